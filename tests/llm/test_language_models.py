"""Operator 3 against plain Kneser-Ney models, and what its rejection takes."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from framewright.llm import language


def plain(text):
    out = "".join(c if c.isalpha() else " " for c in text.lower())
    return " " + " ".join(out.split()) + " " if out.split() else ""


class Brute:
    """Interpolated Kneser-Ney by dictionaries: counts at the highest order, different symbols before at the others."""

    def __init__(self, texts, order):
        self.order = order
        self.count = []
        for n in range(1, order + 1):
            c = Counter()
            if n == order:
                for t in texts:
                    c.update(t[i - n + 1 : i + 1] for i in range(n - 1, len(t)))
            else:
                c.update(g[1:] for g in {t[i - n : i + 1] for t in texts for i in range(n, len(t))})
            by = defaultdict(dict)
            for g, k in c.items():
                by[g[:-1]][g[-1]] = k
            self.count.append(by)

    def cost(self, t):
        total = 0.0
        for i in range(1, len(t)):
            p = 1 / language.CHARS
            for n in range(1, self.order + 1):
                here = self.count[n - 1].get(t[i - n + 1 : i]) if i - n + 1 >= 0 else None
                if here:
                    all_ = sum(here.values())
                    p = max(here.get(t[i], 0) - language.DISCOUNT, 0) / all_ + language.DISCOUNT * len(here) / all_ * p
            total -= math.log(p)
        return total / (len(t) - 1)


@pytest.mark.parametrize("order", [1, 2, 4])
def test_entropies_are_those_of_plain_models(order):
    r = random.Random(order)
    some = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(n))
    texts = {"x": [some("abcd", 30) for _ in range(6)], "y": [some("cdeé", 30) for _ in range(6)]}
    models = language.Models(texts, order)
    tests = [some("abcde", 12) for _ in range(20)] + ["a", "Ab! cd.", "zzz", texts["x"][0]]
    cost, size = models.entropies(tests)
    for k, lang in enumerate(models.langs):
        brute = Brute([plain(t) for t in texts[lang]], order)
        assert np.allclose(cost[:, k], [brute.cost(plain(t)) for t in tests], rtol=1e-5)
    assert size.tolist() == [len(plain(t)) - 1 for t in tests]
    assert [p[0] for p in models.predict(tests)] == [models.langs[k] for k in cost.argmin(1)]


def test_what_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = language.fit(docs)
    own = {lang: [r["text"] for r in docs.where(f"lang = '{lang}'").limit(60).collect()] for lang in ("en", "de")}
    r = random.Random(3)
    junk = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(300)) for _ in range(40)]
    foreign = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw", "kuu nousee metsän ylle ja lapset nukkuvat hiljaa talossa jossa tuuli soi"]
    both = [f"{a} {b}" for a, b in zip(own["en"], own["de"], strict=True)]
    assert all(p[3] and p[1] < 0.34 for p in models.predict(junk + foreign))
    assert not any(p[3] for p in models.predict([*own["en"], *own["de"], *both]))


def test_hot_rows_without_ids_do_not_swell_the_sample(docs, spark):
    rows = docs([(None, "one and the same text of one language")] * 3000 + [(k, f"other text {k} of it") for k in range(20)])
    models = language.fit(rows, sample=10)
    assert models.langs == ["en"] and language.identify(rows, models).count() == 3020
    got = {x["doc_id"]: (x["lang_pred"], x["rejected"]) for x in language.identify(docs([(None, None), (1, "")]), models).collect()}
    assert got == {None: ("und", True), 1: ("und", True)}


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 2)
    df = spark.createDataFrame([(k, "text", f"l{k}") for k in range(12)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        language.fit(df)
