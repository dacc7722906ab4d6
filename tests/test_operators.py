"""Golden and property cases of single operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import text as fn
from framewright.operators import documents, information, joins, kernels, moments, pixels, regions, search, sequence
from framewright.sources import files
from framewright.sources.frames import bin_frames
from framewright.streaming import queries as streams


def prefixes(values):
    """Number, mean and sums of powers of deviations of each prefix, in two passes."""
    out = []
    for n in range(1, len(values) + 1):
        mean = math.fsum(values[:n]) / n
        out.append((float(n), mean, *(math.fsum((v - mean) ** p for v in values[:n]) for p in (2, 3, 4))))
    return out


def values(spark, xs, key="a"):
    return spark.createDataFrame([(key, i, float(x)) for i, x in enumerate(xs)], "p string, k long, f double")


def test_running_moments_are_those_of_each_prefix(spark):
    random.seed(1)
    xs = [random.gauss(1000, 3) for _ in range(60)]
    got = moments.running(values(spark, xs), ["p"]).orderBy("k").collect()
    for row, want in zip(got, prefixes(xs), strict=True):
        assert np.allclose([row[c] for c in ("n", "m1", "m2", "m3", "m4")], want, rtol=1e-8, atol=1e-7)


def test_golden_moments(spark):
    row = moments.running(values(spark, [1, 2, 4, 8]), ["p"]).orderBy(F.desc("k")).first()
    assert (row["n"], row["m1"], round(row["m2"], 9), row["fmin"], row["fmax"]) == (4, 3.75, 28.75, 1, 8)
    flat = moments.differential(values(spark, [5, 5, 5]), ["p"]).orderBy("k").collect()
    assert [r["d_skew"] for r in flat] == [None, None, None] and flat[0]["dm2"] == 0


def test_states_merge(spark):
    random.seed(2)
    xs = [random.expovariate(0.1) for _ in range(50)]
    parts = moments.states(values(spark, xs[:17], "a").union(values(spark, xs[17:], "b")), ["p"]).collect()
    a, b = (next(r["state"] for r in parts if r["p"] == p) for p in "ab")
    pair = spark.createDataFrame([(a, b)], f"a {moments.STATE}, b {moments.STATE}")
    got = pair.select(moments.merge_states(F.col("a"), F.col("b")).alias("s")).first()["s"]
    assert np.allclose([got[c] for c in ("n", "m1", "m2", "m3", "m4")], prefixes(xs)[-1], rtol=1e-9)
    assert (got["lo"], got["hi"]) == (min(xs), max(xs))


def test_lowpass_over_chunks(spark):
    xs = [math.sin(i) * 10 for i in range(300)]
    got = [r["y"] for r in sequence.lowpass(values(spark, xs), ["p"], "k", "f", chunk=16).orderBy("k").collect()]
    want = []
    for x in xs:
        want.append(x if not want else 0.3 * x + 0.7 * want[-1])
    assert np.allclose(got, want, atol=1e-9)


def test_as_of_without_keys_carries_over_days(spark):
    left = spark.sql("SELECT TIMESTAMP'2024-01-01 12:00:00' AS ts, 1 AS id UNION ALL SELECT TIMESTAMP'2024-01-05 00:00:00', 2 UNION ALL SELECT TIMESTAMP'2023-12-31 23:00:00', 3")
    right = spark.sql("SELECT TIMESTAMP'2024-01-01 12:00:00' AS ts, 'a' AS v UNION ALL SELECT TIMESTAMP'2024-01-02 01:00:00', 'b' UNION ALL SELECT TIMESTAMP'2024-01-02 02:00:00', 'c'")
    assert {r["id"]: r["v"] for r in joins.as_of(left, right, "ts", "v").collect()} == {1: "a", 2: "c", 3: None}


def test_near_pairs_are_complete(spark):
    random.seed(3)
    pts = [(i, random.uniform(-5, 5), random.uniform(-5, 5)) for i in range(80)]
    got = {(r["a"], r["b"]) for r in joins.near_pairs(spark.createDataFrame(pts, "id int, x double, y double"), 2, 1.5).collect()}
    assert got == {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and math.dist(a[1:], b[1:]) <= 1.5}


def test_diagonal_pixels_are_one_component(spark):
    on = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 3, 3)], "k long, y int, x int")
    assert sorted((r["k"], r["label"]) for r in regions.components(on, 4, 4).collect()) == [(0, 0), (0, 0), (1, 15)]


def test_merged_regions(spark):
    found = spark.createDataFrame([(i,) for i in range(9)], "id long")
    edges = spark.createDataFrame([(0, 3), (3, 6), (6, 7), (1, 2)], "a long, b long")
    assert {r["id"]: r["roi"] for r in regions.merged(found, edges).collect()} == {0: 0, 3: 0, 6: 0, 7: 0, 1: 1, 2: 1, 4: 4, 5: 5, 8: 8}


def test_phase_correlation_finds_shifts(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(8, 8))
    rows = [(k, np.roll(base, (dy, dx), (0, 1)).ravel().tolist()) for k, (dy, dx) in enumerate([(0, 0), (1, 2), (-2, 3)])]
    f = spark.createDataFrame([*rows, (9, None)], "k long, pixels array<double>")
    template = spark.createDataFrame([(base.ravel().tolist(),)], "pixels array<double>")
    got = {r["k"]: (r["dy"], r["dx"]) for r in kernels.phase_correlation(f, template).collect()}
    assert [tuple(map(round, got[k])) for k in (0, 1, 2)] == [(0, 0), (1, 2), (-2, 3)]
    assert got[9] == (None, None) or all(map(math.isnan, got[9]))


def test_binning(spark):
    f = spark.createDataFrame([(0, [float(i) for i in range(16)])], "k long, pixels array<double>")
    assert bin_frames(f, 4).first()["pixels"] == [2.5, 4.5, 10.5, 12.5]


def test_mutual_information_of_copies_is_their_entropy(spark):
    t = spark.createDataFrame([(i % 4, i % 4) for i in range(16)], "a int, b int")
    assert abs(information.mutual_information(t, "a", "b").first()["bits"] - 2) < 1e-9


def pages(spark):
    rows = [(0, "Cats", "cat and cat", "pets", "en/cats"), (1, "Dogs", "a dog chased a cat.", "pets", "en/dogs"), (2, "Empty", None, "", "de/cat-only-url"), (3, "Birds", "no such", "", "en/birds")]
    return spark.createDataFrame(rows, "pos int, title string, text string, tags string, url string")


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("cat", {0: 80, 1: 20, 2: 20}),
        ("cat dog", {0: 80, 1: 80, 2: 20}),
        ('"a cat"', {1: 20}),
        ("-dog cat", {0: 80, 1: 20, 2: 20}),
        ("cat -dog", {0: 80, 2: 20}),
        ("the and", {}),
        ("ca", {}),
        ("cat  -", {0: 80, 1: 20, 2: 20}),
    ],
)
def test_search_scores(spark, said, want):
    assert {r["pos"]: r["score"] for r in search.matches(pages(spark), said).collect()} == want


def test_search_parse():
    assert search.parse("The").problem == "stop words" and search.parse("ab").problem == "too short" and search.parse(" 'x y z' ").phrase


def test_search_page_and_snippet(spark):
    rows = search.search(pages(spark), "cat", 0, 2).collect()
    assert [r["title"] for r in rows] == ["Cats", "Dogs"]
    assert rows[0]["snippet"] == '<span class="SearchResults__highlight">cat</span> and cat ...' and rows[1]["snippet"].endswith("cat</span>.")
    assert [r["url"] for r in search.search(pages(spark), "cat", lang="de").collect()] == ["de/cat-only-url"]
    assert search.search(pages(spark), "c(t", literal=True).count() == 0
    assert search.count_and_links(pages(spark), "cat", show=1).first()["links"] == [1, 2, 3]


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "c string").select(expression(F.col("c")).alias("r")).first()["r"]


def test_text_functions(spark):
    assert one(spark, fn.escape_html, "<b>&") == "&lt;b&gt;&"
    assert one(spark, fn.straight_quotes, "“a” “b”") == '"a" “b”'
    assert one(spark, fn.deindent, "  a\n    b\n\n  c") == "a\n  b\n\nc"
    assert one(spark, fn.slide_notes, "x\nNotes: y").notes == "y" and one(spark, fn.slide_notes, "a\nnote: b\nnote: c").notes is None
    assert one(spark, fn.attributes, 'a="1" b="2" a="3"') == {"a": "3", "b": "2"}
    assert one(spark, fn.kept_attributes, 'data-markdown="x" class="y"') == {"class": "y"}
    assert one(spark, fn.typed, "2.5").number == 2.5 and one(spark, fn.typed, "true").flag is True and one(spark, fn.typed, "null").kind == "null"
    assert one(spark, fn.query_map, "?a=1+2&b=%41&a=3") == {"a": "3", "b": "A"}
    assert one(spark, fn.last_two, "7") == "07" and one(spark, fn.last_two, "123") == "23"
    assert one(spark, lambda c: fn.lead_int(c, 9), "12px") == 12 and one(spark, lambda c: fn.lead_int(c, 9), "px") == 9
    assert one(spark, fn.rewrite_comments, "a ==MB look== b") == 'a <span class="comment" data-by="MB">look</span> b'
    assert one(spark, fn.clean_file_name, "my -_file.PNG") == "my_file.png"
    assert one(spark, fn.url_display, "HTTP://A.b/C") == "a.b/c"
    assert one(spark, fn.is_format, "docx") and not one(spark, fn.is_format, "xdocx")
    assert one(spark, fn.brightness, "#fff") == 255 and one(spark, fn.brightness, "rgb(10, 20, 30)") == (2990 + 11740 + 3420) / 1000 and one(spark, fn.brightness, "red") is None
    assert one(spark, lambda c: fn.duration(c.cast("long")), "-3661") == "-01:01:01"


def test_documents(spark):
    t = spark.createDataFrame([("d", 2, "b c"), ("d", 1, "é")], "doc string, ord int, text string")
    assert tuple(documents.merge(t, ["doc"], "ord", "text").first()) == ("d", "é\nb c", 6, 3)
    picked = documents.only(spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "z")], "k string, v string"), ["k"], "v").orderBy("k").collect()
    assert [tuple(r) for r in picked] == [("a", "x", None), ("b", None, "2 candidates")]


def test_packets(spark):
    good, bad = files.packets(spark.createDataFrame([("s1x34y-3",), ("s2x-5y0",), ("s1x3",), (None,)], "value string"))
    assert [tuple(r)[1:] for r in good.collect()] == [(1, 34, -3), (2, -5, 0)] and bad.count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "i.json").write_text('{"pages": [{"title": "a", "text": false, "tags": "", "url": "u"}, {"title": "b", "text": "x", "tags": "", "url": "v"}]}')
    assert [r["text"] for r in files.search_index(spark, str(tmp_path / "i.json")).orderBy("title").collect()] == [None, "x"]
    recipes = files.recipes(spark.createDataFrame([('{"name": "a", "options": ["x", "y"]}',), ('{"name": "b", "options": "z"}',)], "value string"), {"format": "pdf"}).orderBy("name").collect()
    assert [(r["options"], r["format"]) for r in recipes] == [(["x", "y"], "pdf"), (["z"], "pdf")]
    meta = files.front_matter(spark.createDataFrame([("---\na: 1\nb: two\n---\nrest",), ("none",)], "text string")).collect()
    assert meta[0]["meta"] == {"a": "1", "b": "two"} and meta[1]["meta"] == {}
    for name in ("a.md", "b.PNG", ".hidden.png"):
        (tmp_path / "f").mkdir(exist_ok=True)
        (tmp_path / "f" / name).write_text("x")
    assert [r["name"] for r in files.images(spark, str(tmp_path / "f")).collect()] == ["b.PNG"]
    files.write_as(spark.range(3), str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    with pytest.raises(ValueError):
        files.write_as(spark.range(1), str(tmp_path / "no"), "pdf")


def test_shift_and_gradient(spark):
    f = spark.createDataFrame([(0, [float(y * y + x) for y in range(4) for x in range(4)])], "k long, pixels array<double>")
    moved = pixels.shift(f, F.lit(1), F.lit(0), 4).first()["pixels"]
    assert moved[:4] == [None] * 4 and moved[4:8] == [0.0, 1.0, 2.0, 3.0]
    g = pixels.gradients(f, 4).where("y = 1 AND x = 1").first()
    assert (g["gx"], g["gy"], g["l1"], g["l2"]) == (1.0, 2.0, 2.0, 0.0)


def test_late_batches():
    assert streams.late_batches([{"batchId": 0, "batchDuration": 20}, {"batchId": 1, "batchDuration": 90}], 50) == [1]
