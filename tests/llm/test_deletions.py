"""Operators 1 and 4: cases in which a wrong key or a wrong number of lines would delete what is alone."""

import hashlib
import random

import numpy as np
from compare import SF, same

from framewright.llm import lines, substring
from framewright.llm.queries import QUERIES, SQL


def test_rows_of_one_id_are_different_documents(docs):
    w, z = " ".join(f"w{k}" for k in range(40)), " ".join(f"z{k}" for k in range(60))
    rows = [(1, w), (2, w), (2, z), (2, z), (3, f"{z} end")]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.remove_repeated(docs(rows)).collect())
    assert got == [(1, 40, 0), (2, 40, 40), (2, 60, 0), (2, 60, 0), (3, 61, 60)]


def test_windows_within_several_texts_of_an_id(docs, monkeypatch):
    monkeypatch.setattr(substring, "SEVERAL", 0)
    w = [" ".join(f"{a}{k}" for k in range(25)) for a in "abc"]
    rows = [(7, f"{w[0]} x {w[0]}"), (7, f"{w[1]} y {w[0]}"), (7, w[2])]
    got = [(r["n_words"], r["n_removed"]) for r in substring.remove_repeated(docs(rows)).collect()]
    assert sorted(n for n, _ in got) == [25, 51, 51] and sum(g for _, g in got) == 50  # two of three copies go, whatever the order


def test_substring_query_is_sql(spark):
    same(QUERIES["op1_substring_dedup"](spark, SF), SQL["op1_substring_dedup"], SF)


def test_matching_statistics():
    r = random.Random(5)
    text = np.array([r.randrange(1, 4) for _ in range(300)] + [0])
    index = substring.FmIndex(text, 8)
    end = np.arange(8, 301)
    length, which, low, high = index.matching(text, end, 8)
    line = "".join(map(str, text.tolist()))

    def times(part):
        return sum(line.startswith(part, k) for k in range(len(line)))

    for e, n in zip(end.tolist(), length.tolist(), strict=True):
        assert n == max((m for m in range(1, 9) if times(line[e - m : e]) > 1), default=0)
    assert set(which.tolist()) == {k for k, n in enumerate(length.tolist()) if n == 8}
    assert [b - a for a, b in zip(low.tolist(), high.tolist(), strict=True)] == [times(line[end[k] - 8 : end[k]]) for k in which.tolist()]


def test_unicode_line_ends_are_lines(docs):
    rows = [(0, "k1\nk2"), (1, " \nu1\nk1\nk2\nkeep"), (2, "\u0085\nv1\n \nk1\nk2"), (3, " \n\u0085\nv1")]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in lines.remove_line_runs(docs(rows)).collect()}
    assert got == {0: (rows[0][1], 2, 0), 1: (" \nu1\nkeep", 5, 2), 2: ("\u0085\nv1\n ", 5, 2), 3: (" ", 3, 2)}
    assert hashlib.sha256(got[1][0].encode()).hexdigest()
