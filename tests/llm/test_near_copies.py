"""The pipeline's near-duplicate stage: other texts of an id, large buckets."""

import random

import pytest

import corpus_pipeline
from framewright.llm import copies, simhash


def stage(spark, docs):
    return sorted(((x["doc_id"], x["text"]) for x in corpus_pipeline.near_dedup(spark, docs.select(*corpus_pipeline.COLUMNS), "").collect()), key=repr)


def test_texts_of_one_id_are_different_documents(spark, docs):
    r = random.Random(1)
    a, b, c = (" ".join(f"{k}{r.randrange(500)}" for _ in range(80)) for k in "abc")
    rows = [(4, a), (4, b), (4, b), (5, b), (6, c), (6, f"{c} end"), (None, a), (None, a)]
    got = stage(spark, docs(rows))
    assert [g for g in got if g[0] is None] == [(None, a)] * 2
    assert {g for g in got if g[0] == 4} == {(4, a), (4, b)} and len([g for g in got if g[0] == 4]) == 2
    assert not [g for g in got if g[0] == 5] and len([g for g in got if g[0] == 6]) == 1


@pytest.mark.parametrize("crowd", [2, 2000])
def test_links_join_all_near_copies(spark, docs, monkeypatch, crowd):
    monkeypatch.setattr(copies, "CROWD", crowd)
    r = random.Random(2)
    texts = []
    for k in range(12):
        base = [f"w{r.randrange(4000)}" for _ in range(120)]
        texts.append(" ".join(base))
        for _ in range(6):
            at = {r.randrange(120) for _ in range(r.choice([1, 2, 3, 5, 9]))}
            texts.append(" ".join(f"n{r.randrange(10**6)}" if i in at else w for i, w in enumerate(base)))
    sets = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and group[a] != group[b]:
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    found = simhash.near_duplicates(docs(texts), radius=1, also=copies.near_copies(docs(texts)))
    got = {x["doc_id"]: x["component_id"] for x in found.collect()}
    assert got == dict(enumerate(group))


@pytest.mark.parametrize("part", [16, 1024])
def test_a_large_group_of_copies_with_few_to_many_changes(spark, docs, monkeypatch, part):
    monkeypatch.setattr(copies, "PART", part)
    monkeypatch.setattr(copies, "WIDTH", 8 * part)
    r = random.Random(3)
    base = [f"w{k}" for k in range(100)]
    texts = []
    for k in range(150):
        at = {r.randrange(100) for _ in range(r.randrange(9))}
        texts.append(" ".join(f"n{r.randrange(10**6)}" if i in at else w for i, w in enumerate(base)))
    sets = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and group[a] != group[b]:
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    assert 1 < len(set(group)) < 150
    rows = docs(texts + texts[:1] * 50)
    links = copies.near_copies(rows)
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(rows, radius=1, also=links).collect()}
    assert got == dict(enumerate(group)) | {k: 0 for k in range(150, 200)}
    assert links.count() < 150 * 36  # by pivots, not by pairs
