"""Nulls, ties and streams that arrive in several batches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import information, joins, kernels, moments, pixels, sequence
from framewright.streaming import queries as streams


def test_running_moments_after_missing_first_values(spark):
    rows = spark.createDataFrame([("a", k, v) for k, v in enumerate([None, 1.0, None, 2.0, 4.0])], "p string, k long, f double")
    got = moments.running(rows, ["p"]).orderBy("k").collect()
    assert [r["m1"] for r in got][:4] == [None, 1.0, 1.0, 1.5] and [r["n"] for r in got] == [0, 1, 1, 2, 3]
    assert np.allclose([got[4][c] for c in ("m1", "m2")], [7 / 3, 14 / 3])


def test_lowpass_leaves_missing_values_out(spark):
    rows = spark.createDataFrame([("a", k, v) for k, v in enumerate([1.0, None, 1.0, 3.0])], "p string, k long, f double")
    assert np.allclose([r["y"] for r in sequence.lowpass(rows, ["p"], "k", "f").orderBy("k").collect()], [1, 1, 1.6])
    assert [r["y"] for r in sequence.lowpass(rows, ["p"], "k", "f", a=1).orderBy("k").collect()] == [1, 1, 3]
    with pytest.raises(ValueError):
        sequence.lowpass(rows, ["p"], "k", "f", a=0)


def test_edges_from_the_mean_or_the_last(spark):
    rows = spark.createDataFrame([(k, 0, 0, v) for k, v in enumerate([None, 1.0, 4.0, None, None])], "k long, y int, x int, f double")
    assert [r["f"] for r in pixels.fill_edges(rows).orderBy("k").collect()] == [None, 1, 4, 4, 4]
    assert [r["f"] for r in pixels.fill_edges(rows, 2).orderBy("k").collect()] == [None, 1, 4, 2.5, 4]


def test_as_of_ties_go_to_the_last_by_the_tie(spark):
    left = spark.sql("SELECT TIMESTAMP'2024-01-01 12:00:00' AS ts, 1 AS id UNION ALL SELECT TIMESTAMP'2024-01-03 00:30:00', 2")
    right = spark.sql("SELECT TIMESTAMP'2024-01-01 12:00:00' AS ts, v, n FROM VALUES ('z', 1), ('a', 2), ('m', 0) AS t(v, n)").repartition(3)
    assert {r["id"]: r["v"] for r in joins.as_of(left, right, "ts", "v", tie="n").collect()} == {1: "a", 2: "a"}
    assert {r["id"]: r["v"] for r in joins.as_of(left, right, "ts", "v").collect()} == {1: "z", 2: "z"}


def test_partners_within_a_box(spark):
    r = random.Random(1)
    rows = [(k, y * 40 + x, y, x) for k in range(6) for y, x in {(r.randrange(40), r.randrange(40)) for _ in range(60)}]
    active = spark.createDataFrame(rows, "k long, u long, y int, x int")
    got = {(x["a"], x["b"]): x["c"] for x in information.pair_counts(active, "u", "k", 8).collect()}
    want = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and abs(a[2] - b[2]) <= 4 and abs(a[3] - b[3]) <= 4:
                want[a[1], b[1]] = want.get((a[1], b[1]), 0) + 1
    assert got == want


def test_mixture_returns_all_rows(spark):
    rows = [(i, float(i % 2 * 50 + i % 7)) for i in range(60)] + [(90, None), (91, float("nan"))]
    got = kernels.mixture(spark.createDataFrame(rows, "id long, v double"), ["v"]).collect()
    assert len(got) == 62 and {r["id"] for r in got if r["component"] is None} == {90, 91}


def arriving(spark, folder, parts, schema):
    """A stream of one batch for each part."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"p{k}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_streams_in_several_batches(spark, tmp_path):
    r = random.Random(2)
    schema = "u long, o long, v double"
    rows = [(u, o, None if o % 11 == 5 else r.gauss(50, 30)) for o in range(60) for u in (1, 2)]
    parts = [rows[:40], rows[40:44], rows[44:]]
    known = {u: [(o, v) for w, o, v in rows if w == u and v is not None] for u in (1, 2)}
    stream = arriving(spark, tmp_path / "in", parts, schema)
    got = {x["u"]: x for x in streams.stream_moments(stream, ["u"], "v").collect()}
    for u, vs in known.items():
        x = np.array([v for _, v in vs])
        assert np.allclose([got[u][c] for c in ("n", "m1", "m2", "m3", "m4", "lo", "hi")], [len(x), x.mean(), *(((x - x.mean()) ** p).sum() for p in (2, 3, 4)), x.min(), x.max()])
    steps = {(x["by"], x["o"]): x["change"] for x in streams.drained(streams.changes(stream, "u", "o", "v", 20.0)).collect()}
    want = {(u, o): v - w for u, vs in known.items() for (_, w), (o, v) in zip(vs, vs[1:], strict=False) if abs(v - w) > 20}
    assert set(steps) == set(want) and all(abs(steps[k] - want[k]) < 1e-9 for k in want)
    smooth = {(x["by"], x["o"]): x["y"] for x in streams.drained(streams.lowpass(stream, "u", "o", "v")).collect()}
    for u, vs in known.items():
        y = None
        for o, v in vs:
            y = v if y is None else 0.3 * v + 0.7 * y
            assert abs(smooth[u, o] - y) < 1e-9
    full = [x for x in streams.drained(streams.chunks(stream.where(F.col("v").isNotNull()), "u", "o", "v")).collect()]
    assert sorted((x["by"], x["chunk"]) for x in full) == [(u, c) for u in (1, 2) for c in range(len(known[u]) // 16)]
