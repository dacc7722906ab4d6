"""Activation, entropy and information between states; edges and degrees of a network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activation(rows: DataFrame, by: list[str], active: str = "active") -> DataFrame:
    """(by, p): share of rows that are active."""
    return rows.groupBy(*by).agg(F.avg(F.col(active).cast("double")).alias("p"))


def entropy(rows: DataFrame, by: list[str], state: str) -> DataFrame:
    """(by, bits): entropy of a state's distribution."""
    counts = rows.groupBy(*by, state).agg(F.count(F.lit(1)).alias("c"))
    # -sum(c/n log2(c/n)) = log2(n) - sum(c log2 c) / n, so one more aggregate is enough.
    return counts.groupBy(*by).agg((F.log2(F.sum("c").cast("double")) - F.sum(F.col("c") * F.log2(F.col("c").cast("double"))) / F.sum("c")).alias("bits"))


def mutual_information(rows: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """(by, bits): mutual information of two states, from the contingency table."""
    by = by or []
    cells = rows.groupBy(*by, a, b).agg(F.count(F.lit(1)).cast("double").alias("c"))
    x = cells.groupBy(*by, a).agg(F.sum("c").alias("ca"))
    y = cells.groupBy(*by, b).agg(F.sum("c").alias("cb"))
    n = cells.groupBy(*by).agg(F.sum("c").alias("n"))
    t = cells.join(x, [*by, a]).join(y, [*by, b])
    t = t.join(n, by) if by else t.crossJoin(F.broadcast(n))  # one row
    p = F.col("c") / F.col("n")
    return t.groupBy(*by).agg(F.sum(p * F.log2(F.col("c") * F.col("n") / (F.col("ca") * F.col("cb")))).alias("bits"))


#: Side of the square about a unit within which others are its partners.
BOX = 64


def pair_counts(active: DataFrame, unit: str, at: str, box: int | None = None) -> DataFrame:
    """(a, b, c): in how many places `at` two units are active together; a < b. Units meet by equality of the place.

    box: only units within a square of this side about each other, by their columns y and x. Each unit then lies in one
    tile of half the side and is offered to that and its neighbours, so the work of a place grows with its active units
    and not with their square.
    """
    if box is None:
        left, right = active.select(F.col(unit).alias("a"), at), active.select(F.col(unit).alias("b"), at)
        return left.join(right, at).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    half = max(1, box // 2)
    t = active.select(F.col(unit).alias("a"), at, "y", "x", F.floor(F.col("y") / half).alias("i"), F.floor(F.col("x") / half).alias("j"))
    steps = F.array(*[F.struct(F.lit(p).alias("di"), F.lit(q).alias("dj")) for p in (-1, 0, 1) for q in (-1, 0, 1)])
    other = t.select(F.col("a").alias("b"), at, F.col("y").alias("by"), F.col("x").alias("bx"), "i", "j", F.explode(steps).alias("s"))
    other = other.select("b", at, "by", "bx", (F.col("i") + F.col("s.di")).alias("i"), (F.col("j") + F.col("s.dj")).alias("j"))
    near = (F.abs(F.col("y") - F.col("by")) <= half) & (F.abs(F.col("x") - F.col("bx")) <= half)
    return t.join(other, [at, "i", "j"]).where("a < b").where(near).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))


def npmi(active: DataFrame, unit: str, at: str, total: int, box: int | None = None) -> DataFrame:
    """(a, b, p, npmi) of pairs that are ever active together: pointwise mutual information over -log p, in -1..1 (Bouma 2009)."""
    single = active.groupBy(unit).agg(F.count(F.lit(1)).alias("c"))
    t = pair_counts(active, unit, at, box)
    t = t.join(single.select(F.col(unit).alias("a"), F.col("c").alias("ca")), "a").join(single.select(F.col(unit).alias("b"), F.col("c").alias("cb")), "b")
    p = F.col("c") / F.lit(float(total))
    value = F.try_divide(F.log(F.col("c") * F.lit(float(total)) / (F.col("ca") * F.col("cb"))), -F.log(p))
    return t.select("a", "b", p.alias("p"), F.when(p >= 1, 1.0).otherwise(value).alias("npmi"))


def conditional(active: DataFrame, unit: str, at: str, box: int | None = None) -> DataFrame:
    """(a, b, p_b_given_a) of pairs that are ever active together."""
    single = active.groupBy(unit).agg(F.count(F.lit(1)).alias("ca")).withColumnRenamed(unit, "a")
    return pair_counts(active, unit, at, box).join(single, "a").select("a", "b", (F.col("c") / F.col("ca")).alias("p_b_given_a"))


def degrees(edges: DataFrame) -> DataFrame:
    """(unit, degree) of an edge list (a, b)."""
    both = edges.select(F.col("a").alias("unit")).unionAll(edges.select(F.col("b").alias("unit")))
    return both.groupBy("unit").agg(F.count(F.lit(1)).alias("degree"))


def histogram(rows: DataFrame, by: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """(by, bin, n): counts in equal bins from 1; 0 and bins + 1 hold what lies below and above."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by, F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def lagged_correlation(a: DataFrame, b: DataFrame, at: str, value: str, lags: list[int]) -> DataFrame:
    """(lag, r, n): correlation of a's value with b's value `lag` steps later; both sides have one row for each step."""
    moved = a.select((F.col(at)).alias("__a"), F.col(value).alias("__x"), F.explode(F.array(*[F.lit(x) for x in lags])).alias("lag"))
    met = moved.join(b.select(F.col(at).alias("__b"), F.col(value).alias("__y")), F.col("__b") == F.col("__a") + F.col("lag"))
    return met.groupBy("lag").agg(F.corr("__x", "__y").alias("r"), F.count(F.lit(1)).alias("n"))
