"""Operators over ordered rows: slopes, shapes, filters, decomposition, pacing, numbering, runs and rotations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def moving_slope(rows: DataFrame, by: list[str], order: str, value: str, before: int = 5, after: int = 0) -> DataFrame:
    """Least-squares slope of a value over the row number, in a frame of rows about each; null for fewer than two."""
    numbered = rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("double"))
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-before, after)
    slope = F.try_divide(F.covar_pop("r", value).over(w), F.var_pop("r").over(w))
    return numbered.select(*by, order, F.when(F.count(value).over(w) > 1, slope).alias("slope"))


def moving_shape(rows: DataFrame, by: list[str], order: str, value: str, before: int = 9, least: int = 4) -> DataFrame:
    """Skewness and raw kurtosis in a frame of rows up to each; null for fewer than `least`."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-before, 0)
    enough = F.count(value).over(w) >= least
    return rows.select(*by, order, F.when(enough, F.skewness(value).over(w)).alias("skew"), F.when(enough, F.kurtosis(value).over(w) + 3).alias("kurt"))


def lowpass(rows: DataFrame, by: list[str], order: str, value: str, a: float = 0.3, chunk: int = 64) -> DataFrame:
    """y = a x + (1 - a) y', from y = x at the first row of each key; rows without a value are left out, as in the streaming form.

    The filter is an affine map, so chunks of rows are filtered apart and joined by their last values: within a chunk
    by a sum of scaled inputs, between chunks by the same rule, whose weights fall so fast that only the chunks within
    double precision of one another count.
    """
    if not 0 < a <= 1:
        raise ValueError("a must be over 0 and at most 1")
    rows = rows.where(F.col(value).isNotNull())
    if a == 1:
        return rows.select(*by, order, F.col(value).alias("y"))
    b = 1.0 - a
    key = Window.partitionBy(*by).orderBy(order)
    t = rows.withColumn("r", F.row_number().over(key) - 1).withColumn("c", F.floor(F.col("r") / chunk)).withColumn("j", F.col("r") % chunk)
    x = F.when(F.col("r") == 0, F.col(value)).otherwise(a * F.col(value))
    w = Window.partitionBy(*by, "c").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("own", F.sum(x * F.pow(F.lit(b), -F.col("j").cast("double"))).over(w) * F.pow(F.lit(b), F.col("j").cast("double")))
    ends = t.groupBy(*by, "c").agg(F.max_by("own", "j").alias("end"))
    reach = max(1, math.ceil(-45.0 / (chunk * math.log(b))))
    back = Window.partitionBy(*by).orderBy("c")
    carried: Column = F.lit(0.0)
    for k in range(1, reach + 1):
        carried = carried + F.coalesce(F.lag("end", k).over(back), F.lit(0.0)) * F.lit(b ** (chunk * (k - 1)))
    ends = ends.select(*by, "c", carried.alias("carried"))
    return t.join(ends, [*by, "c"]).select(*by, order, (F.col("own") + F.col("carried") * F.pow(F.lit(b), F.col("j") + 1.0)).alias("y"))


def decompose(series: DataFrame, at: str, value: str, period: int = 7) -> DataFrame:
    """(at, value, trend, season, rest) of a short, already aggregated series: centred moving mean, mean by phase, remainder.

    at counts steps; the series is ordered in one partition, for it has one row for each step.
    """
    w = Window.orderBy(at).rowsBetween(-(period // 2), period // 2)
    t = series.withColumn("trend", F.avg(value).over(w)).withColumn("d", F.col(value) - F.col("trend"))
    t = t.withColumn("season", F.avg("d").over(Window.partitionBy(F.pmod(F.col(at), F.lit(period)))))
    return t.select(at, value, "trend", "season", (F.col("d") - F.col("season")).alias("rest"))


def pacing(slides: DataFrame, by: list[str], order: str, allotted: Column, elapsed: Column) -> DataFrame:
    """Running sum of allotted time and the status: left < 0 is behind, left < the slide's own time on-track, else ahead."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    t = slides.select(*by, order, allotted.alias("own"), F.sum(allotted).over(w).alias("allotted"), elapsed.alias("elapsed"))
    left = F.col("allotted") - F.col("elapsed")
    return t.select(*by, order, "allotted", "elapsed", F.when(left < 0, "behind").when(left < F.col("own"), "on-track").otherwise("ahead").alias("status"))


def progress(slides: DataFrame, by: list[str], order: str, shown: Column | None = None, fragments: Column | None = None, weight: float = 0.9) -> DataFrame:
    """Slides before each, all slides, and the share that is done.

    shown of a slide's fragments: as long as some are hidden they count as that part of `weight` of a slide.
    """
    past = (F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).cast("long")
    total = F.count(F.lit(1)).over(Window.partitionBy(*by))
    part = F.lit(0.0) if shown is None or fragments is None else F.when(shown < fragments, shown / fragments * weight).otherwise(0.0)
    return slides.select(*by, order, past.alias("past"), total.alias("total"), F.when(total > 1, F.least(F.lit(1.0), (past + part) / (total - 1))).otherwise(1.0).alias("done"))


def reindex(fragments: DataFrame, by: list[str], index: Column, position: str) -> DataFrame:
    """Gapless group numbers from 0: fragments of one explicit index form a group, in order; then each without one is its own."""
    order = Window.partitionBy(*by).orderBy(F.col("idx").isNull(), "idx", F.when(F.col("idx").isNull(), F.col(position)))
    return fragments.select(*by, position, index.alias("idx")).select(*by, position, (F.dense_rank().over(order) - 1).cast("int").alias("fragment"))


def stack(slides: DataFrame, by: list[str], order: str, starts: Column) -> DataFrame:
    """(h, v): horizontal number, one up at each row that starts a stack, and vertical number within it, both from 0."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy(*by).orderBy(order)) == 1
    t = slides.select(*by, order, first.alias("first"), starts.alias("starts")).withColumn("h", F.sum(F.when(F.col("starts") & ~F.col("first"), 1).otherwise(0)).over(w))
    return t.select(*by, order, F.col("h").cast("long").alias("h"), (F.row_number().over(Window.partitionBy(*by, "h").orderBy(order)) - 1).cast("long").alias("v"))


def counters(items: DataFrame, by: list[str], order: str) -> DataFrame:
    """Number of each list item within its list and level, from 1."""
    return items.select(*by, order, F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("long").alias("number"))


def runs(rows: DataFrame, by: list[str], order: str, state: str) -> DataFrame:
    """Maximal runs of equal state: (by, run, state, low, high, n), runs numbered from 0."""
    w = Window.partitionBy(*by).orderBy(order)
    change = F.when(F.col(state).eqNullSafe(F.lag(state).over(w)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    t = rows.select(*by, order, state, change.alias("new")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return t.groupBy(*by, "run").agg(F.first(state).alias(state), F.min(order).alias("low"), F.max(order).alias("high"), F.count(F.lit(1)).alias("n"))


def rotations(rows: DataFrame, by: list[str], order: str, degrees: Column) -> DataFrame:
    """Full turns so far of an orientation series: steps are taken the short way round."""
    w = Window.partitionBy(*by).orderBy(order)
    t = rows.select(*by, order, degrees.alias("a"))
    step = F.col("a") - F.lag("a").over(w)
    t = t.select(*by, order, F.coalesce(F.pmod(step + 180.0, F.lit(360.0)) - 180.0, F.lit(0.0)).alias("step"))
    return t.select(*by, order, (F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)) / 360.0).alias("turns"))


def demodulate(rows: DataFrame, by: list[str], order: str, value: str, period: int) -> DataFrame:
    """In-phase and quadrature part of a value at one period, for each key."""
    phase = F.col(order) * (2 * math.pi / period)
    return rows.groupBy(*by).agg((2 * F.avg(F.col(value) * F.cos(phase))).alias("i"), (2 * F.avg(F.col(value) * F.sin(phase))).alias("q"))
