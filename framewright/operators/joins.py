"""Joins of streams and of neighbours in space, with equality keys so that none becomes a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(left: DataFrame, right: DataFrame, at: str, value: str, bucket: Column | None = None, by: list[str] | None = None, tie: str | None = None) -> DataFrame:
    """left with the latest value of right at or before each row's `at`.

    by: keys of both sides. Without keys, time is cut into buckets (hours unless given, an expression over `at`): each
    bucket is ordered apart, and the last value of earlier buckets, one row for each bucket, is carried in. Of rows of
    right at one time the last by `tie` counts (a column of right; the value itself unless given); null values do not.
    """
    by = by or []
    bucket = F.date_trunc("HOUR", F.col(at)) if bucket is None else bucket
    cell = [] if by else ["__bucket"]
    extra = [c for c in left.columns if c not in (*by, at)]
    a = left.select(*by, at, F.struct(*extra).alias("__row"), F.lit(None).cast(right.schema[value].dataType).alias("__value"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[tie or value].dataType).alias("__tie"))
    b = right.select(*by, at, F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col(value).alias("__value"), F.lit(0).alias("__side"), F.col(tie or value).alias("__tie"))
    both = a.unionByName(b)
    both = both if by else both.withColumn("__bucket", bucket)
    order = [F.col(at), F.col("__side"), F.col("__tie")]
    w = Window.partitionBy(*by, *cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__last", F.last("__value", ignorenulls=True).over(w)).where("__side = 1")
    if not by:
        ends = right.select(bucket.alias("__bucket"), F.struct(F.col(at), F.col(tie or value).alias("__tie")).alias("__at"), value).where(F.col(value).isNotNull()).groupBy("__bucket").agg(F.max_by(value, "__at").alias("__end"))
        cells = both.select("__bucket").distinct().join(ends, "__bucket", "left")
        carry = cells.withColumn("__carried", F.last("__end", ignorenulls=True).over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)))
        out = out.join(carry.select("__bucket", "__carried"), "__bucket").withColumn("__last", F.coalesce("__last", "__carried"))
    return out.select(*by, at, *[F.col(f"__row.{c}").alias(c) for c in extra], F.col("__last").alias(value))


def pair_sensors(packets: DataFrame, at: str, step: int = 30) -> DataFrame:
    """(bucket, x1, y1, x2, y2) of buckets of `step` time units in which both sensors report; several reports add up."""
    t = packets.groupBy(F.floor(F.col(at) / step).alias("bucket")).agg(*[F.sum(F.when(F.col("sensor") == s, F.col(f"d{c}"))).alias(f"{c}{s}") for s in (1, 2) for c in "xy"])
    return t.where("x1 IS NOT NULL AND x2 IS NOT NULL")


def sphere(pairs: DataFrame, degrees: float = 90.0) -> DataFrame:
    """Rotations of a sphere from two sensors `degrees` apart: (bucket, pitch, roll, yaw).

    Each sees the turn about its own axis as dx, and as dy a mix of the other two.
    """
    c, s = (0.0, 1.0) if degrees == 90.0 else (F.cos(F.radians(F.lit(degrees))), F.sin(F.radians(F.lit(degrees))))
    return pairs.select("bucket", F.col("y1").cast("double").alias("pitch"), ((F.col("y2") - F.col("y1") * c) / s).alias("roll"), ((F.col("x1") + F.col("x2")) / 2).alias("yaw"))


def zones(rows: DataFrame, x: Column, low: float, high: float, n: int = 7) -> DataFrame:
    """rows with the window, 1 to n from low to high, that x falls in; null outside."""
    inside = (x >= low) & (x < high)
    return rows.withColumn("zone", F.when(inside, F.floor((x - low) / ((high - low) / n)).cast("int") + 1))


def near_pairs(points: DataFrame, cell: int, within: float, keys: list[str] | None = None) -> DataFrame:
    """(a, b, distance) of the points (id, x, y) of one key within a distance, a < b, each pair once.

    Every point lies in one square of side `cell` >= within and is offered to it and its neighbours; pairs meet by equality.
    """
    if within > cell:
        raise ValueError("a cell must be as wide as the distance")
    keys = keys or []
    t = points.select(*keys, "id", "x", "y", F.floor(F.col("x") / cell).alias("i"), F.floor(F.col("y") / cell).alias("j"))
    steps = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    other = t.select(*keys, F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "i", "j", F.explode(steps).alias("s"))
    other = other.select(*keys, "b", "bx", "by", (F.col("i") + F.col("s.di")).alias("i"), (F.col("j") + F.col("s.dj")).alias("j"))
    d = F.sqrt(F.pow(F.col("x") - F.col("bx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("by"), F.lit(2.0)))
    return t.withColumnRenamed("id", "a").join(other, [*keys, "i", "j"]).where("a < b").withColumn("distance", d).where(F.col("distance") <= within).select(*keys, "a", "b", "distance")
