"""Central moments of pixels over time: batch, running and differential, and how partial ones merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATE = "struct<n:double,m1:double,m2:double,m3:double,m4:double,lo:double,hi:double>"


def shape(n: Column, m2: Column, m3: Column, m4: Column) -> list[Column]:
    """var_samp, skew and raw kurt from sums of powers of deviations; null where they are not defined."""
    return [F.try_divide(m2, F.greatest(F.lit(1.0), n - 1)).alias("var_samp"), F.try_divide(m3 * F.sqrt(n), F.pow(m2, F.lit(1.5))).alias("skew"), F.try_divide(m4 * n, m2 * m2).alias("kurt")]


def moments(values: DataFrame, by: list[str], value: str = "f") -> DataFrame:
    """n, mean, var_samp, skew, kurt, fmin and fmax of a value for each key; nulls do not count."""
    v = F.col(value)
    return values.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var_samp"), F.skewness(v).alias("skew"), (F.kurtosis(v) + 3).alias("kurt"), F.min(v).alias("fmin"), F.max(v).alias("fmax"))


def merge_states(a: Column, b: Column) -> Column:
    """State of the union of two disjoint samples, by the pairwise formulas of Pébay (2008)."""
    n = a["n"] + b["n"]
    d = b["m1"] - a["m1"]
    s = F.try_divide(d, n)
    m2 = a["m2"] + b["m2"] + d * s * a["n"] * b["n"]
    m3 = a["m3"] + b["m3"] + d * s * s * a["n"] * b["n"] * (a["n"] - b["n"]) + 3 * s * (a["n"] * b["m2"] - b["n"] * a["m2"])
    m4 = a["m4"] + b["m4"] + d * s * s * s * a["n"] * b["n"] * (a["n"] * a["n"] - a["n"] * b["n"] + b["n"] * b["n"]) + 6 * s * s * (a["n"] * a["n"] * b["m2"] + b["n"] * b["n"] * a["m2"]) + 4 * s * (a["n"] * b["m3"] - b["n"] * a["m3"])
    both = F.struct(n.alias("n"), (a["m1"] + s * b["n"]).alias("m1"), m2.alias("m2"), m3.alias("m3"), m4.alias("m4"), F.least(a["lo"], b["lo"]).alias("lo"), F.greatest(a["hi"], b["hi"]).alias("hi")).cast(STATE)
    return F.when(a["n"] == 0, b.cast(STATE)).when(b["n"] == 0, a.cast(STATE)).otherwise(both)


def states(values: DataFrame, by: list[str], value: str = "f") -> DataFrame:
    """A mergeable state for each key, from one pass of built-in aggregates."""
    v = F.col(value)
    n = F.count(v).cast("double")
    pop = F.var_pop(v)
    return values.groupBy(*by).agg(
        F.struct(
            n.alias("n"), F.coalesce(F.avg(v), F.lit(0.0)).alias("m1"), F.coalesce(pop * n, F.lit(0.0)).alias("m2"),
            F.coalesce(F.skewness(v) * n * F.pow(pop, F.lit(1.5)), F.lit(0.0)).alias("m3"), F.coalesce((F.kurtosis(v) + 3) * n * pop * pop, F.lit(0.0)).alias("m4"),
            F.min(v).alias("lo"), F.max(v).alias("hi"),
        ).cast(STATE).alias("state")
    )


def running(values: DataFrame, by: list[str], order: str = "k", value: str = "f") -> DataFrame:
    """State after each sample: n, m1 (mean), m2, m3, m4 (sums of powers of deviations), fmin, fmax.

    Sums of powers about each key's first known value run over the order; their combinations give the central sums. Nulls
    do not count: before the first known value n is 0 and the mean null.
    """
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    about = F.first(value, ignorenulls=True).over(w)
    t = values.withColumn("__d", F.col(value) - about)
    power = lambda p: F.sum(F.pow("__d", F.lit(float(p)))).over(w)
    t = t.select("*", F.count(value).over(w).cast("double").alias("n"), power(1).alias("s1"), power(2).alias("s2"), power(3).alias("s3"), power(4).alias("s4"), F.min(value).over(w).alias("fmin"), F.max(value).over(w).alias("fmax"), about.alias("c"))
    u = F.try_divide(F.col("s1"), F.col("n"))
    n = F.col("n")
    m2 = F.col("s2") - n * u * u
    m3 = F.col("s3") - 3 * u * F.col("s2") + 2 * n * u * u * u
    m4 = F.col("s4") - 4 * u * F.col("s3") + 6 * u * u * F.col("s2") - 3 * n * u * u * u * u
    one = lambda m: F.when(n > 1, m).otherwise(0.0)  # noqa: E731  a single sample has no spread, whatever rounding says
    return t.select(*by, order, value, "n", (F.col("c") + u).alias("m1"), one(m2).alias("m2"), one(m3).alias("m3"), one(m4).alias("m4"), "fmin", "fmax")


def differential(values: DataFrame, by: list[str], order: str = "k", value: str = "f") -> DataFrame:
    """What each sample adds to m1..m4, and the shape of that: d_var, d_skew and d_kurt divide by m2 after the update."""
    state = running(values, by, order, value)
    w = Window.partitionBy(*by).orderBy(order)
    d = {k: F.col(f"m{k}") - F.coalesce(F.lag(f"m{k}").over(w), F.lit(0.0)) for k in (1, 2, 3, 4)}
    out = state.select(*by, order, "n", "m2", *[v.alias(f"dm{k}") for k, v in d.items()])
    n, m2 = F.col("n"), F.col("m2")
    return out.select(*by, order, "dm1", "dm2", "dm3", "dm4", (F.col("dm2") / F.greatest(F.lit(1.0), n - 1)).alias("d_var"), F.try_divide(F.col("dm3") * F.sqrt(F.greatest(F.lit(1.0), n)), F.pow(m2, F.lit(1.5))).alias("d_skew"), F.try_divide(F.col("dm4") * n, m2 * m2).alias("d_kurt"))
