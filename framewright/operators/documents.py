"""Document operators: ordered merges, sizes, layered settings, recipes and unique choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge(parts: DataFrame, by: list[str], order: str, text: str, between: str = "\n") -> DataFrame:
    """(by, text, n_bytes, n_words): the parts of each document in order, one document's at a time."""
    t = parts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("__p"))
    t = t.select(*by, F.array_join(F.transform("__p", lambda p: p[text]), between).alias("text"))
    return t.select(*by, "text", *sizes(F.col("text")))


def sizes(text: Column) -> list[Column]:
    """n_bytes and n_words of a text."""
    return [F.octet_length(text).cast("long").alias("n_bytes"), F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(F.regexp_replace(text, r"[\x09-\x0D]+", " ")), " +"))).cast("long").alias("n_words")]


def layered(*layers: Column) -> Column:
    """Maps merged into one, later ones winning; a null map counts as empty."""
    some = [F.coalesce(m, F.create_map().cast("map<string,string>")) for m in layers]
    keys = F.array_distinct(F.concat(*[F.map_keys(m) for m in some]))
    pick = lambda k: F.coalesce(*[F.when(F.map_contains_key(m, k), F.struct(F.element_at(m, k).alias("v"))) for m in reversed(some)])["v"]
    return F.map_from_arrays(keys, F.transform(keys, pick))


def resolve(*choices: Column) -> Column:
    """The first choice that is given: command line, then document, then default."""
    return F.coalesce(*choices)


def only(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, problem): the one candidate of each key; null with a problem if there are several."""
    t = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min(value).alias(value))
    return t.select(*by, F.when(F.col("__n") == 1, F.col(value)).alias(value), F.when(F.col("__n") > 1, F.concat(F.col("__n").cast("string"), F.lit(" candidates"))).alias("problem"))


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """Rows in an order that a seed and their values decide; a uniform permutation, where the studied shuffle is none."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.to_json(F.struct(*rows.columns))))
