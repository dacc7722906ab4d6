"""File sources and sinks for packets, page indexes, markdown, recipes, listings and releases."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDEX = T.StructType([T.StructField("pages", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("title", "text", "tags", "url")])))])
RECIPE = "struct<name:string,format:string,template:string,options:string,filters:array<string>>"
PACKET = r"^s(\d+)x(-?\d+)y(-?\d+)$"


def search_index(spark: SparkSession, path: str) -> DataFrame:
    """(title, text, tags, url) of a JSON index whose records stand under `pages`; a text that is false is missing."""
    rows = spark.read.schema(INDEX).json(path, multiLine=True).select(F.explode("pages").alias("p")).select("p.*")
    return rows.withColumn("text", F.when(F.col("text") != "false", F.col("text")))


def packets(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Sensor packets `s<sensor>x<dx>y<dy>` decoded to (sensor, dx, dy) beside the other columns, and the lines that are none."""
    part = lambda k: F.regexp_extract(F.trim(column), PACKET, k).cast("int")
    good = F.trim(column).rlike(PACKET)
    return lines.where(good).select("*", part(1).alias("sensor"), part(2).alias("dx"), part(3).alias("dy")), lines.where(F.coalesce(~good, F.lit(True)))


def packet_source(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Lines of a packet log, as a table or a stream."""
    return (spark.readStream if stream else spark.read).format("text").load(path)


def markdown(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(path, text) of markdown files, and those that are not valid UTF-8."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    good = F.call_function("is_valid_utf8", F.col("content").cast("string"))
    return files.where(good).select("path", F.col("content").cast("string").alias("text")), files.where(~good).select("path")


def recipes(lines: DataFrame, defaults: dict[str, str], column: str = "value") -> DataFrame:
    """Recipes from JSON texts: options may be a text or a list and becomes a list; what is missing comes from defaults."""
    got = lines.select(F.from_json(column, RECIPE).alias("r")).select("r.*")
    listed = F.coalesce(F.from_json("options", "array<string>"), F.array("options"))
    filled = got.withColumn("options", F.when(F.col("options").isNotNull(), listed))
    return filled.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in filled.columns])


def front_matter(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with a map `meta` of the flat `key: value` lines between leading --- lines, empty if there are none."""
    head = F.regexp_extract(F.col(column), r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    pairs = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^\s*[\w-]+\s*:"))
    entries = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, r"^\s*[\w-]+\s*:", "")).alias("value")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))  # the last of equal keys wins
    last = F.transform(keys, lambda key: F.element_at(F.filter(entries, lambda e: e["key"] == key), -1)["value"])
    return docs.withColumn("meta", F.map_from_arrays(keys, last))


def listing(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, name, length) of the files under a folder; names that start with a dot are hidden; pattern is a regular expression for names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.substring_index("path", "/", -1).alias("name"), "length")
    files = files.where(~F.col("name").startswith("."))
    return files.where(F.col("name").rlike(pattern)) if pattern else files


def images(spark: SparkSession, path: str) -> DataFrame:
    """Image files by extension."""
    return listing(spark, path, r"(?i)\.(png|jpg|gif|svg|eps)$")


def release(df: DataFrame, path: str) -> None:
    """Write a snapshot under release=yyyyMMdd-HHmmss, all rows with the same stamp."""
    stamp = df.sparkSession.range(1).select(F.date_format(F.current_timestamp(), "yyyyMMdd-HHmmss")).first()[0]
    df.withColumn("release", F.lit(stamp)).write.mode("append").partitionBy("release").parquet(path)


def write_as(df: DataFrame, path: str, kind: str) -> None:
    """Write a table as parquet, orc, json, csv or text."""
    if kind not in ("parquet", "orc", "json", "csv", "text"):
        raise ValueError(f"no writer for {kind}")
    writer = df.write.mode("overwrite")
    (writer.option("header", "true") if kind == "csv" else writer).format(kind).save(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="framewright-")
    return found
