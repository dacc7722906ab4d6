"""Frame sources: dense frames, one row each, and their pixels in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, pixels): frame number and its pixels row by row, from the vectors of `embeddings`."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), F.col("embedding").cast("array<double>").alias("pixels"))


def pixels(of: DataFrame, width: int = WIDTH) -> DataFrame:
    """(k, y, x, f): one row for each pixel. Null pixels stay; a null frame has none."""
    long = of.select("k", F.posexplode("pixels").alias("i", "f"))
    return long.select("k", F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).cast("int").alias("x"), "f")


def bin_frames(of: DataFrame, width: int = WIDTH, by: int = 2) -> DataFrame:
    """Frames binned by squares of `by` pixels, within each row: no shuffle. The height and width must be multiples of by."""
    at = lambda i: [F.get("pixels", (F.floor(i / (width // by)) * by + dy).cast("int") * width + (i % (width // by)) * by + dx) for dy in range(by) for dx in range(by)]

    def mean(i):
        cells = at(i)
        total = cells[0]
        for c in cells[1:]:
            total = total + c
        return total / len(cells)

    n = F.size("pixels") / (by * by)
    return of.select("k", F.transform(F.sequence(F.lit(0), n.cast("int") - 1), mean).alias("pixels"))


def stream_frames(spark: SparkSession, sf_dir: str, per_trigger: int = 1) -> DataFrame:
    """Frames as a stream of files."""
    path = f"{sf_dir}/embedding[s].parquet"  # as a pattern, it may be a file or a folder
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path).select(F.col("vec_id").alias("k"), F.col("embedding").cast("array<double>").alias("pixels"))
