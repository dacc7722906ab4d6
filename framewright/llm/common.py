"""What several operators of this subpackage share: table reads, lineage cuts and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import LAST, components, cut, join_labels  # noqa: F401  for the modules of this subpackage
from ..sources.files import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by a path that only Spark needs to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one that was set by hand; a temporary one only in a local session without either."""
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    found = named or (set_dir.get() if set_dir.isDefined() else shared_folder(spark))
    if not set_dir.isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder: smaller than a checkpoint, and columns are pruned on reading."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/framewright-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
