"""Streaming forms: running moments, chunks of frames, events, and the state a frame arrives in."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.moments import merge_states, states
from ..sources.files import shared_folder


def shared(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share."""
    base = shared_folder(spark)
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, with time as TIMESTAMP so that watermarks hold."""
    path = f"{sf_dir}/event[s].parquet"  # as a pattern, it may be a file or a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Run a stream until it has read all there is, and return what it wrote to the shared folder.

    Each batch is written to a folder of its own, over what an earlier attempt left there, so a batch that is run again
    counts once. In complete and update mode the last rows count: complete keeps the last batch alone.
    """
    spark = stream.sparkSession
    base = shared(spark)

    def put(batch: DataFrame, number: int) -> None:
        out = each(batch, number) if each else batch
        out.write.mode("overwrite").parquet(f"{base}/out/batch={0 if mode == 'complete' else number}")

    schema = each(spark.createDataFrame([], stream.schema), -1).schema if each else stream.schema
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")


def stream_moments(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mergeable state of each key over a stream: each batch is aggregated apart and merged into the states so far, one row a key.

    The states after batch n are a folder of their own, written from those after batch n - 1, so a batch that is run
    again gives the same.
    """
    spark = values.sparkSession
    base = shared(spark)
    empty = states(spark.createDataFrame([], values.select(*by, value).schema), by, value)
    last = -1

    def put(batch: DataFrame, number: int) -> None:
        nonlocal last
        before = spark.read.schema(empty.schema).parquet(f"{base}/out/{number - 1}") if number else empty.limit(0)
        new, old = states(batch, by, value).withColumnRenamed("state", "fresh"), before.withColumnRenamed("state", "old")
        both = old.join(new, by, "full").select(*by, F.when(F.col("old").isNull(), F.col("fresh")).when(F.col("fresh").isNull(), F.col("old")).otherwise(merge_states(F.col("old"), F.col("fresh"))).alias("state"))
        both.write.mode("overwrite").parquet(f"{base}/out/{number}")
        last = number

    query = values.select(*by, value).writeStream.option("checkpointLocation", f"{base}/state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    return (spark.read.schema(empty.schema).parquet(f"{base}/out/{last}") if last >= 0 else empty).select(*by, "state.*")


CHUNK = "by long, chunk long, n long, first double, last double, mean double"


def chunks(values: DataFrame, by: str, order: str, value: str, size: int = 16) -> DataFrame:
    """(by, chunk, n, first, last, mean) of each `size` consecutive values of a key, as soon as a chunk is full.

    The state holds the values of the open chunk alone, and its last one is where the next chunk goes on.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, held = state.get if state.exists else (0, [])
        fresh = pd.concat(list(frames))
        held = list(held) + fresh.sort_values("o")["v"].tolist()
        out = []
        while len(held) >= size:
            part, held = held[:size], held[size:]
            out.append((key[0], number, size, part[0], part[-1], sum(part) / size))
            number += 1
        state.update((number, held))
        yield pd.DataFrame(out, columns=["by", "chunk", "n", "first", "last", "mean"])

    rows = values.select(F.col(by).cast("long").alias("by"), F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    return rows.groupBy("by").applyInPandasWithState(step, CHUNK, "number long, held array<double>", "append", GroupStateTimeout.NoTimeout)


def changes(values: DataFrame, by: str, order: str, value: str, over: float) -> DataFrame:
    """(by, o, change): steps of a key's value over a threshold; the state is the last known value. Rows without a value are left out."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(frames)).sort_values("o")
        v = fresh["v"].to_numpy()
        change = np.diff(v, prepend=state.get[0] if state.exists else np.nan)
        some = np.abs(change) > over
        state.update((float(v[-1]),))
        yield pd.DataFrame({"by": key[0], "o": fresh["o"].to_numpy()[some], "change": change[some]})

    rows = values.select(F.col(by).cast("long").alias("by"), F.col(order).cast("long").alias("o"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    return rows.groupBy("by").applyInPandasWithState(step, "by long, o long, change double", "last double", "append", GroupStateTimeout.NoTimeout)


def windows(stream: DataFrame, at: str, length: str, late: str, by: list[str], value: str) -> DataFrame:
    """Event-time windows with a watermark: (low, by, n, total)."""
    t = stream.withWatermark(at, late).groupBy(F.window(at, length), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return t.select(F.col("window.start").alias("low"), *by, "n", "total")


def late_batches(progress: list[dict], budget_ms: float) -> list[int]:
    """Batches that took longer than the acquisition interval allows, from a query's progress reports."""
    return [p["batchId"] for p in progress if p.get("batchDuration", p.get("durationMs", {}).get("triggerExecution", 0)) > budget_ms]


def lowpass(values: DataFrame, by: str, order: str, value: str, a: float = 0.3) -> DataFrame:
    """(by, o, y): the recursive filter y = a x + (1 - a) y' of each key over a stream; the state is the last y."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(frames)).sort_values("o")
        held = [state.get[0]] if state.exists else []
        y = pd.Series([*held, *fresh["v"]]).ewm(alpha=a, adjust=False).mean().to_numpy()[len(held) :]
        state.update((float(y[-1]),))
        yield pd.DataFrame({"by": key[0], "o": fresh["o"].to_numpy(), "y": y})

    rows = values.select(F.col(by).cast("long").alias("by"), F.col(order).cast("long").alias("o"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    return rows.groupBy("by").applyInPandasWithState(step, "by long, o long, y double", "y double", "append", GroupStateTimeout.NoTimeout)


def synchronised(left: DataFrame, right: DataFrame, by: str, at: str, within: str, late: str = "10 minutes") -> DataFrame:
    """Pairs of rows of two streams with one key where the right one comes at most `within` after the left one.

    Both sides have watermarks, so that state goes when its time is over. Columns of the right side get a trailing _r.
    """
    a = left.withWatermark(at, late)
    b = right.select(*[F.col(c).alias(f"{c}_r") for c in right.columns]).withWatermark(f"{at}_r", late)
    return a.join(b, F.expr(f"{by} = {by}_r AND {at}_r >= {at} AND {at}_r <= {at} + INTERVAL {within}"))
