"""Connected components of graphs of any size, without gathering a component anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import shared_folder

#: Edges that one task joins at most; a graph with more is contracted first.
LAST = 200_000


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder; any executor can read it again."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets that a and b are in; labels hold the least member of each."""
    while len(a):
        ra, rb = labels[a], labels[b]
        keep = ra != rb
        a, b, ra, rb = a[keep], b[keep], ra[keep], rb[keep]
        np.minimum.at(labels, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root) of all edges (a, b) of one partition together."""
    held = list(frames)
    if held:
        edges = pd.concat(held)
        place, nodes = pd.factorize(np.concatenate([edges["a"].to_numpy(), edges["b"].to_numpy()]))
        labels = np.arange(len(nodes))
        join_labels(labels, place[: len(edges)], place[len(edges) :])
        yield pd.DataFrame({"node": nodes, "root": nodes[labels]})


def components(edges: DataFrame, a: str = "a", b: str = "b", last: int = LAST) -> DataFrame:
    """Connected components by randomised contraction.

    Each round sends every node to the node of its closed neighbourhood with the least salted hash, then renames and
    de-duplicates the edges; a constant share of the nodes goes each round, whatever the shape of the graph. Nothing
    is gathered per node: the minimum is a partial aggregate, and the renaming joins have one row per node on one side.
    Once no more than `last` edges are left, one task joins them, instead of many rounds of nearly empty partitions.

    Returns (node, root) for every node that has an edge to another one; root is one node of the component, the same
    for all its members. Self loops and null ends are ignored; repeated edges count once.
    """
    kind = edges.schema[a].dataType
    live = edges.select(F.col(a).alias("a"), F.col(b).cast(kind).alias("b")).where("a <> b")
    live = cut(live.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    turn = 0
    while live.count() > last:
        salted = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        ways = live.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(live.select(F.col("b").alias("node"), F.col("a").alias("to")))
        near = ways.groupBy("node").agg(F.min(salted("to")).alias("m")).select("node", F.least("m", salted("node"))["v"].alias("root"))
        near = cut(near)
        steps.append(near)
        left = near.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = near.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        new = live.join(left, "a").join(right, "b").where("ra <> rb")
        live = cut(new.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        turn += 1
        if turn == 200:
            raise RuntimeError("components did not converge")
    out = cut(live.coalesce(1).mapInPandas(_joined, f"node {kind.simpleString()}, root {kind.simpleString()}"))
    for step in reversed(steps):
        later = out.select(F.col("node").alias("root"), F.col("root").alias("last"))
        out = cut(step.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root")))
    return out
