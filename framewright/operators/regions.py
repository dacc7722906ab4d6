"""Regions of interest: properties, traces, spatial moments, components within frames, and merging across frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components as components_of
from .joins import near_pairs


def boxes(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Area, bounding box and centroid for each key."""
    return pixels.groupBy(*by).agg(F.count(F.lit(1)).alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def traces(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """(roi, k, intensity, weighted): mean of each region's pixels in each frame, plain and by the mask's weights (roi, y, x, w)."""
    t = pixels.join(mask, ["y", "x"]).groupBy("roi", "k")
    return t.agg(F.avg("f").alias("intensity"), F.try_divide(F.sum(F.col("w") * F.col("f")), F.sum("w")).alias("weighted"))


def spatial_moments(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """(roi, k, m00, m10, m01, m11, m20, m02): sums of x^p y^q f over each region."""
    t = pixels.join(mask, ["y", "x"]).groupBy("roi", "k")
    return t.agg(*[F.sum(F.pow("x", F.lit(float(p))) * F.pow("y", F.lit(float(q))) * F.col("f")).alias(f"m{p}{q}") for p, q in ((0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (0, 2))])


def label_grid(on: np.ndarray) -> np.ndarray:
    """8-connected components of a binary image: each set pixel gets the least flat index of its component, others -1."""
    h, w = on.shape
    label = np.where(on, np.arange(h * w).reshape(h, w), h * w)
    while True:
        wide = np.pad(label, 1, constant_values=h * w)
        low = np.min([wide[1 + a : h + 1 + a, 1 + b : w + 1 + b] for a in (-1, 0, 1) for b in (-1, 0, 1)], axis=0)
        low = np.where(on, low, h * w)
        if (low == label).all():
            return np.where(on, label, -1)
        label = low


def components(on: DataFrame, width: int = 8, height: int = 8) -> DataFrame:
    """(k, y, x, label) of the set pixels (k, y, x) of each frame: label is the least y * width + x of its 8-connected component.

    A frame's pixels come in one row, as a list that a frame bounds; frames are labelled in Arrow batches.
    """
    rows = on.groupBy("k").agg(F.collect_list((F.col("y") * width + F.col("x")).cast("int")).alias("at"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, at in zip(frame["k"], frame["at"], strict=True):
                image = np.zeros(height * width, bool)
                image[at] = True
                label = label_grid(image.reshape(height, width)).ravel()
                place = np.nonzero(image)[0]
                out.append(pd.DataFrame({"k": k, "y": place // width, "x": place % width, "label": label[place]}))
            yield pd.concat(out) if out else pd.DataFrame({"k": [], "y": [], "x": [], "label": []})

    return rows.mapInPandas(run, "k long, y int, x int, label int")


def merge_edges(regions: DataFrame, within: float = 1.0, cell: int = 2, size: int = 8) -> DataFrame:
    """(a, b, distance) of regions (id, x, y, area) of one size class whose centroids lie within a distance."""
    sized = regions.withColumn("class", F.floor(F.col("area") / size))
    return near_pairs(sized, cell, within, ["class"]).select("a", "b", "distance")


def merged(regions: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, roi): roi is the least id that edges lead to, a region's own id where it has none.

    Ends of edges that are no region's id join what they touch, but are not returned themselves.
    """
    named = regions.select("id").join(components_of(edges).withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("roi"))
    return named.join(least, "root").select("id", "roi")


def region_pixels(members: DataFrame, pixels: DataFrame) -> DataFrame:
    """(roi, y, x): union of the pixel sets (id, y, x) of each merged region."""
    return pixels.join(members, "id").select("roi", "y", "x").distinct()


def box_mask(width: int, height: int, side: int) -> str:
    """SQL of a mask (roi, y, x, w) of squares, weighted by 1 / (1 + distance from the frame's first pixel)."""
    return f"SELECT CAST((y DIV {side}) * {width // side} + x DIV {side} AS INT) AS roi, y, x, 1.0D / (1 + y + x) AS w FROM (SELECT CAST(id DIV {width} AS INT) AS y, CAST(id % {width} AS INT) AS x FROM range({width * height}))"


def grown(mild: DataFrame, seeds: DataFrame) -> DataFrame:
    """Regions (k, y, x, label) that grow from seeds (k, y, x) over the set pixels `mild`: the components that hold a seed."""
    held = mild.join(seeds.select("k", "y", "x").distinct(), ["k", "y", "x"], "left_semi").select("k", "label").distinct()
    return mild.join(held, ["k", "label"], "left_semi").select("k", "y", "x", "label")


def hierarchy(parents: DataFrame, children: DataFrame) -> DataFrame:
    """(k, label, parent, area): each child region with the parent region that its pixels lie in, and their number."""
    up = parents.select("k", "y", "x", F.col("label").alias("parent"))
    return children.join(up, ["k", "y", "x"]).groupBy("k", "label", "parent").agg(F.count(F.lit(1)).alias("area"))
