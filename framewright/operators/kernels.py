"""Array kernels that SQL has no form for, in Arrow batches of whole frames; and models of pyspark.ml."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Frames that are transformed together.
TOGETHER = 16


def displacements(frames: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Rows (dy, dx, peak) of frames by phase correlation, to a part of a pixel by a parabola through the peak and its neighbours; one transform for all."""
    cross = np.fft.fft2(frames) * np.conj(np.fft.fft2(template))
    size = np.abs(cross)
    surface = np.fft.ifft2(np.where(size > 1e-12, cross / np.where(size > 1e-12, size, 1), 0)).real
    n, h, w = surface.shape
    y, x = np.divmod(surface.reshape(n, -1).argmax(1), w)
    at = np.arange(n)
    top = surface[at, y, x]

    def part(before: np.ndarray, after: np.ndarray) -> np.ndarray:
        bend = before - 2 * top + after
        flat = np.abs(bend) < 1e-12
        return np.where(flat, 0.0, np.clip(0.5 * (before - after) / np.where(flat, 1, bend), -0.5, 0.5))

    dy = y + part(surface[at, y - 1, x], surface[at, (y + 1) % h, x])
    dx = x + part(surface[at, y, x - 1], surface[at, y, (x + 1) % w])
    return np.c_[np.where(dy > h / 2, dy - h, dy), np.where(dx > w / 2, dx - w, dx), top]


def phase_correlation(frames: DataFrame, template: DataFrame, width: int = 8) -> DataFrame:
    """(k, dy, dx, peak) of each frame against the one row of template (pixels); a frame of another size or with nulls gives nulls.

    The template, one frame, goes to all executors; frames are not shuffled.
    """
    one = template.select(F.col("pixels").alias("template"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.full((len(batch), 3), np.nan)
            if len(batch):
                mould = np.asarray(batch["template"].iloc[0], float).reshape(-1, width)
                sound = [k for k, p in enumerate(batch["pixels"]) if p is not None and len(p) == mould.size and not np.isnan(np.asarray(p, float)).any()]
                for at in range(0, len(sound), TOGETHER):
                    some = sound[at : at + TOGETHER]
                    found[some] = displacements(np.stack([np.asarray(batch["pixels"].iloc[k], float) for k in some]).reshape(len(some), -1, width), mould)
            out = pd.DataFrame(found, columns=["dy", "dx", "peak"]).astype("Float64")
            out.insert(0, "k", batch["k"].to_numpy())
            yield out

    return frames.crossJoin(F.broadcast(one)).select("k", "pixels", "template").mapInPandas(run, "k long, dy double, dx double, peak double")


def supervised(moves: DataFrame, most: float = 3.0) -> DataFrame:
    """moves with displacements over `most` pixels, those of an erroneous correlation, set to null."""
    bad = (F.abs("dy") > most) | (F.abs("dx") > most)
    return moves.select("k", *[F.when(~bad, F.col(c)).alias(c) for c in ("dy", "dx")], "peak", F.coalesce(bad, F.lit(True)).alias("erroneous"))


def cubic(t: np.ndarray) -> np.ndarray:
    """Weights of the four neighbours at fraction t, by the cubic convolution of Keys (a = -1/2)."""
    a = -0.5
    d = np.stack([1 + t, t, 1 - t, 2 - t])
    near = (a + 2) * d**3 - (a + 3) * d**2 + 1
    return np.where(d <= 1, near, np.where(d < 2, a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a, 0))


def resample(frames: DataFrame, width: int = 8) -> DataFrame:
    """(k, pixels) of frames (k, pixels, dy, dx) moved back by a displacement, bicubically; the edge's pixels are repeated outside."""

    def move(image: np.ndarray, by: float, axis: int) -> np.ndarray:
        n = image.shape[axis]
        at = np.arange(n) + by
        low = np.floor(at).astype(int)
        weights = cubic(at - low)
        parts = [np.take(image, np.clip(low + j - 1, 0, n - 1), axis) * np.expand_dims(weights[j], 1 - axis) for j in range(4)]
        return np.sum(parts, axis=0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, pixels, dy, dx in zip(batch["k"], batch["pixels"], batch["dy"], batch["dx"], strict=True):
                known = pixels is not None and not (pd.isna(dy) or pd.isna(dx))
                out.append((k, move(move(np.asarray(pixels, float).reshape(-1, width), dy, 0), dx, 1).ravel() if known else pixels))
            yield pd.DataFrame(out, columns=["k", "pixels"])

    return frames.select("k", "pixels", "dy", "dx").mapInPandas(run, "k long, pixels array<double>")


def orientation(frames: DataFrame, width: int = 8, step: int = 15) -> DataFrame:
    """(k, degrees): the angle whose projection of the frame (Radon transform) has the highest bin; the least of equal ones."""
    angles = np.radians(np.arange(0, 180, step))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, pixels in zip(batch["k"], batch["pixels"], strict=True):
                if pixels is None or not len(pixels):
                    out.append((k, None))
                    continue
                f = np.nan_to_num(np.asarray(pixels, float))
                y, x = np.divmod(np.arange(len(f)), width)
                y, x = y - (len(f) // width - 1) / 2, x - (width - 1) / 2
                best = []
                for a in angles:
                    bins = np.round(x * np.cos(a) + y * np.sin(a)).astype(int) + len(f)
                    best.append(np.bincount(bins, f - f.min()).max())
                out.append((k, int(np.argmax(np.round(best, 9))) * step))
            yield pd.DataFrame(out, columns=["k", "degrees"]).astype({"degrees": "Int32"})

    return frames.select("k", "pixels").mapInPandas(run, "k long, degrees int")


def bitrates(texts: DataFrame, key: str, column: str = "text", block: int = 4096) -> DataFrame:
    """(key, blocks, bytes, packed): sizes of a text's blocks of bytes, plain and compressed, as a measure of what they tell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, text in zip(batch[key], batch[column], strict=True):
                raw = (text or "").encode()
                parts = [raw[i : i + block] for i in range(0, len(raw), block)]
                out.append((k, len(parts), len(raw), sum(len(zlib.compress(p, 6)) for p in parts)))
            yield pd.DataFrame(out, columns=[key, "blocks", "bytes", "packed"])

    return texts.select(key, column).mapInPandas(run, f"{key} long, blocks long, bytes long, packed long")


def mixture(rows: DataFrame, columns: list[str], k: int = 2, seed: int = 7) -> DataFrame:
    """rows with the component of a Gaussian mixture and its probability; rows with a null have neither and are not learnt from."""
    whole = rows.dropna(subset=columns)
    t = VectorAssembler(inputCols=columns, outputCol="__v").transform(whole)
    model = GaussianMixture(k=k, seed=seed, featuresCol="__v", predictionCol="component", probabilityCol="__p", maxIter=20).fit(t)
    done = model.transform(t).withColumn("probability", F.array_max(vector_to_array("__p"))).drop("__v", "__p")
    null = " OR ".join(f"`{c}` IS NULL OR isnan(`{c}`)" for c in columns)
    return done.unionByName(rows.where(null), allowMissingColumns=True)


def principal_traces(frames: DataFrame, n: int = 3) -> DataFrame:
    """(k, trace): each frame's coordinates on the first n principal components."""
    t = frames.where(F.col("pixels").isNotNull()).select("k", array_to_vector("pixels").alias("__v"))
    model = PCA(k=n, inputCol="__v", outputCol="__t").fit(t)
    return model.transform(t).select("k", vector_to_array("__t").alias("trace"))
