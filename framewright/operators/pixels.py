"""Pixel operators. Those that need one frame alone work on its array, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sample(frames: DataFrame, row: int, column: int, width: int = 8) -> DataFrame:
    """(k, f): one pixel of every frame; null outside the frame."""
    return frames.select("k", F.get("pixels", F.lit(row * width + column)).alias("f"))


def mean_image(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("y", "x").agg(F.avg("f").alias("mean"))


def broadcast_op(pixels: DataFrame, op, statistic) -> DataFrame:
    """op(f, s) for each pixel, s being statistic(f) over time; the statistic image is joined, small beside the frames."""
    image = pixels.groupBy("y", "x").agg(statistic(F.col("f")).alias("s"))
    return pixels.join(image, ["y", "x"]).select("k", "y", "x", op(F.col("f"), F.col("s")).alias("f"))


def subtract_mean(pixels: DataFrame) -> DataFrame:
    return broadcast_op(pixels, lambda f, s: f - s, F.avg)


def contrast(frames: DataFrame) -> DataFrame:
    """Each frame scaled to 0..1; a flat frame is null."""
    lo, hi = F.array_min("pixels"), F.array_max("pixels")
    return frames.select("k", F.transform("pixels", lambda f: F.try_divide(f - lo, hi - lo)).alias("pixels"))


def lut(frames: DataFrame, table: list[float]) -> DataFrame:
    """Pixels of 0..1 replaced by the entries of a lookup table; values beyond it take its ends."""
    entries = F.array(*[F.lit(float(x)) for x in table])
    at = lambda f: F.greatest(F.lit(0), F.least(F.lit(len(table) - 1), F.floor(f * (len(table) - 1)).cast("int")))
    return frames.select("k", F.transform("pixels", lambda f: F.when(f.isNotNull(), F.get(entries, at(f)))).alias("pixels"))


def z_scores(pixels: DataFrame) -> DataFrame:
    """(k, y, x, z): deviations of each pixel from its own mean, in its own standard deviations; null where there are none."""
    image = pixels.groupBy("y", "x").agg(F.avg("f").alias("m"), F.stddev_samp("f").alias("s"))
    return pixels.join(image, ["y", "x"]).select("k", "y", "x", F.try_divide(F.col("f") - F.col("m"), F.col("s")).alias("z"))


def above(z: DataFrame, threshold: float = 1.5) -> DataFrame:
    """Sparse binary frames: the pixels over a threshold."""
    return z.where(F.col("z") > threshold)


def sweep(z: DataFrame, thresholds: list[float], most: int) -> DataFrame:
    """(k, t, n): the least of the thresholds that leaves at most `most` pixels in a frame, else the highest, and how many it leaves.

    All thresholds are counted in one aggregate.
    """
    counts = z.groupBy("k").agg(*[F.count_if(F.col("z") > t).alias(f"c{i}") for i, t in enumerate(thresholds)])
    choice: Column = F.struct(F.lit(float(thresholds[-1])).alias("t"), F.col(f"c{len(thresholds) - 1}").alias("n"))
    for i in range(len(thresholds) - 2, -1, -1):
        choice = F.when(F.col(f"c{i}") <= most, F.struct(F.lit(float(thresholds[i])).alias("t"), F.col(f"c{i}").alias("n"))).otherwise(choice)
    return counts.select("k", choice.alias("c")).select("k", "c.t", "c.n")


def difference(pixels: DataFrame) -> DataFrame:
    """f less the value one frame before; null at the first."""
    w = Window.partitionBy("y", "x").orderBy("k")
    return pixels.select("k", "y", "x", (F.col("f") - F.lag("f").over(w)).alias("d"))


def moving_template(pixels: DataFrame, n: int = 4) -> DataFrame:
    """Mean of the n frames before; null at the first."""
    w = Window.partitionBy("y", "x").orderBy("k").rowsBetween(-n, -1)
    return pixels.select("k", "y", "x", F.avg("f").over(w).alias("template"))


def fixed_template(pixels: DataFrame, share: float = 0.1, seed: int = 0) -> DataFrame:
    """Mean of frames that a hash of the frame number picks: the same ones in every run and partitioning."""
    chosen = F.pmod(F.xxhash64("k", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)
    return pixels.where(chosen).groupBy("y", "x").agg(F.avg("f").alias("template"))


def shift(frames: DataFrame, dy: Column, dx: Column, width: int = 8) -> DataFrame:
    """Frames moved by whole pixels, in each row; what comes from outside is null."""
    height = F.size("pixels") / width

    def source(_, i):
        y, x = F.floor(i / width) - dy, i % width - dx
        inside = (y >= 0) & (y < height) & (x >= 0) & (x < width)
        return F.when(inside, F.get("pixels", (y * width + x).cast("int")))

    return frames.select("k", F.transform("pixels", source).alias("pixels"))


def fill_edges(pixels: DataFrame, n: int | None = None) -> DataFrame:
    """Missing pixels from the last known value; with n, from the mean of the n frames before, where any of them is known."""
    w = Window.partitionBy("y", "x").orderBy("k")
    last = F.last("f", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    mean = [] if n is None else [F.avg("f").over(w.rowsBetween(-n, -1))]
    return pixels.select("k", "y", "x", F.coalesce("f", *mean, last).alias("f"))


def gradients(frames: DataFrame, width: int = 8) -> DataFrame:
    """(k, y, x, gx, gy, l1, l2): central differences and the Hessian's eigenvalues at inner pixels, by array lookups in each row."""
    height = (F.size("pixels") / width).cast("int")

    def at(i, dy, dx):
        return F.get("pixels", i + dy * width + dx)

    def cell(_, i):
        y, x = F.floor(i / width).cast("int"), i % width
        f = at(i, 0, 0)
        xx, yy = at(i, 0, 1) - 2 * f + at(i, 0, -1), at(i, 1, 0) - 2 * f + at(i, -1, 0)
        xy = (at(i, 1, 1) - at(i, 1, -1) - at(i, -1, 1) + at(i, -1, -1)) / 4
        half, root = (xx + yy) / 2, F.sqrt(F.pow((xx - yy) / 2, F.lit(2.0)) + xy * xy)
        inner = (y > 0) & (x > 0) & (x < width - 1) & (y < height - 1)
        return F.when(inner, F.struct(y.alias("y"), x.alias("x"), ((at(i, 0, 1) - at(i, 0, -1)) / 2).alias("gx"), ((at(i, 1, 0) - at(i, -1, 0)) / 2).alias("gy"), (half + root).alias("l1"), (half - root).alias("l2")))

    return frames.select("k", F.explode(F.filter(F.transform("pixels", cell), lambda c: c.isNotNull())).alias("c")).select("k", "c.*")


def opened(frames: DataFrame, threshold: Column, width: int = 8) -> DataFrame:
    """(k, y, x): set pixels after a 3 x 3 erosion and dilation of each frame's pixels over a threshold; outside counts as unset."""
    return _morphed(frames, threshold, width, True)


def closed(frames: DataFrame, threshold: Column, width: int = 8) -> DataFrame:
    """(k, y, x): set pixels after a 3 x 3 dilation and erosion of each frame's pixels over a threshold; outside counts as unset."""
    return _morphed(frames, threshold, width, False)


def _morphed(frames: DataFrame, threshold: Column, width: int, erode_first: bool) -> DataFrame:
    def around(mask: Column, every: bool) -> Column:
        def cell(_, i: Column) -> Column:
            y, x = F.floor(i / width).cast("int"), i % width
            out: Column | None = None
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    ok = (y + dy >= 0) & (x + dx >= 0) & (x + dx < width)
                    got = F.when(ok, F.coalesce(F.get(mask, i + dy * width + dx), F.lit(False))).otherwise(False)
                    out = got if out is None else (out & got) if every else (out | got)
            return out

        return F.transform(mask, cell)

    # Each step is the one element of an array, whose lambda variable is evaluated once; projects would be collapsed and it would be evaluated at every look.
    over = F.transform("pixels", lambda f: F.coalesce(f > threshold, F.lit(False)))
    first = F.transform(F.array(over), lambda b: around(b, erode_first))
    both = F.transform(first, lambda e: around(e, not erode_first))
    long = frames.select("k", F.posexplode(F.get(both, 0)).alias("i", "on")).where("on")
    return long.select("k", F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).alias("x"))


def mass_centres(frames: DataFrame, width: int = 8) -> DataFrame:
    """(k, cy, cx, cy_mass, cx_mass): where the projections on each axis peak (first of equals), and the centre of mass of what lies over the frame's minimum."""
    height = (F.size("pixels") / width).cast("int")
    lo = F.array_min("pixels")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)
    rows = F.transform(F.sequence(F.lit(0), height - 1), lambda y: total(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.get("pixels", y * width + x))))
    columns = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: total(F.transform(F.sequence(F.lit(0), height - 1), lambda y: F.get("pixels", y * width + x))))
    peak = lambda c: (F.array_position(F.col(c), F.array_max(c)) - 1).cast("int")
    weigh = lambda at: F.try_divide(total(F.transform("pixels", lambda f, i: (f - lo) * at(i))), total(F.transform("pixels", lambda f: f - lo)))
    return frames.select("k", rows.alias("r"), columns.alias("c"), weigh(lambda i: F.floor(i / width)).alias("cy_mass"), weigh(lambda i: i % width).alias("cx_mass")).select("k", peak("r").alias("cy"), peak("c").alias("cx"), "cy_mass", "cx_mass")


def local_peaks(frames: DataFrame, width: int = 8) -> DataFrame:
    """(k, y, x, f): pixels that no neighbour exceeds, by array lookups in each row; the frame's edge has fewer neighbours."""

    def cell(f, i):
        y, x = F.floor(i / width).cast("int"), i % width
        around = [F.when((x + dx >= 0) & (x + dx < width) & (y + dy >= 0), F.get("pixels", i + dy * width + dx)) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
        return F.when(f >= F.greatest(*around), F.struct(y.alias("y"), x.alias("x"), f.alias("f")))

    return frames.select("k", F.explode(F.filter(F.transform("pixels", cell), lambda c: c.isNotNull())).alias("c")).select("k", "c.*")
