"""Operator 5: benchmark decontamination, by DataFrame functions only.

Windows of a document as long as a benchmark item are found by the places where it shares shingles with the item. A
window whose similarity reaches the threshold shares at least that part of the item's shingles, so fewer matches rule a
document out. Every window with enough matches gets a SimHash fingerprint. A multi-index of Hamming blocks finds all items of that length within
the radius: of two fingerprints that differ in at most `radius` bits, one of four blocks differs in at most a quarter of
these, and the items' blocks are entered under every such value. An exact comparison of shingle multisets decides.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 19, 4
#: Shingles of the benchmark up to which they are broadcast (24 bytes each); above, Spark shuffles.
BROADCAST = 1_000_000
_NONE = -(1 << 63)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[\\x20\\x09-\\x0D]+", -1), "")


def _shingles(words: Column, size: int) -> Column:
    """Hashes of the runs of `size` words; none if there are fewer words."""
    n = F.size(words) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.lit(size), *[F.get(words, i + k) for k in range(size)]))).otherwise(F.array().cast("array<bigint>"))


def _of_window(words: Column, longest: int) -> Column:
    """Shingles of a window: of `longest` words, or the whole window if it is shorter."""
    out = _shingles(words, longest)
    for size in range(1, longest):
        out = F.when(F.size(words) == size, _shingles(words, size)).otherwise(out)
    return out


def _simhash(shingles: Column) -> Column:
    """Bit by bit the majority of the hashes, each counted as often as it occurs."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: F.when(F.size(F.filter(shingles, lambda x: F.getbit(x, b) == 1)) * 2 > F.size(shingles), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(acc))


def _shared(a: Column, b: Column) -> Column:
    """Size of the intersection of two multisets."""
    many = lambda xs, y: F.size(F.filter(xs, lambda x: x == y))
    return F.aggregate(F.array_distinct(b), F.lit(0), lambda acc, y: acc + F.least(many(a, y), many(b, y)))


def benchmark_items(benchmark: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, m, sh, fp) of the items that have words: number of words, shingles, fingerprint."""
    w = benchmark.select(F.col("item_id").cast("long"), _words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.select("item_id", F.size("w").alias("m"), _of_window(F.col("w"), shingle).alias("sh"))
    return w.withColumn("fp", _simhash(F.col("sh")))


def _starts(places: Column, words: Column, similarity: float) -> Column:
    """Where windows start that hold enough matching places; 0 in a document shorter than the item.

    A window as long as the item has as many shingles, n, so it shares at least 2 s / (1 + s) of n. Of so many
    neighbouring places, the last stands within the window that starts no later than the first.
    """
    need = F.ceil(F.lit(2 * similarity / (1 + similarity)) * F.col("n_sh") - 1e-9).cast("int")
    at = F.array_sort(places)
    runs = F.when(F.size(at) >= need, F.sequence(F.lit(0), F.size(at) - need)).otherwise(F.array().cast("array<int>"))
    ends = F.transform(runs, lambda k: F.struct(F.greatest(F.lit(0), F.get(at, k + need - 1) - F.col("n_sh") + 1).alias("low"), F.least(F.get(at, k), F.size(words) - F.col("m")).alias("high")))
    inside = F.transform(F.filter(ends, lambda e: e["low"] <= e["high"]), lambda e: F.sequence(e["low"], e["high"]))
    return F.when(F.size(words) < F.col("m"), F.array(F.lit(0))).otherwise(F.array_distinct(F.flatten(inside)))


def _aligned(base: DataFrame, known: DataFrame, sizes: list[int], similarity: float) -> DataFrame:
    """(id, mark, m, start, w): every window that holds enough shingles of an item of its length.

    Shingles meet first, without the words; the documents that are left are read again.
    """
    worded = base.select("id", "mark", _words(F.col("text")).alias("w"))
    each = [worded.select("id", "mark", F.posexplode(_shingles(F.col("w"), n)).alias("p", "x")) for n in sizes]
    shingled = each[0]
    for more in each[1:]:
        shingled = shingled.unionByName(more)
    hits = shingled.join(known, "x").groupBy("id", "mark", "item_id", "m", "n_sh").agg(F.collect_set("p").alias("places"))  # of one document and item
    hits = written(hits.where(F.size("places") >= F.lit(similarity) * F.col("n_sh") - 1e-9))
    held = base.join(hits.select("id", "mark").distinct(), ["id", "mark"], "left_semi").dropDuplicates(["id", "mark"])
    held = written(held.select("id", "mark", _words(F.col("text")).alias("w")))
    found = held.join(hits, ["id", "mark"]).select("id", "mark", "m", "w", F.explode(_starts(F.col("places"), F.col("w"), similarity)).alias("start"))
    return found.select("id", "mark", "m", "start", F.slice("w", F.col("start") + 1, F.col("m")).alias("w")).dropDuplicates(["id", "mark", "m", "start"])


def leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, similarity, start) for each document and item of which the document holds a near copy.

    Words are lower-cased and split at ASCII white space; shingles of `shingle` words count as often as they occur, and
    an item of fewer words is one shingle. similarity is the best weighted Jaccard index of a window as long as the item
    (or of the document, if it is shorter), start that window's first word, from 0. Null and empty texts or items match
    nothing; repeated rows give one result; a null doc_id stays null; other columns are ignored; empty tables give an
    empty result.
    """
    best = _leaking(docs, benchmark, shingle, similarity, radius).groupBy("id", "item_id").agg(F.max("b").alias("b"))
    return best.select(F.nullif(F.col("id"), F.lit(_NONE)).alias("doc_id"), "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.back")).cast("long").alias("start"))


def _marked(doc_id: Column, text: Column) -> list[Column]:
    """What a row is told by: its id, or a number for none, and a hash of its text."""
    return [F.coalesce(doc_id.cast("long"), F.lit(_NONE)), F.xxhash64(text.cast("string"))]


def _leaking(docs: DataFrame, benchmark: DataFrame, shingle: int, similarity: float, radius: int) -> DataFrame:
    """(id, mark, item_id, b): for each row by its id and text, and each item, the best similarity and its start, negative."""
    items = written(benchmark_items(benchmark, shingle))
    if not re.fullmatch(r"[1-9]\d*", str(radius)) or radius % BLOCKS != BLOCKS - 1 or radius >= 32:
        raise ValueError("the radius must be 3, 7, 11, 15, ..., under 32")
    size = items.agg(F.sum(F.size("sh")).alias("n"), F.collect_set(F.when(F.col("m") < shingle, F.col("m"))).alias("short")).first()
    known = items.select("item_id", "m", F.size("sh").alias("n_sh"), F.posexplode("sh").alias("q", "x"))
    told = _marked(F.col("doc_id"), F.col("text"))
    base = docs.where("text IS NOT NULL").select(told[0].alias("id"), F.col("text").cast("string"), told[1].alias("mark"))
    sizes = [shingle, *sorted(size["short"] or [])]  # at most `shingle` lengths
    windows = _aligned(base, F.broadcast(known) if (size["n"] or 0) <= BROADCAST else known, sizes, similarity)
    windows = windows.select("id", "mark", "m", "start", _of_window(F.col("w"), shingle).alias("wsh")).where(F.size("wsh") > 0)
    windows = written(windows.withColumn("wfp", _simhash(F.col("wsh"))))

    width, within = 64 // BLOCKS, radius // BLOCKS
    block = lambda fp, k: F.shiftrightunsigned(fp, k * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    flips = F.filter(F.sequence(F.lit(0).cast("long"), F.lit((1 << width) - 1).cast("long")), lambda x: F.bit_count(x) <= within)
    entries = items.select("item_id", "m", "sh", "fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), block(F.col("fp"), k).alias("v")) for k in range(BLOCKS)])).alias("b"), flips.alias("flips"))
    entries = entries.select("item_id", "m", "fp", F.col("b.k").alias("k"), F.explode(F.transform("flips", lambda x: x.bitwiseXOR(F.col("b.v")))).alias("v"))
    probes = windows.select("id", "mark", "m", "start", "wfp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), block(F.col("wfp"), k).alias("v")) for k in range(BLOCKS)])).alias("b"))
    probes = probes.select("id", "mark", "m", "start", "wfp", F.col("b.k").alias("k"), F.col("b.v").alias("v"))
    # Spark takes the entries for as small as the items they come from and would broadcast them: merge, whatever it thinks.
    near = probes.join(entries.hint("merge"), ["k", "v", "m"]).where(F.bit_count(F.col("wfp").bitwiseXOR(F.col("fp"))) <= radius).select("id", "mark", "m", "start", "item_id").distinct()
    pairs = near.join(windows, ["id", "mark", "m", "start"]).join(items.select("item_id", "sh"), "item_id")
    shared = _shared(F.col("wsh"), F.col("sh"))
    scored = pairs.withColumn("shared", shared).withColumn("similarity", F.col("shared") / (F.size("wsh") + F.size("sh") - F.col("shared")))
    return scored.where(F.col("similarity") >= similarity).groupBy("id", "mark", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("b"))


def clean(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of docs whose own text holds no near copy of a benchmark item, unchanged; ids that are null or repeat do not matter."""
    found = _leaking(docs, benchmark, shingle, similarity, radius).select(F.col("id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    told = _marked(docs["doc_id"], docs["text"])
    return docs.join(found, (told[0] == F.col("__id")) & (told[1] == F.col("__mark")), "left_anti")
