"""Operator 10: SimHash near-duplicates through a Gray-order hierarchical index.

Equal fingerprints are one entry of the index. Two fingerprints within the radius agree on at least one of radius + 1
blocks of their bits, so entries meet in buckets by one block each; a bucket that is too large is split again by the
blocks of the bits that are left, by the same rule. Within a bucket, entries are sorted by Gray rank, where neighbours
differ little. Upper nodes hold the bits that all entries below share, as mask and pattern; two nodes whose shared bits
already differ in more than the radius are left out with all pairs below them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, join_labels, written

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Children of a node; pairs of nodes looked at together; entries of a bucket before it is split; entries read before a search.
FAN, TOGETHER, BUCKET, READ = 16, 1 << 21, 1 << 13, 1 << 17


def fingerprint(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits: each is 1 if it is set in over half of the hashes of the word shingles, repeats included."""
    words = raw.lower().split()  # of bytes: A-Z alone, and ASCII white space alone
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    first = (end - size)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(first, end[shingle - 1 :].tolist(), strict=True)], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 256):
        bits = np.unpackbits(hashes[at : at + 255 * 256].view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        for k in range(0, len(bits), 255):  # eight counters of a byte in each word
            total += bits[k : k + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return int((np.uint64(1) << np.nonzero(2 * total > len(hashes))[0].astype(np.uint64)).sum(dtype=np.uint64)) if len(hashes) else 0


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, mark, fp): mark is a hash of the text, fp the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py() or b"", shingle, seed) for x in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "mark", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), marked(text).alias("mark"), text.cast("binary").alias("text")).mapInArrow(run, "doc_id long, mark long, fp long")


def marked(text: Column) -> Column:
    """A hash of a text, null or not, that tells different texts of one doc_id apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    out = codes.copy()
    for by in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(by)
    return out


def gray_groups(codes: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Order by (bucket, Gray rank), and for each entry in that order the first one that links lead to within the bucket."""
    order = np.lexsort((gray_rank(codes), bucket))
    code, home = codes[order], bucket[order]
    labels = np.arange(len(code))
    levels = [(np.full(len(code), ~np.uint64(0)), code, home, home)]
    while len(levels[-1][1]) > FAN:
        mask, pattern, low, high = levels[-1]
        at = np.arange(0, len(pattern), FAN)
        every, some = np.bitwise_and.reduceat(pattern, at), np.bitwise_or.reduceat(pattern, at)
        mask = np.bitwise_and.reduceat(mask, at) & ~(every ^ some)
        levels.append((mask, every & mask, low[at], high[np.minimum(at + FAN, len(high)) - 1]))
    a, b = np.triu_indices(len(levels[-1][1])) if len(code) else (np.zeros(0, np.int64),) * 2
    stack = [(len(levels) - 1, a, b)]
    step = np.arange(FAN)
    while stack:
        depth, a, b = stack.pop()
        mask, pattern, low, high = levels[depth]
        keep = low[b] <= high[a]
        a, b = a[keep], b[keep]
        near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= radius
        a, b = a[near], b[near]
        if depth == 0:
            keep = (a != b) & (home[a] == home[b])
            join_labels(labels, a[keep], b[keep])
            continue
        below, most = len(levels[depth - 1][1]), TOGETHER // (FAN * FAN)
        for k in range(0, len(a), most):
            x = (a[k : k + most, None, None] * FAN + step[:, None] + 0 * step).ravel()
            y = (b[k : k + most, None, None] * FAN + step + 0 * step[:, None]).ravel()
            keep = (x <= y) & (y < below)
            stack.append((depth - 1, x[keep], y[keep]))
    return order, labels


def _bits(value: Column, start: int, size: int) -> Column:
    """size bits of a long from bit start on."""
    return F.shiftrightunsigned(value, start).bitwiseAND(F.lit((1 << size) - 1).cast("long"))


def bucketed(entries: DataFrame, radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """(fp, key): each entry once for each of its buckets; buckets over `most` entries are split while bits are left."""
    left = entries.select("fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"))
    width, done, level = 64, None, 0
    while True:
        each, over = divmod(width, radius + 1)
        cells, at = [], 0
        for k in range(radius + 1):
            size = each + (k < over)
            low = _bits(F.col("rest"), 0, at) if at else F.lit(0).cast("long")
            high = F.shiftleft(F.shiftrightunsigned(F.col("rest"), at + size), at) if at + size < width else F.lit(0).cast("long")
            cells.append(F.struct(F.xxhash64("key", F.lit(level * (radius + 1) + k), _bits(F.col("rest"), at, size)).alias("key"), (low.bitwiseOR(high)).alias("rest"), F.lit(size).alias("size")))
            at += size
        spread = left.select("fp", F.explode(F.array(*cells)).alias("c")).select("fp", "c.key", "c.rest", "c.size")
        spread = cut(spread)
        # Sizes differ by a bit at most; splitting goes on with the least number of bits left, the rest holding zeros above.
        width -= each
        level += 1
        large = cut(spread.groupBy("key").count().where(F.col("count") > most).select("key"))
        if width <= radius + 1 or large.isEmpty():
            ready = spread.select("fp", "key")
            return ready if done is None else done.unionByName(ready)
        ready = spread.join(large, "key", "left_anti").select("fp", "key")
        done = ready if done is None else done.unionByName(ready)
        left = spread.join(large, "key", "left_semi").select("fp", "key", "rest")


def links(entries: DataFrame, radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """(a, b) fingerprints that join all entries within the radius of each other: a forest for each bucket, not all pairs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def search(fp: np.ndarray, key: np.ndarray) -> pd.DataFrame:
            order, labels = gray_groups(fp.view(np.uint64), key, radius)
            fp = fp[order]
            child = np.nonzero(labels != np.arange(len(labels)))[0]
            return pd.DataFrame({"a": fp[labels[child]], "b": fp[child]})

        fp, key = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for frame in frames:
            fp, key = np.concatenate([fp, frame["fp"].to_numpy()]), np.concatenate([key, frame["key"].to_numpy()])
            if len(fp) >= READ and key[0] != key[-1]:
                whole = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
                yield search(fp[:whole], key[:whole])
                fp, key = fp[whole:], key[whole:]
        if len(fp):
            yield search(fp, key)

    return bucketed(entries, radius, most).repartition("key").sortWithinPartitions("key").mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, bucket: int = BUCKET, also: DataFrame | None = None, with_mark: bool = False) -> DataFrame:
    """(doc_id, fingerprint, component_id[, mark, first_mark]) for every row of docs; fingerprint is 16 hexadecimal digits.

    component_id is the least doc_id that links of at most `radius` differing bits lead to; mark is a hash of the text,
    and first_mark that of the least document of the component by (doc_id, mark). also: further links, pairs (a, b) of
    marks. A null or empty text, or one without words, has fingerprint zero and links like any other. Repeated rows are
    kept; rows whose doc_id is null take part, with the component of their fingerprint. Other columns are ignored; an
    empty table gives an empty result.
    """
    found = written(fingerprints(docs, shingle, seed))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark")))
    entries = cut(found.groupBy("fp").agg(first.alias("first")))
    edges = links(entries, radius, bucket)
    if also is not None:
        ends = found.select("mark", "fp").distinct()
        more = also.join(ends.withColumnsRenamed({"mark": "a", "fp": "fa"}), "a").join(ends.withColumnsRenamed({"mark": "b", "fp": "fb"}), "b")
        edges = edges.unionByName(more.select(F.col("fa").alias("a"), F.col("fb").alias("b")))
    joined = components(edges)
    named = entries.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    heads = named.groupBy("root").agg(F.min("first").alias("head"))
    by_fp = cut(named.join(heads, "root").select("fp", "head.doc_id", F.col("head.mark").alias("first_mark")).withColumnRenamed("doc_id", "component_id"))
    return found.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *["mark", "first_mark"] * with_mark)


def first_documents(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Of docs, the least document of each component in groups (see near_duplicates), once, and all rows without doc_id; all columns unchanged.

    Documents are ordered by doc_id, then by a hash of the text, which tells the texts of one doc_id apart; of rows that
    repeat both, any one stays.
    """
    stay = groups.where("doc_id = component_id AND mark = first_mark").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    known = docs.where("doc_id IS NOT NULL").withColumn("__mark", marked(F.col("text")))
    first = known.join(stay.withColumnRenamed("__mark", "__first"), (F.col("doc_id").cast("long") == F.col("__id")) & (F.col("__mark") == F.col("__first")))
    return first.dropDuplicates(["__id", "__mark"]).select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
