"""Near copies by word shingles: MinHash bands find candidates, the shingle sets of each candidate pair decide.

Texts of equal words are one. Texts that agree in a band share a bucket; a bucket of many texts is split by the other
bands, again while it is large, so that what is alike meets and what is not parts. Each text is compared with one text
of its bucket, then with a second. Only where the links so found leave a bucket in several components are the members
of different ones compared with each other, in blocks that give a link for two components, not for two texts. So links join all pairs that meet, and a large group of copies is never
listed by pairs. The first text that the others are compared with is the one whose buckets are largest, as a text with
few changes has; and a text whose shingles are too seldom found in others to be near any is compared no further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, written
from .simhash import marked

#: Words of a shingle and the Jaccard index from which two sets of shingles are near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: A pair at 0.8 agrees in one of 18 bands of 4 minima with probability 0.9999.
BANDS, EACH, TURNS = 18, 4, 2
#: Texts in a bucket before it is split by the other bands, and how often.
CROWD, SPLITS = 2000, 2
#: Texts and shingles of a part of a bucket that meets another in one task, and columns of a matrix.
PART, PART_SHINGLES, WIDTH = 1024, 2_000_000, 2048
_BY = np.random.default_rng(5).integers(0, 1 << 63, (2, BANDS * EACH, 1), dtype=np.uint64)


def shingle_set(raw: bytes, shingle: int = SHINGLE) -> tuple[int, np.ndarray]:
    """A hash of the words, and the different hashes of their shingles: of all words if they are fewer, none without words."""
    words = raw.lower().split()  # of bytes: A-Z alone, and ASCII white space alone
    line = b" ".join(words)
    if not words:
        return 0, np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w) for w in words], np.uint64)
    n = min(shingle, len(words))
    mixed = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(mixed)]
    return digest(line), np.unique(mixed ^ (mixed >> np.uint64(32)))


def bands(shingles: np.ndarray) -> np.ndarray:
    """A hash of each band's minima, signed."""
    least = np.full(BANDS * EACH, ~np.uint64(0))
    for at in range(0, len(shingles), 1000):
        part = (shingles[at : at + 1000] ^ _BY[1]) * (_BY[0] | np.uint64(1))
        least = np.minimum(least, (part ^ (part >> np.uint64(32))).min(1))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, EACH))], np.uint64).view(np.int64)


def _hashed(docs: DataFrame, shingle: int, banded: bool) -> DataFrame:
    """(doc_id, mark, same, xs) of rows whose text has words: the text's hash, the words' hash, and the bands or the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, same, found = [], [], []
            for k, raw in enumerate(batch.column(2)):
                h, xs = shingle_set(raw.as_py() or b"", shingle)
                if len(xs):
                    kept.append(k)
                    same.append(h)
                    found.append(bands(xs) if banded else xs.view(np.int64))
            keys = batch.select([0, 1]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(np.array(same, np.uint64).view(np.int64)), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "mark", "same", "xs"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), marked(text).alias("mark"), text.cast("binary").alias("text")).mapInArrow(run, "doc_id long, mark long, same long, xs array<long>")


def _places(texts: DataFrame) -> DataFrame:
    """(same, mark, key): each text once for each of its buckets that others share."""
    left = texts.select("same", "mark", F.posexplode("xs").alias("band", "key"))
    left = left.select("same", "mark", F.xxhash64("band", "key").alias("key"))
    done = None
    for turn in range(SPLITS + 1):
        left = written(left)
        sizes = cut(left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))  # cut, so that the join may split a large bucket
        ready = left.join(sizes.where(F.col("n") <= CROWD) if turn < SPLITS else sizes, "key").select("same", "mark", "key")
        done = ready if done is None else done.unionByName(ready)
        large = sizes.where(F.col("n") > CROWD)
        if turn == SPLITS or large.isEmpty():
            return written(done.distinct())
        bands_of = texts.select("same", "xs")  # fetched again for large buckets alone, for they are as long as all rows of a text
        left = left.join(large, "key").join(bands_of, "same").select("same", "mark", F.explode(F.transform("xs", lambda x, k: F.xxhash64("key", k, x))).alias("key"))
    raise AssertionError


def _shared(sets: DataFrame, live: DataFrame) -> DataFrame:
    """(same, size, xs): of each live text the number of its shingles, and those that another live text has too.

    Two texts have no more shingles in common than either shares with any: this rules texts out without loss.
    """
    each = written(sets.join(live, "same").select("same", F.size("xs").alias("size"), F.explode("xs").alias("x")))
    known = cut(each.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("x"))
    return each.join(known, "x").groupBy("same", "size").agg(F.collect_list("x").alias("xs"))  # at most the shingles of one text


def _between(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b): a link for each two components (root) of a bucket (key) that hold near copies of each other.

    A bucket is dealt into parts of about PART texts and PART_SHINGLES shingles at most, and every two parts meet in one
    task, which counts common shingles by products of incidence matrices, WIDTH shingles at a time.
    """
    parts = cut(members.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / PART), F.ceil(F.sum(F.size("xs")) / PART_SHINGLES)).alias("parts")))
    dealt = members.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("same", F.lit("part")), "parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    dealt = dealt.select("key", "same", "root", "size", "xs", "part", other)
    dealt = dealt.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        low, high = group["low"].iloc[0], group["high"].iloc[0]
        one, two = (np.flatnonzero(group["part"] == k) for k in (low, high))
        same, root, size = (group[c].to_numpy() for c in ("same", "root", "size"))
        _, ids = np.unique(np.concatenate(group["xs"].to_list()), return_inverse=True)
        owner = np.repeat(np.arange(len(group)), group["xs"].str.len())
        order = np.argsort(ids, kind="stable")
        ids, owner = ids[order], owner[order]
        common = np.zeros((len(one), len(two)), np.float32)
        for at in range(0, int(ids[-1]) + 1, WIDTH):
            here = slice(*np.searchsorted(ids, [at, at + WIDTH]))
            holds = np.zeros((len(group), WIDTH), np.float32)
            holds[owner[here], ids[here] - at] = 1
            common += holds[one] @ holds[two].T
        near = common / (size[one][:, None] + size[two][None, :] - common) >= similarity
        i, j = np.nonzero(near & (root[one][:, None] != root[two][None, :]))
        found = pd.DataFrame({"a": same[one[i]], "b": same[two[j]], "ra": root[one[i]], "rb": root[two[j]]})
        return found.drop_duplicates(["ra", "rb"])[["a", "b"]]

    return dealt.groupBy("key", "low", "high").applyInPandas(compare, "a long, b long")


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): hashes of texts with different words, as simhash.marked gives them, whose links join all near copies that share a band.

    Of texts with equal words one speaks for all. Texts without words and rows without a doc_id link to none; repeated
    rows count once; other columns are ignored; an empty table gives no links.
    """
    docs = docs.where("doc_id IS NOT NULL")
    who = F.min(F.struct("mark", F.col("doc_id").cast("long").alias("doc_id")))
    texts = written(_hashed(docs, shingle, True).groupBy("same").agg(who.alias("who"), F.first("xs").alias("xs")).select("same", "who.mark", "who.doc_id", "xs"))
    places = _places(texts)
    speakers = texts.join(places.select("same").distinct(), "same", "left_semi").select("doc_id", "mark")
    sets = docs.select(F.col("doc_id").cast("long"), marked(F.col("text")).alias("mark"), "text").join(speakers, ["doc_id", "mark"], "left_semi")  # by the id too, for a text may have many rows
    sets = written(_hashed(sets, shingle, False).dropDuplicates(["same"]).select("same", "xs"))
    sizes = cut(places.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    weights = places.join(sizes, "key").groupBy("same").agg(F.sum("n").alias("weight"))
    places = written(places.join(weights, "same"))

    def alike(pairs: DataFrame) -> DataFrame:
        both = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        both = both.join(sets.select(F.col("same").alias("a"), F.col("xs").alias("xa")), "a").join(sets.select(F.col("same").alias("b"), F.col("xs").alias("xb")), "b")
        both = both.withColumn("n", F.size(F.array_intersect("xa", "xb")))
        return written(both.where(F.col("n") / (F.size("xa") + F.size("xb") - F.col("n")) >= similarity).select("a", "b"))

    found = None
    for turn in range(TURNS):
        salt = F.xxhash64("same", F.lit(turn))
        by = F.struct(-F.col("weight") if turn == 0 else salt, salt.alias("h"), F.col("same").alias("b"))
        one = cut(places.groupBy("key").agg(F.min(by)["b"].alias("b")))
        links = alike(places.join(one, "key").where("same <> b").select(F.col("same").alias("a"), "b"))
        found = links if found is None else found.unionByName(links)
    named = places.join(components(found).withColumnRenamed("node", "same"), "same", "left").select("key", "same", F.coalesce("root", "same").alias("root"))
    named = written(named)
    several = cut(named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key"))
    open_ = written(named.join(several, "key"))
    shared = _shared(sets, open_.select("same").distinct()).where(F.size("xs") >= F.col("size") * (similarity - 1e-9))
    rest = written(_between(open_.join(written(shared), "same"), similarity).distinct())
    ids = places.select("same", "mark").distinct()
    out = found.unionByName(rest).join(ids.withColumnsRenamed({"same": "a", "mark": "da"}), "a").join(ids.withColumnsRenamed({"same": "b", "mark": "db"}), "b")
    return out.select(F.col("da").alias("a"), F.col("db").alias("b"))
