"""Operator 1: substring deduplication by compressed FM-indexes.

Every window of words belongs to one anchor, its k-gram of least hash, so equal windows share an anchor. Consecutive
windows of one anchor form a segment. Anchors that occur once cannot repeat anything. The segments of the others are
combined by content (their first place and, implicitly, their number) and dealt to shards by anchor. Each shard builds
an FM-index over its segments: a suffix array to the depth of a window, its Burrows-Wheeler transform in a wavelet
matrix, and rank directories. The shard's segments then stream through backward search, all windows at once; it gives
the matching statistics, how many words before each place also stand elsewhere, up to the threshold, and the intervals
of those that reach it. The least place in such an interval is where the word sequence starts first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, written

WINDOW, GRAM = 20, 5
#: Segments in a shard, on average; segments of one anchor beyond which its windows are dealt out singly.
SHARD, HOT = 40_000, 20_000
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def segments(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor hash, content hash) of the segments of one document, given its words' hashes."""
    n = len(h) - window + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    grams = h[: len(h) - gram + 1].copy()
    for k in range(1, gram):
        grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(_BASE) + h[k : len(h) - gram + 1 + k]
    grams = (grams ^ (grams >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    best, span, width = np.arange(len(grams)), 1, window - gram + 1
    while span < width:  # the place of the least gram of each run, by doubling
        by = min(span, width - span)
        a, b = best[:-by], best[by:]
        best = np.where(grams[b] < grams[a], b, a)
        span += by
    start = np.nonzero(np.r_[True, best[1:] != best[:-1]])[0]
    count = np.diff(np.r_[start, n])
    powers = _powers(len(h), _BASE)
    inverse = pow(_BASE, -1, 1 << 64)
    total = np.r_[np.uint64(0), np.cumsum((h ^ (h >> np.uint64(31))) * powers, dtype=np.uint64)]
    content = (total[start + count + window - 1] - total[start]) * _powers(len(h), inverse)[start]
    content = (content ^ (content >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + count.astype(np.uint64)
    return start, count, grams[best[start]], content


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector for each bit of a symbol, with counts every 64 bits."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = []
        base = np.zeros(sigma, np.int64)
        symbols = np.arange(sigma)
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            ones = ((seq >> bit) & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            packed = np.r_[packed, np.zeros(8 + -len(packed) % 8, np.uint8)].view(np.uint64)
            counts = np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)][:-1]
            zeros = len(seq) - int(ones.sum())
            self.levels.append((bit, packed, counts, zeros))
            up = ((symbols >> bit) & 1).astype(bool)
            r = self._ones(packed, counts, base)
            base = np.where(up, zeros + r, base - r)
            seq = np.concatenate([seq[~ones], seq[ones]])
        self.base = base  # where each symbol's run starts behind the last level

    @staticmethod
    def _ones(packed: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return counts[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        for bit, packed, counts, zeros in self.levels:
            r = self._ones(packed, counts, at)
            at = np.where((symbol >> bit) & 1 == 1, zeros + r, at - r)
        return at - self.base[symbol]


class FmIndex:
    """Backward search over a text of symbols from 1 on, where 0 ends each segment. Patterns may have up to `depth` symbols."""

    def __init__(self, text: np.ndarray, depth: int):
        rank, h = text.astype(np.int64), 1
        while h < depth:
            after = np.r_[rank[h:], np.zeros(min(h, len(rank)), np.int64)][: len(rank)]
            _, rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + after, return_inverse=True)
            h *= 2
        self.sa = np.argsort(rank, kind="stable")
        sigma = int(text.max(initial=0)) + 1
        self.bwt = WaveletMatrix(text[self.sa - 1].astype(np.int64), sigma)
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))]

    def matching(self, text: np.ndarray, end: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the places `end` of text: how many symbols before each occur at least twice, up to `depth`.

        Then which of them reach the depth, and the bounds of their intervals.
        """
        which = np.arange(len(end))
        length = np.zeros(len(end), np.int64)
        symbol = text[end - 1]
        low, high = self.first[symbol], self.first[symbol + 1]
        for k in range(2, depth + 1):
            more = high - low > 1  # a pattern that is alone matches no further elsewhere
            which, low, high = which[more], low[more], high[more]
            length[which] = k - 1
            symbol = text[end[which] - k]
            both = self.first[symbol] + self.bwt.rank(np.r_[symbol, symbol], np.r_[low, high]).reshape(2, -1)
            low, high = both
        more = high - low > 1
        length[which[more]] = depth
        return length, which[more], low[more], high[more]


def first_places(frame: pd.DataFrame, window: int = WINDOW) -> pd.DataFrame:
    """One shard: its segments (anchor, seg, doc_id, nth, start, words) to runs of windows and where their words start first."""
    words = [bytes(x).split(b" ") for x in frame["words"]]
    size = np.fromiter(map(len, words), np.int64, len(words))
    known: dict[bytes, int] = {}
    text = np.zeros(int(size.sum()) + len(size), np.int64)
    begin = np.r_[0, np.cumsum(size + 1)][:-1]
    flat = np.fromiter((known.setdefault(w, len(known) + 1) for ws in words for w in ws), np.int64, int(size.sum()))
    inside = np.ones(len(text), bool)
    inside[begin + size] = False
    text[inside] = flat
    named = np.empty(len(frame), [("doc_id", np.int64), ("nth", np.int64)])
    named["doc_id"], named["nth"] = frame["doc_id"], frame["nth"]
    docs, doc = np.unique(named, return_inverse=True)
    place = np.repeat((doc << 32) + frame["start"].to_numpy() - begin, size + 1) + np.arange(len(text))
    n = size - window + 1
    seg = np.repeat(np.arange(len(n)), n)
    offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = begin[seg] + offset
    index = FmIndex(text, window)
    _, which, low, high = index.matching(text, at + window, window)
    least = place[at]
    if len(which):
        low, back = np.unique(low, return_inverse=True)
        top = np.zeros(len(low), np.int64)
        top[back] = high
        by_suffix = np.r_[place[index.sa], 0]
        least[which] = np.minimum.reduceat(by_suffix, np.c_[low, top].ravel())[::2][back]
    head = np.nonzero(np.r_[True, (seg[1:] != seg[:-1]) | (least[1:] != least[:-1] + 1)])[0] if len(seg) else np.zeros(0, np.int64)
    last = np.r_[head[1:], len(seg)][: len(head)] - 1
    return pd.DataFrame({"anchor": frame["anchor"].to_numpy()[seg[head]], "seg": frame["seg"].to_numpy()[seg[head]], "low": offset[head], "high": offset[last], "e_doc": docs["doc_id"][least[head] >> 32], "e_nth": docs["nth"][least[head] >> 32], "e_start": least[head] & 0xFFFFFFFF})


RUNS = "anchor long, seg long, low long, high long, e_doc long, e_nth long, e_start long"
#: Ids with several texts up to which these are broadcast.
SEVERAL = 1_000_000


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, nth, raw): nth is 0, but in rows whose doc_id has several texts, where it is a hash of the text."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("raw"))
    hashed = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("raw").alias("h"))
    several = cut(hashed.groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("doc_id", F.lit(True).alias("several")))
    n = several.count()
    if not n:
        return docs.select("doc_id", F.lit(0).cast("long").alias("nth"), "raw")
    joined = docs.join(F.broadcast(several) if n <= SEVERAL else several, "doc_id", "left")
    return joined.select("doc_id", F.when(F.col("several"), F.xxhash64("raw")).otherwise(0).alias("nth"), "raw")


def _anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for doc, nth, raw in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                words = (raw.as_py() or b"").split()
                if len(words) >= window:
                    start, count, anchor, seg = segments(word_hashes(words), window, gram)
                    parts.append((np.full(len(start), doc.as_py()), np.full(len(start), nth.as_py()), start, count, anchor.view(np.int64), seg.view(np.int64)))
            whole = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 6
            yield pa.RecordBatch.from_arrays([pa.array(whole[0]), pa.array(whole[1]), pa.array(whole[2].astype(np.int32)), pa.array(whole[3].astype(np.int32)), pa.array(whole[4]), pa.array(whole[5])], names=["doc_id", "nth", "start", "n", "anchor", "seg"])

    return docs.where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, nth long, start int, n int, anchor long, seg long")


def _texts(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Words of the wanted segments (doc_id, nth, start, n, anchor, seg, hot), read again from their documents."""
    listed = wanted.groupBy("doc_id", "nth").agg(F.collect_list(F.struct("start", "n", "anchor", "seg", "hot")).alias("own"))  # at most the segments of one document

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, nth, raw, own in zip(frame["doc_id"], frame["nth"], frame["raw"], frame["own"], strict=True):
                words = (raw or b"").split()
                for s in own:
                    a, z = s["start"], s["start"] + s["n"] + window - 1
                    if z <= len(words):
                        rows.append((doc, nth, a, s["anchor"], s["seg"], s["hot"], b" ".join(words[a:z])))
            yield pd.DataFrame(rows, columns=["doc_id", "nth", "start", "anchor", "seg", "hot", "words"])

    return docs.join(listed, ["doc_id", "nth"]).select("doc_id", "nth", "raw", "own").mapInPandas(run, "doc_id long, nth long, start int, anchor long, seg long, hot boolean, words binary")


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(doc_id, nth, low, high): words low to high - 1 of a document are covered by windows that also start earlier.

    docs needs doc_id, nth and raw, the text's bytes; see numbered. Spans may touch or overlap.
    """
    found = _anchors(docs, window, gram)
    often = cut(found.groupBy("anchor").count().where("count > 1").select("anchor"))  # cut, so that the join may split a frequent anchor
    found = written(found.join(often, "anchor"))
    firsts = found.groupBy("anchor", "seg").agg(F.min(F.struct("doc_id", "nth", "start")).alias("at"), F.first("n").alias("n"))
    firsts = written(firsts.select("anchor", "seg", "at.doc_id", "at.nth", "at.start", "n"))
    sizes = firsts.groupBy("anchor").count()
    crowded = cut(sizes.where(F.col("count") > hot).select("anchor"))  # at most total / hot rows
    wanted = firsts.join(crowded.withColumn("hot", F.lit(True)), "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    texts = written(_texts(docs, wanted, window))
    shards = max(1, -(-firsts.count() // shard))
    runs = texts.where("NOT hot").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard").applyInPandas(lambda frame: first_places(frame, window), RUNS)
    if not crowded.isEmpty():  # windows of a crowded anchor: combined by content before they meet
        list_ = F.split(F.col("words").cast("string"), " ")
        each = texts.where("hot").select("anchor", "seg", "doc_id", "nth", "start", list_.alias("w"))
        each = each.select("anchor", "seg", "doc_id", "nth", "start", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - window + 1), lambda i: F.sha2(F.array_join(F.slice("w", i, window), " "), 256))).alias("low", "content"))
        each = each.withColumn("place", F.struct("doc_id", "nth", (F.col("start") + F.col("low")).alias("start")))
        least = each.groupBy("content").agg(F.min("place").alias("e"))
        runs = runs.unionByName(each.join(least, "content").select("anchor", "seg", F.col("low").cast("long"), F.col("low").cast("long").alias("high"), F.col("e.doc_id").alias("e_doc"), F.col("e.nth").alias("e_nth"), F.col("e.start").cast("long").alias("e_start")))
    all_ = found.join(runs, ["anchor", "seg"])
    own = F.col("start") + F.col("low")
    earlier = F.struct("e_doc", "e_nth", F.col("e_start").alias("s")) < F.struct("doc_id", "nth", own.cast("long").alias("s"))
    return all_.where(earlier).select("doc_id", "nth", own.alias("low"), (F.col("start") + F.col("high") + window).alias("high"))


def remove_repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) for every row of docs.

    Words are runs of what is not ASCII white space, unchanged. A word goes if a window of `window` words that covers it
    also starts earlier: in a smaller doc_id, or earlier in the same document. Null, empty and short texts lose nothing.
    Rows that repeat a doc_id and text are one document and get the same result; rows of one doc_id with different texts
    are different documents, in the order of a hash of the text. A row whose doc_id is null is left as it is, for it has
    no place in the order. Other columns are ignored; an empty table gives an empty result.
    """
    docs = numbered(docs)
    spans = repeated_spans(docs, window, gram, shard, hot)
    listed = spans.groupBy("doc_id", "nth").agg(F.collect_set(F.struct("low", "high")).alias("spans"))  # of one document: at most one for each of its windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, digest, kept = [], [], [], []
            for raw, own in zip(batch.column(1), batch.column(2), strict=True):
                words = (raw.as_py() or b"").split()
                left = words
                if own.is_valid and words:
                    mark = np.zeros(len(words) + 1, np.int64)
                    ends = own.values
                    np.add.at(mark, np.minimum(ends.field(0).to_numpy(), len(words)), 1)
                    np.add.at(mark, np.minimum(ends.field(1).to_numpy(), len(words)), -1)
                    left = [w for w, m in zip(words, np.cumsum(mark).tolist(), strict=False) if not m]
                line = b" ".join(left)
                total.append(len(words))
                gone.append(len(words) - len(left))
                digest.append(hashlib.sha256(line).hexdigest())
                kept.append(line.decode("utf-8", "replace"))
            columns = [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.string())] * with_text, names=names + ["kept"] * with_text)

    joined = docs.join(listed, ["doc_id", "nth"], "left").select("doc_id", "raw", "spans")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


#: Every window by its words; ids are taken for unique.
ORACLE = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20
), k AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS words FROM s
), c AS (SELECT doc_id, i, row_number() OVER (PARTITION BY words ORDER BY doc_id, i) AS copy FROM k
), g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM c WHERE copy > 1
), p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d
), r AS (
  SELECT p.doc_id, count(g.pos) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p.pos) FILTER (g.pos IS NULL), '') AS kept
  FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.pos = p.pos GROUP BY p.doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(r.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""
