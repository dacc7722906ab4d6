"""Operator 3: language identification by interpolated Kneser-Ney character models.

Each language has n-gram counts of lower-cased text, in which a run of anything but letters is one blank. The counts of
all languages lie in sorted arrays of n-gram hashes, one row of numbers for each n-gram. A text goes to the language of
least cross-entropy per character. Rejection is calibrated on texts that the models have not seen: a piece of a text is
recognised if for one language it costs no more than what that language's pieces cost allows, and a text is rejected if less than a
third of it is recognised. So texts of several known languages stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Order of the models; texts to learn from in each language, and the longest that may be one of them, in characters.
ORDER, SAMPLE, SAMPLE_CHARS = 4, 400, 50_000
#: One of so many sampled texts calibrates, the others are learnt from; characters in a piece of a text.
CALIBRATE, PIECE = 4, 24
#: A piece is recognised up to REACH times as far from the median of the calibration pieces as this quantile of them; a text of which less than SHARE is recognised is rejected. Nats that a shorter text may cost more.
QUANTILE, REACH, SHARE, SHORT = 0.9, 4.5, 1 / 3, 12.0
#: Languages that may be learnt; more raise an error.
LANGUAGES = 500
#: Characters of longer texts to learn from in a language that has too few others.
LONG_CHARS = 2_000_000
#: Characters of texts that are looked up together (about 200 bytes of memory each); a longer text is looked up alone.
TOGETHER = 400_000
DISCOUNT, CHARS = 0.75, 50_000.0
UNKNOWN = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    """For each code point of the basic plane whether it is a letter; others are looked at one by one."""
    return np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)


_LETTER: list[np.ndarray] = []


def symbols(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of others than letters as one blank; a blank stands at both ends. Empty if there is no letter."""
    if not _LETTER:
        _LETTER.append(_letters())
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _LETTER[0][np.minimum(code, 0xFFFF)]
    wide = np.nonzero(code > 0xFFFF)[0]
    if len(wide):
        is_letter[wide] = [chr(c).isalpha() for c in code[wide].tolist()]
    if not is_letter.any():
        return np.zeros(0, np.uint32)
    out = np.where(is_letter, code, 32).astype(np.uint32)
    keep = is_letter | np.r_[True, is_letter[:-1]]
    out = out[keep]
    out = out if out[0] == 32 else np.r_[np.uint32(32), out]
    return out if out[-1] == 32 else np.r_[out, np.uint32(32)]


def gram_hashes(code: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each symbol but the first, for n from 1 to order (shorter at the start, as 1-grams are)."""
    code = code.astype(np.uint64) + np.uint64(1)
    out = [code * _MIX]
    for n in range(2, order + 1):
        longer = out[-1].copy()
        # An n-gram is its last n - 1 symbols and the one before; where there is none, the shorter one stays.
        longer[n - 1 :] = ((out[-1][n - 1 :] ^ (out[-1][n - 1 :] >> np.uint64(27))) * np.uint64(0xD6E8FEB86659FD93)) + code[: len(code) - n + 1] * np.uint64(0xA24BAED4963EE407)
        out.append(longer)
    return out


class Pieces(NamedTuple):
    """Pieces of PIECE symbols of texts, the last of a text up to twice as long: the text, cross-entropy by language, size."""

    text: np.ndarray
    cost: np.ndarray
    size: np.ndarray


class Models:
    """Kneser-Ney models of several languages in sorted hash arrays.

    For each order, keys are the n-grams' hashes and values their (continuation) counts by language. For each context:
    the total of the counts and how many different symbols follow, by language.
    """

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER, discount: float = DISCOUNT):
        self.order, self.discount, self.langs = order, discount, sorted(texts)
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        per_order: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(order)]
        for lang in self.langs:
            codes = [c for c in map(symbols, texts[lang]) if len(c)]
            for n in range(1, order + 1):
                gram, context, shorter, count = self._counts(codes, n, order)
                per_order[n - 1].append((gram, context, count))
        for n in range(order):
            keys = np.unique(np.concatenate([x[0] for x in per_order[n]] + [np.zeros(0, np.uint64)]))
            values = np.zeros((len(keys), len(self.langs)), np.float32)
            around = np.unique(np.concatenate([x[1] for x in per_order[n]] + [np.zeros(0, np.uint64)]))
            total, kinds = (np.zeros((len(around), len(self.langs)), np.float32) for _ in range(2))
            for k, (gram, context, count) in enumerate(per_order[n]):
                values[np.searchsorted(keys, gram), k] = count
                at = np.searchsorted(around, context)
                np.add.at(total[:, k], at, count)
                np.add.at(kinds[:, k], at, 1)
            self.grams.append((keys, values))
            self.contexts.append((around, total, kinds))
        self.limits = np.full(len(self.langs), np.inf)

    @staticmethod
    def _counts(codes: list[np.ndarray], n: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams of one language with context and count: occurrences at the highest order, else different symbols before."""
        grams, contexts, longer = [], [], []
        for code in codes:
            h = gram_hashes(code, min(n + 1, order))
            first = n if n < order else n - 1
            if len(code) <= first:
                continue
            grams.append(h[n - 1][first:])
            contexts.append(h[n - 2][first - 1 : -1] if n > 1 else np.zeros(len(code) - first, np.uint64))
            longer.append(h[n][first:] if n < order else np.zeros(0, np.uint64))
        if not grams:
            return (np.zeros(0, np.uint64),) * 3 + (np.zeros(0),)
        gram, context, wide = np.concatenate(grams), np.concatenate(contexts), np.concatenate(longer)
        if n < order:  # each different longer n-gram counts once
            _, at = np.unique(wide, return_index=True)
            gram, context = gram[at], context[at]
        keys, at, count = np.unique(gram, return_index=True, return_counts=True)
        return keys, context[at], keys, count.astype(np.float64)

    def chances(self, hashes: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
        """Probability of each n-gram's last symbol by language; hashes[n - 1] has its n-gram, before[n - 1] that one's context."""
        p = np.full((len(hashes[0]), len(self.langs)), 1.0 / CHARS)
        for n in range(self.order):
            keys, values = self.grams[n]
            around, total, kinds = self.contexts[n]
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, hashes[n]), len(keys) - 1)
            count = np.where((keys[at] == hashes[n])[:, None], values[at], 0)
            at = np.minimum(np.searchsorted(around, before[n]), len(around) - 1)
            here = (around[at] == before[n])[:, None]
            all_, seen = np.where(here, total[at], 0), np.where(here, kinds[at], 0)
            some = np.maximum(all_, 1)
            p = np.where(all_ > 0, np.maximum(count - self.discount, 0) / some + self.discount * seen / some * p, p)
        return p

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, Pieces]:
        """Cross-entropy in nats per symbol, by text and language, each text's number of symbols (0: no letter), and the texts' pieces."""
        codes = [symbols(t) for t in texts]
        sizes = np.array([max(0, len(c) - 1) for c in codes])
        out = np.zeros((len(texts), len(self.langs)))
        some = [k for k, c in enumerate(codes) if len(c)]
        if not some:
            return out, sizes, Pieces(np.zeros(0, np.int64), out[:0], sizes[:0])
        hashes = [gram_hashes(codes[k], self.order) for k in some]
        top = np.concatenate([h[-1][1:] for h in hashes])
        _, at, back = np.unique(top, return_index=True, return_inverse=True)
        each = [np.concatenate([h[n][1:] for h in hashes])[at] for n in range(self.order)]
        before = [np.zeros(len(at), np.uint64)] + [np.concatenate([h[n][:-1] for h in hashes])[at] for n in range(self.order - 1)]
        cost = -np.log(self.chances(each, before))
        starts = np.r_[0, np.cumsum(sizes[some])][:-1]
        n_pieces = np.maximum(1, sizes[some] // PIECE)
        text = np.repeat(np.arange(len(some)), n_pieces)
        edge = starts[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)) * PIECE
        long = np.diff(np.r_[edge, int(sizes[some].sum())])
        total = np.stack([np.add.reduceat(cost[back, k], edge) for k in range(len(self.langs))], 1)
        out[some] = np.add.reduceat(total, np.cumsum(n_pieces) - n_pieces, axis=0) / sizes[some][:, None]
        return out, sizes, Pieces(np.array(some)[text], total / long[:, None], long)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats per symbol, by text and language, and each text's number of symbols (0: no letter)."""
        return self.costs(texts)[:2]

    def calibrate(self, texts: dict[str, list[str]]) -> None:
        """Set each language's limit for a piece, from texts that were kept out of the models."""
        for k, lang in enumerate(self.langs):
            cost = self.costs(texts.get(lang, []))[2].cost[:, k]
            if len(cost):
                middle, high = np.quantile(cost, [0.5, QUANTILE])
                self.limits[k] = middle + REACH * (high - middle)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, bool]]:
        """(language, score, cross-entropy, rejected). Without a letter, or without models: und, 0, 0, rejected.

        score is the chance of the language among those learnt, times the part of the text that is recognised. Of
        languages that cost the same the first by name is taken.
        """
        if not self.langs:
            return [(UNKNOWN, 0.0, 0.0, True)] * len(texts)
        cost, size, pieces = self.costs([t or "" for t in texts])
        best = cost.argmin(1)
        least = cost[np.arange(len(cost)), best]
        chance = 1 / np.exp(np.minimum(50, (least[:, None] - cost) * -np.minimum(size, 20)[:, None]) * -1).sum(1)
        more = SHORT * np.maximum(0, 1 / np.maximum(pieces.size, 1) - 1 / PIECE)
        known = (pieces.cost <= self.limits + more[:, None]).any(1)
        share = np.bincount(pieces.text, known * pieces.size, len(texts)) / np.maximum(size, 1)
        return [(self.langs[b], float(min(1.0, c * s)), float(e), bool(s < SHARE)) if n else (UNKNOWN, 0.0, 0.0, True) for b, c, s, e, n in zip(best, chance, share, least, size, strict=True)]


def held_out(doc_id: str = "doc_id"):
    """Is the CRC-32 of the id as text 2 modulo 4?"""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE, longest: int = SAMPLE_CHARS, order: int = ORDER) -> Models:
    """Learn from at most `sample` whole texts of each language, those of least id hash among texts of at most `longest` characters.

    A language that has fewer of these also gives longer ones, whole and the shortest first: as many as have LONG_CHARS
    characters together, and one in any case if it has no others. Rows that are held out, or whose text or lang is
    null, are not learnt from. Of rows that tie by hash any may be taken. The driver gets at most `sample` texts of each
    of at most LANGUAGES languages. One in CALIBRATE of a language's texts is kept out of the models and sets its limit;
    a language with fewer texts is calibrated on those that it was learnt from.
    """
    usable = docs.where("text IS NOT NULL AND lang IS NOT NULL").where(~held_out())
    usable = usable.select("lang", "text", F.xxhash64("doc_id", "lang", "text").alias("h"), F.length("text").alias("size"))
    fits = F.col("size") <= longest
    counted = usable.groupBy("lang").agg(F.count_if(fits).alias("n"), F.count_if(~fits).alias("more")).limit(LANGUAGES + 1).collect()
    if len(counted) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    sizes = {r["lang"]: (r["n"], r["more"]) for r in counted}
    counts = {k: n for k, (n, _) in sizes.items() if n}
    texts: dict[str, list[str]] = {}
    if counts:
        # Few enough rows pass this bound for a cheap choice; the choice itself is the least by hash, whatever repeats.
        share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(2**63 - 1, int((1.3 * sample + 30) / n * 2**63)))])
        place = F.col("h").bitwiseAND(F.lit(2**63 - 1))
        rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "h"))
        bounded = usable.where(fits).select("lang", "text", place.alias("place"), "h")
        short = list(counts)
        for rows in (bounded.where(F.col("place") <= share[F.col("lang")]), bounded):  # all where rows that repeat crowd the hashes
            chosen = rows.where(F.col("lang").isin(short)).withColumn("k", rank).where(F.col("k") <= sample)
            texts |= {lang: [] for lang in short}
            for r in sorted(chosen.select("lang", "k", "text").collect(), key=lambda r: (r["lang"], r["k"])):
                texts[r["lang"]].append(r["text"])
            short = [lang for lang in short if len(texts[lang]) < min(sample, counts[lang])]
            if not short:
                break
    few = [k for k, (n, more) in sizes.items() if n < sample and more]
    if few:
        wide = usable.where(~fits).where(F.col("lang").isin(few))
        rank = F.row_number().over(Window.partitionBy("lang").orderBy("size", "h"))
        first = wide.select("lang", "h", "size").withColumn("k", rank).where(F.col("k") <= sample).orderBy("lang", "k").collect()  # of each language at most `sample` rows, without texts
        most = {}
        for lang in few:
            own, total = [r for r in first if r["lang"] == lang][: sample - len(texts.get(lang, []))], 0
            for r in own:
                total += r["size"]
                if total <= LONG_CHARS or (r is own[0] and lang not in texts):
                    most[lang] = (r["size"], r["h"])
        if most:
            last = F.create_map(*[x for k, (n, h) in most.items() for x in (F.lit(k), F.struct(F.lit(n).alias("size"), F.lit(h).cast("long").alias("h")))])
            chosen = wide.where(F.struct("size", "h") <= last[F.col("lang")]).select("lang", "text", "size", "h").withColumn("k", rank).where(F.col("k") <= sample)
            for r in chosen.select("lang", "text").collect():
                texts.setdefault(r["lang"], []).append(r["text"])
    apart = {lang: own[CALIBRATE - 1 :: CALIBRATE] for lang, own in texts.items()}
    kept = {lang: [t for k, t in enumerate(own) if k % CALIBRATE != CALIBRATE - 1] for lang, own in texts.items()}
    models = Models(kept, order)
    models.calibrate({lang: apart[lang] or kept[lang] for lang in texts})
    return models


def identify(docs: DataFrame, models: Models | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, cross_entropy, rejected) for every row of docs.

    models: those to use; else they are fitted on docs, which then needs lang. Predictions see the text alone. A null
    text or one without a letter is `und` with score 0, and rejected. Repeated rows and null ids are kept; other columns
    are ignored; an empty table gives an empty result. Whole texts count, however long. One narrow pass; a lost task is
    run again.
    """
    models = models or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(models)  # of bounded size: it comes from a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(2).to_pylist(), 0
            found: list[tuple[str, float, float, bool]] = []
            while at < len(texts):  # so many characters together that memory stays small
                end, size = at, 0
                while end < len(texts) and (end == at or size < TOGETHER):
                    size += len(texts[end] or "")
                    end += 1
                found += shared.value.predict(texts[at:end])
                at = end
            columns = [[x[k] for x in found] for k in range(4)]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")


def accepted(docs: DataFrame, models: Models | None = None) -> DataFrame:
    """The rows of docs, all columns unchanged, whose text is not rejected; see identify.

    A null or empty text, or one without a letter, goes. Null ids and repeated rows make no difference.
    """
    models = models or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(1000, TOGETHER * max(1, batch.num_rows) // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                yield part.filter(pa.array([not x[3] for x in shared.value.predict(part.column(at_text).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
