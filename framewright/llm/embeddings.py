"""Operator 7: near-duplicate vectors by random-hyperplane hashing.

Equal vectors are one entry with a multiplicity. In each of several tables the signs of an entry's products with random
hyperplanes name its bucket. Pairs that share a bucket are compared exactly, in blocks; a pair that meets in several
tables counts in the first of them alone, which the two lists of bucket names tell. Links and their numbers leave a
block as one row for each entry, never as pairs; components of the links are found by distributed contraction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, join_labels, written

COSINE, SEED = 0.95, 7
#: Chance to miss a pair whose cosine is just the threshold; entries in a bucket of vectors without structure; entries in a block.
MISS, LOAD, BLOCK = 1e-4, 8, 1024


def plan(n: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Bits of a table's bucket names and number of tables for n different vectors: buckets stay of one size as n grows."""
    bits = min(30, max(6, math.ceil(math.log2(max(n, 1) / LOAD))))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - meet)))


def names(unit: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """Bucket name of each unit vector in each table."""
    planes = np.random.default_rng([seed, unit.shape[1]]).standard_normal((unit.shape[1], bits * tables))
    signs = (unit @ planes > 0).reshape(len(unit), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64)).astype(np.int32)


def unit_rows(vectors: list, kind: str = "float64") -> np.ndarray:
    """Vectors, given as their bytes in a numeric type, with length one in double precision."""
    unit = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(float)
    unit /= np.abs(unit).max(1, keepdims=True)  # no square overflows
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def compare(unit: np.ndarray, name: np.ndarray, many: np.ndarray, side: np.ndarray, table: int, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a block: the first row that links lead to, and how many vectors it links with that no earlier table shows.

    side: 0 for rows that are compared with each other; 1 and 2 for those compared with rows of the other side alone.
    """
    labels, n = np.arange(len(unit)), np.zeros(len(unit), np.int64)
    close = np.triu(unit @ unit.T >= cosine, 1)
    if side.any():
        close &= side[:, None] != side[None, :]
    a, b = np.nonzero(close)
    for at in range(0, len(a), 1 << 16):
        x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        new = (name[x] == name[y]).argmax(1) == table
        np.add.at(n, x[new], many[y[new]])
        np.add.at(n, y[new], many[x[new]])
    join_labels(labels, a, b)
    return labels, n


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors.

    n_links counts the other vectors found with a cosine of at least `cosine` in double precision; equal vectors count
    each. component_id is the least vec_id that links lead to; kept tells whether that is the vector itself. A vector
    that is null, empty or zero, or holds null or non-finite numbers, links with nothing; so does a row without vec_id,
    whose component_id is null and which is kept. Vectors of different lengths do not link. Rows that repeat a vec_id
    and vector are one vector. Other columns are ignored; an empty table gives an empty result.
    """
    v = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & v.isNotNull() & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v"), F.coalesce(sound, F.lit(False)).alias("sound"))
    rows = rows.withColumn("key", F.when(F.col("sound"), F.sha2(F.to_json("v").cast("binary"), 256)))
    good = rows.where("sound")
    ids = written(good.select("vec_id", "key").distinct())
    entries = ids.groupBy("key").agg(F.min("vec_id").alias("entry"), F.count(F.lit(1)).alias("many"))
    entries = written(entries.join(good.groupBy("key").agg(F.first("v").alias("v")), "key"))
    bits, tables = plan(entries.count(), cosine, miss)

    # Single precision is kept where the input has it; products are taken in double precision all the same.
    kind = "float32" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "float64"
    name_kind = "uint16" if bits <= 16 else "uint32"

    def deal(full: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                size = frame["v"].map(len)
                for dim, same in frame.groupby(size):
                    for at in range(0, len(same), 512):
                        part = same.iloc[at : at + 512]
                        raw = [np.asarray(x, kind).tobytes() for x in part["v"]]
                        name = names(unit_rows(raw, kind), bits, tables, seed)
                        table = np.tile(np.arange(tables), len(part))
                        out = pd.DataFrame({"bucket": (name.ravel().astype(np.int64) * tables + table) * 65536 + int(dim) % 65536})
                        if full:
                            row = np.repeat(np.arange(len(part)), tables)
                            own = [x.astype(name_kind).tobytes() for x in name]
                            out = out.assign(tab=table, entry=part["entry"].to_numpy()[row], many=part["many"].to_numpy()[row], vec=[raw[k] for k in row], name=[own[k] for k in row])
                        yield out

        return run

    # Buckets are named twice rather than stored: the names cost little, the rows are many.
    dealt = entries.select("entry", "many", "v").mapInPandas(deal(True), "bucket long, tab int, entry long, many long, vec binary, name binary")
    named_only = entries.select("entry", "many", "v").mapInPandas(deal(False), "bucket long")
    sizes = cut(named_only.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    parts = F.when(F.col("n") > 2 * block, F.ceil(F.col("n") / block)).otherwise(1).cast("int")
    # A large bucket is cut into parts by a hash of the entry; each two parts meet in one block.
    own = F.pmod(F.xxhash64("entry", F.lit(seed)), F.col("parts")).cast("int")
    met = dealt.join(sizes.select("bucket", parts.alias("parts")), "bucket").withColumn("own", own)
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select(F.when(F.col("parts") == 1, F.xxhash64("bucket")).otherwise(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))).alias("block"), F.when(F.col("own") == F.col("other"), 0).otherwise(F.when(F.col("own") < F.col("other"), 1).otherwise(2)).alias("side"), "tab", "entry", "many", "vec", "name")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(part: pd.DataFrame) -> list[pd.DataFrame]:
            out = []
            key = part["block"].to_numpy()
            edge = np.r_[0, np.nonzero(key[1:] != key[:-1])[0] + 1, len(key)]
            entry, many, side, tab = (part[c].to_numpy() for c in ("entry", "many", "side", "tab"))
            vec, name = part["vec"].to_list(), part["name"].to_list()
            for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if z - a > 1:
                    u = unit_rows(vec[a:z], kind)
                    m = np.frombuffer(b"".join(name[a:z]), name_kind).reshape(z - a, -1)
                    labels, n = compare(u, m, many[a:z], side[a:z], int(tab[a]), cosine)
                    some = np.nonzero((n > 0) | (labels != np.arange(z - a)))[0]
                    if len(some):
                        out.append(pd.DataFrame({"a": entry[a:z][some], "b": entry[a:z][labels[some]], "n": n[some]}))
            return out

        held: list[pd.DataFrame] = []
        for frame in frames:
            if frame.empty:
                continue
            last = frame["block"].iloc[-1]
            whole = int(np.searchsorted(frame["block"].to_numpy(), last))  # sorted: the last block may go on
            if whole:
                yield from one(pd.concat([*held, frame.iloc[:whole]]))
                held = []
            held.append(frame.iloc[whole:])
        if held:
            yield from one(pd.concat(held))

    found = written(met.repartition("block").sortWithinPartitions("block").mapInPandas(search, "a long, b long, n long"))
    direct = found.groupBy("a").agg(F.sum("n").alias("n"))
    joined = components(found.select("a", "b"))
    named = entries.select("key", "entry", "many").join(joined.withColumnRenamed("node", "entry"), "entry", "left").withColumn("root", F.coalesce("root", "entry"))
    named = named.join(direct.withColumnRenamed("a", "entry"), "entry", "left")
    heads = named.groupBy("root").agg(F.min("entry").alias("component_id"))
    by_key = cut(named.join(heads, "root").select("key", (F.col("many") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"))
    out = rows.select("vec_id", "key").join(by_key, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


#: All pairs, for small tables.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), r AS (
  SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.x = e.vec_id)::BIGINT AS n_links,
  least(e.vec_id, coalesce((SELECT min(y) FROM r WHERE r.x = e.vec_id), e.vec_id)) AS component_id,
  least(e.vec_id, coalesce((SELECT min(y) FROM r WHERE r.x = e.vec_id), e.vec_id)) = e.vec_id AS kept
FROM embeddings e
"""
