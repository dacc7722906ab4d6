"""Operator 4: deletion of repeated line runs by a distributed suffix array.

Lines that are not blank become ids. Prefix doubling ranks the suffixes of all documents' id sequences: from ranks to
depth h, the pair of a suffix's rank and that of the suffix h lines on gives ranks to depth 2 h. A suffix that shares
its rank with no other is settled and takes no further part. Suffixes of equal rank to the depth of the shortest run
form an interval of the suffix array whose longest common prefix is at least that run; in each, all but the first in
document order are later copies. Windows of later copies that touch make up the maximal repeated runs, which go.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, written

#: Lines in the shortest run that counts as repeated.
RUN = 2
BLANK = "\\A[\\x20\\x09-\\x0D]*\\z"


def _ranked(classes: DataFrame, by: list[str]) -> DataFrame:
    """Rank distinct rows in the order of `by`: range partitions are sorted, and each starts where those before it end."""
    sorted_ = cut(classes.repartitionByRange(*by).sortWithinPartitions(*by))
    numbered = sorted_.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = {r["part"]: r["n"] for r in numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each partition
    starts, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(part, 0)
    return numbered.withColumn("rank", F.array(*[F.lit(x).cast("long") for x in starts or [0]])[F.col("part")] + F.col("at")).drop("part", "at")


def _rows(docs: DataFrame, rest: tuple[str, ...] = ()) -> DataFrame:
    """Every row with its key: the id and a hash of the text, so that repeated rows are one document; other columns in one, rest."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), *[F.struct(*rest).alias("rest")] * bool(rest)).withColumn("mark", F.xxhash64("text"))


def _number(lines: Column) -> Column:
    """Lines that are not blank, with their places among all lines."""
    return F.filter(F.transform(lines, lambda x, k: F.struct(k.alias("pos"), x.alias("line"))), lambda s: ~s["line"].rlike(BLANK))


def later_copies(docs: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """(doc_id, mark, low, high): the lines numbered low to high - 1 among the document's not blank ones are a later copy of a run, or of a line of so many words."""
    rows = _rows(docs).where("doc_id IS NOT NULL")
    lines = rows.select("doc_id", "mark", F.posexplode(_number(F.split("text", "\n", -1))).alias("i", "s"))
    lines = lines.select("doc_id", "mark", "i", F.xxhash64("s.line").alias("h1"), F.xxhash64(F.lit("line"), "s.line").alias("h2"), *[(F.regexp_count("s.line", F.lit("[^\\x20\\x09-\\x0D]+")) >= words).alias("wide")] * (words is not None)).distinct()
    lines = written(lines)
    classes = _ranked(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2"), ["h1", "h2"])
    live = written(lines.join(classes, ["h1", "h2"]).select("doc_id", "mark", "i", "rank", *["wide"] * (words is not None)))
    place = F.struct("doc_id", "mark", "i")
    alone = None
    if words is not None and run > 1:
        wide = live.where("wide")
        first = cut(wide.groupBy("rank").agg(F.min(place).alias("first")))
        alone = wide.join(first, "rank").where(place > F.col("first")).select("doc_id", "mark", F.col("i").alias("low"), (F.col("i") + 1).alias("high"))
    depth = 1
    while depth < run:
        by = min(depth, run - depth)
        after = live.select("doc_id", "mark", (F.col("i") - by).alias("i"), F.col("rank").alias("next"))
        pairs = written(live.join(after, ["doc_id", "mark", "i"]))
        classes = _ranked(pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("rank").alias("r1"), F.col("next").alias("r2")), ["r1", "r2"])
        live = written(pairs.withColumnsRenamed({"rank": "r1", "next": "r2"}).join(classes, ["r1", "r2"]).select("doc_id", "mark", "i", "rank"))
        depth += by
    first = cut(live.groupBy("rank").agg(F.min(place).alias("first")))  # cut, so that the join may split a frequent run
    copies = live.join(first, "rank").where(place > F.col("first")).select("doc_id", "mark", F.col("i").alias("low"), (F.col("i") + run).alias("high"))
    return copies if alone is None else copies.unionByName(alone)


def remove_line_runs(docs: DataFrame, run: int = RUN, rest: tuple[str, ...] = (), words: int | None = None) -> DataFrame:
    """(doc_id, text, n_lines, n_removed[, rest]) for every row of docs: text without later copies of runs of `run` lines or more.

    With `words`, a later copy of a single line of at least so many words goes too.
    The first copy is that of the least doc_id, then of the earliest line; runs may overlap. Lines are split at \\n; blank
    ones belong to no run and stay, but a text none of whose other lines is left becomes empty. n_lines and n_removed
    count lines that are not blank. A null text counts as empty; rows that repeat a doc_id and text are one document; a
    row with a null doc_id is left as it is. The columns named in rest come back in a struct of that name, others are
    ignored; an empty table gives an empty result.
    """
    spans = later_copies(docs, run, words).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("low", "high")).alias("spans"))  # at most the lines of one document
    joined = _rows(docs, rest).join(spans, ["doc_id", "mark"], "left").select("doc_id", "text", "spans", *["rest"] * bool(rest))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = set(" \t\n\x0b\x0c\r")
        for batch in batches:
            texts, total, gone = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = text.split("\n")
                full = [k for k, x in enumerate(lines) if set(x) - blank]
                drop = {full[k] for s in spans or () for k in range(s["low"], min(s["high"], len(full)))}
                left = [x for k, x in enumerate(lines) if k not in drop]
                texts.append("\n".join(left) if len(drop) < len(full) or not drop else "")
                total.append(len(full))
                gone.append(len(drop))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), *batch.columns[3:]], names=["doc_id", "text", "n_lines", "n_removed"] + ["rest"] * bool(rest))

    kinds = "doc_id long, text string, n_lines long, n_removed long" + (f", rest {joined.schema['rest'].dataType.simpleString()}" if rest else "")
    return joined.mapInArrow(cut_out, kinds)


#: The same for runs of two lines.
ORACLE = """
WITH l AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
), f AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), w AS (SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM f
), c AS (SELECT doc_id, i, row_number() OVER (PARTITION BY line, following ORDER BY doc_id, i) AS copy FROM w WHERE following IS NOT NULL
), d AS (SELECT doc_id, i FROM c WHERE copy > 1 UNION SELECT doc_id, i + 1 FROM c WHERE copy > 1
), k AS (
  SELECT l.doc_id, l.pos, l.line, f.i IS NOT NULL AS filled, d.i IS NOT NULL AS gone
  FROM l LEFT JOIN f USING (doc_id, pos) LEFT JOIN d ON d.doc_id = f.doc_id AND d.i = f.i
), s AS (
  SELECT doc_id, count(*) FILTER (filled) AS n_lines, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM k GROUP BY doc_id
)
SELECT doc_id, n_lines, n_removed, sha256(CASE WHEN n_removed > 0 AND n_removed = n_lines THEN '' ELSE kept END) AS kept_sha256 FROM s
"""
