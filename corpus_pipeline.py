"""A training corpus from `documents`: five stages, each by one operator of framewright.llm.

Documents of no known language go; later copies of line runs are deleted; one document of each group of near duplicates
stays, that of least doc_id (by fingerprints or by five-word shingles); documents with near copies of benchmark items
go; what is left is encoded, and decoded to prove it. Each stage takes the documents that its predecessor kept, with the
columns of `documents`; n_chars follows the text. From the third stage on, rows that repeat a doc_id and text are one
document, and other texts of that doc_id are others. Rows without a doc_id have no place in the order: no line of theirs
is a copy, and none of them goes as a near duplicate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.bpe import encode_documents
from framewright.llm.common import table, written
from framewright.llm.copies import near_copies
from framewright.llm.decontaminate import clean
from framewright.llm.language import accepted
from framewright.llm.lines import remove_line_runs
from framewright.llm.simhash import first_documents, near_duplicates

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a line that is a passage by itself, so that its later copies go without a second line.
LINE_WORDS = 50


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents whose text is not rejected; a null text or one without a letter is. The models learn from those that are not held out."""
    return accepted(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: all documents, without later copies of line runs and of single lines of 50 words or more; a document of copies alone keeps an empty text."""
    done = remove_line_runs(docs, rest=("lang", "source", "n_chars"), words=LINE_WORDS)
    size = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("rest.n_chars"))
    return done.select("doc_id", "text", "rest.lang", "rest.source", size.cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10, and near copies of five-word shingles from a similarity of 0.8 on: one document of each group that both link."""
    groups = written(near_duplicates(docs, also=near_copies(docs), with_mark=True))
    return first_documents(docs, groups).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents without a near copy of a benchmark item."""
    return clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: token ids of each document with their number and digests; a null text has none."""
    return encode_documents(docs, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: SQL has no way to say the models, fingerprints and encoding; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
