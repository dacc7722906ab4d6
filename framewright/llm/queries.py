"""One query for each operator of this subpackage, over its whole table, with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_documents
from .common import table
from .decontaminate import leaks
from .embeddings import ORACLE as VECTORS_SQL
from .embeddings import near_duplicates as near_vectors
from .html import extract
from .language import identify
from .lines import ORACLE as LINES_SQL
from .lines import remove_line_runs
from .secrets import scan
from .simhash import near_duplicates
from .substring import ORACLE as WINDOWS_SQL
from .substring import remove_repeated
from .tokens import count_tokens

SQL: dict[str, str] = {"op1_substring_dedup": WINDOWS_SQL, "op4_line_dedup": LINES_SQL, "op7_embedding_near_dedup": VECTORS_SQL}


def op8_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes, per document."""
    return encode_documents(table(spark, sf_dir, "documents"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by a ledger of distinct texts."""
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "blob", "rule_version")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeated windows of 20 words leave."""
    return remove_repeated(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by models of documents that are not held out."""
    return identify(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, those removed as later copies, and a digest of the text that is left."""
    found = remove_line_runs(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they hold near copies of."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector, whatever its label."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, before and after its secrets are redacted."""
    return count_tokens(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op2_token_counts": op2_token_counts,
    "op9_html_extraction": op9_html_extraction,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op3_language_id": op3_language_id,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontamination": op5_decontamination,
    "op1_substring_dedup": op1_substring_dedup,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op6_secret_scans": op6_secret_scans,
    "op8_bpe_encoding": op8_bpe_encoding,
}
