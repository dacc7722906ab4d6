"""Operator 6: secret scans through an incremental ledger of content-addressed blobs.

Every version of every text is addressed by its SHA-256. Only pairs of blob and rule version that the ledger lacks are
scanned, each once however many paths hold it; the findings are then joined back to all paths. Ids and addresses are
shuffled, texts are not: of the paths that share a blob one is chosen, and its text is scanned where it is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, written

#: Version of every rule that has none of its own. Raise a rule's version with any change, so that known blobs are scanned again for it.
RULE_VERSION = 1
#: Blobs with several paths up to which the chosen paths are broadcast (about 700 bytes each in memory); above, Spark shuffles.
SHARED = 100_000

# The base rules, with the least length of what they match (of group 2 for assign).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a run after the first AKIA that is too short holds no longer one
HEX = re.compile(r"[0-9a-f]{16,}")
#: Further rules: private key blocks, signed web tokens, and tokens of a code host.
MORE = (
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----")),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("host", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
)
BASE = ("assign", "access", "hex")
KINDS = (*BASE, *(kind for kind, _ in MORE))

#: A ledger has a row for each scan of a blob: what was found by each rule, in the version then used.
LEDGER = "blob string, found array<struct<rule: string, version: int, spans: array<struct<start: int, end: int>>>>"
FINDINGS = ("blob", "rule_version", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def spans_of(text: str, kind: str) -> list[tuple[int, int]]:
    """(start, end) of the spans of one rule, in code points, in order."""
    if kind == "assign":
        return [m.span() for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    rule = ACCESS if kind == "access" else HEX if kind == "hex" else dict(MORE)[kind]
    return [m.span() for m in rule.finditer(text)]


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, order of the kind, end) of every span in a text, in code points, sorted."""
    return sorted((a, k, z) for k, kind in enumerate(KINDS) for a, z in spans_of(text, kind)) if text else []


def versions_of(rule_version: int | dict[str, int]) -> dict[str, int]:
    """The version of each rule: one for all, or by name, where rules that are not named have RULE_VERSION."""
    return {k: rule_version.get(k, RULE_VERSION) if isinstance(rule_version, dict) else rule_version for k in KINDS}


def scan_blobs(blobs: DataFrame, versions: dict[str, int]) -> DataFrame:
    """Ledger rows of (blob, text, rules): rules names those to be scanned for; see LEDGER."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([("blob", pa.string()), ("found", pa.list_(pa.struct([("rule", pa.string()), ("version", pa.int32()), ("spans", pa.list_(span))])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, rules in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                said = text.as_py() or ""
                found.append([{"rule": k, "version": versions[k], "spans": [{"start": a, "end": z} for a, z in spans_of(said, k)]} for k in rules])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, schema.field(1).type)], schema=schema)

    return blobs.select("blob", "text", "rules").mapInArrow(run, LEDGER)


def _chosen(addressed: DataFrame, path: str) -> DataFrame:
    """The rows of addressed that speak for their blob: of the paths that share one, that of least path; rows that tie stay."""
    several = cut(addressed.groupBy("blob").agg(F.count(F.lit(1)).alias("n"), F.min(path).alias("first")).where("n > 1").select("blob", "first", F.lit(True).alias("several")))
    several = F.broadcast(several) if several.count() <= SHARED else several
    return addressed.join(several, "blob", "left").where(F.col("several").isNull() | F.col(path).eqNullSafe(F.col("first"))).select("blob", "text")


def _summary(known: DataFrame, versions: dict[str, int]) -> DataFrame:
    """FINDINGS of (blob, found) rows."""
    order = F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)])
    each = F.flatten(F.transform("found", lambda r: F.transform(r["spans"], lambda s: F.struct(s["start"].alias("start"), order[r["rule"]].alias("kind"), s["end"].alias("end"), r["rule"].alias("rule")))))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    known = known.select("blob", F.array_sort(each).alias("all"))
    base = F.filter("all", lambda s: s["kind"] < len(BASE))
    number = lambda k: F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long")
    counts = [number(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return known.select("blob", F.lit(max(versions.values())).alias("rule_version"), *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("all")).alias("spans"))


def scan(versions: DataFrame, path: str = "doc_id", text: str = "text", ledger: str | None = None, rule_version: int | dict[str, int] = RULE_VERSION) -> DataFrame:
    """Findings of every row of versions: its path column, then those of FINDINGS.

    ledger: a folder (any store that Spark writes) with the findings of earlier calls; it gets those of pairs of blob
    and rule version that it lacks, and no others are scanned; scans at the same time may add a pair twice, which counts
    once. With none, the ledger of this call is a table in the shared folder. rule_version: of all rules, or by rule; the
    column rule_version has the greatest. A null text counts as empty. Repeated rows, null paths and empty tables are kept
    as they are; other columns are ignored; spans at one start are in the order of KINDS. A blob that a third of all rows
    share is counted before the shuffle and scanned once; the join back is one that Spark can split. Texts of any length
    are scanned whole.
    """
    spark = versions.sparkSession
    wanted = versions_of(rule_version)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    addressed = versions.select(F.col(path), body.alias("text")).withColumn("blob", F.sha2("text", 256))
    rules = F.array(*[F.lit(k) for k in KINDS])
    blobs = _chosen(addressed, path)
    if ledger is None:
        known = written(scan_blobs(blobs.withColumn("rules", rules), wanted)).dropDuplicates(["blob"])
    else:
        version = F.create_map(*[F.lit(x) for k, v in wanted.items() for x in (k, v)])
        try:
            seen = spark.read.schema(LEDGER).parquet(ledger).select("blob", F.explode("found").alias("f")).where(F.col("f.version") == version[F.col("f.rule")])
            seen = seen.groupBy("blob").agg(F.collect_set("f.rule").alias("have"))  # at most the rules
            blobs = blobs.join(seen, "blob", "left").select("blob", "text", F.when(F.col("have").isNull(), rules).otherwise(F.array_except(rules, "have")).alias("rules")).where(F.size("rules") > 0)
        except AnalysisException:  # there is no ledger yet
            blobs = blobs.withColumn("rules", rules)
        scan_blobs(blobs, wanted).write.mode("append").parquet(ledger)
        each = spark.read.schema(LEDGER).parquet(ledger).select("blob", F.explode("found").alias("f")).where(F.col("f.version") == version[F.col("f.rule")])
        known = each.select("blob", F.col("f.rule").alias("rule"), "f").dropDuplicates(["blob", "rule"]).groupBy("blob").agg(F.collect_list("f").alias("found"))  # one for each rule
    return addressed.select(path, "blob").join(_summary(known, wanted), "blob").select(path, *FINDINGS)
