"""Secret scan with an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed by the SHA-256 of its text. The ledger below a shared
folder holds, per blob, the (rule, version) pairs that have been applied to it and the spans found. A scan
applies to a blob only the pairs that the ledger lacks, once however many paths hold the blob,
appends the outcome, and joins the ledger's findings back to all paths. Raising a rule's version makes
just that rule run again over all blobs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from defectlake.llm.common import documents, store
from defectlake.llm.spans import SPAN, Kind, kind_spans, listed, masked, no_spans, of_kinds
from defectlake.scale import scratch_path

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{%s})"""

#: The base rules, in the order that sorts spans of equal start, then further rules.
#: A repeated class is written with the length that a kept match must have where that finds the same spans.
BASE = ("assign", "access", "hex")
RULES = (
    Kind("assign", _ASSIGN % "1,", _ASSIGN % "6,", lambda m: F.length(F.regexp_extract(m, _ASSIGN % "1,", 2)) >= 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}", r"AKIA[A-Z0-9]{16,}"),
    Kind("hex", r"[0-9a-f]{24,}", r"[0-9a-f]{24,}"),
    Kind("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Kind("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ"),
)

LEDGER = f"blob binary, applied array<string>, spans array<{SPAN}>"


def rule_key(rule: Kind) -> str:
    return f"{rule.name}@{rule.version}"


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/ledger")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(LEDGER).parquet(f"{folder}/ledger") if there else spark.createDataFrame([], LEDGER)


def scan_versions(versions: DataFrame, folder: str, rules: Sequence[Kind] = RULES) -> DataFrame:
    """Findings of each row of ``versions`` (path, version, text), using and extending the ledger in ``folder``.

    Returns path, version, blob and spans (sorted; empty if nothing was found), a row per given row. A null
    text counts as empty. Null paths and versions and repeated rows are kept. Other columns are not read.
    """
    spark = versions.sparkSession
    whole = versions.select("path", "version", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = whole.withColumn("blob", F.unhex(F.sha2("text", 256)))
    catalogue = store(whole.select("path", "version", "blob"), "catalogue")

    keys = F.array(*[F.lit(rule_key(r)) for r in rules])
    applied = (
        _ledger(spark, folder)
        .select("blob", F.explode("applied").alias("rule"))
        .where(F.col("rule").isin([rule_key(r) for r in rules]))
        .groupBy("blob")
        .agg(F.collect_set("rule").alias("applied"))
    )
    pending = (
        catalogue.groupBy("blob")
        .agg(F.min(F.struct("path", "version")).alias("at"))
        .join(applied, "blob", "left")
        .select(
            "blob", F.col("at.path").alias("at_path"), F.col("at.version").alias("at_version"),
            F.array_except(keys, F.coalesce("applied", F.array().cast("array<string>"))).alias("todo"),
        )
        .where(F.size("todo") > 0)
    )
    # one holder of each blob is read; the narrow side is the one kept in memory
    once = whole.join(
        pending.withColumnRenamed("blob", "pending").hint("shuffle_hash"),
        (F.col("blob") == F.col("pending"))
        & F.col("path").eqNullSafe(F.col("at_path"))
        & F.col("version").eqNullSafe(F.col("at_version")),
    )
    spans = [
        F.when(F.array_contains("todo", rule_key(rule)), kind_spans(F.col("text"), rule, i)).otherwise(no_spans())
        for i, rule in enumerate(rules)
    ]
    once.select("blob", F.col("todo").alias("applied"), F.concat(*spans).alias("spans")).write.mode("append").parquet(
        f"{folder}/ledger"
    )

    # a span belongs to the rule versions asked for if its blob's row lists them
    current = F.array(*[F.lit(rule_key(r)) for r in rules])
    names = F.transform(F.array_intersect("applied", current), lambda k: F.split_part(k, F.lit("@"), F.lit(1)))
    findings = store(
        _ledger(spark, folder)
        .select("blob", F.explode(F.filter("spans", lambda s: F.array_contains(names, s["kind"]))).alias("span"))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_set("span")).alias("spans")),
        "findings",
    )
    return catalogue.join(findings, "blob", "left").select(
        "path", "version", "blob", F.coalesce("spans", no_spans()).alias("spans")
    )


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with its secrets replaced by ``[SECRET:kind]``."""
    return masked(text, spans, lambda s: F.concat(F.lit("[SECRET:"), s["kind"], F.lit("]")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = documents(spark, sf_dir).select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), "text")
    found = scan_versions(versions, scratch_path(spark, "blobs"))
    counts = [F.size(of_kinds(F.col("spans"), [k])).cast("bigint").alias(f"n_{k}") for k in BASE]
    return found.select(
        F.col("path").alias("doc_id"),
        *counts,
        F.sha2(listed(of_kinds(F.col("spans"), list(BASE))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def _sql_spans(text: str, kind: str, order: int, pattern: str, keep: str = "true") -> str:
    """SQL list of the spans of one kind; ``keep`` tests the match m."""
    quoted = pattern.replace("'", "''")
    found = f"regexp_extract_all({text}, '{quoted}', 0)"
    gaps = f"string_split_regex({text}, '{quoted}')"
    before = (
        f"(list_sum(list_transform({gaps}[1:i], lambda x: length(x)))"
        f" + coalesce(list_sum(list_transform({found}[1:i - 1], lambda x: length(x))), 0))::BIGINT"
    )
    return (
        f"list_filter(list_transform({found}, lambda m, i: {{'start': {before}, 'ord': {order}, 'end': {before} + length(m),"
        f" 'kind': '{kind}', 'ok': {keep}}}), lambda s: s.ok)"
    )


def _sql_listed(spans: str) -> str:
    return (
        f"array_to_string(list_transform(list_sort({spans}), lambda s: s.kind || ':' || s.\"start\" || ':' || s.\"end\"), ',')"
    )


def _oracle() -> str:
    assign = _ASSIGN % "1,"
    keep = {"assign": "length(regexp_extract(m, '{}', 2)) >= 6".format(assign.replace("'", "''"))}
    lists = [_sql_spans("t", r.name, i, r.pattern, keep.get(r.name, "true")) for i, r in enumerate(RULES)]
    base = [f"list_filter(found, lambda x: x.kind = '{k}')" for k in BASE]
    counts = ", ".join(f"len({b})::BIGINT AS n_{k}" for b, k in zip(base, BASE))
    return f"""
SELECT doc_id, {counts},
       sha256({_sql_listed("list_filter(found, lambda x: x.ord < 3)")}) AS base_sha256,
       {_sql_listed("found")} AS spans
FROM (SELECT doc_id, {" || ".join(lists)} AS found FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
"""


QUERIES = {"op2_secret_scan": op2_secret_scan}
ORACLE_SQL = {"op2_secret_scan": _oracle()}
