"""Stored scans, recordings, role summaries and source corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from defectlake import dims, schemas


def read_scans(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Scan documents from parquet, JSON lines (``json``) or one JSON document per file
    (``json-documents``)."""
    reader = spark.read.schema(schemas.SCAN_DDL)
    if fmt == "parquet":
        return reader.parquet(path)
    if fmt == "json":
        return reader.json(path)
    if fmt == "json-documents":
        return reader.option("multiLine", True).json(path)
    raise ValueError(f"unknown scan format {fmt!r}")


def load_scan(scans: DataFrame, scan_id: str) -> DataFrame:
    """The scan with this id, else the first whose id starts with it."""
    near = scans.where(F.col("scan_id").startswith(scan_id))
    # the exact id sorts before every longer id with the same prefix
    chosen = near.agg(F.min("scan_id").alias("scan_id"))
    return near.join(F.broadcast(chosen), "scan_id", "left_semi")


def scan_findings(scans: DataFrame) -> DataFrame:
    """Findings of stored scans, one row each."""
    return scans.select("scan_id", F.explode("errors").alias("e")).select("scan_id", "e.*")


def read_role_summaries(documents: DataFrame) -> DataFrame:
    """Role summaries from ``{"hints": {name: [...]}}`` documents in column ``value``."""
    hint = "STRUCT<name: STRING, role: STRING, target: STRING, validated: BOOLEAN, confidence: DOUBLE>"
    doc = F.from_json("value", f"STRUCT<hints: MAP<STRING, ARRAY<{hint}>>>")
    return (
        documents.select(F.explode(doc["hints"]).alias("key", "items"))
        .select("key", F.explode("items").alias("h"))
        .select(
            F.coalesce("h.name", "key").alias("name"),
            F.when(F.col("h.role") == "Allocator", F.lit("Allocator"))
            .otherwise(F.lit("Deallocator"))
            .alias("role"),
            F.col("h.target").alias("target"),
            F.coalesce("h.validated", F.lit(True)).alias("validated"),
            F.coalesce("h.confidence", F.lit(0.7)).alias("confidence"),
        )
    )


RECORDING_DDL = (
    "recording_id STRING, binary STRING, args ARRAY<STRING>, duration_ms BIGINT, exit_code INT, "
    "events BIGINT, tool STRING, size_mb DOUBLE"
)


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """Recording metadata documents; unreadable ones are skipped."""
    raw = (
        spark.read.schema(RECORDING_DDL)
        .option("multiLine", True)
        .option("mode", "DROPMALFORMED")
        .option("recursiveFileLookup", True)
        .json(path)
        .withColumn("path", F.col("_metadata.file_path"))
    )
    return list_recordings(raw)


def list_recordings(meta: DataFrame) -> DataFrame:
    """Fill defaults and sort by recording id, newest id first."""
    folder = (
        F.element_at(F.split("path", "/"), -2) if "path" in meta.columns else F.lit(None).cast("string")
    )
    zero = F.lit(0)
    return meta.select(
        F.coalesce("recording_id", folder).alias("recording_id"),
        F.coalesce("binary", F.lit("??")).alias("binary"),
        F.coalesce("args", F.array().cast("array<string>")).alias("args"),
        F.coalesce("duration_ms", zero).alias("duration_ms"),
        F.coalesce("exit_code", zero).alias("exit_code"),
        F.coalesce("events", zero).alias("events"),
        F.coalesce("tool", F.lit("??")).alias("tool"),
        F.coalesce("size_mb", F.lit(0.0)).alias("size_mb"),
    ).orderBy(F.desc("recording_id"))


def read_source_corpus(
    spark: SparkSession, path: str, corpus_id: str, skip_dirs=dims.TAINT_SKIP_DIRS
) -> DataFrame:
    """C and C++ sources below ``path`` as (corpus_id, path, text), skipped folders left out."""
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("wholetext", True)
        .text(path)
        .select(F.lit(corpus_id).alias("corpus_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )
    root = path.rstrip("/") + "/"
    relative = F.regexp_replace("path", r"^(?:file:)?/*" + "".join("\\" + c if not c.isalnum() and c not in "_/" else c for c in root.lstrip("/")), "")
    return select_sources(files.withColumn("path", relative), skip_dirs)


def select_sources(files: DataFrame, skip_dirs=dims.TAINT_SKIP_DIRS) -> DataFrame:
    """Keep ``*.c *.cpp *.cc *.h`` outside skipped folders (the file's own name may match)."""
    folders = F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    skipped = F.arrays_overlap(folders, F.array(*[F.lit(x) for x in skip_dirs]))
    return files.where(F.col("path").rlike(r"\.(?:c|cpp|cc|h)$") & ~skipped)
