"""The corpus pipeline: five operators one after the other, each on all that the one before kept.

Documents of a language that none of the models knows go; of each near-duplicate class one document stays; documents
that hold test items go; secrets are masked in the texts that stay; those are packed into sequences. Every stage is
written as Parquet below ``spark.checkpoint.dir`` and read again as the next one's documents.

A document whose text is null or has no letter goes with the first stage. Repeated rows and exact copies are one class, of which
the row with the least doc_id stays (a null doc_id before all). Later stages find rows by doc_id and text, so repeated ones
share a decision. Other columns pass through the first four stages whatever their names are. Texts are worked on whole;
an empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from defectlake.llm.common import store
from defectlake.llm.decontaminate import contaminated
from defectlake.llm.language import of_known_language, train
from defectlake.llm.near_dup import id_key, without_copies
from defectlake.llm.packing import pack_documents
from defectlake.llm.secret_scan import redacted, scan_versions
from defectlake.scale import scratch_path


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows as one column, beside the keys by which a stage's decisions find them: no name of ``docs`` can clash."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    return docs.select(row, id_key(F.col("doc_id")).alias("__id"), F.xxhash64("text").alias("__hash"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the language models don't reject; ``lang`` stays as given."""
    return of_known_language(docs, train(docs))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class."""
    return without_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of ``benchmark``."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    held = store(found.select(id_key(F.col("doc_id")).alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "held")
    return _keyed(docs).join(held.hint("shuffle_hash"), ["__id", "__hash"], "left_anti").select("__row.*")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts; no document goes. n_chars follows the new text."""
    versions = docs.select(F.col("doc_id").alias("path"), F.xxhash64("text").alias("version"), "text")
    found = scan_versions(versions, scratch_path(spark, "blobs")).where(F.size("spans") > 0)
    spans = store(
        found.select(id_key(F.col("path")).alias("__id"), F.col("version").alias("__hash"), "spans")
        .dropDuplicates(["__id", "__hash"]),
        "spans",
    )
    found, row = F.col("spans"), F.col("__row")
    length = F.length("__text")
    new = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(found.isNull(), row["n_chars"]).otherwise(length.cast(kind))
    text = F.when(found.isNull(), row["text"]).otherwise(redacted(row["text"], found))
    masked = _keyed(docs).join(spans.hint("shuffle_hash"), ["__id", "__hash"], "left").withColumn("__text", text)
    return masked.select(*[new.get(c, row[c]).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the texts that are left and their places in packed sequences."""
    return pack_documents(docs)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: packing needs a tokenizer, and the language models and signatures are no SQL either
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
