"""The stages, one by one, on planted rows."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from defectlake.llm.common import store


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Rows after each stage, from the given documents with some planted ones."""
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    first = given.orderBy("doc_id").first()
    clean = "the and of that with this from " * 3
    rows = [
        (900001, first.text, first.lang, "planted", 0), (900002, None, None, None, None), (900003, "", "en", "x", 0),
        (900004, f"{clean} {item} {clean}", "en", "x", 0), (900005, "so the token = 'abcdef123456' and was with that here", "en", "x", 0),
        (None, "that and the with of thing from here", None, None, None), (900006, "12345 !!", "en", "x", 8),
    ]
    docs = given.unionByName(spark.createDataFrame(rows, given.schema))
    done = [docs]
    for name, stage in corpus_pipeline.STAGES:
        done.append(store(stage(spark, done[-1], sf_dir), name))
    return done


def _ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_each_stage_acts(stages):
    docs, language, single, clean, masked, packed = stages
    for before, after in zip(stages[:-2], stages[1:-1]):
        assert after.columns == docs.columns
        assert _ids(after) <= _ids(before)
    assert _ids(docs) - _ids(language) >= {900002, 900003, 900006} and None in _ids(language)
    assert language.count() >= 0.98 * docs.count() - 3
    assert 900001 in _ids(language) - _ids(single)
    assert 900004 in _ids(single) - _ids(clean)
    assert _ids(masked) == _ids(clean)
    row = masked.where("doc_id = 900005").first()
    assert "abcdef123456" not in row.text and "[SECRET:assign]" in row.text and row.n_chars == len(row.text)
    assert _ids(packed) == _ids(masked)
    untouched = masked.join(clean, ["doc_id", "text", "n_chars"]).count()
    assert untouched >= 0.9 * clean.count()


def test_stage_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_repeated_rows_long_texts_and_extra_columns(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    long = given.limit(1).select(
        F.lit(700001).cast("bigint").alias("doc_id"), F.repeat(F.lit("that the long text of this and more with "), 20_000).alias("text"),
        "lang", "source", F.lit(820_000).cast("bigint").alias("n_chars"),
    )
    names = ("words", "node", "spans", "score", "start", "part", "n", "label")
    docs = given.unionByName(given).unionByName(long).select("*", *[F.lit(i).alias(name) for i, name in enumerate(names)])
    stage_of = dict(corpus_pipeline.STAGES)
    language = store(stage_of["language"](spark, docs, sf_dir), "language")
    assert language.columns == docs.columns and language.where("doc_id = 700001").count() == 1
    single = store(stage_of["near_duplicates"](spark, language, sf_dir), "single")
    ids = [r.doc_id for r in single.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 700001 in ids and single.columns == docs.columns
    clean = store(stage_of["decontamination"](spark, single, sf_dir), "clean")
    masked = store(stage_of["secrets"](spark, clean, sf_dir), "masked")
    assert masked.columns == docs.columns and _ids(masked) == _ids(clean) and 700001 in _ids(masked)
    assert masked.select(*names).distinct().collect()[0] == tuple(range(len(names)))
    packed = stage_of["packing"](spark, masked, sf_dir)
    assert _ids(packed) == _ids(masked) and packed.where("doc_id = 700001").count() > 100
