"""Fill-in-the-middle against a row-by-row version with regular expressions."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from defectlake.llm import fill_middle as M

ROWS = [
    (1, "def f(x):\n    return x + 1\n"), (2, None), (3, ""), (4, "   "), (5, " \t\n"), (6, "Grüße an 日本 🎉🎉 é"), (7, "é"),
    (8, "has <P> in it " * 9), (9, "<S>"), (10, "a <M"), (11, "word " * 5000), (None, "no id at all"), (12, "same"), (12, "same"),
    (13, "nbsp is no space here \x0b\x0c x"), (14, "x" * 40000), (-3, "🎉 " * 300), (15, "\n\nab\n"), (16, "<<P"),
    *[(100 + i, f"text {i} über drei\nZeilen " * (i % 7)) for i in range(120)],
]
TOKEN = re.compile("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def direct(doc_id, text, unit="token"):
    text = text or ""
    tokens = list(text) if unit == "character" else TOKEN.findall(text)
    assert "".join(tokens) == text
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", text, None, None, None
    spm = h4 % 100 < 80
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, "spm" if spm else "psm", output, len(prefix), len(middle), len(suffix)


@pytest.mark.parametrize("unit", ["token", "character"])
def test_equals_direct(spark, unit):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in ROWS], "doc_id bigint, text string, form string, n int")
    rows = M.fill_in_middle(docs, unit=unit)
    assert sorted(map(tuple, rows.collect()), key=str) == sorted((direct(*r, unit) for r in ROWS), key=str)
    back = rows.select("doc_id", M.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((i, t or "") for i, t in ROWS), key=str)
    assert {"plain", "psm", "spm"} == {r.form for r in rows.select("form").distinct().collect()}


def test_slices_do_not_matter(spark, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in ROWS]), pa.array([r[1] for r in ROWS])], ["doc_id", "text"])
    run = M._arrange(42, 50, 80, M.SENTINELS, "token")
    whole = pa.Table.from_batches(run(iter([batch]))).to_pylist()
    parts = [batch.slice(i, 7) for i in range(0, batch.num_rows, 7)]
    assert pa.Table.from_batches(run(iter(parts))).to_pylist() == whole
    assert [tuple(r.values()) for r in whole] == [direct(*r) for r in ROWS]


def test_empty_table(spark):
    assert M.fill_in_middle(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_exception_index():
    text = "aé日🎉b" * 50 + "plain" + "é" * 20
    index = M.ExceptionIndex(np.frombuffer(text.encode(), np.uint8))
    assert len(index.begins) == sum(ord(c) > 127 for c in text)
    points = np.arange(len(text) + 1)
    places = np.array([len(text[:i].encode()) for i in points.tolist()])
    assert index.to_bytes(points).tolist() == places.tolist()
    assert index.to_points(places).tolist() == points.tolist()
