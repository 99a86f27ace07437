"""Spans of disclosing terms against counts over all documents, and what the size of a corpus changes."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import pytest
import regex
from pyspark.sql import functions as F

from defectlake.llm import privacy

DATA = Path("/root/testdata/sf0.001/documents.parquet")


def _brute_force(texts: list[str], spans: list[list]) -> list[set]:
    """Term spans of each text, given the identifiers' spans."""
    terms, entities, blanked = [], [], []
    for text, found in zip(texts, spans):
        letters = list(text)
        held = set()
        for s in found:
            value = text[s.start : s.end]
            held.add((s.kind, value.lower() if s.kind == "email" else regex.sub("[^0-9]", "", value)))
            letters[s.start : s.end] = " " * (s.end - s.start)
        blanked.append("".join(letters))
        entities.append(held)
        terms.append({w.lower() for w in regex.findall(r"\p{L}+", blanked[-1]) if len(w) >= privacy.TERM_LETTERS})
    n_term, n_entity, n_both = Counter(), Counter(), Counter()
    for words, held in zip(terms, entities):
        n_term.update(words)
        n_entity.update(held)
        n_both.update((e, t) for e in held for t in words)
    worst: dict[str, float] = {}
    for (e, t), n in n_both.items():
        given, prior = n / (n_term[t] + privacy.SMOOTHING), min(n_entity[e] / len(texts), 0.5)
        if n >= privacy.LIKELY_FROM * n_term[t]:
            worst[t] = max(worst.get(t, -9.0), math.log(given / prior) / -math.log(prior))
    worst = {t: d for t, d in worst.items() if d >= privacy.GENERALISE_FROM}
    return [
        {
            (m.start(), m.end(), "term_removed" if worst[m[0].lower()] >= privacy.REMOVE_FROM else "term")
            for m in regex.finditer(r"\p{L}{4,}", text) if m[0].lower() in worst
        }
        for text in blanked
    ]


@pytest.mark.parametrize("sent", [privacy.SENT_PAIRS, 0])
def test_term_spans_equal_counts_over_all_documents(spark, monkeypatch, sent):
    monkeypatch.setattr(privacy, "SENT_PAIRS", sent)
    planted = [f"Mrs Quillfeather called +1 555 123 456{int(i > 4)} about Thornbury again" for i in range(6)]
    docs = spark.read.parquet(str(DATA)).select("doc_id", "text").unionByName(
        spark.createDataFrame([(10**6 + i, t) for i, t in enumerate([*planted, None, "", "Quillfeather", "Thornbury " * 3])], "doc_id bigint, text string")
    )
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    told = {r.doc_id: r.spans for r in privacy.sanitise(docs, everywhere=True).collect()}
    base = [[s for s in told[r.doc_id] if not s.kind.startswith("term")] for r in rows]
    want = _brute_force([r.text for r in rows], base)
    for row, spans in zip(rows, want):
        assert {(s.start, s.end, s.kind) for s in told[row.doc_id] if s.kind.startswith("term")} == spans
    assert told[10**6 + 8] and sum(map(len, want)) > 10


@pytest.mark.parametrize("size", [100, 3000])
def test_marks_do_not_depend_on_the_size_of_the_corpus(spark, size):
    rows = [(i, "Marigold Featherstone writes from me@example.org today") for i in range(4)]
    # one of four documents with the word holds the address
    rows += [(10, "a harmless lanternfish and me@example.org")] + [(11 + i, "one more lanternfish swims") for i in range(3)]
    rows += [(100 + i, "today a harmless note writes itself from nothing and swims away once more") for i in range(size)]
    told = {r.doc_id: r.sanitised for r in privacy.sanitise(spark.createDataFrame(rows, "doc_id bigint, text string"), everywhere=True).collect()}
    assert all("Featherstone" not in told[i] and "Marigold" not in told[i] for i in range(4))
    assert "lanternfish" in told[10] and told[11] == "one more lanternfish swims"
    assert all(told[i] == t for i, t in rows if i >= 11)


def test_what_is_sent_does_not_grow_with_the_pairs(spark, monkeypatch):
    """Bits of hashes are sent in place of pairs: no key is lost, and few others are kept."""
    monkeypatch.setattr(privacy, "WORDS", 64)
    key = F.xxhash64("id").alias("text_hash")
    right = spark.range(0, 400).select(key)
    met = privacy._may_meet(spark.range(0, 4000).select("id", key), right, "text_hash")
    assert met.where("id < 400 and not may").count() == 0 and met.count() == 4000
    kept = met.where("may").count()
    assert 400 < kept < 400 + 3600 * 0.2
    assert privacy._near(spark.range(0, 4000).select("id", key), right, "text_hash").count() == kept
    monkeypatch.setattr(privacy, "SENT_PAIRS", 0)
    sent, run = [], F.broadcast
    monkeypatch.setattr(privacy.F, "broadcast", lambda df: sent.append(df.count()) or run(df))
    docs = spark.createDataFrame([(i, f"mail a{i}@b.org word{i * 7:c}zorb blatt{i}") for i in range(60, 160)], "doc_id bigint, text string")
    out = privacy.sanitise(docs, everywhere=True, likely_from=0.1, generalise_from=0.1)
    assert out.count() == 100 and sent and max(sent) <= 64
