"""Automaton counts against greedy matching that cuts the pieces."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from defectlake.llm import token_counts as t


def _greedy(word, first, later):
    count, at, pieces = 0, 0, first
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        count, at, pieces = count + 1, end, later
    return count


def _count(machine, words):
    data = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    return machine.count(data, np.cumsum(lengths) - lengths, lengths).tolist()


def test_pieces_longer_than_a_small_number():
    pieces = {b"a", b"c", b"a" * 300 + b"b", b"a" * 900 + b"d"}
    words = [b"a" * 300 + b"c", b"a" * 300 + b"b", b"a" * 900 + b"c", b"a" * 900 + b"d", b"b", b""]
    machine = t.Automaton(pieces, pieces)
    assert _count(machine, words) == [301, 1, 901, 1, 1, 0]
    small = t.Automaton({b"ab", b"a"}, {b"b"})
    assert small.given.dtype == np.uint8


@pytest.mark.parametrize("seed", range(12))
def test_random_vocabularies(seed):
    rng = random.Random(seed)
    piece = lambda n: bytes(rng.choice(b"abc") for _ in range(rng.randint(1, n)))
    first, later = ({piece(5) for _ in range(rng.randint(1, 25))} for _ in range(2))
    words = [piece(14) for _ in range(400)]
    assert _count(t.Automaton(first, later), words) == [_greedy(w, first, later) for w in words]
    assert _count(t.Automaton(first, first), words) == [_greedy(w, first, first) for w in words]


def test_known_vocabulary(spark):
    pieces = set(t.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    texts = ["The cat sat", None, "", "  \n ", "Élan über 日本語 🎉", "x" * 3000 + " y", "a  b\tc\n", "tokenisation,counts."]
    docs = spark.createDataFrame([(i, x, 0) for i, x in enumerate(texts)], "doc_id bigint, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in t.count_tokens(docs).collect()}
    assert got == {i: sum(_greedy(b" " + w.encode(), pieces, pieces) for w in (x or "").split()) for i, x in enumerate(texts)}
    assert t.count_tokens(docs.limit(0)).count() == 0


def test_whole_documents(spark, sf_dir):
    pieces = set(t.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = t.count_tokens(docs).groupBy().agg(F.sum("n_tokens")).first()[0]
    known: dict = {}
    total = 0
    for row in docs.collect():
        for word in row.text.split():
            if word not in known:
                known[word] = _greedy(b" " + word.encode(), pieces, pieces)
            total += known[word]
    assert got == total
