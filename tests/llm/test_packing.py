"""Packing and record output against direct encoding of every text."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from defectlake.llm import packing, records
from defectlake.llm.encode import default_tokenizer, encoder

ROWS = [
    (5, "The cat, the dog.\nA  line  with   spaces \t tabs"), (1, None), (2, ""), (3, " leading"), (4, "trailing "),
    (6, "word " * 3000), (7, "same text"), (7, "same text"), (8, "Élan über Straße, naïve. don't we'll 12345"),
    (9, "x" * 5000), (10, "<|endoftext|> a b   c"), (11, "ÉÀ́ 日本語 text 🎉 ok"), (None, "no id"),
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in ROWS], "doc_id bigint, text string, start string, bin int")


def _crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_encoder_equals_single_encodings(tokenizer, spark, sf_dir):
    import pyarrow as pa

    texts = [t for _, t in ROWS] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    ids, ends = encoder(default_tokenizer()).texts(pa.array(texts))
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want


def test_special_tokens_as_text():
    import pyarrow as pa
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_tokenizer())
    plain.encode_special_tokens = True
    text = "<|endoftext|> a b   c<|endoftext|>"
    assert encoder(default_tokenizer(), True).texts(pa.array([text]))[0].tolist() == plain.encode(text, add_special_tokens=False).ids
    assert 50256 in encoder(default_tokenizer()).texts(pa.array([text]))[0].tolist()


def test_a_tokenizer_of_another_kind_encodes_whole_texts(tmp_path):
    import pyarrow as pa
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"a b": 0, "a": 1, "b": 2, "?": 3}, unk_token="?"))
    other.pre_tokenizer = pre_tokenizers.Punctuation()
    other.save(str(tmp_path / "other.json"))
    ids, ends = encoder(str(tmp_path / "other.json")).texts(pa.array(["a b", "a", "b.a", None]))
    assert [ids[x:y].tolist() for x, y in zip(ends, ends[1:])] == [[0], [1], [2, 3, 1], []]


def test_odd_spaces_equal_single_encodings(tokenizer):
    import random

    import pyarrow as pa

    rng = random.Random(3)
    parts = ["a", "B", "é", "日", "🎉", " ", "  ", "\n", "\t", "'s", "1", "23", ".", ",", "\x0b", "\x1c", "\x85", "\u3000", " ", " ", "the", "<|endoftext|>", "Ġ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3000)]
    own = encoder(default_tokenizer())
    for start in range(0, len(texts), 100):
        ids, ends = own.texts(pa.array(texts[start : start + 100]))
        for text, a, b in zip(texts[start : start + 100], ends, ends[1:]):
            assert ids[a:b].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_pieces_and_sequences(docs, tokenizer):
    got = packing.pack_documents(docs, capacity=64, slack=2).collect()
    want = []
    for doc_id, text in ROWS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want += [(doc_id, k, a, b - a, _crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r[:5] for r in got), key=str) == sorted(want, key=str)
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= -(-sum(r.length for r in got) // 64) + 1


def test_packing_is_tight_over_many_tasks(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(40)
    got = packing.pack_documents(docs)
    total = got.selectExpr("sum(length)").first()[0]
    assert got.select("sequence_id").distinct().count() <= 1.02 * total / 1024 + 1


@pytest.mark.parametrize("lengths", [[], [5], [3, 3, 3, 3], [10, 1, 9, 2, 8, 7, 3], [6] * 7])
def test_best_fit(lengths):
    bins, offsets, fills = packing.best_fit(np.array(lengths, dtype=np.int64), 10)
    assert fills.sum() == sum(lengths) and (fills <= 10).all()
    for b in range(len(fills)):
        spans = sorted((offsets[i], lengths[i]) for i in range(len(lengths)) if bins[i] == b)
        assert [s for s, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]]


def test_records_round_trip(docs, tokenizer, tmp_path):
    folder = f"file://{tmp_path}/out"
    index = records.write_records(docs, folder)
    got = sorted(records.read_records(index, folder).collect(), key=lambda r: r.start)
    want = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in ROWS]
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(
        ((i, len(x), _crc(x)) for i, x in want), key=str
    )
    assert [r.doc_id is None or r.doc_id for r in got] == [True, *sorted(i for i, _ in ROWS if i is not None)]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]


def test_damaged_record_is_found():
    framed = bytearray(records.frame(b"\x01\x00\x02\x00"))
    assert bytes(records.unframe(memoryview(framed))) == b"\x01\x00\x02\x00"
    for at in (0, 13):
        broken = bytearray(framed)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(memoryview(broken))


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack_documents(none).count() == 0
    folder = str(tmp_path / "none")
    assert records.read_records(records.write_records(none, folder), folder).count() == 0
