"""Fill-in-the-middle documents, cut at tokens, with a sparse exception index between bytes and code points.

A text is cut where its tokens end: optional white space and the characters up to the next white space, or white
space alone at the end. Two draws from a hash of the doc_id choose the cuts, two more the form: the text as it is
(plain), or its three parts behind sentinels in prefix-suffix-middle (psm) or suffix-prefix-middle order (spm).

Tokens and cuts are found in the UTF-8 bytes of a whole Arrow slice at once. Byte and code-point places differ only after
multibyte characters, so the index holds just those: the byte at which each begins and the excess bytes up to and with
it. A place is converted by one binary search in the index; where no such character stands before it, nothing changes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from defectlake.llm.common import arrow_map, documents, text_slices

SEED = 42
#: per cent of documents that are rearranged, and of those that take the spm form
RATE, SPM = 50, 80
#: sentinels before prefix, suffix and middle
SENTINELS = ("<P>", "<S>", "<M>")
ROWS = (
    "doc_id bigint, n bigint, form string, output string, prefix_chars bigint, middle_chars bigint, suffix_chars bigint"
)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class ExceptionIndex:
    """Places in UTF-8 bytes against places in code points, from the multibyte characters alone."""

    def __init__(self, data: np.ndarray):
        # 2, 3 and 4 byte characters begin with these bytes; only they are kept
        self.begins = np.flatnonzero(data >= 0xC0)
        lead = data[self.begins]
        self.excess = np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))
        self.points = self.begins + 1 - np.append(0, self.excess[:-1])

    def to_points(self, places: np.ndarray) -> np.ndarray:
        """Code points before each byte place; a place must not lie inside a character."""
        before = np.searchsorted(self.begins, places, side="left")
        return places - np.append(0, self.excess)[before]

    def to_bytes(self, places: np.ndarray) -> np.ndarray:
        """Bytes before each code-point place."""
        before = np.searchsorted(self.points, places, side="right")
        return places + np.append(0, self.excess)[before]


def token_ends(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte places where tokens end, and the first token number of each text and one past the last."""
    space = _SPACE[data]
    after = np.append(space[1:], True)
    last = np.zeros(len(data), dtype=bool)
    filled = borders[1:][np.diff(borders) > 0]
    last[filled - 1] = True
    # a token ends with its last visible byte; white space that ends a text is one more
    ends = np.flatnonzero((~space & after) | last) + 1
    return ends, np.searchsorted(ends, borders, side="right")


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the hash of the seed and the doc_id (a null id is an empty one)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def _arrange(seed: int, rate: int, spm: int, sentinels: tuple[str, str, str], unit: str):
    marks = [s.encode() for s in sentinels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            texts = pc.fill_null(part.column("text"), "").cast(pa.large_string())
            _, offsets, values = texts.buffers()
            borders = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            start = int(borders[0]) if len(borders) else 0
            raw = memoryview(values)[start : int(borders[-1])] if values is not None else memoryview(b"")
            data = np.frombuffer(raw, np.uint8)
            borders = borders - start
            index = ExceptionIndex(data)
            ends, first = (None, index.to_points(borders)) if unit == "character" else token_ends(data, borders)
            n = np.diff(first)
            drawn = np.array([draws(seed, i) for i in part.column("doc_id").to_pylist()], dtype=np.int64).reshape(-1, 4)
            one, two = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1).T
            if ends is None:
                cuts = [index.to_bytes(first[:-1] + k) for k in (one, two)]
            else:
                known = np.append(0, ends)
                cuts = [np.where(k > 0, known[first[:-1] + k], borders[:-1]) for k in (one, two)]
            held = pa.array(np.zeros(len(texts), dtype=bool))
            for mark in sentinels:
                held = pc.or_(held, pc.match_substring(texts, mark))
            plain = (n == 0) | held.to_numpy(zero_copy_only=False) | (drawn[:, 2] % 100 >= rate)
            first_spm = drawn[:, 3] % 100 < spm
            points = [index.to_points(x) for x in (borders[:-1], *cuts, borders[1:])]
            prefix, middle, suffix = (b - a for a, b in zip(points, points[1:]))
            outputs = []
            places = zip(borders[:-1].tolist(), *(c.tolist() for c in cuts), borders[1:].tolist())
            for row, (a, b, c, d) in enumerate(places):
                if plain[row]:
                    outputs.append(bytes(raw[a:d]))
                elif first_spm[row]:
                    outputs.append(b"".join((marks[1], raw[c:d], marks[0], raw[a:b], marks[2], raw[b:c])))
                else:
                    outputs.append(b"".join((marks[0], raw[a:b], marks[1], raw[c:d], marks[2], raw[b:c])))
            form = np.where(plain, "plain", np.where(first_spm, "spm", "psm"))
            lengths = [pa.array(x, pa.int64(), mask=plain) for x in (prefix, middle, suffix)]
            columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string())]
            columns += [pa.array(outputs, pa.binary()).cast(pa.string()), *lengths]
            yield pa.RecordBatch.from_arrays(
                columns, ["doc_id", "n", "form", "output", "prefix_chars", "middle_chars", "suffix_chars"]
            )

    return run


def fill_in_middle(
    docs: DataFrame,
    seed: int = SEED,
    rate: int = RATE,
    spm: int = SPM,
    sentinels: tuple[str, str, str] = SENTINELS,
    unit: str = "token",
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n, form, output, prefix_chars, middle_chars, suffix_chars.

    n counts the text's tokens, or its code points if ``unit`` is "character", and cuts lie between them; the lengths are in code points and null for the plain form. A null text is an empty
    one, an empty text or one that holds a sentinel is plain. A null doc_id draws as an empty one; rows with one
    doc_id draw alike, repeated rows are kept as rows. A text is worked on as a whole however long it is, a few times
    its size in memory. Other columns are not read. An empty table gives no rows. ``sentinels`` are three different
    texts without a character in common that ends one and begins another.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.transform(arrow_map, _arrange(seed, rate, spm, sentinels, unit), ROWS)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``output`` was made of."""
    either = "|".join(rf"\Q{s}\E" for s in sentinels)
    parts = F.split(output, either)
    # behind the first sentinel: prefix, suffix, middle or suffix, prefix, middle
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(documents(spark, sf_dir))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES = {"op12_fill_in_middle": op12_fill_in_middle}

ORACLE_SQL = {
    "op12_fill_in_middle": r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM hashed
), cut AS (
  SELECT *, len(tokens) AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS one,
    greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS two
  FROM drawn
), formed AS (
  SELECT *, array_to_string(tokens[1:one], '') AS prefix, array_to_string(tokens[one + 1:two], '') AS middle,
    array_to_string(tokens[two + 1:n], '') AS suffix,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(coalesce(prefix, '')) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(coalesce(middle, '')) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'spm' THEN '<S>' || coalesce(suffix, '') || '<P>' || coalesce(prefix, '') || '<M>' || coalesce(middle, '')
    ELSE '<P>' || coalesce(prefix, '') || '<S>' || coalesce(suffix, '') || '<M>' || coalesce(middle, '') END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM formed
""",
}
