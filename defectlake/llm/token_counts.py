"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie. When a character has no edge from the current node, greedy matching would give out the
longest pieces of what has been read and go on from the rest: that rest's node is the failure link, and the number of
pieces given out is fixed beforehand with the node. So each character is read once, no piece is ever built, and a
text's count is a sum of numbers. Links and counts are worked into one table by (node, character), which is walked
for many words at a time.

A word is a space and what follows up to the next white space, so pieces that begin with a space are those that
begin words. Vocabularies that mark continuing pieces instead are given as two sets.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from defectlake.llm.common import arrow_map, documents, text_slices

SLICE = 4 << 20
#: words walked one by one once so few are left of a slice
FEW = 4


class Automaton:
    """Counts pieces of byte strings. ``first`` pieces begin a word, ``later`` ones continue it.

    Give the same object twice if pieces aren't told apart. A word that greedy matching can't finish counts as one
    unknown piece.
    """

    def __init__(self, first: Iterable[bytes], later: Iterable[bytes]):
        edges: list[dict[int, int]] = [{}, {}]  # 0 and 1: roots of first and later pieces
        piece = [False, False]
        again = 0 if later is first else 1  # where the rest of a word goes on
        for root, pieces in ((0, first), (1, later))[: again + 1]:
            for word in pieces:
                node = root
                for byte in word:
                    if byte not in edges[node]:
                        edges[node][byte] = len(edges)
                        edges.append({})
                        piece.append(False)
                    node = edges[node][byte]
                piece[node] = node > 1
        n = len(edges)
        self.dead = n  # from here on the word is unknown
        step = np.full((n + 1, 256), self.dead, dtype=np.int32)
        given = np.zeros((n + 1, 256), dtype=np.int32)
        # link[v]: node of the rest after giving out pops[v] pieces; -1 if greedy matching is stuck
        link, pops = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        layer = [(0, -1, 0), (1, -1, 0)]
        while layer:
            following = []
            for node, parent, byte in layer:
                if parent >= 0:
                    if piece[node]:
                        link[node], pops[node] = again, 1
                    else:
                        rest, count = parent, 0
                        # give out until what is left can go on with this byte
                        while link[rest] >= 0:
                            count += int(pops[rest])
                            rest = int(link[rest])
                            if byte in edges[rest]:
                                link[node], pops[node] = edges[rest][byte], count
                                break
                for b, child in edges[node].items():
                    following.append((child, node, b))
            for node, _, _ in layer:
                if link[node] >= 0:
                    step[node] = step[link[node]]
                    given[node] = np.where(step[node] == self.dead, 0, given[link[node]] + pops[node])
                for b, child in edges[node].items():
                    step[node, b], given[node, b] = child, 0
            layer = following
        ends = np.zeros(n + 1, dtype=np.int64)  # pieces given out at the end of a word, -1 if that is impossible
        ends[0] = ends[1] = 0
        for node in range(2, n):
            count, rest = 0, node
            while rest > 1 and link[rest] >= 0:
                count, rest = count + int(pops[rest]), int(link[rest])
            ends[node] = count if rest <= 1 else -1
        ends[self.dead] = -1
        # a byte can give out as many pieces as the longest piece has bytes; most vocabularies need 8 bits for that
        given = given.astype(np.min_scalar_type(int(given.max())))
        self.step, self.given, self.ends = step.ravel(), given.ravel(), ends

    def count(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Pieces of each byte string data[start : start + length]."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order].astype(np.int64), lengths[order]
        node, total = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=np.int64)
        active, at = len(order), 0
        longest = int(lengths[0]) if len(order) else 0
        while at < longest:
            active = int(np.searchsorted(-lengths[:active], -at, side="left"))
            if active <= FEW:
                break
            index = (node[:active] << 8) | data[starts[:active] + at]
            total[:active] += self.given[index]
            node[:active] = self.step[index]
            at += 1
        for k in range(active if at < longest else 0):
            here, count = int(node[k]), 0
            for byte in data[starts[k] + at : starts[k] + lengths[k]].tolist():
                count += self.given[here << 8 | byte].item()
                here = self.step[here << 8 | byte].item()
            node[k], total[k] = here, total[k] + count
        ends = self.ends[node]
        counts = np.empty(len(order), dtype=np.int64)
        counts[order] = np.where(lengths == 0, 0, np.where(ends < 0, 1, total + ends))
        return counts


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    pieces = vocabulary(path)
    return Automaton(pieces, pieces)


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        for part in text_slices(batches, size=SLICE):
            texts = pc.fill_null(part.column("text"), "").cast(pa.large_string())
            split = pc.utf8_split_whitespace(texts)
            words = split.flatten()
            coded = words.dictionary_encode()
            # each distinct word once, with the space before it
            distinct = pc.binary_join_element_wise(
                pa.scalar("", pa.large_string()), coded.dictionary, pa.scalar(" ", pa.large_string())
            ).cast(pa.large_binary())
            offsets = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
            data = np.frombuffer(distinct.buffers()[2], np.uint8) if len(distinct) else np.empty(0, np.uint8)
            empty = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False).astype(bool)
            lengths = np.where(empty, 0, np.diff(offsets))
            each = machine.count(data, offsets[:-1], lengths)[coded.indices.to_numpy(zero_copy_only=False)]
            borders = split.offsets.to_numpy().astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(each)])[borders - borders[0]]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(sums))], ["doc_id", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens of each row of ``docs`` (doc_id, text).

    Null texts and texts of white space count 0. Repeated rows are kept. Other columns are not read.
    """
    import public_tokenizers

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.transform(
            arrow_map, _counts(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), "doc_id bigint, n_tokens bigint"
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))


QUERIES = {"op5_token_counts": op5_token_counts}
