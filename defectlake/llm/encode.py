"""Token ids of whole texts with the ``tokenizers`` library, sharing work between equal words.

A byte-level BPE never merges across the border between a non-space character and a following
single space, so a text is cut there and every distinct piece is encoded once. Unseen pieces are encoded as one text,
where each begins with the only token that begins with a space, and kept as stretches of one array of ids, from which
a slice's ids are laid out at once. Texts with other white space beside a space, and those that hold the string of an
added token, are encoded as a whole; so are all texts of a tokenizer of another kind.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from defectlake.llm.common import ragged_index

#: pieces that a worker remembers before it starts anew, about 200 bytes each
REMEMBERED = 400_000
#: words that are encoded as one text
TOGETHER = 2000

_SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
_BESIDE = f"{_SPACE} | {_SPACE}"


class Encoder:
    """Ids of texts by the tokenizer file ``path``; the same ids as encoding each text by itself.

    ``special_as_text`` takes the strings of special tokens in a text for text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        cut = parts.get("pre_tokenizer") or {}
        self.cuts = (
            parts["model"].get("type") == "BPE" and not parts["model"].get("dropout") and not parts.get("normalizer")
            and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        )
        self.added = [t["content"] for t in parts.get("added_tokens") or () if not (special_as_text and t.get("special"))]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        # a byte-level vocabulary writes a space as this letter
        self.begins[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self._forget()

    def _forget(self) -> None:
        self.after_space: dict[str, int] = {}
        self.heads: dict[str, int] = {}
        self.flat, self.start, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _keep(self, ids: list[np.ndarray], sizes: np.ndarray) -> None:
        self.start = np.append(self.start, len(self.flat) + np.cumsum(sizes) - sizes)
        self.size = np.append(self.size, sizes)
        self.flat = np.concatenate([self.flat, *ids])

    def _each(self, pieces: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        found = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return found, np.array([len(x) for x in found], dtype=np.int64)

    def _learn(self, words: list[str]) -> None:
        """Ids of unseen words after a space."""
        alone = [w for w in words if not w or w[-1].isspace()]
        if alone:  # at the end of texts only, so there are few
            rest = set(alone)
            words = [w for w in words if w not in rest]
        texts = ["".join([" " + w for w in words[i : i + TOGETHER]]) for i in range(0, len(words), TOGETHER)]
        for i, encoding in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            own = words[i * TOGETHER : (i + 1) * TOGETHER]
            ids = np.array(encoding.ids, dtype=np.uint32)
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) != len(own) or starts[0]:
                alone += own
                continue
            self.after_space.update(zip(own, range(len(self.size), len(self.size) + len(own))))
            self._keep([ids], np.diff(np.append(starts, len(ids))))
        if alone:
            self.after_space.update(zip(alone, range(len(self.size), len(self.size) + len(alone))))
            self._keep(*self._each([" " + w for w in alone]))

    def _places(self, known: dict[str, int], pieces: list[str], learn) -> np.ndarray:
        places = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        unseen = np.flatnonzero(places < 0)
        if len(unseen):
            fresh = [pieces[i] for i in unseen.tolist()]
            learn(fresh)
            places[unseen] = np.fromiter(map(known.__getitem__, fresh), np.int64, len(fresh))
        return places

    def _learn_heads(self, pieces: list[str]) -> None:
        self.heads.update(zip(pieces, range(len(self.size), len(self.size) + len(pieces))))
        self._keep(*self._each(pieces))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the border of each text in them (a null is empty)."""
        if len(self.size) > REMEMBERED:
            self._forget()
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        odd = pc.match_substring_regex(texts, _BESIDE) if self.cuts else pa.array(np.ones(len(texts), dtype=bool))
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        cut = pc.if_else(odd, pa.scalar("", pa.large_string()), texts) if whole else texts
        words = pc.split_pattern(cut, " ")
        coded = words.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        distinct = coded.dictionary.to_pylist()
        borders = words.offsets.to_numpy().astype(np.int64)
        borders = borders - borders[0]
        # the first piece of a text has no space before it
        heads, head = np.unique(index[borders[:-1]], return_inverse=True)
        place = self._places(self.after_space, distinct, self._learn)[index]
        place[borders[:-1]] = self._places(self.heads, [distinct[i] for i in heads.tolist()], self._learn_heads)[head]

        sizes = self.size[place]
        ids = self.flat[ragged_index(self.start[place], sizes)]
        ends = np.append(0, np.cumsum(sizes))[borders]
        if whole:
            encoded, _ = self._each([texts[i].as_py() for i in whole])
            parts = [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]
            for i, own in zip(whole, encoded):
                parts[i] = own
            ids = np.concatenate(parts)
            ends = np.append(0, np.cumsum([len(p) for p in parts]))
        return ids, ends


@lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """The encoder of this worker process; it outlives a task."""
    return Encoder(path, special_as_text)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
