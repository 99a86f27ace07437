"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of its letters within words, of order ORDER: the discounted count of an n-gram
plus the left-over weight of its context times the model of the next lower order, whose counts are the
numbers of distinct left neighbours. All languages' log-probabilities of the n-grams seen in training
lie side by side in one array sorted by the n-gram's hash, one array per order, with another for the
left-over weights of contexts. A text is given the language of the lowest cross-entropy per letter, and is
rejected if that lies over what texts of this language and length reach.

Training reads a bounded sample of whole labelled documents; a prediction reads the whole text and
nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from defectlake.llm.common import arrow_map, documents, send_package, text_slices

ORDER = 4
#: documented bound of the sample: letters of labelled text, per language, that the models are made from (as
#: expected; documents are taken whole) and as many documents at most for calibration
SAMPLE_CHARS = 1_500_000
CALIBRATION_DOCS = 400
#: standard deviations, and bits, by which a text's cross-entropy may exceed what is usual for its language
REJECT_SIGMAS = 7.0
REJECT_BITS = 2.0
#: bytes of text scored at once
SLICE = 1 << 20
#: symbols: 0 is outside a word, 1 a letter that training hasn't seen
OTHER = 1
#: symbols that 16 bits tell apart; four of them fill a key
MAX_SYMBOLS = 1 << 16
UNKNOWN = "und"
PREDICTION = "lang_pred string, score double, bits double, rejected boolean"


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and its lower-case form (one code point)."""
    chars = [chr(i) for i in range(0x110000)]
    letter = np.fromiter((c.isalpha() for c in chars), bool, len(chars))
    lower = np.fromiter((ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars), np.uint32, len(chars))
    return letter, lower


def _codes(text: str) -> np.ndarray:
    """Lower-case code points, 0 for what is no letter."""
    letter, lower = _letters()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(letter[points], lower[points], 0)


def _width(points: np.ndarray) -> int:
    """Bits of a symbol in a key: 8 for small alphabets, or 16."""
    return 8 if len(points) + 2 <= 1 << 8 else 16


def _low(width: int, n: int) -> np.uint64:
    """Mask of a key's last ``n`` symbols."""
    return np.uint64((1 << width * n) - 1)


def _grams(symbols: np.ndarray, order: int) -> np.ndarray:
    """Key of the n-gram that ends at each position, padded with 0 before the word; as many bits as a symbol has."""
    width = 8 * symbols.dtype.itemsize
    if width * order > 64:
        raise ValueError(f"n-grams of {order} symbols of {width} bits don't fit a key")
    keys = symbols.astype(np.uint64)
    inside = symbols != 0
    padded = np.concatenate([np.zeros(order, np.uint64), symbols.astype(np.uint64)])
    alive = inside.copy()
    for back in range(1, order):
        earlier = padded[order - back : order - back + len(symbols)]
        alive &= earlier != 0  # once outside the word, what lies before doesn't count
        keys |= np.where(alive, earlier, 0).astype(np.uint64) << np.uint64(width * back)
    return keys


def _hash(keys: np.ndarray) -> np.ndarray:
    mixed = keys * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return mixed * np.uint64(0xBF58476D1CE4E5B9)


class Table:
    """Rows of values by key in an array sorted by hash; a hash's upper bits say where to look."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashes = _hash(keys)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.values = hashes[order], np.ascontiguousarray(values[order])
        self.bits = max(1, int(len(keys)).bit_length() + 1)
        top = (self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        self.first = np.searchsorted(top, np.arange((1 << self.bits) + 1)).astype(np.int64)
        self.longest = int(np.diff(self.first).max()) if len(keys) else 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if it isn't there."""
        rows = np.full(len(keys), -1, dtype=np.int64)
        if not len(self.hashes):
            return rows
        hashes = _hash(keys)
        bucket = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        open_ = np.flatnonzero(at < end)
        for step in range(self.longest):
            place = at[open_] + step
            hit = self.hashes[place] == hashes[open_]
            rows[open_[hit]] = place[hit]
            open_ = open_[~hit & (place + 1 < end[open_])]
            if not len(open_):
                break
        return rows


@dataclass
class Model:
    langs: list[str]
    points: np.ndarray  # code points of the symbols from 2 on, sorted
    grams: list[Table]  # by order, log2-probabilities by language
    weights: list[Table]  # by length of context, log2 of the left-over weight by language
    floor: float  # log2-probability of a symbol that no language has seen
    mean: np.ndarray | None = None  # of a text's bits per letter, by language
    deviation: np.ndarray | None = None  # of one letter's bits

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.points, codes)
        place[place == len(self.points)] = 0
        known = self.points[place] == codes if len(self.points) else np.zeros(len(codes), bool)
        return np.where(codes == 0, 0, np.where(known, place + 2, OTHER)).astype(f"u{_width(self.points) // 8}")

    def log_probs(self, keys: np.ndarray) -> np.ndarray:
        """log2-probability of the last symbol of each n-gram, a column for each language."""
        width = _width(self.points)
        out = np.empty((len(keys), len(self.langs)), dtype=np.float32)
        left, added = np.arange(len(keys)), np.zeros((len(keys), len(self.langs)), dtype=np.float32)
        for order in range(len(self.grams), 0, -1):
            own = keys[left] & _low(width, order)
            rows = self.grams[order - 1].find(own)
            hit = rows >= 0
            out[left[hit]] = self.grams[order - 1].values[rows[hit]] + added[hit]
            left, added = left[~hit], added[~hit]
            if not len(left):
                return out
            if order > 1:  # what the unseen n-gram's context leaves to the lower order
                context = own[~hit] >> np.uint64(width)
                rows = self.weights[order - 2].find(context)
                seen = rows >= 0
                added[seen] += self.weights[order - 2].values[rows[seen]]
        out[left] = self.floor + added
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits per letter of each text and language, their variance by letter, and the number of letters."""
        codes = [_codes(t) for t in texts]
        sizes = np.fromiter((len(c) + 1 for c in codes), np.int64, len(codes))
        flat = np.zeros(int(sizes.sum()), dtype=np.uint32)  # a zero after each text
        at = 0
        for c in codes:
            flat[at : at + len(c)] = c
            at += len(c) + 1
        keys = _grams(self.symbols(flat), len(self.grams))
        inside = np.flatnonzero(flat)
        text_of = np.repeat(np.arange(len(texts)), sizes)[inside]
        letters = np.bincount(text_of, minlength=len(texts))
        distinct, back = np.unique(keys[inside], return_inverse=True)
        bits = -self.log_probs(distinct)
        sums = np.empty((2, len(texts), len(self.langs)))
        for k in range(len(self.langs)):
            own = bits[:, k][back]
            sums[0, :, k] = np.bincount(text_of, weights=own, minlength=len(texts))
            sums[1, :, k] = np.bincount(text_of, weights=own * own, minlength=len(texts))
        n = np.maximum(letters, 1)[:, None]
        mean = sums[0] / n
        return mean, sums[1] / n - mean * mean, letters


def kneser_ney(counts: list[dict[str, pd.Series]], langs: list[str], points: np.ndarray) -> Model:
    """The models from ``counts``: per order and language, counts by n-gram key (highest order last)."""
    order, width = len(counts), _width(points)
    used: list[dict[str, pd.Series]] = [{} for _ in range(order)]
    used[-1] = counts[-1]
    for n in range(order - 1, 0, -1):
        for lang in langs:
            # lower orders count distinct left neighbours; an n-gram at a word's start has none and keeps its count
            longer = counts[n].get(lang, pd.Series(dtype=np.int64)).index.to_numpy(np.uint64)
            longer = longer[longer >> np.uint64(width * n) != 0]
            neighbours = pd.Series(1, index=longer & _low(width, n)).groupby(level=0).sum()
            own = counts[n - 1].get(lang, pd.Series(dtype=np.int64))
            starts = own[(own.index.to_numpy(np.uint64) >> np.uint64(width * (n - 1))) == 0] if n > 1 else own.iloc[:0]
            used[n - 1][lang] = neighbours.add(starts, fill_value=0)

    size = len(points) + 2
    grams: list[Table] = []
    weights: list[Table] = []
    lower = None
    for n in range(1, order + 1):
        keys = np.unique(np.concatenate([used[n - 1][x].index.to_numpy(np.uint64) for x in langs]))
        contexts = np.unique(keys >> np.uint64(width))
        probs = np.zeros((len(keys), len(langs)))
        rests = np.ones((len(contexts), len(langs)))
        for k, lang in enumerate(langs):
            count = used[n - 1][lang].reindex(keys).fillna(0).to_numpy(np.float64)
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            place = np.searchsorted(contexts, keys >> np.uint64(width))
            total = np.bincount(place, weights=count, minlength=len(contexts))
            kinds = np.bincount(place, weights=count > 0, minlength=len(contexts))
            safe = np.maximum(total, 1)
            rests[:, k] = np.where(total > 0, discount * kinds / safe, 1.0)
            if lower is None:
                below = np.full(len(keys), 1 / size)
            else:
                below = 2.0 ** lower.log_probs(keys & _low(width, n - 1))[:, k]
            probs[:, k] = np.maximum(count - discount, 0) / safe[place] + rests[place, k] * below
        grams.append(Table(keys, np.log2(probs).astype(np.float32)))
        if n > 1:
            weights.append(Table(contexts, np.log2(rests).astype(np.float32)))
            floor = lower.floor
        else:
            floor = float(np.log2(rests[0] / size).min()) if len(rests) else -8.0
        lower = Model(langs, points, list(grams), list(weights), floor)
    return lower


def _sampled_counts():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # code points here; they become symbols when the sample's alphabet is known
        for part in text_slices(batches, size=SLICE):
            langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
            for lang in dict.fromkeys(langs):
                words = np.concatenate([np.append(_codes(t), 0) for t, x in zip(texts, langs) if x == lang])
                code, count = np.unique(words[words != 0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(code), pa.string()), pa.array(code, pa.int64()), pa.array(count, pa.int64())],
                    ["lang", "code", "n"],
                )

    return run


def _sampled_grams(order: int, points: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shell = Model([], points, [], [], 0.0)
        for part in text_slices(batches, size=SLICE):
            langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
            for lang in dict.fromkeys(langs):
                codes = np.concatenate([np.append(_codes(t), 0) for t, x in zip(texts, langs) if x == lang])
                keys, symbols = _grams(shell.symbols(codes), order), codes != 0
                for n in range(1, order + 1):
                    own, count = np.unique(keys[symbols] & _low(_width(points), n), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(own), pa.string()), pa.array([n] * len(own), pa.int32()),
                            pa.array(own.astype(np.int64)), pa.array(count, pa.int64()),
                        ],
                        ["lang", "n", "gram", "count"],
                    )

    return run


def train(labelled: DataFrame, order: int = ORDER, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Models from ``labelled`` (text, lang); rows with a null in either, or an empty text, teach nothing.

    Documents are taken by a hash of their text, in the share that gives about ``sample_chars`` characters for
    each language, and a few others calibrate rejection. What comes to the driver is bounded by the sample.
    """
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(
        "text IS NOT NULL AND lang IS NOT NULL AND text != ''"
    )
    sizes = {r.lang: (r.chars, r.docs) for r in rows.groupBy("lang").agg(
        F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("docs")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.empty(0, np.uint32), [], [], -8.0)
    steps = 1_000_000
    draw = F.pmod(F.xxhash64("text", F.lit(17)), F.lit(steps))
    share, extra = F.lit(0), F.lit(0)
    for lang, (chars, docs) in sizes.items():
        some = int(steps * min(0.9, sample_chars / max(1, chars)))
        share = F.when(F.col("lang") == lang, some).otherwise(share)
        extra = F.when(F.col("lang") == lang, some + int(steps * min(0.1, CALIBRATION_DOCS / docs)) + 1).otherwise(extra)
    sample = rows.where(draw < share)
    alphabet = (
        sample.transform(arrow_map, _sampled_counts(), "lang string, code bigint, n bigint")
        .groupBy("code").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "code").limit(MAX_SYMBOLS - 2)
    )
    points = np.sort(np.array([r.code for r in alphabet.collect()], dtype=np.uint32))
    grams = (
        sample.transform(arrow_map, _sampled_grams(order, points), "lang string, n int, gram bigint, count bigint")
        .groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))
        .toPandas()
    )
    counts: list[dict[str, pd.Series]] = [{x: pd.Series(dtype=np.int64, index=np.empty(0, np.uint64)) for x in langs} for _ in range(order)]
    for (lang, n), own in grams.groupby(["lang", "n"]):
        counts[n - 1][lang] = pd.Series(own["count"].to_numpy(), index=own["gram"].to_numpy().astype(np.uint64))
    model = kneser_ney(counts, langs, points)

    held = rows.where((draw >= share) & (draw < extra))
    scored = held.transform(arrow_map, _calibration(model), "lang string, mean double, variance double, letters bigint").toPandas()
    model.mean, model.deviation = np.full(len(langs), 8.0), np.full(len(langs), 4.0)
    for k, lang in enumerate(langs):
        own = scored[scored["lang"] == lang]
        if len(own):
            model.mean[k] = np.average(own["mean"], weights=own["letters"])
            model.deviation[k] = np.sqrt(np.average(own["variance"], weights=own["letters"]))
    return model


def _calibration(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, size=SLICE):
            langs = part.column("lang").to_pylist()
            mean, variance, letters = model.score(part.column("text").to_pylist())
            own = [model.langs.index(x) for x in langs]
            use = np.flatnonzero(letters > 0)
            at = np.arange(len(langs))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(langs, pa.string()).take(pa.array(use)), pa.array(mean[at, own][use]),
                    pa.array(variance[at, own][use]), pa.array(letters[use], pa.int64()),
                ],
                ["lang", "mean", "variance", "letters"],
            )

    return run


def _judge(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, bits per letter and whether it is rejected, of each of some texts."""
    n = len(texts)
    lang, score, bits, rejected = [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
    if model.langs:
        mean, _, letters = model.score(pc.fill_null(texts, "").to_pylist())
        best = mean.argmin(axis=1)
        bits = mean[np.arange(n), best]
        # posterior of equally likely languages; a text of many letters counts as 20
        weight = np.minimum(letters, 20)[:, None]
        score = 1 / np.exp2(-(mean - bits[:, None]) * weight).sum(axis=1)
        limit = model.mean[best] + REJECT_BITS + REJECT_SIGMAS * model.deviation[best] / np.sqrt(np.maximum(letters, 1))
        rejected = (letters == 0) | (bits > limit)
        lang = [model.langs[k] if m else UNKNOWN for k, m in zip(best, letters)]
        score, bits = np.where(letters > 0, score, 0.0), np.where(letters > 0, bits, 0.0)
    return lang, score, bits, rejected


def _predict(model: Model, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, size=SLICE):
            lang, score, bits, rejected = _judge(model, part.column("text"))
            kept = [c for c in part.schema.names if with_text or c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in kept), pa.array(lang, pa.string()), pa.array(score), pa.array(bits), pa.array(rejected)],
                [*kept, "lang_pred", "score", "bits", "rejected"],
            )

    return run


def _known(model: Model):
    def run(texts: pa.Array) -> pa.Array:
        slices = text_slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), size=SLICE)
        known = [~_judge(model, part.column("text"))[3] for part in slices]
        return pa.array(np.concatenate(known) if known else np.empty(0, bool))

    return run


def _scored(docs: DataFrame, model: Model, keep: list[str]) -> tuple[DataFrame, list[Column]]:
    """Predictions beside the columns ``keep``, which go by numbers here so that no name clashes."""
    inner = {c: "text" if c == "text" else f"c{i}" for i, c in enumerate(keep)}
    rows = docs.select(
        *[F.col(f"`{c}`").alias(name) for c, name in inner.items() if c != "text"], F.col("text").cast("string").alias("text")
    )
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text" or "text" in keep]
    scored = rows.transform(arrow_map, _predict(model, "text" in keep), ", ".join([*fields, PREDICTION]))
    return scored, [F.col(name).alias(c) for c, name in inner.items()]


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of each row of ``docs`` with lang_pred, score, bits (per letter) and rejected.

    A null text or one without a letter is ``und``, score 0, rejected. Repeated rows are kept. Ties go to the
    first language by name. Without any labelled text all is ``und``.
    """
    scored, columns = _scored(docs, model, list(keep))
    return scored.select(*columns, "lang_pred", "score", "bits", "rejected")


def of_known_language(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, all columns as they are; only the text goes to Python."""
    send_package(docs.sparkSession)
    known = F.arrow_udf(_known(model), "boolean")
    return docs.where(known(F.col("text").cast("string")))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; one without an id isn't."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language_id": op6_language_id}
