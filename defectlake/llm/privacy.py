"""Personal data and what gives it away, in DataFrame functions only.

Direct identifiers (e-mail and IP addresses, card and phone numbers) are found by pattern. Each distinct
identifier is a protected entity. Over the whole corpus it is counted in how many documents a term occurs and in how
many it occurs together with an entity; the disclosure of entity e by term t is its normalised pointwise mutual
information, log(p(e|t) / p(e)) / -log p(e): 1 if the term occurs nowhere without the entity, 0 if it says nothing.
p(e|t) counts SMOOTHING documents more that have the term without the entity, so that one document proves less than
many. Each document counts, copies too. A term that discloses an entity by GENERALISE_FROM or more is replaced by its
outline, by REMOVE_FROM or more it is removed. In a large corpus the information alone is high for any rare term that once stood
beside an entity, so the entity must also hold LIKELY_FROM of the term's documents: where a term goes, the entity is as
likely as not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from defectlake.llm.common import documents, store
from defectlake.llm.spans import Kind, kind_spans, listed, masked, no_spans, of_kinds, places
from defectlake.scale import heavy_keys, skewed_lookup

#: documents with a term and without the entity that are added to what was counted
SMOOTHING = 1.0
GENERALISE_FROM = 0.8
REMOVE_FROM = 0.95
#: least share of a term's documents that hold the entity it discloses
LIKELY_FROM = 0.5
#: (text, term) pairs, of up to 200 bytes, that are sent to every executor at most
SENT_PAIRS = 50_000
#: 64-bit words of the table of bits that is sent in place of more pairs
WORDS = 1 << 16
#: letters of a term
TERM_LETTERS = 4
TERM = rf"\p{{L}}{{{TERM_LETTERS},}}"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    digits = F.reverse(_digits(match))

    def value(place: Column) -> Column:
        digit = F.substring(digits, place, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(place % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, place: a + value(place))
    return F.when(F.length(digits).between(12, 19), total % 10 == 0).otherwise(False)


def _parts_at_most_255(match: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) <= 3) & (F.concat(F.lit("0"), F.substring(bare, 1, 3)).cast("int") <= 255)

    return F.forall(F.split(match, r"\."), small)


# A match can only start where a run of its first class starts, or where the last match ended; saying so, and
# giving nothing back once matched, keeps the search linear in texts with very long runs.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

BASE = ("email", "ip", "card", "phone")
KINDS = (
    Kind("email", _EMAIL, r"@[A-Za-z0-9-]"),
    Kind("ip", _IP, r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", _parts_at_most_255),
    Kind("card", _CARD, r"[0-9](?:[\x20-]?[0-9]){11}", _luhn),
    Kind("phone", _PHONE, r"\+[0-9][\x20().0-9-]{2}", lambda m: F.length(_digits(m)).between(9, 15)),
)


def identifiers(text: Column) -> Column:
    """Sorted spans of direct identifiers in a text that is not null."""
    return F.array_sort(F.concat(*[kind_spans(text, kind, i) for i, kind in enumerate(KINDS)]))


def _entities(text: Column, spans: Column) -> Column:
    """Distinct entities of the identifiers in a text."""

    def entity(span: Column) -> Column:
        value = F.substring(text, (span["start"] + 1).cast("int"), (span["end"] - span["start"]).cast("int"))
        return F.xxhash64(span["kind"], F.when(span["kind"] == "email", F.lower(value)).otherwise(_digits(value)))

    return F.array_distinct(F.transform(spans, entity))


def _blanked(text: Column, spans: Column) -> Column:
    """``text`` with blanks for identifiers, as long as before."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, span: Column) -> Column:
        between = F.substring(
            text, (state["at"] + 1).cast("int"), F.greatest(span["start"] - state["at"], F.lit(0)).cast("int")
        )
        blanks = F.repeat(F.lit(" "), (span["end"] - F.greatest(span["start"], state["at"])).cast("int"))
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"), F.concat(state["parts"], F.array(between, blanks)).alias("parts")
        )

    def finish(state: Column) -> Column:
        return F.concat(F.array_join(state["parts"], ""), F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(F.array_sort(spans), start, step, finish)).otherwise(text)


def _term_hashes(blanked: Column) -> Column:
    """Distinct terms of a text without its identifiers."""
    words = F.filter(F.split(blanked, r"[^\p{L}]+"), lambda w: F.length(w) >= TERM_LETTERS)
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(F.lower(w))))


def disclosing_terms(
    terms: DataFrame,
    private: DataFrame,
    smoothing: float = SMOOTHING,
    generalise_from: float = GENERALISE_FROM,
    likely_from: float = LIKELY_FROM,
) -> DataFrame:
    """(term_hash, disclosure) of the terms at or over both thresholds, with the entity that each discloses most.

    ``terms`` (term_hashes) has a row for each document of the corpus, ``private`` (text_hash, entities, term_hashes) for
    each with an entity.
    """
    counts = store(
        terms.select(F.explode("term_hashes").alias("term_hash")).groupBy("term_hash").agg(F.count(F.lit(1)).alias("n_term")),
        "term_counts",
    )
    total = float(max(1, terms.count()))
    held = store(
        private.select("text_hash", F.explode("entities").alias("entity"))
        .groupBy("text_hash", "entity").agg(F.count(F.lit(1)).alias("copies")),
        "held",
    )
    p_entity = F.least(F.col("n_entity") / total, F.lit(0.5))
    # no pair of the entity can reach the threshold with a term of more documents
    sized = held.groupBy("entity").agg(F.sum("copies").alias("n_entity")).withColumn(
        "most",
        F.col("n_entity") * F.least(F.pow(p_entity, F.lit(generalise_from - 1.0)), F.lit(1 / likely_from)) * (1 + 1e-9),
    )
    sized = store(held.join(sized, "entity"), "sized")
    bounds = sized.groupBy("text_hash").agg(F.max("most").alias("most_of_text"))
    rare = store(
        private.select("text_hash", F.explode("term_hashes").alias("term_hash")).distinct()
        .join(counts.where(F.col("n_term") <= (sized.agg(F.max("most")).first()[0] or 0.0)), "term_hash")
        .join(bounds, "text_hash").where("n_term <= most_of_text").select("text_hash", "term_hash", "n_term"),
        "rare",
    )
    p_given = F.col("n_both") / (F.col("n_term") + smoothing)
    return (
        rare.join(sized, "text_hash").where("n_term <= most")
        .groupBy("entity", "term_hash")
        .agg(F.sum("copies").alias("n_both"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity"))
        .where(F.col("n_both") >= likely_from * F.col("n_term"))
        .select("term_hash", (F.log(p_given / p_entity) / -F.log(p_entity)).alias("disclosure"))
        .where(F.col("disclosure") >= generalise_from)
        .groupBy("term_hash").agg(F.max("disclosure").alias("disclosure"))
    )


def _key_bits(right: DataFrame, key: str) -> DataFrame:
    """A table of bits of the ``key``, a hash: ``WORDS`` rows at most whatever the size of ``right``."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit_of(key))
    words = right.select(_word_of(key), bit.alias("bit")).groupBy("__word").agg(F.bit_or("bit").alias("__bits"))
    # written first, so that the driver gets these rows and not what they are made of
    return F.broadcast(store(words, "words"))


def _word_of(key: str) -> Column:
    return F.pmod(key, F.lit(WORDS)).alias("__word")


def _bit_of(key: str) -> Column:
    return F.pmod(F.shiftright(key, 16), F.lit(64)).cast("int")


def _may_meet(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` with ``may``: false only where no row of ``right`` has its ``key``."""
    met = left.withColumn("__word", _word_of(key)).join(_key_bits(right, key), "__word", "left")
    return met.withColumn("may", F.coalesce(F.getbit("__bits", _bit_of(key)) == 1, F.lit(False))).drop("__word", "__bits")


def _near(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The rows of ``left`` that may meet ``right``."""
    words = _key_bits(right, key).withColumnRenamed("__word", "__of")
    return left.join(words, (_word_of(key) == F.col("__of")) & (F.getbit("__bits", _bit_of(key)) == 1), "left_semi")


def sanitise(
    docs: DataFrame,
    smoothing: float = SMOOTHING,
    generalise_from: float = GENERALISE_FROM,
    remove_from: float = REMOVE_FROM,
    everywhere: bool = False,
    likely_from: float = LIKELY_FROM,
) -> DataFrame:
    """Spans and sanitised text of each row of ``docs`` (doc_id, text).

    Returns doc_id, spans (identifiers, then ``term`` for generalised and ``term_removed`` for removed terms, sorted)
    and sanitised. Disclosing terms are marked wherever they stand in a text with identifiers, and with ``everywhere``
    in all texts. Whole texts of any length are searched. A null text is empty. Rows with equal or null doc_id are kept, each with the spans of its own text.
    Other columns are not read. An empty table gives no rows.
    """
    whole = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    found = whole.withColumn("spans", identifiers(F.col("text"))).withColumn("text_hash", F.xxhash64("text"))
    private = store(found.where(F.size("spans") > 0), "private")
    clean = found.where(F.size("spans") == 0)
    told = private.withColumn("term_hashes", _term_hashes(_blanked(F.col("text"), F.col("spans"))))
    free = clean.withColumn("term_hashes", _term_hashes(F.col("text")))
    terms = told.select("text_hash", "term_hashes").unionByName(free.select("text_hash", "term_hashes"))
    holders = told.select("text_hash", _entities(F.col("text"), F.col("spans")).alias("entities"), "term_hashes")
    pairs = store(disclosing_terms(terms, holders, smoothing, generalise_from, likely_from), "disclosing")
    searched = terms if everywhere else told.select("text_hash", "term_hashes")
    exploded = searched.select("text_hash", F.explode("term_hashes").alias("term_hash"))
    if pairs.count() <= SENT_PAIRS:
        told_terms = exploded.join(F.broadcast(pairs), "term_hash")
    else:
        near = store(_near(exploded, pairs, "term_hash"), "near")
        told_terms = skewed_lookup(near, pairs, ["term_hash"], salt=["text_hash"], how="inner")
    hits = store(
        told_terms
        .groupBy("text_hash")
        .agg(F.collect_set(F.struct("term_hash", "disclosure")).alias("list"))
        # a map is searched from its start, so a text with n terms has about sqrt(n) maps
        .withColumn("n", F.ceil(F.sqrt(F.size("list"))).cast("int"))
        .select(
            "text_hash",
            F.transform(
                F.sequence(F.lit(0), F.col("n") - 1),
                lambda b: F.map_from_entries(F.filter("list", lambda x: F.pmod(x["term_hash"], F.col("n")) == b)),
            ).alias("hits"),
        ),
        "hits",
    )

    def told_by(match: Column) -> Column:
        own, key = F.col("hits"), F.xxhash64(F.lower(match))
        return own[F.pmod(key, F.size(own)).cast("int")][key]

    n_hits = hits.agg(F.sum(F.aggregate("hits", F.lit(0), lambda n, m: n + F.size(m)))).first()[0] or 0

    def mark(met: DataFrame) -> DataFrame:
        """Spans with the terms of rows that have met their hits."""
        text, spans, own = F.col("text"), F.col("spans"), F.col("hits")
        placed = F.transform(
            places(_blanked(text, spans), TERM, lambda m: told_by(m).isNotNull()),
            lambda p: F.struct(
                p["start"].alias("start"), F.lit(len(KINDS)).alias("ord"), (p["start"] + F.length(p["match"])).alias("end"),
                F.when(told_by(p["match"]) >= remove_from, "term_removed").otherwise("term").alias("kind"),
            ),
        )
        return met.select(
            "doc_id", "text", F.when(own.isNull(), spans).otherwise(F.array_sort(F.concat(spans, placed))).alias("spans")
        )

    plain = ["doc_id", "text", "spans"]
    if n_hits <= SENT_PAIRS:
        few = F.broadcast(hits)
        marked = mark(private.join(few, "text_hash", "left"))
        marked = marked.unionByName(mark(clean.join(few, "text_hash", "left")) if everywhere else clean.select(*plain))
    else:
        hashed = whole.withColumn("text_hash", F.xxhash64("text"))
        heavy = heavy_keys(hashed, ["text_hash"])
        marked = mark(skewed_lookup(private, hits, ["text_hash"], salt=["doc_id"], heavy=heavy))
        if everywhere:
            told_of, may = _may_meet(hashed, hits, "text_hash"), F.col("may")

            def without_identifiers(chosen: Column) -> DataFrame:
                # the spans name the choice, so they are looked for in chosen texts only
                rows = told_of.where(chosen).withColumn("spans", F.when(chosen, identifiers(F.col("text"))))
                return rows.where(F.size("spans") == 0)

            # only texts that may have a term are moved
            moved = skewed_lookup(without_identifiers(may), hits, ["text_hash"], salt=["doc_id"], heavy=heavy)
            marked = marked.unionByName(mark(moved)).unionByName(without_identifiers(~may).select(*plain))
        else:
            marked = marked.unionByName(clean.select(*plain))
    return marked.select("doc_id", "spans", sanitised(F.col("text"), F.col("spans")).alias("sanitised"))


def sanitised(text: Column, spans: Column) -> Column:
    """``text`` with identifiers replaced by ``[KIND]``, terms by their outline or by nothing."""

    def label(span: Column) -> Column:
        term = F.substring(text, (span["start"] + 1).cast("int"), (span["end"] - span["start"]).cast("int"))
        outline = F.regexp_replace(F.regexp_replace(term, r"\p{Lu}", "X"), r"[^X]", "x")
        return (
            F.when(span["kind"] == "term", outline)
            .when(span["kind"] == "term_removed", "")
            .otherwise(F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]")))
        )

    return masked(text, spans, label)


def op10_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise(documents(spark, sf_dir), everywhere=True)
    counts = [F.size(of_kinds(F.col("spans"), [k])).cast("bigint").alias(f"n_{k}") for k in BASE]
    return found.select(
        "doc_id", *counts,
        F.sha2(listed(of_kinds(F.col("spans"), list(BASE))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


QUERIES = {"op10_private_data": op10_private_data}
