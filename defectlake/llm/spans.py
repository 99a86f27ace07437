"""Places of regular-expression matches in a text, as plain column expressions.

Spark returns matches without their places, so a place is taken from the lengths of what lies between
the matches (``split``) and of the matches themselves (``regexp_extract_all``); both walk the text from
left to right without overlap. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: lengths are summed in blocks of so many matches, so that n matches cost n * BLOCK steps at most
BLOCK = 128
SPAN = "struct<start:bigint,ord:int,end:bigint,kind:string>"


@dataclass(frozen=True)
class Kind:
    """What is looked for: ``probe`` holds in every text that has a match which ``keep`` accepts."""

    name: str
    pattern: str
    probe: str
    keep: Callable[[Column], Column] | None = None
    version: int = 1


def _total(values: Column, start: Column, count: Column) -> Column:
    return F.aggregate(F.slice(values, start, count), F.lit(0).cast("bigint"), lambda a, x: a + x)


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once: an expression that a lambda uses would be made again for each element."""
    return F.transform(F.array(value), then)[0]


def places(text: Column, pattern: str, chosen: Callable[[Column], Column] | None = None) -> Column:
    """Array of (start, match) of all matches of ``pattern``, or of those matches that are ``chosen``."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def sized(parts: Column) -> Column:
        sizes = F.zip_with(
            parts["gaps"], parts["found"], lambda g, m: (F.length(g) + F.coalesce(F.length(m), F.lit(0))).cast("bigint")
        )
        return F.struct(parts["gaps"].alias("gaps"), parts["found"].alias("found"), sizes.alias("sizes"))

    def blocked(parts: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor(F.size(parts["found"]) / BLOCK).cast("int")),
            lambda b: _total(parts["sizes"], b * BLOCK + 1, F.lit(BLOCK)),
        )
        return F.struct(parts.alias("parts"), blocks.alias("blocks"))

    def placed(state: Column) -> Column:
        gaps, found, sizes = (state["parts"][c] for c in ("gaps", "found", "sizes"))

        def one(m: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            before = _total(state["blocks"], F.lit(1), block) + _total(sizes, block * BLOCK + 1, i - block * BLOCK)
            return F.struct((before + F.length(gaps[i])).alias("start"), m.alias("match"))

        if chosen is None:
            return F.transform(found, one)
        numbered = F.transform(found, lambda m, i: F.struct(m.alias("match"), i.alias("i")))
        return F.transform(F.filter(numbered, lambda x: chosen(x["match"])), lambda x: one(x["match"], x["i"]))

    lists = F.struct(gaps.alias("gaps"), found.alias("found"))
    return _with(lists, lambda x: _with(sized(x), lambda y: _with(blocked(y), placed)))


def kind_spans(text: Column, kind: Kind, order: int) -> Column:
    """Array of spans of one kind; ``order`` sorts kinds that start at the same place."""
    found = places(text, kind.pattern)
    if kind.keep is not None:
        found = F.filter(found, lambda p: kind.keep(p["match"]))
    spans = F.transform(
        found,
        lambda p: F.struct(
            p["start"].alias("start"), F.lit(order).alias("ord"),
            (p["start"] + F.length(p["match"])).alias("end"), F.lit(kind.name).alias("kind"),
        ),
    )
    return F.when(text.rlike(kind.probe), spans).otherwise(no_spans())


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    return F.concat_ws(
        ",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    )


def of_kinds(spans: Column, names: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(names))


def masked(text: Column, spans: Column, label: Callable[[Column], Column]) -> Column:
    """``text`` with each span replaced by its label; overlapping spans become the first one's label."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, span: Column) -> Column:
        between = F.substring(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(span["start"] >= state["at"], F.concat(state["parts"], F.array(between, label(span))))
            .otherwise(state["parts"])
            .alias("parts"),
        )

    def finish(state: Column) -> Column:
        rest = F.substring(text, (state["at"] + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(state["parts"], ""), rest)

    return F.when(F.size(spans) > 0, F.aggregate(F.array_sort(spans), start, step, finish)).otherwise(text)
