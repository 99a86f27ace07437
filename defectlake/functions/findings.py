"""Column functions on findings: fingerprints, locations, ranks and reclassification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from defectlake import dims, schemas
from defectlake.functions.text import basename, nonempty


def severity_rank(col: Column) -> Column:
    """critical=0 ... info=4, anything else 9."""
    return F.coalesce(dims.lookup({s: i for i, s in enumerate(dims.SEVERITIES)}, col), F.lit(9))


def risk_rank(col: Column) -> Column:
    """critical=0 ... low=3, anything else 4."""
    return F.coalesce(dims.lookup({s: i for i, s in enumerate(dims.TAINT_RISKS)}, col), F.lit(4))


def exploit_rank(col: Column) -> Column:
    """TRIVIAL=0 ... UNLIKELY=3, anything else 9."""
    return F.coalesce(dims.lookup({s: i for i, s in enumerate(dims.EXPLOITABILITY)}, col), F.lit(9))


def size_severity(size: Column) -> Column:
    """Severity of an allocation by its bytes."""
    return (
        F.when(size > 1_000_000, F.lit("high"))
        .when(size > 100_000, F.lit("medium"))
        .otherwise(F.lit("low"))
    )



def stack_key(stack: Column, strict: bool = False) -> Column:
    """'fn@file:line' of the first three frames.

    Frames without a function are left out when ``strict``; otherwise they count as '@file:line',
    so that tools that report no functions do not fold all their findings into one.
    """

    def keep(f):
        named = nonempty(f["function"])
        return named if strict else named | nonempty(f["file"])

    def show(f):
        return F.concat(
            F.coalesce(f["function"], F.lit("")),
            F.lit("@"),
            F.coalesce(f["file"], F.lit("None")),
            F.lit(":"),
            F.coalesce(f["line"].cast("string"), F.lit("None")),
        )

    top = F.slice(F.coalesce(stack, F.array().cast(schemas.STACK)), 1, 3)
    return F.concat_ws(":", F.transform(F.filter(top, keep), show))


def _capitals(col: Column, known) -> Column:
    """The text in capitals; ``known`` names are looked up, which costs less."""
    return F.coalesce(dims.lookup({name: name.upper() for name in known}, col), F.upper(col))


def fingerprint(bug_type: Column, tool: Column, stack: Column, strict: bool = False) -> Column:
    """16 hex digits that identify a finding across runs of the same tool."""
    key = F.concat(
        F.lit("BugType."), _capitals(bug_type, dims.BUG_TYPES), F.lit(":AnalysisTool."), _capitals(tool, dims.TOOLS), F.lit(":"),
        stack_key(stack, strict),
    )
    return F.substring(F.sha2(key, 256), 1, 16)


def cross_tool_key(bug_type: Column, stack: Column) -> Column:
    """Like the fingerprint but the same for all tools."""
    key = F.concat(F.lit("BugType."), _capitals(bug_type, dims.BUG_TYPES), F.lit(":"), stack_key(stack))
    return F.substring(F.sha2(key, 256), 1, 16)


def has_location(frame: Column) -> Column:
    """True when a frame has a file and a line."""
    return nonempty(frame["file"]) & F.coalesce(frame["line"] != 0, F.lit(False))


def first_location(stack: Column, *predicates) -> Column:
    """Location of the first frame that passes the first predicate any frame passes."""
    hits = F.concat(*[F.slice(F.filter(stack, p), 1, 1) for p in predicates])
    places = F.transform(hits, lambda f: schemas.location(f["file"], f["line"]))
    return F.get(places, F.lit(0))


def memcheck_location(stack: Column) -> Column:
    """User code first, then any frame with a location."""

    def user(f):
        return (
            has_location(f)
            & ~basename(f["file"]).isin(*dims.LIBC_FILES)
            & ~f["file"].startswith("/usr/")
            & ~f["file"].startswith("/build/")
            & ~F.coalesce(f["module"], F.lit("")).contains("vgpreload")
        )

    return first_location(stack, user, has_location)


def helgrind_location(stack: Column) -> Column:
    """First frame with a location outside /usr/."""
    return first_location(stack, lambda f: has_location(f) & ~f["file"].startswith("/usr/"))


def any_location(stack: Column) -> Column:
    """First frame with a location."""
    return first_location(stack, has_location)


def is_user_function(name: Column) -> Column:
    """A known name that does not start with an underscore."""
    return nonempty(name) & (name != "??") & ~name.startswith("_")


def bug_function(stack: Column) -> Column:
    """First user function of the stack, '??' when there is none."""
    first = F.get(F.filter(stack, lambda f: is_user_function(f["function"])), F.lit(0))
    return F.coalesce(first["function"], F.lit("??"))


def bug_location(loc: Column) -> Column:
    """'file.c:12', '??' without a location."""
    shown = F.concat(
        basename(F.coalesce(loc["file"], F.lit(""))),
        F.lit(":"),
        F.coalesce(loc["line"], F.lit(0)).cast("string"),
    )
    return F.when(loc.isNotNull(), shown).otherwise(F.lit("??"))


def location_text(loc: Column) -> Column:
    """'path/file.c:12[:3]'."""
    return F.when(
        loc.isNotNull(),
        F.concat_ws(
            ":", loc["file"], loc["line"].cast("string"), F.nullif(loc["column"], F.lit(0)).cast("string")
        ),
    )


def use_after_free(kind: Column, auxwhat: Column, second_stack: Column) -> Column:
    """An invalid access is a use after free when the block is known to have been freed."""
    freed = F.coalesce(auxwhat.contains("free'd"), F.lit(False))
    free_frame = F.coalesce(
        F.exists(
            second_stack,
            lambda f: F.coalesce(f["function"].isin(*dims.STACK_DEALLOCATORS), F.lit(False)),
        ),
        F.lit(False),
    )
    return kind.isin("InvalidRead", "InvalidWrite") & (freed | free_frame)


def corrected_cwe(bug_type: Column, cwe_ids: Column) -> Column:
    """Put the expected weakness ids in front when none of them is listed."""
    table = F.create_map(
        *[
            x
            for bug, ids in dims.EXPECTED_CWE.items()
            for x in (F.lit(bug), F.array(*[F.lit(i) for i in ids]))
        ]
    )
    expected = F.try_element_at(table, bug_type)
    listed = F.coalesce(cwe_ids, F.array().cast("array<string>"))
    return F.when(
        expected.isNotNull() & ~F.arrays_overlap(expected, listed), F.concat(expected, listed)
    ).otherwise(listed)
