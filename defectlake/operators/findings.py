"""Findings: dedup, rank, filter, cap, and per-finding projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlake import dims, scale, schemas
from defectlake.functions import findings as ff
from defectlake.functions.text import basename, language_of, nonempty, with_commas


def with_fingerprint(df: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``fingerprint`` and the tool-independent ``cross_tool_key``."""
    return df.withColumns(
        {
            "fingerprint": ff.fingerprint(F.col("bug_type"), F.col("tool"), F.col("stack"), strict),
            "cross_tool_key": ff.cross_tool_key(F.col("bug_type"), F.col("stack")),
        }
    )


def with_primary_location(df: DataFrame) -> DataFrame:
    """Fill a missing ``primary_location`` from the stack by the reporting tool's rule."""
    stack = F.col("stack")
    by_tool = (
        F.when(F.col("tool") == "valgrind", ff.memcheck_location(stack))
        .when(F.col("tool") == "helgrind", ff.helgrind_location(stack))
        .otherwise(ff.any_location(stack))
    )
    return df.withColumn(
        "primary_location", F.coalesce(F.col("primary_location"), by_tool, ff.any_location(stack))
    )


def kind_of(tool: str, kind: Column, severity: Column | None = None) -> tuple[Column, Column]:
    """Bug type and severity of a tool's kind (the block text for sanitizers; cppcheck also names a ``severity``)."""
    if tool == "valgrind":
        return dims.kind_columns(dims.MEMCHECK_KINDS, kind, ("unknown", "medium"))
    if tool == "helgrind":
        return dims.kind_columns(dims.HELGRIND_KINDS, kind, ("race_condition", "medium"))
    if tool == "infer":
        return dims.kind_columns(dims.INFER_KINDS, kind, ("unknown", "medium"))
    if tool == "cppcheck":
        bug = F.coalesce(dims.lookup(dims.CPPCHECK_KINDS, kind), F.lit("unknown"))
        return bug, F.coalesce(dims.lookup(dims.CPPCHECK_SEVERITIES, severity), F.lit("info"))
    if tool in ("asan", "lsan", "msan", "ubsan", "tsan"):
        return sanitizer_kind(kind)
    raise ValueError(f"no kind table for {tool!r}")


def classify_kind(df: DataFrame, tool: str, kind: str = "kind") -> DataFrame:
    """Add ``bug_type`` and ``severity`` for a tool's kind column (or block text for sanitizers)."""
    bug, severity = kind_of(tool, F.col(kind), F.col("severity") if tool == "cppcheck" else None)
    return df.withColumns({"bug_type": bug, "severity": severity})


def sanitizer_kind(block: Column) -> tuple[Column, Column]:
    """First listed pattern the block contains, ignoring case."""
    text = F.lower(block)
    bug, sev = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for pattern, b, s in dims.SANITIZER_PATTERNS:
        bug, sev = bug.when(text.contains(pattern), b), sev.when(text.contains(pattern), s)
    return bug.otherwise(F.lit("unknown")), sev.otherwise(F.lit("medium"))


def freed_block_columns(
    kind: Column, auxwhat: Column, stacks: Column, size: Column, count: Column, bug_type: Column, allocation: Column
) -> dict[str, Column]:
    """bug_type, free_info and allocation_info of an error: an invalid access to a freed block is a use after free.

    ``stacks`` are those of the error: of the access, the free and the allocation.
    """
    second, third = F.get(stacks, F.lit(1)), F.get(stacks, F.lit(2))
    freed = ff.use_after_free(kind, auxwhat, second)

    def info(stack: Column, how: Column) -> Column:
        return F.struct(
            size.cast("bigint").alias("size"), count.cast("bigint").alias("count"), stack.alias("stack"), how.cast("string").alias("kind")
        )

    return {
        "bug_type": F.when(freed, F.lit("use_after_free")).otherwise(bug_type),
        "free_info": F.when(freed & second.isNotNull(), info(second, F.lit("free"))),
        "allocation_info": F.when(freed & third.isNotNull(), info(third, F.lit(None))).otherwise(allocation),
    }


def reclassify_use_after_free(df: DataFrame) -> DataFrame:
    """Turn invalid accesses to freed blocks into use_after_free.

    Expects ``kind``, ``auxwhat`` and ``stacks`` (all stacks of the error) beside the finding columns.
    """
    columns = ("kind", "auxwhat", "stacks", "bytes_leaked", "alloc_count", "bug_type", "allocation_info")
    return df.withColumns(freed_block_columns(*[F.col(c) for c in columns]))


def rank_order() -> list[Column]:
    """Most severe first, then most bytes leaked, then file, then report order."""
    return [
        ff.severity_rank(F.col("severity")).asc(),
        F.coalesce(F.col("bytes_leaked"), F.lit(0)).desc(),
        F.coalesce(F.col("primary_location.file"), F.lit("")).asc(),
        F.col("ord").asc(),
    ]


def dedupe_findings(df: DataFrame) -> DataFrame:
    """One row per (scan, fingerprint): the most severe copy, the earliest among equals.

    An aggregate rather than a window: copies are folded before the shuffle, so a fingerprint with
    a third of all rows costs one row per map task.
    """
    df = df if "fingerprint" in df.columns else with_fingerprint(df)
    order = F.struct(ff.severity_rank(F.col("severity")), F.col("ord"))
    return scale.first_by(df, ["scan_id", "fingerprint"], order)


def mark_duplicates(df: DataFrame) -> DataFrame:
    """All rows, with ``duplicate_of`` = id of the copy that :func:`dedupe_findings` keeps."""
    df = df if "fingerprint" in df.columns else with_fingerprint(df)
    order = F.struct(ff.severity_rank(F.col("severity")), F.col("ord"))
    keys = ["scan_id", "fingerprint"]
    winners = scale.materialise(
        df.groupBy(*keys).agg(F.min_by("id", order).alias("__winner"), F.count(F.lit(1)).alias("n")),
        "winners",
    )
    heavy = winners.where(F.col("n") >= scale.HEAVY_ROWS).select(*keys)
    joined = scale.skewed_lookup(df, winners.drop("n"), keys, salt=["ord"], heavy=heavy)
    return joined.withColumn(
        "duplicate_of", F.when(F.col("__winner") != F.col("id"), F.col("__winner"))
    ).select(*df.columns)


def drop_uninformative(df: DataFrame) -> DataFrame:
    """Drop findings of unknown type that have neither source nor location."""
    bare = (
        (F.col("bug_type") == "unknown")
        & F.col("source_context").isNull()
        & F.col("primary_location").isNull()
    )
    return df.where(~bare)


def prioritise(df: DataFrame) -> DataFrame:
    """Sort by scan and priority (a range-partitioned sort, no per-scan task)."""
    return df.orderBy("scan_id", *rank_order())


def with_priority(df: DataFrame, name: str = "priority") -> DataFrame:
    """Add the 1-based place each finding has in its scan's priority order."""
    return scale.ordered_position(df, ["scan_id"], rank_order(), name)


def cap_findings(df: DataFrame, n: int | None = None) -> DataFrame:
    """The scan's findings with their ``rank`` in priority order; only the first ``n`` if given."""
    if n is None:
        return with_priority(df, "rank")
    return scale.top_n(df, ["scan_id"], rank_order(), n, salt=["ord"])


def page(df: DataFrame, number: int, size: int, keys=("scan_id",)) -> DataFrame:
    """Rows of one 0-based page per scan in priority order, each with the scan's ``total``."""
    # pages up to this one are all that has to be put in order
    placed = scale.top_n(df, list(keys), rank_order(), (number + 1) * size, salt=["ord"], rank_col="position")
    hit = placed.where(F.col("position") > number * size)
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    return hit.join(totals, list(keys))


def with_bug_function(df: DataFrame) -> DataFrame:
    """Add ``bug_function``: the first user function of the stack."""
    return df.withColumn("bug_function", ff.bug_function(F.col("stack")))


def with_bug_location(df: DataFrame) -> DataFrame:
    """Add ``bug_location``: 'file.c:12'."""
    return df.withColumn("bug_location", ff.bug_location(F.col("primary_location")))


def with_language(df: DataFrame, default: Column | str = "c") -> DataFrame:
    """Refine ``language`` from the extension of the primary file."""
    default = F.lit(default) if isinstance(default, str) else default
    file = F.col("primary_location.file")
    return df.withColumn(
        "language",
        F.when(file.isNotNull(), language_of(file, default)).otherwise(F.col("language")),
    )


def breakpoints(df: DataFrame) -> DataFrame:
    """Debugger stops: location, function, what to look for, and a watched address for UAF."""
    loc = F.col("primary_location")
    place = F.concat_ws(":", basename(loc["file"]), loc["line"].cast("string"))
    bug = F.col("bug_type")
    leaked = F.coalesce(F.nullif(F.col("bytes_leaked"), F.lit(0)).cast("string"), F.lit("?"))
    text = F.when(F.lit(False), "")
    for kind, template in dims.BREAKPOINT_TEXT.items():
        before, _, after = template.partition("{bytes}")
        shown = F.concat(F.lit(before), leaked, F.lit(after)) if after else F.lit(before)
        text = text.when(bug == kind, shown)
    address = F.get(F.col("stack"), F.lit(0))["address"]
    return df.where(nonempty(loc["file"]) & (loc["line"] != 0)).select(
        "scan_id",
        "ord",
        place.alias("location"),
        ff.bug_function(F.col("stack")).alias("function"),
        "bug_type",
        F.lit(None).cast("string").alias("condition"),
        F.when((bug == "use_after_free") & nonempty(address), address).alias("watchpoint"),
        text.otherwise(F.concat(F.upper(bug), F.lit(" at "), place)).alias("description"),
    )


def with_tips(df: DataFrame, tips: DataFrame | None = None) -> DataFrame:
    """Add ``tips`` for the language and defect type, or the language's default advice."""
    if tips is None:
        table = F.create_map(
            *[
                x
                for lang, bug, advice in _tip_rows()
                for x in (F.lit(f"{lang}/{bug}"), F.array(*[F.lit(t) for t in advice]))
            ]
        )

        def advice(bug):
            return F.try_element_at(table, F.concat_ws("/", F.col("language"), bug))

        empty = F.array().cast("array<string>")
        return df.withColumn("tips", F.coalesce(advice(F.col("bug_type")), advice(F.lit("*")), empty))
    exact = tips.select("language", "bug_type", F.col("tips").alias("__exact"))
    default = tips.where("bug_type = '*'").select("language", F.col("tips").alias("__default"))
    # few languages and types: without salts all findings would meet in a handful of tasks
    joined = scale.salted_lookup(df, exact, ["language", "bug_type"], salt=["ord"])
    joined = scale.salted_lookup(joined, default, ["language"], salt=["ord"])
    return joined.select(
        *df.columns,
        F.coalesce("__exact", "__default", F.array().cast("array<string>")).alias("tips"),
    )


def _tip_rows():
    for (lang, bug), advice in dims.TIPS.items():
        yield lang, bug, advice
        if lang == "c":
            yield "cpp", bug, advice


def issue_table(df: DataFrame, n: int | None = None) -> DataFrame:
    """Numbered issue list: severity, type, place, tool and bytes, as shown to a user; all unless ``n`` is given."""
    loc = F.col("primary_location")
    place = F.concat_ws(":", basename(loc["file"]), loc["line"].cast("string"))
    needed = df.select("scan_id", "ord", "severity", "bug_type", "primary_location", "tool", "bytes_leaked")
    return cap_findings(needed, n).select(
        "scan_id",
        F.col("rank").alias("number"),
        "severity",
        F.replace(F.col("bug_type"), F.lit("_"), F.lit(" ")).alias("type"),
        F.when(loc.isNotNull(), place).otherwise(F.lit("—")).alias("location"),
        "tool",
        F.coalesce(with_commas(F.nullif(F.col("bytes_leaked"), F.lit(0))), F.lit("—")).alias("bytes"),
    )


def finding_context_text(df: DataFrame, keep: Sequence[str | Column] = ("scan_id", "ord", "id")) -> DataFrame:
    """A deterministic text description of each finding (heading, stack, source, guidance) beside its ``keep`` columns."""
    bug, tool = F.col("bug_type"), F.col("tool")

    def truthy(col):
        return F.nullif(col, F.lit(0))

    def where_of(f):
        addr = F.coalesce(F.when(nonempty(f["address"]), f["address"]), F.lit("??"))
        return F.when(
            ff.has_location(f), F.concat(f["file"], F.lit(":"), f["line"].cast("string"))
        ).otherwise(addr)

    def name_of(f):
        return F.when(nonempty(f["function"]), f["function"]).otherwise(F.lit("??"))

    def frame_line(f, with_module):
        base = F.concat(
            F.lit("  #"), f["index"].cast("string"), F.lit(" "), name_of(f), F.lit(" at "), where_of(f)
        )
        if not with_module:
            return base
        shown = nonempty(f["module"]) & ~F.coalesce(f["module"].contains("vgpreload"), F.lit(False))
        return F.concat(
            base,
            F.when(shown, F.concat(F.lit(" ["), f["module"], F.lit("]"))).otherwise(F.lit("")),
        )

    stack = F.coalesce(F.col("stack"), F.array().cast(schemas.STACK))
    alloc = F.col("allocation_info")
    alloc_stack = F.coalesce(alloc["stack"], F.array().cast(schemas.STACK))
    user = F.filter(
        stack,
        lambda f: ff.has_location(f) & ~basename(f["file"]).isin(*dims.CONTEXT_LIBC_FILES),
    )

    def user_line(label, i):
        f = F.get(user, F.lit(i))
        return F.when(
            f.isNotNull(),
            F.concat(
                F.lit(label), name_of(f), F.lit(" at "), f["file"], F.lit(":"), f["line"].cast("string")
            ),
        )

    ctx = F.col("source_context")

    def marked(lines, first):
        return F.array_join(
            F.transform(
                lines,
                lambda text, i: F.concat(
                    F.when(i + first == ctx["location"]["line"], F.lit(" >>>")).otherwise(F.lit("    ")),
                    F.lit(" "),
                    F.lpad((i + first).cast("string"), 4, " "),
                    F.lit(" | "),
                    text,
                ),
            ),
            "\n",
        )

    def lines_of(text):
        return F.split(F.regexp_replace(text, r"\n\z", ""), "\n")

    full = F.when(
        nonempty(ctx["full_file_content"]),
        F.concat(
            F.lit("\nFULL SOURCE FILE ("), ctx["location"]["file"], F.lit("):\n"),
            marked(lines_of(ctx["full_file_content"]), F.lit(1)),
        ),
    )
    first_line = F.coalesce(F.nullif(ctx["function_start_line"], F.lit(0)), F.lit(1))
    function = F.when(
        nonempty(ctx["function_body"]),
        F.concat(
            F.lit("\nFUNCTION (starting line "), first_line.cast("string"), F.lit("):\n"),
            marked(lines_of(ctx["function_body"]), first_line),
        ),
    )
    before = F.slice(
        ctx["before_lines"],
        F.greatest(F.size(ctx["before_lines"]) - 4, F.lit(1)),
        F.lit(5),
    )

    def plain(lines):
        return F.transform(lines, lambda text: F.concat(F.lit("     | "), text))

    around = F.when(
        ctx.isNotNull(),
        F.array_join(
            F.concat(
                F.array(
                    F.concat(
                        F.lit("\nSOURCE AROUND ERROR ("), ff.location_text(ctx["location"]), F.lit("):")
                    )
                ),
                plain(before),
                F.array(F.concat(F.lit(" >>> | "), ctx["target_line"], F.lit("   <<< ERROR"))),
                plain(F.slice(ctx["after_lines"], 1, 5)),
            ),
            "\n",
        ),
    )
    guidance = F.when(F.lit(False), "")
    for column, value, text in dims.CONTEXT_GUIDANCE:
        guidance = guidance.when(F.col(column) == value, F.lit(text))
    size_text = F.coalesce(truthy(alloc["size"]).cast("string"), F.lit("?"))
    alloc_head = F.concat(
        F.lit("\n### Allocation Site ("),
        F.when(nonempty(alloc["kind"]), alloc["kind"]).otherwise(F.lit("unknown")),
        F.lit(", "),
        size_text,
        F.lit(" bytes)"),
    )
    parts = [
        F.concat(
            F.lit("## "), F.coalesce(dims.lookup(dims.CONTEXT_HEADINGS, bug), F.upper(bug))
        ),
        F.concat(F.lit("Tool: "), tool, F.lit(" | Severity: "), F.col("severity")),
        F.concat(F.lit("Message: "), F.col("message")),
        F.concat(F.lit("Bytes leaked: "), with_commas(truthy(F.col("bytes_leaked")))),
        F.concat(F.lit("Blocks: "), truthy(F.col("alloc_count")).cast("string")),
        F.when(nonempty(F.col("detail")), F.concat(F.lit("Detail: "), F.col("detail"))),
        F.when(F.size(stack) > 0, F.lit("\n### Error Stack Trace")),
        F.when(
            F.size(stack) > 0,
            F.array_join(F.transform(F.slice(stack, 1, 10), lambda f: frame_line(f, True)), "\n"),
        ),
        F.when(F.size(alloc_stack) > 0, alloc_head),
        F.when(
            F.size(alloc_stack) > 0,
            F.array_join(F.transform(F.slice(alloc_stack, 1, 6), lambda f: frame_line(f, False)), "\n"),
        ),
        user_line("\nUSER CODE RESPONSIBLE: ", 0),
        user_line("CALLED FROM: ", 1),
        F.coalesce(full, function, around),
        F.lit("\n### Analysis Instructions"),
        guidance,
    ]
    # concat_ws leaves out the null parts
    return df.select(*keep, F.concat_ws("\n", *parts).alias("context_text"))
