"""Memory-management roles of functions, leak feasibility and fix auditing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from defectlake import dims, scale
from defectlake.functions.text import alternation, quoted, regex_escape, strip, text_lines
from defectlake.operators.corpus import FUNCTION_KEY, function_lines

ALLOC_CALL = rf"\b(?:{alternation(dims.KNOWN_ALLOCATORS)})\s*\("
#: names in one pattern row
PATTERN_NAMES = 500
FREE_CALL = rf"\b(?:{alternation(dims.KNOWN_DEALLOCATORS)})\s*\("
FREE_VARIABLE = rf"(?:{alternation(dims.KNOWN_DEALLOCATORS)})\s*\((\w+)"
BRANCH_LINE = r"^(?:if|else|switch|while|for)\b"
RETURN_LINE = r"^return\b"


def classify_lines(functions: DataFrame, rows: int | None = None) -> DataFrame:
    """Node type and variable of every code line: BRANCH, RETURN, FREE, ALLOC or CALL; ``rows`` counts the functions, if known."""
    text = F.col("text")
    code = function_lines(functions, rows).where(
        (text != "") & ~text.startswith("//") & ~text.startswith("/*")
    )
    kind = (
        F.when(text.rlike(BRANCH_LINE), "BRANCH")
        .when(text.rlike(RETURN_LINE), "RETURN")
        .when(text.rlike(FREE_CALL), "FREE")
        .when(text.rlike(ALLOC_CALL), "ALLOC")
        .otherwise("CALL")
    )
    assigned = F.regexp_extract(text, r"^(\w+)\s*=", 1)
    made = F.when(text.rlike(ALLOC_CALL), assigned).otherwise(F.lit(""))
    freed = F.when(text.rlike(FREE_CALL), F.regexp_extract(text, FREE_VARIABLE, 1)).otherwise("")
    returned = F.regexp_extract(text, r"^return\s+(\w+)", 1)

    def or_else(first: Column, then: Column) -> Column:
        return F.when(first != "", first).otherwise(then)

    # a later class overwrites the variable only when it finds one
    variable = (
        F.when(F.col("node_type") == "BRANCH", F.lit(""))
        .when(F.col("node_type") == "RETURN", or_else(returned, or_else(freed, made)))
        .otherwise(or_else(freed, made))
    )
    condition = F.when(
        F.col("node_type") == "BRANCH", F.regexp_extract(text, r"(?:if|while)\s*\((.+?)\)", 1)
    ).otherwise(F.lit(""))
    return code.withColumn("node_type", kind).select(
        *FUNCTION_KEY,
        (F.col("pos") + 1).alias("line"),
        "node_type",
        variable.alias("variable"),
        condition.alias("condition"),
        F.col("text").alias("code"),
    )


def callees(functions: DataFrame) -> DataFrame:
    """Distinct names called in a body, without the function itself."""
    names = F.array_distinct(F.regexp_extract_all("body", F.lit(r"\b(\w+)\s*\("), F.lit(1)))
    return functions.select(
        "corpus_id", F.col("name").alias("function"), F.explode(names).alias("callee")
    ).where(F.col("callee") != F.col("function")).distinct()


def validate_role(
    summaries: DataFrame, functions: DataFrame, strict: bool = False
) -> DataFrame:
    """Accept or reject (corpus_id, name, role, target) claims from the code.

    An allocator holds when its body allocates and returns, or a callee (or its callee) is a known
    allocator. A deallocator holds when a free names a variable; when it frees nothing itself, a
    callee (or its callee) must be a known deallocator. ``strict`` wants the freed variable to be
    the parameter ``target`` names. Claims about functions without source are kept.

    Functions are written once, since they are read for their lines, callees and parameters.
    """
    functions = scale.materialise(functions, "functions")
    rows = functions.count()
    nodes = classify_lines(functions, rows)
    body = nodes.groupBy("corpus_id", F.col("function").alias("name")).agg(
        F.bool_or(F.col("node_type") == "ALLOC").alias("allocs"),
        F.bool_or(F.col("node_type") == "RETURN").alias("returns"),
        F.bool_or(F.col("node_type") == "FREE").alias("frees"),
        F.collect_set(
            F.when((F.col("node_type") == "FREE") & (F.col("variable") != ""), F.col("variable"))
        ).alias("freed"),
    )
    direct = callees(scale.spread(functions, rows))
    flags = direct.groupBy("corpus_id", "function").agg(
        F.bool_or(F.col("callee").isin(*dims.KNOWN_ALLOCATORS)).alias("calls_alloc"),
        F.bool_or(F.col("callee").isin(*dims.KNOWN_DEALLOCATORS)).alias("calls_free"),
    )
    # second hop: only callees that call an allocator or deallocator themselves take part
    wrappers = flags.where(F.col("calls_alloc") | F.col("calls_free")).select(
        "corpus_id",
        F.col("function").alias("callee"),
        F.col("calls_alloc").alias("far_alloc"),
        F.col("calls_free").alias("far_free"),
    )
    far = (
        direct.join(scale.sorted_side(wrappers), ["corpus_id", "callee"])
        .groupBy("corpus_id", "function")
        .agg(F.bool_or("far_alloc").alias("far_alloc"), F.bool_or("far_free").alias("far_free"))
    )
    params = scale.first_by(
        functions.select("corpus_id", "name", "params", "file", "start_line"),
        ["corpus_id", "name"],
        F.struct("file", "start_line"),
    ).select("corpus_id", "name", "params")
    no = F.lit(False)
    keyed = (
        summaries.join(scale.sorted_side(params), ["corpus_id", "name"], "left")
        .join(scale.sorted_side(body), ["corpus_id", "name"], "left")
        .join(scale.sorted_side(flags.withColumnRenamed("function", "name")), ["corpus_id", "name"], "left")
        .join(scale.sorted_side(far.withColumnRenamed("function", "name")), ["corpus_id", "name"], "left")
    )

    def flag(name):
        return F.coalesce(F.col(name), no)

    param = F.get("params", F.coalesce(F.regexp_extract("target", r"^arg(\d+)$", 1).try_cast("int"), F.lit(0)))
    named = F.size(F.coalesce("freed", F.array().cast("array<string>"))) > 0
    if strict:
        named = F.coalesce(F.array_contains("freed", param), no)
    allocator = (flag("allocs") & flag("returns")) | flag("calls_alloc") | flag("far_alloc")
    deallocator = F.when(flag("frees"), named).otherwise(flag("calls_free") | flag("far_free"))
    valid = F.when(F.col("params").isNull(), F.lit(True)).when(
        F.col("role") == "Allocator", allocator
    ).otherwise(deallocator)
    return keyed.select(*[c for c in summaries.columns if c != "validated"], valid.alias("validated"))


def role_funnel(functions: DataFrame, candidates: DataFrame, summaries: DataFrame) -> DataFrame:
    """Per corpus: extracted, candidates, summaries, validated, allocators, deallocators."""

    def tagged(df: DataFrame, **flags: Column) -> DataFrame:
        names = ("extracted", "candidates", "summaries", "validated", "allocators", "deallocators")
        zero = F.lit(0)
        return df.select(
            "corpus_id", *[flags.get(n, zero).cast("bigint").alias(n) for n in names]
        )

    one = F.lit(1)
    ok = F.col("validated").cast("int")
    is_alloc = (F.col("role") == "Allocator").cast("int")
    parts = (
        tagged(functions, extracted=one)
        .unionByName(tagged(candidates, candidates=one))
        .unionByName(
            tagged(
                summaries,
                summaries=one,
                validated=ok,
                allocators=ok * is_alloc,
                deallocators=ok * (1 - is_alloc),
            )
        )
    )
    names = [c for c in parts.columns if c != "corpus_id"]
    return parts.groupBy("corpus_id").agg(*[F.sum(c).alias(c) for c in names])


def role_patterns(summaries: DataFrame, escape: bool = True) -> DataFrame:
    """Per corpus and role: ``^(a|b)$`` over the validated names, at most PATTERN_NAMES in one row.

    A name matches when it matches any of its role's patterns.
    """
    name = regex_escape(F.col("name")) if escape else F.col("name")
    distinct = summaries.where("validated").select("corpus_id", "role", name.alias("n")).distinct()
    placed = scale.ordered_position(distinct, ["corpus_id", "role"], [F.asc("n")], "place")
    part = F.floor((F.col("place") - 1) / PATTERN_NAMES).cast("int")
    return placed.groupBy("corpus_id", "role", part.alias("part")).agg(
        F.concat(F.lit("^("), F.array_join(F.array_sort(F.collect_list("n")), "|"), F.lit(")$")).alias("pattern")
    )


def role_documents(summaries: DataFrame) -> DataFrame:
    """One ``{"hints": {name: [...]}}`` document per summary name (a JSON line each)."""
    entry = F.array(F.struct("name", "role", "target", "validated", "confidence"))
    return summaries.select(
        F.to_json(F.struct(F.create_map("name", entry).alias("hints"))).alias("value")
    )


def write_role_summaries(summaries: DataFrame, path: str) -> None:
    """Write the documents of :func:`role_documents` as text."""
    role_documents(summaries).write.text(path)


# -- leak feasibility -------------------------------------------------------------------------
ESCAPES = (r"(\w+)->(\w+)\s*=\s*(\w+)", r"(\w+)\[.*\]\s*=\s*(\w+)", r"return\s+(\w+)")


def leak_feasibility(
    warnings: DataFrame,
    source_lines: DataFrame,
    allocators: list[str] | None = None,
    deallocators: list[str] | None = None,
) -> DataFrame:
    """Is a leak warning feasible: allocated, never freed, ownership never passed on.

    ``warnings`` are (warning_id, variable); ``source_lines`` are (warning_id, line_no, text) of the
    function warned about. Without a variable the first allocated one is used, from its line on.
    """
    alloc = rf"\b(?:{alternation([*dims.KNOWN_ALLOCATORS, *(allocators or [])])})\s*\("
    free = rf"\b(?:{alternation([*dims.KNOWN_DEALLOCATORS, *(deallocators or [])])})\s*\("
    text = F.col("text")
    lines = source_lines.join(warnings.select("warning_id", "variable"), "warning_id").select(
        "warning_id", "line_no", F.nullif("variable", F.lit("")).alias("variable"), strip(text).alias("text")
    )
    is_alloc = text.rlike(alloc)
    assigned = F.nullif(F.regexp_extract(text, r"(\w+)\s*=[^=]", 1), F.lit(""))
    # the line from which the variable is known, as one aggregate per warning
    first = lines.where(is_alloc & assigned.isNotNull()).groupBy("warning_id").agg(
        F.min_by(F.struct(F.col("line_no").alias("known_at"), assigned.alias("known")), F.col("line_no")).alias("f")
    )
    joined = lines.join(first, "warning_id", "left").withColumn(
        "var",
        F.coalesce(
            F.col("variable"),
            F.when(F.col("line_no") >= F.col("f.known_at"), F.col("f.known")),
        ),
    )
    names = F.coalesce(text.contains(F.col("var")), F.lit(False))
    freed = text.rlike(free) & names
    escape = F.lit(False)
    for pattern in ESCAPES:
        escape = escape | text.rlike(pattern)
    escaped = escape & names & ~is_alloc
    flags = joined.groupBy("warning_id").agg(
        F.max(F.when(is_alloc, F.col("line_no"))).alias("alloc_line"),
        F.array_sort(F.collect_list(F.when(freed, F.col("line_no")))).alias("free_lines"),
        F.array_sort(F.collect_list(F.when(escaped, F.col("line_no")))).alias("escape_lines"),
    )

    def listed(col: str) -> Column:
        return F.array_join(F.transform(col, lambda n: n.cast("string")), ",")

    has_free, has_escape = F.size("free_lines") > 0, F.size("escape_lines") > 0
    feasible = F.col("alloc_line").isNotNull() & ~has_free & ~has_escape
    # The sentences of the reasons.
    reason = (
        F.when(
            feasible,
            F.concat(
                F.lit("Feasible leak: allocated at line "), F.col("alloc_line").cast("string"),
                F.lit(", never freed, no escape"),
            ),
        )
        .when(has_escape, F.concat(F.lit("ownership transferred at line(s) "), listed("escape_lines")))
        .when(has_free, F.concat(F.lit("freed on all paths at line(s) "), listed("free_lines")))
        .otherwise(F.lit("infeasible"))
    )
    return flags.select("warning_id", feasible.alias("feasible"), reason.alias("reason"))


def _leaks(df: DataFrame, code: str, variable: Column, alloc: str, free: str) -> Column:
    """Leak flag of a code column (row-local: the lines never leave their row)."""
    lines = F.transform(text_lines(F.coalesce(F.col(code), F.lit(""))), strip)
    var = quoted(variable)

    def any_line(test) -> Column:
        return F.coalesce(F.exists(lines, test), F.lit(False))

    made = any_line(lambda x: x.rlike(alloc))
    freed = any_line(lambda x: x.rlike(free) & x.contains(variable))
    arrow = F.concat(F.lit(r"->(\w+)\s*=\s*"), var)
    passed = any_line(lambda x: F.regexp_like(x, arrow)) & (variable != "")
    returned = any_line(lambda x: F.regexp_like(x, F.concat(F.lit(r"return\s+"), var)))
    return made & ~freed & ~(passed | returned)


def proof_of_fix(
    fixes: DataFrame, allocators: list[str] | None = None, deallocators: list[str] | None = None
) -> DataFrame:
    """Does the fixed code no longer leak ``variable``: proven, both flags and a sentence."""
    alloc = rf"\b(?:{alternation([*dims.KNOWN_ALLOCATORS, *(allocators or [])])})\s*\("
    free = rf"\b(?:{alternation([*dims.KNOWN_DEALLOCATORS, *(deallocators or [])])})\s*\("
    var = F.col("variable")
    before, after = F.col("original_sat"), F.col("fixed_sat")
    flagged = fixes.select(
        "fix_id",
        _leaks(fixes, "original_code", var, alloc, free).alias("original_sat"),
        _leaks(fixes, "fixed_code", var, alloc, free).alias("fixed_sat"),
    )
    return flagged.select(
        "fix_id",
        (before & ~after).alias("proven"),
        "original_sat",
        "fixed_sat",
        # The sentences of the verdict.
        F.when(before & ~after, F.lit("Fix PROVEN correct: original has feasible leak, fix eliminates it"))
        .when(~before, F.lit("Original code has no feasible leak (may be ownership transfer)"))
        .otherwise(F.lit("Fix does NOT eliminate the leak — still feasible after fix"))
        .alias("explanation"),
    )


# -- fixes ------------------------------------------------------------------------------------
def audit_fix_safety(fixes: DataFrame) -> DataFrame:
    """Flag fixes whose replacement uses a variable after freeing it or frees what it just made.

    Adds ``warning``; a flagged fix gets confidence low and applicable false, others keep theirs
    (an unknown confidence counts as medium).
    """
    # a fix becomes several lines and words: a task takes a share of the fixes that doesn't grow with their number
    fixes = scale.spread(fixes, fixes.count())
    lines = fixes.select(
        "fix_id", F.posexplode(text_lines(strip(F.coalesce("replace_text", F.lit(""))))).alias("pos", "raw")
    ).withColumn("text", strip(F.col("raw")))
    word = r"\b(\w+)\b"
    freed_here = F.regexp_extract("text", r"free\s*\(\s*(\w+)\s*\)", 1)
    frees = lines.where(freed_here != "").select("fix_id", F.col("pos").alias("free_pos"), freed_here.alias("var"))
    # Uses meet frees by variable name, and each variable keeps its first use after each free.
    uses = lines.select(
        "fix_id", "pos", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(word), F.lit(1)))).alias("var")
    )
    var = F.col("var")
    safe = F.expr(
        r"""regexp_like(text, '^' || var || '\\s*=')
            OR regexp_like(text, '^if\\s*\\(\\s*!?\\s*' || var)
            OR regexp_like(text, 'free\\s*\\(\\s*' || var)"""
    )
    unsafe = uses.where(~safe)
    after_free = (
        frees.join(scale.sorted_side(unsafe), ["fix_id", "var"])
        .where(F.col("pos") > F.col("free_pos"))
        .groupBy("fix_id")
        .agg(F.min(F.struct(F.col("free_pos"), F.col("pos"), var)).alias("u"))
    )
    made_here = F.regexp_extract("text", r"(\w+)\s*=\s*(?:malloc|calloc)", 1)
    next_text = F.lead("text").over(Window.partitionBy("fix_id").orderBy("pos"))
    made = F.when(F.col("raw").rlike(r"malloc\s*\(|calloc\s*\("), F.nullif(made_here, F.lit("")))
    useless = (
        lines.withColumns({"made": made, "next": next_text})
        .where(F.expr(r"made IS NOT NULL AND regexp_like(next, 'free\\s*\\(\\s*' || made || '\\s*\\)')"))
        .groupBy("fix_id")
        .agg(F.min(F.struct("pos", F.col("made").alias("var"))).alias("m"))
    )
    warning = F.coalesce(
        F.when(
            F.col("u").isNotNull(),
            F.concat(
                F.lit("Use-after-free: '"), F.col("u.var"), F.lit("' freed on line "),
                (F.col("u.free_pos") + 1).cast("string"), F.lit(" but used on line "),
                (F.col("u.pos") + 1).cast("string"),
            ),
        ),
        F.when(
            F.col("m").isNotNull(),
            F.concat(F.lit("Useless allocation: '"), F.col("m.var"), F.lit("' freed immediately after malloc")),
        ),
    )
    given = F.col("confidence") if "confidence" in fixes.columns else F.lit("medium")
    usable = F.col("applicable") if "applicable" in fixes.columns else F.lit(True)
    rest = [c for c in fixes.columns if c not in ("confidence", "applicable")]
    return (
        fixes.join(scale.sorted_side(after_free), "fix_id", "left")
        .join(scale.sorted_side(useless), "fix_id", "left")
        .withColumn("warning", warning)
        .select(
            *rest,
            "warning",
            F.when(F.col("warning").isNotNull(), F.lit("low"))
            .when(given.isin(*dims.CONFIDENCES), given)
            .otherwise(F.lit("medium"))
            .alias("confidence"),
            (F.col("warning").isNull() & F.coalesce(usable, F.lit(True))).alias("applicable"),
        )
    )


def locate_fix(fixes: DataFrame, source_lines: DataFrame) -> DataFrame:
    """First place where a fix's find-lines equal the file's lines after trimming.

    ``fixes`` are (fix_id, file, find_text, replace_text), ``source_lines`` (file, line_no, text).
    Division by joining on the text: a start line where every find-line has its partner is a
    place. Only the rarest find-line of a fix proposes starts, so a line that is everywhere (a
    brace, a blank) does not multiply the candidates.
    """
    lines = source_lines.select("file", "line_no", strip(F.col("text")).alias("norm"))
    find = fixes.select(
        "fix_id", "file", F.posexplode(text_lines(F.col("find_text"))).alias("pos", "raw")
    ).select("fix_id", "file", "pos", strip(F.col("raw")).alias("norm"))
    wanted = find.groupBy("fix_id").agg(F.count(F.lit(1)).alias("n_find"))
    frequency = lines.groupBy("file", "norm").agg(F.count(F.lit(1)).alias("n"))
    anchors = (
        find.join(scale.sorted_side(frequency), ["file", "norm"])
        .groupBy("fix_id", "file")
        .agg(F.min_by(F.struct("pos", "norm"), F.struct("n", "pos")).alias("a"))
        .select("fix_id", "file", F.col("a.pos").alias("anchor"), F.col("a.norm").alias("norm"))
    )
    starts = anchors.join(scale.sorted_side(lines), ["file", "norm"]).select(
        "fix_id", "file", (F.col("line_no") - F.col("anchor")).alias("start")
    ).where(F.col("start") >= 1)
    # each start asks for its own lines by number: an equi-join on (file, line_no)
    asked = starts.join(scale.sorted_side(find.select("fix_id", "pos", "norm")), "fix_id").withColumn(
        "line_no", F.col("start") + F.col("pos")
    )
    matched = (
        asked.join(scale.sorted_side(lines), ["file", "line_no", "norm"])
        .groupBy("fix_id", "file", "start")
        .agg(F.count(F.lit(1)).alias("n_hit"))
        .join(scale.sorted_side(wanted), "fix_id")
        .where(F.col("n_hit") == F.col("n_find"))
        .groupBy("fix_id")
        .agg(F.min("start").alias("start"))
    )
    length = lines.groupBy("file").agg(F.max("line_no").alias("n_lines"))
    n_replace = F.when(
        F.coalesce(F.length("replace_text"), F.lit(0)) > 0, F.size(text_lines(F.col("replace_text")))
    ).otherwise(0)
    start, n_find = F.col("start"), F.col("n_find")
    before = F.least(start - 1, F.lit(2))
    after = F.least(F.col("n_lines") - (start + n_find - 1), F.lit(2))
    return (
        fixes.join(scale.sorted_side(wanted), "fix_id", "left")
        .join(scale.sorted_side(matched), "fix_id", "left")
        .join(scale.sorted_side(length), "file", "left")
        .select(
            "fix_id",
            "file",
            start.isNotNull().alias("applicable"),
            start.alias("match_line"),
            F.when(start.isNull(), F.lit("@@ fix @@"))
            .otherwise(
                F.concat(
                    F.lit("@@ -"), (start - before).cast("string"), F.lit(","),
                    (before + n_find + after).cast("string"), F.lit(" +"),
                    (start - before).cast("string"), F.lit(","),
                    (before + n_replace + after).cast("string"), F.lit(" @@"),
                )
            )
            .alias("hunk_header"),
        )
    )
