"""Symbols and source text joined to findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from defectlake import scale, schemas
from defectlake.functions.text import nonempty

CONTEXT_LINES = 8
SNIPPET_FRAMES = 5
#: a function's first line is looked for in this many lines up to the finding's; lines lie in blocks of this size
HEADER_LINES = 80
#: lines of a function that are shown, and the least length of its text
BODY_LINES, BODY_CHARS = 150, 20
#: What the first line of a function looks like
HEADER, PYTHON_HEADER = r"\)\s*\{?\s*$", r"^(def |async def )"


def resolve_frames(findings: DataFrame, symbols: DataFrame, keys=("scan_id", "ord")) -> DataFrame:
    """Fill function, file and line of frames without a place from ``symbols`` by address.

    Only the frames that need it travel: their distinct addresses are resolved, and the resolved
    frames return to their finding. Names that are '??' or empty are not taken over.
    """
    keys = list(keys)
    needs = F.filter(
        "stack",
        lambda f: nonempty(f["address"]) & ~(nonempty(f["file"]) & F.coalesce(f["line"] != 0, F.lit(False))),
    )
    wanted = findings.select(*keys, F.explode(F.array_distinct(F.transform(needs, lambda f: f["address"]))).alias("address"))

    def usable(name: str) -> Column:
        col = F.col(name)
        return F.when(nonempty(col) & (col != "??"), col)

    table = symbols.select(
        "address",
        usable("function").alias("function"),
        usable("file").alias("file"),
        F.nullif(F.col("line"), F.lit(0)).cast("int").alias("line"),
    ).dropDuplicates(["address"])
    # an address that very many frames share (malloc) is salted
    found = scale.skewed_lookup(wanted, table, ["address"], salt=keys, how="inner")
    resolved = found.groupBy(*keys).agg(
        F.map_from_entries(
            F.collect_list(F.struct("address", F.struct("function", "file", "line")))
        ).alias("__symbols")
    )

    def fill(f):
        s = F.try_element_at(F.col("__symbols"), f["address"])
        missing = ~(nonempty(f["file"]) & F.coalesce(f["line"] != 0, F.lit(False)))
        known = missing & s.isNotNull()
        return F.when(
            known,
            f.withField("function", F.coalesce(s["function"], f["function"]))
            .withField("file", F.coalesce(s["file"], f["file"]))
            .withField("line", F.coalesce(s["line"], f["line"])),
        ).otherwise(f)

    return (
        findings.join(resolved, keys, "left")
        .withColumn(
            "stack",
            F.when(F.col("__symbols").isNull(), F.col("stack")).otherwise(F.transform("stack", fill)),
        )
        .drop("__symbols")
    )


def _block(line: Column) -> Column:
    return F.floor(line / HEADER_LINES)


def near_lines(places: DataFrame, source_lines: DataFrame) -> DataFrame:
    """The lines near ``places``, stored in blocks: (scan_id, file, block, lines, heads, heads_python).

    Every later search (the lines around a place, the first line of its function, the function's text) meets whole blocks
    by an equi-join, so a place asks for a few blocks and not for its line numbers one by one. ``heads`` are the numbers of
    those lines that look like a function's first.
    """
    file = ["scan_id", "file"]
    at = _block(F.col("line"))
    near = places.select(*file, F.explode(F.sequence(at - 1, at + 2)).alias("block")).distinct()
    blocks = (
        source_lines.select(*file, "line_no", "text", _block(F.col("line_no")).alias("block"))
        .join(scale.sorted_side(near), [*file, "block"], "left_semi")
        .groupBy(*file, "block")
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("lines"))
    )

    def like(pattern: str) -> Column:
        return F.transform(F.filter("lines", lambda x: x["text"].rlike(pattern)), lambda x: x["line_no"])

    return scale.materialise(blocks.select("*", like(HEADER).alias("heads"), like(PYTHON_HEADER).alias("heads_python")), "near_lines")


def line_windows(places: DataFrame, blocks: DataFrame, before: int, after: int) -> DataFrame:
    """The lines around distinct (scan_id, file, line) places, as an ordered array, from the blocks of :func:`near_lines`.

    ``before`` and ``after`` are at most ``HEADER_LINES``. A block is small and met by few places, so a hot file splits evenly.
    """
    line = F.col("line")
    around = F.filter("lines", lambda x: (x["line_no"] >= F.greatest(line - before, F.lit(1))) & (x["line_no"] <= line + after))
    return (
        places.select("scan_id", "file", "line", F.explode(F.sequence(_block(line - before), _block(line + after))).alias("block"))
        .join(scale.sorted_side(blocks.select("scan_id", "file", "block", "lines")), ["scan_id", "file", "block"])
        .select("scan_id", "file", "line", around.alias("around"))
        .where(F.size("around") > 0)
        .groupBy("scan_id", "file", "line")
        .agg(F.array_sort(F.flatten(F.collect_list("around"))).alias("around"))
    )


def _body(texts: str, start: Column, number: DataType) -> Column:
    """The text of the function that begins at line ``start``, from the lines there and after it."""

    def braces(text: Column) -> Column:
        return F.length(F.replace(text, F.lit("}"), F.lit(""))) - F.length(F.replace(text, F.lit("{"), F.lit("")))

    def walk(seen: Column, x: Column) -> Column:
        depth = seen["depth"] + braces(x["text"])
        closed = (depth < 0) | ((depth == 0) & (x["line_no"] > start + 2))
        return F.struct(depth.alias("depth"), F.coalesce(seen["end"], F.when(closed, x["line_no"])).alias("end"))

    begin = F.struct(F.lit(0).alias("depth"), F.lit(None).cast(number).alias("end"))
    end = F.coalesce(F.aggregate(texts, begin, walk, lambda seen: seen["end"]), start + BODY_LINES)
    return F.array_join(F.transform(F.filter(texts, lambda x: x["line_no"] <= end), lambda x: x["text"]), "\n")


def enclosing_functions(places: DataFrame, blocks: DataFrame) -> DataFrame:
    """``places`` (scan_id, file, line, language) with function_body and function_start_line.

    A function begins at the last line up to the place that looks like a function's first line, or at the place itself if
    none of ``HEADER_LINES`` lines does. It ends where its braces are closed again, past its third line, after ``BODY_LINES``
    lines or with the file. Both are null for a text of ``BODY_CHARS`` characters or less.

    ``blocks`` are those of :func:`near_lines`. A place meets the first lines of its own block and of
    the one before, so the search backward is an equi-join; bodies are put together once per function, from three blocks.
    """
    file, key = ["scan_id", "file"], ["scan_id", "file", "line", "language"]
    at = _block(F.col("line"))
    line = F.col("line")
    heads = blocks.where((F.size("heads") > 0) | (F.size("heads_python") > 0)).select(*file, "block", "heads", "heads_python")
    own = F.when(F.col("language") == "python", F.col("heads_python")).otherwise(F.col("heads"))
    last = F.array_max(F.filter(own, lambda n: (n <= line) & (n > line - HEADER_LINES)))
    started = (
        places.select(*key, F.explode(F.array(at - 1, at)).alias("block"))
        .join(scale.sorted_side(heads), [*file, "block"], "left")
        .groupBy(*key)
        .agg(F.coalesce(F.max(last), line).cast("int").alias("start"))
    )
    started = scale.materialise(started, "started")
    start, first = F.col("start"), _block(F.col("start"))
    texts = F.filter(
        F.array_sort(F.flatten(F.collect_list("lines"))), lambda x: (x["line_no"] >= start) & (x["line_no"] < start + BODY_LINES)
    )
    body = _body("texts", start, blocks.schema["lines"].dataType.elementType["line_no"].dataType)
    bodies = (
        started.select(*file, "start").distinct()
        .select(*file, "start", F.explode(F.sequence(first, first + 2)).alias("block"))
        .join(scale.sorted_side(blocks.select(*file, "block", "lines")), [*file, "block"])
        .groupBy(*file, "start")
        .agg(texts.alias("texts"))
        .select(*file, "start", body.alias("body"))
        .where(F.length("body") > BODY_CHARS)
        .select(*file, "start", F.col("body").alias("function_body"), start.alias("function_start_line"))
    )
    return started.join(scale.sorted_side(bodies), [*file, "start"], "left").drop("start")


def attach_source_context(
    findings: DataFrame, source_lines: DataFrame, full_file_lines: int | None = None
) -> DataFrame:
    """Add ``source_context``: lines around the primary location, the enclosing function, and the whole file.

    ``full_file_lines`` keeps whole texts to files of fewer lines. The finding's ``language``, if there is that column,
    says what a function looks like.

    With whole files asked for, the lines of a file are moved once, to one row; findings meet that row and cut all texts from it
    (:func:`_from_whole_files`). Otherwise places are made distinct first, so copies of a finding cost one lookup, and the contexts
    return to the findings through a join that salts places with very many findings.
    """
    loc = F.col("primary_location")
    language = F.coalesce("language", F.lit("unknown")) if "language" in findings.columns else F.lit("unknown")
    placed = findings.withColumns({"__file": loc["file"], "__line": loc["line"], "__language": language})
    base = placed.drop("source_context") if "source_context" in findings.columns else placed
    if full_file_lines is None:
        return _from_whole_files(base, source_lines).drop("__file", "__line", "__language")
    spoken = (
        placed.where(_is_placed())
        .select("scan_id", F.col("__file").alias("file"), F.col("__line").alias("line"), F.col("__language").alias("language"))
        .distinct()
    )
    places = spoken.select("scan_id", "file", "line").distinct()
    blocks = near_lines(places, source_lines)
    windows = line_windows(places, blocks, CONTEXT_LINES, CONTEXT_LINES)
    files = places.select("scan_id", "file").distinct()
    sizes = source_lines.groupBy("scan_id", "file").agg(F.max("line_no").alias("n_lines"))
    short = files.join(scale.sorted_side(sizes.where(F.col("n_lines") < full_file_lines)), ["scan_id", "file"], "left_semi")
    whole = _whole_files(short, source_lines).select("scan_id", "file", _joined("lines").alias("full_file_content"))
    functions = enclosing_functions(spoken, blocks)
    found = windows.join(scale.sorted_side(functions), ["scan_id", "file", "line"]).join(scale.sorted_side(whole), ["scan_id", "file"], "left")
    context = found.select(
        "scan_id",
        F.col("file").alias("__file"),
        F.col("line").alias("__line"),
        F.col("language").alias("__language"),
        _context("file", "line", "language").alias("source_context"),
    )
    joined = scale.skewed_lookup(base, context, ["scan_id", "__file", "__line", "__language"], salt=["ord"], unsized=True)
    return joined.drop("__file", "__line", "__language")


def _is_placed() -> Column:
    return nonempty(F.col("__file")) & (F.col("__line") > 0)


def _joined(lines: str) -> Column:
    return F.array_join(F.transform(lines, lambda x: x["text"]), "\n")


def _whole_files(files: DataFrame, source_lines: DataFrame) -> DataFrame:
    """The ordered lines of distinct ``files`` (scan_id, file), a row for each file."""
    return (
        source_lines.join(scale.sorted_side(files), ["scan_id", "file"], "left_semi")
        .groupBy("scan_id", "file")
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("lines"))
    )


def _context(file: str, at: str, language: str) -> Column:
    """The context of a row that has its lines ``around``, the function around it and the whole file."""
    line = F.col(at)

    def texts(test):
        return F.transform(F.filter("around", test), lambda x: x["text"])

    target = F.get(texts(lambda x: x["line_no"] == line), F.lit(0))
    return F.struct(
        schemas.location(F.col(file), line).alias("location"),
        texts(lambda x: x["line_no"] < line).alias("before_lines"),
        F.coalesce(target, F.lit("")).alias("target_line"),
        texts(lambda x: x["line_no"] > line).alias("after_lines"),
        F.col(language).alias("language"),
        # past the file's end there are lines before the place but no function around it
        F.when(target.isNotNull(), F.col("function_body")).alias("function_body"),
        F.when(target.isNotNull(), F.col("function_start_line")).alias("function_start_line"),
        F.greatest(line - CONTEXT_LINES, F.lit(1)).cast("int").alias("snippet_start_line"),
        F.col("full_file_content"),
    )


def _from_whole_files(placed: DataFrame, source_lines: DataFrame) -> DataFrame:
    """``placed`` findings with the source_context that :func:`attach_source_context` gives if all files are kept whole.

    Every row gets its whole file, so its other texts are cut there and not moved. A file with very many findings is copied to salts.
    """
    files = placed.where(_is_placed()).select("scan_id", F.col("__file").alias("file")).distinct()
    whole = _whole_files(files, source_lines).withColumnRenamed("file", "__file").withColumnRenamed("lines", "__lines")
    number = source_lines.schema["line_no"].dataType
    line, start = F.col("__line"), F.col("__start")
    met = scale.skewed_lookup(placed, whole, ["scan_id", "__file"], salt=["ord"], unsized=True)

    def lines(first: Column, last: Column) -> Column:
        return F.filter("__lines", lambda x: (x["line_no"] >= first) & (x["line_no"] <= last))

    def head(pattern: str) -> Column:
        return F.array_max(F.transform(F.filter("__above", lambda x: x["text"].rlike(pattern)), lambda x: x["line_no"]))

    started = met.withColumns(
        {
            "around": lines(line - CONTEXT_LINES, line + CONTEXT_LINES),
            "__above": lines(line - HEADER_LINES + 1, line),
            "full_file_content": _joined("__lines"),
        }
    ).withColumn(
        "__start", F.coalesce(F.when(F.col("__language") == "python", head(PYTHON_HEADER)).otherwise(head(HEADER)), line).cast("int")
    )
    body, long = F.col("__body"), F.length("__body") > BODY_CHARS
    told = (
        started.withColumn("__texts", lines(start, start + (BODY_LINES - 1)))
        .withColumn("__body", _body("__texts", start, number))
        .withColumns({"function_body": F.when(long, body), "function_start_line": F.when(long, start)})
    )
    context = F.when(_is_placed() & (F.size("around") > 0), _context("__file", "__line", "__language"))
    return told.select(*placed.columns, context.alias("source_context"))


def attach_frame_snippets(findings: DataFrame, source_lines: DataFrame) -> DataFrame:
    """Set ``snippet`` and ``snippet_start_line`` of the first five frames from the source lines."""
    top = F.filter(
        F.slice("stack", 1, SNIPPET_FRAMES),
        lambda f: nonempty(f["file"]) & F.coalesce(f["line"] > 0, F.lit(False)),
    )
    asked = findings.select(
        "scan_id",
        "ord",
        F.explode(F.array_distinct(F.transform(top, lambda f: F.struct(f["file"], f["line"])))).alias("p"),
    ).select("scan_id", "ord", F.col("p.file").alias("file"), F.col("p.line").alias("line_no"))
    one = source_lines.select("scan_id", "file", "line_no", "text")
    got = (
        scale.skewed_lookup(asked, one, ["scan_id", "file", "line_no"], salt=["ord"], how="inner", unsized=True)
        .groupBy("scan_id", "ord")
        .agg(
            F.map_from_entries(
                F.collect_list(F.struct(F.concat_ws(":", "file", F.col("line_no").cast("string")), "text"))
            ).alias("__text")
        )
    )

    def fill(f, i):
        text = F.try_element_at(F.col("__text"), F.concat_ws(":", f["file"], f["line"].cast("string")))
        hit = (i < SNIPPET_FRAMES) & text.isNotNull()
        return F.when(
            hit, f.withField("snippet", text).withField("snippet_start_line", f["line"])
        ).otherwise(f)

    return (
        findings.join(scale.sorted_side(got), ["scan_id", "ord"], "left")
        .withColumn(
            "stack", F.when(F.col("__text").isNull(), F.col("stack")).otherwise(F.transform("stack", fill))
        )
        .drop("__text")
    )
