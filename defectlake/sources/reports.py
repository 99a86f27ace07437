"""Diagnostic reports to findings.

Input rows are ``(scan_id, report_id, tool, output)``: one report text per row, so the work splits
by report and a scan with very many reports spreads over the cluster. A format says how a text becomes an array of
items and how an item becomes the columns of a finding. A mixed table is read once: its tool chooses the text's
format, all formats' items leave one ``inline`` and the item's format chooses the columns. Reasons to reject a report
are items too. Only the per-report dedup shuffles, and only the keys of findings that occur more than once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from defectlake import dims, scale, schemas
from defectlake.functions import findings as ff
from defectlake.functions.text import nonempty, strip, truncate, with_commas
from defectlake.operators.findings import freed_block_columns, kind_of, with_fingerprint

#: findings of one report are numbered below this; ``ord`` = report_id * REPORT_SPAN + position
REPORT_SPAN = 1 << 24
#: report ids from here on, and below 64 times this, have the numbers above all others, in narrower spans
WIDE_IDS, WIDE_SPAN = 1 << 38, 1 << 18

_VG_FRAME = "STRUCT<ip: STRING, fn: STRING, file: STRING, line: STRING, obj: STRING>"
_VG_ERROR = (
    "STRUCT<kind: ARRAY<STRING>, what: ARRAY<STRING>, "
    "xwhat: ARRAY<STRUCT<text: STRING, leakedbytes: STRING, leakedblocks: STRING>>, "
    f"auxwhat: ARRAY<STRING>, stack: ARRAY<STRUCT<frame: ARRAY<{_VG_FRAME}>>>>"
)
_VG_SCHEMA = f"STRUCT<error: ARRAY<{_VG_ERROR}>>"
_CPP_ERROR = (
    "STRUCT<_id: STRING, _severity: STRING, _msg: STRING, "
    "location: ARRAY<STRUCT<_file: STRING, _line: STRING, _column: STRING>>>"
)
_CPP_SCHEMA = f"STRUCT<error: ARRAY<{_CPP_ERROR}>, errors: STRUCT<error: ARRAY<{_CPP_ERROR}>>>"
_INFER_SCHEMA = (
    "ARRAY<STRUCT<bug_type: STRING, qualifier: STRING, procedure: STRING, file: STRING, line: INT, "
    "`column`: INT, bug_trace: ARRAY<STRUCT<filename: STRING, line_number: INT, "
    "column_number: INT, procedure_name: STRING>>>>"
)
_ALLOC_SCHEMA = (
    "ARRAY<STRUCT<size: BIGINT, count: BIGINT, traceback: ARRAY<STRUCT<file: STRING, line: INT>>>>"
)

# Text patterns of the report formats.
LEAK_TEXT = r"(\d[\d,]*)\s+bytes?\s+in\s+(\d[\d,]*)\s+blocks?"
SANITIZER_FRAME = r"(?md)^\s*#(\d+)\s+0x[0-9a-f]+\s+in\s+(\S+)\s+(.*?)(?::(\d+)(?::(\d+))?)?$"
SANITIZER_LEAK = (
    r"(?d)Direct leak of (\d+) byte\(s\) in (\d+) object\(s\) allocated from:\s*((?:#\d+.*\n?)+)"
)
BARE_AMPERSAND = r"&(?!amp;|lt;|gt;|quot;|apos;)"
FD_LEAK = r"Open file descriptor|FILE DESCRIPTORS|(?i:inherited)"


def _ord(position: Column, half: bool = False) -> Column:
    """Place of a finding in its scan, by report and position; ``half`` puts it into the upper half of its report's span."""
    report = F.col("report_id")
    wide = F.lit(1 << 62) + (report - WIDE_IDS) * F.lit(WIDE_SPAN) + position + (WIDE_SPAN // 2 if half else 0)
    fits = position < WIDE_SPAN // 2
    return F.when(report < WIDE_IDS, report * F.lit(REPORT_SPAN) + position + (REPORT_SPAN // 2 if half else 0)).otherwise(
        F.when(fits, wide).otherwise(F.raise_error(F.lit(f"a report of id {WIDE_IDS} or above has too many findings")).cast("bigint"))
    )


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("bigint")


def _first(col: Column) -> Column:
    return F.get(col, F.lit(0))


def _or_next(*cols: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.when(nonempty(c), c) for c in cols])


def _carried(df: DataFrame) -> list[str]:
    """Key columns, and the event time where the reports have one."""
    return ["scan_id", "report_id"] + (["discovered_at"] if "discovered_at" in df.columns else [])


class Format(NamedTuple):
    """One kind of findings in a tool's reports."""

    #: tools whose reports hold them
    tools: tuple[str, ...]
    #: columns that parse the text ``output``, by name; formats may share them
    documents: dict[str, Column]
    #: array of items, from those columns
    items: Column
    #: columns of an item ``x`` that several finding columns need; they are null where ``x`` is
    prepared: Callable[[Column], dict[str, Column]]
    #: finding columns of an item ``x``
    columns: Callable[[Column], dict[str, Column]]
    #: items that give no finding
    dropped: Callable[[Column], Column] = lambda x: F.lit(False)
    #: whether findings follow the other items of their report
    half: bool = False
    #: whether a report's findings are counted once per fingerprint
    dedup: bool = False


#: finding columns that formats fill
_FILLED = (
    "tool", "language", "bug_type", "severity", "message", "detail", "stack", "primary_location", "allocation_info",
    "free_info", "bytes_leaked", "alloc_count",
)
_REJECTED = -1


def _parse(reports: DataFrame, formats: Sequence[Format], reason: Column | None = None) -> DataFrame:
    """All findings of the formats in one projection: finding columns, report_id, report_tool, part and reason.

    ``part`` is the format's number; a row with part -1 has only the ``reason`` for which its report is rejected.
    """
    carried = _carried(reports)
    documents = {name: col for f in formats for name, col in f.documents.items()}
    parsed = scale.spread(reports).select(*carried, "tool", "output", *[c.alias(n) for n, c in documents.items()])
    # an item is what one format's array holds; the columns of the other formats are null
    held = parsed.select(*[f.items.alias(f"__{i}") for i, f in enumerate(formats)]).schema
    kinds = {field.name: field.dataType.elementType for field in held}
    fields = [StructField("part", IntegerType()), StructField("pos", IntegerType()), StructField("reason", StringType())]
    none = F.array().cast(ArrayType(StructType(fields + [StructField(name, kind) for name, kind in kinds.items()])))

    def item(part: int, pos: Column, x: Column, because: Column) -> Column:
        own = [(x if name == f"__{part}" else F.lit(None).cast(kind)).alias(name) for name, kind in kinds.items()]
        return F.struct(F.lit(part).alias("part"), pos.cast("int").alias("pos"), because.cast("string").alias("reason"), *own)

    def wrapped(part: int) -> Callable[[Column, Column], Column]:
        return lambda x, i: item(part, i, x, F.lit(None))

    # a text is read by its own tool's formats alone; most tools have one, whose items are then not put together with others
    tools: dict[tuple[int, ...], list[str]] = {}
    for tool in {t: None for f in formats for t in f.tools}:
        tools.setdefault(tuple(i for i, f in enumerate(formats) if tool in f.tools), []).append(tool)
    items = F.when(F.lit(False), none)
    for parts, names in tools.items():
        own = [F.coalesce(F.transform(formats[i].items, wrapped(i)), none) for i in parts]
        items = items.when(F.col("tool").isin(*names), own[0] if len(own) == 1 else F.concat(*own))
    items = items.otherwise(none)
    if reason is not None:
        rejected = F.array(item(_REJECTED, F.lit(0), F.lit(None), F.col("__why")))
        parsed = parsed.withColumn("__why", reason)
        items = F.when(F.col("__why").isNotNull(), F.concat(items, rejected)).otherwise(items)
    rows = parsed.select(*carried, F.col("tool").alias("report_tool"), F.inline(items))
    part = F.col("part")
    for i, f in enumerate(formats):
        rows = rows.where((part != i) | ~f.dropped(F.col(f"__{i}")))
    rows = rows.withColumns({n: c for i, f in enumerate(formats) for n, c in f.prepared(F.col(f"__{i}")).items()})
    chosen: dict[str, Column] = {name: F.when(F.lit(False), None) for name in _FILLED}
    order = F.when(F.lit(False), None)
    for i, f in enumerate(formats):
        columns = f.columns(F.col(f"__{i}"))
        for name in _FILLED:
            if name in columns:
                chosen[name] = chosen[name].when(part == i, columns[name].cast(schemas.FINDING[name]))
        order = order.when(part == i, _ord(F.col("pos"), f.half))
    finding = rows.select(
        *carried, "report_tool", "part", "reason", order.cast("bigint").alias("ord"),
        *[c.cast(schemas.FINDING[n]).alias(n) for n, c in chosen.items()],
    )
    return with_fingerprint(schemas.conform(finding, keep=("report_id", "report_tool", "part", "reason")))


def _first_in_report(found: DataFrame, formats: Sequence[Format]) -> DataFrame:
    """First finding per (report, fingerprint) of the formats that are counted once.

    ``found`` is read twice, so it is a stored table. Only fingerprints with copies meet the whole rows.
    """
    once = [i for i, f in enumerate(formats) if f.dedup]
    key = ["scan_id", "report_id", "part", "fingerprint"]
    copies = (
        found.where(F.col("part").isin(*once))
        .groupBy(*key).agg(F.min("ord").alias("__first"), F.count(F.lit(1)).alias("__n"))
        .where("__n > 1").drop("__n")
    )
    later = copies.select(*[F.col(c).alias(f"__{c}") for c in key], "__first")
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key] + [F.col("ord") > F.col("__first")]
    return found.join(later, on, "left_anti")


def _findings(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("part") != _REJECTED).drop("report_id", "report_tool", "part", "reason")


def _ingest(reports: DataFrame, form: Format, dedup: bool = False) -> DataFrame:
    """Findings of one format; reports of other tools give none."""
    parsed = _parse(reports, (form,))
    if dedup and form.dedup:
        # ranked and not folded as whole rows, so columns that nobody asks for are not made
        same = Window.partitionBy("scan_id", "report_id", "fingerprint").orderBy("ord")
        parsed = parsed.withColumn("__rn", F.row_number().over(same)).where(F.col("__rn") == 1).drop("__rn")
    return _findings(parsed)


def _xml_frames(frames: Column) -> Column:
    return F.transform(
        frames,
        lambda f, i: schemas.frame(
            i,
            address=f["ip"],
            function=f["fn"],
            file=f["file"],
            line=_number(f["line"]),
            module=f["obj"],
        ),
    )


def _xml(text: Column, schema: str, reasons: bool) -> Column:
    """Parsed XML; with ``reasons`` text that is no XML comes with the document, from the same parse."""
    return F.from_xml(text, f"{schema[:-1]}, _corrupt_record: STRING>" if reasons else schema)


def _xml_stacks(x: Column) -> Column:
    return F.transform(x["stack"], lambda s: _xml_frames(s["frame"]))


def _first_stack(stacks: str) -> Column:
    return F.coalesce(F.get(F.col(stacks), F.lit(0)), F.array().cast(schemas.STACK))


def _memcheck_prepared(x: Column) -> dict[str, Column]:
    what, xwhat = _first(x["what"]), _first(x["xwhat"])
    kind = F.coalesce(_first(x["kind"]), F.lit(""))
    return {
        "mc_kind": kind,
        "mc_what": F.coalesce(_or_next(what, xwhat["text"], kind), F.lit("")),
        "mc_bytes": _number(xwhat["leakedbytes"]),
        "mc_blocks": _number(xwhat["leakedblocks"]),
        "mc_aux": _first(x["auxwhat"]),
        "mc_stacks": _xml_stacks(x),
    }


def _memcheck_columns(x: Column) -> dict[str, Column]:
    """Memcheck errors: kinds, leak sizes, up to three stacks, user-code location, UAF reclassing."""
    what, kind, aux = F.col("mc_what"), F.col("mc_kind"), F.col("mc_aux")
    from_text = F.col("mc_bytes").isNull() & what.rlike(LEAK_TEXT)

    def number(group: int, listed: str) -> Column:
        return F.when(from_text, _number(F.regexp_extract(what, LEAK_TEXT, group))).otherwise(F.col(listed))

    size, count = number(1, "mc_bytes"), number(2, "mc_blocks")
    second = F.get(F.col("mc_stacks"), F.lit(1))
    allocator = _first(
        F.filter(F.transform(second, lambda f: f["function"]), lambda fn: F.coalesce(fn.isin(*dims.STACK_ALLOCATORS), F.lit(False)))
    )
    bug, severity = kind_of("valgrind", kind)
    allocation = F.when(
        second.isNotNull(),
        F.struct(size.alias("size"), count.alias("count"), second.alias("stack"), allocator.alias("kind")),
    )
    return {
        "tool": F.lit("valgrind"), "language": F.lit("c"), "message": what, "detail": F.when(nonempty(aux), aux),
        "severity": severity, "bytes_leaked": size, "alloc_count": count,
        "stack": _first_stack("mc_stacks"), "primary_location": ff.memcheck_location(_first_stack("mc_stacks")),
        **freed_block_columns(kind, aux, F.col("mc_stacks"), size, count, bug, allocation),
    }


def _helgrind_prepared(x: Column) -> dict[str, Column]:
    return {"hg_stacks": _xml_stacks(x)}


def _helgrind_columns(x: Column) -> dict[str, Column]:
    """Helgrind errors: races and lock errors."""
    kind, aux = F.coalesce(_first(x["kind"]), F.lit("")), _first(x["auxwhat"])
    bug, severity = kind_of("helgrind", kind)
    return {
        "tool": F.lit("helgrind"), "language": F.lit("c"), "bug_type": bug, "severity": severity,
        "message": F.coalesce(_or_next(_first(x["what"]), _first(x["xwhat"])["text"], kind), F.lit("")),
        "detail": F.when(nonempty(aux), aux),
        "stack": _first_stack("hg_stacks"), "primary_location": ff.helgrind_location(_first_stack("hg_stacks")),
    }


def _text_frames(block: Column) -> Column:
    """Frames of '#n 0x… in fn file:line:col' lines."""
    index, function, place, line, column = (
        F.regexp_extract_all(block, F.lit(SANITIZER_FRAME), F.lit(g)) for g in range(1, 6)
    )
    return F.transform(
        F.arrays_zip(
            index.alias("index"),
            function.alias("function"),
            place.alias("place"),
            line.alias("line"),
            column.alias("column"),
        ),
        lambda f: schemas.frame(
            f["index"].try_cast("int"),
            function=f["function"],
            file=strip(f["place"]),
            line=F.nullif(f["line"], F.lit("")).try_cast("int"),
            column=F.nullif(f["column"], F.lit("")).try_cast("int"),
        ),
    )


def _sanitizer_columns(x: Column) -> dict[str, Column]:
    """ERROR/WARNING blocks of ASan, LSan, MSan, UBSan and TSan text."""
    bug, severity = kind_of("asan", x)
    return {
        "tool": F.col("report_tool"), "language": F.lit("c"), "bug_type": bug, "severity": severity,
        "message": truncate(strip(_first(F.split(x, "\n"))), 200),
        "stack": F.col("sn_stack"), "primary_location": ff.any_location(F.col("sn_stack")),
    }


def _leak_items() -> Column:
    size, count, trace = (F.regexp_extract_all("output", F.lit(SANITIZER_LEAK), F.lit(g)) for g in (1, 2, 3))
    return F.arrays_zip(size.alias("size"), count.alias("count"), trace.alias("trace"))


def _leak_columns(x: Column) -> dict[str, Column]:
    """'Direct leak of N byte(s) in M object(s)' blocks of sanitizer text."""
    return {
        "tool": F.lit("lsan"), "language": F.lit("c"), "bug_type": F.lit("memory_leak"), "severity": F.lit("high"),
        "message": F.concat(F.lit("Direct leak of "), x["size"], F.lit(" bytes in "), x["count"], F.lit(" object(s)")),
        "stack": F.col("lk_stack"), "primary_location": ff.any_location(F.col("lk_stack")),
        "bytes_leaked": x["size"].try_cast("bigint"), "alloc_count": x["count"].try_cast("bigint"),
    }


def _cppcheck_items() -> Column:
    none = F.array().cast(f"ARRAY<{_CPP_ERROR}>")
    doc = F.col("cpp_doc")
    return F.concat(F.coalesce(doc["error"], none), F.coalesce(doc["errors"]["error"], none))


def _cppcheck_prepared(x: Column) -> dict[str, Column]:
    def positive(text: Column) -> Column:
        return F.nullif(F.coalesce(text.try_cast("int"), F.lit(0)), F.lit(0))

    frames = F.transform(
        x["location"], lambda f, i: schemas.frame(i, file=f["_file"], line=positive(f["_line"]), column=positive(f["_column"]))
    )
    return {"cp_stack": F.coalesce(frames, F.array().cast(schemas.STACK))}


def _cppcheck_columns(x: Column) -> dict[str, Column]:
    """Cppcheck XML attributes."""
    bug, severity = kind_of("cppcheck", F.coalesce(x["_id"], F.lit("")), x["_severity"])
    placed = _first(F.filter("cp_stack", ff.has_location))
    return {
        "tool": F.lit("cppcheck"), "language": F.lit("c"), "bug_type": bug, "severity": severity,
        "message": F.coalesce(x["_msg"], F.lit("")), "stack": F.col("cp_stack"),
        "primary_location": F.when(placed.isNotNull(), schemas.location(placed["file"], placed["line"], placed["column"])),
    }


def _infer_kind(x: Column) -> Column:
    return F.coalesce(x["bug_type"], F.lit("UNKNOWN"))


def _infer_columns(x: Column) -> dict[str, Column]:
    """Infer JSON issues without the noise types."""
    kind = _infer_kind(x)
    bug, severity = kind_of("infer", kind)
    frames = F.transform(
        x["bug_trace"],
        lambda f, i: schemas.frame(
            i, function=f["procedure_name"], file=f["filename"], line=f["line_number"], column=f["column_number"]
        ),
    )
    message = F.concat(F.lit("[Infer] "), kind, F.lit(": "), F.coalesce(x["qualifier"], F.lit("")))
    placed = nonempty(x["file"]) & (F.coalesce(x["line"], F.lit(0)) != 0)
    return {
        "tool": F.lit("infer"), "language": F.lit("c"), "bug_type": bug, "severity": severity,
        "message": truncate(message, 200, ellipsis=True),
        "detail": F.when(nonempty(x["procedure"]), F.concat(F.lit("In function: "), x["procedure"])),
        "stack": F.coalesce(frames, F.array().cast(schemas.STACK)),
        "primary_location": F.when(placed, schemas.location(x["file"], x["line"], F.coalesce(x["column"], F.lit(0)))),
    }


def _allocation_prepared(x: Column) -> dict[str, Column]:
    frames = F.transform(x["traceback"], lambda f, i: schemas.frame(i, file=f["file"], line=f["line"]))
    return {"al_stack": F.coalesce(frames, F.array().cast(schemas.STACK))}


def _allocation_columns(x: Column) -> dict[str, Column]:
    """Allocation statistics: records rated by size."""
    size = F.coalesce(x["size"], F.lit(0))
    return {
        "tool": F.lit("tracemalloc"), "language": F.lit("python"), "bug_type": F.lit("python_large_object"),
        "severity": ff.size_severity(size),
        "message": F.concat(
            F.lit("Large allocation: "), with_commas(size), F.lit(" bytes in "),
            F.coalesce(x["count"], F.lit(0)).cast("string"), F.lit(" objects"),
        ),
        "stack": F.col("al_stack"), "primary_location": ff.any_location(F.col("al_stack")),
        "bytes_leaked": size, "alloc_count": x["count"],
    }


SANITIZERS = ("asan", "lsan", "msan", "ubsan", "tsan")


def _formats(reasons: bool = False) -> dict[str, Format]:
    """The known formats by name, in the order in which their findings are listed."""
    output, tool = F.col("output"), F.col("tool")

    def only(*tools: str) -> Column:
        return tool.isin(*tools)

    fixed = F.regexp_replace(output, BARE_AMPERSAND, "&amp;")
    xml = {"xml_doc": F.when(only("valgrind", "helgrind") & (F.length(output) >= 50), _xml(fixed, _VG_SCHEMA, reasons))}
    cppcheck = {"cpp_doc": F.when(only("cppcheck") & (strip(output) != ""), _xml(output, _CPP_SCHEMA, reasons))}
    infer = {"infer_doc": F.when(only("infer") & strip(output).startswith("["), F.from_json("output", _INFER_SCHEMA))}
    records = {"alloc_doc": F.when(only("tracemalloc", "memray"), F.from_json("output", _ALLOC_SCHEMA))}
    errors = F.col("xml_doc")["error"]
    none = dict  # formats without shared columns
    blocks = F.split("output", r"(?=ERROR:|WARNING:)")
    return {
        "memcheck": Format(("valgrind",), xml, errors, _memcheck_prepared, _memcheck_columns, dedup=True),
        "sanitizer": Format(
            SANITIZERS, {}, blocks, lambda x: {"sn_stack": _text_frames(x)}, _sanitizer_columns, lambda x: strip(x) == ""
        ),
        "leak": Format(SANITIZERS, {}, _leak_items(), lambda x: {"lk_stack": _text_frames(x["trace"])}, _leak_columns, half=True),
        "helgrind": Format(("helgrind",), xml, errors, _helgrind_prepared, _helgrind_columns, dedup=True),
        "infer": Format(
            ("infer",), infer, F.col("infer_doc"), lambda x: none(), _infer_columns,
            lambda x: x.isNull() | _infer_kind(x).isin(*dims.INFER_NOISE), dedup=True,
        ),
        "cppcheck": Format(("cppcheck",), cppcheck, _cppcheck_items(), _cppcheck_prepared, _cppcheck_columns),
        "allocation": Format(
            ("tracemalloc", "memray"), records, F.col("alloc_doc"), _allocation_prepared, _allocation_columns, lambda x: x.isNull()
        ),
    }


def ingest_memcheck(reports: DataFrame, dedup: bool = True) -> DataFrame:
    """Memcheck XML: kinds, leak sizes, up to three stacks, user-code location, UAF reclassing."""
    return _ingest(reports, _formats()["memcheck"], dedup)


def ingest_helgrind(reports: DataFrame, dedup: bool = True) -> DataFrame:
    """Helgrind XML: races and lock errors."""
    return _ingest(reports, _formats()["helgrind"], dedup)


def ingest_sanitizer(reports: DataFrame) -> DataFrame:
    """ASan, LSan, MSan, UBSan and TSan text: one finding per ERROR/WARNING block."""
    return _ingest(reports, _formats()["sanitizer"])


def ingest_lsan_leaks(reports: DataFrame) -> DataFrame:
    """'Direct leak of N byte(s) in M object(s)' blocks of sanitizer text."""
    return _ingest(reports, _formats()["leak"])


def ingest_cppcheck(reports: DataFrame) -> DataFrame:
    """Cppcheck XML attributes."""
    return _ingest(reports, _formats()["cppcheck"])


def ingest_infer(reports: DataFrame, dedup: bool = True) -> DataFrame:
    """Infer JSON issues without the noise types."""
    return _ingest(reports, _formats()["infer"], dedup)


def ingest_allocation_stats(reports: DataFrame, n: int | None = None) -> DataFrame:
    """Allocation statistics JSON: the report's records (the first ``n`` if given), rated by size."""
    form = _formats()["allocation"]
    return _ingest(reports, form if n is None else form._replace(items=F.slice(form.items, 1, n)))


Parser = Callable[[DataFrame], DataFrame]
_EXTRA: dict[str, Parser] = {}


def register_report_format(tool: str, parser: Parser) -> None:
    """Add (or replace) the parser of a tool's reports: raw reports in, findings out."""
    _EXTRA[tool] = parser


def known_tools() -> list[str]:
    """Tools whose reports can be read."""
    return sorted({t for f in _formats().values() for t in f.tools} | set(_EXTRA))


def _reason() -> Column:
    """Why a report gives no findings: an unknown tool or undecodable text."""
    tool, text = F.col("tool"), F.col("output")
    broken = F.col("xml_doc")["_corrupt_record"].isNotNull() | F.col("cpp_doc")["_corrupt_record"].isNotNull()
    json = tool.isin("infer", "tracemalloc", "memray") & (strip(text) != "")
    return (
        F.when(~tool.isin(*known_tools()), F.lit("unknown tool"))
        .when(tool.isin(*_EXTRA), F.lit(None))
        .when(broken, F.lit("malformed XML"))
        .when(json & F.try_parse_json(text).isNull(), F.lit("malformed JSON"))
    )


def _own_formats(reasons: bool) -> list[Format]:
    """The known formats without the tools whose parser was replaced."""
    own = [f._replace(tools=tuple(t for t in f.tools if t not in _EXTRA)) for f in _formats(reasons).values()]
    return [f for f in own if f.tools]


def parse_reports(raw: DataFrame, reasons: bool = True) -> DataFrame:
    """Findings and (unless not wanted) reasons to reject of a mixed report table, in one pass over it.

    The columns of a finding, and report_id, report_tool, part and reason. A row that has a ``reason`` is a report that
    gives no findings; ``part`` is the number of the format that a finding comes from.
    """
    return _parse(raw, _own_formats(reasons), _reason() if reasons else None)


def read_reports(raw: DataFrame, per_report_dedup: bool = True) -> dict[str, DataFrame]:
    """``findings`` and ``rejected`` of a mixed report table, which is read once and its parsed rows written."""
    parsed = scale.materialise(parse_reports(raw), "parsed")
    rejected = parsed.where(F.col("part") == _REJECTED)
    found = _findings(_first_in_report(parsed, _own_formats(True)) if per_report_dedup else parsed)
    return {
        "findings": _with_extra(found, raw),
        "rejected": rejected.select("scan_id", "report_id", F.col("report_tool").alias("tool"), "reason"),
    }


def _with_extra(found: DataFrame, raw: DataFrame) -> DataFrame:
    """Findings and those of the registered formats, whose parsers take the reports of their tool."""
    for tool, parse in _EXTRA.items():
        found = found.unionByName(parse(raw.where(F.col("tool") == tool)), allowMissingColumns=True)
    return found


def ingest_reports(raw: DataFrame, per_report_dedup: bool = True) -> DataFrame:
    """All findings of a mixed report table; reports of unknown tools give none.

    Streams switch ``per_report_dedup`` off, since their dedup by fingerprint covers it; then nothing is written. A
    ``discovered_at`` column of the reports is carried over to the findings.
    """
    parsed = parse_reports(raw, reasons=False)
    if per_report_dedup:
        once = [i for i, f in enumerate(_own_formats(False)) if f.dedup]
        # ranked and not stored, so columns that nobody asks for are not made; a finding that has no copies by its format is a
        # key of its own. Copies go before the shuffle, as only the first of a key is asked for
        alone = F.when(~F.col("part").isin(*once), F.col("ord"))
        same = Window.partitionBy("scan_id", "report_id", "part", "fingerprint", alone).orderBy("ord")
        parsed = parsed.withColumn("__rn", F.row_number().over(same)).where(F.col("__rn") == 1).drop("__rn")
    return _with_extra(_findings(parsed), raw)


def rejected_reports(raw: DataFrame) -> DataFrame:
    """Reports that give no findings because of an unknown tool or undecodable text."""
    rejected = parse_reports(raw).where(F.col("part") == _REJECTED)
    return rejected.select("scan_id", "report_id", F.col("report_tool").alias("tool"), "reason")


def extract_fd_leaks(outputs: DataFrame) -> DataFrame:
    """Lines of tool output that speak of leaked file descriptors."""
    return (
        outputs.select(
            "scan_id", "report_id", F.posexplode(F.split("output", r"\r\n|\n|\r")).alias("pos", "text")
        )
        .where(F.col("text").rlike(FD_LEAK))
        .select("scan_id", "report_id", (F.col("pos") + 1).alias("line_no"), "text")
    )
