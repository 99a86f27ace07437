"""Heap-profiler text to summaries, call sites and flame stacks.

Input rows are ``(scan_id, output)``, one profile per row. Blocks are cut out of the text inside
the row (split before each header), so no window over lines and no shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlake import dims, scale
from defectlake.functions.text import parse_size, strip, strip_line, text_lines

# Phrasings of the profiler's summary lines; of a list the first that matches is used.
PEAK_LINES = (
    r"(?i)peak heap memory consumption:\s*([\d,.]+)\s*(\w+)",
    r"(?i)peak heap:\s*([\d,.]+)\s*(\w+)",
    r"(?i)([\d,.]+)\s*(\w+)\s+peak heap",
    r"(?i)peak memory consumed.*?([\d,.]+)\s*(\w+)",
)
TOTAL_LINES = (
    r"(?i)total memory allocated:\s*([\d,.]+)\s*(\w+)",
    r"(?i)([\d,.]+)\s*(\w+)\s+total memory allocated",
    r"(?i)total allocated:\s*([\d,.]+)\s*(\w+)",
)
COUNT_LINES = (
    r"(?i)calls to allocation functions:\s*([\d,]+)",
    r"(?i)([\d,]+)\s+calls to allocation",
    r"(?i)total allocations:\s*([\d,]+)",
    r"(?i)([\d,]+)\s+allocations",
)
TEMPORARY_LINES = (
    r"(?i)temporary allocations:\s*([\d,]+)\s*\(([\d.]+)%\)",
    r"(?i)([\d,]+)\s+temporary.*?([\d.]+)%",
)
LEAKED_LINES = (
    r"(?i)([\d,.]+)\s*(\w+)\s+leaked",
    r"(?i)leaked:\s*([\d,.]+)\s*(\w+)",
    r"(?i)memory leaked:\s*([\d,.]+)\s*(\w+)",
)
SITE_HEADER = (
    r"(\d+)\s+calls?\s+(?:to allocation functions\s+)?with\s+([\d,.]+)\s*(\w+)\s+peak\s+consumption\s+from"
)
CALL_HEADER = r"(\d+)\s+calls?\s+with\s+([\d,.]+)\s*(\w+)\s+peak\s+consumption\s+from"
ALLOCATION_HEADER = r"(\d+)\s+calls?\s+to\s+allocation"
SECTION = r"(?i)^(?:MOST\s+CALLS|PEAK\s+HEAP|MOST\s+TEMPORARY|MOST\s+BYTES)"
AT_LINE = r"^at\s+(.+?):(\d+)\s*$"


def _matching(text: Column, patterns) -> Column:
    """Number of the first pattern that occurs in the text."""
    out = F.when(F.lit(False), 0)
    for i, p in enumerate(patterns):
        out = out.when(text.rlike(p), i)
    return out


def _group(text: Column, matching: Column, patterns, group: int) -> Column:
    """A group of the pattern that :func:`_matching` found."""
    out = F.when(F.lit(False), "")
    for i, p in enumerate(patterns):
        out = out.when(matching == i, F.regexp_extract(text, p, group))
    return out


def ingest_heap_summary(profiles: DataFrame) -> DataFrame:
    """Peak, total, counts and leaked bytes per profile; of several mentions the last counts."""
    s, low = F.col("line"), F.col("low")

    def has(*words: str) -> Column:
        out = low.contains(words[0])
        for word in words[1:]:
            out = out | low.contains(word)
        return out

    # Every summary line has one of these words, and a line of a kind its own; the costly patterns see no other lines.
    kinds = {
        "peak": (PEAK_LINES, has("peak heap", "peak memory")),
        "total": (TOTAL_LINES, has("allocated")),
        "calls": (COUNT_LINES, has("allocation")),
        "temp": (TEMPORARY_LINES, has("temporary")),
        "leaked": (LEAKED_LINES, has("leaked")),
    }
    lines = (
        scale.spread(profiles)
        .select("scan_id", F.posexplode(text_lines(F.col("output"))).alias("pos", "raw"))
        .where(F.col("raw").rlike(r"(?i)peak (?:heap|memory)|allocat|temporary|leaked"))
        .select("scan_id", "pos", F.lower("raw").alias("low"), strip_line(F.col("raw")).alias("line"))
    )
    lines = lines.select("scan_id", "pos", "line", *[F.when(own, _matching(s, p)).alias(f"__{k}") for k, (p, own) in kinds.items()])

    def group(kind: str, number: int) -> Column:
        return _group(s, F.col(f"__{kind}"), kinds[kind][0], number)

    lines = lines.select(
        "scan_id",
        "pos",
        parse_size(group("peak", 1), group("peak", 2)).alias("peak"),
        parse_size(group("total", 1), group("total", 2)).alias("total"),
        F.regexp_replace(group("calls", 1), ",", "").try_cast("bigint").alias("calls"),
        F.regexp_replace(group("temp", 1), ",", "").try_cast("bigint").alias("temp"),
        group("temp", 2).try_cast("double").alias("temp_pct"),
        parse_size(group("leaked", 1), group("leaked", 2)).alias("leaked"),
    )

    def last(name: str) -> Column:
        at = F.when(F.col(name).isNotNull(), F.col("pos"))
        return F.coalesce(F.max_by(name, at), F.lit(0))

    return lines.groupBy("scan_id").agg(
        last("peak").alias("peak_heap_bytes"),
        last("total").alias("total_bytes_allocated"),
        F.coalesce(F.max("calls"), F.lit(0)).alias("total_allocations"),
        last("temp").alias("total_temporary"),
        last("temp_pct").alias("total_temporary_pct"),
        last("leaked").alias("leaked_bytes"),
    )


def _function_name(line: Column, min_prefix: int = 0) -> Column:
    """The text before '::' where there is one (longer than ``min_prefix``), else the line."""
    prefix = F.get(F.split(line, "::"), F.lit(0))
    cut = line.contains("::") & (F.length(prefix) > min_prefix)
    return strip(F.when(cut, prefix).otherwise(line))


#: white space before a header, on the header's own line
INDENT = r"^[^\S\n]*"


def _blocks(profiles: DataFrame, header: str, keep: str) -> DataFrame:
    """Rows (scan_id, pos, block, body) per block that starts with a ``keep`` header.

    Blocks run from one ``header`` line to the next; ``body`` is the trimmed lines after it.
    """
    cut = "(?m)(?=" + INDENT + header + ")"
    return (
        scale.spread(profiles)
        .select("scan_id", F.posexplode(F.split("output", cut)).alias("pos", "block"))
        .where(F.col("block").rlike(INDENT + keep))
        # a column of its own, since the lines mention it several times
        .withColumn("rest", F.when(F.col("block").contains("\n"), F.substr("block", F.locate("\n", F.col("block")) + 1)).otherwise(""))
        .select(
            "scan_id",
            "pos",
            "block",
            F.transform(
                text_lines(F.col("rest")), strip_line
            ).alias("body"),
        )
    )


def ingest_heap_sites(profiles: DataFrame) -> DataFrame:
    """Call sites: function, place, calls, peak and the first five functions of the stack."""
    many = F.lit(1 << 30)

    def upto(array: Column, stop: Column) -> Column:
        """The elements before 1-based ``stop`` (all of them when it is 0 or null)."""
        n = F.when(F.coalesce(stop, F.lit(0)) > 0, stop - 1).otherwise(F.size(array))
        return F.slice(array, F.lit(1), n.cast("int"))

    # names are read up to the first blank line; a section title can only come after one
    blocks = (
        _blocks(profiles, SITE_HEADER, SITE_HEADER)
        .withColumn("blank", F.array_position("body", ""))
    )
    after_blank = F.slice("body", (F.col("blank") + 1).cast("int"), many)
    titles = F.transform(after_blank, lambda x: x.rlike(SECTION))
    section = F.when(
        (F.col("blank") > 0) & F.array_contains(titles, True),
        F.col("blank") + F.array_position(titles, True),
    )
    named = F.filter(
        F.transform(
            upto(F.col("body"), F.col("blank")),
            lambda x, i: F.struct(
                i.alias("i"),
                F.when(
                    ~x.startswith("at ") & ~x.startswith("in "), _function_name(x)
                ).alias("name"),
            ),
        ),
        lambda x: F.length(x["name"]) > 1,
    )
    blocks = blocks.select(
        "scan_id", "pos", "block", upto(F.col("body"), section).alias("body"), named.alias("names")
    )
    # exploded before it is filtered by: a condition on the block's columns would be moved below and cut its lines once more
    site = F.slice(F.filter("names", lambda x: ~x["name"].isin(*dims.HEAP_SITE_SKIP)), 1, 1)
    blocks = blocks.select("*", F.explode_outer(site).alias("site")).where(F.col("site").isNotNull())
    place = F.get(
        F.filter(
            F.slice("body", F.col("site.i") + 2, many),
            lambda x: x.rlike(AT_LINE)
            & ~F.regexp_extract(x, AT_LINE, 1).rlike("|".join(dims.HEAP_SYSTEM_PATHS)),
        ),
        F.lit(0),
    )
    blocks = blocks.withColumn("place", place)
    place = F.col("place")
    path, head = F.regexp_extract(place, AT_LINE, 1), INDENT + SITE_HEADER
    return blocks.select(
        "scan_id",
        F.col("pos").alias("site_no"),
        F.col("site.name").alias("function"),
        F.coalesce(F.element_at(F.split(path, "/"), -1), F.lit("??")).alias("file"),
        F.coalesce(F.regexp_extract(place, AT_LINE, 2).try_cast("int"), F.lit(0)).alias("line"),
        F.regexp_extract("block", head, 1).try_cast("bigint").alias("allocations"),
        parse_size(
            F.regexp_extract("block", head, 2), F.regexp_extract("block", head, 3)
        ).alias("peak_bytes"),
        F.lit(0).cast("bigint").alias("leaked_bytes"),
        F.lit(0).cast("bigint").alias("temporary"),
        F.transform(F.slice("names", 1, 5), lambda x: x["name"]).alias("stack"),
        F.col("block").rlike(INDENT + CALL_HEADER).alias("is_subcall"),
    )


def ingest_flame_stacks(profiles: DataFrame) -> DataFrame:
    """Root-first stacks of the 'N calls with X' blocks with their bytes per profile."""
    head = INDENT + CALL_HEADER
    either = rf"(?:{CALL_HEADER}|{ALLOCATION_HEADER})"
    names = F.filter(
        F.transform(
            F.filter(
                "body",
                lambda s: (s != "") & ~s.startswith("at ") & ~s.startswith("in /"),
            ),
            lambda s: _function_name(s, 2),
        ),
        lambda n: (F.length(n) > 1) & ~n.isin("from", "from:"),
    )
    blocks = (
        _blocks(profiles, either, CALL_HEADER)
        .select(
            "scan_id",
            F.array_join(F.reverse(names), ";").alias("stack"),
            parse_size(
                F.regexp_extract("block", head, 2), F.regexp_extract("block", head, 3)
            ).alias("bytes"),
        )
        .where((F.col("stack") != "") & (F.col("bytes") > 0))
    )
    return blocks.groupBy("scan_id", "stack").agg(F.sum("bytes").alias("bytes"))
