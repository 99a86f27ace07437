"""Column functions on text, sizes, paths and loose JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from defectlake import dims


#: every line boundary of Unicode text, as str.splitlines has them
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

OTHER_LINE_END = r"[\x0b-\r\x1c-\x1e\x85\u2028\u2029]"


def nonempty(col: Column) -> Column:
    """True for a string that is neither null nor empty."""
    return F.coalesce(F.length(col) > 0, F.lit(False))


def basename(path: Column) -> Column:
    """Last component of a path."""
    return F.element_at(F.split(path, "/"), -1)


def strip(col: Column) -> Column:
    """Trim all white space, not only blanks."""
    # a pattern tries every blank of the text; it is needed only where the text's end is a line end that is no white space
    odd_end = col.endswith("\x85") | col.endswith("\u2028") | col.endswith("\u2029")
    return F.when(odd_end, F.regexp_replace(col, r"^\s+|\s+$", "")).otherwise(strip_line(col))


def strip_line(col: Column) -> Column:
    """:func:`strip` of a text without line ends but \\n and \\r, where it needs no pattern."""
    return F.btrim(col, F.lit(" \t\n\x0b\f\r"))


def text_lines(text: Column) -> Column:
    """Array of lines without the terminators and without a trailing empty line."""
    # the last terminator goes first, so the text is split once and nothing is sliced afterwards; only its end is looked at
    last = F.when(text.endswith("\r\n"), 2).when(F.right(text, F.lit(1)).rlike(LINE_END), 1).otherwise(0)
    body = F.substr(text, F.lit(1), F.length(text) - last)
    # most texts have no line end but \\n, which is split at without a pattern
    lines = F.when(text.rlike(OTHER_LINE_END), F.split(body, LINE_END)).otherwise(F.split(body, "\n"))
    return F.when(F.length(text) > 0, lines).when(
        text.isNotNull(), F.array().cast("array<string>")
    )


def parse_size(number: Column, unit: Column) -> Column:
    """'1,234.5' and 'KB' to bytes; units are binary multiples, unknown units count as bytes."""
    value = F.regexp_replace(number, ",", "").try_cast("double")
    # units as they are mostly written are found at once; only others are put into capitals
    usual = {spelt: n for u, n in dims.SIZE_UNITS.items() for spelt in (u, u.lower())}
    factor = F.coalesce(dims.lookup(usual, unit), dims.lookup(dims.SIZE_UNITS, F.upper(F.trim(unit))), F.lit(1))
    return (value * factor).try_cast("bigint")


def format_bytes(col: Column) -> Column:
    """Bytes as '1.5 MB', '2.0 KB' or '12 B'."""
    # halves round to even, as in the usual printf of these values
    mb, kb = F.bround(col / F.lit(1048576.0), 1), F.bround(col / F.lit(1024.0), 1)
    return (
        F.when(col >= 1048576, F.format_string("%.1f MB", mb))
        .when(col >= 1024, F.format_string("%.1f KB", kb))
        .when(col.isNotNull(), F.format_string("%d B", col))
    )


def with_commas(col: Column) -> Column:
    """Integer with thousands separators."""
    return F.format_number(col.cast("bigint"), 0)


def is_user_path(path: Column, markers=dims.NON_USER_PATHS) -> Column:
    """True when the path contains none of the system or build markers."""
    return ~path.rlike("|".join(_quote(m) for m in markers))


def language_of(path: Column, default: Column) -> Column:
    """Language by file extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(dims.lookup(dims.EXTENSION_LANGUAGE, ext), default)


def truncate(col: Column, limit: int, ellipsis: bool = False) -> Column:
    """Cap a text; with ``ellipsis`` the last three of the kept characters become dots."""
    if not ellipsis:
        return F.substring(col, 1, limit)
    return F.when(
        F.length(col) > limit, F.concat(F.substring(col, 1, limit - 3), F.lit("..."))
    ).otherwise(col)


def lenient_json(col: Column) -> Column:
    """VARIANT from loosely formatted JSON text.

    Code fences are removed and backslashes that start no JSON escape are doubled; when the whole
    text is no JSON the first flat ``{...}`` object in it is parsed.
    """
    bare = strip(F.regexp_replace(strip(col), r"```(?:json)?\n?", ""))
    bare = strip(F.regexp_replace(bare, r"^`+|`+$", ""))
    # an escaped pair is matched first and kept, so only lone invalid escapes are doubled
    fixed = F.regexp_replace(bare, r'(\\["\\/bfnrtu])|\\', r"$1\\\\")
    fixed = F.regexp_replace(fixed, r'(\\["\\/bfnrtu])\\\\', "$1")
    inner = F.regexp_extract(fixed, r"\{[^{}]+\}", 0)
    return F.coalesce(F.try_parse_json(fixed), F.try_parse_json(F.nullif(inner, F.lit(""))))


def clamp_confidence(col: Column) -> Column:
    """'high', 'medium' or 'low'; anything else is 'medium'."""
    return F.when(col.isin(*dims.CONFIDENCES), col).otherwise(F.lit("medium"))


def regex_escape(col: Column) -> Column:
    """Escape the characters that are special in a regular expression."""
    return F.regexp_replace(col, r"([^A-Za-z0-9_])", r"\\$1")


def quoted(col: Column) -> Column:
    """A column's text as a literal inside a Java regular expression."""
    return F.concat(F.lit(r"\Q"), col, F.lit(r"\E"))


def _quote(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_/" else "\\" + c for c in text)


def alternation(names) -> str:
    """Regular-expression alternation of literal names."""
    return "|".join(_quote(n) for n in names)
