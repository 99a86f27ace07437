r"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record is a JSON text of any layout. Its fingerprint is a hash of its nested field paths, without
types, so that a null, a number and a string in a field give the same one. A fingerprint selects a layout: a
declared expression that turns the record into (role, text) pairs. A record with further fields has a fingerprint of its own;
it takes the first layout whose required fields it has as text. The rest, such as messages whose content is a list, are kept
apart and listed with their paths (``rejected_records``), for someone to declare.

The template writes ``<turn role="ROLE">TEXT</turn>`` and a line end for each turn. In roles and texts a
backslash is written ``\\``, ``<`` is ``\l`` and ``"`` is ``\q``, so no text can close a turn or open one, and
reading gives back every character. The loss mask is a list of places in the formatted string, one for each
assistant text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from defectlake.llm.spans import BLOCK, _total

TURNS = "array<struct<role:string,text:string>>"
#: turn of a record that holds a whole conversation
WHOLE = 0


@dataclass(frozen=True)
class Layout:
    """``examples`` are records whose paths have this layout; ``turns`` is SQL over the variant ``v``.

    ``needs`` is SQL over ``v`` that tells of a record with other fields, too, whether it has what the layout requires.
    """

    name: str
    examples: tuple[str, ...]
    turns: str
    needs: str = "false"


def _texts(*names: str) -> str:
    """Fields that are there and are text."""
    return " AND ".join(f"schema_of_variant(variant_get(v, '$.{n}')) = 'STRING'" for n in names)


def _texts_in(field: str, first: str, second: str) -> str:
    """A list whose items all have text in two fields, named in order."""
    more = "([^<>]*, )?"
    return (
        f"schema_of_variant(variant_get(v, '$.{field}')) "
        f"RLIKE '^ARRAY<OBJECT<{more}{first}: STRING, {more}{second}: STRING[,>]'"
    )


def _string(path: str) -> str:
    return f"variant_get(v, '{path}', 'string')"


LAYOUTS = (
    Layout("turn", ('{"turn": 0, "role": "", "text": ""}',), f"array(struct({_string('$.role')}, {_string('$.text')}))",
           _texts("role", "text")),
    Layout(
        "messages",
        ('{"messages": [{"role": "", "content": ""}]}', '{"messages": []}'),
        "transform(variant_get(v, '$.messages', 'array<struct<role:string,content:string>>'), m -> struct(m.role, m.content))",
        _texts_in("messages", "content", "role"),
    ),
    Layout(
        "from_value",
        ('{"conversations": [{"from": "", "value": ""}]}', '{"conversations": []}'),
        "transform(variant_get(v, '$.conversations', 'array<struct<`from`:string,`value`:string>>'), "
        "m -> struct(CASE m.`from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.`from` END, m.`value`))",
        _texts_in("conversations", "from", "value"),
    ),
    Layout(
        "prompt_response",
        ('{"prompt": "", "response": ""}', '{"prompt": "", "completion": ""}'),
        f"array(struct('user', {_string('$.prompt')}), "
        f"struct('assistant', coalesce({_string('$.response')}, {_string('$.completion')})))",
        f"variant_get(v, '$.system') IS NULL AND {_texts('prompt')} AND ({_texts('response')} OR {_texts('completion')})",
    ),
    Layout(
        "instruction",
        ('{"instruction": "", "output": ""}', '{"instruction": "", "input": "", "output": ""}'),
        f"array(struct('user', concat_ws('\\n\\n', {_string('$.instruction')}, nullif({_string('$.input')}, ''))), "
        f"struct('assistant', {_string('$.output')}))",
        f"{_texts('instruction', 'output')} AND (variant_get(v, '$.input') IS NULL OR {_texts('input')})",
    ),
    Layout(
        "system_prompt_response",
        ('{"system": "", "prompt": "", "response": ""}',),
        f"array(struct('system', {_string('$.system')}), struct('user', {_string('$.prompt')}), "
        f"struct('assistant', {_string('$.response')}))",
        _texts("system", "prompt", "response"),
    ),
)


def field_paths(record: Column) -> Column:
    """Nested field names of a JSON text, sorted, without the types of their values; null if it is no JSON."""
    schema = F.schema_of_variant(F.try_parse_json(record))
    leaf = r": (VOID|STRING|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL\([0-9]+,[0-9]+\)|VARIANT)"
    return F.regexp_replace(schema, leaf, "")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(field_paths(record))


def canonical_turns(records: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """``records`` (conv_id, turn, record) with fingerprint, layout and turns, an array of (role, text).

    A declared fingerprint decides; else the first layout whose ``needs`` hold. Null roles and texts become empty. The layout of a record that matches none is null and so are its turns.
    Repeated records are kept. Other columns are kept as they are.
    """
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for each in reversed(layouts):
        fits = F.expr(each.needs)
        layout, turns = F.when(fits, each.name).otherwise(layout), F.when(fits, F.expr(each.turns).cast(TURNS)).otherwise(turns)
    for each in layouts:
        known = F.col("fingerprint").isin([fingerprint(F.lit(x)) for x in each.examples])
        layout = F.when(known, each.name).otherwise(layout)
        turns = F.when(known, F.expr(each.turns).cast(TURNS)).otherwise(turns)
    filled = F.transform(
        "turns",
        lambda t: F.struct(
            F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")
        ),
    )
    return (
        records.withColumn("v", F.try_parse_json("record"))
        .withColumn("fingerprint", F.when(F.col("v").isNotNull(), fingerprint(F.col("record"))))
        .withColumns({"layout": layout, "turns": turns})
        .withColumn("turns", filled)
        .drop("v")
    )


def rejected_records(turns: DataFrame) -> DataFrame:
    """Records that took no layout: fingerprint, paths and n_records, a row for each set of paths.

    ``turns`` comes from ``canonical_turns``. Both are null for what is no JSON.
    """
    return (
        turns.where(F.col("layout").isNull())
        .select("fingerprint", F.when(F.col("fingerprint").isNotNull(), field_paths(F.col("record"))).alias("paths"))
        .groupBy("fingerprint", "paths").agg(F.count(F.lit(1)).alias("n_records"))
    )


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("<"), F.lit("\\l")), F.lit('"'), F.lit("\\q"))


def unescaped(text: Column) -> Column:
    # between escaped backslashes every backslash opens another escape
    parts = F.transform(
        F.split(text, r"\\\\"),
        lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\q"), F.lit('"')),
    )
    return F.array_join(parts, "\\")


OPEN, MIDDLE, CLOSE = '<turn role="', '">', "</turn>\n"


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, turns): conv_id, formatted, loss_mask.

    The parts of a conversation are ordered by turn, then place in the record, then role and text. loss_mask is an
    array of (start, length) in code points of ``formatted``. A conversation without turns gives an empty
    string. Rows with a null conv_id form one conversation.
    """
    part = F.struct("turn", "place", F.col("part.role").alias("role"), F.col("part.text").alias("text"))
    grouped = (
        turns.where(F.col("turns").isNotNull())
        .select("conv_id", "turn", F.posexplode_outer("turns").alias("place", "part"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), part))).alias("parts"))
    )
    pieces = F.transform(
        "parts",
        lambda p: F.struct(
            (p["role"] == "assistant").alias("loss"),
            F.concat(F.lit(OPEN), escaped(p["role"]), F.lit(MIDDLE)).alias("head"),
            escaped(p["text"]).alias("body"),
        ),
    )
    sizes = F.transform(
        "pieces", lambda p: (F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)).cast("bigint")
    )
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("pieces") / BLOCK).cast("int")),
        lambda b: _total(F.col("sizes"), b * BLOCK + 1, F.lit(BLOCK)),
    )

    def masked(p: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        before = _total(F.col("blocks"), F.lit(1), block) + _total(F.col("sizes"), block * BLOCK + 1, i - block * BLOCK)
        return F.when(
            p["loss"], F.struct((before + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))
        )

    return (
        grouped.withColumn("pieces", pieces)
        .withColumn("sizes", sizes)
        .withColumn("blocks", blocks)
        .select(
            "conv_id",
            F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("formatted"),
            F.filter(F.transform("pieces", masked), lambda m: m.isNotNull()).alias("loss_mask"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) pairs of a formatted string."""
    written = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    return F.transform(
        written,
        lambda p: F.struct(
            unescaped(F.regexp_extract(p, f'(?s)^{OPEN}([^"]*){MIDDLE}', 1)).alias("role"),
            unescaped(F.regexp_replace(p, f'(?s)^{OPEN}[^"]*{MIDDLE}', "")).alias("text"),
        ),
    )


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    parts = F.transform(
        mask, lambda m: unescaped(F.substring(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))
    )
    return F.array_join(parts, "")


_HARD = r"\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        "conv_id", "turn", F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record")
    )
    said = [F.struct(F.lit(role).alias("role"), F.lit(_HARD).alias("content")) for role in ("user", "assistant")]
    hard = spark.range(1).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.lit(WHOLE).cast("bigint").alias("turn"),
        F.to_json(F.struct(F.array(*said).alias("messages"))).alias("record"),
    )
    formatted = format_conversations(canonical_turns(rows.unionByName(hard)))
    back = formatted.withColumn("read", read_turns(F.col("formatted"))).withColumn(
        "loss", read_loss(F.col("formatted"), F.col("loss_mask"))
    )
    lines = F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("read").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


_SQL_LENGTH = "length(replace(replace(replace({0}, '\\', '\\\\'), '<', '\\l'), '\"', '\\q'))"
ORACLE_SQL = {
    "op4_chat_format": f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_HARD}'
  UNION ALL SELECT -7, 1, 'assistant', '{_HARD}'),
joined AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS loss,
         sum({_SQL_LENGTH.format('role')} + {_SQL_LENGTH.format('text')} + {len(OPEN + MIDDLE + CLOSE)})::BIGINT AS formatted_chars
  FROM said GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM joined
"""
}
QUERIES = {"op4_chat_format": op4_chat_format}
