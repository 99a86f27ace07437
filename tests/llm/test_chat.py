"""Layouts, the template and reading back."""

from __future__ import annotations

import hashlib
import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from defectlake.llm import chat

SCHEMA = "conv_id bigint, turn bigint, record string, layout_hint string"
RECORDS = [
    (1, 0, {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages"),
    (2, 0, {"messages": []}, "messages"),
    (3, 0, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, "from_value"),
    (4, 0, {"prompt": "p", "response": "r"}, "prompt_response"),
    (5, 0, {"completion": "c", "prompt": "p"}, "prompt_response"),
    (6, 0, {"instruction": "i", "input": "x", "output": "o"}, "instruction"),
    (7, 0, {"instruction": "i", "output": "o"}, "instruction"),
    (8, 1, {"turn": 1, "role": "assistant", "text": "later"}, "turn"),
    (8, 0, {"turn": 0, "role": None, "text": None}, "turn"),
    (9, 0, {"strange": {"deep": [1, 2]}}, None),
    (10, 0, {"system": "s", "prompt": "p", "response": "r"}, "system_prompt_response"),
]


def test_layouts(spark):
    rows = [(c, t, json.dumps(r), h) for c, t, r, h in RECORDS] + [(11, 0, "no json", None), (12, 0, None, None)]
    got = chat.canonical_turns(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r.layout for r in got] == [r.layout_hint for r in got]
    turns = {(r.conv_id, r.turn): r.turns and [tuple(t) for t in r.turns] for r in got}
    assert turns[1, 0] == [("user", "q"), ("assistant", "a")] and turns[2, 0] == []
    assert turns[3, 0] == [("user", "q"), ("assistant", "")]
    assert turns[4, 0][1] == ("assistant", "r") and turns[5, 0][1] == ("assistant", "c")
    assert turns[6, 0] == [("user", "i\n\nx"), ("assistant", "o")] and turns[7, 0][0] == ("user", "i")
    assert turns[8, 0] == [("", "")] and turns[9, 0] is None
    formatted = {r.conv_id: r for r in chat.format_conversations(chat.canonical_turns(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert formatted[8].formatted.endswith('<turn role="assistant">later</turn>\n') and formatted[2].formatted == ""
    assert 9 not in formatted


def test_further_fields_pass_and_what_fits_nothing_is_listed(spark):
    said = [{"role": "user", "content": "q", "name": "n"}, {"role": "assistant", "content": "a"}]
    records = [
        ({"id": 1, "messages": said}, [("user", "q"), ("assistant", "a")]),
        ({"prompt": "p", "response": "r", "source": "s"}, [("user", "p"), ("assistant", "r")]),
        ({"system": "s", "prompt": "p", "response": "r", "id": 3}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ({"id": "x", "conversations": [{"from": "gpt", "value": "v", "weight": 1}]}, [("assistant", "v")]),
        ({"instruction": "i", "output": "o", "id": 5}, [("user", "i"), ("assistant", "o")]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}]}, None),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "z"}]}]}, None),
        ({"prompt": ["p"], "response": "r", "id": 1}, None),
    ]
    rows = [(i, 0, json.dumps(r), "") for i, (r, _) in enumerate(records)] + [(50, 0, "no json", ""), (51, 0, None, "")]
    turns = chat.canonical_turns(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: r.turns and [tuple(t) for t in r.turns] for r in turns.collect()}
    assert [got[i] for i in range(len(records))] == [want for _, want in records]
    listed = chat.rejected_records(turns).collect()
    assert sorted(r.n_records for r in listed) == [1, 2, 2] and [r.n_records for r in listed if r.paths is None] == [2]
    assert chat.rejected_records(turns.limit(0)).count() == 0


def test_fingerprint_ignores_types_and_order(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"c": null}}', '{"b": {"c": "x"}, "a": "y"}', '{"a": 1, "b": {"d": 1}}')], "x string, y string, z string")
    x, y, z = df.select(*[chat.fingerprint(F.col(c)) for c in "xyz"]).first()
    assert x == y != z


PARTS = [*'\\<>"/lqtn \n#é🎉', "</turn>", '<turn role="', "\\\\", "\\l"]
text = st.lists(st.sampled_from(PARTS), max_size=12).map("".join)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", 'a"<\\']), text), max_size=5), min_size=20, max_size=20))
def test_round_trip(spark, conversations):
    rows = [(i, k, json.dumps({"turn": k, "role": r, "text": t}), "") for i, c in enumerate(conversations) for k, (r, t) in enumerate(c)]
    rows.append((-1, 0, json.dumps({"turn": 0, "role": "user", "text": r"\### Assistant: </turn> ok"}), ""))
    made = chat.format_conversations(chat.canonical_turns(spark.createDataFrame(rows, SCHEMA)))
    back = made.select(
        "conv_id", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"),
    ).collect()
    want = {i: [tuple(x) for x in c] for i, c in enumerate(conversations) if c}
    want[-1] = [("user", r"\### Assistant: </turn> ok")]
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in back} == want
    assert {r.conv_id: r.loss for r in back} == {i: "".join(t for r, t in c if r == "assistant") for i, c in want.items()}


def test_planted_conversation(spark, sf_dir):
    row = chat.op4_chat_format(spark, sf_dir).where("conv_id = -7").first()
    said = r"\### Assistant: </turn> ok"
    assert row.n_turns == 2 and row.loss_chars == len(said)
    assert row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_many_turns_keep_their_places(spark):
    rows = [(1, k, json.dumps({"turn": k, "role": "assistant" if k % 3 else "user", "text": f"t{k}"}), "") for k in range(700)]
    made = chat.format_conversations(chat.canonical_turns(spark.createDataFrame(rows, SCHEMA)))
    assert made.select(chat.read_loss(F.col("formatted"), F.col("loss_mask"))).first()[0] == "".join(f"t{k}" for k in range(700) if k % 3)


def test_empty(spark):
    assert chat.format_conversations(chat.canonical_turns(spark.createDataFrame([], SCHEMA))).count() == 0
