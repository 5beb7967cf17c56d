import random

import pytest
from pyspark.sql import functions as F

from hydrolake.llm import chat
from hydrolake.llm.queries import ORACLES, QUERIES
from tests.oracle import compare

SCHEMA = "conv_id bigint, turn int, role string, text string, formatted string, segments int"


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)


def read(spark, rows):
    out = chat.format_conversations(made(spark, rows))
    return {r["conv_id"]: r for r in out.select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss_text")).collect()}


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(4)
    bits = [*chat.INSTRUCT.controls, "\\", "\\\\", "<", "[", "s>", "/INST]", " ", "\n", "é", "😀", "a", "<<SYS>>\n", "$1", "[/ROLE] "]
    rows, want = [], {}
    for c in range(150):
        turns = []
        for t in range(rng.randrange(1, 8)):
            role = rng.choice(["system", "user", "assistant", "tool", "", "[/ROLE]", "user "])
            text = rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randrange(12)))])
            rows.append((c, t, role, text))
            turns.append((role, text or ""))
        want[c] = turns
    got = read(spark, rows)
    assert {c: [(t["role"], t["text"]) for t in r["turns"]] for c, r in got.items()} == want
    for c, r in got.items():
        assert r["loss_text"] == "".join(text for role, text in want[c] if role == "assistant")
        assert r["formatted"] == "".join(s["text"] for s in r["segments"])


@pytest.mark.parametrize(
    "roles, valid",
    [
        (["user", "assistant"], True),
        (["system", "user", "assistant", "user", "assistant"], True),
        (["user"], False),
        (["assistant"], False),
        (["user", "user", "assistant"], False),
        (["user", "assistant", "system"], False),
        (["user", "tool", "assistant"], False),
        ([None, "assistant"], False),
    ],
)
def test_turn_order(spark, roles, valid):
    assert read(spark, [(1, i, r, "t") for i, r in enumerate(roles)])[1]["valid"] is valid


def test_null_ids_ties_and_repeated_rows(spark):
    got = read(spark, [(None, 0, "user", "b"), (None, 0, "user", "a"), (None, 0, "user", "a"), (None, None, None, None)])
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")]


def test_long_conversation(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "</s> word " * 300) for i in range(400)]
    r = read(spark, rows)[1]
    assert len(r["turns"]) == 400 and r["valid"] and r["loss_text"] == "</s> word " * 60_000


def test_empty_table(spark):
    assert chat.format_conversations(made(spark, [(1, 1, "user", "a")]).limit(0)).collect() == []


def test_template_must_be_readable():
    with pytest.raises(ValueError):
        chat.Template({"user": chat.Turn("u", "no mark")}, ("[X]",), {"": ("user",)}, ("user",), other=("[X]", "[X]", "[X]"))


def test_query_matches_sql(spark, duck, sf):
    assert compare(spark, duck, QUERIES["op7_chat_format"], ORACLES["op7_chat_format"], sf) == ""
