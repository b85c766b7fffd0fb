import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hanok.llm import chat

PARTS = ["[INST]", "[/INST]", " [/INST]", "</s>", "<s>", "[SYS]", "[/SYS]", "[TURN ", "]", "[/TURN]", "\\", "\\\\", "a", " ", "\n", "é", "語", "\x00"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=8).map("".join)
ROLE = st.sampled_from(["user", "assistant", "system", "", "tool", "x] y", "[/TURN]"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ROLE, TEXT), min_size=1, max_size=6))
def test_round_trip(turns):
    out, ends, inner, outer, taught = chat.assemble(pa.array([r for r, _ in turns]), pa.array([t for _, t in turns]))
    raw = out.tobytes()
    assert chat.parse(raw.decode()) == turns
    starts = [0, *ends[:-1].tolist()]
    for i, (role, text) in enumerate(turns):
        assert chat.parse(raw[starts[i] : ends[i]].decode()) == [(role, text)]
        assert chat.unescape(raw[inner[i] : outer[i]].decode()) == text and taught[i] == (role == "assistant")


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns = sorted(turns)
        taught = "".join(t for *_, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest(), len(taught), hashlib.sha256(taught.encode()).hexdigest())
    return out


@pytest.mark.parametrize("batch", [3, 10_000])
def test_query_digests_survive_batch_borders(spark, batch):
    rows = [(i % 5, i // 5, ("user", "assistant", "system", None, "tool")[i % 7 % 5], (None, "", "hello [INST]", "</s> ü", "long " * 5000)[i % 5]) for i in range(60)]
    rows += [(9, 1, "user", "same")] * 3 + [(9, None, "assistant", "no number"), (None, 0, "assistant", "no conversation"), (8, 0, "user", None)]
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string, piece int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(chat.format_chats(turns)).collect()}
        pieces = chat.format_chats(turns).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    assert got == brute(rows)
    assert all(len(r.loss_starts) == len(r.loss_ends) and r.turns == len(chat.parse(r.formatted)) for r in pieces)


def test_empty_table(spark):
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.read_back(chat.format_chats(turns)).count() == 0


def test_hot_conversation(spark):
    turns = spark.range(6000).selectExpr("if(id % 3 = 0, 1, id) AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    got = {r.conv_id: r.n_turns for r in chat.read_back(chat.format_chats(turns)).collect()}
    assert got[1] == 2001 and sum(got.values()) == 6000
