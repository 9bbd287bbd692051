import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessella.llm import chat

from .compare import agree

F = chat.Formatter(chat.TEMPLATE)
PIECES = st.lists(st.sampled_from([*chat.TEMPLATE.controls(), "\\", "<", "[", "/", " ", "\n", "a", "é", "INST]", "s>"]), max_size=12).map("".join)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), PIECES), PIECES), max_size=6))
def test_every_turn_comes_back(turns):
    segments, _ = F.segments(turns)
    assert F.parse("".join(t for t, _ in segments)) == turns
    assert [F.unescape(t) for t, loss in segments if loss] == [t for r, t in turns if r == "assistant"]


@pytest.mark.parametrize(("roles", "wrong"), [("ua", None), ("sua", None), ("uaua", None), ("uu", 1), ("au", 0), ("su", 2), ("s", 1), ("", 0), ("uxa", 1), ("usa", 1)])
def test_machine(roles, wrong):
    names = {"u": "user", "a": "assistant", "s": "system", "x": "tool"}
    assert F.segments([(names[r], "t") for r in roles])[1] == wrong


def test_rows(spark):
    rows = [(1, 1, "assistant", None, 5), (1, 0, "user", "q", 5), (2, None, None, "x", 5), (2, 0, "assistant", "y", 5), (2, 0, "assistant", "y", 5), (None, 0, "user", "n", 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    chats = chat.format_chats(df)
    assert {r.conv_id: (r.n_turns, r.valid, r.wrong_at) for r in chats.collect()} == {1: (2, True, None), 2: (3, False, 0), None: (1, False, 1)}
    got = {r.conv_id: r for r in chat.read_chats(chats).collect()}
    assert got[2].turns_sha256 == hashlib.sha256(b"\nx\nassistant\ny\nassistant\ny\n").hexdigest()
    assert (got[2].loss_chars, got[2].loss_sha256) == (2, hashlib.sha256(b"yy").hexdigest())
    assert (got[1].loss_chars, got[1].loss_sha256) == (0, hashlib.sha256(b"").hexdigest())
    assert chat.read_chats(chat.format_chats(df.limit(0))).count() == 0


def test_sql(spark):
    agree(spark, chat.op4_chat_segments, chat.ORACLE_SQL["op4_chat_segments"])
