import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, valid string"
NASTY = st.lists(st.sampled_from([*"\\#<:/turn>bhlc \n\u00e9\U0001f600", "</turn>", "### ", "\\h"]), max_size=12).map("".join)


def want(turns):
    body = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(body.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a:b", "#"]), NASTY), min_size=1, max_size=5), min_size=1, max_size=20))
def test_round_trip(spark, conversations):
    rows = [(c, k, r, t, "x") for c, turns in enumerate(conversations) for k, (r, t) in enumerate(turns)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.chat_digests(chat.format_chats(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {c: want(turns) for c, turns in enumerate(conversations)}


def test_order_and_nulls(spark):
    rows = [(1, 0, "user", "q", ""), (1, 1, "assistant", "a", ""), (2, 0, "assistant", "a", ""), (3, 0, "system", None, ""), (3, 1, "user", "", ""), (3, 2, "assistant", "z", ""), (4, 0, "user", "q", ""), (4, 1, "user", "q", ""), (None, None, None, None, "")]
    out = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [(out[c].valid, out[c].bad_turn) for c in (1, 2, 3, 4, None)] == [(True, None), (False, 0), (True, None), (False, 1), (False, 0)]
    assert out[1].formatted == "### user: q</turn>\n### assistant: a</turn>\n"
    assert [(s.text, s.loss) for s in out[1].segments if s.loss] == [("a", True)]
    assert "".join(s.text for s in out[3].segments) == out[3].formatted
    assert chat.chat_digests(chat.format_chats(spark.createDataFrame([], SCHEMA))).count() == 0


def test_a_very_long_conversation(spark):
    rows = spark.range(20_000).selectExpr("0L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('text ', id) AS text")
    r = chat.format_chats(rows).selectExpr("n_turns", "valid", "length(formatted) AS n").first()
    assert r.n_turns == 20_000 and r.valid and r.n > 400_000
