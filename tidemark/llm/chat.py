"""Chat formatting: a role state machine, a declarative template and text segments with loss flags.

Everything is a DataFrame expression. A conversation becomes one row (its text is one value), so
the only shuffle is by conversation; a very long conversation is bounded by a row's size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """What surrounds a turn, which roles' texts are trained on, and which role may follow which state.

    A state is named by the last role, ``start`` before the first turn. ``final`` are the states in
    which a conversation may end. Codes replace the characters that the template's own marks are
    made of, so no text can hold a mark: an escaped text has no ``#`` or ``<``, and every backslash
    in it starts a code.
    """

    before_role: str = "### "
    after_role: str = ": "
    after_text: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    transitions: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    final: tuple[str, ...] = ("assistant",)
    # Character, code.
    codes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def _escape(text: Column, template: ChatTemplate) -> Column:
    for mark, code in template.codes:
        text = F.replace(text, F.lit(mark), F.lit(code))
    return text


def unescape(text: Column, template: ChatTemplate) -> Column:
    """Undo the escaping; the backslash comes last, as only it can make a new code."""
    for mark, code in reversed(template.codes):
        text = F.replace(text, F.lit(code), F.lit(mark))
    return text


def format_chats(conversations: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, segments, valid, bad_turn, end_state.

    ``segments`` is an array of (text, loss) whose texts, joined, are ``formatted``; marks have no
    loss, a turn's text has it where its role is one of ``loss_roles``. ``valid`` says whether the
    state machine accepts the order of roles; ``bad_turn`` is the position (from 0) of the first turn
    it refuses, null if none. Invalid conversations are formatted as well, so that the caller decides.

    Turns are ordered by turn, nulls first, ties by role and text; repeated rows are turns each.
    Null role or text: an empty one. Null conv_id: a conversation of its own. Empty table: no rows.
    """
    t = template or ChatTemplate()
    steps = {f"{state}>{role}": role for state, roles in t.transitions.items() for role in roles}
    table = F.create_map(*[F.lit(x) for pair in steps.items() for x in pair])
    chats = (
        conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("_turns"))
    )
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))

    def step(a: Column, x: Column) -> Column:
        to = F.element_at(table, F.concat(a["state"], F.lit(">"), x["role"]))
        return F.struct(
            F.coalesce(to, x["role"]).alias("state"), (a["n"] + 1).alias("n"), F.coalesce(a["bad"], F.when(to.isNull(), a["n"])).alias("bad")
        )

    def pieces(x: Column) -> Column:
        head = F.concat(F.lit(t.before_role), _escape(x["role"], t), F.lit(t.after_role))
        loss = x["role"].isin(*t.loss_roles)
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(_escape(x["text"], t).alias("text"), loss.alias("loss")),
            F.struct(F.lit(t.after_text).alias("text"), F.lit(False).alias("loss")),
        )

    return (
        chats.withColumn("_end", F.aggregate("_turns", start, step))
        .withColumn("segments", F.flatten(F.transform("_turns", pieces)))
        .select(
            "conv_id",
            F.size("_turns").cast("long").alias("n_turns"),
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
            "segments",
            (F.col("_end.bad").isNull() & F.col("_end.state").isin(*t.final)).alias("valid"),
            F.col("_end.bad").alias("bad_turn"),
            F.col("_end.state").alias("end_state"),
        )
    )


def parse_chat(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    t = template or ChatTemplate()
    quoted = "".join(f"\\x{ord(c):02x}" for c in t.after_text)
    parts = F.split(formatted, quoted)

    def turn(x: Column) -> Column:
        body = F.substr(x, F.lit(len(t.before_role) + 1))
        cut = F.instr(body, t.after_role)
        return F.struct(
            unescape(F.substr(body, F.lit(1), cut - 1), t).alias("role"),
            unescape(F.substr(body, cut + len(t.after_role)), t).alias("text"),
        )

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def chat_digests(chats: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Digests read back from the output of ``format_chats``: turns from its text, loss from its segments."""
    t = template or ChatTemplate()
    turns = F.array_join(F.transform("_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], t)), "")
    return (
        chats.withColumn("_turns", parse_chat(F.col("formatted"), t))
        .withColumn("_loss", loss)
        .select(
            "conv_id",
            F.size("_turns").cast("long").alias("n_turns"),
            F.sha2(turns, 256).alias("turns_sha256"),
            F.char_length("_loss").cast("long").alias("loss_chars"),
            F.sha2("_loss", 256).alias("loss_sha256"),
            F.char_length("formatted").cast("long").alias("formatted_chars"),
            "valid",
        )
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (
  SELECT *, lag(role) OVER w AS prev, lead(role) OVER w AS next,
    length(text) + len(regexp_extract_all(text, '[\\#<:]')) + length(role) + len(regexp_extract_all(role, '[\\#<:]')) + 14 AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  bool_and(CASE WHEN prev IS NULL THEN role IN ('system', 'user') WHEN prev = 'system' THEN role = 'user'
                WHEN prev = 'user' THEN role = 'assistant' WHEN prev = 'assistant' THEN role = 'user' ELSE false END
           AND (next IS NOT NULL OR role = 'assistant')) AS valid
FROM o GROUP BY conv_id
"""
