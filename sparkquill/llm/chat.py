"""Chat formatting: logs of events folded into messages, messages rendered by a template that can be read back.

A log is partitioned by conversation and folded in order of its sequence numbers; what is rendered is one row for each
conversation, built by one shuffle on its id. The template marks turns with MARKS. Inside texts a backslash is doubled, and
put after the first character of every control string (this template's marks and those of common others), so no text can
open or end a turn; taking every backslash before a character away reverses that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = MARKS = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings: <|, <s>, </s>, <<SYS>>, <</SYS>>, [INST], [/INST].
CONTROL = ((r"<(\||/?s>|</?SYS>>)", "<"), (r"\[(/?INST\])", "["))


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for pattern, first in CONTROL:
        text = F.regexp_replace(text, pattern, first + r"\\$1")
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) from a log (conv_id, seq, turn, op, role, text).

    op: ``message`` and ``edit`` set the text of a turn, ``regenerate`` starts it anew, ``delta`` adds to it. An edit or a
    regeneration also drops what stood in later turns before it. The last role that isn't null holds. Null texts count as
    empty; a turn of deltas only is their sum; events of one sequence number go by op, then text. An unknown op counts as delta.
    """
    by_turn = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    log = events.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("seq").cast("long").alias("seq"), F.coalesce("op", F.lit("delta")).alias("op"), "role", F.coalesce("text", F.lit("")).alias("text"))
    dropped = F.max(F.when(F.col("op").isin("edit", "regenerate"), F.col("seq"))).over(by_turn)
    log = log.withColumn("dropped", dropped).where(F.col("dropped").isNull() | (F.col("seq") > F.col("dropped")))
    sets = F.col("op").isin("message", "edit", "regenerate")
    turns = log.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("seq", "op", "text", sets.alias("sets"), "role"))).alias("x"))
    last = F.array_max(F.transform("x", lambda e, i: F.when(e["sets"], i).otherwise(0)))
    roles = F.filter("x", lambda e: e["role"].isNotNull())
    return turns.select("conv_id", "turn", F.when(F.size(roles) > 0, F.element_at(roles, -1)["role"]).alias("role"), F.array_join(F.transform(F.slice("x", last + 1, F.size("x")), lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row for each conversation of messages (conv_id, turn, role, text): conv_id, formatted, loss_mask (array<boolean>, for each
    turn whether its text is trained on) and loss_spans (array<struct<start, end>>, code points of formatted under the mask).

    Turns are in order of turn, role, text. Null roles and texts count as empty; a null conv_id is a conversation of its own.
    """
    role, text = (escape(F.coalesce(c, F.lit(""))) for c in ("role", "text"))
    rows = messages.select("conv_id", "turn", "role", "text", role.alias("r"), text.alias("t"), F.coalesce(F.col("role") == trained_role, F.lit(False)).alias("loss"))
    pieces = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "r", "t", "loss"))).alias("x"))
    formatted = F.array_join(F.transform("x", lambda e: F.concat(F.lit(TURN), e["r"], F.lit(TEXT), e["t"], F.lit(END))), "")
    marks = sum(map(len, MARKS))
    lengths = F.transform("x", lambda e: F.struct((F.length(e["r"]) + F.length(e["t"]) + marks).alias("all"), F.length(e["t"]).alias("text"), e["loss"].alias("loss")))

    def step(state, e):
        end = state["at"] + e["all"]
        span = F.struct((end - len(END) - e["text"]).alias("start"), (end - len(END)).alias("end"))
        return F.struct(end.alias("at"), F.when(e["loss"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return pieces.select("conv_id", formatted.alias("formatted"), F.transform("x", lambda e: e["loss"]).alias("loss_mask"), F.aggregate(lengths, start, step)["spans"].alias("loss_spans"))


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask, turns array<struct<role, text>>) parsed from what render wrote."""

    def turn(part):
        halves = F.split(part, r"<\|text\|>", 2)
        return F.struct(unescape(halves[0]).alias("role"), unescape(F.substring(halves[1], F.lit(1), F.length(halves[1]) - len(END))).alias("text"))

    parts = F.split("formatted", r"<\|turn\|>")
    return rendered.select("conv_id", "formatted", "loss_mask", F.transform(F.slice(parts, F.lit(2), F.size(parts)), turn).alias("turns"))


def as_log(conversations: DataFrame) -> DataFrame:
    """A table (conv_id, turn, role, text) of finished messages as a log: one event for each row, rows that repeat a turn included."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))))
    return conversations.select("conv_id", place.alias("seq"), place.alias("turn"), F.lit("message").alias("op"), "role", "text")


def format_digest(conversations: DataFrame) -> DataFrame:
    """One row for each conversation that sums up its formatted text as read back; an empty table gives an empty result."""
    turns = read_back(render(fold_events(as_log(conversations.select("conv_id", "turn", "role", "text")))))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join(F.zip_with("turns", "loss_mask", lambda t, m: F.when(m, t["text"]).otherwise("")), "")
    digest = turns.select("conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"), trained.alias("trained"))
    return digest.select("conv_id", "n_turns", "turns_sha256", F.length("trained").cast("long").alias("loss_chars"), F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *,
    regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(\||/?s>|</?SYS>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS r,
    regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\||/?s>|</?SYS>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS t
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|turn|>') + length(r) + length('<|text|>') + length(t) + length('<|end|>')) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
