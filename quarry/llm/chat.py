"""Multi-party perspective rotation of dialogues.

For every participant of a conversation (each role but ``system``) the
whole dialogue is rendered once with that speaker as the assistant, the
others as named users and system turns as they are.  A row is one turn of
one rendering: its text, its character span in the rendering, and the span
that the loss covers (text and end mark of the assistant's turns).  The
rendering is the rows' texts in the order of ``start``.

A rendering of a very long conversation is never put together in one task:
turns are range-partitioned by (conversation, speaker, turn) and the spans
are running sums over partitions.

Turns are ordered by turn (nulls first), equal ones by role and text;
repeated rows are separate turns.  A null role is the speaker ``unknown``,
a null text is empty, rows of a null conversation form one conversation.
Marks inside a text are broken with a space, so no text can end its turn.
A conversation of system turns only has no participant and no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import exact, running_sum, text_column

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"


def _plain(c: Column) -> Column:
    return F.regexp_replace(c, r"<\|", "< |")


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, perspective, turn, speaker, role, rendered, start, end, mask_start, mask_end."""
    turns = exact(turns, conv_col, turn_col, role_col, text_col)
    said = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("speaker"),
                        text_column(turns, text_col).alias("text"))
    who = said.filter(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("_c"), F.col("speaker").alias("perspective")).distinct()
    each = said.join(who, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    role = F.when(F.col("speaker") == SYSTEM, "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    head = F.concat(F.lit(START), F.col("role"), F.when(F.col("role") == "user", F.concat(F.lit(" name="), _name(F.col("speaker")))).otherwise(""),
                    F.lit("\n"))
    each = each.withColumn("role", role).withColumn("_head", head) \
        .withColumn("rendered", F.concat("_head", _plain(F.col("text")), F.lit(END + "\n"))) \
        .withColumn("_length", F.length("rendered").cast("long"))
    order = [F.col("turn").asc_nulls_first(), F.col("speaker").asc(), F.col("text").asc()]
    placed = running_sum(each, ["conv_id", "perspective"], order, "_length", "start", "chat-turns")
    speaks = F.col("role") == "assistant"
    return placed.select(
        "conv_id", "perspective", "turn", "speaker", "role", "rendered", "start", (F.col("start") + F.col("_length")).alias("end"),
        F.when(speaks, F.col("start") + F.length("_head")).alias("mask_start"),
        F.when(speaks, F.col("start") + F.col("_length") - 1).alias("mask_end"))


def _name(c: Column) -> Column:
    """A speaker's name on one line without marks."""
    return F.regexp_replace(c, r"[\s<>|]+", "_")


def oracle_sql() -> str:
    return rf"""
    WITH t AS (SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations)
      , w AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> '{SYSTEM}')
      , e AS (SELECT t.*, perspective, CASE WHEN speaker = '{SYSTEM}' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
              FROM t JOIN w ON t.conv_id IS NOT DISTINCT FROM w.conv_id)
      , h AS (SELECT *, '{START}' || role || CASE WHEN role = 'user' THEN ' name=' || regexp_replace(speaker, '[\s<>|]+', '_', 'g') ELSE '' END
                || chr(10) AS head FROM e)
      , d AS (SELECT *, head || replace(text, '<|', '< |') || '{END}' || chr(10) AS rendered FROM h)
      , s AS (SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text, r
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "start" FROM d)
    SELECT conv_id, perspective, turn, speaker, role, rendered, "start", "start" + length(rendered) AS "end",
      CASE WHEN role = 'assistant' THEN "start" + length(head) END AS mask_start,
      CASE WHEN role = 'assistant' THEN "start" + length(rendered) - 1 END AS mask_end FROM s"""
