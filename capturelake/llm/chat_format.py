"""Chat formatting by perspective rotation, in DataFrame operations only.

Every participant of a conversation gets its own rendering: its turns are the
assistant's, all others are named users, and the mask covers what the
assistant says. System turns stay system turns and are nobody's perspective, so
a conversation of system turns alone gives no row. A null role is the speaker
``unknown``, a null text is empty, a null turn comes first, and rows without a
conversation id form one conversation. Repeated turns are rendered each; ties go
by role and text. Other columns are not read; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import HOT_ROWS, running_total

START, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM_ROLES = ("system",)
#: Turns of a rendered segment; a longer conversation gives several, so that no conversation is gathered whole.
SEGMENT = 256


def plain(text: Column) -> Column:
    """Text in which nothing reads as a marker."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _spans(turns: Column) -> Column:
    """(start, length) of the assistant's words, from turns (own, head, body) in order, in characters."""
    def add(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.char_length(t["head"])
        size = F.char_length(t["body"])
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct((start + size).alias("at"), F.when(t["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return F.aggregate(turns, empty, add, lambda acc: acc["spans"])


def rotate_perspectives(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                        system_roles: Sequence[str] = SYSTEM_ROLES, segment: int = SEGMENT, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows (conversation, perspective, segment, turns, text, spans); the spans of trained characters are relative to the text."""
    rows = df.select(
        # A structure is never null itself, so the conversation without an id joins like any other.
        F.struct(F.col(f"`{conversation}`").alias("id")).alias("conv"), F.col(f"`{turn}`").alias("turn"),
        F.regexp_replace(F.coalesce(F.col(f"`{role}`"), F.lit("unknown")), r"[\s<|>]+", "_").alias("speaker"),
        plain(F.col(f"`{text}`")).alias("words"))
    placed = running_total(rows, ["conv"], [F.col("turn"), F.col("speaker"), F.col("words")], "idx", hot_rows=hot_rows)
    parts = (
        placed.withColumn("segment", F.floor(F.col("idx") / segment)).groupBy("conv", "segment")
        .agg(F.array_sort(F.collect_list(F.struct("idx", "speaker", "words"))).alias("turns"))
    )
    people = rows.filter(~F.col("speaker").isin(*system_roles)).groupBy(F.col("conv").alias("whose"), "speaker").agg(
        F.count(F.lit(1)).alias("said")).select("whose", F.col("speaker").alias("perspective"))
    views = parts.join(people, F.col("conv") == F.col("whose"))

    def piece(t: Column) -> Column:
        own = t["speaker"] == F.col("perspective")
        name = F.when(own, "assistant").when(t["speaker"].isin(*system_roles), t["speaker"]).otherwise(F.concat(F.lit("user name="), t["speaker"]))
        return F.struct(own.alias("own"), F.concat(F.lit(START), name, F.lit("\n")).alias("head"), F.concat(t["words"], F.lit(END)).alias("body"))

    rendered = views.select("conv", "perspective", "segment", F.transform("turns", piece).alias("turns"))
    return rendered.select(
        F.col("conv.id").alias(conversation), "perspective", "segment", F.size("turns").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"])), "").alias("text"), _spans(F.col("turns")).alias("spans"))
