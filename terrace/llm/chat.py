"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role
are merged into one block by slicing and joining arrays. A block reads
``<turn>role<text>first text<text>second text</turn>``. In roles and texts ``\\`` becomes
``\\b`` and ``<`` becomes ``\\l``, so that no text can hold a marker and everything can be
read back. The loss mask marks what is to be learned: each assistant text, nothing else.

A formatted conversation is one value, and so its turns meet in one row; turns are collected
in each map task before they are shuffled. Every step is linear in the number of turns.
NULL roles and texts are empty; turns of equal number are ordered by role, then text;
rows without conv_id are one conversation; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<turn>", "<text>", "</turn>"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def format_chat(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, and segments: the formatted text cut into (text, loss) pieces."""
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("said"),
    )
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))

    said = F.col("said")
    place = F.sequence(F.lit(1), F.size(said))  # 1-based
    begins = F.filter(
        place,
        lambda i: (i == 1) | (F.get(said, i - 1)["role"] != F.get(said, i - 2)["role"]),
    )
    runs = sorted_turns.withColumn("begins", begins)

    def block(begin: Column, k: Column) -> Column:
        until = F.coalesce(F.get(F.col("begins"), k + 1), F.size(said) + 1)
        return F.struct(
            F.get(said, begin - 1)["role"].alias("role"),
            F.transform(F.slice(said, begin, until - begin), lambda t: t["text"]).alias("texts"),
        )

    merged = runs.select("conv_id", F.transform("begins", block).alias("blocks"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def segments(b: Column) -> Column:
        learned = b["role"] == LEARNED
        texts = F.transform(
            b["texts"],
            lambda t: F.array(segment(F.lit(TEXT), F.lit(False)), segment(escape(t), learned)),
        )
        opening = segment(F.concat(F.lit(TURN), escape(b["role"])), F.lit(False))
        closing = segment(F.lit(END), F.lit(False))
        return F.concat(F.array(opening), F.flatten(texts), F.array(closing))

    cut = merged.select("conv_id", F.flatten(F.transform("blocks", segments)).alias("segments"))
    joined = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return cut.select("conv_id", joined.alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns in a formatted conversation: an array of (role, text)."""
    blocks = F.filter(F.split(formatted, END), lambda b: b != "")
    parts = F.transform(blocks, lambda b: F.split(F.substring(b, len(TURN) + 1, 2**31 - 1), TEXT))

    def turns(p: Column) -> Column:
        role = unescape(F.get(p, F.lit(0)))
        texts = F.slice(p, F.lit(2), F.size(p) - 1)
        return F.transform(
            texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text"))
        )

    return F.flatten(F.transform(parts, turns))


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, as it was said."""
    under = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(under, lambda s: unescape(s["text"])), "")
