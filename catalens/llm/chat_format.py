"""Conversations in reply order, without the quotations in their messages.

A line's quote level is the number of ">" it begins with. Quoted lines, and runs of lines of one level,
are passages; their text is put in a normal form (small letters, single spaces) and hashed. Messages'
own lines and whole own texts are hashed alike, and a passage belongs to the earliest message of its
conversation that has it. A message answers the message that its quotes of the lowest level name most
(by quoted characters; of equal ones the latest). Following the answers up gives each message's thread
and depth: sorted by thread, depth and turn, every message stands behind the one it answers.

Everything is a column expression or a join on keys; the earliest message per passage is combined before
the shuffle, and no conversation is gathered in one place. Null text counts as empty. Rows without
conversation or turn quote nothing, are quoted by nobody and are threads of their own. Rows with equal
conversation and turn count as one message when links are made, with the passages of all; each keeps its
own text. A message never answers a later one. An empty table gives no rows.
Other columns stay; added ones whose names clash get a leading underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.llm.columns import fresh, let, text_or_empty
from catalens.llm.components import written
from catalens.sources.shared import shared_folder

_QUOTE = r"^\x20{0,3}(?:>\x20?)+"
#: Lines that announce a quotation. Fixed values.
_ANNOUNCES = r"(?i)^\s*(?:on\b.*\bwrote|am\b.*\bschrieb\b.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$"


def parsed_lines(text: Column) -> Column:
    """Array of (level, body) per line."""
    return F.transform(
        F.split(text, "\r?\n", -1),
        lambda line: let(
            F.regexp_extract(line, f"({_QUOTE})", 1),
            lambda q: F.struct(
                F.length(F.regexp_replace(q, "[^>]", "")).alias("level"),
                F.substring(line, F.length(q) + 1, F.length(line)).alias("body"),
            ),
        ),
    )


def own_text(lines: Column) -> Column:
    """What a message says itself: no quoted lines, none that announce them, no blank ends."""
    kept = F.filter(
        lines,
        lambda x, i: (x["level"] == 0)
        & ~(
            x["body"].rlike(_ANNOUNCES)
            & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)
        ),
    )
    text = F.array_join(F.transform(kept, lambda x: x["body"]), "\n")
    return F.regexp_replace(F.regexp_replace(text, r"\A(?:[\x20\t]*\n)+", ""), r"\s+\z", "")


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def quoted_passages(lines: Column) -> Column:
    """Array of (level, text): quoted lines, and runs of more than one line of a level, normalised."""
    single = F.transform(
        F.filter(lines, lambda x: x["level"] > 0),
        lambda x: F.struct(x["level"], normal(x["body"]).alias("text")),
    )
    # Runs: each line goes on with the one before if their levels are equal.
    runs = F.aggregate(
        lines,
        F.struct(
            F.lit(0).alias("level"), F.lit("").alias("text"), F.lit(0).alias("n"),
            F.array().cast("array<struct<level:int,text:string>>").alias("done"),
        ),
        lambda a, x: F.when(
            x["level"] == a["level"],
            F.struct(
                a["level"],
                F.when(a["level"] > 0, F.concat(a["text"], F.lit(" "), x["body"])).otherwise("")
                .alias("text"),
                (a["n"] + 1).alias("n"),
                a["done"],
            ),
        ).otherwise(
            F.struct(
                x["level"].alias("level"), F.when(x["level"] > 0, x["body"]).otherwise("").alias("text"),
                F.lit(1).alias("n"),
                _ended(a).alias("done"),
            )
        ),
        lambda a: _ended(a),
    )
    return F.array_distinct(
        F.filter(
            F.concat(single, F.transform(runs, lambda r: F.struct(r["level"], normal(r["text"]).alias("text")))),
            lambda p: p["text"] != "",
        )
    )


def _ended(a: Column) -> Column:
    return F.when(
        (a["level"] > 0) & (a["n"] > 1),
        F.concat(a["done"], F.array(F.struct(a["level"], a["text"]))),
    ).otherwise(a["done"])


def own_passages(own: Column) -> Column:
    """Normalised own lines and the whole own text."""
    return F.array_distinct(
        F.filter(
            F.transform(F.concat(F.split(own, "\n", -1), F.array(own)), normal), lambda t: t != ""
        )
    )


def answers(parts: DataFrame) -> DataFrame:
    """conv, turn, parent: the turn that each quoting message answers.

    ``parts``: conv, turn, own, quotes.
    """
    known = parts.filter("conv IS NOT NULL AND turn IS NOT NULL")
    quotes = known.select("conv", "turn", F.explode("quotes").alias("q")).select(
        "conv", "turn", "q.level", F.length("q.text").alias("size"), _digest(F.col("q.text")).alias("h")
    )
    first = (
        known.select("conv", "turn", F.explode(own_passages(F.col("own"))).alias("t"))
        .select("conv", "turn", _digest(F.col("t")).alias("h"))
        .groupBy("conv", "h").agg(F.min("turn").alias("origin"))
    )
    named = (
        quotes.join(first, ["conv", "h"]).filter("origin < turn")
        .groupBy("conv", "turn", "origin").agg(F.min("level").alias("level"), F.sum("size").alias("size"))
    )
    best = named.groupBy("conv", "turn").agg(
        F.max(F.struct((-F.col("level")).alias("l"), "size", "origin")).alias("best")
    )
    return best.select("conv", "turn", F.col("best.origin").alias("parent"))


def threads(links: DataFrame) -> DataFrame:
    """conv, turn, thread, depth of every answering message, by pointer doubling."""
    folder = shared_folder(links.sparkSession, "threads")
    up = written(
        links.select("conv", "turn", F.col("parent").alias("thread"), F.lit(1).cast("long").alias("depth")),
        f"{folder}/0",
    )
    n = 0
    while True:
        above = up.select(
            "conv", F.col("turn").alias("thread"), F.col("thread").alias("higher"),
            F.col("depth").alias("more"),
        )
        moved = up.join(above, ["conv", "thread"])
        if moved.isEmpty():
            return up
        n += 1
        up = written(
            up.join(above, ["conv", "thread"], "left").select(
                "conv", "turn", F.coalesce("higher", "thread").alias("thread"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            ),
            f"{folder}/{n}",
        )


def format_chats(
    messages: DataFrame,
    *,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    mark: str = "<|%s|>",
) -> DataFrame:
    """``messages`` with own_text, n_quoted, parent_turn, thread_turn, depth and formatted.

    own_text: the message without quotations. n_quoted: quoted lines. parent_turn: turn of the message
    it answers, or null. thread_turn: turn of the message that the thread begins with. formatted: own
    text under a line with the role's mark.
    """
    names = fresh(messages, "own_text", "n_quoted", "parent_turn", "thread_turn", "depth", "formatted")
    own, n_quoted, parent, thread, depth, formatted = names
    lines, conv_key, turn_key = fresh(messages, "lines", "conv_key", "turn_key")
    body = messages.withColumn(lines, parsed_lines(text_or_empty(text))).withColumn(
        own, own_text(F.col(lines))
    )
    parts = body.select(
        F.col(conversation).alias("conv"), F.col(turn).alias("turn"), F.col(own).alias("own"),
        F.when(F.exists(lines, lambda x: x["level"] > 0), quoted_passages(F.col(lines)))
        .otherwise(F.array().cast("array<struct<level:int,text:string>>")).alias("quotes"),
    )
    folder = shared_folder(messages.sparkSession, "answers")
    links = written(answers(parts), folder)
    placed = links.join(threads(links), ["conv", "turn"]).select(
        F.col("conv").alias(conv_key), F.col("turn").alias(turn_key),
        F.col("parent").alias(parent), F.col("thread").alias(thread), F.col("depth").alias(depth),
    )
    same = (F.col(conversation) == F.col(conv_key)) & (F.col(turn) == F.col(turn_key))
    return (
        body.withColumn(
            n_quoted, F.size(F.filter(lines, lambda x: x["level"] > 0)).cast("long")
        )
        .drop(lines)
        .join(placed, same, "left")
        .withColumn(thread, F.coalesce(thread, F.col(turn)))
        .withColumn(depth, F.coalesce(F.col(depth), F.lit(0)).cast("long"))
        .withColumn(
            formatted,
            F.concat(F.format_string(mark, F.coalesce(F.col(role), F.lit("unknown"))), F.lit("\n"), F.col(own), F.lit("\n")),
        )
        .drop(conv_key, turn_key)
    )
