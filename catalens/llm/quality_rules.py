"""Quality rules as a cascade that stops at the first rule that rejects.

Every rule is a condition on the text. On a bounded sample each rule is timed and its share of
rejected documents counted; the rules then run in the order of rejections per second, as branches of
one CASE expression, so that a document that a cheap rule rejects never meets a costly one. The order
changes the work and never the verdict: a document is kept if no rule rejects it.

Null text counts as empty. A rule whose condition is null (an empty text has no ratios) does not
reject. Rows repeat and ids may be null or equal: every row is judged by its own text. Columns of the
input stay; where their names clash with an added one, the added one gets a leading underscore.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.llm.columns import NOT_SPACE, SPACE, fresh, let, split_words, text_or_empty

#: Words in a window whose repetition within a text counts.
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Rejects a text for which ``rejects`` is true."""

    name: str
    rejects: Callable[[Column], Column]


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def _left(text: Column, pattern: str) -> Column:
    """Number of characters that stay when all that match are taken away."""
    return F.length(F.regexp_replace(text, pattern, ""))


def _solid(text: Column) -> Column:
    """Characters without spaces and line ends."""
    return F.length(F.replace(F.replace(text, F.lit(" ")), F.lit("\n")))


def _marks(text: Column) -> Column:
    return F.try_divide(_left(text, r"[^#*$%&|<>{}~^]+"), F.length(text))


def _shouts(text: Column) -> Column:
    calm = F.replace(F.replace(text, F.lit("!")), F.lit("?"))
    return F.try_divide(F.length(text) - F.length(calm), F.length(text))


def _capitals(text: Column) -> Column:
    return F.try_divide(_left(text, r"[^A-ZÀ-ÖØ-ÞΑ-ΩА-Я]+"), _solid(text))


def _other(text: Column) -> Column:
    """Share of digits, punctuation and signs."""
    return F.try_divide(_left(text, r"[^\x21-\x40\x5B-\x60\x7B-\x7E]+"), _solid(text))


def _word_length(text: Column) -> Column:
    """Characters per gap between words."""
    return F.length(text) / (1 + F.length(text) - _solid(text))


def _bullets(text: Column) -> Column:
    """Share of lines that begin with a bullet."""
    lines = F.split(text, "\n", -1)
    return let(
        lines, lambda x: F.size(F.filter(x, lambda y: y.rlike(r"^[ \t]*[-*•‣◦]"))) / F.size(x)
    )


#: Rules for prose in any script with spaces.
RULES = (
    Rule("marks", lambda t: _marks(t) > 0.06),
    Rule("shouts", lambda t: _shouts(t) > 0.08),
    Rule("capitals", lambda t: _capitals(t) > 0.50),
    Rule("few_letters", lambda t: _other(t) > 0.50),
    Rule("long_words", lambda t: _word_length(t) > 40),
    Rule("bullets", lambda t: _bullets(t) > 0.90),
)


def measure_rules(sample: DataFrame, rules: tuple[Rule, ...]) -> list[Measured]:
    """Time and rejected share of each rule on a sample of column ``text``, each run by itself."""
    held = sample.select(text_or_empty("text").alias("text")).cache()
    try:
        rows = held.count()
        out = []
        for rule in rules:
            begun = time.perf_counter()
            rejected = held.filter(rule.rejects(F.col("text"))).count()
            out.append(Measured(rule, time.perf_counter() - begun, rejected / max(rows, 1)))
        return out
    finally:
        held.unpersist()


def order_rules(measured: list[Measured]) -> tuple[Rule, ...]:
    """Most rejections per second first; ties by name."""
    return tuple(m.rule for m in sorted(measured, key=lambda m: (-m.gain, m.rule.name)))


def first_rejection(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Name of the first rule, in this order, that rejects the text; null if none does.

    The branches of CASE run in turn, so later rules do not run for a text that one rejects.
    """
    chain = F
    for rule in rules:
        chain = chain.when(rule.rejects(text), F.lit(rule.name))
    return chain if rules else F.lit(None).cast("string")


def _covered(hashes: Column) -> Column:
    """Words that lie in windows found more than once, from the windows' hashes in text order."""

    def repeated(s: Column) -> Column:
        # s: (hash, position) sorted; equal hashes stand side by side.
        same = F.filter(
            F.transform(
                s,
                lambda x, j: F.when(
                    (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]), x["p"]
                ),
            ),
            lambda p: p.isNotNull(),
        )
        return let(
            F.array_sort(same),
            lambda p: F.aggregate(
                F.transform(
                    p,
                    lambda x, j: F.least(
                        F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))
                    ),
                ),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            ),
        )

    return F.when(
        F.size(F.array_distinct(hashes)) < F.size(hashes),
        let(
            F.array_sort(F.transform(hashes, lambda h, j: F.struct(h.alias("h"), j.alias("p")))),
            repeated,
        ),
    ).otherwise(F.lit(0).cast("long"))


def _window_hashes(words: Column) -> Column:
    """A hash per window of :data:`WINDOW` words, in text order."""

    def windows(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW),
            lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))),
        )

    return F.when(
        F.size(words) > WINDOW, let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    ).otherwise(F.array().cast("array<bigint>"))


def text_counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NOT_SPACE))
    return let(
        split_words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
            .alias("n_dup_lines"),
            let(_window_hashes(w), _covered).alias("n_repeat_words"),
        ),
    )


def apply_rules(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    *,
    text: str = "text",
    sample_rows: int = 500,
    min_words: int = 20,
    max_repeat_percent: int = 30,
) -> DataFrame:
    """``docs`` with the counts of :func:`text_counts`, base_failed, kept and rejected_by.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat_percent`` of the words in
    repeated windows. kept: not base_failed and no rule rejects. rejected_by: "base", the rule that
    came first in the measured order, or null. Only the order is taken from the sample of
    ``sample_rows`` rows; all rows are judged.
    """
    body, counts = fresh(docs, "body", "counts")
    held = docs.withColumn(body, text_or_empty(text)).withColumn(counts, text_counts(F.col(body)))
    ordered = order_rules(
        measure_rules(docs.select(F.col(text).alias("text")).limit(sample_rows), rules)
    )
    c = F.col(counts)
    failed = (c["n_words"] < min_words) | (
        100 * c["n_repeat_words"] > max_repeat_percent * c["n_words"]
    )
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    *outs, base, kept, by = fresh(docs, *names, "base_failed", "kept", "rejected_by")
    return (
        held.withColumns({o: c[n] for o, n in zip(outs, names)} | {base: failed})
        .withColumn(
            by, F.when(F.col(base), "base").otherwise(first_rejection(F.col(body), ordered))
        )
        .withColumn(kept, F.col(by).isNull())
        .drop(body, counts)
    )
