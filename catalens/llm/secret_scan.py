"""Secrets in texts: named forms by pattern, unnamed ones by the entropy of a sliding window.

Base kinds are matches of fixed patterns. The entropy kinds look at candidate strings, maximal runs
of one character class. A window moves over a candidate; the counts of its characters change by the
one that leaves and the one that enters, and with them the sum of c * log2(c), from which the
window's Shannon entropy follows. Windows at or above the class's threshold are joined into spans.
Windows that meet an allow-listed part of their candidate are left out, and so are spans within base
spans or within spans of a class listed before. Each kind of token has a class: hex, base64, small letters
with or without digits, capitals likewise, letters of both cases; from 20 characters on (hex 24). A
candidate is dropped before its entropy is looked at only if it reads like plain words: letters and
digits do not alternate, and fewer than three pairs of letters are ones that words hardly have.

Everything is a column expression. Null text counts as empty and has no spans. Rows are judged each by
itself, so repeated rows and null or equal ids need no care. Positions are code points, end exclusive.
Columns of the input stay; an added one whose name clashes gets a leading underscore.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.llm.columns import fresh, let, text_or_empty

#: Kind, pattern, group whose length counts, least length. Fixed values; a run that is too short is a
#: match all the same for "assign", whose search goes on behind it.
BASE = (
    (
        "assign",
        r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
        r"|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
        r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        1,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)


@dataclass(frozen=True)
class EntropyClass:
    """Candidates are runs of ``alphabet`` of at least ``window`` characters that match ``needs``."""

    kind: str
    run: str
    alphabet: str
    window: int
    bits: float
    needs: str


#: Pairs of letters that words hardly have.
_ODD = (
    r"(?i:q[^u\W\d_]|j[b-df-hj-np-tv-z]|x[bdfgjkmnqrsvwxz]|v[bcdfghjkmnpqtwxz]|w[cgjpqvx]|z[bcdfgjknpqrsvx]"
    r"|[b-df-hj-mp-tvwxz][jq]|[b-df-hj-mp-tvwz]x|b[cfgkpwz]|c[bdfgmnpvwz]|d[ckpz]|f[bcdghkmnpvwz]"
    r"|g[bcfkpvz]|h[bcdfgkpvz]|k[cdfgpvz]|m[cdfghkrvwz]|p[bcdgkmvwz]|[bfgmpvwz]k|[cfgjkmpqvxz]v|[jqxv]w)"
)
#: Candidates that are more than plain words.
_NO_WORDS = rf"[A-Za-z][0-9]+[A-Za-z]+[0-9]|[0-9][A-Za-z]+[0-9]+[A-Za-z]|{_ODD}.*?{_ODD}.*?{_ODD}"
_DIGEST = "".join(rf"(?<!{a}{n}-)" for a in ("sha", "SHA") for n in (1, 256, 384, 512))
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    EntropyClass(
        "entropy_hex", r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{32,}(?![0-9A-Fa-f])",
        "0123456789abcdefABCDEF", 32, 3.02, r"[0-9].*[a-fA-F]|[a-fA-F].*[0-9]",
    ),
    EntropyClass(
        "entropy_base64", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}",
        _LETTERS + _LETTERS.lower() + "0123456789+/_-", 24, 3.91,
        rf"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])|{_NO_WORDS}",
    ),
    EntropyClass(
        "entropy_short_hex", r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{24,31}(?![0-9A-Fa-f])",
        "0123456789abcdefABCDEF", 24, 3.02, r"[0-9].*[a-fA-F]|[a-fA-F].*[0-9]",
    ),
    EntropyClass(
        "entropy_short_base64", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,23}(?![A-Za-z0-9+/_-])",
        _LETTERS + _LETTERS.lower() + "0123456789+/_-", 20, 3.65, _NO_WORDS,
    ),
    EntropyClass(
        "entropy_small", rf"(?<![A-Za-z0-9])(?=[a-z0-9]{{20}}){_DIGEST}[a-z0-9]{{20,}}(?![A-Za-z0-9])",
        _LETTERS.lower() + "0123456789", 20, 3.25, _NO_WORDS,
    ),
    EntropyClass(
        "entropy_capital", rf"(?<![A-Za-z0-9])(?=[A-Z0-9]{{20}}){_DIGEST}[A-Z0-9]{{20,}}(?![A-Za-z0-9])",
        _LETTERS + "0123456789", 20, 3.25, _NO_WORDS,
    ),
    EntropyClass(
        "entropy_letters", rf"(?<![A-Za-z0-9])(?=[A-Za-z]{{20}}){_DIGEST}[A-Za-z]{{20,}}(?![A-Za-z0-9])",
        _LETTERS + _LETTERS.lower(), 20, 3.55, _NO_WORDS,
    ),
)
#: Parts of candidates that are no secrets: identifiers with dashes in their usual places, digests under their
#: name, documentation samples, sequences of letters or digits in order.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|placeholder|dummy|changeme",
    r"(?i)^sha(1|256|384|512)-.*",
    r"(?i)abcdefghij|0123456789",
)
KINDS = tuple(kind for kind, *_ in BASE) + tuple(c.kind for c in CLASSES)


def _starts(between: Column, found: Column) -> Column:
    """Start of each match, from the lengths of the matches and of what stands between them."""
    return F.aggregate(
        F.transform(found, lambda m, i: F.struct(F.length(F.get(between, i)).alias("gap"),
                                                 F.length(m).alias("len"))),
        F.struct(
            F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")
        ),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["len"]).alias("at"),
            F.concat(a["starts"], F.array(a["at"] + x["gap"])).alias("starts"),
        ),
        lambda a: a["starts"],
    )


def _no_spans() -> Column:
    return F.array().cast("array<struct<kind:string,rank:int,start:int,end:int>>")


def _span(kind: str, start: Column, end: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("rank"),
        start.cast("int").alias("start"), end.cast("int").alias("end"),
    )


def _matches(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of one base kind. Positions are worked out only for texts with a match."""

    def placed(found: Column) -> Column:
        starts = _starts(F.split(text, pattern, -1), found)
        sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
        spans = let(
            starts,
            lambda s: let(
                sizes,
                lambda n: F.transform(
                    found,
                    lambda m, i: F.when(
                        F.get(n, i) >= least,
                        _span(kind, F.get(s, i), F.get(s, i) + F.length(m)),
                    ),
                ),
            ),
        )
        return F.when(F.size(found) > 0, F.filter(spans, lambda x: x.isNotNull())).otherwise(
            _no_spans()
        )

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _clog(count: Column) -> Column:
    return F.when(count > 0, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def hot_windows(candidate: Column, c: EntropyClass) -> Column:
    """Spans (start, end) within a candidate that windows of high entropy cover.

    A window that holds a character outside the alphabet is never hot.
    """
    size = len(c.alphabet)
    # A window's entropy is log2(window) - sum / window, so the threshold bounds the sum.
    most = (math.log2(c.window) - c.bits) * c.window
    intervals = "array<struct<start:int,end:int>>"

    def step(a: Column, i: Column) -> Column:
        new = F.substring(candidate, i, F.lit(1))
        old = F.substring(candidate, i - c.window, F.lit(1))
        k_in = F.instr(F.lit(c.alphabet), new) - 1  # -1 outside the alphabet
        k_out = F.when(i > c.window, F.instr(F.lit(c.alphabet), old) - 1).otherwise(F.lit(-1))

        def moved(k: Column) -> Column:
            i_in, i_out, n = k["i"], k["o"], a["n"]
            less = F.coalesce(F.get(n, i_out), F.lit(0))
            left = F.when(
                i_out >= 0,
                F.transform(n, lambda v, j: F.when(j == i_out, v - 1).otherwise(v)),
            ).otherwise(n)

            def entered(m: Column) -> Column:
                was = F.coalesce(F.get(m, i_in), F.lit(0))
                bad = F.when(i_in < 0, i.cast("int")).otherwise(a["bad"])
                total = (
                    a["sum"]
                    - F.when(i_out >= 0, _clog(less) - _clog(less - 1)).otherwise(F.lit(0.0))
                    + F.when(i_in >= 0, _clog(was + 1) - _clog(was)).otherwise(F.lit(0.0))
                )
                counts = F.transform(m, lambda v, j: F.when(j == i_in, v + 1).otherwise(v))
                start = (i - c.window).cast("int")
                last = F.get(a["spans"], F.size(a["spans"]) - 1)
                hot = (i - bad >= c.window) & (total <= most)
                spans = (
                    F.when(~hot, a["spans"])
                    .when(
                        last["end"] >= start,
                        F.concat(
                            F.filter(a["spans"], lambda s: s["start"] < last["start"]),
                            F.array(F.struct(last["start"].alias("start"), i.cast("int").alias("end"))),
                        ),
                    )
                    .otherwise(
                        F.concat(
                            a["spans"],
                            F.array(F.struct(start.alias("start"), i.cast("int").alias("end"))),
                        )
                    )
                )
                return F.struct(
                    counts.alias("n"), total.alias("sum"), spans.cast(intervals).alias("spans"),
                    bad.alias("bad"),
                )

            return let(left, entered)

        return let(F.struct(k_in.alias("i"), k_out.alias("o")), moved)

    return F.aggregate(
        F.sequence(F.lit(1), F.length(candidate)),
        F.struct(
            F.array_repeat(F.lit(0), size).alias("n"),
            F.lit(0.0).alias("sum"),
            F.array().cast(intervals).alias("spans"),
            F.lit(0).alias("bad"),
        ),
        step,
        lambda a: a["spans"],
    )


def _entropy_spans(text: Column, c: EntropyClass, allowed: tuple[str, ...]) -> Column:
    run = f"{c.run}"

    def placed(found: Column) -> Column:
        wanted = lambda m: m.rlike(c.needs)
        spans = let(
            _starts(F.split(text, run, -1), found),
            lambda s: F.flatten(
                F.transform(
                    found,
                    lambda m, i: F.when(
                        wanted(m),
                        F.transform(
                            let(_masked(m, allowed), lambda x: hot_windows(x, c)),
                            lambda h: _span(c.kind, F.get(s, i) + h["start"], F.get(s, i) + h["end"]),
                        ),
                    ).otherwise(_no_spans()),
                )
            ),
        )
        return F.when(F.exists(found, wanted), spans).otherwise(_no_spans())

    return let(F.regexp_extract_all(text, F.lit(run), F.lit(0)), placed)


def _masked(value: Column, patterns: tuple[str, ...]) -> Column:
    """The value with spaces in the place of all that the patterns match."""
    # One alternation: a step per pattern makes the plan several times as long.
    pattern = "|".join(f"(?:{p})" for p in patterns) or r"(?!)"

    def blank(v: Column) -> Column:
        blanks = F.transform(
            F.regexp_extract_all(v, F.lit(pattern), F.lit(0)),
            lambda m: F.repeat(F.lit(" "), F.length(m)),
        )
        pieces = F.zip_with(
            F.split(v, pattern, -1), blanks, lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))
        )
        return F.when(v.rlike(pattern), F.array_join(pieces, "")).otherwise(v)

    return let(value, blank)


def _sorted(spans: Column) -> Column:
    """By start, then kind as listed, then end."""
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"]))
    )
    return F.transform(
        ordered, lambda s: F.struct(s["kind"], s["rank"], s["start"], s["end"])
    )


def secret_spans(
    text: Column, classes: tuple[EntropyClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED
) -> Column:
    """Struct of arrays ``base`` and ``added`` of (kind, rank, start, end), each in text order."""

    def with_base(base: Column) -> Column:
        # A text without any run that a window fits has no candidates.
        every = re.escape("".join(sorted({x for c in classes for x in c.alphabet})))
        added = F.when(
            text.rlike(f"[{every}]{{{min(c.window for c in classes)}}}"),
            F.concat(*(_entropy_spans(text, c, allowed) for c in classes)),
        ).otherwise(_no_spans())
        clear = F.filter(
            added,
            lambda s: ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])),
        )
        # A hex run is a base64 run as well; the class listed first names it.
        return let(
            clear,
            lambda x: F.struct(
                base.alias("base"),
                _sorted(
                    F.filter(
                        x,
                        lambda s: ~F.exists(
                            x,
                            lambda o: (o["rank"] < s["rank"])
                            & (o["start"] <= s["start"]) & (s["end"] <= o["end"]),
                        ),
                    )
                ).alias("added"),
            ),
        )

    return let(_sorted(F.concat(*(_matches(text, *b) for b in BASE))), with_base)


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def scan_secrets(
    docs: DataFrame,
    *,
    text: str = "text",
    classes: tuple[EntropyClass, ...] = CLASSES,
    allowed: tuple[str, ...] = ALLOWED,
) -> DataFrame:
    """``docs`` with base_spans and all_spans: arrays of (kind, rank, start, end) in text order."""
    body, found, base, every = fresh(docs, "body", "found", "base_spans", "all_spans")
    return (
        docs.withColumn(body, text_or_empty(text))
        .withColumn(found, secret_spans(F.col(body), classes, allowed))
        .withColumn(base, F.col(found)["base"])
        .withColumn(every, _sorted(F.concat(F.col(found)["base"], F.col(found)["added"])))
        .drop(body, found)
    )


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by ``mark``; spans that overlap become one."""
    return F.when(F.size(spans) == 0, text).otherwise(
        F.aggregate(
            spans,
            F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
            lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
                F.struct(
                    F.when(
                        s["start"] >= a["at"],
                        F.concat(
                            a["out"],
                            F.substring(text, a["at"] + 1, s["start"] - a["at"]),
                            F.lit(mark),
                        ),
                    ).otherwise(a["out"]).alias("out"),
                    s["end"].alias("at"),
                )
            ),
            lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
        )
    )
