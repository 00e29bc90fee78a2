"""Licence notices in files, found by the places of their rarest words.

Templates are short notices. Their words and positions form an index, and every word of it has an IDF
counted over all documents. A file's licence words are compared with each template's by weight, an
upper bound that most files fail. For each of the others, its highest-IDF words are looked up wherever
they stand in the file, however many notices it holds; occurrences that agree in file position minus
template position vote together, and the weight of the words that meet at the best relative position
is the template's score. A label is given if the score reaches a threshold and one of the template's
key phrases stands in the file. Phrases that name a licence outright are found by themselves as base
labels.

Everything is a column expression but the IDFs, one number per word of the templates, which the driver
reads. Null text counts as empty: no words, no labels, score 0. Repeated rows and null or equal ids need
no care. Columns of the input stay; an added one whose name clashes gets a leading underscore.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.llm.columns import fresh, let, lower_ascii, text_or_empty

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrase and label. Fixed values.
BASE = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)


@dataclass(frozen=True)
class Template:
    """A notice; ``keys``: phrases of which the file must hold one."""

    label: str
    text: str
    keys: tuple[str, ...]


#: Usual wordings of public licences' notices. Fixed values.
TEMPLATES = (
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
        " and associated documentation files (the Software), to deal in the Software without"
        " restriction",
        ("permission is hereby granted free of charge",),
    ),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0",
             ("apache license version 2 0",)),
    Template(
        "gpl-3.0",
        "This work is licensed under the GNU General Public License, version 3",
        ("gnu general public license version 3",),
    ),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of"
        " the GNU General Public License as published by the Free Software Foundation",
        ("gnu general public license as published by the free software foundation",),
    ),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        ("mozilla public license v 2 0",),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
        " without fee is hereby granted",
        ("permission to use copy modify and or distribute this software",),
    ),
    Template("all-rights-reserved", "All rights reserved", ("all rights reserved",)),
)


def _words(text: str) -> list[str]:
    return [w for w in re.split(NOT_WORD, text.lower()) if w]


def licence_words(text: Column) -> Column:
    """Array of the words of a text that is in lower case."""
    return F.filter(F.split(text, NOT_WORD), lambda w: w != "")


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in _words(t.text)})


def measure_idf(docs: DataFrame, templates: tuple[Template, ...], text: str = "text") -> dict[str, float]:
    """IDF over all documents of every word of the templates, in small, capital or title letters."""
    vocab = vocabulary(templates)
    forms = F.array(*(F.lit(f) for w in vocab for f in dict.fromkeys((w, w.upper(), w.capitalize()))))
    words = F.split(text_or_empty(text), NOT_WORD_ANY_CASE)
    met = F.array_distinct(F.transform(F.array_intersect(words, forms), F.lower))
    # The empty word stands for the document itself.
    counted = docs.select(F.explode(F.concat(met, F.array(F.lit("")))).alias("w")).groupBy("w").count()
    found = {r["w"]: r["count"] for r in counted.collect()}
    rows = found.get("", 0)
    return {w: math.log((rows + 1) / (found.get(w, 0) + 0.5)) for w in vocab}


def _literal_map(pairs: list[tuple[Column, Column]]) -> Column:
    return F.create_map(*(x for pair in pairs for x in pair))


class LicenceIndex:
    """Weights and postings of the templates as literals."""

    def __init__(self, templates: tuple[Template, ...], idf: dict[str, float], top_words: int):
        self.templates, self.top_words = templates, top_words
        self.idf = {w: max(idf.get(w, 0.0), 1e-3) for w in vocabulary(templates)}
        self.words = [_words(t.text) for t in templates]

    def weight(self, words) -> float:
        return sum(self.idf[w] for w in set(words))

    def rarest(self, words) -> list[str]:
        return sorted(set(words), key=lambda w: (-self.idf[w], w))[: self.top_words]

    def candidates(self, own: Column, threshold: float) -> Column:
        """Numbers of the templates of whose weight the file's licence words reach the threshold."""
        weights = _literal_map([(F.lit(w), F.lit(v)) for w, v in self.idf.items()])

        def enough(k: int) -> Column:
            rare = self.rarest(self.words[k])
            shared = F.array_intersect(own, F.array(*map(F.lit, rare)))
            got = F.aggregate(shared, F.lit(0.0), lambda a, w: a + weights[w])
            return F.when(got >= threshold * self.weight(rare), F.lit(k))

        return F.filter(
            F.array(*(enough(k) for k in range(len(self.templates)))), lambda k: k.isNotNull()
        )

    def scores(self, words: Column, candidates: Column) -> Column:
        """Per candidate: template number and the greatest share of weight at one relative position."""
        postings: dict[str, list[tuple[int, int]]] = {}
        for k, ws in enumerate(self.words):
            for p, w in enumerate(ws):
                if w in self.rarest(ws):
                    postings.setdefault(w, []).append((k, p))
        lookup = _literal_map(
            [
                (
                    F.lit(w),
                    F.array(*(F.struct(F.lit(k).alias("k"), F.lit(p).alias("p")) for k, p in found)),
                )
                for w, found in postings.items()
            ]
        )
        weights = _literal_map([(F.lit(w), F.lit(v)) for w, v in self.idf.items()])
        totals = F.array(*(F.lit(self.weight(self.rarest(ws))) for ws in self.words))
        rarest = F.array(*(F.array(*map(F.lit, self.rarest(ws))) for ws in self.words))
        sought_words = F.array_distinct(
            F.flatten(F.transform(candidates, lambda k: F.get(rarest, k)))
        )

        def votes(sought: Column) -> Column:
            hits = F.filter(
                F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
                lambda h: F.array_contains(sought, h["w"]),
            )
            return F.array_sort(
                F.flatten(
                    F.transform(
                        hits,
                        lambda h: F.transform(
                            F.filter(lookup[h["w"]], lambda q: F.array_contains(candidates, q["k"])),
                            lambda q: F.struct(q["k"], (h["i"] - q["p"]).alias("at"), h["w"]),
                        ),
                    )
                )
            )

        def step(a: Column, v: Column) -> Column:
            together = (a["k"] == v["k"]) & (a["at"] == v["at"])
            # A word that stands twice in the template votes once.
            sums = (
                F.when(together & (a["w"] == v["w"]), a["sum"])
                .when(together, a["sum"] + weights[v["w"]])
                .otherwise(weights[v["w"]])
            )
            return F.struct(
                v["k"].alias("k"), v["at"].alias("at"), v["w"].alias("w"), sums.alias("sum"),
                F.transform(
                    a["best"],
                    lambda b, j: F.when(j == v["k"], F.greatest(b, sums)).otherwise(b),
                ).alias("best"),
            )

        best = F.aggregate(
            let(sought_words, votes),
            F.struct(
                F.lit(-1).alias("k"), F.lit(0).alias("at"), F.lit("").alias("w"),
                F.lit(0.0).alias("sum"),
                F.array_repeat(F.lit(0.0), len(self.templates)).alias("best"),
            ),
            step,
            lambda a: a["best"],
        )
        return F.transform(best, lambda b, j: F.least(b / F.get(totals, j), F.lit(1.0)))


def _places(words: Column, phrase: str) -> Column:
    """Positions at which the phrase's words stand one after another."""
    parts = phrase.split(" ")

    def here(i: Column) -> Column:
        same = F.lit(True)
        for k, part in enumerate(parts):
            same = same & (F.get(words, i + k) == part)
        return same

    return F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)


def scan_licences(
    docs: DataFrame,
    *,
    text: str = "text",
    templates: tuple[Template, ...] = TEMPLATES,
    top_words: int = 8,
    threshold: float = 0.6,
) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels (arrays) and score.

    score: the greatest share of a labelled template's weight found in place; where only a base phrase
    stands in the file, ``threshold``; else 0. ``top_words``: a template is weighed by so many of its
    rarest words, and all of them are looked up in every file that can reach its threshold.
    """
    index = LicenceIndex(templates, measure_idf(docs, templates, text), top_words)
    known = F.array(*map(F.lit, vocabulary(templates)))
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    none = F.array().cast("array<int>")

    def read(words: Column) -> Column:
        return let(
            F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")),
            lambda line: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.struct(
                    *(
                        F.when(F.contains(line, F.lit(f" {phrase} ")), _places(words, phrase))
                        .otherwise(none).alias(f"p{k}")
                        for k, (phrase, _) in enumerate(BASE)
                    )
                ).alias("places"),
                let(
                    F.array_intersect(known, words),
                    lambda own: let(
                        index.candidates(own, threshold),
                        lambda c: F.when(F.size(c) > 0, _labelled(line, index.scores(words, c)))
                        .otherwise(F.array().cast("array<struct<label:string,score:double>>")),
                    ),
                ).alias("found"),
            ),
        )

    def _labelled(line: Column, scores: Column) -> Column:
        def verified(k: int, s: Column) -> Column:
            keys = F.lit(False)
            for key in templates[k].keys:
                keys = keys | F.contains(line, F.lit(f" {key} "))
            return F.when(
                (F.get(s, k) >= threshold) & keys,
                F.struct(F.lit(templates[k].label).alias("label"), F.get(s, k).alias("score")),
            )

        return let(
            scores,
            lambda s: F.filter(
                F.array(*(verified(k, s) for k in range(len(templates)))), lambda x: x.isNotNull()
            ),
        )

    found, = fresh(docs, "found")
    c = F.col(found)
    places = F.concat(*(c["places"][f"p{k}"] for k in range(len(BASE))))
    base = F.array_compact(
        F.array(
            *(F.when(F.size(c["places"][f"p{k}"]) > 0, label) for k, (_, label) in enumerate(BASE))
        )
    )
    values = (
        c["n_words"],
        F.size(places).cast("long"),
        F.array_min(places).cast("long"),
        F.array_max(places).cast("long"),
        F.array_sort(F.array_distinct(base)),
        F.array_sort(F.array_distinct(F.concat(base, F.transform(c["found"], lambda x: x["label"])))),
        F.greatest(
            F.when(F.size(places) > 0, F.lit(threshold)).otherwise(F.lit(0.0)),
            F.coalesce(F.array_max(F.transform(c["found"], lambda x: x["score"])), F.lit(0.0)),
        ),
    )
    return (
        docs.withColumn(found, let(licence_words(lower_ascii(text_or_empty(text))), read))
        .withColumns(dict(zip(fresh(docs, *names), values)))
        .drop(found)
    )
