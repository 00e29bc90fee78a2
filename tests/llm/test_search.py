"""Ranked search against every pair of item and document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from catalens.llm import lexical_search


def terms(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(lexical_search.TERM, text)


def all_pairs(items, docs, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    holding = Counter(w for _, c in held for w in c)
    out = []
    for item, words in asked.items():
        found = []
        for doc, c in held:
            n, score = sum(c.values()), 0
            m = 100 - 50 + (50 * n * n_docs) // length
            for w in words & set(c):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[w] + 1)))
                score += weight * ((1_000_000_000 * c[w]) // (1000 * c[w] + 20 * m))
            if score > 0 and doc is not None:
                found.append((-score, doc))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out)


def tables(spark, items, docs):
    return (
        spark.createDataFrame([(1, i, t) for i, t in items], "Rank int, item_id long, text string"),
        spark.createDataFrame([(t, 1, i) for i, t in docs], "text string, Score int, doc_id long"),
    )


def rows(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def case():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["Ä", "é_x", "a-b", "日本", "X9"]
    chosen = lambda n: " ".join(rng.choice(words[: rng.choice([5, 30, 65])]) for _ in range(n))
    docs = [(i * 3, chosen(rng.choice([1, 2, 5, 40, 200]))) for i in range(400)]
    docs += [(5000 + i, "w1 W2 w2") for i in range(60)]  # ties
    docs += [(None, "w1 w7"), (9000, None), (9001, ""), (9002, "-- !"), docs[3], (9003, "w3 " * 30_000 + "w64")]
    items = [(i, chosen(rng.choice([1, 3, 12]))) for i in range(40)]
    items += [(100, None), (101, ""), (None, "w1"), (3, "w40 w41"), (102, "absent words"), (103, "w1 w1 w1")]
    rng.shuffle(docs)
    return items, docs


@pytest.mark.parametrize("options", [
    {}, {"batch_rows": 16}, {"block_terms": 25, "batch_rows": 64}, {"floor_rows": 60}, {"k": 1, "floor_rows": 5},
])
def test_equals_all_pairs(spark, case, options):
    items, docs = case
    want = all_pairs(items, docs, options.get("k", 50))
    assert rows(lexical_search.search(*tables(spark, items, docs), **options)) == want
    assert len({r[0] for r in want}) > 40


def test_empty_tables(spark, case):
    items, docs = tables(spark, *case)
    assert lexical_search.search(items.filter("false"), docs).count() == 0
    assert lexical_search.search(items, docs.filter("false")).count() == 0
    assert lexical_search.search(items, docs.filter("text = '-- !'")).count() == 0


def test_bounds_prune_whole_batches():
    """Documents of other subjects than an item are not scored for it."""
    rng = np.random.default_rng(5)
    subjects = [np.arange(s * 40, s * 40 + 40) for s in range(25)]
    items = [rng.choice(subjects[i % 25], 8, replace=False) for i in range(50)]
    weights = np.full(1000, 5000)
    search = lexical_search.Search(items, weights, 5, np.zeros(50, np.int64))
    n = 0
    for _ in range(4):
        docs = [np.sort(rng.choice(subjects[rng.integers(25)], 20, replace=False)) for _ in range(1000)]
        sizes = np.array([len(d) for d in docs])
        search.add(np.arange(n, n + 1000), sizes, np.concatenate(docs), np.full(sizes.sum(), 1000))
        n += 1000
    assert all(len(s) == 5 for s, _ in search.best)
    assert search.pairs < 0.1 * n * len(items)


def test_like_columns_become_neighbours():
    kinds = np.repeat(np.eye(4, dtype=np.float32), 16, axis=1)
    shuffled = np.random.default_rng(0).permutation(64)
    order = lexical_search.halved(kinds[:, shuffled])
    assert sorted(order) == list(range(64))
    owner = kinds.argmax(0)[shuffled][order]
    assert all(len(set(owner[i : i + 8])) == 1 for i in range(0, 64, 8))
