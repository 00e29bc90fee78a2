"""Line runs and n-gram groups against all pairs."""

import random
from fractions import Fraction

import numpy as np
import pytest

from catalens.llm import components, line_dedup, ngram_join
from llm_rows import near_copies


def _all_runs(rows, least):
    """Lines left when every later copy of a run of enough words goes."""
    docs = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    split = [(r, r[1].split("\n")) for r in docs if r[1] is not None]
    gone = {r: set() for r in docs}
    places = [(d, i) for d, (_, lines) in enumerate(split) for i in range(len(lines))]
    for x, (d, i) in enumerate(places):
        for e, j in places[:x]:
            a, b, k = split[d][1], split[e][1], 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            if sum(len(s.split()) for s in a[i : i + k]) >= least:
                gone[split[d][0]].update(range(i, i + k))
    return {
        r: None if r[1] is None else "\n".join(s for i, s in enumerate(r[1].split("\n")) if i not in gone[r])
        for r in docs
    }


@pytest.mark.parametrize("seed", range(2))
def test_line_runs(spark, seed):
    rng = random.Random(seed)
    lines = ["a b c", "d", "", "e f", "g h i j k l", "m", " "]
    rows = [(d, "\n".join(rng.choice(lines) for _ in range(rng.choice([1, 3, 8, 20])))) for d in range(25)]
    rows += [(None, rows[3][1]), (100, None), (101, ""), rows[5], (None, None), (102, "long " * 9000)]
    docs = spark.createDataFrame(
        [(i, t, t, 1, 2) for i, t in rows], "doc_id long, text string, before string, id int, Gone int"
    )
    got = line_dedup.dedup_lines(docs, min_words=5).collect()
    want = _all_runs(rows, 5)
    assert len(got) == len(rows)
    for r in got:
        assert r.text == want[r.doc_id, r.before]
        n = 0 if r.before is None else r.before.count("\n") + 1
        assert r.n_lines == n and 0 <= r.n_deleted <= n


def test_lines_of_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup_lines(empty).count() == 0


def _groups(rows, n, t):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both * t.denominator >= t.numerator * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [(i, len(sets[k]), least.get(root(k))) for k, (i, _) in enumerate(rows)], [root(k) for k in range(len(rows))]


def _text(rows):
    return sorted(tuple(map(str, r)) for r in rows)


def test_groups(spark):
    rows, t = near_copies(1), Fraction(85, 100)
    docs = spark.createDataFrame([(i, x, 7) for i, x in rows], "doc_id long, text string, Node int")
    got = ngram_join.ngram_groups(docs.repartition(4), n=4, threshold=t)
    want, _ = _groups(rows, 4, t)
    assert _text(got.select("doc_id", "n_shingles", "component_id").collect()) == _text(want)


def test_one_of_each_group_stays(spark):
    rows, t = near_copies(2), Fraction(4, 5)
    docs = spark.createDataFrame([(i, x, 7) for i, x in rows], "doc_id long, text string, key int")
    got = [(r.doc_id, r.text) for r in ngram_join.one_per_group(docs).collect()]
    _, roots = _groups(rows, 5, t)
    worded = [k for k, (_, x) in enumerate(rows) if x and x.split()]
    where = {row: roots[k] for k, row in enumerate(rows)}
    kept = [where[r] for r in got if r[1] and r[1].split()]
    assert sorted(kept) == sorted({roots[k] for k in worded})
    assert len(got) - len(kept) == len(rows) - len(worded)


def test_groups_of_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.ngram_groups(empty).count() == 0
    assert ngram_join.one_per_group(empty).count() == 0


def test_components(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 20)]
    links += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = components.connected(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in list(parent))


def test_parities_bound_the_difference():
    rng = np.random.default_rng(3)
    for size, other in ((40, 3), (500, 60), (5000, 4000)):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: len(a) - other], rng.integers(0, 1 << 63, other, dtype=np.uint64)]))
        differ = len(np.setxor1d(a, b))
        turned = sum(int(x).bit_count() for x in (ngram_join.parities(a) ^ ngram_join.parities(b)).view(np.uint64))
        assert turned <= differ and (turned > differ / 2 or size == 5000)
    assert not ngram_join.parities(np.empty(0, np.uint64)).any()


def test_many_texts_below_the_threshold(spark):
    """Texts that share most n-grams, all pairs just below the threshold, and two that reach it."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(120):
        words = list(base)
        for i in rng.sample(range(200), 6):
            words[i] = f"x{k}.{i}"
        rows.append((k, " ".join(words)))
    close = rows[7][1].split()
    close[100] = "other"
    rows.append((500, " ".join(close)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_groups(docs, n=4, threshold=Fraction(85, 100)).collect()}
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(197)} for i, t in rows}
    reach = {i: i for i in sets}
    for i in sorted(sets):
        for j in sets:
            if j > i and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                low, high = sorted((reach[i], reach[j]))
                reach = {k: low if v == high else v for k, v in reach.items()}
    assert got == reach and 100 < len(set(got.values())) < len(rows)


def test_word_hashes_that_a_worker_keeps_are_few():
    from catalens.llm import ngram_join

    hashes = ngram_join._WordHashes()
    for k in range(100_000):
        hashes[b"%d" % k]
    assert len(hashes) <= (1 << 16) + 1
