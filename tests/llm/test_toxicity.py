"""The convolutional classifier on held-out rows, long texts and tables without labels."""

import os
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalens.llm import toxicity


@pytest.fixture(scope="module")
def case():
    """Rows (id, text, toxic): insults differ by language, some only begin alike."""
    rng = random.Random(6)
    parts = ["ba", "lo", "mi", "ren", "tu", "sko", "pel", "da", "vir", "on"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.choice([1, 2, 3])))
    frequent = [ws.split() for ws in toxicity._LANGUAGES.values()]
    rows = []
    for i in range(900):
        lang = rng.randrange(4)
        words = [rng.choice(frequent[lang]) if rng.random() < 0.3 else word() for _ in range(rng.choice([15, 60, 200]))]
        toxic = i % 7 == 0
        for _ in range(3 if toxic else 0):
            insult = ["zgrumf", "Qualtz", "xofe" + word(), "yekk!!"][lang]
            words.insert(rng.randrange(len(words)), insult)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def _scored(spark, rows, labels, **options):
    docs = spark.createDataFrame([(t, i, 0) for i, t in rows], "text string, doc_id long, Label int")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    return toxicity.classify_toxic(docs, table, learn=F.col("doc_id") % 3 != 0, **options).collect()


def test_held_out_rows(spark, case):
    rows = [(i, t) for i, t, _ in case] + [(2000, None), (2001, ""), (None, "a b"), (2002, "zgrumf " * 3), case[5][:2]]
    labels = [(i, y) for i, _, y in case] + [(7, None), (8, 5), (None, 1)]
    got = _scored(spark, rows, labels)
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    toxic = {i: y for i, _, y in case}
    held = [r for r in got if r.doc_id in toxic and r.doc_id % 3 == 0]
    caught = [r.predicted for r in held if toxic[r.doc_id]]
    clean = [r.predicted for r in held if not toxic[r.doc_id]]
    assert sum(caught) >= 0.95 * len(caught) and sum(clean) <= 0.03 * len(clean)
    assert {r.doc_id: r.predicted for r in got}[2001] == 0


def test_labels_that_may_not_be_used(spark, case):
    """Labels outside ``learn`` change nothing."""
    rows = [(i, t) for i, t, _ in case[:200]]
    labels = [(i, y) for i, _, y in case[:200]]
    turned = [(i, 1 - y if i % 3 == 0 else y) for i, y in labels]
    scores = [{r.doc_id: r.score for r in _scored(spark, rows, ls)} for ls in (labels, turned)]
    assert scores[0] == scores[1]


def test_one_class_or_nothing(spark, case):
    for labels in ([(1, 1), (2, 1)], [(3, 0)]):
        got = _scored(spark, [(1, "a b"), (2, None)], labels)
        assert all(r.predicted == 0 and r.score < 0.5 for r in got)
    assert _scored(spark, [], [(1, 1), (2, 0)]) == []


def test_long_texts_in_pieces(case, monkeypatch):
    texts, labels = [t for _, t, _ in case], np.array([y for _, _, y in case])
    model = toxicity.fit(texts[:300], labels[:300], epochs=3)
    some = [" ".join(texts[300:340]), *texts[340:400], "", None, "yekk"]
    whole = toxicity.Scorer(model).scores(some)
    monkeypatch.setattr(toxicity, "_PIECE", 7)
    assert np.allclose(toxicity.Scorer(model).scores(some), whole)
    alone = [toxicity.Scorer(model).scores([t])[0] for t in some]
    assert np.allclose(alone, whole)


def test_sample_is_bounded(spark, case):
    rows = [(i, t) for i, t, _ in case]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in case], "doc_id long, label int")
    texts, marks = toxicity._sample(docs, labels, 100, 10**9)
    assert len(texts) == len(marks) == 100 and set(texts) <= {t for _, t in rows}
    texts, _ = toxicity._sample(docs, labels, 100, 5000)
    assert 0 < sum(map(len, texts)) <= 5000


def test_threshold_is_in_the_widest_gap():
    scores = np.array([0.0, 1.0, 2.0, 8.0, 9.0])
    assert toxicity._threshold(scores, np.array([0, 0, 0, 1, 1])) == 5.0
    assert 2.0 < toxicity._threshold(scores, np.array([0, 1, 0, 1, 1])) < 8.0


def test_language_from_the_text():
    words = toxicity.Words()
    texts = ["The cat and the dog of it", "Der Hund und die Katze", "le chat est dans la maison", "el perro y los gatos", "xyz"]
    held = [words.numbers(t) for t in texts]
    owners = np.array(words.owners)
    assert [words.language(t, owners) for t in held] == [0, 1, 2, 3, 4]


def test_all_labelled_rows_are_learned(spark, case):
    """An insult that only stands in a few hundred of many labelled rows, far back in the order of the ids' hash."""
    rng = random.Random(8)
    plain = [t.split()[:8] for _, t, y in case if not y]
    ids = spark.range(10800).select("id").orderBy(F.xxhash64("id")).toPandas()["id"].tolist()
    late = set(ids[9200:])
    rows, labels = [], []
    for n, i in enumerate(ids):
        words, toxic = list(rng.choice(plain)), n % 5 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), "vrokkel" if i in late else "zgrumf")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    got = {r.doc_id: r.predicted for r in _scored(spark, rows, labels)}
    for wanted, part in ((1, late), (1, set(ids) - late)):
        held = [got[i] for i, y in labels if y == wanted and i in part and i % 3 == 0]
        assert len(held) > 40 and sum(held) >= 0.95 * len(held)
    clean = [got[i] for i, y in labels if not y and i % 3 == 0]
    assert sum(clean) <= 0.03 * len(clean)


def test_blocks_learn_together(spark, case):
    """Many small blocks, some without a toxic row, catch what one block does."""
    rows, labels = [(i, t) for i, t, _ in case], [(i, y) for i, _, y in case]
    for options in ({"block_rows": 40}, {"block_chars": 20_000}):
        got = {r.doc_id: r.predicted for r in _scored(spark, rows, labels, **options)}
        held = [(got[i], y) for i, y in labels if i % 3 == 0]
        assert sum(p for p, y in held if y) >= 0.9 * sum(y for _, y in held)
        assert sum(p for p, y in held if not y) <= 0.05 * sum(1 - y for _, y in held)


def test_thresholds_of_ranges(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(k % 3), float(s), int(rng.random() < 1 / (1 + np.exp(-s)))) for k, s in enumerate(rng.normal(0, 2, 600))]
    rows += [(4, 90.0, 1), (4, -90.0, 0)]
    judged = spark.createDataFrame(rows, "lang int, given double, label int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = toxicity._thresholds(judged, 20)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    of = lambda keep: toxicity._threshold(*(np.array([r[k] for r in rows if keep(r)]) for k in (1, 2)))
    assert got.tolist() == [*[of(lambda r, k=k: r[0] == k) for k in range(3)], of(lambda r: True), of(lambda r: True)]


def test_greatest_answers_in_pieces(case, monkeypatch):
    texts, labels = [t for _, t, _ in case], np.array([y for _, _, y in case])
    whole = toxicity.fit(texts[:200], labels[:200], epochs=2)
    monkeypatch.setattr(toxicity, "_PIECE", 50)
    pieces = toxicity.fit(texts[:200], labels[:200], epochs=2)
    assert np.allclose(whole.table, pieces.table, atol=1e-4) and np.allclose(whole.thresholds, pieces.thresholds, atol=1e-3)


def test_training_leaves_no_shuffle_files(spark, case, monkeypatch):
    """Sums of an epoch are gone from disk when the next one begins; counts of some bytes may go later."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = [f for f in str(disk.getAllFiles().mkString("\n")).split("\n") if "/shuffle_" in f]
        return sum(os.path.getsize(f) for f in files if os.path.exists(f))

    before, left, summed = shuffled(), [], toxicity._summed

    def look(blocks, of_block):
        for _ in range(20):  # executors remove them a moment later
            if (found := shuffled() - before) < 100_000:
                break
            time.sleep(0.1)
        left.append(found)
        return summed(blocks, of_block)

    monkeypatch.setattr(toxicity, "_summed", look)
    docs = spark.createDataFrame([(i, t) for i, t, _ in case[:200]], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in case[:200]], "doc_id long, toxic int")
    toxicity.classify_toxic(docs, labels, learn=F.col("doc_id") % 3 != 0, block_rows=40)
    assert len(left) > 5 and max(left) < 100_000


def test_rows_of_words():
    """Words in bulk get the rows that the checksums of their parts say, whatever their letters take in bytes."""
    rng = random.Random(2)
    drawn = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for letters in ("abcde", "aäßжd漢") for _ in range(300)]
    words = toxicity.Words()
    for word in drawn:
        words[word]
    got = np.concatenate([words.rows()[:200], words.rows(200)])
    assert len(got) == len(words) and (got[0] == toxicity._PAD).all()
    for word, rows in list(zip(words, got.tolist()))[1:]:
        parts = ["0" + word, "1" + word, *("^" + word[:n] if len(word) > n else "" for n in toxicity._BEGINNINGS)]
        parts.append("$" + word[-4:] if len(word) > 4 else "")
        assert rows == [zlib.crc32(p.encode()) % toxicity._ROWS if p else toxicity._PAD for p in parts]
