"""Face lists, exact and approximate matching, and the classifier."""

import os
import subprocess
import sys
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalens.operators import people_model, recognition
from catalens.operators.cells import CellIndex, cell_parts, close_pairs
from catalens.sources import reports

c = F.col
FACES = "face_id bigint, image_id bigint, face_no int, encoding array<double>"


def faces_table(spark, vectors):
    rows = [(i, i // 3, i % 3, None if v is None else list(map(float, v))) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, FACES)


def known_table(spark, named):
    return spark.createDataFrame([(n, list(map(float, v))) for n, v in named], "name string, encoding array<double>")


def brute_force(vectors, named, tolerance):
    return sorted(
        (i, n, round(float(np.linalg.norm(v - k)), 6))
        for i, v in enumerate(vectors) if v is not None
        for n, k in named
        if np.linalg.norm(v - k) <= tolerance
    )


def found(matches):
    return sorted((r.face_id, r.name, round(r.distance, 6)) for r in matches.collect())


def clustered(seed, people=12, per_person=6, faces=400, dimensions=16):
    """People as tight clusters; a third of all faces is of one person."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(people, dimensions))
    named = [
        (f"p{i}", centres[i] + rng.normal(scale=0.08, size=dimensions))
        for i in range(people) for _ in range(per_person)
    ]
    who = np.where(rng.random(faces) < 1 / 3, 0, rng.integers(0, people, faces))
    vectors = list(centres[who] + rng.normal(scale=0.12, size=(faces, dimensions)))
    return vectors, named


@pytest.mark.parametrize("tolerance", [0.3, 0.6, 3.0])
@pytest.mark.parametrize("count", [1, 5, 128])
def test_matches_equal_brute_force(spark, tolerance, count):
    vectors, named = clustered(count)
    matches = recognition.face_matches(
        faces_table(spark, vectors), known_table(spark, named), tolerance, count
    )
    expected = brute_force(vectors, named, tolerance)
    assert expected and found(matches) == expected


def test_copies_and_gaps(spark):
    """Copies of faces and of known encodings all count; encodings with gaps match nothing."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    vectors = [base] * 120 + [base + 0.01] * 3 + [None, np.full(8, np.nan), rng.normal(size=8) + 9]
    named = [("a", base)] * 40 + [("b", base)] + [("c", base + 0.05)]
    odd = known_table(spark, [("nan", np.full(8, np.nan)), ("short", [1.0])])
    # A NULL and an encoding of another length next to the usable ones.
    known = known_table(spark, named).union(odd.where("name = 'nan'"))
    matches = recognition.face_matches(faces_table(spark, vectors), known, 0.6)
    expected = brute_force([v for v in vectors[:123]], named, 0.6)
    assert found(matches) == expected and len(expected) == 123 * 42


def test_boundary_is_inclusive(spark):
    vectors, named = [np.array([0.0, 0.0])], [("on", np.array([0.6, 0.0])), ("off", np.array([0.6000001, 0.0]))]
    assert found(recognition.face_matches(faces_table(spark, vectors), known_table(spark, named))) == [(0, "on", 0.6)]


def test_groups_are_bounded(spark, monkeypatch):
    """Small groups: the result is the same, and no group exceeds a few times its target."""
    vectors, named = clustered(8)
    monkeypatch.setattr(recognition, "FACES_PER_GROUP", 40)
    monkeypatch.setattr(recognition, "PEOPLE_PER_GROUP", 10)
    matches = recognition.face_matches(faces_table(spark, vectors), known_table(spark, named), 0.6)
    assert found(matches) == brute_force(vectors, named, 0.6)
    near = found(people_model.face_matches_lsh(
        faces_table(spark, vectors), known_table(spark, named), 0.6, bucket_length=1000.0
    ))
    # One bucket on either side of the origin per projection: nearly all rows share one.
    assert not Counter(near) - Counter(brute_force(vectors, named, 0.6)) and len(near) > 1000


def test_only_full_cells_are_copied(spark, monkeypatch):
    """Rows that meet grow with what the cells hold, not with faces times people."""
    vectors, named = clustered(6, people=40, per_person=50, faces=4000)
    faces, known = faces_table(spark, vectors), known_table(spark, named)
    cells = CellIndex.of(recognition.known_encodings(known), 128)
    visits = faces.select("face_id", "encoding", F.explode(cells.visited(0.3)(c("encoding"))).alias("cell"))
    members = known.withColumn("cell", cells.nearest()(c("encoding"))["cell"])
    parts = cell_parts(visits, members, (200, 40))
    n_faces, n_people = (r.groupBy("cell").count() for r in (visits, members))
    met = parts.join(n_faces.withColumnRenamed("count", "f"), "cell").join(
        n_people.withColumnRenamed("count", "p"), "cell"
    )
    row = met.agg(F.sum(c("f") * c("blocks")).alias("f"), F.sum(c("p") * c("chunks")).alias("p")).first()
    every_face = visits.count() * -(-len(named) // 40)
    every_person = len(named) * -(-len(vectors) // 200)
    assert row.f < every_face / 5 and row.p < every_person / 2
    assert met.where("chunks > ceil(f / 200) OR blocks > ceil(p / 40)").count() == 0


def test_a_face_is_sent_once_for_a_group_of_people(spark, monkeypatch):
    """Where faces visit all cells, copies follow from the blocks of people, not from the cells."""
    rng = np.random.default_rng(12)
    vectors = list(rng.normal(size=(300, 16)))
    named = [(f"n{i}", v) for i, v in enumerate(rng.normal(size=(400, 16)))]
    faces, known = faces_table(spark, vectors), known_table(spark, named)
    sent = []
    close = recognition.in_groups
    monkeypatch.setattr(recognition, "in_groups", lambda f, *rest: sent.append(f.count()) or close(f, *rest))
    assert found(recognition.face_matches(faces, known, 3.5)) == brute_force(vectors, named, 3.5)
    monkeypatch.setattr(recognition, "PEOPLE_PER_GROUP", 150)
    assert found(recognition.face_matches(faces, known, 3.5)) == brute_force(vectors, named, 3.5)
    assert sent[0] <= 300 and sent[1] <= 300 * 5


def test_bundles_hold_what_a_group_takes():
    index = CellIndex(np.zeros((7, 2)), 0)
    index.members = np.array([3, 4, 4, 20, 0, 5, 5])
    assert index.bundles(10).tolist() == [0, 0, 1, 2, 3, 3, 3]


def test_memory_of_a_group_of_copies():
    """Every pair of the group matches: differences are taken a bounded number of pairs at a time."""
    vectors = pa.array([[0.25] * 128] * 3000)
    faces = pa.table({"face_id": pa.array(range(3000)), "image_id": pa.array(range(3000)), "encoding": vectors})
    people = pa.table({"name": ["a"] * 300, "copies": [1] * 300, "encoding": vectors[:300]})
    tracemalloc.start()
    pairs = close_pairs(faces, people, 0.6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs.num_rows == 900_000 and peak < 150e6


def test_pairs_of_a_group_are_handed_on_while_they_are_found():
    """A group in which every face matches everyone never holds all of its pairs."""
    from catalens.operators import cells

    n = 1500
    same = pa.FixedSizeListArray.from_arrays(pa.array(np.zeros(4 * n)), 4)
    faces = pa.table({"face_id": range(n), "image_id": range(n), "encoding": same})
    people = pa.table({"name": [f"p{k}" for k in range(n)], "copies": [1] * n, "encoding": same})
    sizes = [b.num_rows for b in cells.pair_batches(faces, people, 0.6)]
    assert sum(sizes) == n * n and max(sizes) < cells.PAIRS + cells.CANDIDATES


def test_a_group_streams_its_pairs(spark):
    """In the plan a group gets and gives batches, it is not one table of pairs."""
    vectors, named = clustered(4)
    matches = recognition.face_matches(faces_table(spark, vectors), known_table(spark, named), 3.0)
    assert found(matches) == brute_force(vectors, named, 3.0)
    plan = matches._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" not in plan


def test_known_encodings_of_one_length(spark):
    faces = faces_table(spark, [np.zeros(2), np.zeros(3)])
    mixed = known_table(spark, [("a", [0.0, 0.0]), ("b", [0.0, 0.0, 0.0])])
    with pytest.raises(ValueError, match="between 2 and 3 components"):
        recognition.face_matches(faces, mixed)
    with pytest.raises(ValueError, match="between 2 and 3 components"):
        people_model.face_matches_lsh(faces, mixed)
    assert found(recognition.face_matches(faces, mixed.where("name = 'a'"))) == [(0, "a", 0.0)]


def test_cells_prune(spark):
    """On clustered people most cells are never visited."""
    vectors, named = clustered(5, people=30)
    index = CellIndex.of(known_table(spark, named), 128)
    visited = faces_table(spark, vectors).select(F.size(index.visited(0.3)(c("encoding"))).alias("n"))
    assert visited.agg(F.avg("n")).first()[0] < len(index.centres) / 3


def test_nobody_known(spark):
    vectors, _ = clustered(1)
    faces = faces_table(spark, vectors)
    nobody = known_table(spark, [("a", [0.0])]).limit(0)
    named = recognition.named_faces(faces, recognition.face_matches(faces, nobody))
    assert {r.name for r in named.collect()} == {"unknown_person"} and named.count() == len(vectors)


def test_recognition_lines(spark, tmp_path):
    faces = faces_table(spark, [np.zeros(2), np.ones(2) * 9, np.zeros(2)])
    faces = faces.withColumn("image_id", F.when(c("face_id") == 2, 5).otherwise(c("image_id")))
    images = spark.createDataFrame([(0,), (5,), (6,)], "image_id bigint")
    known = known_table(spark, [("a", [0.1, 0.0]), ("b", [0.0, 0.0])])
    lines = recognition.recognize(images, faces, known)
    assert sorted((r.file, r.name) for r in lines.collect()) == [
        (0, "a"), (0, "b"), (0, "unknown_person"), (5, "a"), (5, "b"), (6, "no_persons_found"),
    ]
    path = str(tmp_path / "csv")
    reports.write_recognition_csv(lines, path, show_distance=True)
    back = spark.read.schema("file bigint, name string, distance double").csv(path)
    assert back.count() == 6 and back.where("distance IS NULL").count() == 2
    assert reports.recognition_lines(lines).columns == ["file", "name"]
    matches = recognition.face_matches(faces, known)
    assert {r.face_id: r.matched for r in recognition.any_match(faces, matches).collect()} == {
        0: True, 1: False, 2: True,
    }


def test_approximate_matches_are_true_ones(spark):
    vectors, named = clustered(2)
    vectors += [vectors[0]] * 50
    faces, known = faces_table(spark, vectors), known_table(spark, named)
    exact = brute_force(vectors, named, 0.6)
    near = found(people_model.face_matches_lsh(faces, known, 0.6))
    # No pair is found twice, though most share several buckets.
    assert not Counter(near) - Counter(exact)
    assert len(near) > 0.9 * len(exact)


def test_counts_per_image(spark):
    faces = faces_table(spark, [np.zeros(2)] * 4)
    images = spark.createDataFrame([(0,), (1,), (2,)], "image_id bigint")
    assert [r.image_id for r in recognition.single_face_images(faces, "encoding").collect()] == [1]
    skipped = {r.image_id: r.faces for r in recognition.skipped_images(images, faces).collect()}
    assert skipped == {0: 3, 2: 0}
    warnings = {r.image_id: r.warning for r in recognition.known_image_report(images, faces).collect()}
    assert warnings[1] is None and warnings[0].startswith("More than one") and warnings[2].startswith("No faces")
    assert {r.face_id for r in recognition.first_faces(faces, "face_id").collect()} == {0, 3}


def test_face_lists_are_whole(spark):
    rows = [(1, i * 3, 10, 60, 50, 5, 101, 103, [float(i * 3)]) for i in range(5000)]
    rows += [(2, 0, 1, 2, 3, 0, 101, 103, [0.5])]
    schema = (
        "image_id bigint, face_no int, top int, right int, bottom int, left int, img_w int, img_h int,"
        "encoding array<double>"
    )
    lists = recognition.face_boxes(spark.createDataFrame(rows, schema))
    assert sorted((r.image_id, len(r.faces)) for r in lists.collect()) == [(1, 5000), (2, 1)]
    texts = lists.select("image_id", reports.face_list_json(c("faces")).alias("j"))
    back = reports.explode_face_list(texts, "j", "image_id")
    assert back.where("image_id = 1 AND encoding[0] = face_no").count() == 5000
    bare = spark.createDataFrame([(1, '[{"id": "a", "x": 0.5}, {"id": "b"}]')], "image_id int, j string")
    assert [r.face_no for r in reports.explode_face_list(bare, "j", "image_id").collect()] == [0, 1]


def test_match_size_of_odd_images(spark):
    sizes = [(0, 5), (5, 0), (None, 5), (5, None), (-1, 5), (3200, 1600), (10, 20)]
    rows = recognition.with_match_size(spark.createDataFrame(sizes, "img_w int, img_h int")).collect()
    assert [(r.match_w, r.match_h, r.scale) for r in rows[:5]] == [(None, None, None)] * 5
    assert [(r.match_w, r.match_h, r.scale) for r in rows[5:]] == [(1600, 800, 0.5), (10, 20, 1.0)]


def test_classifier_learns_people(spark):
    vectors, _ = clustered(4, people=4, faces=160)
    rng = np.random.default_rng(4)
    centres = np.eye(4) * 3
    rows = [(i, 0, f"p{i % 4}", list(map(float, centres[i % 4] + rng.normal(scale=0.2, size=4)))) for i in range(80)]
    # Two faces in one image: not used for training.
    rows += [(1000, n, "liar", [3.0, 0.0, 0.0, 0.0]) for n in range(2)]
    faces = spark.createDataFrame(rows, "image_id bigint, face_no int, person string, encoding array<double>")
    model = people_model.train_people(faces)
    predicted = people_model.predict_people(model, faces).join(faces, ["image_id", "face_no"])
    right = predicted.where("image_id < 1000 AND predicted = person").count()
    assert right == 80 and predicted.where("predicted = 'liar'").count() == 0
    assert people_model.faces_per_image(faces).where("faces = 2").count() == 1


def test_task_code_needs_no_package_on_executors(tmp_path):
    """Functions are sent as code: a Python without this package on its path can load them."""
    from pyspark import cloudpickle

    from catalens.operators import cells
    from catalens.streaming import request_stream

    for function in (cells.close_pairs, request_stream._earliest_per_batch):
        file = tmp_path / "function.pickle"
        file.write_bytes(cloudpickle.dumps(lambda *a, f=function: f(*a)))
        load = f"import pickle; pickle.load(open({str(file)!r}, 'rb'))"
        environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        done = subprocess.run([sys.executable, "-c", load], cwd=tmp_path, env=environment, timeout=60)
        assert done.returncode == 0
