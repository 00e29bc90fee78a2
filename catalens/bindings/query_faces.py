"""Queries on faces, known people and the trained classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalens.bindings import views
from catalens.bindings.registry import query
from catalens.bindings.sql_views import with_views
from catalens.functions import boxes, vectors
from catalens.operators import lookup, people_kernel, people_model, recognition, uneven
from catalens.plans import routing
from catalens.sources import reports
from catalens.sources.shared import shared_folder

c = F.col

# The encodings of the given tables lie farther apart than those of a face network.
TOLERANCE = 1.1


def _matches(spark, sf_dir):
    return recognition.face_matches(
        views.unknown(spark, sf_dir), views.known(spark, sf_dir), TOLERANCE
    )


# --- boxes and lists --------------------------------------------------------------------


@query(
    "f1_distance",
    with_views(
        """
SELECT f.face_id, k.face_id AS first_id, round(list_distance(f.encoding, k.encoding), 5) AS distance
FROM faces f JOIN (SELECT person, face_id, encoding FROM (SELECT *, row_number() OVER (PARTITION BY person
  ORDER BY face_id) AS nth FROM faces) WHERE nth = 1) k ON f.person = k.person""",
        "faces",
    ),
)
def f1_distance(spark, sf_dir):
    """Distance of each face to the first one of the same person."""
    faces = views.faces(spark, sf_dir)
    first = faces.groupBy("person", uneven.apart("person")).agg(
        F.min_by(
            F.struct(c("face_id").alias("first_id"), c("encoding").alias("first_encoding")), "face_id"
        ).alias("k")
    )
    paired = faces.select("person", "face_id", "encoding").join(
        first.select("person", "k.*"), "person"
    )
    distance = F.round(vectors.distance(c("encoding"), c("first_encoding")), 5)
    return paired.select("face_id", "first_id", distance.alias("distance"))


def _sql_box(prefix: str = "") -> str:
    values = {
        "x": '("left" + ("right" - "left") / 2::DOUBLE) / img_w',
        "y": '("top" + (bottom - "top") / 2::DOUBLE) / img_h',
        "w": '("right" - "left") * 1.65::DOUBLE / img_w',
        "h": '(bottom - "top") * 1.65::DOUBLE / img_h',
    }
    return ", ".join(f"round(CAST({v} AS DOUBLE), 5) AS {prefix}{k}" for k, v in values.items())


@query("f2_face_box", with_views(f"SELECT face_id, {_sql_box()} FROM faces", "faces"))
def f2_face_box(spark, sf_dir):
    box = boxes.face_box(
        c("top"), c("right"), c("bottom"), c("left"), c("img_w"), c("img_h")
    )
    return views.faces(spark, sf_dir).select("face_id", box.alias("b")).select("face_id", "b.*")


_DIGEST = "md5(image_id || '#' || face_no)"
_FACE_ID = "concat_ws('-', " + ", ".join(
    f"substr({_DIGEST}, {start}, {n})" for start, n in [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
) + ")"
_SUMMARY = f"""
SELECT image_id, face_no, {_FACE_ID} AS id, {_sql_box()}, 'face_recognition' AS detector,
  1 AS confidence, CAST(len(encoding) AS INTEGER) AS dimensions FROM faces"""


@query("f3_face_record", with_views(_SUMMARY, "faces"))
def f3_face_record(spark, sf_dir):
    records = recognition.with_records(views.detections(spark, sf_dir))
    return records.select("image_id", "face_no", "face.*").select(
        "image_id", "face_no", "id", "x", "y", "w", "h", "detector", "confidence",
        F.size("encoding").alias("dimensions"),
    )


@query(
    "a9_face_lists",
    with_views(
        f"""
SELECT image_id, count(*) AS faces, string_agg(id, ',' ORDER BY face_no) AS ids,
  round(sum(x), 5) AS sum_x FROM (SELECT image_id, face_no, {_FACE_ID} AS id, {_sql_box()} FROM faces)
GROUP BY image_id""",
        "faces",
    ),
)
def a9_face_lists(spark, sf_dir):
    lists = recognition.face_boxes(views.detections(spark, sf_dir))
    total = F.aggregate("faces", F.lit(0.0), lambda s, f: s + f["x"])
    return lists.select(
        "image_id",
        F.size("faces").cast("bigint").alias("faces"),
        F.array_join(F.transform("faces", lambda f: f["id"]), ",").alias("ids"),
        F.round(total, 5).alias("sum_x"),
    )


@query("s11_face_json", with_views(_SUMMARY, "faces"))
def s11_face_json(spark, sf_dir):
    """Face lists written as JSON and read back."""
    lists = recognition.face_boxes(views.detections(spark, sf_dir))
    texts = lists.select("image_id", reports.face_list_json(c("faces")).alias("json"))
    rows = reports.explode_face_list(texts, "json", "image_id")
    return rows.select(
        "image_id", "face_no", "id", "x", "y", "w", "h", "detector", "confidence",
        F.size("encoding").alias("dimensions"),
    )


# --- images by number of faces ----------------------------------------------------------


@query(
    "a4_single_face_images",
    with_views(
        """
SELECT image_id, min(person) AS person, round(min(encoding[1]), 6) AS e1 FROM faces
GROUP BY image_id HAVING count(*) = 1""",
        "faces",
    ),
)
def a4_single_face_images(spark, sf_dir):
    single = recognition.single_face_images(views.faces(spark, sf_dir), "person", "encoding")
    return single.select("image_id", "person", F.round(c("encoding")[0], 6).alias("e1"))


_COUNTED = """(SELECT i.image_id, count(f.face_id) AS faces FROM images i
  LEFT JOIN faces f ON f.image_id = i.image_id GROUP BY i.image_id)"""


@query(
    "s12_skipped_images",
    with_views(f"SELECT image_id, faces FROM {_COUNTED} WHERE faces <> 1", "images"),
)
def s12_skipped_images(spark, sf_dir):
    return recognition.skipped_images(views.images(spark, sf_dir), views.faces(spark, sf_dir))


@query(
    "a5_faces_per_image",
    with_views(
        f"""
SELECT image_id, faces, CASE WHEN faces = 0 THEN 'No faces found, ignored'
  WHEN faces > 1 THEN 'More than one face found, only considering the first' END AS warning
FROM {_COUNTED}""",
        "images",
    ),
)
def a5_faces_per_image(spark, sf_dir):
    return recognition.known_image_report(views.images(spark, sf_dir), views.faces(spark, sf_dir))


@query(
    "w2_first_face",
    with_views(
        """
SELECT image_id, face_id, person FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY face_no) AS nth FROM faces) WHERE nth = 1""",
        "faces",
    ),
)
def w2_first_face(spark, sf_dir):
    return recognition.first_faces(views.faces(spark, sf_dir), "face_id", "person")


@query(
    "g18_downscale",
    with_views(
        """
SELECT request_id, src_w, src_h, CASE WHEN r > 0 THEN round(least(1, 1600 / greatest(src_w, src_h)::DOUBLE), 9) END AS scale,
  CASE WHEN r IS NULL OR r = 0 THEN NULL WHEN greatest(src_w, src_h) <= 1600 THEN src_w WHEN src_w > src_h THEN 1600
    ELSE greatest(CAST(CASE WHEN abs(r - floor(1600 * r) / 1600) <= abs(r - ceil(1600 * r) / 1600)
      THEN floor(1600 * r) ELSE ceil(1600 * r) END AS INTEGER), 1) END AS match_w,
  CASE WHEN r IS NULL OR r = 0 THEN NULL WHEN greatest(src_w, src_h) <= 1600 THEN src_h WHEN src_w <= src_h THEN 1600
    ELSE greatest(CAST(CASE WHEN floor(1600 / r) = 0 OR abs(r - 1600 / floor(1600 / r)) <= abs(r - 1600 / ceil(1600 / r))
      THEN floor(1600 / r) ELSE ceil(1600 / r) END AS INTEGER), 1) END AS match_h
FROM (SELECT k.request_id, m.width AS src_w, m.height AS src_h, m.width / nullif(m.height, 0)::DOUBLE AS r
  FROM keyed k JOIN media m ON m.path = k.filename
  WHERE k.error IS NULL)""",
        "keyed", "media",
    ),
)
def g18_downscale(spark, sf_dir):
    keyed = lookup.valid(views.keyed(spark, sf_dir))
    sized = routing.with_source(keyed, views.media(spark, sf_dir))
    images = sized.select("request_id", c("src_w").alias("img_w"), c("src_h").alias("img_h"))
    return recognition.with_match_size(images).select(
        "request_id", c("img_w").alias("src_w"), c("img_h").alias("src_h"),
        F.round("scale", 9).alias("scale"), "match_w", "match_h",
    )


# --- matching ---------------------------------------------------------------------------


@query(
    "j6_face_match",
    with_views(
        "SELECT face_id, image_id, name, round(distance, 5) AS distance FROM matches", "matches"
    ),
)
def j6_face_match(spark, sf_dir):
    return _matches(spark, sf_dir).withColumn("distance", F.round("distance", 5))


@query("j7_face_match_lsh")
def j7_face_match_lsh(spark, sf_dir):
    pairs = people_model.face_matches_lsh(
        views.unknown(spark, sf_dir), views.known(spark, sf_dir), TOLERANCE
    )
    return pairs.withColumn("distance", F.round("distance", 5))


@query(
    "j8_unknown_person",
    with_views(
        """
SELECT u.image_id, u.face_id, coalesce(m.name, 'unknown_person') AS name, round(m.distance, 5) AS distance
FROM unknown u LEFT JOIN matches m ON m.face_id = u.face_id""",
        "unknown", "matches",
    ),
)
def j8_unknown_person(spark, sf_dir):
    named = recognition.named_faces(views.unknown(spark, sf_dir), _matches(spark, sf_dir))
    return named.withColumn("distance", F.round("distance", 5))


@query(
    "j9_no_persons",
    with_views(
        """
SELECT u.image_id AS file, coalesce(m.name, 'unknown_person') AS name, round(m.distance, 5) AS distance
FROM unknown u LEFT JOIN matches m ON m.face_id = u.face_id
UNION ALL SELECT image_id, 'no_persons_found', NULL FROM images
WHERE image_id >= 1000000 AND image_id NOT IN (SELECT image_id FROM faces)""",
        "unknown", "matches", "images",
    ),
)
def j9_no_persons(spark, sf_dir):
    lines = recognition.recognize(
        views.unknown_images(spark, sf_dir),
        views.unknown(spark, sf_dir),
        views.known(spark, sf_dir),
        TOLERANCE,
    )
    return lines.withColumn("distance", F.round("distance", 5))


@query(
    "a6_any_match",
    with_views(
        "SELECT face_id, face_id IN (SELECT face_id FROM matches) AS matched FROM unknown",
        "unknown", "matches",
    ),
)
def a6_any_match(spark, sf_dir):
    return recognition.any_match(views.unknown(spark, sf_dir), _matches(spark, sf_dir))


@query(
    "s10_recognition_csv",
    with_views(
        """
SELECT CAST(u.image_id AS VARCHAR) AS file, coalesce(m.name, 'unknown_person') AS name
FROM unknown u LEFT JOIN matches m ON m.face_id = u.face_id
UNION ALL SELECT CAST(image_id AS VARCHAR), 'no_persons_found' FROM images
WHERE image_id >= 1000000 AND image_id NOT IN (SELECT image_id FROM faces)""",
        "unknown", "matches", "images",
    ),
)
def s10_recognition_csv(spark, sf_dir):
    """Recognition lines written as CSV and read back."""
    folder = shared_folder(spark, "recognition")
    lines = recognition.recognize(
        views.unknown_images(spark, sf_dir),
        views.unknown(spark, sf_dir),
        views.known(spark, sf_dir),
        TOLERANCE,
    )
    reports.write_recognition_csv(lines, folder)
    return spark.read.schema("file string, name string").csv(folder)


# --- classifier -------------------------------------------------------------------------


@query("a7_train_people")
def a7_train_people(spark, sf_dir):
    """Examples per person the classifier was trained on, and how many it gets right."""
    faces = views.faces(spark, sf_dir)
    model = people_model.train_people(faces)
    single = recognition.single_face_images(faces, "face_no", "person", "encoding")
    predicted = people_model.predict_people(model, single)
    right = (c("predicted") == c("person").cast("string")).cast("bigint")
    return (
        predicted.join(single.select("image_id", "person"), "image_id")
        .groupBy("person")
        .agg(F.count("*").alias("examples"), F.sum(right).alias("right"))
    )


@query(
    "a7_training_rows",
    with_views(
        """
SELECT name, count(*) AS examples FROM (
  SELECT CAST(min(person) AS VARCHAR) AS name FROM faces GROUP BY image_id HAVING count(*) = 1)
GROUP BY name""",
        "faces",
    ),
)
def a7_training_rows(spark, sf_dir):
    """Examples per person that a classifier is trained on."""
    rows = people_kernel.training_rows(views.faces(spark, sf_dir))
    return rows.groupBy("name").agg(F.count("*").alias("examples"))


@query("a7_train_kernel")
def a7_train_kernel(spark, sf_dir):
    """Examples per person the kernel machines were trained on, and how many they get right."""
    faces = views.faces(spark, sf_dir)
    model = people_kernel.train_people_kernel(faces, features=128, iterations=10)
    single = recognition.single_face_images(faces, "face_no", "person", "encoding")
    predicted = people_kernel.predict_people_kernel(model, single)
    right = (c("predicted") == c("person").cast("string")).cast("bigint")
    return (
        predicted.join(single.select("image_id", "person"), "image_id")
        .groupBy("person")
        .agg(F.count("*").alias("examples"), F.sum(right).alias("right"))
    )


@query("a8_predict_people")
def a8_predict_people(spark, sf_dir):
    model = people_model.train_people(views.faces(spark, sf_dir))
    return people_model.predict_people(model, views.unknown(spark, sf_dir))


@query(
    "a8_face_count",
    with_views("SELECT image_id, count(*) AS faces FROM faces GROUP BY image_id", "faces"),
)
def a8_face_count(spark, sf_dir):
    return people_model.faces_per_image(views.faces(spark, sf_dir))
