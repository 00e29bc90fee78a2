"""Faces: boxes, lists per image, and matching against known people.

Tables: ``faces`` (image_id, face_no, face_id, encoding, box columns), ``images``
(image_id), ``known`` (name, encoding).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalens.functions import boxes, vectors
from catalens.operators.cells import CellIndex, in_groups, is_usable

c = F.col

# Largest distance that is a match, and the names given without one.
TOLERANCE = 0.6
UNKNOWN_PERSON = "unknown_person"
NO_PERSONS = "no_persons_found"

# Most cells known people are divided into: the centres stay under a megabyte however many
# people there are.
CENTRES = 128
# Faces and people that meet in one group: some tens of megabytes each.
FACES_PER_GROUP = 32768
PEOPLE_PER_GROUP = 16384


def with_records(detections: DataFrame, detector: str = "face_recognition") -> DataFrame:
    """Detections with pixel boxes -> faces with ``face_id`` and relative boxes."""
    box = boxes.face_box(
        c("top"), c("right"), c("bottom"), c("left"), c("img_w"), c("img_h")
    )
    encoding = vectors.as_doubles(c("encoding"))
    id_ = boxes.face_id(c("image_id"), c("face_no"))
    return detections.select(
        "image_id", "face_no", boxes.face_record(id_, box, encoding, detector).alias("face")
    )


def face_lists(records: DataFrame) -> DataFrame:
    """Face records of an image as one array, in order of position, ``face_no`` in each.

    A list is as long as its image has faces; :func:`with_records` gives a row per face.
    """
    grouped = records.groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct("face_no", "face"))).alias("faces")
    )
    return grouped.withColumn("faces", F.transform("faces", lambda f: f["face"].withField("face_no", f["face_no"])))


def face_boxes(detections: DataFrame, detector: str = "face_recognition") -> DataFrame:
    """What is found in each image: detections to lists of face records."""
    return face_lists(with_records(detections, detector))


def _per_image(faces: DataFrame, *columns: str) -> DataFrame:
    """Number of faces and the first face of each image, combined before the shuffle."""
    first = F.min_by(F.struct(*columns), "face_no")
    return (
        faces.groupBy("image_id")
        .agg(F.count("*").alias("n"), first.alias("first"))
        .select("image_id", "n", "first.*")
    )


def single_face_images(faces: DataFrame, *columns: str) -> DataFrame:
    """Images with exactly one face: those fit for training."""
    return _per_image(faces, *columns).where("n = 1").drop("n")


def skipped_images(images: DataFrame, faces: DataFrame) -> DataFrame:
    """Images not fit for training, with their number of faces."""
    counts = faces.groupBy("image_id").agg(F.count("*").alias("n"))
    return (
        images.select("image_id")
        .join(counts, "image_id", "left")
        .select("image_id", F.coalesce("n", F.lit(0)).alias("faces"))
        .where("faces <> 1")
    )


def known_image_report(images: DataFrame, faces: DataFrame) -> DataFrame:
    """Face count of each image of a known person, with the warning it deserves."""
    counts = faces.groupBy("image_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    warning = F.when(n == 0, "No faces found, ignored").when(
        n > 1, "More than one face found, only considering the first"
    )
    return (
        images.select("image_id")
        .join(counts, "image_id", "left")
        .select("image_id", n.alias("faces"), warning.alias("warning"))
    )


def first_faces(faces: DataFrame, *columns: str) -> DataFrame:
    """First face of each image that has any."""
    return _per_image(faces, *columns).drop("n")


# --- matching ---------------------------------------------------------------------------


def face_matches(
    faces: DataFrame, known: DataFrame, tolerance: float = TOLERANCE, count: int = CENTRES
) -> DataFrame:
    """All pairs within the tolerance: ``face_id, image_id, name, distance``. Exact.

    Known people belong to the cell of their nearest centre. By the triangle inequality a
    face can only match in cells whose ball (radius: farthest member) comes within the
    tolerance, and whose centre is at most twice the tolerance farther than its nearest one;
    so a face visits those cells only.

    Small cells are put together to bundles of as many people as a group takes, and a face is sent
    once to each bundle that it visits cells of: where encodings lie so that a face visits most
    cells, it is copied for each such block of people, not for each cell.

    Faces and people then meet in groups of one bundle, one chunk of faces and one block of
    people, each of bounded size by hash: a bundle that a third of all faces visit is spread
    over as many chunks as it needs. In a group, a face meets the cells that it visits. Copies of a person's encoding are counted beforehand, as
    a hash would put them all into one block. A group is one matrix product, not a row per
    pair.

    Planning runs two small jobs: one counts the known encodings and picks the centres, one
    takes the radii, at most ``count`` rows. Known encodings of different lengths are an
    error; a face of another length than theirs is near nobody.
    """
    people = known_encodings(known)
    cells = CellIndex.of(people, count)
    if cells is None:
        return no_matches(faces)
    fits = F.size("encoding") == cells.dimensions
    bundles = cells.bundles(group_sizes()[1])
    visits = (
        faces.where(fits)
        .select("face_id", "image_id", "encoding", cells.visited_bundles(tolerance, bundles)(c("encoding")).alias("_v"))
        # The outer form keeps the optimizer from computing the cells twice, to filter first.
        .select("face_id", "image_id", "encoding", "_v.cells", F.explode_outer("_v.bundles").alias("cell"))
        .where("cell IS NOT NULL")
    )
    members = people.withColumn("own", cells.nearest()(c("encoding"))["cell"])
    members = members.withColumn("cell", F.get(F.array(*[F.lit(int(n)) for n in bundles]), c("own")))
    return in_groups(visits, members, group_sizes(), tolerance)


def known_encodings(known: DataFrame) -> DataFrame:
    """Usable encodings of known people, equal ones of a name counted as ``copies``."""
    return known.where(is_usable(c("encoding"))).groupBy("name", "encoding").agg(
        F.count("*").alias("copies")
    )


def no_matches(faces: DataFrame) -> DataFrame:
    return faces.select(
        "face_id",
        "image_id",
        F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("double").alias("distance"),
    ).limit(0)


def group_sizes() -> tuple[int, int]:
    """Faces and people that meet in one group."""
    return FACES_PER_GROUP, PEOPLE_PER_GROUP


def any_match(faces: DataFrame, matches: DataFrame) -> DataFrame:
    """``face_id, matched`` for every face."""
    found = matches.select("face_id").distinct().withColumn("matched", F.lit(True))
    return (
        faces.select("face_id")
        .join(found, "face_id", "left")
        .withColumn("matched", F.coalesce("matched", F.lit(False)))
    )


def named_faces(faces: DataFrame, matches: DataFrame) -> DataFrame:
    """Every match of every face; a face without one gives one row of an unknown person."""
    return (
        faces.select("face_id", "image_id")
        .join(matches.select("face_id", "name", "distance"), "face_id", "left")
        .select(
            "image_id", "face_id", F.coalesce("name", F.lit(UNKNOWN_PERSON)).alias("name"), "distance"
        )
    )


def images_without_faces(images: DataFrame, faces: DataFrame) -> DataFrame:
    return images.select("image_id").join(
        faces.select("image_id").distinct(), "image_id", "left_anti"
    )


def recognize(
    images: DataFrame,
    faces: DataFrame,
    known: DataFrame,
    tolerance: float = TOLERANCE,
    count: int = CENTRES,
) -> DataFrame:
    """``file, name, distance`` lines of all images, including those without a face."""
    named = named_faces(faces, face_matches(faces, known, tolerance, count))
    empty = images_without_faces(images, faces)
    lines = named.select(c("image_id").alias("file"), "name", "distance")
    return lines.unionByName(
        empty.select(
            c("image_id").alias("file"),
            F.lit(NO_PERSONS).alias("name"),
            F.lit(None).cast("double").alias("distance"),
        )
    )


def with_match_size(images: DataFrame) -> DataFrame:
    """Add the size at which an image is matched."""
    size = boxes.match_size(c("img_w"), c("img_h"))
    return images.withColumn("_s", size).select(
        *images.columns,
        c("_s.width").alias("match_w"),
        c("_s.height").alias("match_h"),
        c("_s.scale").alias("scale"),
    )
