"""Approximate matching by random projections, and a classifier trained by Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from catalens.operators import recognition
from catalens.operators.cells import in_groups, projection_buckets, same_length
from catalens.operators.recognition import TOLERANCE, single_face_images

c = F.col


def face_matches_lsh(
    faces: DataFrame,
    known: DataFrame,
    tolerance: float = TOLERANCE,
    bucket_length: float = 2.0,
    tables: int = 4,
    seed: int = 1,
) -> DataFrame:
    """Like ``recognition.face_matches`` but by random projections, which may miss pairs.

    Only faces and people in the same bucket of a projection are compared. They meet in the
    same bounded groups as in the exact form, so a bucket that holds most encodings is cut
    up, and only pairs within the tolerance ever become rows. A pair found in several
    projections is kept in the first.
    """
    people = recognition.known_encodings(known)
    size = F.size("encoding")
    one = people.agg(F.min(size).alias("n"), F.max(size).alias("most")).first()
    if one.n is None:
        return recognition.no_matches(faces)
    same_length(one.n, one.most)
    buckets = projection_buckets(one.n, tables, bucket_length, seed)

    def in_buckets(rows: DataFrame) -> DataFrame:
        usable = rows.where(F.size("encoding") == one.n)
        numbered = usable.withColumn("buckets", buckets(c("encoding")))
        each = numbered.select("*", F.posexplode_outer("buckets").alias("nth", "bucket"))
        return each.withColumn("cell", F.struct("nth", "bucket")).drop("bucket")

    visits = in_buckets(faces.select("face_id", "image_id", "encoding"))
    return in_groups(visits, in_buckets(people), recognition.group_sizes(), tolerance)


def train_people(faces: DataFrame, label: str = "person", iterations: int = 50) -> PipelineModel:
    """Classifier of people from images that show exactly one face.

    Multinomial logistic regression: Spark ML has no kernel support vector machine, and
    this one trains in passes over the distributed rows.
    """
    examples = single_face_images(faces, label, "encoding").select(
        c(label).cast("string").alias("name"), array_to_vector("encoding").alias("features")
    )
    index = StringIndexer(inputCol="name", outputCol="label", stringOrderType="alphabetAsc")
    index_model = index.fit(examples)
    stages = [
        index_model,
        LogisticRegression(maxIter=iterations, regParam=0.01),
        IndexToString(inputCol="prediction", outputCol="predicted", labels=index_model.labels),
    ]
    return Pipeline(stages=stages).fit(examples)


def predict_people(model: PipelineModel, faces: DataFrame) -> DataFrame:
    """``image_id, face_no, predicted`` for every face."""
    scoring = PipelineModel(stages=model.stages[1:])
    vectors = faces.select("image_id", "face_no", array_to_vector("encoding").alias("features"))
    return scoring.transform(vectors).select("image_id", "face_no", "predicted")


def faces_per_image(faces: DataFrame) -> DataFrame:
    return faces.groupBy("image_id").agg(F.count("*").alias("faces"))
