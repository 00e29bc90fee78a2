"""Face lists as JSON, recognition lines as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FACE_LIST_SCHEMA = (
    "array<struct<id:string,x:double,y:double,w:double,h:double,detector:string,"
    "confidence:int,encoding:array<double>,face_no:int>>"
)


def face_list_json(faces: Column) -> Column:
    return F.to_json(faces)


def explode_face_list(lists: DataFrame, json_column: str, *keep: str) -> DataFrame:
    """JSON face lists -> one row per face, with its ``face_no``, or else its place in the list."""
    parsed = F.from_json(json_column, FACE_LIST_SCHEMA)
    rows = lists.select(*keep, F.posexplode(parsed).alias("_place", "_face"))
    face_no = F.coalesce("_face.face_no", "_place").alias("face_no")
    fields = ("id", "x", "y", "w", "h", "detector", "confidence", "encoding")
    return rows.select(*keep, face_no, *(f"_face.{f}" for f in fields))


def recognition_lines(results: DataFrame, show_distance: bool = False) -> DataFrame:
    """``file, name[, distance]``, ready for a CSV sink."""
    columns = ["file", "name"] + (["distance"] if show_distance else [])
    return results.select(*columns)


def write_recognition_csv(results: DataFrame, path: str, show_distance: bool = False) -> None:
    recognition_lines(results, show_distance).write.mode("errorifexists").csv(path)
