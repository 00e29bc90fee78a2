"""Rendition requests, as a table or as a stream of JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalens.functions import keys

# Client values of these columns may be text, number or boolean.
_LOOSE = ["angle", "mirror", "timeindex"]
_SIZES = ["width", "height"]
_SCHEMA = (
    "request_id bigint, ts timestamp, id string, filename string, type string, "
    "width variant, height variant, angle variant, mirror variant, timeindex variant, "
    "deinterlace boolean"
)


def _loose_text(c: Column) -> Column:
    """Loosely typed value as text; a boolean false or a number 0 becomes NULL.

    Only those are empty to the client: the texts "false" and "0" are not.
    """
    text = F.try_variant_get(c, "$", "string")
    written_as_text = F.schema_of_variant(c) == "STRING"
    empty = (text == "false") | (F.try_variant_get(c, "$", "double") == 0)
    return F.when(written_as_text | ~F.coalesce(empty, F.lit(False)), text)


def _size(c: Column) -> Column:
    """Size sent as number or text as INT; NULL if it is no whole number, or a boolean."""
    number = F.try_variant_get(c, "$", "double")
    whole = (F.schema_of_variant(c) != "BOOLEAN") & (number == F.floor(number))
    return F.when(whole, number.try_cast("int"))


def _size_error(*sizes: str) -> Column:
    """What is wrong with a size that was sent; an empty one is just absent."""
    def wrong(name: str) -> Column:
        text = _loose_text(F.col(name))
        sent = text.isNotNull() & (text != "")
        return F.when(sent & _size(F.col(name)).isNull(), F.concat(F.lit(keys.SIZE_ERROR), text))

    return F.coalesce(*(wrong(s) for s in sizes))


def _tidy(requests: DataFrame) -> DataFrame:
    sizes = {c: _size(F.col(c)) for c in _SIZES}
    return requests.withColumns(
        {c: _loose_text(F.col(c)) for c in _LOOSE} | sizes | {"size_error": _size_error(*_SIZES)}
    )


def read_requests(spark: SparkSession, root: str) -> DataFrame:
    return _tidy(spark.read.schema(_SCHEMA).json(root))


def stream_requests(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    return _tidy(reader.json(root))
