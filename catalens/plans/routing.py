"""Which converter turns a source of one type into a rendition of another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalens.functions import mime

c = F.col

# Source type, rendition type, converter.
ROUTES = [
    ("image", "image", "image2image"),
    ("video", "video", "video2video"),
    ("video", "image", "video2image"),
    ("audio", "audio", "audio2audio"),
    ("audio", "image", "audio2image"),
    ("document", "image", "document2image"),
    ("document", "document", "document2document"),
]
# Fixed value: compression of sources that need deinterlacing.
INTERLACED = "dvsd"


def route_table(spark: SparkSession) -> DataFrame:
    """The routes as a table; seven rows, safe to broadcast."""
    return spark.createDataFrame(ROUTES, "source_type string, type string, converter string")


def route_error(type_: Column, mimetype: Column, filename: Column) -> Column:
    return F.concat(
        F.lit('Unknown conversion path from source type to destination type "'), type_,
        F.lit('", mimetype is "'), F.coalesce(mimetype, F.lit("undefined")),
        F.lit(" and filename is "), filename,
    )


def deinterlace(converter: Column, compression: Column, asked: Column) -> Column:
    """Decided by the source for video to video, by the caller for video to image."""
    return F.when(
        converter == "video2video", F.coalesce(compression == INTERLACED, F.lit(False))
    ).when(converter == "video2image", F.coalesce(asked, F.lit(False)))


def with_source(requests: DataFrame, media: DataFrame) -> DataFrame:
    """Add the source's ``mimetype, src_w, src_h, compression``; rows without a source go.

    ``media``: path, mimetype, width, height, compression, one row per path.
    """
    source = media.select(
        c("path").alias("filename"),
        "mimetype",
        c("width").alias("src_w"),
        c("height").alias("src_h"),
        "compression",
    )
    return requests.join(source, "filename")


def route(jobs: DataFrame) -> DataFrame:
    """Add ``source_type``, ``converter`` or ``error``, and the resolved ``deinterlace``."""
    table = F.broadcast(route_table(jobs.sparkSession))
    typed = jobs.withColumn("source_type", mime.media_type(c("mimetype")))
    routed = typed.join(table, ["source_type", "type"], "left")
    return routed.withColumns(
        {
            "error": F.when(
                c("converter").isNull(), route_error(c("type"), c("mimetype"), c("filename"))
            ),
            "deinterlace": deinterlace(c("converter"), c("compression"), c("deinterlace")),
        }
    )
