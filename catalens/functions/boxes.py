"""Face boxes relative to their image, and the record kept per face."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Decimals kept, and how much larger than the detected box a face is taken.
PRECISION = 5
SCALING = 1.65

# Longest image side matched at full size, and the sides of the smaller copy.
MATCH_SIDE = 1600


def face_box(
    top: Column, right: Column, bottom: Column, left: Column, img_w: Column, img_h: Column
) -> Column:
    """Pixel box -> struct(x, y, w, h): centre and enlarged size, as a share of the image."""
    width, height = right - left, bottom - top

    def share(pixels: Column, side: Column) -> Column:
        return F.bround(F.try_divide(pixels, side.cast("double")), PRECISION)

    return F.struct(
        share(left + width / 2, img_w).alias("x"),
        share(top + height / 2, img_h).alias("y"),
        share(width * F.lit(SCALING), img_w).alias("w"),
        share(height * F.lit(SCALING), img_h).alias("h"),
    )


def face_id(image_id: Column, face_no: Column) -> Column:
    """Id in UUID form, derived from image and position.

    A random id would change when a lost task is run again, so rows already shuffled and
    rows recomputed would disagree.
    """
    digest = F.md5(F.concat(image_id.cast("string"), F.lit("#"), face_no.cast("string")))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, n) for start, n in cuts])


def face_record(id_: Column, box: Column, encoding: Column, detector: str) -> Column:
    return F.struct(
        id_.alias("id"),
        *[box[c].alias(c) for c in ("x", "y", "w", "h")],
        F.lit(detector).alias("detector"),
        F.lit(1).alias("confidence"),
        encoding.alias("encoding"),
    )


def match_size(width: Column, height: Column) -> Column:
    """Size at which an image is matched: large ones fit in a square, ratio kept.

    The shorter side is whichever whole number keeps the ratio closer.
    """
    w, h = width.cast("double"), height.cast("double")
    # Unknown or 0 sides give no size instead of an error.
    ratio = F.try_divide(w, h)
    side = F.lit(float(MATCH_SIDE))

    def nearer(exact: Column, drift) -> Column:
        low, high = F.floor(exact).cast("double"), F.ceil(exact).cast("double")
        return F.greatest(F.when(drift(low) <= drift(high), low).otherwise(high), F.lit(1.0))

    narrow = nearer(side * ratio, lambda n: F.abs(ratio - n / side))
    flat = nearer(
        F.try_divide(side, ratio),
        lambda n: F.when(n == 0, F.lit(0.0)).otherwise(F.abs(ratio - F.try_divide(side, n))),
    )
    large = F.greatest(width, height) > MATCH_SIDE
    known = F.coalesce((w > 0) & (h > 0), F.lit(False))
    return F.struct(
        F.when(~known, F.lit(None)).when(~large, width).when(ratio > 1, side).otherwise(narrow).cast("int").alias("width"),
        F.when(~known, F.lit(None)).when(~large, height).when(ratio > 1, flat).otherwise(side).cast("int").alias("height"),
        F.when(known, F.least(F.lit(1.0), F.try_divide(side, F.greatest(w, h)))).alias("scale"),
    )
