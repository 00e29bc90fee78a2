"""Sizes, resize and crop arguments, and rotation filters of renditions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from catalens.functions import js

# Default waveform width, and its width to height ratio.
WAVEFORM_WIDTH = 720
WAVEFORM_RATIO = 1.3333
# Fixed value: sides of the page image a document is turned into first.
PAGE_SIDE = 600


def quarter_turn(angle: Column) -> Column:
    return F.coalesce(F.abs(angle).isin(90, 270), F.lit(False))


def turned_size(angle: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Source size after rotation: sides swap on a quarter turn."""
    turned = quarter_turn(angle)
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def target_size(
    width: Column, height: Column, src_w: Column, src_h: Column
) -> tuple[Column, Column]:
    """Asked size; with none at all the (turned) source size, else 0 for the missing side."""
    neither = ~js.truthy_number(width) & ~js.truthy_number(height)
    return (
        F.when(neither, src_w).otherwise(js.or_number(width, F.lit(0))),
        F.when(neither, src_h).otherwise(js.or_number(height, F.lit(0))),
    )


def _side(c: Column) -> Column:
    return F.when(js.truthy_number(c), js.number_text(c)).otherwise("")


def resize_spec(
    width: Column, height: Column, src_w: Column, src_h: Column
) -> Column:
    """``Wx`` or ``xH`` to cover the asked box, or ``WxH`` with empty sides to fit.

    ``src_w`` and ``src_h`` are the turned source size. An unknown source ratio, or a
    missing width (target ratio 0), fits the height.
    """
    target_w, target_h = target_size(width, height, src_w, src_h)
    narrower = F.coalesce(
        F.try_divide(src_w.cast("double"), src_h.cast("double"))
        < F.try_divide(target_w.cast("double"), target_h.cast("double")),
        F.lit(False),
    )
    cover = F.when(narrower, F.concat(js.number_text(target_w), F.lit("x"))).otherwise(
        F.concat(F.lit("x"), js.number_text(target_h))
    )
    fit = F.concat(_side(target_w), F.lit("x"), _side(target_h))
    return F.when(js.truthy_number(height), cover).otherwise(fit)


def crop_spec(width: Column, height: Column) -> Column:
    """Centre crop to the asked box, only when a height is asked for."""
    return F.when(
        js.truthy_number(height),
        F.concat(
            js.number_text(js.or_number(width, F.lit(0))),
            F.lit("x"), js.number_text(height), F.lit("+0+0"),
        ),
    )


def flips(mirror: Column) -> Column:
    """Only the value true flips; other non-empty texts change the key but not the picture."""
    return F.coalesce(mirror == "true", F.lit(False))


def scaled_side(asked: Column, along: Column, across: Column) -> Column:
    """Other side of a picture scaled so that ``along`` becomes ``asked``; at least 1.

    NULL where a side of the source is unknown or 0: its shape is then unknown.
    """
    exact = F.try_divide(asked.cast("double") * across.cast("double"), along.cast("double"))
    return F.when(exact > 0, F.greatest(F.floor(exact + 0.5), F.lit(1))).cast("int")


def image_size(
    width: Column, height: Column, angle: Column, src_w: Column, src_h: Column
) -> tuple[Column, Column]:
    """Size of an image rendition."""
    w0, h0 = turned_size(angle, src_w, src_h)
    has_w, has_h = js.truthy_number(width), js.truthy_number(height)
    return (
        F.when(has_w, width).when(has_h, scaled_side(height, h0, w0)).otherwise(w0).cast("int"),
        F.when(has_h, height).when(has_w, scaled_side(width, w0, h0)).otherwise(h0).cast("int"),
    )


def waveform_size(width: Column, height: Column) -> tuple[Column, Column]:
    """Size of the picture drawn for a sound file."""
    w = js.or_number(width, F.lit(WAVEFORM_WIDTH)).cast("int")
    h = js.or_number(height, F.floor(w.cast("double") / F.lit(WAVEFORM_RATIO))).cast("int")
    return w, h


def video_scale(width: Column, height: Column) -> Column:
    has_w, has_h = js.truthy_number(width), js.truthy_number(height)
    w, h = js.number_text(width), js.number_text(height)
    return (
        F.when(has_w & has_h, F.concat(F.lit("scale="), w, F.lit(":"), h))
        .when(has_w, F.concat(F.lit("scale="), w, F.lit(":-1")))
        .when(has_h, F.concat(F.lit("scale=-1:"), h))
    )


def video_rotation(angle: Column) -> Column:
    return (
        F.when(angle.isin(90, -270), F.lit("transpose=2"))
        .when(angle.isin(270, -90), F.lit("transpose=1"))
        .when(angle.isin(180, -180), F.lit("transpose=1,transpose=1"))
    )


def video_filters(
    deinterlace: Column, width: Column, height: Column, angle: Column
) -> Column:
    """Filters in the order they are passed. The encoder applies only the last one."""
    return F.array_compact(
        F.array(
            F.when(F.coalesce(deinterlace, F.lit(False)), F.lit("yadif")),
            video_scale(width, height),
            video_rotation(angle),
        )
    )


def effective_filter(filters: Column) -> Column:
    return F.try_element_at(filters, F.lit(-1))


def video_size(
    width: Column, height: Column, angle: Column, src_w: Column, src_h: Column
) -> tuple[Column, Column]:
    """Size of a video rendition, given that only the last filter is applied.

    A rotation comes last, so a request with both a size and an angle is turned, not scaled.
    """
    turned_w, turned_h = turned_size(angle, src_w, src_h)
    has_w, has_h = js.truthy_number(width), js.truthy_number(height)
    scaled_w = F.when(has_w, width).when(has_h, scaled_side(height, src_h, src_w)).otherwise(src_w)
    scaled_h = F.when(has_h, height).when(has_w, scaled_side(width, src_w, src_h)).otherwise(src_h)
    rotated = video_rotation(angle).isNotNull()
    return (
        F.when(rotated, turned_w).otherwise(scaled_w).cast("int"),
        F.when(rotated, turned_h).otherwise(scaled_h).cast("int"),
    )
