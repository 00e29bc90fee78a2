"""Tool calls of a conversion: which tool, with which arguments, in which order.

Everything is a column expression over a routed job. A plan is
``ARRAY<STRUCT<step INT, tool STRING, args ARRAY<STRING>>>``.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

from pyspark.sql import Column, DataFrame, functions as F

from catalens.functions import geometry, js, keys, mime

c = F.col

# Fixed values below: arguments of the tools, in the order the tools get them.
RAW_OPTIONS = ["-dcbe", "-w", "-T"]
IMAGE_SETUP = ["-set", "optionsion:filter:blur", "0.8", "-filter", "Lagrange", "-strip"]
IMAGE_QUALITY = ["-quality", "91"]
VIDEO_CODEC = [
    "-codec:v", "libvpx",
    "-cpu-used", "0",
    "-b:v", "500k",
    "-qmin", "10",
    "-qmax", "42",
    "-maxrate", "500k",
    "-bufsize", "1000k",
    "-max_muxing_queue_size", "9999",
]
AUDIO_CODEC = ["-codec:a", "libvorbis", "-b:a", "128k", "-ar", "44100"]
AUDIO_RATE = ["-cpu-used", "0", "-maxrate", "500k", "-bufsize", "1000k"]
WAVEFORM = (
    "[0:a]aformat=channel_layouts=mono,compand,showwavespic=s={size}:colors=#2185D0[fg];"
    "color=s={size}:color=#E0E0E0,drawgrid=width=iw/10:height=ih/5:color=#CACACA[bg];"
    "[bg][fg]overlay=format=rgb,drawbox=x=(iw-w)/2:y=(ih-h)/2:w=iw:h=1:color=#2185D0"
)
PAGE_THUMBNAIL = ["-thumbnail", "x590", "-background", "white", "-alpha", "remove"]
PAGE_PADDING = ["-gravity", "center", "-background", "#EFEFEF", "-extent", "600x600"]

Arg = str | Column | tuple[Column, list["str | Column"]]


def _texts(values: list[str]) -> Column:
    """Constant list, as one expression: plans hold hundreds of constant arguments."""
    quoted = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return F.expr(f"array({quoted})")


def _pieces(parts: list[str | Column]) -> list[Column]:
    """Argument lists of the parts, runs of constants taken together."""
    runs = groupby(parts, key=lambda p: isinstance(p, str))
    return [_texts(list(run)) if constant else F.array(*run) for constant, run in runs]


def arguments(*parts: Arg) -> Column:
    """Argument list; a ``(condition, values)`` part is left out unless the condition holds."""
    pieces: list[Column] = []
    for optional, run in groupby(parts, key=lambda p: isinstance(p, tuple)):
        if not optional:
            pieces += _pieces(list(run))
            continue
        for condition, values in run:
            given = F.concat(*_pieces(values))
            pieces.append(F.when(condition, given).otherwise(F.expr("cast(array() as array<string>)")))
    return F.concat(*pieces)


def call(tool: str, *parts: Arg) -> Column:
    return F.struct(F.lit(tool).alias("tool"), arguments(*parts).alias("args"))


def numbered(calls: Column) -> Column:
    return F.transform(
        calls,
        lambda s, i: F.struct((i + 1).alias("step"), s["tool"].alias("tool"), s["args"].alias("args")),
    )


def _file(name: str) -> Column:
    return F.concat(c("work_dir"), F.lit("/" + name))


def _first_page(path: Column) -> Column:
    return F.concat(path, F.lit("[0]"))


def threads() -> Column:
    return F.when(js.truthy_number(c("threads")), c("threads")).otherwise(1).cast("string")


def _no_calls() -> Column:
    return F.array().cast("array<struct<tool:string,args:array<string>>>")


# Calls of each converter before the picture call (see _picture_call), if it has one.


def _before_image() -> Column:
    """A raw image is developed first: in the work folder, as that is where the result goes."""
    staged = F.concat(c("work_dir"), F.lit("/"), keys.base_name(c("filename")))
    calls = F.array(call("ln", "-s", c("filename"), staged), call("dcraw", *RAW_OPTIONS, staged))
    return F.when(mime.is_raw_image(c("mimetype")), calls).otherwise(_no_calls())


def _audio() -> Column:
    return F.array(
        call(
            "ffmpeg",
            "-i", c("filename"),
            *AUDIO_RATE,
            "-threads", threads(),
            *AUDIO_CODEC,
            "-f", "webm",
            _file("audio2audio.webm"),
        )
    )


def _before_waveform() -> Column:
    size = F.concat(c("_want_w").cast("string"), F.lit("x"), c("_want_h").cast("string"))
    before, between, after = WAVEFORM.split("{size}")
    drawing = F.concat(F.lit(before), size, F.lit(between), size, F.lit(after))
    return F.array(
        call(
            "ffmpeg",
            "-i", c("filename"),
            "-filter_complex", drawing,
            "-frames:v", "1",
            _file("video2image.png"),
        )
    )


def _before_frame() -> Column:
    return F.array(
        call(
            "ffmpeg",
            "-i", c("filename"),
            (F.coalesce(c("deinterlace"), F.lit(False)), ["-filter:v", "yadif"]),
            (c("_seek").isNotNull(), ["-ss", c("_seek")]),
            "-vframes", "1",
            "-qscale", "0",
            _file("video2image.jpg"),
        )
    )


def _video() -> Column:
    """Two passes that share all but their last arguments."""
    filters = geometry.video_filters(c("deinterlace"), c("width"), c("height"), c("angle"))
    passed = F.flatten(F.transform(filters, lambda f: F.array(F.lit("-vf"), f)))
    shared = F.concat(
        arguments("-i", c("filename")),
        passed,
        arguments(*VIDEO_CODEC, "-threads", threads()),
    )
    first = arguments("-an", "-pass", "1", "-f", "webm", _file("video2video_pass1.webm"))
    second = arguments(*AUDIO_CODEC, "-pass", "2", "-f", "webm", _file("video2video_pass2.webm"))
    return F.transform(
        F.array(first, second),
        lambda last: F.struct(F.lit("ffmpeg").alias("tool"), F.concat(shared, last).alias("args")),
    )


def _document() -> Column:
    """Nothing for a PDF, which is passed on as it is."""
    pdf = _file("document2document.pdf")
    convert = call("unoconv", "-f", "pdf", "-o", pdf, c("filename"))
    return F.when(mime.is_pdf(c("mimetype")), _no_calls()).otherwise(F.array(convert))


def _before_page() -> Column:
    """First page on a square sheet."""
    pdf = F.when(mime.is_pdf(c("mimetype")), c("filename")).otherwise(
        _file("document2document.pdf")
    )
    page, padded = _file("document2image1.jpg"), _file("document2image2.jpg")
    sheet = F.array(
        call("convert", _first_page(pdf), *PAGE_THUMBNAIL, *IMAGE_QUALITY, page),
        call("convert", page, *PAGE_PADDING, *IMAGE_QUALITY, padded),
    )
    return F.concat(_document(), sheet)


CONVERTERS: dict[str, Callable[[], Column]] = {
    "image2image": _before_image,
    "audio2audio": _audio,
    "audio2image": _before_waveform,
    "video2image": _before_frame,
    "video2video": _video,
    "document2document": _document,
    "document2image": _before_page,
}
# File that the calls before leave for the picture call.
PICTURES = {
    "audio2image": "video2image.png",
    "video2image": "video2image.jpg",
    "document2image": "document2image2.jpg",
}


def _image_input() -> Column:
    """What an image rendition of an image starts from."""
    stem = F.regexp_replace(keys.base_name(c("filename")), r"(?<!^)\.[^.]*$", "")
    developed = F.concat(c("work_dir"), F.lit("/"), stem, F.lit(".tiff"))
    return (
        F.when(mime.is_raw_image(c("mimetype")), developed)
        .when(c("mimetype") == "image/gif", _first_page(c("filename")))
        .otherwise(c("filename"))
    )


def _seek(timeindex: Column, is_text: bool) -> Column:
    """Position in a video as text; NULL for its start. Clients send numbers or texts."""
    if is_text:
        return F.when(js.truthy_text(timeindex), timeindex)
    return F.when(js.truthy_number(timeindex), js.number_text(timeindex))


def _with_picture(routed: DataFrame) -> DataFrame:
    """Add what the picture call is built from: input, asked size, resize and crop.

    A waveform is drawn in the size asked for, by default a certain one, and counts as
    having it; the size of a page is not known to the resize.
    """
    wave = c("converter") == "audio2image"
    page = c("converter") == "document2image"
    wave_w, wave_h = geometry.waveform_size(c("width"), c("height"))
    asked = routed.withColumns(
        {
            "_want_w": F.when(wave, wave_w).otherwise(c("width")),
            "_want_h": F.when(wave, wave_h).otherwise(c("height")),
            "_seek": _seek(c("timeindex"), dict(routed.dtypes)["timeindex"] == "string"),
        }
    )
    turned = geometry.turned_size(
        c("angle"),
        F.when(wave, c("_want_w")).when(~page, c("src_w")),
        F.when(wave, c("_want_h")).when(~page, c("src_h")),
    )
    inputs = [F.when(c("converter") == k, _file(name)) for k, name in PICTURES.items()]
    sized = asked.withColumns({"_turned_w": turned[0], "_turned_h": turned[1]})
    return sized.withColumns(
        {
            "_input": F.coalesce(*inputs, _image_input()),
            "_resize": geometry.resize_spec(
                c("_want_w"), c("_want_h"), c("_turned_w"), c("_turned_h")
            ),
            "_crop": geometry.crop_spec(c("_want_w"), c("_want_h")),
        }
    )


def _picture_call() -> Column:
    """The call every rendition that is an image ends with."""
    return call(
        "convert",
        c("_input"),
        *IMAGE_SETUP,
        (js.truthy_number(c("angle")), ["-rotate", (-c("angle")).cast("string"), "+repage"]),
        "-resize", c("_resize"),
        (c("_crop").isNotNull(), ["-gravity", "Center", "-crop", c("_crop"), "+repage"]),
        *IMAGE_QUALITY,
        (geometry.flips(c("mirror")), ["-flop", "+repage"]),
        _file("image2image.jpg"),
    )


def with_work_dir(jobs: DataFrame, work_root: str, thread_count: int) -> DataFrame:
    """Add ``work_dir`` (one per rendition) and ``threads``."""
    return jobs.withColumns(
        {
            "work_dir": keys.path_in(work_root, keys.base_name(c("filepath"))),
            "threads": F.lit(thread_count),
        }
    )


def with_steps(routed: DataFrame, converters: list[str] | None = None) -> DataFrame:
    """Add ``steps``. Needs a routed job with ``work_dir`` and ``threads``."""
    before = [F.when(c("converter") == k, CONVERTERS[k]()) for k in converters or CONVERTERS]
    picture = F.when(c("converter").endswith("2image"), F.array(_picture_call()))
    calls = F.concat(F.coalesce(*before), F.coalesce(picture, _no_calls()))
    planned = _with_picture(routed).withColumn("steps", numbered(calls))
    return planned.select(*routed.columns, "steps")


# File each converter leaves in the work folder.
RESULTS = {
    "image2image": "image2image.jpg",
    "audio2audio": "audio2audio.webm",
    "audio2image": "image2image.jpg",
    "video2image": "image2image.jpg",
    "video2video": "video2video_pass2.webm",
    "document2document": "document2document.pdf",
    "document2image": "image2image.jpg",
}


def with_result(routed: DataFrame) -> DataFrame:
    """Add ``result``: the file to publish as ``filepath``. A PDF is published as it is."""
    kind = c("converter")
    passed = (kind == "document2document") & mime.is_pdf(c("mimetype"))
    left = [F.when(kind == k, _file(name)) for k, name in RESULTS.items()]
    return routed.withColumn("result", F.when(passed, c("filename")).otherwise(F.coalesce(*left)))


def with_size(routed: DataFrame) -> DataFrame:
    """Add the predicted ``out_w``, ``out_h``; NULL where there is no picture."""
    kind = c("converter")
    page = F.lit(geometry.PAGE_SIDE)
    asked, angle = (c("width"), c("height")), c("angle")
    # A page has the size of its sheet.
    base = [
        F.when(kind == "document2image", page).otherwise(side) for side in (c("src_w"), c("src_h"))
    ]
    image = geometry.image_size(*asked, angle, *base)
    wave = geometry.waveform_size(*asked)
    video = geometry.video_size(*asked, angle, c("src_w"), c("src_h"))

    def side(i: int) -> Column:
        return (
            F.when(kind == "audio2image", wave[i])
            .when(kind == "video2video", video[i])
            .when(kind.endswith("2image"), image[i])
        )

    return routed.withColumns({"out_w": side(0), "out_h": side(1)})


def step_rows(planned: DataFrame) -> DataFrame:
    """One row per tool call, in order."""
    return planned.select("filepath", "converter", F.explode("steps").alias("s")).select(
        "filepath", "converter", "s.step", "s.tool", "s.args"
    )
