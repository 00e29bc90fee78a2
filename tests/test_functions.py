"""Edge rows of the column functions."""

import pytest
from pyspark.sql import functions as F

from catalens.functions import boxes, dates, geometry, js, keys, mime

c = F.col


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_first_present_value(spark):
    df = spark.createDataFrame(
        [("a", "b"), ("", "b"), (None, "b"), ("", ""), (None, None)], "a string, b string"
    )
    assert [v for (v,) in values(df, js.or_text(c("a"), c("b")))] == ["a", "b", "b", "", None]
    df = spark.createDataFrame(
        [(1.0, 2.0), (0.0, 2.0), (float("nan"), 2.0), (None, 0.0), (None, None)], "a double, b double"
    )
    assert [v for (v,) in values(df, js.or_number(c("a"), c("b")))] == [1.0, 2.0, 2.0, 0.0, None]


@pytest.mark.parametrize(
    "text,expected",
    [("90", 90), ("90abc", 90), (" \t-90", -90), (" +7", 7), ("abc", None), ("", None),
     (None, None), ("1e3", 1), ("0x10", 0), ("9" * 30, 1e30), ("-", None)],
)
def test_parse_int(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert values(df, js.parse_int(c("t"))) == [(expected,)]


@pytest.mark.parametrize(
    "number,expected",
    [(12.0, "12"), (12.5, "12.5"), (0.001, "0.001"), (12345678.5, "12345678.5"), (100.0, "100"), (None, None)],
)
def test_number_text(spark, number, expected):
    df = spark.createDataFrame([(number,)], "n double")
    assert values(df, js.number_text(c("n"))) == [(expected,)]


def test_media_types(spark):
    rows = [("image/CR2",), ("video/mp4",), ("audio/mpeg",), ("text/plain",), ("image/cr2",), (None,)]
    df = spark.createDataFrame(rows, "m string")
    found = values(df, mime.media_type(c("m")), mime.is_raw_image(c("m")))
    assert found == [
        ("image", True), ("video", False), ("audio", False), ("document", False),
        ("other", False), ("other", False),
    ]
    assert mime.mime_dimension(spark).count() == sum(map(len, mime.MIME_GROUPS.values()))


def test_strict_mode_fails(spark):
    df = spark.createDataFrame([("sticker",)], "t string")
    strict = mime.strict(mime.extension_of_type(c("t")), mime.type_error(c("t")))
    with pytest.raises(Exception, match="Unknown format type, sticker"):
        df.select(strict).collect()


KEY = "id string, type string, width int, height int, angle string, mirror string"


@pytest.mark.parametrize(
    "row,key",
    [
        (("7", "image", 20, 30, "90", "true"), "7_w20_h30_s0_a90_m1.jpg"),
        (("7", "image", None, None, None, None), "7_w0_h0_s1_a0_m0.jpg"),
        (("7", "image", 0, None, None, ""), "7_w0_h0_s0_a0_m0.jpg"),
        (("7", "video", 20, 20, "-90", "false"), "7_w20_h20_s1_a-90_m1.webm"),
        (("7", "audio", None, 20, "0", None), "7_w0_h20_s0_a0_m0.webm"),
        (("a_b", "document", 1, 2, "270x", None), "a_b_w1_h2_s0_a270_m0.pdf"),
        (("7", "*", 1, 2, None, None), "7_w1_h2_s0_a0_m0."),
        (("7", "sticker", 1, 2, None, None), None),
    ],
)
def test_build_key(spark, row, key):
    df = spark.createDataFrame([row], KEY).withColumn("angle", keys.normalise_angle(c("angle")))
    built = keys.build_key(*[c(n) for n in ("id", "type", "width", "height", "angle", "mirror")])
    assert values(df, built) == [(key,)]


@pytest.mark.parametrize(
    "angle,normal,bad",
    [("90", 90, False), ("-270", -270, False), ("0", None, False), ("abc", None, False),
     ("45", None, True), ("360", None, True), ("9" * 25, None, True), (None, None, False), ("-0", None, False)],
)
def test_angle(spark, angle, normal, bad):
    df = spark.createDataFrame([(angle,)], "a string")
    ((value, error),) = values(df, keys.normalise_angle(c("a")), keys.angle_error(c("a")))
    assert value == normal and (error == keys.ANGLE_ERROR) == bad


def test_parse_key(spark):
    names = [
        "7_w20_h30_s0_a-90_m1.jpg", "7_w0_h0_s1_a0_m0.webm", "7_wx_h_s1_a_m2.pdf", "7_w1_h1_s1_a0_m0.gif",
        "note.txt", "a_b_w1_h2_s0_a0_m0.jpg", "7_w1_h1_s1_a0_m0.",
    ]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    rows = [tuple(r) for (r,) in values(df, keys.parse_key(c("n")))]
    assert rows == [
        ("image", 20, 30, -90, True, None),
        ("video", 0, 0, 0, False, None),
        ("document", None, None, None, False, None),
        (None, 1, 1, 0, False, "Unknown extension, gif"),
        (None, None, None, None, None, "Not a rendition key"),
        ("image", 1, 2, 0, False, None),
        (None, 1, 1, 0, False, "Unknown extension, "),
    ]


def test_round_trip_of_keys(spark):
    """All but audio, which is stored like video, come back from their key."""
    sizes = [None, 0, 20, 320]
    rows = [
        (str(i), t, w, h, a, m)
        for i, (t, w, h, a, m) in enumerate(
            (t, w, h, a, m)
            for t in ("image", "video", "document")
            for w in sizes for h in sizes for a in (None, 90, -270) for m in (None, "true")
        )
    ]
    schema = "id string, type string, width int, height int, angle int, mirror string"
    df = spark.createDataFrame(rows, schema)
    built = keys.build_key(*[c(n) for n in ("id", "type", "width", "height", "angle", "mirror")])
    back = df.withColumn("k", keys.parse_key(built)).withColumn("back_id", keys.id_of_key(built))
    wrong = back.where(
        "k.type <> type OR k.width <> coalesce(width, 0) OR k.height <> coalesce(height, 0)"
        " OR k.angle <> coalesce(angle, 0) OR k.mirror <> coalesce(mirror = 'true', false)"
        " OR back_id <> id OR k.error IS NOT NULL"
    )
    assert wrong.count() == 0 and back.count() == len(rows)


@pytest.mark.parametrize(
    "text,zone",
    [
        ("2020:01:02 03:04:05", None), ("2020/01/02 03:04:05Z", "+00:00"),
        ("2020:01:02 03:04:05.123+02:00", "+02:00"), ("2020:01:02 03:04:05|x", "|x"),
        ("at 2020:01:02 03:04:05 sharp", None),
    ],
)
def test_dates(spark, text, zone):
    df = spark.createDataFrame([(text,)], "t string")
    ((parsed,),) = values(df, dates.parse_date(c("t")))
    assert tuple(parsed) == ("2020", "01", "02", "03", "04", "05", zone)


def test_bad_dates(spark):
    df = spark.createDataFrame([("2020-01-02",), ("",), (None,)], "t string")
    error = dates.date_error(c("t"), dates.find_date(c("t")))
    assert values(df, dates.parse_date(c("t")), error) == [
        (None, "Unparsable date, 2020-01-02"), (None, None), (None, None),
    ]


# source type, rendition type, source size, asked size, angle, expected size
GOLDEN = [
    ("image", "image", 350, 150, 20, None, None, 20, 9),
    ("image", "image", 350, 150, 20, 30, None, 20, 30),
    ("image", "image", 350, 150, 20, 20, None, 20, 20),
    ("image", "image", 350, 150, None, None, 90, 150, 350),
    ("image", "image", 350, 150, None, None, None, 350, 150),
    ("image", "image", 350, 150, 75, 175, 90, 75, 175),
    ("video", "image", 560, 320, 20, None, None, 20, 11),
    ("video", "image", 560, 320, 20, 30, None, 20, 30),
    ("video", "image", 560, 320, 20, 20, None, 20, 20),
    ("video", "video", 560, 320, 20, None, None, 20, 11),
    ("video", "video", 560, 320, 20, 30, None, 20, 30),
    ("video", "video", 560, 320, 20, 20, None, 20, 20),
    ("video", "video", 560, 320, None, None, 90, 320, 560),
    ("audio", "image", None, None, 20, None, None, 20, 15),
    ("audio", "image", None, None, 20, 30, None, 20, 30),
    ("audio", "image", None, None, None, None, None, 720, 540),
    ("document", "image", None, None, 20, None, None, 20, 20),
]


def test_golden_sizes(spark):
    from catalens.plans import steps

    rows = [
        (i, f"{s}2{d}", sw, sh, w, h, a, ew, eh)
        for i, (s, d, sw, sh, w, h, a, ew, eh) in enumerate(GOLDEN)
    ]
    schema = (
        "i int, converter string, src_w int, src_h int, width int, height int, angle int, ew int, eh int"
    )
    sized = steps.with_size(spark.createDataFrame(rows, schema))
    wrong = sized.where("NOT (out_w <=> ew AND out_h <=> eh)").collect()
    assert not wrong


@pytest.mark.parametrize(
    "asked,source,resize,crop",
    [
        ((20, 30), (350, 150), "x30", "20x30+0+0"),
        ((300, 10), (350, 150), "300x", "300x10+0+0"),
        ((None, 30), (350, 150), "x30", "0x30+0+0"),
        ((20, None), (350, 150), "20x", None),
        ((None, None), (350, 150), "350x150", None),
        ((None, None), (None, None), "x", None),
        ((20, 30), (None, None), "x30", "20x30+0+0"),
        ((20, 30), (350, 0), "x30", "20x30+0+0"),
        ((0, 0), (0, 150), "x150", None),
    ],
)
def test_resize_and_crop(spark, asked, source, resize, crop):
    df = spark.createDataFrame([(*asked, *source)], "w int, h int, sw int, sh int")
    found = values(
        df,
        geometry.resize_spec(c("w"), c("h"), c("sw"), c("sh")),
        geometry.crop_spec(c("w"), c("h")),
    )
    assert found == [(resize, crop)]


def test_only_true_flips(spark):
    df = spark.createDataFrame([("true",), ("false",), ("1",), ("",), (None,)], "m string")
    flips = [f for (f,) in values(df, geometry.flips(c("m")))]
    assert flips == [True, False, False, False, False]


def test_face_box_and_id(spark):
    df = spark.createDataFrame([(100, 260, 220, 90, 1021, 769)], "t int, r int, b int, l int, w int, h int")
    box = boxes.face_box(c("t"), c("r"), c("b"), c("l"), c("w"), c("h"))
    ((found, id_),) = values(df, box, boxes.face_id(F.lit(5), F.lit(0)))
    assert tuple(found) == (
        round((90 + 170 / 2) / 1021, 5), round((100 + 120 / 2) / 769, 5),
        round(170 * 1.65 / 1021, 5), round(120 * 1.65 / 769, 5),
    )
    assert [len(p) for p in id_.split("-")] == [8, 4, 4, 4, 12]


@pytest.mark.parametrize(
    "size,expected",
    [((1600, 900), (1600, 900)), ((3200, 1800), (1600, 900)), ((1000, 4000), (400, 1600)),
     ((5000, 5000), (1600, 1600)), ((9000, 2), (1600, 1)), ((1601, 1000), (1600, 999))],
)
def test_match_size(spark, size, expected):
    df = spark.createDataFrame([size], "w int, h int")
    ((s,),) = values(df, boxes.match_size(c("w"), c("h")))
    assert (s["width"], s["height"]) == expected
