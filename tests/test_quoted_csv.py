"""Quoted CSV in byte ranges of any size against the csv module."""

import csv
import io
import random

import pytest

from catalens.sources import dumps, quoted_csv


def text(rng):
    parts = ["a", "é", ",", '"', "\n", "\r\n", " ", "xyz", '""', "\n\n", '",\n"']
    return "".join(rng.choice(parts) for _ in range(rng.randrange(8)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [(f"/{n}/{text(rng)}", text(rng)) for n in range(300)] + [("/long", '"\n,' * 2000), ("/last", "end")]


def written(rows, **options):
    out = io.StringIO(newline="")
    csv.writer(out, **options).writerows(rows)
    return out.getvalue().encode()


def test_every_cut(rows):
    """Ranges of any width give every record once, from the first byte of a record on."""
    data = written(rows[:40], quoting=csv.QUOTE_ALL, lineterminator="\n")
    for width in [1, 2, 3, 7, 64, 1000, len(data)]:
        found = b""
        for start in range(0, len(data), width):
            inside = data[:start].count(b'"') % 2 == 1
            first = start == 0 or (not inside and data[start - 1 : start] == b"\n")
            pieces = (data[k : k + 5] for k in range(start, len(data), 5))
            for record in quoted_csv.record_bounds(pieces, start, min(start + width, len(data)), inside, first):
                assert record.endswith(b"\n") and record.count(b'"') % 2 == 0
                found += record
        assert found == data, width


@pytest.mark.parametrize("range_bytes", [11, 500, 1 << 20])
@pytest.mark.parametrize("options", [{"quoting": csv.QUOTE_ALL}, {"lineterminator": "\n"}])
def test_equals_the_csv_module(spark, tmp_path, rows, range_bytes, options):
    some = rows if range_bytes > 11 else rows[:60]
    (tmp_path / "a.csv").write_bytes(written(some, **options))
    (tmp_path / "b.csv").write_bytes(written([("/b", "x")], **options).rstrip())  # no line end
    (tmp_path / "_skip.csv").write_bytes(b"no,no\n")
    (tmp_path / "empty.csv").write_bytes(b"")
    got = quoted_csv.read_quoted(spark, str(tmp_path), ["path", "mimetype"], range_bytes)
    want = sorted((p, m) for p, m in [*some, ("/b", "x")])
    assert sorted((r.path, r.mimetype or "") for r in got.collect()) == want
    one = quoted_csv.read_quoted(spark, str(tmp_path / "a.csv"), ["path", "mimetype"], range_bytes)
    assert one.count() == len(some)


def test_one_file_in_many_tasks(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_bytes(written(rows * 5, quoting=csv.QUOTE_ALL))
    got = quoted_csv.read_quoted(spark, str(tmp_path), ["path", "mimetype"], 2000)
    held = got.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(held) == 5 * len(rows) and sum(n > 0 for n in held) > 8


def test_values_that_lack_or_are_too_many(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'/one\n/two,"a\nb"\n\n/three,x,y\n"",""\n/four,\n')
    got = quoted_csv.read_quoted(spark, str(tmp_path), ["path", "mimetype"], 6)
    assert sorted(map(str, got.collect())) == sorted(
        f"Row(path={p!r}, mimetype={m!r})"
        for p, m in [("/one", None), ("/two", "a\nb"), ("/three", "x"), ("", ""), ("/four", None)]
    )


def test_feed(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes(b'/a,"image/png\n"\n"/b ""c""","text/html\n"\n')
    got = dumps.read_mime_feed(spark, str(tmp_path), 5).collect()
    assert sorted(map(tuple, got)) == [('/a', "image/png"), ('/b "c"', "text/html")]
