"""The manifest sink: batches that appear as a whole and once, compaction, files read per batch."""

import os
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from catalens.operators import lookup
from catalens.sources import manifest
from catalens.streaming import request_stream as rs

KINDS = ("jpg", "webm", "pdf", "x")


def listing(spark, numbers):
    names = [f"{i}_w{i}_h0_s0_a0_m{i % 2}.{e}" for i in numbers for e in KINDS]
    return manifest.manifest_rows(spark.createDataFrame([(f"/cache/{n}", n) for n in names], "filepath string, name string"))


def data_files(path):
    return sorted(str(p) for p in Path(path).rglob("*.parquet"))


def stored(spark, path):
    return sorted(r.filepath for r in manifest.read_manifest(spark, path).select("filepath").collect())


def test_a_repeated_batch_changes_no_file(spark, tmp_path):
    path = str(tmp_path / "m")
    manifest.write_manifest(listing(spark, range(20)), path, "one")
    before = data_files(path), manifest.committed_files(path)
    manifest.write_manifest(listing(spark, range(20)), path, "one")
    assert (data_files(path), manifest.committed_files(path)) == before
    # The commit itself, reached again after a failure behind it, drops what was written anew.
    manifest._append(listing(spark, range(20)), path, "one", [])
    assert (data_files(path), manifest.committed_files(path)) == before
    assert len(stored(spark, path)) == 80


def test_paths_are_there_once(spark, tmp_path):
    path = str(tmp_path / "m")
    twice = listing(spark, range(10)).unionByName(listing(spark, range(5, 15)))
    manifest.write_manifest(twice, path, "one")
    manifest.write_manifest(listing(spark, range(12, 20)), path, "two")
    names = stored(spark, path)
    assert len(names) == 80 == len(set(names))
    plan = manifest.read_manifest(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_a_failed_append_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "m")
    manifest.write_manifest(listing(spark, range(4)), path, "one")
    before = manifest.committed_files(path)
    broken = listing(spark, range(4, 40)).withColumn(
        "id", F.when(F.col("name") == "39_w39_h0_s0_a0_m1.x", F.raise_error(F.lit("lost"))).otherwise(F.col("id"))
    )
    with pytest.raises(Exception, match="lost"):
        manifest.write_manifest(broken, path, "two")
    assert manifest.committed_files(path) == before and len(stored(spark, path)) == 16
    manifest.write_manifest(listing(spark, range(4, 40)), path, "two")
    assert len(stored(spark, path)) == 160
    # A file that no batch names is not read.
    shutil.copy(data_files(path)[0], os.path.dirname(data_files(path)[0]) + "/orphan.parquet")
    assert len(stored(spark, path)) == 160


def test_compaction(spark, tmp_path):
    path = str(tmp_path / "m")
    for n in range(4):
        manifest.write_manifest(listing(spark, range(n * 100, n * 100 + 100)), path, f"b{n}")
    before, n_files = stored(spark, path), len(manifest.committed_files(path))
    replaced = manifest.compact(spark, path, "together")
    assert 0 < replaced <= n_files
    after = manifest.committed_files(path)
    assert len(after) == len({f["file"].rsplit("/", 1)[0] for f in after}) < n_files
    assert stored(spark, path) == before and sum(f["rows"] for f in after) == len(before)
    assert manifest.compact(spark, path, "together") == 0 and manifest.committed_files(path) == after
    assert manifest.compact(spark, path, "again") == 0
    with pytest.raises(ValueError):
        manifest.write_manifest(listing(spark, [1]), path, "../x")


def test_a_batch_reads_the_buckets_it_asks_for(spark, tmp_path):
    """The files of all other buckets may be gone."""
    path = str(tmp_path / "m")
    manifest.write_manifest(listing(spark, range(200)), path, "one")
    keyed = listing(spark, [3, 500]).select(
        F.monotonically_increasing_id().alias("request_id"), "filepath", F.lit(None).cast("string").alias("error")
    )
    keyed.coalesce(1).write.parquet(str(tmp_path / "in"))
    wanted = {r[0] for r in keyed.select(manifest.bucket_of("filepath")).collect()}
    assert len(wanted) < manifest.BUCKETS
    gone = [f for f in data_files(path) if int(f.split("bucket=")[1].split("/")[0]) not in wanted]
    assert gone
    for f in gone:
        os.truncate(f, 0)
    stream = spark.readStream.schema(keyed.schema).parquet(str(tmp_path / "in"))
    run = rs.lookup_stream(
        stream, lambda: manifest.read_manifest(spark, path).select("filepath", "bucket"), str(tmp_path / "out")
    )
    run.awaitTermination()
    got = rs.read_rows(spark, str(tmp_path / "out"), "request_id bigint, filepath string, hit boolean")
    assert {r.filepath: r.hit for r in got.collect()} == {
        r.filepath: "/3_" in r.filepath for r in lookup.valid(keyed).collect()
    }


def test_empty_manifest(spark, tmp_path):
    path = str(tmp_path / "m")
    assert manifest.read_manifest(spark, path).count() == 0
    manifest.write_manifest(listing(spark, range(3)).where("false"), path, "none")
    assert manifest.read_manifest(spark, path).count() == 0 and manifest.is_committed(path, "none")
