"""Packets: a round trip, changed files, failed tasks, unnamed reviewers."""

import json
import os

import pytest
from pyspark.sql import functions as F

from rowsense.sources import packets


@pytest.fixture
def at(spark, tmp_path):
    spark.dataSource.register(packets.Packets)
    return f"file://{tmp_path}/packet"


def files(at):
    base = at.removeprefix("file://")
    return sorted(os.listdir(base)) if os.path.isdir(base) else []


ROWS = [("1", 'a "quoted", text', "བོད"), ("2", "two\nlines", None), ("3", None, " x "), (None, None, "é")]


def write(spark, at, rows=ROWS, mode="append"):
    spark.createDataFrame(rows, "id string, zh string, bo string").repartition(3).write.format("packet").mode(mode).option("path", at).save()


def read(spark, at, schema=None, **options):
    out = spark.read.format("packet").options(**options)
    return (out.schema(schema) if schema else out).load(at)


def test_round_trip(spark, at):
    write(spark, at)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, read(spark, at, blank="true").collect()), key=key) == sorted(ROWS, key=key)
    with pytest.raises(Exception, match="reviewer's name"):
        read(spark, at).collect()
    held = packets.sealed(at, " Tashi ", "t@example.org", "2024-01-02")
    assert held["reviewer_name"] == "Tashi" and len(held["files"]) == 3
    assert sorted(r["bo"] or "" for r in read(spark, at, "bo string").collect()) == ["", " x ", "é", "བོད"]
    with pytest.raises(Exception, match="missing required columns: other"):
        read(spark, at, "id string, other string").collect()


def test_a_changed_file_is_refused_until_it_is_sealed(spark, at):
    write(spark, at)
    packets.sealed(at, "n", "c")
    file = next(f for f in files(at) if f.endswith(".csv"))
    path = f"{at.removeprefix('file://')}/{file}"
    with open(path, "rb") as f:
        raw = f.read()
    with open(path, "wb") as f:
        f.write(b"\xef\xbb\xbf" + raw + b"9,new,row\n")
    with pytest.raises(Exception, match="has changed since"):
        read(spark, at).collect()
    packets.sealed(at, "n", "c")
    assert ("9", "new", "row") in set(map(tuple, read(spark, at).collect()))
    with open(path, "ab") as f:
        f.write(b"too,few\n")
    packets.sealed(at, "n", "c")
    with pytest.raises(Exception, match="another number of fields"):
        read(spark, at).collect()


def test_a_failed_task_leaves_no_packet(spark, at):
    rows = spark.createDataFrame([(str(i),) for i in range(9)], "id string").repartition(3)
    bad = rows.select(F.when(F.col("id") == "5", F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("packet").mode("append").option("path", at).save()
    assert packets.MANIFEST not in files(at)
    with pytest.raises(Exception, match="is missing from"):
        read(spark, at, "id string", blank="true").collect()


def test_writing_again_needs_overwrite_and_makes_a_new_packet(spark, at):
    write(spark, at)
    packets.sealed(at, "n", "c")
    before = packets.manifest_of(at)
    with pytest.raises(Exception, match="holds a packet already"):
        write(spark, at)
    assert packets.manifest_of(at) == before and len(files(at)) == 4
    write(spark, at, ROWS[:1], mode="overwrite")
    after = packets.manifest_of(at)
    assert after["packet_id"] != before["packet_id"] and after["reviewer_name"] == "" and not set(files(at)) & {f["file"] for f in before["files"]}
    assert [tuple(r) for r in read(spark, at, blank="true").collect()] == ROWS[:1]


def test_an_empty_packet(spark, at):
    spark.createDataFrame([], "id string").write.format("packet").mode("append").option("path", at).save()
    assert read(spark, at, "id string", blank="true").count() == 0
    json.dumps(packets.manifest_of(at))
