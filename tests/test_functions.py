"""Parsers, intervals and lookups on the edge values that reports print."""

import pytest
from pyspark.sql import functions as F

from rowsense.functions import intervals, parse, text
from rowsense.operators import geometry, lookup, metrics, reconcile
from rowsense.sources import files
from rowsense.streaming import limits


def one(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_scalars(spark):
    assert one(spark, ["12", "-1.5", "1d", "NaN", "1e3", ".5", "", None, "3-15"], parse.parse_value) == [12, -1.5, None, None, None, None, None, None, None]
    assert one(spark, ["569.412↑", "12 H", "1e3", ".5", "3-15", "", None], parse.parse_scalar) == [569.412, 12, 1000, 0.5, None, None, None]


def test_ranges(spark):
    got = one(spark, ["3-15", "0--1.75", "-3.0--1.0", "-2-2", "<5.2", "≤5.2", "<2.000E+01", "＜7", ">=10", "25-12", "", None, "a-b"], parse.parse_range)
    assert [None if r is None else (r["low"], r["high"], r["low_open"], r["high_open"]) for r in got] == [
        (3, 15, False, False), (0, 1.75, False, False), None, (-2, 2, False, False), (None, 5.2, False, True), (None, 5.2, False, False), (None, 20, False, True), (None, 7, False, True), (10, None, False, False), None, None, None, None,
    ]


def test_words(spark):
    assert one(spark, [" Negative", "POS", "±", "maybe", None, "++", "未检出", "nil"], parse.parse_qualitative) == ["negative", None, "trace", None, None, "positive", "negative", "negative"]
    assert one(spark, ["H", " l ", "H/L", "L-H", "*h", "x", None, "*", "增高", "【减低】", "H?"], parse.flag_direction) == ["high", "low", "abnormal", "abnormal", None, None, None, "abnormal", "high", "low", None]
    assert one(spark, ["半", "十", "二十三", "七", "1,000", "百", None], parse.chinese_number) == [0.5, 10, 23, 7, 1000, None, None]
    assert one(spark, ["µmol / L", "(mg/dL)", "*10^9/L", None], text.norm_unit) == ["umol/l", "mg/dl", "x10^9/l", None]
    assert one(spark, ["γ-GT（血）", " A．b ", None], text.norm_name) == ["y-gt血", "ab", None]
    assert one(spark, ["", "a", "foobar", None], text.fnv1a) == [0x811C9DC5, 0xE40C292C, 0xBF9CF968, None]


def test_status_and_rounding(spark):
    r = spark.range(1).select(
        intervals.status(F.lit(5.2), parse.parse_range(F.lit("<5.2"))).alias("open"),
        intervals.status(F.lit(5.2), parse.parse_range(F.lit("≤5.2"))).alias("closed"),
        intervals.status_range(parse.parse_value_range(F.lit("1-9")), parse.parse_range(F.lit("5-20"))).alias("partly"),
        intervals.rounded_bound(F.lit(1.23456), True).alias("up"),
        intervals.rounded_bound(F.lit(1.23456), False).alias("down"),
    ).first()
    assert (r["open"], r["closed"], r["partly"]) == ("above", "within", "none")
    assert r["up"] == pytest.approx(1.235) and r["down"] == pytest.approx(1.234)


def test_lookup_takes_the_last_entry(spark):
    dim = spark.createDataFrame([("a", ["Alpha"], "blood", 1), ("b", ["alpha", "Beta"], "urine", 2)], "key string, names array<string>, specimen string, ord int")
    facts = spark.createDataFrame([(1, "ALPHA", "blood"), (2, "Beta（尿）", "unknown"), (5, "Beta (x)", "unknown"), (3, None, "blood"), (4, "alpha", "unknown")], "i int, name string, specimen string")
    got = {r["i"]: (r["key"], r["matched_by"]) for r in lookup.lookup_cascade(facts, dim).collect()}
    assert got == {1: ("a", "scoped"), 2: ("b", "scoped"), 3: (None, "unmatched"), 4: ("b", "direct"), 5: (None, "unmatched")}
    assert lookup.lookup_cascade(facts, dim.limit(0)).filter("key is not null").count() == 0


def test_aurc_is_the_trapezoid(spark):
    rows = [(i, s, e) for i, (s, e) in enumerate([(0.9, 0), (0.8, 1), (0.8, 0), (0.1, 1), (0.0, 1)])]
    df = spark.createDataFrame(rows, "i int, s double, e int")
    risk, errors = [], 0
    for k, (_, _, e) in enumerate(rows, 1):
        errors += e
        risk.append(errors / k)
    expected = sum((a + b) / 2 / len(rows) for a, b in zip([risk[0], *risk], risk))
    assert metrics.aurc(metrics.risk_coverage(df, "s", F.col("e") == 1, "i")).first()[0] == pytest.approx(expected)


def test_cells_bind_to_rows(spark):
    cells = [(1, r * 2 + c, c * 100.0, r * 30.0 + c * 7, 60.0, 20.0, "") for r in range(3) for c in range(2)]
    df = spark.createDataFrame(cells, "page_id long, cell_id long, x double, y double, width double, height double, text string")
    got = {r["cell_id"]: (r["column"], r["anchor"]) for r in geometry.bind_cells(df).collect()}
    assert got == {0: (0, 0), 1: (1, 0), 2: (0, 2), 3: (1, 2), 4: (0, 4), 5: (1, 4)}


def test_admission_depends_on_admissions(spark):
    rows = spark.sql("select * from values (1, 7, timestamp'2024-01-01 00:00:00'), (2, 7, timestamp'2024-01-01 00:00:10'), (3, 7, timestamp'2024-01-01 00:00:20'), (4, 7, timestamp'2024-01-01 00:01:05'), (5, null, timestamp'2024-01-01 00:00:00') as t(event_id, user_id, ts)").selectExpr("cast(event_id as long) event_id", "cast(user_id as long) user_id", "ts")
    got = {r["event_id"]: r["outcome"] for r in limits.admit(rows, F.lit(4), burst=2, seconds=60, daily=9).collect()}
    assert got == {1: "admitted", 2: "admitted", 3: "burst", 4: "daily"}


def test_strict_csv(spark, tmp_path):
    good, twice = tmp_path / "a.csv", tmp_path / "b.csv"
    good.write_text('﻿id,text\n1,"a, ""b""\nc"\n')
    twice.write_text("id,id\n1,2\n")
    assert [tuple(r) for r in files.read_csv_strict(spark, str(good)).collect()] == [("1", 'a, "b"\nc')]
    with pytest.raises(ValueError):
        files.read_csv_strict(spark, str(twice))


def test_reconcile(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, t string")
    b = spark.createDataFrame([(2, "z"), (3, "x")], "k int, t string")
    assert {tuple(r) for r in reconcile.drift(a, b, "k", "t").collect()} == {(1, "missing"), (2, "drift"), (3, "orphan")}


def test_few_texts_travel_to_rows_and_many_meet_them(spark, monkeypatch):
    """Ranges by text give the same rows either way; few texts don't move the rows."""
    rows = spark.range(200).select("id", F.concat((F.col("id") % 9).cast("string"), F.lit("-20")).alias("r"))
    wanted = {i: (float(i % 9), 20.0) for i in range(200)}
    for most, moved in ((50, False), (3, True)):
        monkeypatch.setattr(parse, "FEW", most)
        found = parse.with_ranges(rows, "r", among=rows)
        assert {r["id"]: (r["of"]["low"], r["of"]["high"]) for r in found.collect()} == wanted
        with_hint = "strategy=broadcast" in found._jdf.queryExecution().analyzed().toString()
        assert with_hint != moved
