"""What is shown, and what is held back."""

from pyspark.sql import functions as F

from rowsense.operators import display


def column(spark, values, kind, made):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(made(F.col("v"))).collect()]


def test_names_values_and_consent(spark):
    assert column(spark, ["cocaine,urine", "Oxycodone ", "Oxycodone total", "人类免疫缺陷病毒抗体/抗原（P24）", None], "string", display.sensitive) == [True, True, False, True, False]
    assert column(spark, ["measurement", "blood", None], "string", display.printed_specimen) == ["unknown", "blood", None]
    assert column(spark, ["5", None], "string", lambda v: display.value_text(v, F.when(v == "5", "mg"))) == ["5 mg", "—"]
    assert column(spark, ["3", " 3.0 ", "3.5", "2", "", None, "x"], "string", lambda v: display.consented(v, 3)) == [True, True, False, False, False, False, False]


def test_sizes(spark):
    df = spark.createDataFrame([(3200, 1601), (100, 50), (1601, 1), (1, 3201)], "w int, h int")
    assert [tuple(r[0]) for r in df.select(display.target_size(F.col("w"), F.col("h"))).collect()] == [(1600, 801), (100, 50), (1600, 1), (0, 1600)]


def test_covered_parts(spark):
    box = "array<struct<x:double,y:double,w:double,h:double>>"
    whole = [1.0] * 16
    rows = [(whole, 4, 4, [(0.25, 0.25, 0.5, 0.5)]), (whole, 4, 4, [(0.0, 0.0, 0.001, 0.9)]), (whole, 4, 4, None), (whole[:15], 4, 4, [(0.0, 0.0, 1.0, 1.0)]), (None, 4, 4, [(0.0, 0.0, 1.0, 1.0)])]
    got = [r[0] for r in spark.createDataFrame(rows, f"p array<double>, w int, h int, b {box}").select(display.covered(F.col("p"), F.col("w"), F.col("h"), F.col("b"))).collect()]
    assert got[0]["pixels"] == [0.0 if i in (5, 6, 9, 10) else 1.0 for i in range(16)] and got[1]["pixels"] == got[2]["pixels"] == whole
    assert [g["refused"] for g in got] == [None, None, None, "decode-failed", "decode-failed"] and got[3]["pixels"] is None


def test_view_of_notes(spark):
    rows = [(0, "a", "b", [("drug", "x")]), (2, "a", "b", [("drug", "x")]), (1, "a", "b", None)]
    got = display.notes_view(spark.createDataFrame(rows, "action int, source string, translation string, preserved array<struct<type:string,raw:string>>")).collect()
    assert [(r["translation"], r["abstain_note"] is None, [c["label"] for c in r["chips"]]) for r in got] == [("b", True, ["x"]), ("", False, []), ("b", True, [])]
