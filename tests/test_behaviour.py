"""Behavioural cases, confirmed edits, chains of fallbacks, conversions, and the corpus report."""

import random
from collections import Counter

from pyspark.sql import functions as F

from rowsense.operators import behaviour, evaluation, lookup


def judge(rows):
    return rows.withColumn("verdict", F.when(F.col("value").isNull(), "abstain").when(F.col("value") > 10, "flag").otherwise("render")).withColumn("class", F.when(F.col("value") > 5, "high").otherwise("normal"))


def test_cases(spark):
    cases = spark.createDataFrame([("a", "INV", None, 3.0, "x"), ("b", "INV", None, 3.0, "x"), ("c", "MFT", "flag", 11.0, "x"), ("d", "DIR", "flag", 1.0, "x"), ("e", "INV", None, 3.0, "x"), ("f", "INV", None, None, "x")], "id string, test_type string, expected string, value double, note string")
    patches = spark.createDataFrame([("a", "case", {"note": "X"}), ("b", "z-more", {"value": "20"}), ("b", "m-class", {"value": "6"}), ("b", "same", {"value": "4"}), ("c", "ignored", {"value": "0"}), ("f", "gone", {"value": None, "note": "y"}), ("nobody", "p", {"value": "1"})], "case string, name string, patch map<string,string>")
    got = {r["id"]: tuple(r)[1:] for r in behaviour.run_cases(cases, patches, ["value", "note"], judge).collect()}
    assert got == {
        "a": ("INV", "invariant", "render", True, None), "e": ("INV", "invariant", "render", True, None), "f": ("INV", "invariant", "abstain", True, None),
        "b": ("INV", "invariant", "render", False, 'perturbation "m-class" changed verdict render→render / class normal→high'), "c": ("MFT", "flag", "flag", True, None), "d": ("DIR", "flag", "render", False, None),
    }
    assert behaviour.run_cases(cases.limit(0), patches, ["value", "note"], judge).count() == 0


def test_regrounding_changed_reports_equals_regrounding_all(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(r, o, float(rng.randint(0, 20)), "x") for r in range(30) for o in range(4)], "report_id int, ord int, value double, note string")
    edits = spark.createDataFrame([(3, 1, 1, 99.0, "n"), (3, 1, 2, None, None), (7, 0, 1, 50.0, "n"), (99, 0, 1, 1.0, "n"), (7, 9, 1, 1.0, "n")], "report_id int, ord int, at int, value double, note string")
    seen = []

    def ground(x):
        seen.append(x)
        whole = x.groupBy(F.col("report_id").alias("_r")).agg(F.max("value").alias("top"))
        return judge(x).join(whole, F.col("report_id") == F.col("_r")).drop("_r")

    before = ground(rows)
    got = behaviour.reground(rows, before, edits, ground, ["value", "note"])
    last = {(3, 1): (None, None), (7, 0): (50.0, "n")}
    after = ground(spark.createDataFrame([(r["report_id"], r["ord"], *last.get((r["report_id"], r["ord"]), (r["value"], r["note"]))) for r in rows.collect()], rows.schema))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, after.select(*got.columns).collect()), key=key)
    assert {r["report_id"] for r in seen[1].select("report_id").collect()} == {3, 7}


def test_fallbacks_of_any_length(spark):
    chain = [("long", f"l{i}", "end" if i == 10 else None, f"l{i + 1}" if i < 10 else None, True) for i in range(11)]
    texts = [*chain, ("round", "a", None, "b", True), ("round", "b", None, "c", True), ("round", "c", None, "b", True), ("self", "a", None, "a", True), ("lost", "a", None, "z", True), ("none", "a", None, None, True), ("own", "a", "x", "b", None)]
    got = {(r["id"], r["lang"]): r for r in evaluation.resolved_texts(spark.createDataFrame(texts, "id string, lang string, text string, fallback string, verified boolean")).collect()}
    assert [(got["long", f"l{i}"]["text"], got["long", f"l{i}"]["verified"], got["long", f"l{i}"]["resolved_lang"], len(got["long", f"l{i}"]["path"])) for i in range(11)] == [("end", i == 10, "l10", 11 - i) for i in range(11)]
    assert got["round", "a"]["error"] == "Localized text fallback cycle: a -> b -> c -> b" and got["self", "a"]["error"] == "Localized text fallback cycle: a -> a"
    assert got["lost", "a"]["error"] == "Localized text without a fallback: a -> z" and got["none", "a"]["error"] == "Localized text without a fallback: a"
    assert (got["own", "a"]["text"], got["own", "a"]["verified"], got["own", "a"]["error"]) == ("x", False, None)


def test_conversions_take_the_first_factor_and_leave_allowed_units(spark):
    facts = spark.createDataFrame([(1, "k", 2.0, "mg/dl", ["mmol/L"]), (2, "k", 2.0, "mmol/l", ["mmol/L", "g"]), (3, "k", 2.0, "g", None), (4, None, 2.0, "g", [])], "id int, key string, value double, unit string, allowed array<string>")
    factors = spark.createDataFrame([("k", "mg/dL", "mmol/L", 9.0, 2), ("k", "MG/DL", "mmol/L", 3.0, 1), ("k", "mmol/L", "x", 5.0, 1), ("k", "g", "mmol/L", 7.0, 3)], "key string, from_unit string, to_unit string, factor double, ord int")
    got = {r["id"]: (r["converted"], r["converted_unit"]) for r in lookup.convert(facts, factors, allowed="allowed").collect()}
    assert got == {1: (6.0, "mmol/L"), 2: (None, None), 3: (14.0, "mmol/L"), 4: (None, None)}
    entries = spark.createDataFrame([("a", "ours", 17, 1.0), ("a", "ours", 18, 1.0), ("a", "ours", None, 1.0), ("b", "ours", 5, 1.0), ("a", "report-only", 5, 1.0)], "key string, interpretation string, age int, ref_low double")
    young = lookup.adult_only(entries, F.col("age"), ["a"], bounds=["ref_low"]).collect()
    assert [(r["interpretation"], r["ref_low"]) for r in young] == [("report-only", None), ("ours", 1.0), ("ours", 1.0), ("ours", 1.0), ("report-only", 1.0)]


def test_report_equals_a_plain_count(spark):
    rng = random.Random(2)
    fields = "report_id int, name string, key string, value_text string, value double, range_text string, flag string, asserted boolean, said_out boolean, entry_high_stakes boolean, needs_confirm boolean, needs_review boolean, abstains boolean, classification string, rule_ids array<string>"
    pick = rng.choice
    rows = [(rng.randrange(9), pick([" Na", "K ", "Zz", "Ca", "Q"]), pick(["k", "k", None]), pick(["5", "", None]), pick([5.0, None]), pick(["1-9", " "]), pick(["0", "1", "", None]), pick([True, False, None]), pick([True, False]), pick([True, False, None]), pick([True, False]), pick([True, False]), pick([True, False]), pick(["normal", "low", "high", "unclassified"]), pick([[], ["R3"], ["R3", "R5"], None])) for _ in range(400)]
    gold = [("Na", "analyte", True), ("K", "analyte", False), ("Ca", "non-analyte", False), ("Na", "non-analyte", False)]
    got = evaluation.corpus_report(spark.createDataFrame(rows, fields), spark.createDataFrame(gold, "name string, kind string, high_stakes boolean")).first().asDict()
    want, reasons, rules = Counter(), Counter(), Counter()
    labels = {"Na": ("analyte", True), "K": ("analyte", False), "Ca": ("non-analyte", False)}
    for _, name, key, vt, v, rt, flag, said, out, stakes, confirm, review, gone, cls, ids in rows:
        kind, high = labels.get(name.strip(), (None, False))
        scored = flag in ("0", "1")
        ours = {"normal": False, "low": True, "high": True}.get(cls)
        agrees = None if gone or not scored or ours is None else ours == (flag == "1")
        full = scored and bool((vt or "").strip()) and bool((rt or "").strip())
        told = {"items": True, "recognized": key is not None, "chip_reproduced": bool(said), "chip_deferred": not said, "chip_scorable": full, "chip_correct": full and said and out == (flag == "1"), "chip_wrong": full and said and out != (flag == "1"), "chip_abstained": full and not said, "recognized_high_stakes": bool(stakes), "recognized_high_stakes_confirm": stakes and confirm,
                "gold_high_stakes": high, "gold_high_stakes_confirm": high and confirm, "gold_high_stakes_unrecognized": high and key is None, "gold_analyte": kind == "analyte", "gold_non_analyte": kind == "non-analyte", "abstained": gone, "classified": not gone, "confirmed": not gone and confirm, "agreement_scored": agrees is not None, "agree": agrees,
                "confident_scored": agrees is not None and not confirm and not review, "confident_agree": agrees and not confirm and not review, "confidently_wrong": agrees is False and not confirm and not review, "disagreements": agrees is False}
        want.update({k: 1 for k, on in told.items() if on})
        if gone:
            reasons["R1-UNKNOWN-ANALYTE" if key is None else "NON-NUMERIC-VALUE" if v is None else ids[0] if ids else "OTHER-ABSTAIN"] += 1
        elif confirm:
            rules.update(set(ids or []))
    assert {k: got[k] for k in evaluation.COUNTS} == {k: want[k] for k in evaluation.COUNTS}
    assert got["abstain_by_reason"] == dict(reasons) and got["confirm_by_rule"] == dict(rules) and got["reports"] == len({r[0] for r in rows})
    assert all(got[n] == (want[a] / want[b] if want[b] else None) for n, (a, b) in evaluation.RATIOS.items())
    lists = evaluation.worst_rows(spark.createDataFrame(rows, fields), spark.createDataFrame(gold, "name string, kind string, high_stakes boolean"), 3).collect()
    assert max(r["place"] for r in lists) == 3 and {r["kind"] for r in lists} <= {"chip-wrong", "gold-unrecognized", "confidently-wrong", "disagreement"}
    empty = evaluation.corpus_report(spark.createDataFrame([], fields), spark.createDataFrame([], "name string, kind string, high_stakes boolean")).first()
    assert empty["items"] == 0 and empty["agreement"] is None and empty["abstain_by_reason"] == {} and empty["reports"] == 0
