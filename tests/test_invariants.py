"""What translations keep, and imports of reviewed texts."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from rowsense.operators import invariants, text_import
from rowsense.plans import safety_queries


def plain(zh, bo):
    digits = str.maketrans("༠༡༢༣༤༥༦༧༨༩−", "0123456789-")
    a, b = (zh or "").translate(digits), (bo or "").translate(digits)
    number = re.compile(r"(?<![0-9.])[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)")
    pair = re.compile(r"([+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+))\s*(?:-|–|—|~|～|至|到)\s*([+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+))")
    latin, unit = re.compile(r"[A-Za-z][A-Za-z0-9]*(?:[-'][A-Za-z0-9]+)*"), re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(map(re.escape, sorted(invariants.UNITS, key=lambda u: -len(u)))) + ")(?![A-Za-z0-9])")
    out = []
    if Counter(number.findall(a)) != Counter(number.findall(b)):
        out.append("B1")
    if re.search("[༠-༩]", bo or ""):
        out.append("B1")
    if pair.findall(a) != pair.findall(b):
        out.append("B2")
    out += ["B4"] * (Counter(latin.findall(zh or "")) != Counter(latin.findall(bo or ""))) + ["B5"] * (Counter(unit.findall(zh or "")) != Counter(unit.findall(bo or "")))
    return out + ["B7"] * (len(re.findall("[。；：;:]", zh or "")) != len(re.findall("[།༎]", bo or "")))


def common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_findings_equal_a_plain_version(spark):
    rng = random.Random(1)
    bits = ["5", "5.5", "-3", "3-5", "3 至 5", "5–3", "mmol/L", "mg/dL", "g/L2", "%", "10%", "Na", "T-3", "。", "；", "།", "༥", "−2", ".5", "1.2.3", " ", " ", "血", "ཁྲག་"]
    rows = [(i, *("".join(rng.choice(bits) for _ in range(rng.randint(0, 7))) for _ in range(2))) for i in range(400)] + [(400, None, None), (401, "5", None), (402, None, "")]
    rows += [(i + 500, z, z) for i, z, _ in rows[:50]]
    df = spark.createDataFrame(rows, "id int, zh string, bo string")
    parts = (invariants.number_findings, invariants.interval_findings, invariants.latin_findings, invariants.unit_findings, invariants.separator_findings)
    got = df.select("*", F.transform(F.concat(*(p(F.col("zh"), F.col("bo")) for p in parts)), lambda f: f["check"]).alias("c")).collect()
    assert all(r["c"] == plain(r["zh"], r["bo"]) for r in got), [(r, plain(r["zh"], r["bo"])) for r in got if r["c"] != plain(r["zh"], r["bo"])][:3]


def test_alignment_and_placeholders(spark):
    rng = random.Random(2)
    pairs = [([rng.choice("abc") for _ in range(rng.randint(0, 6))], [rng.choice("abc") for _ in range(rng.randint(0, 6))]) for _ in range(80)]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    assert [r[0] for r in df.select(invariants.kept_in_order(F.col("a"), F.col("b"))).collect()] == [common(a, b) for a, b in pairs]
    held = spark.createDataFrame([(["{a}", "{b}"], ["{b}", "{a}"]), (["{a}"], ["{a}"]), (None, None), (None, ["{a}"])], "a array<string>, b array<string>")
    found = [[(f["check"], f["kept"]) for f in r[0]] for r in held.select(invariants.placeholder_findings(F.col("a"), F.col("b"))).collect()]
    assert found == [[("B10", 1)], [], [], [("B10", 0)]]


def test_candidates_and_models(spark):
    rows = [("m", "血糖 5.5", "ཁྲག་ 5.5"), ("m", "血糖 5.5", "  "), ("m", "x", None), ("n", "血糖 5.5", "ཁྲག་ 5"), ("n", "5 mmol/L", "血 5 mmol")]
    df = spark.createDataFrame(rows, "model string, zh string, bo string")
    got = [[f["check"] for f in r[0]] for r in df.select(invariants.check_candidate(F.col("zh"), F.col("bo"))).collect()]
    assert got == [[], ["EMPTY"], ["EMPTY"], ["B1"], ["A2", "A3", "B4", "B5"]]
    assert {tuple(r) for r in invariants.model_report(df, target="bo", source="zh").collect()} == {("m", 3, 1, 2, 2), ("n", 2, 0, 2, 0)}
    told = df.select(invariants.template_diagnostics(F.col("zh"), F.col("bo"), F.array(F.lit("{a}")), F.array())).collect()
    assert [d["message"] for d in told[0][0]] == ['Placeholder count or order differs. source=["{a}"] target=[]'] and "U+8840" in told[4][0][0]["message"]


NODE = "defineText({bo: fallback('zh')})"


def imports(spark, rows, entries=None, content=NODE * 3):
    """Rows (packet, id, hash, zh, bo) against three entries of one file: a name, and two texts."""
    digest = hashlib.sha256(NODE.encode()).hexdigest()
    made = [(f"e{i}", "f", i * len(NODE), (i + 1) * len(NODE), digest, "name" if i == 0 else None, "k" if i == 0 else None, f"甲 {i}", "x", {"screen": "s"}, "fallback('zh')", i * len(NODE) + 16, i * len(NODE) + 30, True, "reviewed({})", f"甲 {i}", [], False, None) for i in range(3)]
    for i, changes in (entries or {}).items():
        for at, value in changes:
            made[i] = (*made[i][:at], value, *made[i][at + 1 :])
    schema = "id string, file string, start int, end int, source_hash string, field string, key string, zh string, en string, extra map<string,string>, current string, current_start int, current_end int, replaceable boolean, wrap string, zh_literal string, zh_holders array<string>, excluded boolean, existing string"
    given = [(k, p, i, digest if h is None else h, None, z, "x", b, {"screen": "s"}) for k, (p, i, h, z, b) in enumerate(rows)]
    files = spark.createDataFrame([("f", content)], "file string, content string")
    plan = text_import.plan_import(spark.createDataFrame(given, "place int, packet string, id string, source_hash string, key string, zh string, en string, bo string, extra map<string,string>"), spark.createDataFrame(made, schema), files, {"names": True, "floor": False}).cache()
    changed = text_import.apply_edits(files, plan.filter("edit IS NOT NULL").select("file", "edit")).collect()
    return [(r["status"], [d["check"] for d in r["diagnostics"]]) for r in plan.orderBy("place").collect()], changed


def test_import_by_rule(spark):
    good = ("floor", "e1", None, "甲 1", 'ཀ་ "1"')
    got, changed = imports(spark, [good, ("floor", "e2", None, "甲 2", " "), ("odd", "e2", None, "甲 2", "ཀ་ 2")])
    assert got == [("written", []), ("skipped", []), ("refused", ["IDENTITY"])]
    assert changed[0]["problem"] is None and changed[0]["content"] == NODE + "defineText({bo: reviewed(\"ཀ་ \\\"1\\\"\")})" + NODE
    got, _ = imports(spark, [good, good, ("floor", "e9", None, "甲", "ཀ་"), ("floor", "e0", None, "甲 0", "ཀ་ 0"), ("names", "e2", None, "甲 2", "ཀ་ 2")])
    assert got == [("refused", ["IDENTITY"])] * 5
    got, _ = imports(spark, [("floor", "e1", "0" * 64, "甲 1", "ཀ་ 1"), ("floor", "e2", None, "other", "ཀ་ 2"), ("names", "e0", None, "甲 0", "ཀ་")])
    assert got == [("refused", ["B13"]), ("refused", ["PACKET"]), ("refused", ["B1"])]
    one = lambda *changes: imports(spark, [good], {1: changes})[0]
    assert one((13, False)) == [("refused", ["OVERWRITE"])]
    assert one((15, "")) == [("refused", ["EMPTY-SOURCE"])] and one((15, None)) == [("refused", ["SOURCE"])]
    assert one((10, "fallback('en')")) == [("refused", ["AST"])] and one((9, {"screen": "t"})) == [("refused", ["PACKET"])]
    assert one((15, "10秒 1")) == [("refused", ["B1", "DECISION"])]


def test_names_that_two_ids_would_have(spark):
    name = ("names", "e0", None, "甲 0", "ཀ་ 0")
    other = ("names", "e2", None, "甲 0", "ཀ་ 0")
    alike = [(5, "name"), (7, "甲 0"), (15, "甲 0")]
    assert imports(spark, [name, other], {2: alike})[0] == [("refused", ["B12"])] * 2
    assert imports(spark, [name, ("names", "e2", None, "甲 2", "ཀ་ 2")], {2: [(5, "name")]})[0] == [("written", [])] * 2
    assert imports(spark, [name], {2: [(5, "name"), (18, "ཀ་ 0")]})[0] == [("refused", ["B12"])]
    # A text that isn't a name takes none away.
    assert imports(spark, [name], {2: [(18, "ཀ་ 0")]})[0] == [("written", [])]


def test_a_row_with_two_names_that_others_have_is_one_row(spark):
    changes = {0: [(18, "ཁ་")], 1: [(5, "name"), (18, "ཀ་ 0")], 2: [(5, "name"), (18, "ཁ་")]}
    assert imports(spark, [("names", "e0", None, "甲 0", "ཀ་ 0")], changes)[0] == [("refused", ["B12", "B12"])]


def test_what_is_moved_does_not_grow_with_the_ids_of_a_name(spark):
    """Judged rows are as long for many ids of a name as for few; a plan's messages name all others; the query makes none."""
    files = spark.createDataFrame([("f", NODE)], "file string, content string")

    def tables(n):
        both = ["concat('e', id) AS id", "node AS source_hash", "'k' AS key", "'甲' AS zh", "'x' AS en", "map('screen', 's') AS extra"]
        ids = spark.range(n).withColumn("node", F.sha2(F.lit(NODE), 256))
        entry = ["'f' AS file", "0 AS start", f"{len(NODE)} AS end", "'name' AS field", "\"fallback('zh')\" AS current", "16 AS current_start", "30 AS current_end", "true AS replaceable", "'reviewed({})' AS wrap", "'甲' AS zh_literal", "CAST(array() AS array<string>) AS zh_holders", "false AS excluded", "CAST(null AS string) AS existing"]
        return ids.selectExpr("id AS place", "'names' AS packet", *both, "'ཀ་' AS bo"), ids.selectExpr(*both, *entry), files, {"names": True, "floor": False}

    few, many = (text_import.judge_import(*tables(n)).agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.concat("status", F.array_join("checks", ","))).alias("said"), F.max(F.length(F.to_json(F.struct("*")))).alias("long")).first() for n in (2, 2500))
    assert few["said"] == many["said"] == ["refusedB12"] and (few["n"], many["n"]) == (2, 2500) and many["long"] <= few["long"] + 2 * len("2500")
    told = text_import.plan_import(*tables(2500)).select("id", F.size("diagnostics").alias("n"), F.regexp_extract(F.col("diagnostics")[0]["message"], r"\ATibetan reference name collides with (.*)\.\z", 1).alias("ids"))
    each = told.select("id", "n", F.array_distinct(F.split("ids", ", ")).alias("ids")).agg(F.count(F.lit(1)), F.count_if((F.col("n") == 1) & (F.size("ids") == 2499) & ~F.array_contains("ids", F.col("id"))), F.count_if(F.array_sort("ids") == F.col("ids"))).first()
    assert tuple(each) == (2500, 2500, 2500)
    assert "array_remove" not in safety_queries.import_plan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_edits_must_find_what_they_expect(spark):
    files = spark.createDataFrame([("a", "0123456789"), ("b", "0123456789"), ("c", "0123456789")], "file string, content string")
    edits = [("a", (2, 4, "23", "XY", "i")), ("a", (0, 1, "0", "zz", "j")), ("b", (2, 4, "99", "", "k")), ("c", (1, 4, "123", "", "l")), ("c", (3, 5, "34", "", "m")), ("d", (0, 1, "x", "", "n"))]
    df = spark.createDataFrame(edits, f"file string, edit {text_import.EDIT}")
    got = {r["file"]: (r["content"], r["problem"]) for r in text_import.apply_edits(files, df).collect()}
    assert got == {"a": ("zz1XY456789", None), "b": ("0123456789", "k changed between validation and application."), "c": ("0123456789", "Overlapping replacements in c."), "d": (None, "Missing source file d.")}


def test_spans_are_cut_once_as_substr_cuts_them(spark):
    """Entries' spans come without their file's content, and as Spark's substr gives them, past the ends too."""
    text = "a血b😀c" * 3
    spans = [(a, b) for a in (*range(-20, 20, 3), None) for b in (*range(-20, 20, 4), None)]
    files = spark.createDataFrame([("f", text), ("none", None)], "file string, content string")
    entries = spark.createDataFrame([(f, *s, *s) for s in spans for f in ("f", "none", "lost")], "file string, start int, end int, current_start int, current_end int")
    got = {(r["_start"], r["_end"]): (r["_node"], r["_current"]) for r in text_import.spans_of(entries, files).collect()}
    plain = spark.createDataFrame([(text, *s) for s in spans], "t string, a int, b int").select("a", "b", F.substr("t", F.col("a") + 1, F.col("b") - F.col("a")).alias("s"))
    assert got == {(r["a"], r["b"]): (r["s"], r["s"]) for r in plain.collect()}
    assert "content" not in text_import.spans_of(entries, files).columns
