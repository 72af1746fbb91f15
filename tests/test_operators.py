"""Operators that no SQL covers, on small rows."""

import hashlib
import hmac
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from rowsense.functions import text
from rowsense.operators import evaluation, fidelity, geometry, lookup, notes, quality, rules, wellformed


def test_negations_use_the_longest_markers_first(spark):
    markers = [("no", "en", "negated", "firm", False), ("no evidence of", "en", "negated", "weak", False), ("未见", "zh", "negated", "firm", False), ("待排", "zh", "uncertain", "weak", True)]
    rows = [("No evidence of fever, none", "en"), ("nothing known", "en"), ("未见 骨折", "zh"), ("肺炎待排", "zh"), (None, "en")]
    got = spark.createDataFrame(rows, "c string, lang string").select(notes.negations(F.col("c"), F.col("lang"), markers).alias("x")).collect()
    assert [[(n["raw"], n["finding"], n["polarity"]) for n in r["x"]] for r in got] == [[("No evidence of", "fever, none", "negated")], [], [("未见", "骨折", "negated")], [("待排", "肺炎", "uncertain")], []]
    counted = spark.createDataFrame(rows, "c string, lang string").select(notes.polarity_buckets(notes.negations(F.col("c"), F.col("lang"), markers)).alias("b")).collect()
    assert [(r["b"]["negated"], r["b"]["uncertain"]) for r in counted] == [(1, 0), (0, 0), (1, 0), (0, 1), (0, 0)]


def test_doses_numbers_and_frequencies(spark):
    units = {"mg": "mg", "片": "tablet", "mL": "mL", "ml": "mL"}
    rows = [("take 1,000 mg BID", "en"), ("每日两次 十二片", "zh"), ("2-3 ml and 7", "en"), ("半片", "zh"), ("", "en"), (None, "zh")]
    df = spark.createDataFrame(rows, "c string, lang string").withColumn("d", notes.doses(F.col("c"), units))
    got = df.select("d", notes.bare_numbers(F.col("c"), F.col("d")).alias("n"), notes.frequency(F.col("c"), F.col("lang"), ["BID", "每日", "每日两次"]).alias("f")).collect()
    assert [[(x["amount"], x["upper"], x["dimension"]) for x in r["d"]] for r in got] == [[("1000", None, "mg")], [("12", None, "tablet")], [("2", "3", "mL")], [("0.5", None, "tablet")], [], []]
    assert [r["n"] for r in got] == [[], [], ["7"], [], [], []] and [r["f"] for r in got] == ["BID", "每日两次", None, None, None, None]


def test_drugs_survival_and_coverage(spark):
    forms = [("aspirin", "a"), ("aspirin plus", "b"), ("阿司匹林", "a")]
    df = spark.createDataFrame([("Aspirin Plus daily", "en"), ("aspirins", "en"), ("服阿司匹林", "zh")], "c string, lang string")
    assert [r[0] for r in df.select(notes.known_drugs(F.col("c"), F.col("lang"), forms)).collect()] == [["b"], [], ["a"]]
    items = spark.createDataFrame([(1, "number", "12"), (1, "number", "2"), (1, "drug", "Aspirin"), (2, "drug", "x")], "id int, kind string, value string")
    texts = spark.createDataFrame([(1, "take 12 of aspirin")], "id int, text string")
    assert {tuple(r) for r in notes.matched_by_kind(items, texts).collect()} == {("number", 1, 2), ("drug", 1, 2)}
    near = spark.range(1).select(notes.nearest(F.lit(10), F.array(*(F.struct(F.lit(a).alias("at"), F.lit(i).alias("id")) for a, i in ((2, "x"), (12, "y"), (8, "z"))))))
    assert near.first()[0] == "z"
    shown = spark.createDataFrame([("a", "all normal"), ("b", "see report")], "id string, chip string")
    assert [tuple(r) for r in notes.leaks(shown, ["chip"], ["(?i)normal", "fine"]).collect()] == [("a", "all normal", "chip", "(?i)normal")]


def test_image_quality_against_loops(spark):
    rng = np.random.default_rng(1)
    images = [(w, h, rng.integers(0, 256, w * h).astype(float).tolist()) for w, h in ((3, 3), (5, 4), (2, 9), (8, 8))] + [(0, 0, [])]

    def blur(w, h, p):
        v = [p[(y - 1) * w + x] + p[(y + 1) * w + x] + p[y * w + x - 1] + p[y * w + x + 1] - 4 * p[y * w + x] for y in range(1, h - 1) for x in range(1, w - 1)]
        return sum((x - sum(v) / len(v)) ** 2 for x in v) / len(v) if v and w > 2 and h > 2 else 0

    got = quality.assess(spark.createDataFrame(images, "width int, height int, pixels array<double>")).collect()
    assert np.allclose([r["blur"] for r in got], [blur(*i) for i in images]) and got[-1]["ink"] == 0 and got[-1]["reasons"] == ["blurry", "no-text-found"]


def test_identifiers_and_forms(spark):
    df = spark.createDataFrame([("user@1",), ("é",), (None,)], "x string")
    assert [r[0] for r in df.select(text.pseudonym(F.col("x"), b"key", "p:")).collect()] == ["p:" + hmac.new(b"key", x.encode(), hashlib.sha256).hexdigest() for x in ("user@1", "é")] + [None]
    odd = " é​ １⁄２  x "
    r = spark.createDataFrame([(odd,), (None,)], "x string").select(text.composed("x").alias("c"), text.plain(F.col("x")).alias("p")).collect()
    assert r[0]["c"] == unicodedata.normalize("NFC", odd).strip() and r[0]["p"] == "é 1/2 x" and r[1]["c"] is None and r[1]["p"] is None


def test_bilingual_pairs_must_agree(spark):
    dim = spark.createDataFrame([("na", ["钠", "Na"], "blood", 1), ("k", ["钾", "K"], "blood", 2), ("ca", ["钙", "Ca"], "blood", 3)], "key string, names array<string>, specimen string, ord int").withColumn("scoped_names", F.expr("cast(array() as array<string>)"))
    facts = spark.createDataFrame([("钠 Na", None), ("钠 K", None), ("钾 XX", "blood"), ("钙 Ca", None), ("血清钾（尿）", None), ("钾测定", "urine"), (None, None)], "name string, specimen string")
    got = {r["name"]: r["key"] for r in lookup.lookup_cascade(facts, dim).collect()}
    assert got == {"钠 Na": "na", "钠 K": None, "钾 XX": "k", "钙 Ca": None, "血清钾（尿）": None, "钾测定": None, None: None}
    assert lookup.lookup_cascade(facts.limit(0), dim).count() == 0


def test_cross_row_flags_mark_the_rows(spark):
    rows = spark.createDataFrame([("r", 1, "total", 10.0, False), ("r", 2, "direct", 20.0, False), ("r", 3, "indirect", 1.0, True), ("q", 1, "total", 10.0, False), ("q", 2, "direct", 4.0, False), ("q", 3, "indirect", 6.0, False)], "report_id string, ord int, part string, value double, abstained boolean")
    rows = rows.withColumn("flags", F.expr("cast(array() as array<struct<id:string,severity:int>>)")).withColumn("needs_confirm", F.lit(False))
    got = {(r["report_id"], r["ord"]): (len(r["flags"]), r["needs_confirm"]) for r in rules.cross_row_flags(rows).collect()}
    assert got == {("r", 1): (1, True), ("r", 2): (1, True), ("r", 3): (0, False), **{("q", i): (0, False) for i in (1, 2, 3)}}


def test_claims_use_each_printed_text_once(spark):
    cells = spark.createDataFrame([(1, i, x, y, 50.0, 20.0, t) for i, (x, y, t) in enumerate([(0.0, 0.0, "Na"), (100.0, 0.0, "5"), (0.0, 30.0, "K"), (100.0, 30.0, "7"), (0.0, 60.0, "Ca"), (100.0, 60.0, "9")])], "page_id long, cell_id long, x double, y double, width double, height double, text string")
    claims = spark.createDataFrame([(1, 0, "Na", "5", None, None), (1, 1, "K", "5", None, None), (1, 2, "Ca", "7", None, None), (2, 0, "x", None, None, None)], "page_id long, ord long, name string, value string, unit string, printed_range string")
    got = sorted(tuple(r) for r in geometry.verify_rows(claims, cells).collect())
    assert (1, 1, "value", "reused-cell") in got and (2, 0, None, "unverifiable") in got and len(got) >= 2


def test_evaluation_gates(spark):
    cases = spark.createDataFrame([(1, True, True), (2, False, False), (3, True, False)], "id int, should_abstain boolean, high_stakes boolean")
    results = spark.createDataFrame([(1, False), (2, True)], "id int, abstained boolean")
    errors = evaluation.error_list(cases, results)
    assert {(r["id"], r["why"]) for r in errors.collect()} == {(1, "missed"), (2, "over-abstained"), (3, "absent")}
    none = spark.createDataFrame([], "test_type string, passed boolean")
    assert evaluation.release_blocked(errors, none).first()[0] and not evaluation.release_blocked(errors.limit(0), none).first()[0]
    texts = spark.createDataFrame([("t", "bo", None, "zh", False), ("t", "zh", None, "en", True), ("t", "en", "Hi", None, True), ("u", "bo", None, "zh", True), ("u", "zh", None, "bo", True)], "id string, lang string, text string, fallback string, verified boolean")
    assert {(r["id"], r["lang"]): (r["text"], r["verified"]) for r in evaluation.resolved_texts(texts).collect()} == {("t", "bo"): ("Hi", False), ("t", "zh"): ("Hi", False), ("t", "en"): ("Hi", True), ("u", "bo"): (None, False), ("u", "zh"): (None, False)}
    shown = spark.range(1).select(evaluation.range_text(F.lit(1.5), F.lit(2.0), F.lit("u")), evaluation.range_text(F.lit(None).cast("double"), F.lit(2.0), F.lit(None).cast("string"), F.lit(True)), evaluation.range_text(F.lit(3.0), F.lit(2.0), F.lit("u"))).first()
    assert tuple(shown) == ("1.5–2 u", "< 2", "")


def test_fidelity_of_a_second_version(spark):
    dose = "array<struct<amount:string,upper:string,dimension:string>>"
    rows = [([("5", None, "m")], [("5", None, "m")], []), ([("5", "10", "m")], [("5", None, "m")], [fidelity.RANGE_INCOMPLETE]), ([("5", "10", "m")], [("5", "10", "m")], []), ([("5", None, "m")], [], [fidelity.NOT_PRESERVED]), ([("5", None, "m")], [("5", None, "v")], [fidelity.UNIT_MISMATCH]), ([("5", None, "m")], [("50", None, "m")], [fidelity.NOT_PRESERVED, fidelity.MAGNITUDE]), ([("5", None, "m")], [("6", "7", "m")], [fidelity.NOT_PRESERVED]), ([("0", None, "m")], [("7", None, "m")], [fidelity.NOT_PRESERVED]), ([], [("7", None, "m")], []), (None, None, [])]
    none = F.lit(None).cast("string")
    got = spark.createDataFrame(rows, f"s {dose}, o {dose}, want array<string>").select("want", fidelity.verdict(fidelity.dose_hits(F.col("s"), F.col("o"), none, none), F.col("s")).alias("v")).collect()
    assert all(r["v"]["flags"] == r["want"] for r in got) and [r["v"]["action"] for r in got] == [0, 1, 0, 1, 2, 2, 1, 1, 0, 0]
    assert got[4]["v"]["preserved"] == [] and len(got[0]["v"]["preserved"]) == 1
    drugs = spark.createDataFrame([(["a"], ["a"], None, "A SR", "A"), (["a"], [], None, "A", ""), ([], ["b"], ["Zzz"], "Zzz", "B"), ([], [], ["Zzz"], "Zzz", None), (None, None, None, None, None)], "s array<string>, o array<string>, u array<string>, st string, ot string")
    got = [[h["id"] for h in r[0]] for r in drugs.select(fidelity.drug_hits(F.col("s"), F.col("o"), F.col("u"), F.lit(None), F.col("st"), F.col("ot"), [{"en": ["sr"], "zh": ["缓释"]}])).collect()]
    assert got == [[fidelity.QUALIFIER_DROPPED], [fidelity.DRUG_LOST], [fidelity.UNKNOWN_ALTERED], [], []]
    order = "array<struct<drug:string,kind:string,direction:string>>"
    cases = [([], [("a", "hold", None)], False), ([("a", "hold", None)], [("b", "hold", None)], False), ([("a", "hold", None), ("b", "continue", None)], [("a", "continue", None), ("b", "hold", None)], True), ([("a", "dose-change", None)], [("a", "dose-change", None)], True), ([("a", "hold", None)], [], True), ([("a", "dose-change", "up")], [("a", "dose-change", "up")], False)]
    got = spark.createDataFrame(cases, f"s {order}, o {order}, want boolean").select("want", fidelity.directives_differ(F.col("s"), F.col("o")).alias("d")).collect()
    assert all(r["want"] == r["d"] for r in got)
    lost = spark.createDataFrame([(["1", "2"], ["1"], [("2", None, "m")]), (["1"], None, None), (None, None, None)], f"s array<string>, o array<string>, d {dose}")
    assert [len(r[0]) for r in lost.select(fidelity.number_hits(F.col("s"), F.col("o"), F.col("d"))).collect()] == [0, 1, 0]
    shown = spark.range(1).select(fidelity.canonical_finding(F.lit("No Mass seen"), [("nodule", ["nodul"]), ("mass", ["mass", "占位"])]), fidelity.age_label(F.lit(40)), fidelity.age_label(F.lit(41)), fidelity.age_label(F.lit(None).cast("int"))).first()
    assert tuple(shown) == ("mass", "18–64 (submitted age-band value: 40)", "41", "not provided")


def test_columns_that_fit_no_shift_refuse_the_page(spark):
    at = lambda page, ys: [(page, i, x, float(y), 50.0, 20.0, "t") for i, (x, y) in enumerate(ys)]
    shifted = at(1, [(0.0, 0), (0.0, 30), (0.0, 60), (100.0, 30), (100.0, 60), (100.0, 90)])
    drifting = at(2, [(0.0, 0), (0.0, 30), (100.0, 0), (100.0, 60)])
    two = at(3, [(0.0, 0), (100.0, 0), (100.0, 3)])
    flat = [(4, 0, 0.0, 0.0, 50.0, 0.0, "t")]
    cells = spark.createDataFrame(shifted + drifting + two + flat, "page_id long, cell_id long, x double, y double, width double, height double, text string")
    got = {p: [(r["anchor"], r["refused"]) for r in sorted(geometry.bind_cells(cells).collect(), key=lambda r: r["cell_id"]) if r["page_id"] == p] for p in (1, 2, 3, 4)}
    assert got[1] == [(0, False), (1, False), (2, False)] * 2 and got[2] == [(None, True)] * 4
    assert got[3] == [(0, False), (0, False), (None, False)] and got[4] == [(None, True)]
    assert geometry.bind_cells(cells.limit(0)).count() == 0


def test_well_formed_texts(spark):
    texts = ["\u0f42\u0f0b", None, "\U0001f600\u200b", "\u0f77", "\u0f42 \u0f44", "\u0f42\u0f0b\u0f0b", "a\n\u0f0b", "\u8840 5"]
    got = [[tuple(f) for f in r[0]] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(wellformed.findings(F.col("t"))).collect()]
    assert got[:3] == [[], [("A1", None, None)], [("A3", 0, 0x1F600), ("A3", 2, 0x200B), ("A9", 2, 0x200B)]]
    assert got[3][0] == ("A5", 0, 0x0F77) and [[f[0] for f in x] for x in got[4:]] == [["A7"], ["A7"], ["A3"], ["A2", "A3"]]


def test_directives_by_marker_negation_and_scope(spark):
    markers = [("stop", "en", "hold", None, False), ("keep taking", "en", "continue", None, False), ("halve", "en", "dose-change", "down", False), ("暂停", "zh", "hold", None, True), ("停", "zh", "hold", None, True)]
    a, b = ("aspirin", "a"), ("warfarin", "b")
    cases = [("stop aspirin today, keep taking warfarin", "en", [a, b], [("stop", "hold", None, "a"), ("keep taking", "continue", None, "b")]), ("never stop aspirin", "en", [a], [("stop", "continue", None, "a")]), ("whenever stop", "en", [], [("stop", "hold", None, None)]), ("暂停期间服药", "zh", [("药", "c")], [("停期间服药", "hold", None, "c")]), ("暂停期间", "zh", [("药", "c")], []), ("不要停药", "zh", [("药", "c")], [("停", "continue", None, "c")]), ("停他汀类药物", "zh", [], [("停他汀类药", "hold", None, None)]), ("nonstop", "en", [a], []), (None, "en", None, [])]
    got = spark.createDataFrame([c[:3] for c in cases], f"c string, lang string, d {notes.NAMED}").select(notes.directives(F.col("c"), F.col("lang"), F.col("d"), markers, [("never", "en"), ("不要", "zh")], ["观察"], [])).collect()
    assert [sorted((d["raw"], d["kind"], d["direction"], d["drug"]) for d in r[0]) for r in got] == [sorted(c[3], key=str) for c in cases]


def test_negations_of_two_versions(spark):
    one = "array<struct<raw:string,finding:string,polarity:string,strength:string>>"
    neg = lambda finding, polarity="absent": ("x", finding, polarity, "firm")
    cases = [([neg("mass")], [neg("mass")], "no mass", "no mass", []), ([neg("mass", "uncertain")], [neg("mass")], "mass?", "no mass", [1]), ([], [neg("tumour")], "tumour", "no tumour", [2]), ([neg("clot")], [], "no clot", "clot", [1]), ([], [neg("clot")], "clot", "no clot", [2]), ([neg("mass")], [neg(None)], "no mass", "mass: none", []), (None, None, None, None, [])]
    known = [("mass", {"en": ["mass"]}, False), ("tumour", {"en": ["tumour"]}, True)]
    got = spark.createDataFrame([c[:4] for c in cases], f"a {one}, b {one}, s string, t string").select(fidelity.negation_hits(F.col("a"), F.col("b"), F.col("s"), F.col("t"), F.lit("en"), F.lit("en"), known, {}, {}, {})).collect()
    assert [[h["action"] for h in r[0]] for r in got] == [c[4] for c in cases]


def test_pages_side_by_side_equal_pages_alone(spark):
    """Pages of different sizes in one batch: shifts as a plain search finds them, and claims without a frame a page."""
    rng = np.random.default_rng(6)
    for n, m in ((1, 1), (3, 5), (12, 9)):
        own, rows = rng.integers(0, 60, (20, n)) * 2.5, rng.integers(0, 60, (20, m)) * 2.5
        shift, fits = geometry._offsets(own, rows, np.full(20, 5.0))
        for q in range(20):
            tried = dict.fromkeys([0.0, *(own[q][:, None] - rows[q]).ravel().tolist()])
            met = {d: geometry._met(np.abs(own[q][:, None] - d - rows[q]), 5.0) for d in tried}
            best = min(tried, key=lambda d: (-met[d][0], met[d][1], abs(d)))
            assert (shift[q], fits[q]) == (best, met[best][0] >= min(n, m) and met[best][1] <= 5.0)
    cells = [(p, 3 * r + c, 120.0 * c, 30.0 * r + 4 * c, 80.0, 20.0, ["name", str(r), "mg"][c]) for p in range(300) for r in range(p % 7 + 1) for c in range(3)]
    df = spark.createDataFrame(cells, "page_id long, cell_id long, x double, y double, width double, height double, text string").repartition(2)
    got = {(r["page_id"], r["cell_id"]): (r["column"], r["anchor"], r["refused"]) for r in geometry.bind_cells(df).collect()}
    assert got == {(p, i): (i % 3, i - i % 3, False) for p, i, *_ in cells}
    found = {r["page_id"]: (r["columns"], r["aligned_rows"], r["reason"]) for r in geometry.table_structure(df).collect()}
    assert found == {p: (3, p % 7 + 1, "few rows" if p % 7 < 2 else "") for p in range(300)}
    claims = df.select("page_id", (F.col("cell_id") / 3).cast("long").alias("ord"), "text").filter("cell_id % 3 = 1").select("page_id", "ord", F.lit("name").alias("name"), F.when(F.col("ord") == 4, "x").otherwise(F.col("text")).alias("value"), F.lit("mg").alias("unit"), F.lit(None).cast("string").alias("printed_range"))
    claims = claims.unionByName(claims.limit(1).withColumn("page_id", F.lit(-1).cast("long")).withColumn("ord", F.lit(0).cast("long")))
    plan = geometry.verify_rows(claims, df)
    assert "Pandas" not in plan._jdf.queryExecution().toString()
    assert sorted(map(tuple, plan.collect()), key=str) == sorted([(-1, 0, None, "unverifiable"), *((p, 4, "value", "not-on-page") for p in range(300) if p % 7 > 3)], key=str)


def test_images_of_several_shapes_in_one_batch(spark):
    """Each shape is one array; an image is measured as it is alone."""
    rng = np.random.default_rng(8)
    shapes = [(0, 0), (2, 9), (3, 3), (8, 8), (5, 4)]
    images = [(i, *shapes[i % 5], rng.integers(0, 256, shapes[i % 5][0] * shapes[i % 5][1]).astype(float)) for i in range(60)]
    df = spark.createDataFrame([(i, w, h, p.tolist()) for i, w, h, p in images], "id int, width int, height int, pixels array<double>").coalesce(1)
    got = {r["id"]: (r["blur"], r["ink"]) for r in quality.assess(df).collect()}
    for i, w, h, p in images:
        alone = (float(quality._stencil_variances(p[None], w, h)[0]), float(quality._inks(p[None])[0]))
        assert np.allclose(got[i], alone)
        if len(p):
            tones = np.bincount(p.astype(int), minlength=256)
            paper = next(t for t in range(256) if tones[: t + 1].sum() >= 0.95 * len(p))
            assert got[i][1] == sum(x < paper * 0.75 for x in p) / len(p)
