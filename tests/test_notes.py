"""Entities of clauses against plain searches, and verdicts on segments."""

import random
import re

from pyspark.sql import functions as F

from rowsense.functions import lexicon as words
from rowsense.functions.lexicon import Lexicon
from rowsense.operators import clause_entities, entities, fidelity, notes, reconcile, segments

#: source, translation, action, flags that must be there.
CASES = [
    ("胸片未见明显占位性病变。", "Chest X-ray shows a space-occupying lesion.", 1, ["R7-NEGATION-POLARITY-MISMATCH", "R9-HIGH-RISK-PAIR"]),
    ("活检提示恶性肿瘤细胞。", "Biopsy shows no malignant tumor cells.", 2, ["R7-NEGATION-POLARITY-MISMATCH", "R9-HIGH-RISK-PAIR"]),
    ("不能排除转移可能。", "Metastasis is excluded.", 2, ["R7-HEDGE-STRENGTH-WEAKENED", "R7-NEGATION-POLARITY-MISMATCH"]),
    ("Cannot exclude early interstitial lung disease.", "无间质性肺病证据。", 2, ["R7-HEDGE-STRENGTH-WEAKENED"]),
    ("二甲双胍 850mg 每日两次。", "Metformin 1000 mg twice daily.", 1, ["R8-DOSE-NOT-PRESERVED"]),
    ("Levothyroxine 50 mcg once daily.", "左甲状腺素 50 毫克 每日一次。", 2, ["R8-DOSE-UNIT-DIMENSION-MISMATCH"]),
    ("泼尼松 5mg 每日三次。", "Prednisone 5 mg.", 1, ["R8-DOSE-FREQUENCY-DROPPED"]),
    ("布洛芬 1-2片 需要时服用。", "Ibuprofen 2 tablets as needed.", 1, ["R8-DOSE-RANGE-INCOMPLETE"]),
    ("地高辛 0.125 mg 每日一次。", "Digoxin 0.25 mg once daily.", 2, ["R8-DOSE-NOT-PRESERVED", "R8-DOSE-MAGNITUDE-DIVERGENCE"]),
    ("随访血压记录为 148/92 mmHg。", "Follow-up blood pressure recorded as 184/92 mmHg.", 1, ["R8-NUMBER-NOT-PRESERVED"]),
    ("继续服用氯硝西泮。", "Continue clonidine.", 2, ["R9-DRUG-SUBSTITUTED"]),
    ("琥珀酸美托洛尔缓释片 47.5mg 每日一次。", "Metoprolol 47.5 mg once daily.", 1, ["R9-DRUG-QUALIFIER-DROPPED"]),
    ("服用 恩美曲妥珠单抗 治疗。", "Take trastuzumab.", 2, ["R9-UNKNOWN-DRUG-ALTERED"]),
    ("未见肝内占位。", "Intrahepatic mass.", 2, ["R7-NEGATION-SCOPE-BROKEN"]),
    ("见结节，未见钙化。", "No nodule seen; calcification present.", 1, ["R7-NEGATION-RETARGETED"]),
    ("乙肝表面抗原 阳性。", "Hepatitis B surface antigen negative.", 2, ["R9-RESULT-POLARITY-FLIP"]),
    ("阿莫西林 500 毫克 每日三次。", "Amoxicillin 500 mg three times daily.", 0, None),
    ("处方：▮▮▮ 0.█ mg ▮▮ 每日", "Prescription: medication 0.5 mg twice daily.", 2, ["R8-DOSE-SOURCE-UNPARSEABLE"]),
    ("不能排除转移可能。", "不能排除转移的可能性。", 0, []),
    ("已排除转移。", "Metastasis has been ruled out.", 0, []),
    ("请多喝水，注意休息。", "Please drink more water and rest.", 0, None),
    ("未见积液", "Effusion present.", 1, ["R7-NEGATION-POLARITY-MISMATCH"]),
    ("可见气胸", "No pneumothorax.", 2, ["R7-NEGATION-POLARITY-MISMATCH"]),
    ("未见积液", "No effusion.", 0, None),
    ("Continue warfarin.", "Continue heparin.", 2, ["R9-DRUG-SUBSTITUTED"]),
    ("继续服用二甲双胍。", "Continue your medication.", 2, ["R9-DRUG-SUBSTITUTED"]),
    ("继续服用二甲双胍。", "Continue metformin.", 0, None),
    ("Take 5 mg.", "服用 5-10 毫克。", 0, None),
    ("3 of them", "3-5 mg", 0, None),
    ("1,000 steps", "1000 steps", 0, None),
    ("琥珀酸 x metoprolol", "metoprolol", 1, ["R9-DRUG-QUALIFIER-DROPPED"]),
    ("5？？ 每日", "5 daily", 2, ["R8-DOSE-SOURCE-UNPARSEABLE"]),
]


def test_verdicts_of_segments(spark):
    rows = [(i, a, b) for i, (a, b, _, _) in enumerate(CASES)] + [(900, None, None), (901, "", None), (0, *CASES[0][:2])]
    df = spark.createDataFrame(rows, "id int, source string, output string").withColumn("ours", F.lit("x")).withColumn("pair", F.lit(1))
    got = segments.segment_verdicts(df).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() >= {"id", "ours", "pair", "action", "flags", "preserved"}
    for r in got:
        if r["id"] >= 900:
            assert r["action"] == 0 and r["flags"] == []
            continue
        a, b, action, flags = CASES[r["id"]]
        assert r["action"] == action, (a, b, r)
        assert r["flags"] == [] if flags is None else set(flags) <= set(r["flags"]) and (flags or "R7-HEDGE-STRENGTH-WEAKENED" not in r["flags"]), (a, b, r)
        assert (r["preserved"] == []) if action == 2 else True
    assert {x["key"] for r in got if r["id"] == 16 for x in r["preserved"]} >= {"dose:500:mg", "drug:amoxicillin"}


def plain_hits(low, lang, needles, edges):
    """Entries longest first, each by repeated find, with the places that were taken."""
    word = lambda i: 0 <= i < len(low) and re.match("[a-z0-9]", low[i])
    taken, out = set(), []
    for needle, entry in sorted(needles, key=lambda x: -len(x[0])):
        at = low.find(needle)
        while at >= 0:
            end = at + len(needle)
            span = set(range(at, end))
            inner = [i for i in range(at, end) if word(i)] if edges else [at, end - 1]
            if not span & taken and not (lang == "en" and inner and (word(inner[0] - 1) or word(inner[-1] + 1))):
                taken |= span
                out.append((at, end, entry))
            at = low.find(needle, end)
    return out


def test_entities_equal_a_plain_scan(spark):
    rng, lex = random.Random(6), Lexicon()
    bits = {"en": ["no", "no evidence of", "non-", "cannot rule out", "r/o", "mass", "nodule", "aspirin", "Lipitor", "simvastatin", "spine", "take", "5 mg", "1,000 mg", "2-3 tablets", "BID", "pobid", "7", "1.2.3", "３ mg", "stop", "do not stop", "hold", "household", "this pill", "nothing", "x", "half"],
            "zh": ["未见", "未见明显", "不能除外", "待排", "占位", "结节", "无", "阿司匹林", "氟伐他汀", "服用", "停用", "继续", "观察", "降压药", "5毫克", "半片", "十二片", "每日两次", "3", "天", "停经", "暂停", "的"]}
    texts = []
    for i in range(300):
        lang = rng.choice(["en", "zh"])
        joint = " " if lang == "en" else ""
        texts.append((i, joint.join(rng.choice(bits[lang]) + rng.choice(["", "", "", ".", ",", "。", " and "]) for _ in range(rng.randint(1, 9)))))
    texts += [(300, None), (301, ""), (302, " \n "), (303, "no " * 3000), (0, texts[0][1])]
    df = spark.createDataFrame(texts, "id int, text string").withColumn("start_of", F.lit(1))
    got = clause_entities.clause_entities(df).collect()
    clauses = df.select("id", entities.language(F.coalesce("text", F.lit(""))).alias("lang"), F.posexplode(entities.clauses(F.coalesce("text", F.lit(""))))).collect()
    expected = []
    for r in clauses:
        lang, clause = r["lang"], r["col"]
        low = clause.lower() if lang == "en" else clause
        for a, b, m in plain_hits(low, lang, [((m[0].lower() if lang == "en" else m[0]), m) for m in lex.markers if m[1] == lang], True):
            finding = (clause[:a] if m[4] else clause[b:]).strip(clause_entities.STRIP)
            expected.append((r["id"], r["pos"], "negation", clause[a:b], a, finding, m[2]))
        seen = set()
        for a, b, drug in plain_hits(low, lang, [(f.lower() if lang == "en" else f, d) for f, d in lex.drugs], False):
            if drug not in seen:
                seen.add(drug)
                expected.append((r["id"], r["pos"], "drug", clause[a:b], a, drug, None))
    mine = [(r["id"], r["clause"], r["type"], r["raw"], r["start"], r["finding"] if r["type"] == "negation" else r["drug"], r["polarity"]) for r in got if r["type"] == "negation" or r["type"] == "drug" and r["drug"]]
    key = lambda x: tuple(map(str, x))
    assert sorted(mine, key=key) == sorted(expected, key=key)
    ids = {r["id"] for r in got}
    assert not ids & {300, 301, 302} and sum(r["id"] == 303 for r in got) == 3000


def found(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    out = [[] for _ in texts]
    for r in sorted(clause_entities.clause_entities(rows).collect(), key=lambda r: (r["id"], r["clause"], r["place"])):
        out[r["id"]].append(r)
    return out


def test_unknown_drugs_need_a_medical_clause(spark):
    got = found(spark, "the lower spine hurts", "take simvastatin", "simvastatin 5 mg", "服用氟伐他汀", "氟伐他汀", "口服阿托伐他汀", "do not stop aspirin", "1,000 and 1.2.3 or ３")
    drugs = [[(r["raw"], r["drug"]) for r in g if r["type"] == "drug"] for g in got]
    assert drugs == [[], [("simvastatin", None)], [("simvastatin", None)], [("氟伐他汀", None)], [], [("阿托伐他汀", "atorvastatin")], [("aspirin", "aspirin")], []]
    assert [(r["kind"], r["drug"]) for r in got[6] if r["type"] == "imperative"] == [("continue", "aspirin")]
    assert [r["amount"] for r in got[7] if r["type"] == "number"] == ["1000", "1.2", "3"]
    assert [r["immutable_key"] for r in got[2]] == ["dose:5:mg", "drug:?:simvastatin"]


def test_forms_are_built_from_names():
    forms = dict(words.drug_forms(words.DRUGS))
    assert forms["er jia shuang gua"] == forms["glucophage"] == forms["二甲双胍"] == "metformin" and len(words.listed(words.FREQUENCIES[0])) == 1
    assert len(Lexicon().markers) == 60 and Lexicon().units["µg"] == "mcg"


def test_what_the_reviews_of_round_two_found(spark):
    texts = spark.createDataFrame([("5？？ daily",), ("take ?? 5",), ("box □ 5 mg",), ("why??",), ("dose ??",), (None,)], "t string")
    assert [r[0] for r in texts.select(notes.corrupted_dose(F.col("t"))).collect()] == [True, True, False, False, True, False]
    d = spark.createDataFrame([("３ mg",), ("1,000 or 1.2.3, 5 mg",)], "t string").withColumn("d", notes.doses(F.col("t"), {"mg": "mg"}))
    assert [[x["raw"] for x in r["d"]] for r in d.collect()] == [[], ["5 mg"]]
    assert [r[0] for r in d.select(notes.bare_numbers(F.col("t"), F.col("d"))).collect()] == [[], ["1000", "1.2", "3"]]
    dose = "array<struct<amount:string,upper:string,dimension:string>>"
    ranges = spark.createDataFrame([([("5", None, "mg")], [("5", "10", "mg")]), ([("7", None, "mg")], [("5", "10", "mg")])], f"s {dose}, o {dose}")
    none = F.lit(None).cast("string")
    assert [[h["id"] for h in r[0]] for r in ranges.select(fidelity.dose_hits(F.col("s"), F.col("o"), none, none)).collect()] == [[], [fidelity.NOT_PRESERVED]]


def test_verdicts_of_reviewers_keep_types(spark):
    cases = spark.createDataFrame([(1, "g", True, False, "ambiguous", "x"), (2, "g", True, True, "ambiguous", "x"), (3, "g", False, True, None, "x"), (4, "g", True, True, "ocr", "x")], "id int, gold string, should_abstain boolean, high_stakes boolean, reason string, own string")
    said = spark.createDataFrame([(1, " new ", "FALSE", "", "ocr"), (2, " ", "", " True", "nonsense"), (4, None, None, None, " ambiguous ")], "id int, gold string, should_abstain string, high_stakes string, reason string")
    got = reconcile.merge_verdicts(cases, said, "id", ["gold"], ["should_abstain", "high_stakes"], "reason", ["ambiguous", "ocr"], "should_abstain")
    assert got.schema["should_abstain"].dataType.simpleString() == "boolean" and got.columns == cases.columns
    assert sorted(map(tuple, got.collect())) == [(1, " new ", False, False, None, "x"), (2, "g", True, True, "ambiguous", "x"), (3, "g", False, True, None, "x"), (4, "g", True, True, "ambiguous", "x")]


def test_entities_of_clauses_come_in_batches(spark, monkeypatch):
    """Entities travel by batches with their text's columns, not clause by clause through a table function."""
    monkeypatch.setattr(clause_entities, "ROWS", 3)
    df = spark.createDataFrame([(i, None if i % 5 == 0 else "no mass, take aspirin 5 mg. Stop warfarin" if i % 2 else "fine") for i in range(40)], "id long, text string").coalesce(1)
    found = clause_entities.clause_entities(df)
    assert "PythonUDTF" not in found._jdf.queryExecution().toString()
    got = found.select("id", "clause", "place", "type", "raw").collect()
    assert {r["id"] for r in got} == {i for i in range(40) if i % 5 and i % 2}
    assert sorted((r["clause"], r["type"], r["raw"]) for r in got if r["id"] == 1) == sorted((r["clause"], r["type"], r["raw"]) for r in got if r["id"] == 39)
    assert ("drug", "aspirin") in {(r["type"], r["raw"]) for r in got} and ("imperative", "Stop") in {(r["type"], r["raw"]) for r in got}
