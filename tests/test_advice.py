"""Emergencies and floors under answers."""

import random

from pyspark.sql import functions as F

from rowsense.operators import advice, emergency

CLEAN = ["Keep a regular sleep schedule.", "See a clinician if symptoms persist.", "Choose gentle activity as tolerated.", "Seek care if the problem worsens.", "Stay hydrated and keep notes about your symptoms.", "Talk with a clinician if you remain concerned."]
DOSING = """take ibuprofen 400 mg|黄芪 10 克|drink the decoction three times a day|每日三次服用|take 2 metformin|Take one ibuprofen tablet.|Take one tablet.|Take half a tablet.|Take two metformin.|Use thirteen mg.|The amount is twenty mg.|４００毫克|½ tablet|400​mg|Take 2 antibiotics.|Use a 400-mg dose.|Take ibuprofen q.d.|Take ibuprofen b.i.d.|Take ibuprofen QAM.|每周服用中药。|Take ibuprofen.|服用布洛芬。|Use an antibiotic.|Drink the decoction.|按时服药。|Take medication weekly.|Take fluconazole.|服用氟康唑。|Continue metformin.|继续服用二甲双胍。|Start metformin.|加用二甲双胍。|Take it every morning.|Take it twice weekly.|Take it every 8 hours.|Drink it weekly.|隔天服用。|早晚服用。|Take it every other day.|Take it on alternate days.|The medicine should be taken every other day.|Take it, twice daily.|Drink, three times a day.|每两天服用。|服用，一日两次。|Take it for five days.|Use it for two weeks.|服用五天。|Use a 2% cream.|Apply 1% hydrocortisone.|Use the 0.05 percent ointment.|Take 2 teaspoons.|Use one teaspoon of syrup.|Take two puffs.|Use one scoop.|喝两勺。|The amount is 400 milligrams.|Use five milliliters.|Take ten micrograms.|Use two grams.|Use 400\nmg.|Use 10\n克。|Inject insulin.|Administer aspirin.|Inhale the medicine.|Insert the suppository.|注射胰岛素。|吸入药物。|take 2 clonazepam|Use the antibiotic twice daily""".split("|")
FREE = ["Check your blood pressure twice daily and write down the readings.", "Check your blood pressure every 8 hours and write down the readings.", "", None]
FORM = "id int, question string, texts array<string>, detected boolean, out_of_scope boolean"
LIFE, URGENT = ["emergency-self-harm"], ["emergency"]


def test_floors(spark):
    q = "What general self-care might help?"
    cases = [(q, [*CLEAN[:5], t], False, False, "blocked", [], "dosing") for t in DOSING] + [(q, [*CLEAN, t], False, False, "normal", [], None) for t in FREE]
    bo = "བོད་ take ibuprofen 400 mg"
    cases += [
        ("胸痛", CLEAN, False, False, "banner", URGENT, None), ("chest pain radiating to my arm", CLEAN, None, None, "banner", URGENT, None), (q, CLEAN, True, False, "banner", URGENT, None), (q, [*CLEAN, "This could involve chest pain and needs urgent assessment."], False, False, "banner", URGENT, None),
        (q, [*CLEAN, "A person may want to die."], False, False, "blocked", LIFE, "emergency-only"), (q, [*CLEAN, "This sounds like an overdose."], False, False, "blocked", LIFE, "emergency-only"), ("I want\n   to die", CLEAN, False, True, "blocked", LIFE, "emergency-only"), ("自杀", [bo], True, True, "blocked", LIFE, "emergency-only"),
        (q, [*CLEAN, "བོད་"], False, False, "blocked", [], "tibetan-output"), ("Help with my laptop", CLEAN, False, True, "blocked", [], "out-of-scope"), ("Help with my laptop", [bo], True, True, "blocked", URGENT, "out-of-scope"), (q, [bo], True, False, "blocked", URGENT, "tibetan-output"),
        (q, ["Take ibuprofen 400 mg."], True, False, "blocked", URGENT, "dosing"), ("I have chest pain radiating to my arm.", ["Take ibuprofen 400 mg."], False, False, "blocked", URGENT, "dosing"), (None, None, None, None, "normal", [], None), (q, [], False, False, "normal", [], None), (q, CLEAN, False, False, "normal", [], None),
    ]
    rows = [(i, *c[:4]) for i, c in enumerate(cases)]
    df = spark.createDataFrame([*rows, rows[0], rows[-1]], FORM).withColumn("plain", F.lit("x")).withColumn("_dosing_", F.lit(1))
    got = advice.floors(df).collect()
    assert len(got) == len(rows) + 2
    wrong = [(cases[r["id"]], r["presentation"], r["banners"], r["refused"]) for r in got if (r["presentation"], r["banners"], r["refused"]) != tuple(cases[r["id"]][4:])]
    assert not wrong
    assert advice.floors(df.limit(0)).count() == 0


def test_floors_read_equal_texts_once(spark, monkeypatch):
    given, judged = [], advice.judged
    monkeypatch.setattr(advice, "judged", lambda texts: given.append(texts) or judged(texts))
    rows = [(i, "Take ibuprofen 400 mg." if i % 2 else "How can I sleep?", ["Rest.", f"Drink {i % 3} cups.", None], None, None) for i in range(60)]
    got = advice.floors(spark.createDataFrame(rows, FORM)).collect()
    assert len(got) == 60 and {(r["id"] % 3, r["presentation"]) for r in got} == {(0, "normal"), (1, "normal"), (2, "normal")}
    assert sorted((r["text"], r["own"]) for r in given[0].collect()) == [("", True), *((f"Drink {i} cups.", True) for i in range(3)), ("How can I sleep?", False), ("Rest.", True), ("Take ibuprofen 400 mg.", False)]


def met(text, patterns, english):
    """Whether a text holds a pattern, by plain search."""
    low = text.lower().replace("’", "'").replace("‘", "'")

    def holds(term):
        at = low.find(term)
        while at >= 0:
            ends = (low[at - 1 : at] if at else "", low[at + len(term) : at + len(term) + 1])
            if not english or not any(c.isascii() and c.isalnum() for c in ends):
                return True
            at = low.find(term, at + 1)
        return False

    return any(all(any(holds(t) for t in g.split("|")) for g in p.split("+")) for p in patterns.split(";") if p)


def test_categories_equal_a_plain_search(spark):
    rng = random.Random(8)
    terms = [t for _, _, *of in emergency.CATEGORIES for p in of for g in p.split(";") for x in g.split("+") for t in x.split("|") if t]
    texts = [" ".join(rng.choice([*terms, "strokes", "Heart", "a", "won’t stop bleeding", "STROKE"]) for _ in range(rng.randint(0, 4))) + rng.choice(["", "s", "!"]) for _ in range(300)] + [None, "", "I want\n  to die", "ｓｔｒｏｋｅ"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["id"]: r["c"] for r in df.select("id", emergency.matched(F.col("t")).alias("c")).collect()}
    for i, t in enumerate(texts):
        shown = {"I want\n  to die": "I want to die", "ｓｔｒｏｋｅ": "stroke"}.get(t, t or "")
        assert got[i] == [name for name, _, zh, en in emergency.CATEGORIES if met(shown, zh, False) or met(shown, en, True)], t
    assert emergency.suppressing() == ["self-harm", "overdose-poisoning"]


def test_a_text_at_a_time_becomes_a_string(spark):
    """Terms are looked for in Arrow values, not in a batch of Python strings; null and empty texts have none."""
    from pyspark.util import PythonEvalType

    df = spark.createDataFrame([(1, "I have chest pain"), (2, None), (3, ""), (4, "想死")], "id int, text string")
    found = df.select("id", emergency.matched(F.col("text")).alias("c"))
    assert f"], {PythonEvalType.SQL_SCALAR_ARROW_UDF}" in found._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["c"] for r in found.collect()} == {1: ["cardiac"], 2: [], 3: [], 4: ["self-harm"]}
