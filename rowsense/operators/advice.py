"""Floors under answers to health questions: which are shown, shown under a banner, or blocked.

An answer is blocked as a whole: where the question or the answer speaks of what the model must not answer, where the answer
is out of scope, is written in Tibetan, or gives doses. Texts become rows, and equal texts are read once: a text's clauses are read
in both languages, once as the commas cut them and once over commas. What is found goes back to answers by the text's hash, as one
aggregate, and one ordered decision takes it.

Defined results: null texts and null arrays say nothing; a null flag is false; answers with equal ids are one answer each, told apart
by all they say; further columns stay."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import lexicon as words
from ..functions.lexicon import Lexicon, listed
from ..functions.text import plain
from . import emergency, entities
from .clause_entities import standard
from .segments import CONCEPTS, SUPPLEMENTAL

# Java's word edges take Chinese characters for letters; these are of ASCII.
A, Z = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
END = r"(?=$|[^a-z0-9一-鿿])"
# Verbs of taking a medicine, by their forms.
EN_TAKING = "take|takes|taking|taken|drink|drinks|drinking|drunk|swallow|swallows|swallowing|swallowed|ingest|ingests|ingesting|ingested|use|uses|using|used|apply|applies|applying|applied|inject|injects|injecting|injected|administer|administers|administering|administered|inhale|inhales|inhaling|inhaled|insert|inserts|inserting|inserted|instill|instills|instilling|instilled|start|starts|starting|started|begin|begins|beginning|begun|continue|continues|continuing|continued|resume|resumes|resuming|resumed|stop|stops|stopping|stopped|discontinue|discontinues|discontinued|discontinuing"
ZH_TAKING = "服用|口服|外用|使用|注射|吸入|滴入|塞入|开始|加用|继续|停用|停服|恢复|改用|换用|服|吃|喝|涂|打|吸|喷|贴"
# Remedies and medicines without a name.
REMEDIES = "herbal remedy|herbal medicine|traditional remedy|decoction|supplement|草药|中药|藏药|方剂|汤剂|补充剂"
MEDICINES = "medication|medications|medicine|medicines|drug|drugs|remedy|remedies"
# Further forms and units.
FORMS = "tsp|teaspoon|teaspoons|tbsp|tablespoon|tablespoons|cc|scoop|scoops|puff|puffs|spoonful|spoonfuls|suppository|suppositories|勺|茶匙|汤匙|泵|栓|栓剂"
UNITS = "milligram|milligrams|gram|grams|microgram|micrograms|milliliter|milliliters|millilitre|millilitres|liter|liters|litre|litres|unit|units|international unit|international units"
# Worded quantities, schedules, durations, strengths, forms of medicines.
QUANTITY = "(?:zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion|half|quarter|single|double|triple|dozen)"
PHRASE = rf"{QUANTITY}(?:[-\s]+(?:and\s+)?{QUANTITY}){{0,4}}"
EN_SCHEDULE = rf"daily|weekly|monthly|hourly|nightly|every\s+other\s+day|on\s+alternate\s+days|every\s+(?:(?:[0-9]+|{QUANTITY})\s+)?(?:hour|hours|day|days|week|weeks|month|months|morning|evening|night)|(?:once|twice|{QUANTITY}\s+times?)\s+(?:daily|weekly|monthly|a\s+day|per\s+day|a\s+week|per\s+week|a\s+month|per\s+month)|morning\s+and\s+evening|with\s+(?:each\s+)?meals?|before\s+meals?|after\s+meals?"
ZH_SCHEDULE = r"隔天|早晚|每月|每晨|按需|按时|每(?:两|2)天|每隔\s*(?:[0-9]+|[零一二两三四五六七八九十半]+)\s*(?:小时|天|日|周|月)|(?:每日|每天|一日|每周|每月)\s*(?:[0-9]+|[一二两三四五六七八九十]+)\s*次"
EN_DURATION = rf"(?:for|over)\s+(?:a|an|[0-9]+|{PHRASE}|few|several|a\s+couple\s+of)\s+(?:hours?|days?|weeks?|months?)"
ZH_DURATION = r"(?:[0-9]+|[零一二两三四五六七八九十百半数几]+)\s*(?:小时|天|日|周|个月|月)"
STRENGTH = rf"(?:[0-9]+(?:\.[0-9]+)?|{PHRASE})\s*(?:%|percent(?:age)?)"
FORM_NAMES = "cream|ointment|solution|suspension|syrup|drops?|gel|lotion|suppository|suppositories"
ZH_FORM_NAMES = "乳膏|软膏|溶液|混悬液|糖浆|滴剂|凝胶|洗剂|栓剂|栓"
TIBETAN = r"[ༀ-࿿]"
DOTTED = [("q.d.", "qd"), ("b.i.d.", "bid"), ("t.i.d.", "tid"), ("q.i.d.", "qid"), ("p.r.n.", "prn"), ("q.h.s.", "qhs")]


def any_of(terms: list[str]) -> str:
    """An alternation of literal terms, longest first."""
    return "|".join(rf"\Q{t}\E" for t in sorted(terms, key=lambda t: -len(t)))


ALL_UNITS = [*Lexicon().units, *listed(FORMS), *listed(UNITS)]
LATIN_UNITS = [u for u in ALL_UNITS if any(c.isascii() and c.isalpha() for c in u) and not any("一" <= c <= "鿿" for c in u)]
FORM_TOKENS = [t for t, d in Lexicon().units.items() if d in words.FORMS] + list(listed(FORMS))
ASCII_FORMS, OTHER_FORMS = [t for t in FORM_TOKENS if t.isascii()], [t for t in FORM_TOKENS if not t.isascii()]
AMOUNTS = "|".join((
    rf"{A}(?:a|an|{PHRASE})(?:\s+and\s+a\s+half)?\s+(?:a\s+|an\s+)?(?:{any_of(LATIN_UNITS)}){Z}",
    rf"(?:[0-9]+(?:\.[0-9]+)?|[零一二两三四五六七八九十百半]+|{PHRASE})\s*(?:{any_of(ALL_UNITS)}){END}",
    rf"(?:[0-9]+(?:\.[0-9]+)?|[零一二两三四五六七八九十半]+|{PHRASE})\s*[-–—]\s*(?:{any_of(ALL_UNITS)}){END}",
    rf"[0-9]+\s*/\s*[0-9]+\s*(?:{any_of(ALL_UNITS)}){END}",
))
CURATED = "|".join(rf"(?<![a-z0-9])\Q{f}\E(?![a-z0-9])" if f.isascii() else rf"\Q{f}\E" for f in words.FREQUENCIES)
CONCEPT_TERMS = any_of([t for _, zh, en in CONCEPTS for t in (*zh, *en)])
REFERENTS = "|".join((
    any_of([t for of in (words.CLASSES, words.REFERENTS) for ts in of.values() for t in ts]),
    any_of([t for _, zh, en in SUPPLEMENTAL for t in (*zh, *en)]),
    f"{A}(?:{MEDICINES}){Z}",
    "药",
    any_of(list(listed(REMEDIES))),
    rf"(?<![a-z0-9])(?:{any_of(ASCII_FORMS)})(?![a-z0-9])",
    any_of(OTHER_FORMS),
))


def says(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?iu)(?:{pattern})")


def clauses_of(text: Column) -> Column:
    """The clauses of a plain text, and those that it has if commas are spaces; each once."""
    for dotted, short in DOTTED:
        text = F.regexp_replace(text, rf"(?i){A}\Q{dotted}\E(?=$|[^A-Za-z0-9])", short)
    return F.array_union(entities.clauses(text), entities.clauses(F.translate(text, ",，", "  ")))


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def stated(clauses: pd.Series) -> pd.Series:
    """For each of a text's clauses, kinds of entities that it states in either language."""
    reader = standard()
    return pd.Series([[sorted({e["type"] for lang in ("en", "zh") for e in reader.read(c, lang)}) for c in of] for of in clauses])


def gives_dose(clause: Column, kinds: Column) -> Column:
    """Whether a clause says how much, how often or how long to take a medicine, or to take one at all. kinds: stated()'s of it."""
    is_ = lambda k: F.array_contains(kinds, k)
    form = says(clause, f"{A}(?:{FORM_NAMES}){Z}|{ZH_FORM_NAMES}")
    taking = says(clause, f"{ZH_TAKING}|{A}(?:{EN_TAKING}){Z}")
    counted = is_("number") | says(clause, f"{A}{QUANTITY}{Z}")
    lasting = says(clause, f"{A}(?:{EN_DURATION}){Z}|{ZH_DURATION}")
    often = says(clause, f"{CONCEPT_TERMS}|{CURATED}|{A}(?:{EN_SCHEDULE}){Z}|{ZH_SCHEDULE}")

    def together(of: Column) -> Column:
        medicine, form, taking = (of[c] for c in ("medicine", "form", "taking"))
        return ((medicine | form) & taking) | (medicine & counted) | ((medicine | taking) & (lasting | often)) | (says(clause, STRENGTH) & (medicine | taking | form))

    # What is asked again is matched once.
    asked = F.struct((is_("drug") | says(clause, REFERENTS)).alias("medicine"), form.alias("form"), taking.alias("taking"))
    return is_("dosage") | is_("imperative") | says(clause, AMOUNTS) | F.exists(F.array(asked), together)


def judged(texts: DataFrame) -> DataFrame:
    """key, categories, tibetan and dosing of rows of key, text and own: whether it is an answer's. A question's doses aren't read."""
    own = F.col("own")
    read = texts.select("key", "own", plain(F.col("text")).alias("plain"))
    read = read.withColumn("clauses", F.when(own, clauses_of(F.col("plain"))).otherwise(F.array().cast("array<string>")))
    read = read.select("key", "own", "plain", "clauses", stated(F.col("clauses")).alias("kinds"), emergency.groups_met(F.col("plain")).alias("met"))
    dosing = F.exists(F.arrays_zip(F.col("clauses").alias("clause"), F.col("kinds").alias("kinds")), lambda x: gives_dose(x["clause"], x["kinds"]))
    return read.select("key", emergency.categories_of(F.col("met")).alias("categories"), (own & F.col("plain").rlike(TIBETAN)).alias("tibetan"), (own & (says(F.col("plain"), AMOUNTS) | dosing)).alias("dosing"))


def floors(answers: DataFrame, question: str = "question", texts: str = "texts", detected: str = "detected", out_of_scope: str = "out_of_scope") -> DataFrame:
    """answers with presentation (normal, banner or blocked), banners, and refused: why it is blocked, else null.

    question: the text asked; texts: all texts of the answer; detected: the model's own word of an emergency; out_of_scope: its
    word that it isn't one of health."""
    body = F.coalesce(F.col(texts), F.array().cast("array<string>"))
    asked = F.coalesce(F.col(question), F.lit(""))
    keyed = answers.select("*", F.sha2(F.to_json(F.struct(asked.alias("q"), body.alias("t"))), 256).alias("_said"))
    said = keyed.select("_said", asked.alias("q"), body.alias("t")).dropDuplicates(["_said"])
    spoken = said.select("_said", F.posexplode(F.concat(F.array("q"), "t")).alias("at", "text")).select("_said", (F.col("at") > 0).alias("own"), F.coalesce("text", F.lit("")).alias("text"))
    spoken = spoken.withColumn("key", F.unhex(F.sha2("text", 256)))
    # Of equal texts one is read; the others are rows of their hash alone.
    found = judged(spoken.groupBy("key").agg(F.first("text").alias("text"), F.bool_or("own").alias("own")))
    never, own = F.array(*(F.lit(c) for c in emergency.suppressing())), F.col("own")
    told = (
        spoken.select("_said", "own", "key")
        .join(found, "key")
        .groupBy("_said")
        .agg(
            F.bool_or(~own & F.arrays_overlap("categories", never)).alias("asked_never"),
            F.bool_or(own & F.arrays_overlap("categories", never)).alias("told_never"),
            F.bool_or(F.size("categories") > 0).alias("urgent"),
            F.bool_or(own & F.col("tibetan")).alias("tibetan"),
            F.bool_or(own & F.col("dosing")).alias("dosing"),
        )
    )
    met = keyed.join(told.withColumnRenamed("_said", "_told"), F.col("_said") == F.col("_told"), "left")
    true = lambda c: F.coalesce(c, F.lit(False))
    banner = F.when(true(F.col("told_never")), F.array(F.lit("emergency-self-harm"))).when(true(F.col("urgent")) | true(F.col(detected)), F.array(F.lit("emergency"))).otherwise(F.array().cast("array<string>"))
    refused = (
        F.when(true(F.col("asked_never")), "emergency-only")
        .when(true(F.col(out_of_scope)), "out-of-scope")
        .when(true(F.col("tibetan")), "tibetan-output")
        .when(true(F.col("dosing")), "dosing")
        .when(true(F.col("told_never")), "emergency-only")
    )
    out = met.withColumn("refused", refused).withColumn("banners", F.when(F.col("asked_never"), F.array(F.lit("emergency-self-harm"))).otherwise(banner))
    shown = F.when(F.col("refused").isNotNull(), "blocked").when(F.size("banners") > 0, "banner").otherwise("normal")
    return out.select(*(F.col(c) for c in answers.columns), shown.alias("presentation"), "banners", "refused")
