"""The verdict on a segment of a note and its translation: the entities of both sides, compared part by part, folded into one action.

A verdict depends on the two texts alone, so equal pairs are read once. Entities of a pair meet in one row; each part gives hits
(flag and action), and the highest action counts while each flag stands once, in the order of the parts.

Defined results: null texts state nothing; repeated rows get equal verdicts; further columns stay as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as words
from ..functions.lexicon import Lexicon, listed
from . import entities, fidelity, notes
from .clause_entities import clause_entities, contained, supplemental

SUPPLEMENTAL = [(i, listed(zh), listed(en)) for i, zh, en in words.SUPPLEMENTAL]
CONCEPTS = [(i, listed(zh), listed(en)) for i, zh, en in words.CONCEPTS]
FINDINGS = [(i, {"zh": listed(zh), "en": listed(en)}, risk) for i, zh, en, risk in words.FINDINGS]
QUALIFIERS = [{"zh": (zh,), "en": listed(en)} for zh, en in words.QUALIFIERS]
HIGH_RISK_PAIR = "R9-HIGH-RISK-PAIR"


def frequency_concept(text: Column, lang: Column) -> Column:
    """What the first frequency in the text means, in either language; else null."""
    held = contained(text, lang, CONCEPTS)
    return F.coalesce(*(F.when(h, F.lit(name)) for h, (name, _, _) in zip(held, CONCEPTS, strict=True)))


def high_risk_pair(text: Column) -> Column:
    """Whether a term stands in the text whose confusion is dangerous."""
    both = "|".join(rf"\Q{w}\E" for zh, en in words.HIGH_RISK for w in (zh, en.lower()))
    return F.coalesce(F.lower(text).rlike(both), F.lit(False))


def entities_of_pairs(pairs: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """pair, ours and theirs: the entities of both texts of (pair, source, output), in order."""
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("source").alias("text")), F.struct(F.lit(1).alias("side"), F.col("output").alias("text"))))
    found = clause_entities(pairs.select("pair", sides.alias("of")).select("pair", "of.side", "of.text"), lexicon=lexicon)
    entity = F.struct("clause", "place", "type", "raw", "finding", "polarity", "strength", "amount", "upper", "dimension", "drug", "kind", "direction", "immutable_key")
    of = lambda side: F.sort_array(F.collect_list(F.when(F.col("side") == side, entity)))
    return found.groupBy("pair").agg(of(0).alias("ours"), of(1).alias("theirs"))


def of_type(found: Column, what: str) -> Column:
    return F.filter(found, lambda e: e["type"] == what)


def segment_verdicts(segments: DataFrame, source: str = "source", output: str = "output", lexicon: Lexicon | None = None) -> DataFrame:
    """segments with action (0 render, 1 flag, 2 abstain), flags, and preserved: the source's entities unless it abstains."""
    whole = lambda c: F.coalesce(F.col(c), F.lit(""))
    pair = F.sha2(F.concat(F.sha2(whole(source), 256), F.sha2(whole(output), 256)), 256)
    keyed = segments.select("*", pair.alias("_pair"))
    pairs = keyed.groupBy(F.col("_pair").alias("pair")).agg(F.any_value(whole(source)).alias("source"), F.any_value(whole(output)).alias("output"))
    met = pairs.join(entities_of_pairs(pairs, lexicon), "pair", "left")
    ours, theirs, a, b = (F.col(c) for c in ("ours", "theirs", "source", "output"))
    la, lb = entities.language(a), entities.language(b)
    shaped = lambda held, fields: F.transform(held, lambda e: F.struct(*(e[f].cast("string").alias(f) for f in fields)))
    held = {(side, what): of_type(F.col(side), what) for side in ("ours", "theirs") for what in ("negation", "dosage", "drug", "number")}
    negated = [shaped(held[s, "negation"], ("raw", "finding", "polarity", "strength")) for s in ("ours", "theirs")]
    dosed = [fidelity.filled(shaped(held[s, "dosage"], ("amount", "upper", "dimension")), "array<struct<amount:string,upper:string,dimension:string>>") for s in ("ours", "theirs")]
    counted = [F.transform(held[s, "number"], lambda e: e["amount"]) for s in ("ours", "theirs")]
    known = [F.array_union(fidelity.filled(F.transform(F.filter(held[s, "drug"], lambda e: e["drug"].isNotNull()), lambda e: e["drug"]), "array<string>"), supplemental(t, lang, SUPPLEMENTAL)) for s, t, lang in (("ours", a, la), ("theirs", b, lb))]
    unknown = [F.transform(F.filter(held[s, "drug"], lambda e: e["drug"].isNull()), lambda e: e["raw"]) for s in ("ours", "theirs")]
    unread = notes.corrupted_dose(a)
    doses = F.concat(fidelity.dose_hits(*dosed, frequency_concept(a, la), frequency_concept(b, lb)), fidelity.number_hits(*counted, dosed[1]))
    parts = [
        fidelity.hits_if(high_risk_pair(a) | high_risk_pair(b), (HIGH_RISK_PAIR, fidelity.RENDER)),
        F.when(unread, fidelity.hits((fidelity.UNPARSEABLE, fidelity.ABSTAIN))).otherwise(doses),
        fidelity.negation_hits(*negated, a, b, la, lb, FINDINGS, words.HEDGES, words.EXCLUSIONS, words.LOCATORS, words.NOT_EXCLUSIONS),
        fidelity.drug_hits(*known, *unknown, a, b, QUALIFIERS, la),
        fidelity.polarity_hits(a, b),
    ]
    stated = fidelity.filled(F.transform(ours, lambda e: F.struct(e["type"].alias("type"), e["raw"].alias("raw"), e["immutable_key"].alias("key"))), "array<struct<type:string,raw:string,key:string>>")
    told = met.select(F.col("pair").alias("_told"), fidelity.verdict(F.concat(*parts), stated).alias("_verdict"))
    return keyed.join(told, F.col("_pair") == F.col("_told")).select(*(F.col(c) for c in segments.columns), "_verdict.action", "_verdict.flags", "_verdict.preserved")
