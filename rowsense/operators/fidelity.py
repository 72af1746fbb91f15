"""Whether a second version of a note (a translation) keeps what the first states: doses, numbers, drugs, polarity of
results, directives; and what a note shows where it doesn't.

Column functions over the arrays that notes.py finds, and joins by note. A hit is struct<id, action>; a verdict takes the
highest action. Defined results: null arrays count as empty, null texts as texts that state nothing."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RENDER, FLAG, ABSTAIN = 0, 1, 2
HITS = "array<struct<id:string,action:int>>"
#: Ids of the flags.
NOT_PRESERVED, UNIT_MISMATCH, RANGE_INCOMPLETE = "R8-DOSE-NOT-PRESERVED", "R8-DOSE-UNIT-DIMENSION-MISMATCH", "R8-DOSE-RANGE-INCOMPLETE"
MAGNITUDE, FREQUENCY_DROPPED, UNPARSEABLE = "R8-DOSE-MAGNITUDE-DIVERGENCE", "R8-DOSE-FREQUENCY-DROPPED", "R8-DOSE-SOURCE-UNPARSEABLE"
NUMBER_LOST, DRUG_LOST, UNKNOWN_ALTERED = "R8-NUMBER-NOT-PRESERVED", "R9-DRUG-SUBSTITUTED", "R9-UNKNOWN-DRUG-ALTERED"
HEDGE_WEAKENED, NEGATION_DIFFERS = "R7-HEDGE-STRENGTH-WEAKENED", "R7-NEGATION-POLARITY-MISMATCH"
RETARGETED, SCOPE_BROKEN = "R7-NEGATION-RETARGETED", "R7-NEGATION-SCOPE-BROKEN"
QUALIFIER_DROPPED, POLARITY_FLIP = "R9-DRUG-QUALIFIER-DROPPED", "R9-RESULT-POLARITY-FLIP"


def hits(*found: tuple[str, int]) -> Column:
    return F.array(*(F.struct(F.lit(i).alias("id"), F.lit(a).alias("action")) for i, a in found)).cast(HITS)


def hits_if(condition: Column, *found: tuple[str, int]) -> Column:
    return F.when(condition, hits(*found)).otherwise(hits())


def filled(array: Column, kind: str) -> Column:
    return F.coalesce(array, F.array().cast(kind))


def dose_hits(source: Column, output: Column, source_frequency: Column, output_frequency: Column, ratio: float = 2) -> Column:
    """Hits of each dose of the source against the most alike dose of the output. Doses: notes.doses()."""

    def of(s: Column) -> Column:
        first = lambda keep: F.get(F.filter(output, keep), F.lit(0))
        same_unit = lambda o: o["dimension"] == s["dimension"]
        same_ends = lambda o: F.when(o["upper"].isNotNull(), (o["amount"] == s["amount"]) & (o["upper"] == s["upper"])).otherwise(o["amount"].isin(s["amount"], s["upper"]))
        any_dose = F.coalesce(first(same_unit), F.get(output, F.lit(0)))
        range_to = F.coalesce(first(lambda o: same_unit(o) & same_ends(o)), any_dose)
        single_to = F.coalesce(first(lambda o: o["amount"] == s["amount"]), any_dose)
        kept = (range_to["amount"] == s["amount"]) & range_to["upper"].eqNullSafe(s["upper"])
        of_range = F.when(range_to.isNull(), hits((NOT_PRESERVED, FLAG))).when(range_to["dimension"] != s["dimension"], hits((UNIT_MISMATCH, ABSTAIN))).otherwise(hits_if(~kept, (RANGE_INCOMPLETE, FLAG)))
        # A range of the output stands for its lower end.
        amount = single_to["amount"]
        a, b = (F.nullif(x.try_cast("double"), F.lit(0.0)) for x in (s["amount"], amount))
        far = F.coalesce(F.greatest(a / b, b / a) >= ratio, F.lit(False))
        changed = F.when(far, hits((NOT_PRESERVED, ABSTAIN), (MAGNITUDE, ABSTAIN))).otherwise(hits((NOT_PRESERVED, FLAG)))
        lost = source_frequency.isNotNull() & ~source_frequency.eqNullSafe(output_frequency)
        of_single = F.when(single_to.isNull(), hits((NOT_PRESERVED, FLAG))).when(single_to["dimension"] != s["dimension"], hits((UNIT_MISMATCH, ABSTAIN))).when(~amount.eqNullSafe(s["amount"]), changed).otherwise(hits_if(lost, (FREQUENCY_DROPPED, FLAG)))
        return F.when(s["upper"].isNotNull(), of_range).otherwise(of_single)

    return F.coalesce(F.flatten(F.transform(source, of)), hits())


def number_hits(source: Column, output: Column, output_doses: Column) -> Column:
    """Numbers of the source that are neither numbers nor doses of the output, ranges by their lower end."""
    dosed = F.transform(output_doses, lambda d: d["amount"])
    lost = F.array_except(filled(source, "array<string>"), F.array_union(filled(output, "array<string>"), filled(dosed, "array<string>")))
    return hits_if(F.size(lost) > 0, (NUMBER_LOST, FLAG))


def drug_hits(source: Column, output: Column, source_unknown: Column, output_unknown: Column, source_text: Column, output_text: Column, qualifiers: Iterable[dict[str, Iterable[str]]] = (), source_lang: Column | str = "en") -> Column:
    """Known drugs (ids) that the output lacks; unknown ones (tokens) that it replaced by another drug; and, where a drug
    survives, qualifiers that it dropped. qualifiers: forms by language; the source says one in its own, the output in any."""
    source, output, source_unknown, output_unknown = (filled(x, "array<string>") for x in (source, output, source_unknown, output_unknown))
    source_lang = F.lit(source_lang) if isinstance(source_lang, str) else source_lang
    text = F.coalesce(output_text, F.lit(""))
    names_drug = (F.size(output) > 0) | (F.size(output_unknown) > 0)
    altered = F.exists(source_unknown, lambda t: (t != "") & ~F.contains(text, t)) & names_drug
    out = [hits_if(F.size(F.array_except(source, output)) > 0, (DRUG_LOST, ABSTAIN)), hits_if(altered, (UNKNOWN_ALTERED, ABSTAIN))]
    has = lambda t, forms: F.lower(F.coalesce(t, F.lit(""))).rlike("|".join(rf"\Q{f.strip().lower()}\E" for f in forms))
    for forms in qualifiers:
        said = F.lit(False)
        for lang, own in forms.items():
            said |= (source_lang == lang) & has(source_text, own)
        out.append(hits_if(said & ~has(output_text, [f for own in forms.values() for f in own]) & F.arrays_overlap(source, output), (QUALIFIER_DROPPED, FLAG)))
    return F.concat(*out)


def result_polarity(text: Column) -> Column:
    """positive, negative or null: Chinese words first, then English whole words; positive before negative."""
    return F.when(text.contains("阳性"), "positive").when(text.contains("阴性"), "negative").when(text.rlike(r"(?i)\bpositive\b"), "positive").when(text.rlike(r"(?i)\bnegative\b"), "negative")


def polarity_hits(source_text: Column, output_text: Column) -> Column:
    return hits_if(F.coalesce(result_polarity(source_text) != result_polarity(output_text), F.lit(False)), (POLARITY_FLIP, ABSTAIN))


def negation_hits(source: Column, output: Column, source_text: Column, output_text: Column, source_lang: Column, output_lang: Column, findings: Iterable[tuple[str, dict[str, list[str]], bool]], hedges: dict[str, list[str]], exclusions: dict[str, list[str]], locators: dict[str, list[str]], shields: dict[str, list[str]] | None = None) -> Column:
    """Hits of the source's negations (notes.negations(), 'absent' or not) against the output's.

    findings: name, terms by language, high risk; a negation's finding is the first of which it holds a term. Of one finding
    both sides must be as certain (a negation of no known finding
    counts for one that the output states); an output that states what the source negates, or negates what it states, differs. Negations
    of other findings can only be counted: more of a kind abstain, fewer are flagged. A hedge (cannot exclude) of the source
    is compared with words of exclusion alone, away from the shields (the hedges, if none are given), which hold such words.
    Null arrays count as empty, null texts as blank."""
    shields = hedges if shields is None else shields
    findings = [(name, terms, risk) for name, terms, risk in findings]
    says = lambda text, terms: any(t.lower() in text.lower() for t in terms)

    def excludes(text: str, of: str) -> bool:
        low = text.lower()
        for h in sorted(shields.get(of, ()), key=len, reverse=True):
            low = low.replace(h.lower(), " ")
        return says(low, exclusions.get(of, ()))

    def of_segment(ours: list, theirs: list, text: str, other: str, of: str, to: str) -> list[dict]:
        out: list[tuple[str, int]] = []
        hedged, used = says(text, hedges.get(of, ())), set()
        about = lambda n, language: next((f for f in findings if says(n["finding"] or "", f[1].get(language, ()))), None)
        known, known_out = [about(n, of) for n in ours], [about(n, to) for n in theirs]
        if hedged and excludes(other, to):
            out += [(HEDGE_WEAKENED, ABSTAIN), (NEGATION_DIFFERS, ABSTAIN)]
        for n, finding in zip(ours, known, strict=True):
            if finding is None or hedged:
                continue
            stated = says(other, finding[1].get(to, ()))
            same = next((i for i, k in enumerate(known_out) if k and k[0] == finding[0]), None)
            if same is None and stated:
                same = next((i for i, k in enumerate(known_out) if k is None), None)
            if same is not None:
                used.add(same)
                firm, firm_out = n["polarity"] == "absent", theirs[same]["polarity"] == "absent"
                if firm != firm_out:
                    out.append((NEGATION_DIFFERS, ABSTAIN if firm_out and finding[2] else FLAG))
            elif stated and theirs:
                out.append((RETARGETED, FLAG))
            elif stated:
                scoped = says(n["finding"] or "", locators.get(of, ()))
                out.append((SCOPE_BROKEN, ABSTAIN) if scoped else (NEGATION_DIFFERS, FLAG))
        for finding in known_out:
            if finding and all(k is None or k[0] != finding[0] for k in known) and says(text, finding[1].get(of, ())):
                out.append((NEGATION_DIFFERS, ABSTAIN if finding[2] else FLAG))
        if not hedged and not says(other, hedges.get(to, ())):
            counts = [Counter(n["polarity"] == "absent" for i, (n, k) in enumerate(zip(ns, ks, strict=True)) if k is None and i not in taken) for ns, ks, taken in ((ours, known, ()), (theirs, known_out, used))]
            out += [(NEGATION_DIFFERS, ABSTAIN if counts[1][firm] > counts[0][firm] else FLAG) for firm in (True, False) if counts[1][firm] != counts[0][firm]]
        return [{"id": i, "action": a} for i, a in out]

    @F.pandas_udf(HITS)
    def find(ours: pd.Series, theirs: pd.Series, texts: pd.Series, others: pd.Series, langs: pd.Series, tos: pd.Series) -> pd.Series:
        full = lambda x: list(x) if x is not None else []
        return pd.Series([of_segment(full(a), full(b), t or "", o or "", of, to) for a, b, t, o, of, to in zip(ours, theirs, texts, others, langs, tos, strict=True)])

    return find(source, output, source_text, output_text, source_lang, output_lang)


def verdict(found: Column, stated: Column) -> Column:
    """struct<action, flags, preserved>: the highest action, each flag once, and what is stated unless it abstains."""
    action = F.coalesce(F.array_max(F.transform(found, lambda h: h["action"])), F.lit(RENDER))
    flags = F.array_distinct(F.transform(found, lambda h: h["id"]))
    return F.struct(action.alias("action"), flags.alias("flags"), F.when(action < ABSTAIN, stated).otherwise(F.slice(stated, 1, 0)).alias("preserved"))


def canonical_finding(text: Column, findings: Iterable[tuple[str, Iterable[str]]]) -> Column:
    """The first finding (name, terms in lower case) of which the text holds a term; else null."""
    low = F.lower(text)
    return F.coalesce(*(F.when(low.rlike("|".join(rf"\Q{t}\E" for t in terms)), F.lit(name)) for name, terms in findings))


def directives_differ(source: Column, output: Column) -> Column:
    """Whether the output's directives (array<struct<drug, kind, direction>>) aren't surely the source's: one of the source
    is unclear, or the multisets differ - by kind alone if there is one kind in all, else by drug and kind."""
    kind = lambda d: F.when(d["kind"] == "dose-change", F.concat(F.lit("dose-change:"), F.coalesce(d["direction"], F.lit("unknown")))).otherwise(F.coalesce(d["kind"], F.lit("unknown")))
    scoped = lambda d: F.concat(F.coalesce(d["drug"], F.lit("?")), F.lit(":"), kind(d))
    kinds = [F.transform(x, kind) for x in (source, output)]
    unclear = F.exists(kinds[0], lambda k: k.isin("unknown", "dose-change:unknown"))
    same = lambda a, b: F.array_sort(a) == F.array_sort(b)
    one = F.size(F.array_union(*kinds)) <= 1
    kept = F.when(one, same(*kinds)).otherwise(same(F.transform(source, scoped), F.transform(output, scoped)))
    return F.when(F.size(source) > 0, unclear | ~kept).otherwise(False)


def ground(notes: DataFrame, segments: DataFrame, stated: DataFrame, covered: DataFrame, changed: DataFrame) -> DataFrame:
    """note_id, outcome and action of each note.

    notes: note_id, text; segments: note_id, source, action; stated and covered: note_id, key (what the note and its
    segments' sources state), stated with high_risk; changed: note_id of notes whose directives differ. Outcomes:
    total-drop and directives replace all segments by the note itself, partial-drop adds it, kept; a blank note is kept."""
    of = segments.groupBy("note_id").agg(F.max("action").alias("_action"), F.max(F.coalesce(F.col("source"), F.lit("")).rlike(r"\S")).alias("_usable"))
    lost = stated.join(covered.select("note_id", "key"), ["note_id", "key"], "left_anti").groupBy("note_id").agg(F.max("high_risk").alias("_risk"))
    met = notes.join(of, "note_id", "left").join(lost, "note_id", "left").join(changed.select("note_id").distinct().withColumn("_changed", F.lit(True)), "note_id", "left")
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    outcome = F.when(blank, "kept").when(~F.coalesce("_usable", F.lit(False)), "total-drop").when(F.col("_changed"), "directives").when(F.col("_risk").isNotNull(), "partial-drop").otherwise("kept")
    own = F.coalesce("_action", F.lit(RENDER))
    raised = F.when(outcome.isin("total-drop", "directives"), ABSTAIN).when(outcome == "partial-drop", F.greatest(own, F.when(F.col("_risk"), ABSTAIN).otherwise(FLAG))).otherwise(own)
    return met.select("note_id", outcome.alias("outcome"), raised.cast("int").alias("action"))


def age_label(age: Column) -> Column:
    """What an age or the code of an age band (10, 40, 70) is called."""
    band = lambda name, code: F.lit(f"{name} (submitted age-band value: {code})")
    return F.when(age.isNull(), "not provided").when(age == 10, band("under 18", 10)).when(age == 40, band("18–64", 40)).when(age == 70, band("65 and over", 70)).otherwise(age.cast("string"))
