"""What clauses of notes state, by lexicons that are parameters: negations and hedges, doses, frequencies, drugs, other
numbers; and how two notes of one text (a source and its translation) compare.

Clauses come from entities.clauses. Lexicons are small lists that travel with the function; matching is by the longest entry
first, and a stretch of text that an entry has used is not used again. Matching needs the places of earlier hits, so it runs
per clause in Arrow batches; comparing and counting are Spark's. Defined results: a null or empty clause states nothing."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chinese digits and their numbers.
ZH_NUMBER = {"零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
AMOUNT = r"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?|[零一二两三四五六七八九十]+|半"
NEGATION = "array<struct<raw:string,finding:string,polarity:string,strength:string>>"
DOSE = "array<struct<raw:string,amount:string,upper:string,dimension:string,start:int,end:int>>"

NAMED = "array<struct<raw:string,id:string>>"
DIRECTIVE = "array<struct<raw:string,kind:string,direction:string,drug:string>>"
#: Characters after which these words order nothing; what a negated directive means; a stop of any named medicine
#: and a halving.
NO_ORDER = {"停": "经诊产售搏跳留止工业学课滞顿车电水", "暂停": "期间一片时刻后会歇下"}
TURNED = {"hold": "continue", "continue": "hold"}
STOP_MEDICINE, HALVE = re.compile("停[一-龥]{1,8}?药"), re.compile(r"\bcut\b[a-z0-9\s'-]*\bin half\b", re.ASCII)


def free_hits(text: str, needle: str, used: list[tuple[int, int]], whole_words: bool) -> Iterable[tuple[int, int]]:
    """Places of the needle that lie in no used stretch; as whole words, no letter or digit touches its own outer ones."""
    edges = [i for i, c in enumerate(needle) if c.isascii() and c.isalnum()]
    touching = lambda i: 0 <= i < len(text) and text[i].isascii() and text[i].isalnum()
    at = text.find(needle)
    while at >= 0:
        end = at + len(needle)
        clear = all(end <= a or at >= b for a, b in used)
        if clear and not (whole_words and edges and (touching(at + edges[0] - 1) or touching(at + edges[-1] + 1))):
            yield at, end
        at = text.find(needle, end)


def negations(clause: Column, lang: Column, markers: Iterable[tuple[str, str, str, str, bool]]) -> Column:
    """raw, finding, polarity and strength of each marker, longest markers first. markers: marker, language, polarity,
    strength, and whether the finding stands before it."""
    ordered = sorted(markers, key=lambda m: -len(m[0]))
    strip = " \t\n\r\f\v\u3000\u00a0,，、的"

    @F.pandas_udf(NEGATION)
    def find(clauses: pd.Series, langs: pd.Series) -> pd.Series:
        out = []
        for text, of in zip(clauses, langs, strict=True):
            used, found = [], []
            low = (text or "").lower() if of == "en" else text or ""
            for marker, language, polarity, strength, before in ordered:
                if language != of:
                    continue
                for a, b in free_hits(low, marker.lower() if of == "en" else marker, used, of == "en"):
                    used.append((a, b))
                    found.append({"raw": text[a:b], "finding": (text[:a] if before else text[b:]).strip(strip), "polarity": polarity, "strength": strength})
            out.append(found)
        return pd.Series(out)

    return find(clause, lang)


def plain_amount(raw: str) -> str:
    """An amount in digits: without commas, or as Chinese numbers below 100 read."""
    if raw == "半":
        return "0.5"
    if re.fullmatch(r"[0-9.,]+", raw):
        return raw.replace(",", "")
    tens, mark, ones = raw.partition("十")
    if not mark:
        return str(ZH_NUMBER[raw]) if raw in ZH_NUMBER else raw
    tens, ones = ZH_NUMBER.get(tens) if tens else 1, ZH_NUMBER.get(ones) if ones else 0
    return raw if tens is None or ones is None else str(tens * 10 + ones)


def dose_pattern(units: dict[str, str]) -> re.Pattern:
    tokens = "|".join(re.escape(u) for u in sorted(units, key=lambda u: -len(u)))
    return re.compile(rf"({AMOUNT})(?:\s*[-~–至]\s*({AMOUNT}))?\s*({tokens})", re.I)


def doses_in(clause: str, pattern: re.Pattern, units: dict[str, str]) -> list[dict]:
    return [{"raw": m[0], "amount": plain_amount(m[1]), "upper": plain_amount(m[2]) if m[2] else None, "dimension": units.get(m[3], m[3]), "start": m.start(), "end": m.end()} for m in pattern.finditer(clause)]


def doses(clause: Column, units: dict[str, str]) -> Column:
    """raw, amount, upper end of a range (or null), the unit's dimension and the place of each dose. units: token, dimension.
    Digits are ASCII or Chinese."""
    pattern = dose_pattern(units)

    @F.pandas_udf(DOSE)
    def find(clauses: pd.Series) -> pd.Series:
        return pd.Series([doses_in(t or "", pattern, units) for t in clauses])

    return find(clause)


def frequency(clause: Column, lang: Column, tokens: Iterable[str]) -> Column:
    """The longest frequency token in the clause: as a whole word where it is ASCII and the clause English; else null."""
    ordered = sorted(tokens, key=lambda t: -len(t))
    hit = lambda t: F.when((lang == "en") & F.lit(bool(re.fullmatch(r"[A-Za-z0-9/]+", t))), clause.rlike(rf"(?i)\b\Q{t}\E\b")).otherwise(clause.contains(t))
    return F.coalesce(*(F.when(hit(t), F.lit(t)) for t in ordered))


def known_drugs(clause: Column, lang: Column, forms: Iterable[tuple[str, str]]) -> Column:
    """Distinct ids of the drugs whose forms (form, id) the clause holds, longest forms first."""
    ordered = sorted(forms, key=lambda f: -len(f[0]))

    @F.pandas_udf("array<string>")
    def find(clauses: pd.Series, langs: pd.Series) -> pd.Series:
        out = []
        for text, of in zip(clauses, langs, strict=True):
            used, ids = [], {}
            low = (text or "").lower() if of == "en" else text or ""
            for form, drug in ordered:
                for hit in free_hits(low, form.lower() if of == "en" else form, used, of == "en"):
                    used.append(hit)
                    ids[drug] = True
            out.append(list(ids))
        return pd.Series(out)

    return find(clause, lang)


def is_turned(before: str, of: str, inversions: Iterable[tuple[str, str]]) -> bool:
    """Whether a negation stands right before."""
    if of != "en":
        return before.endswith(tuple(w for w, language in inversions if language == of))
    ends = "|".join(re.escape(w.lower()) for w, language in inversions if language == of)
    return bool(ends) and re.search(rf"(?<![a-z0-9])(?:{ends})\s*$", before) is not None


def directives_in(text: str, of: str, named: Iterable[dict], markers: Iterable[tuple[str, str, str, str | None, bool]], inversions: Iterable[tuple[str, str]], monitored: Iterable[str], referents: Iterable[tuple[str, str]]) -> list[dict]:
    """The directives of one clause, see directives()."""
    low, used, found = text.lower() if of == "en" else text, [], []
    places = [(text.find(d["raw"]), d["id"]) for d in named if d["raw"] in text]
    referred = len(named) > 0 or any((t.lower() if of == "en" else t) in low for t, language in referents if language == of)

    def add(a: int, b: int, kind: str, direction: str | None) -> None:
        used.append((a, b))
        if is_turned(low[:a], of, inversions):
            kind, direction = (kind, "unknown") if kind == "dose-change" else (TURNED.get(kind, "unknown"), None)
        elif kind == "dose-change":
            direction = direction or "unknown"
        drug = min(places, key=lambda p: abs(p[0] - a))[1] if places else None
        found.append({"raw": text[a:b], "kind": kind, "direction": direction, "drug": drug})

    here = [m for m in markers if m[1] == of and (m[0].lower() if of == "en" else m[0]) in low]
    for marker, _, kind, direction, needs_drug in sorted(here, key=lambda m: -len(m[0])):
        if needs_drug and not referred:
            continue
        for a, b in free_hits(low, marker.lower() if of == "en" else marker, used, of == "en"):
            orders_nothing = text[b : b + 1] and text[b : b + 1] in NO_ORDER.get(marker, "")
            if not (orders_nothing or (marker == "停" and text[:a].endswith("暂")) or (kind == "continue" and text[b:].startswith(tuple(monitored)))):
                add(a, b, kind, direction)
    others = STOP_MEDICINE.finditer(text) if of == "zh" else HALVE.finditer(low) if of == "en" and referred else ()
    for m in others:
        clear = all(m.end() <= a or m.start() >= b for a, b in used)
        if clear and not (of == "zh" and text[m.start() + 1] in NO_ORDER["停"]):
            add(m.start(), m.end(), *(("hold", None) if of == "zh" else ("dose-change", "down")))
    return found


def directives(clause: Column, lang: Column, drugs: Column, markers: Iterable[tuple[str, str, str, str | None, bool]], inversions: Iterable[tuple[str, str]], monitored: Iterable[str], referents: Iterable[tuple[str, str]]) -> Column:
    """raw, kind (hold, continue, dose-change or unknown), direction (of dose changes) and drug of each directive:
    the one whose first mention starts nearest to it.

    drugs: array<struct<raw, id>> of the clause; markers: marker, language, kind, direction, and whether it needs a drug or a
    referent (word, language) in the clause; a negation (word, language) right before a marker turns it; a continue marker
    right before something monitored orders nothing. A null clause or null drugs state nothing."""
    markers, monitored, inversions, referents = list(markers), tuple(monitored), list(inversions), list(referents)

    @F.pandas_udf(DIRECTIVE)
    def find(clauses: pd.Series, langs: pd.Series, named: pd.Series) -> pd.Series:
        return pd.Series([directives_in(t or "", of, ds if ds is not None else [], markers, inversions, monitored, referents) for t, of, ds in zip(clauses, langs, named, strict=True)])

    return find(clause, lang, drugs)


def bare_numbers(clause: Column, dosed: Column) -> Column:
    """Amounts of the clause's numbers that lie in no dose, without commas. dosed: doses() of the clause.

    Doses are blanked at their places first, so that what remains is a pattern's."""
    held = F.coalesce(clause, F.lit(""))
    blanked = F.aggregate(dosed, held, lambda t, d: F.overlay(t, F.repeat(F.lit("\u0000"), d["end"] - d["start"]), d["start"] + 1, d["end"] - d["start"]))
    found = F.regexp_extract_all(F.coalesce(blanked, held), F.lit("([0-9]+(?:[.,][0-9]+)?)"), F.lit(1))
    return F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit("")))


def nearest(place: Column, candidates: Column) -> Column:
    """Of candidates (array of struct<at, id>) the id that is nearest to a place; the earlier one in ties."""
    return F.array_min(F.transform(candidates, lambda c: F.struct(F.abs(c["at"] - place).alias("far"), c["at"].alias("at"), c["id"].alias("id"))))["id"]


def conjunctive(text: Column, patterns: Iterable[Iterable[Iterable[str]]]) -> Column:
    """Whether any pattern holds: all of its groups have one of their terms (lower case) in the text."""
    low, out = F.lower(text), F.lit(False)
    for groups in patterns:
        held = F.lit(True)
        for terms in groups:
            any_term = F.lit(False)
            for t in terms:
                any_term |= low.contains(t.lower())
            held &= any_term
        out |= held
    return F.coalesce(out, F.lit(False))


def excluded(text: Column, hedges: Iterable[str], words: Iterable[str]) -> Column:
    """Whether a word of exclusion stands in the text outside all hedges."""
    bare = F.regexp_replace(F.lower(text), "|".join(rf"\Q{h.lower()}\E" for h in sorted(hedges, key=lambda h: -len(h))), " ")
    return F.coalesce(bare.rlike("|".join(rf"\Q{w.lower()}\E" for w in words)), F.lit(False))


#: Signs of a text that could not be read, and what tells that it speaks of a dose.
CORRUPTED = r"[\u2580-\u259f\ufffd]|[?？]{2,}"
DOSED = r"[0-9]|(?i:mg|mcg|ml|g\b|毫克|微克|毫升|片|粒|单位|iu|处方|prescription|剂量|dose)"


def corrupted_dose(text: Column, context: str = DOSED) -> Column:
    """A block, a replacement character or several question marks in a text that speaks of a dose (context: a pattern)."""
    return F.coalesce(text.rlike(CORRUPTED) & text.rlike(context), F.lit(False))


def survives(kind: Column, value: Column, text: Column) -> Column:
    """Whether a number (no digit beside it), or any other value (in either case), stands in a text."""
    number = F.regexp_count(text, F.concat(F.lit(r"(?<!\d)\Q"), value, F.lit(r"\E(?!\d)"))) > 0
    return F.coalesce(F.when(kind == "number", number).otherwise(F.contains(F.lower(text), F.lower(value))), F.lit(False))


def matched_by_kind(immutables: DataFrame, texts: DataFrame, key: str = "id") -> DataFrame:
    """kind, matched, total of immutables (key, kind, value) against the text of their key; a missing text matches none."""
    met = immutables.join(texts.select(key, F.col("text").alias("_text")), key, "left")
    return met.groupBy("kind").agg(F.count_if(survives(F.col("kind"), F.col("value"), F.col("_text"))).alias("matched"), F.count(F.lit(1)).alias("total"))


def missing(source: Column, output: Column) -> Column:
    """Distinct values of the source that the output lacks: empty if it covers them."""
    return F.array_sort(F.array_except(source, output))


def polarity_buckets(found: Column) -> Column:
    """struct<affirmed, negated, uncertain>: how many negations() have each polarity."""
    count = lambda p: F.size(F.filter(found, lambda x: x["polarity"] == p))
    return F.struct(*(count(p).alias(p) for p in ("affirmed", "negated", "uncertain")))


def leaks(rows: DataFrame, texts: Iterable[str], banned: Iterable[str]) -> DataFrame:
    """rows whose texts match a banned pattern: its columns with the column and the pattern."""
    hits = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("shown")) for c in texts)))
    rules = F.explode(F.array(*(F.lit(b) for b in banned)))
    return rows.withColumn("_hit", hits).withColumn("banned", rules).filter(F.coalesce(F.expr("_hit.shown rlike banned"), F.lit(False))).select(*rows.columns, F.col("_hit.field").alias("field"), "banned")
