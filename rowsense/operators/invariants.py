"""What a translation into Tibetan must keep of its source, as findings; candidates and templates checked by them.

Column functions: patterns give the tokens of both texts in the JVM, multisets are compared sorted, and orders by alignment: the
longest common subsequence tells how much of the source's order is kept. Tibetan digits count as ASCII ones.

Defined results: null texts are empty, null arrays are empty arrays; a text without tokens agrees with another without."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wellformed

FINDING = "struct<check:string,reason:string,source:array<string>,target:array<string>,kept:int>"
# Digits and the minus sign as ASCII writes them; numbers, intervals, Latin words, separators of both languages.
DIGITS = "༠༡༢༣༤༥༦༧༨༩"
SIGNED = r"[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)"
NUMBER, INTERVAL = rf"((?<![0-9.]){SIGNED})", rf"({SIGNED})\s*(?:-|–|—|~|～|至|到)\s*({SIGNED})"
LATIN = r"([A-Za-z][A-Za-z0-9]*(?:[-'][A-Za-z0-9]+)*)"
SOURCE_ENDS, TARGET_ENDS = "([。；：;:])", "([།༎])"
# Printed units that a source may carry.
UNITS = ("mmol/L", "mg/dL", "g/L", "μmol/L", "umol/L", "nmol/L", "ng/L", "ng/mL", "ug/L", "U/L", "mL/min/1.73m2", "mg/L", "FEU", "%", "s", "pg/mL", "IU/mL")
# What findings say.
REASONS = {"B1": "Number multisets differ.", "B1b": "Tibetan digits are not permitted in immutable numeric values.", "B2": "Interval endpoints or order differ.", "B4": "Latin token multisets differ.", "B5": "Unit token multisets differ.", "B7": "Chinese clause separators and Tibetan shad counts differ.", "B10": "Placeholder count or order differs."}
DETAILS = {"B1": "number multiset differs from source", "B2": "interval structure differs from source", "B4": "Latin token differs from source", "B5": "unit token differs from source"}
EMPTY = "No candidate Tibetan supplied."


def text_of(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def ascii_digits(text: Column) -> Column:
    return F.translate(text, DIGITS + "−", "0123456789-")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def numbers(text: Column) -> Column:
    return found(ascii_digits(text_of(text)), NUMBER)


def intervals(text: Column) -> Column:
    """Both ends of each interval with an arrow between, in order."""
    plain = ascii_digits(text_of(text))
    return F.zip_with(found(plain, INTERVAL), found(plain, INTERVAL, 2), lambda a, b: F.concat(a, F.lit("→"), b))


def latin(text: Column) -> Column:
    return found(text_of(text), LATIN)


def units(text: Column, vocabulary: Iterable[str]) -> Column:
    """Units with no Latin letter or digit beside them, the longest of the vocabulary first."""
    words = sorted({u for u in vocabulary if u}, key=lambda u: (-len(u), u))
    if not words:
        return F.array().cast("array<string>")
    return found(text_of(text), rf"(?<![A-Za-z0-9])({'|'.join(rf'\Q{u}\E' for u in words)})(?![A-Za-z0-9])")


def kept_in_order(source: Column, target: Column) -> Column:
    """Length of the longest common subsequence of two arrays: one row of the table at a time."""

    def row(before: Column, s: Column) -> Column:
        def cell(now: Column, t: Column) -> Column:
            j = F.size(now)
            best = F.when(t == s, F.get(before, j - 1) + 1).otherwise(F.greatest(F.get(before, j), F.element_at(now, -1)))
            return F.concat(now, F.array(best))

        return F.aggregate(target, F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(source, F.array_repeat(F.lit(0), F.size(target) + 1), row), -1)


def finding(check: str, holds: Column, source: Column, target: Column, ordered: bool = False) -> Column:
    """An array with one finding, or none. kept: how many of the source's tokens stand in its order in the target."""
    kept = kept_in_order(source, target) if ordered else F.lit(None).cast("int")
    one = F.struct(F.lit(check[:2] if check == "B1b" else check).alias("check"), F.lit(REASONS[check]).alias("reason"), source.alias("source"), target.alias("target"), kept.alias("kept"))
    return F.when(holds, F.array(one.cast(FINDING))).otherwise(F.array().cast(f"array<{FINDING}>"))


def differ(source: Column, target: Column) -> Column:
    return F.array_sort(source) != F.array_sort(target)


def number_findings(source: Column, target: Column) -> Column:
    a, b, digits = numbers(source), numbers(target), found(text_of(target), f"([{DIGITS}])")
    return F.concat(finding("B1", differ(a, b), a, b), finding("B1b", F.size(digits) > 0, F.array().cast("array<string>"), digits))


def interval_findings(source: Column, target: Column) -> Column:
    a, b = intervals(source), intervals(target)
    return finding("B2", a != b, a, b, ordered=True)


def latin_findings(source: Column, target: Column) -> Column:
    return finding("B4", differ(latin(source), latin(target)), latin(source), latin(target))


def unit_findings(source: Column, target: Column, vocabulary: Iterable[str] = UNITS) -> Column:
    a, b = units(source, vocabulary), units(target, vocabulary)
    return finding("B5", differ(a, b), a, b)


def separator_findings(source: Column, target: Column) -> Column:
    a, b = found(text_of(source), SOURCE_ENDS), found(text_of(target), TARGET_ENDS)
    return finding("B7", F.size(a) != F.size(b), a, b)


def placeholder_findings(source: Column, target: Column) -> Column:
    a, b = (F.coalesce(x, F.array().cast("array<string>")) for x in (source, target))
    return finding("B10", a != b, a, b, ordered=True)


def check_candidate(source: Column, target: Column) -> Column:
    """array<struct<check, detail>> of a candidate: EMPTY alone where it is blank; else what is wrong with its form, then with what
    it keeps. An empty array passes."""
    pair = lambda check, detail: F.struct(check.alias("check"), detail.alias("detail"))
    form = F.transform(wellformed.findings(target), lambda f: pair(f["check"], F.lit("well-formedness")))
    kept = F.concat(number_findings(source, target), interval_findings(source, target), latin_findings(source, target), unit_findings(source, target))
    named = F.create_map(*(F.lit(x) for kv in DETAILS.items() for x in kv))
    both = F.concat(form, F.transform(kept, lambda f: pair(f["check"], F.element_at(named, f["check"]))))
    return F.when(text_of(target).rlike(rf"\A{wellformed.BLANK}*\z"), F.array(pair(F.lit("EMPTY"), F.lit(EMPTY)))).otherwise(both)


def template_diagnostics(source: Column, target: Column, source_holders: Column, target_holders: Column, vocabulary: Iterable[str] = UNITS) -> Column:
    """array<struct<check, message>> of a template's literal texts and placeholders: form, with the first CJK code point, then B1 to B10."""
    one = lambda check, message: F.struct(check.alias("check"), message.alias("message"))
    cjk = F.regexp_extract(text_of(target), f"({wellformed.CJK})", 1)
    first = F.concat(F.lit(" First CJK codepoint: U+"), F.lpad(F.hex(F.ascii(cjk)), 4, "0"), F.lit("."))
    form = F.transform(wellformed.findings(target), lambda f: one(f["check"], F.when(f["check"] == "A2", first).otherwise("")))
    kept = F.concat(number_findings(source, target), interval_findings(source, target), latin_findings(source, target), unit_findings(source, target, vocabulary), separator_findings(source, target), placeholder_findings(source_holders, target_holders))
    shown = F.transform(kept, lambda f: one(f["check"], F.concat(f["reason"], F.lit(" source="), F.to_json(f["source"]), F.lit(" target="), F.to_json(f["target"]))))
    return F.concat(form, shown)


def model_report(candidates: DataFrame, model: str = "model", source: str = "source", target: str = "target") -> DataFrame:
    """model, total, passed, failed, empty of candidates (a row each)."""
    checked = candidates.select(model, check_candidate(F.col(source), F.col(target)).alias("_found"))
    is_empty = F.exists("_found", lambda f: f["check"] == "EMPTY")
    return checked.groupBy(model).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.size("_found") == 0).alias("passed"), F.count_if(F.size("_found") > 0).alias("failed"), F.count_if(is_empty).alias("empty"))
