"""Whether a Tibetan text is well formed, as findings of its code points and of the text.

Column functions; a pattern class decides each code point. Defined results: a null text has the findings of an empty one."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

FINDINGS = "array<struct<check:string,at:int,code_point:int>>"
#: Code points that a text may hold (the Tibetan block, ASCII letters, digits and signs, signs of units);
#: unassigned or deprecated ones of the block; Devanagari; zero-width and direction controls; CJK; blanks that are trimmed.
ALLOWED = r"""[\u0F00-\u0FFFA-Za-z0-9 !"#%'()*+,\-./:;<=>?\[\]^_{}\u00B2\u00B5\u00D7\u03BC\u2013\u2212\u2264\u2265]"""
UNASSIGNED = r"[\u0F48\u0F6D-\u0F70\u0F77\u0F79\u0F98\u0FBD\u0FCD\u0FDB-\u0FFF]"
DEVANAGARI = r"[\u0900-\u097F]"
CONTROL = r"[\u200B-\u200F\u202A-\u202E\u2060\u2066-\u2069\uFEFF]"
CJK = r"[\u3400-\u4DBF\u4E00-\u9FFF]"
BLANK = r"[\t-\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
TSHEG, SYLLABLE = r"[\u0F0B\u0F0C]", r"[\u0F40-\u0FBC]"


def is_composed(text: Column) -> Column:
    """Whether a text equals its NFC form."""
    return F.pandas_udf(lambda texts: texts.map(lambda t: unicodedata.is_normalized("NFC", t)), "boolean")(text)


def findings(text: Column) -> Column:
    """check, at and code_point (null for what concerns the whole text): A1 empty, A2 CJK, A3 a code point that isn't allowed,
    A4 Devanagari, A5 unassigned or not composed, A7 a separator that is first, doubled or missing, A9 a control.
    at counts UTF-16 units from 0; findings of code points come by place, between A1, A2 and the others."""
    text = F.coalesce(text, F.lit(""))
    points = F.filter(F.split(text, ""), lambda c: c != "")
    placed = F.transform(points, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    bad = F.filter(placed, lambda p: ~p["c"].rlike(ALLOWED) | p["c"].rlike(UNASSIGNED) | p["c"].rlike(CONTROL))
    wide = lambda i: F.regexp_count(F.substring(text, F.lit(1), i), F.lit(r"[\x{10000}-\x{10FFFF}]"))
    one = lambda check, at, code: F.struct(F.lit(check).alias("check"), at.cast("int").alias("at"), code.cast("int").alias("code_point"))
    none = F.array().cast(FINDINGS)

    def of(p: Column) -> Column:
        rules = (("A3", ~p["c"].rlike(ALLOWED)), ("A4", p["c"].rlike(DEVANAGARI)), ("A5", p["c"].rlike(UNASSIGNED)), ("A9", p["c"].rlike(CONTROL)))
        return F.concat(*(F.when(holds, F.array(one(check, p["i"] + wide(p["i"]), F.ascii(p["c"])))).otherwise(none) for check, holds in rules))

    whole = lambda check, holds: F.when(holds, F.array(one(check, F.lit(None), F.lit(None)))).otherwise(none)
    runs = F.size(F.filter(F.split(text, " "), lambda r: r.rlike(SYLLABLE)))
    return F.concat(
        whole("A1", text.rlike(rf"\A{BLANK}*\z")),
        whole("A2", text.rlike(CJK)),
        F.flatten(F.transform(bad, of)),
        whole("A5", ~is_composed(text)),
        whole("A7", text.rlike(rf"\A{BLANK}*{TSHEG}")),
        whole("A7", text.contains("\u0f0b\u0f0b")),
        whole("A7", (runs >= 2) & ~text.rlike(TSHEG)),
    )
