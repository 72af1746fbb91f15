"""What short texts state: clauses, numbers, doses, terms. Column functions, but for none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import trimmed

NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
#: What ends a clause.
CLAUSE_ENDS = r"[。；;!?！？\n]|(?<![0-9])[.,]|[.,](?![0-9])|但是|但|而|及|和|，|(?i:\band\b|\bbut\b)"
#: Units of doses, longest first.
UNITS = ("tablets", "tablet", "capsules", "capsule", "units", "drops", "mcg", "ug", "mg", "ml", "kg", "iu", "g", "l")


def clauses(x: Column) -> Column:
    """Parts between sentence marks, commas and points outside numbers, and the words and, but; no empty ones."""
    return F.filter(F.transform(F.split(x, CLAUSE_ENDS), lambda c: trimmed(c)), lambda c: c != "")


def numbers(x: Column) -> Column:
    """All numbers in order, as they stand."""
    return F.regexp_extract_all(x, F.lit(f"({NUMBER})"), F.lit(1))


def same_numbers(a: Column, b: Column) -> Column:
    """Whether two texts have the same numbers equally often."""
    return F.array_sort(numbers(a)) == F.array_sort(numbers(b))


def doses(x: Column) -> Column:
    """amount, upper amount of a range (or empty) and unit of each dose, in order."""
    pattern = rf"(?i)({NUMBER})(?:\s*[-~–至]\s*({NUMBER}))?\s*({'|'.join(UNITS)})"
    hit = lambda i: F.regexp_extract_all(x, F.lit(pattern), F.lit(i))
    return F.arrays_zip(hit(1).alias("amount"), hit(2).alias("upper"), F.transform(hit(3), F.lower).alias("unit"))


def has_term(x: Column, term: str) -> Column:
    """An English term with no letter or digit at its edges, in either case; other scripts anywhere."""
    low = F.translate(F.lower(x), "’‘", "''")
    if not term.isascii():
        return low.contains(term.lower())
    return low.rlike(rf"(?<![a-z0-9])\Q{term.lower()}\E(?![a-z0-9])")


def language(x: Column) -> Column:
    return F.when(x.rlike(r"[\u4e00-\u9fff]"), "zh").otherwise("en")
