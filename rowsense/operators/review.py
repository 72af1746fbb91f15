"""Reviews by two people: forms of an answer, who reviewed, and whether both agree.

Defined results: null texts are empty; an id that stands twice in one packet is an error, told by its own outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import composed

BLANKS = r"[\s ﻿]+"


def identity(name: Column) -> Column:
    """A reviewer's name for comparison: composed, trimmed, in lower case, blanks as one space."""
    return F.regexp_replace(F.lower(composed(F.coalesce(name, F.lit("")))), BLANKS, " ")


def alternatives(cell: Column) -> Column:
    """The texts of a JSON list of texts, as they are; null for all else."""
    text = F.trim(F.coalesce(cell, F.lit("")))
    items = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    whole = text.startswith("[") & text.endswith("]") & F.forall(items, lambda x: F.schema_of_variant(x) == "STRING")
    return F.when(whole, F.transform(items, lambda x: F.try_variant_get(x, "$", "string")))


def reviewed_forms(cell: Column, count: Column) -> Column:
    """struct<forms, refused>: one plain text where the source has one form, else a JSON list of as many texts as it has."""
    text, listed = F.coalesce(cell, F.lit("")), alternatives(cell)
    looks = F.trim(text).startswith("[") & F.trim(text).endswith("]")
    is_list = looks & F.coalesce(F.schema_of_variant(F.try_parse_json(F.trim(text))).startswith("ARRAY"), F.lit(False))
    refused = F.when((count == 1) & is_list, "This source takes a single plain-text Tibetan string, not a JSON array.").when((count != 1) & (listed.isNull() | (F.size(listed) != count)), F.concat(F.lit("This source has "), count.cast("string"), F.lit(" runtime alternatives; bo must be a JSON string array.")))
    return F.struct(F.when(refused.isNull(), F.when(count == 1, F.array(text)).otherwise(listed)).alias("forms"), refused.alias("refused"))


def reconciled(a: DataFrame, b: DataFrame, key: str, context: list[str], answer: str, alternative: str | None = None) -> DataFrame:
    """key, outcome and agreed (what both say, in one spelling) of two reviewers' rows.

    Outcomes, the first that holds: repeated (an id twice in one packet), context-mismatch (they saw other sources), skipped (neither
    answered), coverage-mismatch (one did), agreed, disagreement. Answers are compared composed and trimmed; where the column
    `alternative` says that a row has several forms, element by element of their lists, whatever their spacing."""
    plain = lambda c: F.coalesce(composed(F.coalesce(c, F.lit(""))), F.lit(""))

    def side(rows: DataFrame, of: str) -> DataFrame:
        seen = F.sha2(F.to_json(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in context)), {"ignoreNullFields": "false"}), 256)
        many = F.coalesce(F.col(alternative), F.lit(False)) if alternative else F.lit(False)
        held = rows.select(F.col(key).alias("_key"), seen.alias("seen"), plain(F.col(answer)).alias("text"), F.when(many, alternatives(F.col(answer))).alias("list"), many.alias("many"))
        return held.groupBy("_key").agg(F.count(F.lit(1)).alias(f"n_{of}"), F.min(F.struct("seen", "text", "list", "many")).alias(of))

    met = side(a, "a").join(side(b, "b"), "_key")
    x, y = F.col("a"), F.col("b")
    # A list is compared in one spelling of its elements.
    spelled = lambda s: F.transform(s["list"], lambda t: F.trim(t))
    lists = x["many"] & x["list"].isNotNull() & y["list"].isNotNull()
    same = F.when(lists, spelled(x) == spelled(y)).otherwise(~x["many"] & (x["text"] == y["text"]))
    blank = lambda s: s["text"] == ""
    outcome = (
        F.when((F.col("n_a") > 1) | (F.col("n_b") > 1), "repeated").when(x["seen"] != y["seen"], "context-mismatch").when(blank(x) & blank(y), "skipped").when(blank(x) | blank(y), "coverage-mismatch").when(same, "agreed").otherwise("disagreement")
    )
    said = F.when(lists, F.to_json(spelled(x))).otherwise(x["text"])
    return met.select(F.col("_key").alias(key), outcome.alias("outcome"), F.when(outcome == "agreed", said).alias("agreed"))
