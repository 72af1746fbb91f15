"""Typed reads of what a model says as JSON: the rows, or why they are refused.

A shape says of each field which kinds it may have, and which values. Texts are read as variants, so that a number isn't taken
for a text; nothing is repaired. Defined results: null or broken JSON is refused; further fields are left out; the first field
in the shape's order that doesn't fit tells; an empty list is right."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT, NOTHING, TRUTH = "STRING", "VOID", "BOOLEAN"


@dataclass(frozen=True)
class Field:
    name: str
    kinds: tuple[str, ...] = (TEXT,)
    values: tuple[str, ...] = ()
    optional: bool = False


# Shapes of rows of a report, segments of a note, a school's advice.
EXTRACTION = (Field("name"), Field("value", (TEXT, NOTHING)), Field("unit", (TEXT, NOTHING)), Field("printedRange", (TEXT, NOTHING)), Field("printedFlagRaw", (TEXT, NOTHING), optional=True), Field("confidence", values=("low", "medium", "high")), Field("specimen", (TEXT, NOTHING), ("urine", "blood", "unknown"), True))
SEGMENTS = (Field("sourceText"), Field("translatedText"), Field("kind", values=("finding", "medication", "instruction", "followup", "other")))
SCHOOLS = ("tcm", "tibetan", "western")


def part(of: Column, path: str) -> Column:
    return F.try_variant_get(of, path, "variant")


def kind(of: Column) -> Column:
    """The JSON kind of a variant; null where there is none."""
    return F.split_part(F.schema_of_variant(of), F.lit("<"), F.lit(1))


def field_wrong(of: Column, field: Field) -> Column:
    """Why a field doesn't fit, or null."""
    got = part(of, f"$.{field.name}")
    fits = kind(got).isin(*field.kinds)
    if field.values:
        fits &= (kind(got) == NOTHING) | F.coalesce(F.try_variant_get(of, f"$.{field.name}", "string").isin(*field.values), F.lit(False))
    missing = F.lit(None).cast("string") if field.optional else F.lit(f"{field.name}: missing")
    return F.when(kind(got).isNull(), missing).when(~fits, F.concat(F.lit(f"{field.name}: not one of "), F.lit(", ".join(field.values or field.kinds))))


def read_list(text: Column, under: str, shape: tuple[Field, ...]) -> Column:
    """struct<rows: array<struct of texts>, refused: string> of a JSON object whose field `under` is a list of such objects."""
    json = F.try_parse_json(text)
    items = F.try_variant_get(json, f"$.{under}", "array<variant>")
    wrong = F.array_compact(F.transform(items, lambda x, i: F.concat(F.lit(f"{under}["), i.cast("string"), F.lit("]."), F.when(kind(x) != "OBJECT", "not an object").otherwise(F.coalesce(*(field_wrong(x, f) for f in shape))))))
    rows = F.transform(items, lambda x: F.struct(*(F.try_variant_get(x, f"$.{f.name}", "string").alias(f.name) for f in shape)))
    refused = F.when(json.isNull(), "not JSON").when((kind(json) != "OBJECT") | (F.coalesce(kind(part(json, f"$.{under}")), F.lit("")) != "ARRAY"), f"{under}: not a list").otherwise(F.get(wrong, F.lit(0)))
    return F.struct(F.when(refused.isNull(), rows).alias("rows"), refused.alias("refused"))


def read_extraction(text: Column) -> Column:
    return read_list(text, "rows", EXTRACTION)


def read_segments(text: Column) -> Column:
    return read_list(text, "segments", SEGMENTS)


def read_advice(text: Column) -> Column:
    """struct<detected, reason, out_of_scope, texts, refused>: texts are all suggestions and where to seek care, by school."""
    json = F.try_parse_json(text)
    is_ = lambda path, *kinds: F.coalesce(kind(part(json, path)).isin(*kinds), F.lit(False))
    tips = lambda s: F.try_variant_get(json, f"$.{s}.suggestions", "array<variant>")
    checks = [("emergency.detected", is_("$.emergency.detected", TRUTH)), ("emergency.reason", is_("$.emergency.reason", TEXT, NOTHING)), ("outOfScope", is_("$.outOfScope", TRUTH))]
    for s in SCHOOLS:
        some = is_(f"$.{s}.suggestions", "ARRAY") & (F.size(tips(s)) > 0) & F.forall(tips(s), lambda x: kind(x) == TEXT)
        checks += [(f"{s}.suggestions", some), (f"{s}.seekCare", is_(f"$.{s}.seekCare", TEXT))]
    refused = F.coalesce(F.when(json.isNull(), "not JSON"), *(F.when(~F.coalesce(ok, F.lit(False)), f"{name}: missing or of another kind") for name, ok in checks))
    texts = F.concat(*(F.concat(F.try_variant_get(json, f"$.{s}.suggestions", "array<string>"), F.array(F.try_variant_get(json, f"$.{s}.seekCare", "string"))) for s in SCHOOLS))
    given = lambda c: F.when(refused.isNull(), c)
    return F.struct(given(F.try_variant_get(json, "$.emergency.detected", "boolean")).alias("detected"), given(F.try_variant_get(json, "$.emergency.reason", "string")).alias("reason"), given(F.try_variant_get(json, "$.outOfScope", "boolean")).alias("out_of_scope"), given(texts).alias("texts"), refused.alias("refused"))
