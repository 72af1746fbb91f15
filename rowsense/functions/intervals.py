"""Comparisons of values with bounds and of bounds with bounds. Open or missing bounds are endless."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Share of our bound by which a printed bound may differ; ratio from which a printed range can't be of our unit.
DISAGREE, IMPLAUSIBLE = 0.15, 10.0


def status(value: Column, of: Column) -> Column:
    """none, below, within or above, honouring open ends. of: parse_range()'s struct."""
    low, high = of["low"], of["high"]
    below = F.when(of["low_open"], value <= low).otherwise(value < low)
    above = F.when(of["high_open"], value >= high).otherwise(value > high)
    return F.when(value.isNull() | of.isNull(), "none").when(F.coalesce(below, F.lit(False)), "below").when(F.coalesce(above, F.lit(False)), "above").otherwise("within")


def status_qualitative(value: Column, printed: Column) -> Column:
    return F.when(value.isNull() | printed.isNull(), "none").when(value == printed, "within").otherwise("outside")


def status_range(value: Column, of: Column) -> Column:
    """A value that is a range against a two-sided one: contained, wholly outside, or (partly, or one-sided) none."""
    above_low, below_high = (value["low"] > of["low"]) | (value["low"] == of["low"]) & ~of["low_open"], (value["high"] < of["high"]) | (value["high"] == of["high"]) & ~of["high_open"]
    below = (value["high"] < of["low"]) | of["low_open"] & (value["high"] == of["low"])
    above = (value["low"] > of["high"]) | of["high_open"] & (value["low"] == of["high"])
    said = F.when(above_low & below_high, "within").when(below, "below").when(above, "above").otherwise("none")
    return F.when(value.isNull() | of.isNull() | of["low"].isNull() | of["high"].isNull(), "none").otherwise(said)


def report_status(number: Column, quality: Column, value_range: Column, printed: Column, printed_quality: Column) -> Column:
    """The first of the three that says something; on raw values and raw ranges."""
    some = lambda x: F.nullif(x, F.lit("none"))
    return F.coalesce(some(status(number, printed)), some(status_qualitative(quality, printed_quality)), status_range(value_range, printed))


def classify(value: Column, low: Column, high: Column, critical_low: Column | None = None, critical_high: Column | None = None) -> Column:
    """Critical bounds first; all bounds are exclusive."""
    no = lambda x: F.coalesce(x, F.lit(False))
    out = F.when(value.isNull(), "unclassified")
    if critical_low is not None:
        out = out.when(no(value < critical_low), "critical-low")
    if critical_high is not None:
        out = out.when(no(value > critical_high), "critical-high")
    return out.when(no(value < low), "low").when(no(value > high), "high").otherwise("normal")


def outside(value: Column, low: Column, high: Column) -> Column:
    return F.coalesce(value < low, F.lit(False)) | F.coalesce(value > high, F.lit(False))


def ranges_disagree(ours: Column, printed: Column) -> Column:
    """Whether a bound that both have differs by more than DISAGREE of ours."""
    far = lambda a, b: F.coalesce(F.abs(a - b) > F.abs(a) * DISAGREE, F.lit(False))
    return far(ours["low"], printed["low"]) | far(ours["high"], printed["high"])


def disjoint(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    return F.coalesce(a_high < b_low, F.lit(False)) | F.coalesce(b_high < a_low, F.lit(False))


def range_plausible(ours: Column, printed: Column, absolute_low: Column, absolute_high: Column) -> Column:
    """False if the printed range lies beyond what can be, or if every bound that compares is off by more than IMPLAUSIBLE."""
    ratio = lambda a, b: F.when((a != 0) & (b != 0), F.greatest(a / b, b / a))
    low, high = ratio(ours["low"], printed["low"]), ratio(ours["high"], printed["high"])
    off = (low.isNotNull() | high.isNotNull()) & F.coalesce(low > IMPLAUSIBLE, F.lit(True)) & F.coalesce(high > IMPLAUSIBLE, F.lit(True))
    return ~disjoint(absolute_low, absolute_high, printed["low"], printed["high"]) & ~off


def rounded_bound(x: Column, up: bool, digits: int = 4) -> Column:
    """To significant digits, inwards: low bounds go up and high bounds down."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - (digits - 1))
    return F.when(x == 0, F.lit(0.0)).otherwise((F.ceil(x / unit) if up else F.floor(x / unit)) * unit)


# Bounds of entries: struct<any, male, female>, any for both sexes or else null; null without a bound.
BOUND = "struct<any:double,male:double,female:double>"


def bound_for(bound: Column, sex: Column, low: bool) -> Column:
    """A bound for a sex; the wider of the two where the sex isn't known."""
    wide = F.least if low else F.greatest
    by_sex = F.when(sex == "male", bound["male"]).when(sex == "female", bound["female"]).otherwise(wide(bound["male"], bound["female"]))
    return F.coalesce(bound["any"], by_sex)


def resolved_bounds(low: Column, high: Column, bands: Column, sex: Column, age: Column) -> Column:
    """struct<low, high, used_union> of an entry's bounds, or of its bands (array of struct<age_min, age_max, low, high>):
    the first band with the age; all bands and sexes together where none has it."""
    split = lambda b: b.isNotNull() & b["any"].isNull()
    made = lambda a, z, union: F.struct(a.alias("low"), z.alias("high"), F.coalesce(union, F.lit(False)).alias("used_union"))
    unknown = ~sex.isin("male", "female")
    own = lambda a, z: made(bound_for(a, sex, True), bound_for(z, sex, False), (split(a) | split(z)) & unknown)
    fits = F.filter(bands, lambda x: age.between(x["age_min"], x["age_max"]))
    least = F.array_min(F.transform(bands, lambda x: F.coalesce(x["low"]["any"], F.least(x["low"]["male"], x["low"]["female"]))))
    most = F.array_max(F.transform(bands, lambda x: F.coalesce(x["high"]["any"], F.greatest(x["high"]["male"], x["high"]["female"]))))
    band = F.try_element_at(fits, F.lit(1))
    return F.when(F.coalesce(F.size(bands), F.lit(0)) <= 0, own(low, high)).when(F.size(fits) > 0, own(band["low"], band["high"])).otherwise(made(least, most, F.lit(True)))
