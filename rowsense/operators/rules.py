"""The ordered rule set: each row gets flags in a fixed order, an action, and whether it must be confirmed or reviewed.

Rows have the columns of READ: key (null: not recognised), report_only, measurement and scoped (how the entry was matched),
what predicates() says, value, confidence, high_stakes, sensitive, ours and printed (range structs), absolute_low,
absolute_high, critical_low, critical_high, sex, has_ages (the entry has bands by age and the age isn't known). Some rules
stop the evaluation: those after the first that stops don't count. Each step is a projection of its own, so what several
rules ask for is made once a row, in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import classify, disjoint, outside, range_plausible, ranges_disagree, status
from ..functions.parse import parse_qualitative
from ..functions.text import trimmed, unit_key

#: Rules in order, with severity and whether they stop.
RULES = (
    ("R1-UNKNOWN-ANALYTE", 2, True),
    ("R2-UNIT-MISMATCH (measurement)", 2, True),
    ("R18-SPECIMEN-MATCH-UNCORROBORATED", 2, True),
    ("R5-LOW-OCR-CONFIDENCE-NUMERIC (report only)", 2, False),
    ("REPORT-ONLY", 0, True),
    ("R2-UNIT-MISMATCH", 2, True),
    ("R13-IMPLAUSIBLE-VALUE", 2, True),
    ("R3-CRITICAL-PANIC-RANGE", 3, False),
    ("R4-HIGH-STAKES-ANY-ABNORMAL", 2, False),
    ("R5-LOW-OCR-CONFIDENCE-NUMERIC", 2, False),
    ("R6-HIGH-STAKES-MANDATORY-CONFIRM", 1, False),
    ("R16-PRINTED-RANGE-UNIT-SUSPECT", 2, False),
    ("R17-BAND-NOT-COMPARABLE", 2, False),
    ("R11-RANGE-DISAGREEMENT", 1, False),
    ("R12-POPULATION-SENSITIVE", 1, False),
)
ABSTAINING = ("R1-UNKNOWN-ANALYTE", "R2-UNIT-MISMATCH (measurement)", "R18-SPECIMEN-MATCH-UNCORROBORATED", "R2-UNIT-MISMATCH", "R13-IMPLAUSIBLE-VALUE")
CONFIRMING = ("R5-LOW-OCR-CONFIDENCE-NUMERIC (report only)", "R13-IMPLAUSIBLE-VALUE", "R5-LOW-OCR-CONFIDENCE-NUMERIC", "R6-HIGH-STAKES-MANDATORY-CONFIRM", "R16-PRINTED-RANGE-UNIT-SUSPECT")
CAUTION = 2

#: Columns that the rules read.
READ = ("key", "report_only", "measurement", "scoped", "unit_fits", "implicit_unit", "contradicted", "corroborated", "suspicious", "value", "confidence", "high_stakes", "sensitive", "ours", "printed", "absolute_low", "absolute_high", "critical_low", "critical_high", "sex", "has_ages")


def no(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def some(x: Column) -> Column:
    """Whether a printed text holds more than white space."""
    return no(trimmed(x) != "")


def unit_matches(unit: Column, allowed: Column, optional: Column) -> Column:
    """Whether a printed unit is one of the entry's, as confusable letters read; without a unit, whether it may be missing."""
    key = unit_key(unit)
    return F.when(unit.isNull() | (unit == ""), no(optional)).otherwise(no(F.exists(allowed, lambda a: unit_key(a) == key)))


def predicates(rows: DataFrame) -> DataFrame:
    """rows with unit_fits, implicit_unit, contradicted, corroborated and suspicious, from unit (printed), entry_unit,
    allowed_units, unit_optional, text (the printed value), range_text, value, report_only, ours, printed, absolute_low."""
    fits = rows.withColumn("unit_fits", unit_matches(F.col("unit"), F.col("allowed_units"), F.col("unit_optional"))).withColumn("_quality", (F.col("entry_unit") == "qualitative") & parse_qualitative(F.col("text")).isNotNull())
    printed_unit, quality = some(F.col("unit")), no(F.col("_quality"))
    by_range = F.col("printed").isNotNull() & ~no(F.col("report_only"))
    negative = no((F.col("entry_unit") == "qualitative") & (parse_qualitative(F.col("range_text")) == "negative"))
    below_zero = no(F.col("value") < 0) & ~no(F.col("absolute_low") < 0)
    return fits.select(
        *rows.columns,
        "unit_fits",
        (quality & ~printed_unit).alias("implicit_unit"),
        ((no(F.col("entry_unit") != "as reported")) & printed_unit & ~F.col("unit_fits")).alias("contradicted"),
        F.when(by_range, ~ranges_disagree(F.col("ours"), F.col("printed"))).otherwise(negative | (printed_unit & F.col("unit_fits"))).alias("corroborated"),
        (F.col("text").isNull() | (~quality & (F.col("value").isNull() | below_zero))).alias("suspicious"),
    )


def derived(z: Column) -> Column:
    """What several rules ask for. z: a struct of READ."""
    kind = classify(z["value"], z["ours"]["low"], z["ours"]["high"], z["critical_low"], z["critical_high"])
    suspect = z["printed"].isNotNull() & ~range_plausible(z["ours"], z["printed"], z["absolute_low"], z["absolute_high"])
    apart = z["printed"].isNotNull() & disjoint(z["ours"]["low"], z["ours"]["high"], z["printed"]["low"], z["printed"]["high"])
    by_ours, by_printed = status(z["value"], z["ours"]), status(z["value"], z["printed"])
    flips = (by_ours != by_printed) & (by_printed != "none") & (by_ours != "none")
    return F.struct(kind.alias("kind"), suspect.alias("suspect"), apart.alias("apart"), flips.alias("flips"))


def rule_conditions(z: Column, y: Column) -> dict[str, Column]:
    """Whether each rule holds, by itself. y: derived(z)."""
    usable = z["printed"].isNotNull() & ~y["suspect"]
    return {
        "R1-UNKNOWN-ANALYTE": z["key"].isNull(),
        "R2-UNIT-MISMATCH (measurement)": no(z["measurement"]) & no(z["contradicted"]),
        "R18-SPECIMEN-MATCH-UNCORROBORATED": no(z["scoped"]) & F.when(no(z["report_only"]), no(z["contradicted"])).otherwise(~no(z["corroborated"])),
        "R5-LOW-OCR-CONFIDENCE-NUMERIC (report only)": no(z["report_only"]) & no(z["confidence"] == "low"),
        "REPORT-ONLY": no(z["report_only"]),
        "R2-UNIT-MISMATCH": ~no(z["unit_fits"]) & ~no(z["implicit_unit"]),
        "R13-IMPLAUSIBLE-VALUE": outside(z["value"], z["absolute_low"], z["absolute_high"]),
        "R3-CRITICAL-PANIC-RANGE": y["kind"].startswith("critical"),
        "R4-HIGH-STAKES-ANY-ABNORMAL": no(z["high_stakes"]) & y["kind"].isin("low", "high"),
        "R5-LOW-OCR-CONFIDENCE-NUMERIC": no(z["confidence"] == "low") | no(z["suspicious"]),
        "R6-HIGH-STAKES-MANDATORY-CONFIRM": no(z["high_stakes"]),
        "R16-PRINTED-RANGE-UNIT-SUSPECT": y["suspect"],
        "R17-BAND-NOT-COMPARABLE": usable & y["apart"],
        "R11-RANGE-DISAGREEMENT": usable & (y["flips"] | ranges_disagree(z["ours"], z["printed"])),
        "R12-POPULATION-SENSITIVE": no(z["sensitive"]) & (no(z["sex"] == "unknown") | no(z["has_ages"])),
    }


def evaluate(rows: DataFrame) -> DataFrame:
    """rows with flags (array of id and severity, in order), classification, abstained, needs_confirm, needs_review, action."""
    z, y = F.col("_z"), F.col("_y")
    asked = rows.select(F.struct(*rows.columns).alias("_row"), F.struct(*READ).alias("_z")).withColumn("_y", derived(z))
    conditions = rule_conditions(z, y)
    held = asked.withColumn("_held", F.array(*(F.when(conditions[name], F.lit(i)) for i, (name, _, _) in enumerate(RULES))))
    stops = F.array(*(F.lit(i) for i, r in enumerate(RULES) if r[2]))
    kept = held.withColumn("_kept", F.array_compact("_held")).withColumn("_stop", F.coalesce(F.array_min(F.array_intersect("_kept", stops)), F.lit(len(RULES)))).withColumn("_kept", F.filter("_kept", lambda i: i <= F.col("_stop")))
    names, severities = F.array(*(F.lit(r[0].split(" (")[0]) for r in RULES)), F.array(*(F.lit(r[1]) for r in RULES))
    number = {r[0]: i for i, r in enumerate(RULES)}
    # A band that would change the call is more than information.
    severity = lambda i: F.when((i == number["R11-RANGE-DISAGREEMENT"]) & y["flips"], CAUTION).otherwise(severities[i])
    flagged = kept.withColumn("_flags", F.transform("_kept", lambda i: F.struct(names[i].alias("id"), severity(i).alias("severity"))))
    has = lambda *of: F.arrays_overlap("_kept", F.array(*(F.lit(number[x]) for x in of)))
    worst = F.coalesce(F.array_max(F.transform("_flags", lambda f: f["severity"])), F.lit(0))
    unclassified = has(*ABSTAINING) | (no(z["report_only"]) & z["ours"].isNull())
    return flagged.select(
        "_row.*",
        F.col("_flags").alias("flags"),
        has(*ABSTAINING).alias("abstained"),
        F.when(unclassified, "unclassified").otherwise(y["kind"]).alias("classification"),
        (has(*CONFIRMING) | (has("R2-UNIT-MISMATCH", "REPORT-ONLY") & no(z["high_stakes"]))).alias("needs_confirm"),
        (has("R3-CRITICAL-PANIC-RANGE", "R17-BAND-NOT-COMPARABLE") | (has("R11-RANGE-DISAGREEMENT") & y["flips"])).alias("needs_review"),
        F.element_at(F.array(*map(F.lit, ("none", "info", "caution", "urgent"))), worst + 1).alias("action"),
    )


def with_flag(rows: DataFrame, which: Column, name: str, severity: int, first: bool = False, confirm: bool = True) -> DataFrame:
    """rows with a flag more, once, where `which` holds; it asks for confirmation unless it is information only."""
    one = F.array(F.struct(F.lit(name).alias("id"), F.lit(severity).alias("severity")))
    new = no(which) & ~F.exists("flags", lambda f: f["id"] == name)
    out = rows.withColumn("flags", F.when(new, F.concat(one, "flags") if first else F.concat("flags", one)).otherwise(F.col("flags")))
    return out.withColumn("needs_confirm", F.col("needs_confirm") | no(which)) if confirm else out


def converted_flag(rows: DataFrame, converted: str = "converted") -> DataFrame:
    """Rows whose value was converted say so first."""
    return with_flag(rows, F.col(converted).isNotNull(), "R2b-UNIT-CONVERTED", 1, first=True, confirm=False)


def low_quality(rows: DataFrame, poor: Column) -> DataFrame:
    """Rows of a page that was hard to read: all that weren't abstained from must be confirmed."""
    return with_flag(rows, poor & ~F.col("abstained"), "H4-LOW-QUALITY-OVERRIDE", CAUTION)


def cross_row_flags(rows: DataFrame, report: str = "report_id", total: str = "total", direct: str = "direct", indirect: str = "indirect") -> DataFrame:
    """R15 on the rows themselves: of each report the first classified rows of the parts, where they don't fit their total.
    rows: report, ord, part, value, abstained, flags, needs_confirm; rows of one report that share ord and part share the flag."""
    fit = rows.filter(~F.col("abstained") & F.col("value").isNotNull() & F.col("part").isin(total, direct, indirect))
    first = lambda p: F.min(F.when(F.col("part") == p, F.struct("ord", "value"))).alias(f"_{p}")
    seen = fit.groupBy(report).agg(*map(first, (total, direct, indirect)))
    t, d, i = (F.col(f"_{p}.value") for p in (total, direct, indirect))
    exceeds, differs = no((d > 1.1 * t) & (d - t > 3)), no(F.abs(t - (d + i)) > F.greatest(F.lit(2.0), 0.1 * t))
    parts = F.when(differs, F.array(F.lit(total), F.lit(direct), F.lit(indirect))).otherwise(F.array(F.lit(total), F.lit(direct)))
    named = F.array(*(F.struct(F.lit(p).alias("part"), F.col(f"_{p}.ord").alias("ord")) for p in (total, direct, indirect)))
    marked = seen.filter(exceeds | differs).select(F.col(report).alias("_report"), F.filter(named, lambda x: F.array_contains(parts, x["part"])).alias("_marked"))
    met = rows.join(marked, rows[report] == F.col("_report"), "left")
    hit = F.exists("_marked", lambda x: (x["part"] == F.col("part")) & (x["ord"] == F.col("ord")))
    return with_flag(met, hit & ~F.col("abstained") & F.col("value").isNotNull(), "R15-CROSS-ROW-INCONSISTENCY", CAUTION).drop("_report", "_marked")


def cross_row(rows: DataFrame, report: str = "report_id", total: str = "total", direct: str = "direct", indirect: str = "indirect") -> DataFrame:
    """Reports whose parts don't fit their total: report and what is wrong. rows: report, ord, part, value. The first row
    of each part counts; sums are one aggregation."""
    first = lambda p: F.min_by("value", F.when(F.col("part") == p, F.col("ord"))).alias(p)
    seen = rows.filter(F.col("value").isNotNull() & F.col("part").isin(total, direct, indirect)).groupBy(report).agg(*map(first, (total, direct, indirect)))
    t, d, i = F.col(total), F.col(direct), F.col(indirect)
    exceeds, differs = (d > 1.1 * t) & (d - t > 3), F.abs(t - (d + i)) > F.greatest(F.lit(2.0), 0.1 * t)
    return seen.filter(F.coalesce(exceeds, F.lit(False)) | F.coalesce(differs, F.lit(False))).withColumn("problem", F.when(F.coalesce(exceeds, F.lit(False)), "direct exceeds total").otherwise("parts differ from total"))


def flag_counts(rows: DataFrame, *by: str) -> DataFrame:
    """by, rule, severity, n: how many rows have each flag.

    explode_outer, then a filter on what came out: below explode Spark would add a filter on the array's size, and so make
    all flags a second time."""
    out = rows.select(*by, F.explode_outer("flags").alias("_flag")).groupBy(*by, F.col("_flag.id").alias("rule"), F.col("_flag.severity").alias("severity"))
    return out.agg(F.count(F.lit(1)).alias("n")).filter("rule IS NOT NULL")


def confirm_burden(rows: DataFrame) -> DataFrame:
    """Emitted and confirmed rows, and for each rule the confirmed rows that have it: rule, emitted, confirmed, n.

    One pass: a row counts once as such, and once for each flag that it has where it is confirmed."""
    ids = F.when(F.col("needs_confirm"), F.col("flags.id")).otherwise(F.array().cast("array<string>"))
    each = rows.select("abstained", "needs_confirm", F.posexplode_outer(F.concat(F.array(F.lit(None).cast("string")), ids)).alias("_at", "rule"))
    own = F.col("_at") == 0
    counted = each.groupBy("rule").agg(F.count_if(own & ~F.col("abstained")).alias("emitted"), F.count_if(own & F.col("needs_confirm")).alias("confirmed"), F.count(F.lit(1)).alias("n"))
    totals = counted.filter("rule IS NULL").select("emitted", "confirmed")
    return counted.filter("rule IS NOT NULL").select("rule", "n").crossJoin(F.broadcast(totals))  # one row of totals
