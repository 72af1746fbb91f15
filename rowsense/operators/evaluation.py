"""Evaluation of runs: operating points, recalls, error lists, gates, and small statistics. Ratios without a base are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def operating_point(rows: DataFrame, emitted: Column, error: Column) -> DataFrame:
    """coverage (0 without rows) and selective_risk (null where nothing is emitted)."""
    shown = F.count_if(emitted)
    return rows.agg(F.coalesce(F.try_divide(shown, F.count(F.lit(1))), F.lit(0.0)).alias("coverage"), F.try_divide(F.count_if(emitted & error), shown).alias("selective_risk"))


def macro_average(rows: DataFrame, sample: str, hit: Column) -> DataFrame:
    """recall: the mean over samples of each one's share of hits; samples without a known hit don't count."""
    each = rows.groupBy(sample).agg(F.avg(hit.cast("double")).alias("_share"))
    return each.agg(F.avg("_share").alias("recall"), F.count("_share").alias("samples"))


def abnormal(classification: Column) -> Column:
    """true, false or null (not classified)."""
    return F.when(classification == "normal", False).when(classification.isin("low", "high", "critical", "critical-low", "critical-high"), True)


def grounding_recall(rows: DataFrame, predicted: Column, gold: Column) -> DataFrame:
    """n (rows that say something), agreed, recall."""
    said = predicted.isNotNull() & gold.isNotNull()
    counted = rows.agg(F.count_if(said).alias("n"), F.count_if(said & (predicted == gold)).alias("agreed"))
    return counted.withColumn("recall", F.try_divide("agreed", "n"))


def outcomes(rows: DataFrame, abstained: Column, right: Column, *by: str) -> DataFrame:
    """items, abstained, correct, wrong (and whether they add up) of each group."""
    counted = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("items"), F.count_if(abstained).alias("abstained"), F.count_if(~abstained & right).alias("correct"), F.count_if(~abstained & ~right).alias("wrong"))
    return counted.withColumn("whole", F.col("items") == F.col("abstained") + F.col("correct") + F.col("wrong"))


def corpus_score(rows: DataFrame, gold: DataFrame, name: str = "name") -> DataFrame:
    """rows joined to gold by trimmed verbatim name (not by alias), counted by kind: rows, recognised, high_stakes, confirmed
    (of high-stakes rows), unlabelled. rows: name, key, needs_confirm; gold: name, kind, high_stakes."""
    of = gold.select(F.trim(F.col(name)).alias("_name"), "kind", "high_stakes").dropDuplicates(["_name"])
    met = rows.join(of, F.trim(rows[name]) == F.col("_name"), "left")
    high = F.coalesce(F.col("high_stakes"), F.lit(False))
    return met.groupBy(F.coalesce("kind", F.lit("unlabelled")).alias("kind")).agg(F.count(F.lit(1)).alias("rows"), F.count("key").alias("recognised"), F.count_if(high).alias("high_stakes"), F.count_if(high & F.coalesce(F.col("needs_confirm"), F.lit(False))).alias("confirmed"))


def error_list(cases: DataFrame, results: DataFrame, key: str = "id") -> DataFrame:
    """Cases that failed, with why: missed (should have abstained), over-abstained, or absent. results: key, abstained."""
    met = cases.join(results.select(key, F.col("abstained").alias("_got")), key, "left")
    why = F.when(F.col("_got").isNull(), "absent").when(F.col("should_abstain") & ~F.col("_got"), "missed").when(~F.col("should_abstain") & F.col("_got"), "over-abstained")
    return met.withColumn("why", why).filter("why is not null").drop("_got")


def release_blocked(errors: DataFrame, failures: DataFrame) -> DataFrame:
    """blocked: whether a high-stakes case was missed, or a behavioural case of a blocking type (MFT, DIR) failed."""
    each = errors.select(((F.col("why") == "missed") & F.col("high_stakes")).alias("blocked")).unionAll(failures.select((F.col("test_type").isin("MFT", "DIR") & ~F.col("passed")).alias("blocked")))
    return each.agg(F.coalesce(F.bool_or("blocked"), F.lit(False)).alias("blocked"))


def by_model(answers: DataFrame, model: str, text: Column, passed: Column) -> DataFrame:
    """total, passed, failed, empty of each model; an empty answer neither passes nor fails."""
    empty = F.coalesce(F.trim(text), F.lit("")) == ""
    return answers.groupBy(model).agg(F.count(F.lit(1)).alias("total"), F.count_if(~empty & passed).alias("passed"), F.count_if(~empty & ~passed).alias("failed"), F.count_if(empty).alias("empty"))


def blinded(rows: DataFrame, order: Column, models: Column, labels: int = 5) -> DataFrame:
    """rows exploded by model, with a letter that rotates with the row's number."""
    at = rows.withColumn("_i", order).select("*", F.posexplode(models).alias("_m", "model"))
    letter = F.char((F.pmod(F.col("_m") + F.col("_i"), F.lit(labels)) + 65).cast("int"))
    return at.withColumn("label", letter).drop("_i", "_m")


def median(x: Column) -> Column:
    """The aggregate: mean of the two middle values, 0 without any."""
    return F.coalesce(F.percentile(x, 0.5), F.lit(0.0))


def collisions(rows: DataFrame, text: Column, ident: str) -> DataFrame:
    """Texts that more than one id has, with the ids in order: text, ids."""
    return rows.groupBy(text.alias("text")).agg(F.array_sort(F.collect_set(ident)).alias("ids")).filter(F.size("ids") > 1)


def user_flags(flags: Column, visible: list[str]) -> Column:
    """The flags that users may see, in order."""
    return F.filter(flags, lambda f: f["id"].isin(visible))


def retry_after(reset_ms: Column, now_ms: Column) -> Column:
    """Seconds to wait for a fixed window: one at least."""
    return F.greatest(F.lit(1), F.ceil((reset_ms - now_ms) / 1000)).cast("long")


def limits_in_force(routes: DataFrame, overrides: DataFrame, route: str = "route", limit: str = "limit") -> DataFrame:
    """routes with the newest override (route, value, at) of their limit; a null value clears it."""
    last = overrides.groupBy(F.col(route).alias("_r")).agg(F.max_by("value", "at").alias("_v"))
    return routes.join(last, routes[route] == F.col("_r"), "left").withColumn(limit, F.coalesce("_v", limit)).drop("_r", "_v")


def range_text(low: Column, high: Column, unit: Column, high_open: Column | None = None) -> Column:
    """'a–b unit', '< b unit', '≤ b unit' or '≥ a unit'; empty without a bound or where low lies above high."""
    number = lambda x: F.regexp_replace(F.format_string("%.4f", x), r"\.?0+$", "")
    sign = F.lit("≤ ") if high_open is None else F.when(high_open, "< ").otherwise("≤ ")
    shown = F.when(low.isNotNull() & high.isNotNull(), F.when(low <= high, F.concat(number(low), F.lit("–"), number(high)))).when(high.isNotNull(), F.concat(sign, number(high))).when(low.isNotNull(), F.concat(F.lit("≥ "), number(low)))
    return F.coalesce(F.concat_ws(" ", shown, F.when(shown.isNotNull(), F.nullif(unit, F.lit("")))), F.lit(""))


def resolved_texts(texts: DataFrame, depth: int | None = None) -> DataFrame:
    """id, lang, text, verified, resolved_lang, path, error: texts (id, lang, text, fallback: a language, verified) whose fallbacks are
    followed to a text, however many; what a fallback gives is never verified. A cycle, or a fallback that isn't there, is an
    error with its path. depth is the most steps, if there is to be one.

    The languages of an id meet in one row, as a map; chains are followed there."""
    held = F.struct("text", "fallback", F.coalesce("verified", F.lit(False)).alias("verified"))
    maps = texts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("lang", held))).alias("_of"))
    asked = maps.select("id", "_of", F.explode(F.map_keys("_of")).alias("lang"))
    of = lambda at: F.try_element_at("_of", at)
    start = F.struct(F.col("lang").alias("at"), F.array("lang").alias("path"), F.lit(False).alias("ended"))

    def step(a: Column, i: Column) -> Column:
        to = of(a["at"])["fallback"]
        stays = a["ended"] | of(a["at"])["text"].isNotNull() | to.isNull()
        seen = F.coalesce(F.array_contains(a["path"], to), F.lit(False))
        return F.when(stays, F.struct(a["at"].alias("at"), a["path"].alias("path"), F.lit(True).alias("ended"))).otherwise(F.struct(F.when(~seen, to).alias("at"), F.concat(a["path"], F.array(to)).alias("path"), seen.alias("ended")))

    steps = F.sequence(F.lit(1), F.size("_of"))
    walked = asked.withColumn("_end", F.aggregate(steps if depth is None else F.slice(steps, 1, depth), start, step))
    at, text = F.col("_end.at"), of(F.col("_end.at"))["text"]
    error = F.when(text.isNull(), F.concat(F.when(at.isNull(), "Localized text fallback cycle: ").otherwise("Localized text without a fallback: "), F.array_join("_end.path", " -> ")))
    verified = F.coalesce(text.isNotNull() & (at == F.col("lang")) & of(at)["verified"], F.lit(False))
    return walked.select("id", "lang", text.alias("text"), verified.alias("verified"), F.when(text.isNotNull(), at).alias("resolved_lang"), F.col("_end.path").alias("path"), error.alias("error"))


#: What corpus_report counts of a row: name and condition.
COUNTS = {
    "items": "true", "recognized": "key IS NOT NULL", "chip_reproduced": "asserted", "chip_deferred": "NOT asserted", "chip_scorable": "scorable", "chip_correct": "scorable AND asserted AND said_out = flagged_out",
    "chip_wrong": "scorable AND asserted AND said_out <> flagged_out", "chip_abstained": "scorable AND NOT asserted", "recognized_high_stakes": "entry_high_stakes", "recognized_high_stakes_confirm": "entry_high_stakes AND needs_confirm",
    "gold_high_stakes": "gold_kind = 'analyte' AND gold_high_stakes", "gold_high_stakes_confirm": "gold_kind = 'analyte' AND gold_high_stakes AND needs_confirm", "gold_high_stakes_unrecognized": "gold_kind = 'analyte' AND gold_high_stakes AND key IS NULL",
    "gold_analyte": "gold_kind = 'analyte'", "gold_non_analyte": "gold_kind = 'non-analyte'", "abstained": "abstains", "classified": "NOT abstains", "confirmed": "NOT abstains AND needs_confirm", "agreement_scored": "agrees IS NOT NULL", "agree": "agrees",
    "confident_scored": "agrees IS NOT NULL AND NOT needs_confirm AND NOT needs_review", "confident_agree": "agrees AND NOT needs_confirm AND NOT needs_review", "confidently_wrong": "NOT agrees AND NOT needs_confirm AND NOT needs_review", "disagreements": "NOT agrees",
}
#: Ratios of counts; null without a base.
RATIOS = {"chip_coverage": ("chip_reproduced", "items"), "chip_accuracy": ("chip_correct", "chip_scorable"), "confirm_coverage": ("recognized_high_stakes_confirm", "recognized_high_stakes"), "confirm_coverage_gold": ("gold_high_stakes_confirm", "gold_high_stakes"), "abstain_rate": ("abstained", "items"), "confirm_rate": ("confirmed", "classified"), "agreement": ("agree", "agreement_scored"), "confident_agreement": ("confident_agree", "confident_scored")}


def judged_rows(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """rows with their gold label (by trimmed name, the first by name, kind and stakes) and what corpus_report counts.

    rows: report_id, name, key, value_text, value, range_text, flag ('0', '1' or empty: the report's own), asserted and said_out (what the chip
    says), entry_high_stakes, needs_confirm, needs_review, abstains, classification, rule_ids (array)."""
    of = gold.groupBy(F.trim(F.col("name")).alias("_name")).agg(F.min(F.struct("kind", "high_stakes")).alias("_gold"))
    met = rows.join(of, F.trim(rows["name"]) == F.col("_name"), "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    filled = met.withColumns({c: no(c) for c in ("asserted", "said_out", "entry_high_stakes", "needs_confirm", "needs_review", "abstains")})
    scored = F.coalesce(F.col("flag").isin("0", "1"), F.lit(False))
    given = (F.trim(F.coalesce("value_text", F.lit(""))) != "") & (F.trim(F.coalesce("range_text", F.lit(""))) != "")
    ours = abnormal(F.col("classification"))
    flagged = F.col("flag") == "1"
    reason = F.when(F.col("key").isNull(), "R1-UNKNOWN-ANALYTE").when(F.col("value").isNull(), "NON-NUMERIC-VALUE").otherwise(F.coalesce(F.get("rule_ids", F.lit(0)), F.lit("OTHER-ABSTAIN")))
    return filled.withColumns({"gold_kind": F.col("_gold.kind"), "gold_high_stakes": F.coalesce("_gold.high_stakes", F.lit(False)), "scorable": scored & given, "flagged_out": flagged, "agrees": F.when(scored & ~F.col("abstains"), ours == flagged), "reason": F.when(F.col("abstains"), reason)}).drop("_name", "_gold")


def corpus_report(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: reports, all COUNTS and RATIOS, abstain_by_reason and confirm_by_rule (maps of counts).

    Rows are counted once, by reason and set of rules, of which there are few; all else is read from those counts. The number of
    reports is that of distinct ids, a pass over one column."""
    met = judged_rows(rows, gold)
    rules = F.when(~F.col("abstains") & F.col("needs_confirm"), F.array_sort(F.array_distinct("rule_ids")))
    counts = [F.count_if(F.coalesce(F.expr(c), F.lit(False))).alias(f"_{n}") for n, c in COUNTS.items()]
    by = met.groupBy("reason", rules.alias("rules")).agg(*counts)
    each = F.transform("rules", lambda r: F.struct(r.alias("rule"), F.col("_confirmed").alias("n")))
    whole = by.agg(
        *(F.coalesce(F.sum(f"_{n}"), F.lit(0)).alias(n) for n in COUNTS),
        F.coalesce(F.map_from_entries(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "_abstained")))), F.create_map().cast("map<string,bigint>")).alias("abstain_by_reason"),
        F.flatten(F.collect_list(each)).alias("_rules"),
    )
    named = F.array_sort(F.array_distinct(F.transform("_rules", lambda x: x["rule"])))
    total = lambda name: F.aggregate(F.filter("_rules", lambda x: x["rule"] == name), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    ratios = [F.try_divide(F.col(a), F.col(b)).alias(n) for n, (a, b) in RATIOS.items()]
    reports = rows.select("report_id").distinct().agg(F.count("report_id").alias("reports"))
    shown = whole.select(*COUNTS, *ratios, "abstain_by_reason", F.map_from_arrays(named, F.transform(named, total)).alias("confirm_by_rule"))
    return reports.crossJoin(F.broadcast(shown))  # a row each


def worst_rows(rows: DataFrame, gold: DataFrame, most: int = 12) -> DataFrame:
    """kind, place, name, detail: of each kind (chip-wrong, gold-unrecognized, confidently-wrong, disagreement) the first `most` by name and
    detail. The report's lists; each kind's first rows are kept in every task before they meet."""
    met = judged_rows(rows, gold)
    no = lambda c: F.coalesce(F.expr(COUNTS[c]), F.lit(False))
    shown = F.concat(F.trim("name"), F.lit(" "), F.coalesce("value_text", F.lit("")), F.lit(" (range "), F.coalesce("range_text", F.lit("")), F.lit(") flagged "), F.when(F.col("flagged_out"), "ABNORMAL").otherwise("normal"), F.lit(", classified "), F.coalesce("classification", F.lit("")))
    kinds = {"chip-wrong": "chip_wrong", "gold-unrecognized": "gold_high_stakes_unrecognized", "confidently-wrong": "confidently_wrong", "disagreement": "disagreements"}
    each = F.explode(F.array_compact(F.array(*(F.when(no(c), F.lit(k)) for k, c in kinds.items()))))
    listed = met.select(each.alias("kind"), F.trim("name").alias("name"), shown.alias("detail")).distinct()
    part = Window.partitionBy("kind", "_part").orderBy("name", "detail")
    local = listed.withColumn("_part", F.pmod(F.xxhash64("name", "detail"), F.lit(64))).withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= most)
    return local.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy("name", "detail"))).filter(F.col("place") <= most).select("kind", "place", "name", "detail")
