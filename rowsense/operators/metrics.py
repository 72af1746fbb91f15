"""Metrics of pipelines: agreement, calibration, abstention, severity and risk over coverage. Ratios without a base are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def agreement(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """n, observed agreement, prevalence, Cohen's kappa, Gwet's AC1, PABAK of two boolean raters; rows with a null rater don't count."""
    x = lambda c: c.cast("long")
    s = rows.filter(a.isNotNull() & b.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.sum(x(a)).alias("sa"), F.sum(x(b)).alias("sb"), F.sum(x(a == b)).alias("same"))
    po, pa, pb = F.col("same") / F.col("n"), F.col("sa") / F.col("n"), F.col("sb") / F.col("n")
    p, chance = (pa + pb) / 2, pa * pb + (1 - pa) * (1 - pb)
    gwet = 2 * p * (1 - p)
    return s.filter("n > 0").select("n", po.alias("observed"), p.alias("prevalence"), F.try_divide(po - chance, 1 - chance).alias("kappa"), F.try_divide(po - gwet, 1 - gwet).alias("ac1"), (2 * po - 1).alias("pabak"))


def reliability_bins(rows: DataFrame, score: Column, correct: Column, bins: int = 10) -> DataFrame:
    """bin, n, n_correct, score_sum for each of the bins, empty ones too. Scores are cut to 0..1; 1 is in the last bin."""
    cut = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    of = F.least(F.floor(cut * bins), F.lit(bins - 1)).cast("int")
    seen = rows.select(of.alias("bin"), correct.cast("long").alias("c"), cut.alias("s")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("n_correct"), F.sum("s").alias("score_sum"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(seen, "bin", "left").select("bin", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_correct", "score_sum")))


def calibration_error(bins: DataFrame) -> DataFrame:
    """ece: the mean distance of score and accuracy over bins, weighted by rows."""
    gap = F.abs(F.try_divide(F.col("n_correct"), F.col("n")) - F.try_divide(F.col("score_sum"), F.col("n")))
    return bins.agg(F.try_divide(F.sum(gap * F.col("n")), F.sum("n")).alias("ece"))


def abstention(rows: DataFrame, abstained: Column, should: Column, high_stakes: Column) -> DataFrame:
    """precision, recall, and recall over high-stakes rows."""
    n = lambda c: F.count_if(c)
    return rows.agg(F.try_divide(n(abstained & should), n(abstained)).alias("precision"), F.try_divide(n(abstained & should), n(should)).alias("recall"), F.try_divide(n(abstained & should & high_stakes), n(should & high_stakes)).alias("recall_high_stakes"))


def term_fidelity(rows: DataFrame, matched: Column, total: Column, emitted: Column) -> DataFrame:
    use = emitted & (total > 0)
    return rows.agg(F.try_divide(F.sum(F.when(use, matched)), F.sum(F.when(use, total))).alias("fidelity"))


def severity_fidelity(rows: DataFrame, missed: dict[str, Column], total: dict[str, Column], high_stakes: Column) -> DataFrame:
    """1 - penalties / most penalties. A number weighs 5, of a high-stakes row 25; all else 25."""
    weight = lambda k: F.when(high_stakes, 25).otherwise(5) if k == "numbers" else F.lit(25)
    total_of = lambda d: sum((F.coalesce(c, F.lit(0)) * weight(k) for k, c in d.items()), F.lit(0))
    return rows.agg((1 - F.try_divide(F.sum(total_of(missed)), F.sum(total_of(total)))).alias("severity_fidelity"))


def field_recall(gold: DataFrame, predicted: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """field, hits, gold: gold rows whose last prediction (by order) has the field's value. Null equals null."""
    last = predicted.groupBy(key).agg(*(F.max_by(F.struct(f), order)[f].alias(f"_{f}") for f in fields), F.lit(True).alias("_there"))
    hits = gold.join(last, key, "left").agg(F.count(F.lit(1)).alias("gold"), *(F.count_if(F.col("_there").isNotNull() & F.col(f).eqNullSafe(F.col(f"_{f}"))).alias(f) for f in fields))
    return hits.select("gold", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("hits")) for f in fields))).alias("x")).select("x.field", "x.hits", "gold")


def risk_coverage(rows: DataFrame, score: str, error: Column, position: str, parts: int = 1024) -> DataFrame:
    """position, k, errors, n: rows by score (0..1, descending, ties by position), the errors among the first k, all rows.

    The order is cut into `parts` stretches of scores, so no task sees all rows: sums of stretches, then sums within."""
    part = F.floor(F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0)) * (parts - 1))
    cut = rows.select(F.col(score).alias("score"), F.col(position).alias("position"), error.cast("long").alias("error"), part.alias("part"))
    sums = cut.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("error").alias("e"))
    before = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    offsets = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("k0"), F.coalesce(F.sum("e").over(before), F.lit(0)).alias("e0"), F.sum("n").over(Window.partitionBy()).alias("n"))
    within = Window.partitionBy("part").orderBy(F.desc("score"), "position").rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(offsets, "part").select("position", "part", (F.col("k0") + F.row_number().over(within)).alias("k"), (F.col("e0") + F.sum("error").over(within)).alias("errors"), "n")


def aurc(curve: DataFrame) -> DataFrame:
    """The area under risk over coverage by trapezoids, from coverage 0 at the first point's risk: a term for each k needs
    its own errors and the ones before, which the error of row k gives without a second order."""
    risk = F.col("errors") / F.col("k")
    steps = curve.select("k", "n", risk.alias("risk")).withColumn("weight", F.when(F.col("k") == 1, 1.5).when(F.col("k") == F.col("n"), 0.5).otherwise(1.0))
    weight = F.when(F.col("n") == 1, 1.0).otherwise(F.col("weight"))
    return steps.agg((F.sum(F.col("risk") * weight) / F.max("n")).alias("aurc"))
