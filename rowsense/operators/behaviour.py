"""Behavioural cases: what must not change under a perturbation, and what must be said; and confirmed edits.

A perturbation is a patch of some fields of its case. Patched cases are rows beside their own, so that whatever judges them runs
once over all; verdicts are then compared within each case by one aggregate. Confirmed edits change reports, and only those are
judged again.

Defined results: a case without perturbations is invariant; a perturbation of no case says nothing; a patch may set a field to
null by holding the name with a null value; of the perturbations that change a verdict the first by name tells; an edit of a row that
isn't there does nothing, of two edits of a row the last by `at` holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def perturbed(cases: DataFrame, perturbations: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """cases, and a row for each of their perturbations (case, name, patch: a map of fields to texts), with the column
    perturbation: null for the case itself."""
    own = cases.withColumn("perturbation", F.lit(None).cast("string"))
    patches = perturbations.select(F.col("case").alias("_case"), F.col("name").alias("_name"), F.col("patch").alias("_patch"))
    met = cases.join(patches, F.col(key) == F.col("_case"))
    kinds = dict(cases.dtypes)
    new = {f: F.when(F.map_contains_key("_patch", f), F.try_element_at("_patch", F.lit(f)).cast(kinds[f])).otherwise(F.col(f)) for f in fields}
    return own.unionByName(met.withColumns(new).withColumn("perturbation", F.col("_name")).select(*cases.columns, "perturbation"))


def run_cases(cases: DataFrame, perturbations: DataFrame, fields: list[str], judge: Callable[[DataFrame], DataFrame], key: str = "id") -> DataFrame:
    """id, test_type, expected, actual, passed, detail of each case (id, test_type: INV, MFT or DIR, expected, and the fields).

    judge gives its rows back with verdict and class. An INV case passes if no perturbation changes either; others if their
    verdict is the expected one."""
    invariant = F.col("test_type") == "INV"
    every = cases.filter(F.coalesce(~invariant, F.lit(True))).withColumn("perturbation", F.lit(None).cast("string")).unionByName(perturbed(cases.filter(invariant), perturbations, fields, key))
    told = judge(every).select(F.col(key).alias("id"), "test_type", "expected", "perturbation", F.struct("verdict", "class").alias("said"))
    base = F.any_value(F.when(F.col("perturbation").isNull(), F.col("said")), True)
    of = told.groupBy("id", "test_type", "expected").agg(base.alias("base"), F.count("perturbation").alias("tried"))
    changed = told.filter("perturbation IS NOT NULL").join(of.select(F.col("id").alias("_id"), F.col("base").alias("_base")), F.col("id") == F.col("_id")).filter(~F.col("said").eqNullSafe(F.col("_base")))
    first = changed.groupBy(F.col("id").alias("_id")).agg(F.min(F.struct("perturbation", "said")).alias("broken"))
    met = of.join(first, F.col("id") == F.col("_id"), "left")
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    b, s = F.col("base"), F.col("broken.said")
    detail = F.concat(F.lit('perturbation "'), F.col("broken.perturbation"), F.lit('" changed verdict '), shown(b["verdict"]), F.lit("→"), shown(s["verdict"]), F.lit(" / class "), shown(b["class"]), F.lit("→"), shown(s["class"]))
    actual = F.when(invariant & F.col("broken").isNotNull(), s["verdict"]).otherwise(b["verdict"])
    passed = F.when(invariant, F.col("broken").isNull()).otherwise(F.coalesce(b["verdict"] == F.col("expected"), F.lit(False)))
    return met.select("id", "test_type", F.when(invariant, "invariant").otherwise(F.col("expected")).alias("expected"), actual.alias("actual"), passed.alias("passed"), F.when(invariant, detail).alias("detail"))


def reground(rows: DataFrame, grounded: DataFrame, edits: DataFrame, ground: Callable[[DataFrame], DataFrame], fields: list[str], report: str = "report_id", row: str = "ord") -> DataFrame:
    """grounded again where edits change a report: ground() runs over all rows of changed reports only, the others are taken
    as they were. edits: report, row, at, and the fields' new values (nulls too); rows are ground()'s inputs."""
    last = edits.groupBy(report, row).agg(F.max_by(F.struct(*fields), "at").alias("_new"))
    changed = last.select(report).distinct()
    theirs = rows.join(changed, report, "left_semi").join(last, [report, row], "left")
    edited = theirs.withColumns({f: F.when(F.col("_new").isNotNull(), F.col(f"_new.{f}")).otherwise(F.col(f)) for f in fields}).select(*rows.columns)
    return grounded.join(changed, report, "left_anti").unionByName(ground(edited).select(*grounded.columns))
