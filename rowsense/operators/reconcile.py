"""Reconciling two versions of rows: collisions, drift, completeness, double review, order within a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collisions(rows: DataFrame, text: Column, row_id: str) -> DataFrame:
    """hash, ids (sorted) of texts that more than one id has. Texts travel as hashes, and unique ones end early."""
    thin = rows.select(F.sha2(text, 256).alias("hash"), F.col(row_id).alias("id")).filter("hash is not null")
    many = thin.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash")
    return thin.join(many, "hash").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter("n > 1")


def drift(locked: DataFrame, current: DataFrame, key: str, text: str) -> DataFrame:
    """key and kind: missing (only locked), orphan (only current) or drift (another hash)."""
    a, b = locked.select(key, F.sha2(F.coalesce(text, F.lit("")), 256).alias("_a")), current.select(key, F.sha2(F.coalesce(text, F.lit("")), 256).alias("_b"))
    kind = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "orphan").when(F.col("_a") != F.col("_b"), "drift")
    return a.join(b, key, "full_outer").select(key, kind.alias("kind")).filter("kind is not null")


def completeness(expected: DataFrame, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key and problem: only-a, only-b, fabricated (in either, not expected), missing (in neither)."""
    flag = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    met = flag(expected, "_e").join(flag(a, "_a"), key, "full_outer").join(flag(b, "_b"), key, "full_outer")
    e, x, y = (F.col(c).isNotNull() for c in ("_e", "_a", "_b"))
    problem = F.when(~e, "fabricated").when(~x & ~y, "missing").when(~y, "only-a").when(~x, "only-b")
    return met.select(key, problem.alias("problem")).filter("problem is not null")


def double_review(a: DataFrame, b: DataFrame, key: str, context: str, answer: str) -> DataFrame:
    """key and outcome of two reviewers' answers: context-mismatch, skipped, coverage-mismatch, agreed or disagreement."""
    canon = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    x = a.select(key, F.col(context).alias("_ca"), canon(F.col(answer)).alias("_a"))
    y = b.select(key, F.col(context).alias("_cb"), canon(F.col(answer)).alias("_b"))
    empty = lambda c: F.col(c).isNull()
    outcome = F.when(~F.col("_ca").eqNullSafe(F.col("_cb")), "context-mismatch").when(empty("_a") & empty("_b"), "skipped").when(empty("_a") | empty("_b"), "coverage-mismatch").when(F.col("_a") == F.col("_b"), "agreed").otherwise("disagreement")
    return x.join(y, key).select(key, outcome.alias("outcome"))


def said(text: Column, otherwise: Column) -> Column:
    """A reviewer's word as a boolean: true for "true" in any case, the given value where it is empty."""
    return F.when(F.coalesce(text, F.lit("")) == "", otherwise).otherwise(F.lower(F.trim(text)) == "true")


def merge_verdicts(rows: DataFrame, verdicts: DataFrame, key: str, texts: list[str], booleans: list[str] = [], reason: str | None = None, reasons: list[str] = [], when: str | None = None) -> DataFrame:  # noqa: B006
    """rows whose fields take a verdict's words, of several for one key the last by all its columns.

    texts take what isn't blank, as it is written; booleans keep their type. reason takes one of reasons, keeps its own
    where none is given, and is cleared where the boolean `when` doesn't hold. Rows without a verdict stay as they are."""
    fields = [*texts, *booleans, *([reason] if reason else [])]
    last = verdicts.groupBy(key).agg(F.max(F.struct(*(F.col(f).cast("string").alias(f) for f in fields))).alias("_verdict")).withColumnRenamed(key, "_key")
    met = rows.join(last, F.col(key) == F.col("_key"), "left")
    word = lambda f: F.col("_verdict").getField(f)
    new = {f: F.when(F.trim(word(f)) != "", word(f)).otherwise(F.col(f)) for f in texts}
    new |= {f: said(word(f), F.col(f)) for f in booleans}
    if reason:
        given = F.when(F.trim(word(reason)).isin(reasons), F.trim(word(reason)))
        kept = F.coalesce(given, F.col(reason))
        new[reason] = F.when(F.col("_key").isNull(), F.col(reason)).otherwise(F.when(new[when], kept) if when else kept)
    return met.select(*(new[c].alias(c) if c in new else F.col(c) for c in rows.columns))


def occurrence(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with ordinal: the row's place within by, from 0."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def overlapping(rows: DataFrame, by: list[str], start: str, end: str, order: list[str]) -> DataFrame:
    """rows that begin before the row before them, by start, has ended."""
    w = Window.partitionBy(*by).orderBy(start, *order)
    return rows.withColumn("_end", F.lag(end).over(w)).filter(F.col(start) < F.col("_end")).drop("_end")


def duplicate_keys(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that stand more than once: an error for strict inputs."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
