"""Queries over evaluation: chains of fallbacks, behavioural cases, confirmed edits, the corpus report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import behaviour, evaluation
from .registry import query, table


@query("""WITH c AS (SELECT p_partkey AS id, p_partkey % 11 AS k, p_partkey % 13 = 0 AS rounds, p_name FROM part), r AS (SELECT *, unnest(range(k + 1)) AS i FROM c)
SELECT id, 'l' || i AS lang, CASE WHEN NOT rounds THEN p_name END AS text, NOT rounds AND i = k AS verified, (CASE WHEN rounds THEN k + 2 ELSE k - i + 1 END)::INTEGER AS steps, rounds AS fails FROM r""")
def fallback_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part is a chain of up to eleven languages, the last of which has its name; some chains are rounds."""
    k, rounds = (F.col("p_partkey") % 11).cast("int"), F.col("p_partkey") % 13 == 0
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), k.alias("k"), rounds.alias("rounds"), "p_name", F.explode(F.sequence(F.lit(0), k)).alias("i"))
    last = F.col("i") == F.col("k")
    texts = rows.select("id", F.concat(F.lit("l"), "i").alias("lang"), F.when(last & ~F.col("rounds"), F.col("p_name")).alias("text"), F.when(~last, F.concat(F.lit("l"), F.col("i") + 1)).when(F.col("rounds"), "l0").alias("fallback"), F.lit(True).alias("verified"))
    return evaluation.resolved_texts(texts).select("id", "lang", "text", "verified", F.size("path").alias("steps"), F.col("error").isNotNull().alias("fails"))


@query("""WITH c AS (SELECT o_orderkey % 3 AS t, o_orderkey % 2 = 0 AS patched, o_totalprice AS v, o_totalprice * 2 AS w, CASE WHEN o_custkey % 2 = 0 THEN 'flag' ELSE 'render' END AS expected FROM orders),
j AS (SELECT *, CASE WHEN v > 300000 THEN 'abstain' WHEN v > 150000 THEN 'flag' ELSE 'render' END AS said, CASE WHEN w > 300000 THEN 'abstain' WHEN w > 150000 THEN 'flag' ELSE 'render' END AS again FROM c)
SELECT CASE t WHEN 0 THEN 'INV' WHEN 1 THEN 'MFT' ELSE 'DIR' END AS test_type, CASE WHEN t = 0 AND patched AND said <> again THEN again ELSE said END AS actual, CASE WHEN t = 0 THEN NOT (patched AND said <> again) ELSE said = expected END AS passed, count(*)::BIGINT AS n FROM j GROUP BY 1, 2, 3""")
def behaviour_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases; a note's change must not matter, a doubled price does where it crosses a bar."""
    test = F.when(F.col("o_orderkey") % 3 == 0, "INV").when(F.col("o_orderkey") % 3 == 1, "MFT").otherwise("DIR")
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), test.alias("test_type"), F.when(F.col("o_custkey") % 2 == 0, "flag").otherwise("render").alias("expected"), F.col("o_totalprice").alias("value"), F.lit("n").alias("note"))
    each = F.array(F.struct(F.lit("noted").alias("name"), F.create_map(F.lit("note"), F.lit("m")).alias("patch")), F.struct(F.lit("doubled").alias("name"), F.create_map(F.lit("value"), (F.col("value") * 2).cast("string")).alias("patch")))
    patches = cases.select(F.col("id").alias("case"), F.explode(F.when(F.col("id") % 2 == 0, each).otherwise(F.slice(each, 1, 1))).alias("p")).select("case", "p.*")
    verdict = F.when(F.col("value") > 300000, "abstain").when(F.col("value") > 150000, "flag").otherwise("render")
    told = behaviour.run_cases(cases, patches, ["value", "note"], lambda rows: rows.withColumn("verdict", verdict).withColumn("class", F.lit(None).cast("string")))
    return told.groupBy("test_type", "actual", "passed").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT o_custkey AS report_id, o_orderkey AS ord, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice / 4 ELSE o_totalprice END AS value FROM orders)
SELECT report_id, ord, value, value = max(value) OVER (PARTITION BY report_id) AS largest FROM e""")
def confirmed_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders are a report; a tenth of the orders are edited twice. Which is the largest is told for changed reports anew."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("report_id"), F.col("o_orderkey").alias("ord"), F.col("o_totalprice").alias("value"))

    def ground(of: DataFrame) -> DataFrame:
        top = of.groupBy(F.col("report_id").alias("_r")).agg(F.max("value").alias("_top"))
        return of.join(top, F.col("report_id") == F.col("_r")).select("report_id", "ord", "value", (F.col("value") == F.col("_top")).alias("largest"))

    edited = rows.filter("ord % 10 = 0")
    edits = edited.select("report_id", "ord", F.lit(1).alias("at"), (F.col("value") * 3).alias("value")).unionByName(edited.select("report_id", "ord", F.lit(2).alias("at"), (F.col("value") / 4).alias("value")))
    return behaviour.reground(rows, ground(rows), edits, ground, ["value"])


#: A row of a report, in both dialects.
REPORT_ROW = """SELECT l_orderkey % 1000 AS report_id, concat(' N', cast(l_partkey % 40 as string), ' ') AS name, CASE WHEN l_partkey % 7 <> 0 THEN 'k' END AS key, CASE WHEN l_suppkey % 9 <> 0 THEN '5' ELSE ' ' END AS value_text,
  CASE WHEN l_suppkey % 6 <> 0 THEN l_quantity END AS value, CASE WHEN l_linenumber % 5 <> 0 THEN '1-9' ELSE '' END AS range_text, CASE l_suppkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN '' END AS flag, l_partkey % 3 <> 0 AS asserted, l_quantity > 25 AS said_out,
  l_partkey % 4 = 0 AS entry_high_stakes, l_suppkey % 5 = 0 AS needs_confirm, l_suppkey % 11 = 0 AS needs_review, l_partkey % 7 = 0 OR l_suppkey % 6 = 0 OR l_linenumber = 7 AS abstains,
  CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity > 40 THEN 'high' WHEN l_quantity < 12 THEN 'unclassified' ELSE 'normal' END AS classification, CASE l_linenumber % 4 WHEN 0 THEN 'R3' WHEN 1 THEN 'R3,R5' WHEN 2 THEN 'R11' END AS rules FROM lineitem"""


@query(f"""WITH r AS ({REPORT_ROW.replace('string', 'varchar')}), g AS (SELECT 'N' || i AS name, CASE WHEN i % 3 = 0 THEN 'non-analyte' ELSE 'analyte' END AS gold_kind, i % 2 = 0 AS gold_high_stakes FROM range(30) t(i)),
j AS (SELECT r.*, gold_kind, coalesce(gold_high_stakes, false) AS gold_high_stakes, coalesce(flag IN ('0', '1'), false) AND trim(value_text) <> '' AND trim(range_text) <> '' AS scorable, flag = '1' AS flagged_out,
  CASE WHEN flag IN ('0', '1') AND NOT abstains THEN CASE classification WHEN 'normal' THEN false WHEN 'unclassified' THEN NULL ELSE true END = (flag = '1') END AS agrees,
  CASE WHEN abstains THEN CASE WHEN key IS NULL THEN 'R1-UNKNOWN-ANALYTE' WHEN value IS NULL THEN 'NON-NUMERIC-VALUE' ELSE coalesce(string_split(rules, ',')[1], 'OTHER-ABSTAIN') END END AS reason FROM r LEFT JOIN g ON trim(r.name) = g.name),
c AS (SELECT count(DISTINCT report_id)::BIGINT AS reports, {", ".join(f"count(*) FILTER (coalesce({c}, false))::BIGINT AS {n}" for n, c in evaluation.COUNTS.items())} FROM j),
a AS (SELECT string_agg(reason || ':' || n, ',' ORDER BY reason) AS abstain_by_reason FROM (SELECT reason, count(*) AS n FROM j WHERE reason IS NOT NULL GROUP BY 1)),
b AS (SELECT string_agg(rule || ':' || n, ',' ORDER BY rule) AS confirm_by_rule FROM (SELECT unnest(string_split(rules, ',')) AS rule, count(*) AS n FROM j WHERE NOT abstains AND needs_confirm GROUP BY 1))
SELECT c.*, {", ".join(f"{x} / {y} AS {n}" for n, (x, y) in evaluation.RATIOS.items())}, abstain_by_reason, confirm_by_rule FROM c, a, b""")
def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as rows of a thousand reports, forty names of which thirty have gold labels."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("_report_lineitem")
    rows = spark.sql(REPORT_ROW.replace("FROM lineitem", "FROM _report_lineitem")).withColumn("rule_ids", F.split("rules", ","))
    gold = spark.range(30).select(F.concat(F.lit("N"), "id").alias("name"), F.when(F.col("id") % 3 == 0, "non-analyte").otherwise("analyte").alias("kind"), (F.col("id") % 2 == 0).alias("high_stakes"))
    shown = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias(c)
    return evaluation.corpus_report(rows, gold).select("reports", *evaluation.COUNTS, *evaluation.RATIOS, shown("abstain_by_reason"), shown("confirm_by_rule"))
