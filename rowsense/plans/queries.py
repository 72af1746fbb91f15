"""The queries over the driver's tables and their SQL.

Observation rows come from lineitem and part by expressions that both engines read alike; what is tested is the library's
reading of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals, parse, text
from ..operators import entities, evaluation, fidelity, geometry, lookup, metrics, notes, quality, reconcile, rules, wellformed
from ..streaming import limits
from .registry import ORACLE_SQL, QUERIES, query, table  # noqa: F401

#: Derived columns, the same text for Spark and SQL.
QUANTITY = "cast(cast(l_quantity as int) as string)"
VALUE = f"concat({QUANTITY}, case l_partkey % 9 when 0 then ' H' when 1 then '↑' when 2 then 'x' when 3 then '.5' when 4 then '.' when 5 then '\u3000' when 6 then '\u00a0h' else '' end)"
RANGE = "case l_suppkey % 9 when 0 then '5-30' when 1 then '<20' when 2 then '>= 10' when 3 then '10 ~ 40' when 4 then '-3.0--1.0' when 5 then '0--25' when 6 then '≤15' when 7 then '25–12' else '' end"
UNIT = "case l_partkey % 5 when 0 then 'mg/dL' when 1 then ' MG / dl' when 2 then 'µmol/L' when 3 then '(μmol/l)' else '*10^9/L' end"
FLAG = "case event_id % 14 when 0 then ' H ' when 1 then '↓' when 2 then 'H/L' when 3 then 'abnormal' when 4 then '(low)' when 5 then 'L-H' when 6 then 'HH' when 7 then '高' when 8 then 'x' when 9 then '*H' when 10 then ' * ' when 11 then '增高' when 12 then '【减低】' else 'H?' end"
QUALITY = "case o_orderkey % 14 when 0 then ' Negative' when 1 then 'POS' when 2 then '±' when 3 then 'Not  Detected' when 4 then '阴性' when 5 then 'reactive' when 6 then 'maybe' when 7 then 'trace' when 8 then '++' when 9 then '未检出' when 10 then 'Absent' when 11 then '+/-' when 12 then '检出' else 'nil' end"
SEX = "case l_returnflag when 'R' then 'male' when 'A' then 'female' else 'unknown' end"

N = parse.NUMBER
BARE = "regexp_replace(r, '\\s', '', 'g')"
TWO = ", ".join(f"{{'lo': try_cast(nullif(regexp_extract(b, '^({N}){s}({N})$', 1), '') as double), 'hi': try_cast(nullif(regexp_extract(b, '^({N}){s}({N})$', 2), '') as double)}}" for s in ("--", "[-~–—]"))
RANGE_SQL = f"""
r0 AS (SELECT *, {RANGE} AS r FROM lineitem), r1 AS (SELECT *, {BARE} AS b FROM r0),
r2 AS (SELECT *, list_distinct(list_filter([{TWO}], lambda p: p.lo <= p.hi)) AS two,
  try_cast(nullif(regexp_extract(b, '^<({N})$', 1), '') as double) AS lt, try_cast(nullif(regexp_extract(b, '^(?:<=|≤)({N})$', 1), '') as double) AS le,
  try_cast(nullif(regexp_extract(b, '^>({N})$', 1), '') as double) AS gt, try_cast(nullif(regexp_extract(b, '^(?:>=|≥)({N})$', 1), '') as double) AS ge FROM r1),
r3 AS (SELECT *, len(two) AS readings, CASE WHEN len(two) = 1 THEN two[1].lo WHEN len(two) = 0 THEN coalesce(gt, ge) END AS low, CASE WHEN len(two) = 1 THEN two[1].hi WHEN len(two) = 0 THEN coalesce(lt, le) END AS high,
  len(two) = 0 AND lt IS NOT NULL AS high_open, len(two) = 0 AND gt IS NOT NULL AS low_open FROM r2)"""


@query(f"""WITH {RANGE_SQL}
SELECT l_returnflag, CASE WHEN low IS NULL AND high IS NULL THEN 'none' WHEN l_quantity < low OR (low_open AND l_quantity = low) THEN 'below'
  WHEN l_quantity > high OR (high_open AND l_quantity = high) THEN 'above' ELSE 'within' END AS status, count(*)::BIGINT AS n FROM r3 GROUP BY 1, 2""")
def printed_range_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse.with_ranges(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", F.expr(RANGE).alias("r")), "r")
    return rows.groupBy("l_returnflag", intervals.status(F.col("l_quantity"), F.col("of")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RANGE_SQL} SELECT l_suppkey % 9 AS kind, readings::INT AS readings, count(*)::BIGINT AS n FROM r3 GROUP BY 1, 2")
def printed_range_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy((F.col("l_suppkey") % 9).alias("kind"), F.size(parse.range_readings(F.expr(RANGE))).alias("readings")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {RANGE_SQL}, v AS (SELECT *, l_quantity AS a, l_quantity + 5 AS z FROM r3)
SELECT CASE WHEN low IS NULL OR high IS NULL THEN 'none' WHEN a >= low AND z <= high THEN 'within' WHEN z < low THEN 'below' WHEN a > high THEN 'above' ELSE 'none' END AS status, count(*)::BIGINT AS n FROM v GROUP BY 1""")
def range_vs_range_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = parse.parse_value_range(F.expr(f"concat({QUANTITY}, '-', cast(cast(l_quantity as int) + 5 as string))"))
    rows = table(spark, sf_dir, "lineitem").select(value.alias("v"), parse.parse_range(F.expr(RANGE)).alias("of"))
    return rows.groupBy(intervals.status_range(F.col("v"), F.col("of")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH v AS (SELECT l_partkey % 9 AS kind, {VALUE} AS t FROM lineitem)
SELECT kind, count(*) FILTER (kind IN (3, 5, 7, 8))::BIGINT AS strict, count(*) FILTER (kind NOT IN (2, 4))::BIGINT AS lenient, count(*)::BIGINT AS n FROM v GROUP BY 1""")
def scalar_parse_strictness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 9).alias("kind"), F.expr(VALUE).alias("t"))
    return rows.groupBy("kind").agg(F.count(parse.parse_value(F.col("t"))).alias("strict"), F.count(parse.parse_scalar(F.col("t"))).alias("lenient"), F.count(F.lit(1)).alias("n"))


QUALITY_SQL = "CASE WHEN q IN ('absent', 'negative', 'not detected', 'nil', '-', '阴性', '未检出') THEN 'negative' WHEN q IN ('present', 'positive', '+', '++', '+++', '阳性', '检出') THEN 'positive' WHEN q IN ('trace', '±', '+/-', '微量') THEN 'trace' END"


@query(f"""WITH q AS (SELECT o_orderstatus, lower(trim(regexp_replace({QUALITY}, '\\s+', ' ', 'g'))) AS q FROM orders), p AS (SELECT o_orderstatus, {QUALITY_SQL} AS v FROM q)
SELECT o_orderstatus, CASE WHEN v IS NULL THEN 'none' WHEN v = 'negative' THEN 'within' ELSE 'outside' END AS status, count(*)::BIGINT AS n FROM p GROUP BY 1, 2""")
def qualitative_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = intervals.status_qualitative(parse.parse_qualitative(F.expr(QUALITY)), F.lit("negative"))
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, CASE WHEN event_id % 14 IN (0, 7, 11) THEN 'high' WHEN event_id % 14 IN (1, 4, 12) THEN 'low' WHEN event_id % 14 IN (2, 5, 10) THEN 'abnormal' END AS direction, count(*)::BIGINT AS n FROM events GROUP BY 1, 2""")
def printed_flag_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", parse.flag_direction(F.expr(FLAG)).alias("direction")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH u AS (SELECT l_partkey % 5 AS kind, l_quantity FROM lineitem)
SELECT CASE WHEN kind IN (0, 1) THEN 'mg/dl' WHEN kind IN (2, 3) THEN 'umol/l' ELSE 'x10^9/l' END AS unit, translate(CASE WHEN kind IN (0, 1) THEN 'mg/dl' WHEN kind IN (2, 3) THEN 'umol/l' ELSE 'x10^9/l' END, 'io', 'l0') AS unit_key, count(*)::BIGINT AS n FROM u GROUP BY 1, 2""")
def unit_key_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.expr(UNIT).alias("u"))
    return rows.groupBy(text.norm_unit(F.col("u")).alias("unit"), text.unit_key(F.col("u")).alias("unit_key")).agg(F.count(F.lit(1)).alias("n"))


SCANNED = "case l_partkey % 7 when 0 then 'mg/dL' when 1 then 'mg/dI' when 2 then ' g/L' when 3 then 'g/i' when 4 then 'µmol/l' when 5 then 'umo1/L' else 'mmol/L' end"


@query(f"""WITH u AS (SELECT DISTINCT lower(replace(replace({SCANNED}, ' ', ''), 'µ', 'u')) AS unit FROM lineitem)
SELECT translate(unit, 'io', 'l0') AS unit_key, array_to_string(list_sort(list(unit)), ' ') AS units FROM u GROUP BY 1 HAVING count(*) > 1""")
def unit_key_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "lineitem").select(F.expr(SCANNED).alias("unit"))
    return lookup.unit_collisions(units).select("unit_key", F.array_join("units", " ").alias("units"))


@query("""SELECT p_brand, count(*) FILTER (l_partkey % 5 IN (0, 1))::BIGINT AS converted, coalesce(sum(CASE WHEN l_partkey % 5 IN (0, 1) THEN l_quantity * 4 END), 0)::BIGINT AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    factors = parts.select(F.col("p_brand").alias("key"), F.lit("mg/dl").alias("from_unit"), F.lit("mmol/l").alias("to_unit"), F.lit(4.0).alias("factor")).distinct()
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_quantity").alias("value"), F.expr(UNIT).alias("unit")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    done = lookup.convert(rows.withColumnRenamed("p_brand", "key"), factors)
    return done.groupBy(F.col("key").alias("p_brand")).agg(F.count("converted").alias("converted"), F.coalesce(F.sum("converted"), F.lit(0)).cast("long").alias("total"))


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry per part name: key, names (the name in capitals with brackets), specimen, ord."""
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.max("p_size").alias("_s")).select(F.col("p_name").alias("key"), F.array(F.upper("p_name"), F.concat(F.lit("["), F.col("p_name"), F.lit("]"))).alias("names"), F.when(F.col("_s") % 2 == 0, "blood").otherwise("urine").alias("specimen"), F.col("_s").alias("ord"))


PRINTED = "case p_partkey % 4 when 0 then upper(p_name) when 1 then concat(p_name, ' (serum)') when 2 then concat('x', p_name) else concat(' ', p_name, '.') end"


@query(f"""WITH n AS (SELECT p_name, p_partkey, lower(replace(p_name, ' ', '')) AS own, regexp_replace(lower(replace({PRINTED}, ' ', '')), '[:.,()\\[\\]]', '', 'g') AS token FROM part), d AS (SELECT DISTINCT lower(replace(p_name, ' ', '')) AS token FROM part)
SELECT p_partkey % 4 AS kind, count(d.token)::BIGINT AS matched, count(*)::BIGINT AS n FROM n LEFT JOIN d USING (token) GROUP BY 1""")
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(PRINTED).alias("name"))
    return lookup.alias_lookup(rows, dimension(spark, sf_dir)).groupBy((F.col("p_partkey") % 4).alias("kind")).agg(F.count("key").alias("matched"), F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT p_name, max(p_size) AS s FROM part GROUP BY 1)
SELECT p_partkey % 2 AS kind, count(*) FILTER ((s % 2 = 0) = (p_partkey % 2 = 0))::BIGINT AS matched, count(*)::BIGINT AS n FROM part JOIN s USING (p_name) GROUP BY 1""")
def scoped_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 2 == 0, "blood").otherwise("urine").alias("specimen"))
    return lookup.scoped_lookup(rows, dimension(spark, sf_dir)).groupBy((F.col("p_partkey") % 2).alias("kind")).agg(F.count("key").alias("matched"), F.count(F.lit(1)).alias("n"))


ASKED = "case p_partkey % 5 when 0 then upper(p_name) when 1 then concat('血清', p_name, '测定') when 2 then 'none such here' when 3 then concat(' ', p_name, '.') else concat(p_name, '（尿）') end"


@query("""WITH s AS (SELECT p_name, max(p_size) AS s FROM part GROUP BY 1), x AS (
  SELECT p_partkey % 5 AS kind, CASE p_partkey % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'blood' ELSE 'urine' END AS given, CASE WHEN s % 2 = 0 THEN 'blood' ELSE 'urine' END AS own, s % 3 = 0 AS scoped FROM part JOIN s USING (p_name)),
y AS (SELECT *, CASE kind WHEN 1 THEN 'blood' WHEN 4 THEN 'urine' END AS told FROM x), z AS (SELECT *, coalesce(told, given) AS e FROM y)
SELECT kind, CASE WHEN kind = 2 OR (told IS NOT NULL AND given <> 'unknown' AND told <> given) THEN 'unmatched' WHEN e = 'unknown' THEN 'direct' WHEN e <> own THEN 'unmatched'
  WHEN scoped THEN 'scoped' WHEN told IS NOT NULL THEN 'candidate' ELSE 'direct' END AS matched_by, count(*)::BIGINT AS n FROM z GROUP BY 1, 2""")
def lookup_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    specimen = F.when(F.col("p_partkey") % 3 == 0, "unknown").when(F.col("p_partkey") % 3 == 1, "blood").otherwise("urine")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(ASKED).alias("name"), specimen.alias("specimen"))
    scoped = F.when(F.col("ord") % 3 == 0, F.array("key")).otherwise(F.array().cast("array<string>"))
    return lookup.lookup_cascade(rows, dimension(spark, sf_dir).withColumn("scoped_names", scoped)).groupBy((F.col("p_partkey") % 5).alias("kind"), "matched_by").agg(F.count(F.lit(1)).alias("n"))


BOUNDS_SQL = "CASE WHEN l_returnflag = 'R' THEN p_size % 10 + 5 WHEN l_returnflag = 'A' THEN p_size % 10 + 3 ELSE p_size % 10 + 3 END AS low, CASE WHEN l_returnflag = 'R' THEN p_size % 10 + 30 WHEN l_returnflag = 'A' THEN p_size % 10 + 25 ELSE p_size % 10 + 30 END AS high"


@query(f"""WITH b AS (SELECT *, {BOUNDS_SQL} FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_returnflag, CASE WHEN l_quantity < 3 THEN 'critical-low' WHEN l_quantity > 45 THEN 'critical-high' WHEN l_quantity < low THEN 'low' WHEN l_quantity > high THEN 'high' ELSE 'normal' END AS classification, count(*)::BIGINT AS n FROM b GROUP BY 1, 2""")
def bounds_sex_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    sex, s = F.expr(SEX), F.col("p_size") % 10
    by_sex = lambda male, female, either: F.when(sex == "male", male).when(sex == "female", female).otherwise(either(male, female))
    low, high = by_sex(s + 5, s + 3, F.least), by_sex(s + 30, s + 25, F.greatest)
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey", "l_quantity").join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("l_returnflag", intervals.classify(F.col("l_quantity"), low, high, F.lit(3), F.lit(45)).alias("classification")).agg(F.count(F.lit(1)).alias("n"))


#: Rows of lineitem in a part that meets parts.
JOINED_A_PART = 1_000_000


def ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with what the rules ask for."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    d = lambda x: F.lit(float(x))
    ours = F.struct((F.col("p_size") % 10 + 5).cast("double").alias("low"), (F.col("p_size") % 10 + 30).cast("double").alias("high"), F.lit(False).alias("low_open"), F.lit(False).alias("high_open"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    printed = lambda of: of.select("*", F.expr(VALUE).alias("text"), F.expr(RANGE).alias("range_text"), F.expr(UNIT).alias("unit"))
    # What is printed is made after the join, which so moves keys and numbers alone, in parts that don't grow with the table.
    parted = lines.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // JOINED_A_PART)), "l_partkey")
    rows = printed(parted.join(parts, F.col("l_partkey") == F.col("p_partkey")))
    # Values print with few endings, so they too are parsed once a text.
    texts = parse.few(printed(lines).select(F.col("text").alias("_t")).distinct()).select("_t", parse.parse_scalar(F.col("_t")).alias("value"))
    rows = parse.with_ranges(rows, "range_text", "printed", printed(lines)).join(texts, F.col("text") == F.col("_t"), "left").drop("_t")
    allowed = F.when(F.col("l_partkey") % 7 == 0, F.array(F.lit("IU/L"))).otherwise(F.array(F.lit("mg/dl"), F.lit("umol/l"), F.lit("x10^9/l")))
    negative = F.when(F.col("l_partkey") % 3 == 0, -F.col("value")).otherwise(F.col("value"))
    entries = rows.select(
        "l_returnflag", F.col("l_suppkey").alias("supplier"), "text", "range_text", "unit", negative.alias("value"), "printed", ours.alias("ours"), allowed.alias("allowed_units"), F.lit(False).alias("unit_optional"), F.lit("mg/dl").alias("entry_unit"),
        F.when(F.col("l_partkey") % 11 != 0, F.col("p_name")).alias("key"), (F.col("l_partkey") % 13 == 0).alias("report_only"), (F.col("l_partkey") % 19 == 0).alias("measurement"), (F.col("l_suppkey") % 17 == 0).alias("scoped"),
        F.when(F.col("l_linestatus") == "F", "low").otherwise("high").alias("confidence"), (F.col("p_size") % 4 == 0).alias("high_stakes"), (F.col("p_size") % 5 == 0).alias("sensitive"),
        F.when(F.col("l_suppkey") % 2 == 0, d(-100)).otherwise(d(0)).alias("absolute_low"), d(49).alias("absolute_high"), d(3).alias("critical_low"), d(45).alias("critical_high"), F.expr(SEX).alias("sex"), F.lit(False).alias("has_ages"),
    )
    return rules.evaluate(rules.predicates(entries))


RULED_SQL = f"""{RANGE_SQL}, f AS (
  SELECT r3.*, p_size, l_partkey % 3 = 0 AS minus, try_cast(CASE WHEN l_partkey % 9 IN (2, 4) THEN NULL ELSE {QUANTITY} || CASE l_partkey % 9 WHEN 3 THEN '.5' ELSE '' END END AS DOUBLE) AS plus,
    (p_size % 10 + 5)::DOUBLE AS ol, (p_size % 10 + 30)::DOUBLE AS oh, low IS NOT NULL OR high IS NOT NULL AS pr, CASE WHEN l_suppkey % 2 = 0 THEN -100 ELSE 0 END AS least FROM r3 JOIN part ON l_partkey = p_partkey),
g AS (SELECT *, CASE WHEN minus THEN -plus ELSE plus END AS v, coalesce(abs(ol - low) > ol * 0.15, false) OR coalesce(abs(oh - high) > oh * 0.15, false) AS off,
  list_filter([CASE WHEN low <> 0 THEN greatest(ol / low, low / ol) END, CASE WHEN high <> 0 THEN greatest(oh / high, high / oh) END], lambda x: x IS NOT NULL) AS ratios FROM f),
h AS (SELECT *, CASE WHEN v IS NULL THEN NULL WHEN v < 3 OR v > 45 THEN 'c' WHEN v < ol THEN 'l' WHEN v > oh THEN 'h' ELSE 'n' END AS kind,
  CASE WHEN v IS NULL THEN 'none' WHEN v < ol THEN 'below' WHEN v > oh THEN 'above' ELSE 'within' END AS so,
  CASE WHEN v IS NULL OR NOT pr THEN 'none' WHEN v < low OR (low_open AND v = low) THEN 'below' WHEN v > high OR (high_open AND v = high) THEN 'above' ELSE 'within' END AS sp,
  pr AND ((len(ratios) > 0 AND len(list_filter(ratios, lambda x: x > 10)) = len(ratios)) OR coalesce(49 < low, false) OR coalesce(high < least, false)) AS suspect,
  pr AND (coalesce(oh < low, false) OR coalesce(high < ol, false)) AS apart FROM g),
j AS (SELECT *, so <> sp AND so <> 'none' AND sp <> 'none' AS flips FROM h),
k AS (SELECT *, list_filter([
  CASE WHEN l_partkey % 11 = 0 THEN 1 END, CASE WHEN l_partkey % 19 = 0 AND l_partkey % 7 = 0 THEN 2 END,
  CASE WHEN l_suppkey % 17 = 0 AND CASE WHEN l_partkey % 13 = 0 THEN l_partkey % 7 = 0 WHEN pr THEN off ELSE l_partkey % 7 = 0 END THEN 3 END,
  CASE WHEN l_partkey % 13 = 0 AND l_linestatus = 'F' THEN 4 END, CASE WHEN l_partkey % 13 = 0 THEN 5 END, CASE WHEN l_partkey % 7 = 0 THEN 6 END, CASE WHEN v > 49 OR v < least THEN 7 END,
  CASE WHEN kind = 'c' THEN 8 END, CASE WHEN p_size % 4 = 0 AND kind IN ('l', 'h') THEN 9 END, CASE WHEN l_linestatus = 'F' OR v IS NULL OR (v < 0 AND least >= 0) THEN 10 END, CASE WHEN p_size % 4 = 0 THEN 11 END, CASE WHEN suspect THEN 12 END,
  CASE WHEN NOT suspect AND apart THEN 13 END, CASE WHEN NOT suspect AND pr AND (flips OR off) THEN 14 END,
  CASE WHEN p_size % 5 = 0 AND l_returnflag NOT IN ('R', 'A') THEN 15 END], lambda x: x IS NOT NULL) AS hits FROM j),
m AS (SELECT *, coalesce(list_min(list_filter(hits, lambda x: x IN (1, 2, 3, 5, 6, 7))), 99) AS stop FROM k), w AS (SELECT *, list_filter(hits, lambda x: x <= stop) AS flags FROM m)"""
NAMED = "[" + ", ".join(f"'{r[0].split(' (')[0]}'" for r in rules.RULES) + "]"

SEVERE = "[" + ", ".join(str(r[1]) for r in rules.RULES) + "]"


@query(f"WITH {RULED_SQL}, e AS (SELECT l_returnflag, flips, unnest(flags) AS i FROM w) SELECT l_returnflag, ({NAMED})[i] AS rule, ({SEVERE})[i] + CASE WHEN i = 14 AND flips THEN 1 ELSE 0 END AS severity, count(*)::BIGINT AS n FROM e GROUP BY 1, 2, 3")
def rule_engine_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.flag_counts(ruled(spark, sf_dir), "l_returnflag")


@query(f"""WITH {RULED_SQL}, c AS (SELECT *, len(list_filter(flags, lambda x: x IN (1, 2, 3, 6, 7))) > 0 AS abstained, len(list_filter(flags, lambda x: x IN (4, 7, 10, 11, 12))) > 0 OR (p_size % 4 = 0 AND len(list_filter(flags, lambda x: x IN (5, 6))) > 0) AS confirm FROM w),
t AS (SELECT count(*) FILTER (NOT abstained)::BIGINT AS emitted, count(*) FILTER (confirm)::BIGINT AS confirmed FROM c), e AS (SELECT unnest(flags) AS i FROM c WHERE confirm)
SELECT ({NAMED})[i] AS rule, count(*)::BIGINT AS n, any_value(emitted) AS emitted, any_value(confirmed) AS confirmed FROM e, t GROUP BY 1""")
def confirm_burden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.confirm_burden(ruled(spark, sf_dir))


@query(f"""WITH {RULED_SQL}, c AS (SELECT *, len(list_filter(flags, lambda x: x IN (1, 2, 3, 6, 7))) > 0 AS abstained FROM w)
SELECT CASE WHEN abstained OR v IS NULL THEN 'unclassified' WHEN kind = 'c' THEN CASE WHEN v < 3 THEN 'critical-low' ELSE 'critical-high' END WHEN kind = 'l' THEN 'low' WHEN kind = 'h' THEN 'high' ELSE 'normal' END AS classification, sp AS chip,
  CASE WHEN len(list_filter(flags, lambda x: x <> 5)) = 0 THEN 'none' WHEN list_contains(flags, 8) THEN 'urgent' WHEN len(list_filter(flags, lambda x: x NOT IN (5, 11, 14, 15))) > 0 OR (flips AND list_contains(flags, 14)) THEN 'caution' ELSE 'info' END AS action, count(*)::BIGINT AS n FROM c GROUP BY 1, 2, 3""")
def summary_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ruled(spark, sf_dir)
    return rows.groupBy("classification", intervals.status(F.col("value"), F.col("printed")).alias("chip"), "action").agg(F.count(F.lit(1)).alias("n"))


CROSS = "case l_linenumber when 1 then 'total' when 2 then 'direct' when 3 then 'indirect' end"


@query(f"""WITH p AS (SELECT l_orderkey AS report_id, {CROSS} AS part, l_quantity AS value, l_partkey * 1000000 + l_suppkey AS ord FROM lineitem),
f AS (SELECT report_id, arg_min(value, ord) FILTER (part = 'total') AS t, arg_min(value, ord) FILTER (part = 'direct') AS d, arg_min(value, ord) FILTER (part = 'indirect') AS i FROM p GROUP BY 1)
SELECT CASE WHEN coalesce(d > 1.1 * t AND d - t > 3, false) THEN 'direct exceeds total' ELSE 'parts differ from total' END AS problem, count(*)::BIGINT AS n FROM f
WHERE coalesce(d > 1.1 * t AND d - t > 3, false) OR coalesce(abs(t - (d + i)) > greatest(2.0, 0.1 * t), false) GROUP BY 1""")
def cross_row_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.expr(CROSS).alias("part"), F.col("l_quantity").alias("value"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("ord"))
    return rules.cross_row(rows).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT count(*) AS n, sum(quality) AS a, sum(toxic) AS b, count(*) FILTER (quality = toxic) AS same FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), p AS (SELECT n, same / n AS po, a / n AS pa, b / n AS pb FROM s)
SELECT n::BIGINT AS n, po AS observed, (pa + pb) / 2 AS prevalence, (po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) AS kappa, (po - 2 * ((pa + pb) / 2) * (1 - (pa + pb) / 2)) / (1 - 2 * ((pa + pb) / 2) * (1 - (pa + pb) / 2)) AS ac1, 2 * po - 1 AS pabak FROM p""")
def agreement_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.agreement(table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 1)


SCORED = "SELECT doc_id, (n_chars % 129) / 128.0::DOUBLE AS score, quality = 1 AS correct, toxic = 1 AS toxic FROM documents JOIN labels USING (doc_id)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", ((F.col("n_chars") % 129) / 128.0).alias("score"), (F.col("quality") == 1).alias("correct"), (F.col("toxic") == 1).alias("toxic"))


@query(f"""WITH s AS ({SCORED}), b AS (SELECT least(floor(score * 10), 9)::INT AS bin, correct, score FROM s)
SELECT r.i::INT AS bin, count(score)::BIGINT AS n, coalesce(sum(correct::INT), 0)::BIGINT AS n_correct, coalesce(sum(score), 0)::DOUBLE AS score_sum FROM range(10) r(i) LEFT JOIN b ON bin = r.i GROUP BY 1""")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    return metrics.reliability_bins(s, F.col("score"), F.col("correct"))


@query(f"""WITH s AS ({SCORED})
SELECT doc_id AS position, row_number() OVER w AS k, sum((NOT correct)::INT) OVER (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS errors, count(*) OVER ()::BIGINT AS n FROM s WINDOW w AS (ORDER BY score DESC, doc_id)""")
def risk_coverage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.risk_coverage(scored(spark, sf_dir), "score", ~F.col("correct"), "doc_id").select("position", "k", "errors", "n")


@query(f"""WITH s AS ({SCORED}) SELECT (count(*) FILTER (toxic AND NOT correct) / count(*) FILTER (toxic))::DOUBLE AS precision, (count(*) FILTER (toxic AND NOT correct) / count(*) FILTER (NOT correct))::DOUBLE AS recall,
  (count(*) FILTER (toxic AND NOT correct AND score > 0.5) / count(*) FILTER (NOT correct AND score > 0.5))::DOUBLE AS recall_high_stakes FROM s""")
def abstention_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.abstention(scored(spark, sf_dir), F.col("toxic"), ~F.col("correct"), F.col("score") > 0.5)


@query("""SELECT (sum(n_chars % 7) FILTER (n_chars % 11 > 2 AND n_chars % 7 + 3 > 0) / sum(n_chars % 7 + 3) FILTER (n_chars % 11 > 2 AND n_chars % 7 + 3 > 0))::DOUBLE AS fidelity FROM documents""")
def term_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return metrics.term_fidelity(table(spark, sf_dir, "documents").select("n_chars"), n % 7, n % 7 + 3, n % 11 > 2)


@query("""WITH d AS (SELECT n_chars % 3 AS a, n_chars % 5 AS b, n_chars % 2 = 0 AS h FROM documents)
SELECT 1 - sum(a * 25 + b * CASE WHEN h THEN 25 ELSE 5 END)::DOUBLE / sum((a + 1) * 25 + (b + 2) * CASE WHEN h THEN 25 ELSE 5 END)::DOUBLE AS severity_fidelity FROM d""")
def severity_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("n_chars") % 3, F.col("n_chars") % 5
    return metrics.severity_fidelity(table(spark, sf_dir, "documents").select("n_chars"), {"negations": a, "numbers": b}, {"negations": a + 1, "numbers": b + 2}, F.col("n_chars") % 2 == 0)


@query("""WITH g AS (SELECT * FROM customer), t AS (SELECT count(*) AS n, count(*) FILTER (c_custkey % 3 <> 0 AND c_custkey % 5 <> 0) AS seg, count(*) FILTER (c_custkey % 3 <> 0) AS nat FROM g)
SELECT unnest(['c_mktsegment', 'c_nationkey']) AS field, unnest([seg, nat])::BIGINT AS hits, n::BIGINT AS gold FROM t""")
def field_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    guess = lambda n, wrong: gold.filter("c_custkey % 3 <> 0").select("c_custkey", (F.when(F.col("c_custkey") % 5 == 0, "none") if not wrong else F.lit("other")).alias("_w"), "c_mktsegment", "c_nationkey", F.lit(n).alias("ord"))
    predicted = guess(1, True).unionByName(guess(2, False)).withColumn("c_mktsegment", F.coalesce("_w", "c_mktsegment")).drop("_w")
    return metrics.field_recall(gold, predicted, "c_custkey", ["c_mktsegment", "c_nationkey"], "ord")


@query("WITH h AS (SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL) SELECT hash, count(DISTINCT doc_id)::BIGINT AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM h GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.collisions(table(spark, sf_dir, "documents"), F.col("text"), "doc_id")


@query("SELECT CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 7 = 1 THEN 'orphan' ELSE 'drift' END AS kind, count(*)::BIGINT AS n FROM documents WHERE doc_id % 7 IN (0, 1, 2) GROUP BY 1")
def source_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    new = F.when(F.col("doc_id") % 7 == 2, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text"))
    return reconcile.drift(docs.filter("doc_id % 7 <> 1"), docs.filter("doc_id % 7 <> 0").withColumn("text", new), "doc_id", "text").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'fabricated' WHEN o_orderkey % 5 = 1 THEN 'only-a' WHEN o_orderkey % 5 = 2 THEN 'only-b' ELSE 'missing' END AS problem, count(DISTINCT o_orderkey)::BIGINT AS n FROM orders WHERE o_orderkey % 5 <> 4 GROUP BY 1")
def packet_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey") % 5
    return reconcile.completeness(o.filter(k != 0), o.filter(k.isin(0, 1, 4)), o.filter(k.isin(0, 2, 4)), "o_orderkey").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'context-mismatch' WHEN o_orderkey % 6 = 0 THEN 'skipped' WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 THEN 'coverage-mismatch' WHEN o_orderkey % 5 = 0 THEN 'disagreement' ELSE 'agreed' END AS outcome, count(*)::BIGINT AS n FROM orders GROUP BY 1""")
def dual_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    a = o.select(k, F.col("o_orderstatus").alias("context"), F.when(k % 2 != 0, F.col("o_orderpriority")).otherwise(" ").alias("answer"))
    b = o.select(k, F.when(k % 11 == 0, "?").otherwise(F.col("o_orderstatus")).alias("context"), F.when(k % 3 == 0, F.lit(None)).when(k % 5 == 0, "other").otherwise(F.concat(F.lit(" "), F.col("o_orderpriority"))).alias("answer"))
    return reconcile.double_review(a, b, "o_orderkey", "context", "answer").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1)::INT AS ordinal FROM events")
def occurrence_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.occurrence(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], ["event_id"]).select("event_id", "ordinal")


@query("WITH s AS (SELECT event_id, user_id, ts, lag(ts + INTERVAL 1 HOUR) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, count(*)::BIGINT AS n FROM s WHERE ts < before GROUP BY 1")
def adjacent_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.expr("ts + interval 1 hour").alias("until"))
    return reconcile.overlapping(rows, ["user_id"], "ts", "until", ["event_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("WITH n AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[0-9]+(?:[.,][0-9]+)*') AS x FROM documents) SELECT doc_id, len(x)::INT AS n_numbers, sha256(array_to_string(list_sort(x), '|')) AS multiset FROM n")
def number_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = entities.numbers(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(x).alias("n_numbers"), F.sha2(F.array_join(F.array_sort(x), "|"), 256).alias("multiset"))


CLAUSES_SQL = r"""
c0 AS (SELECT conv_id, turn, regexp_replace(regexp_replace(coalesce(text, ''), '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g'), '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g') AS t FROM conversations),
c1 AS (SELECT conv_id, turn, regexp_replace(regexp_replace(t, '([0-9]),([0-9])', '\1' || chr(2) || '\2', 'g'), '([0-9]),([0-9])', '\1' || chr(2) || '\2', 'g') AS t FROM c0),
c2 AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(t, '[。；;!?！？\n.,]|但是|但|而|及|和|，|(?i:\band\b|\bbut\b)'), lambda x: replace(replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), chr(1), '.'), chr(2), ',')), lambda x: x <> '') AS c FROM c1)"""


@query(f"WITH {CLAUSES_SQL} SELECT conv_id, turn, len(c)::INT AS clauses, sha256(array_to_string(c, '|')) AS texts FROM c2")
def clause_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = entities.clauses(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(c).alias("clauses"), F.sha2(F.array_join(c, "|"), 256).alias("texts"))


MARKERS = (("no", "en", "negated", "firm", False), ("not", "en", "negated", "firm", False), ("without", "en", "negated", "firm", False), ("no evidence of", "en", "negated", "weak", False), ("maybe", "en", "uncertain", "weak", False))
UNITS = {"mg": "mg", "mL": "mL", "ml": "mL", "g": "g", "%": "%", "片": "tablet", "tablets": "tablet"}


@query(f"""WITH {CLAUSES_SQL}, e AS (SELECT unnest(c) AS x FROM c2), m AS (SELECT unnest(['no', 'not', 'without', 'maybe']) AS marker)
SELECT marker, sum(len(regexp_extract_all(lower(x), '\\b' || marker || '\\b')) - CASE WHEN marker = 'no' THEN len(regexp_extract_all(lower(x), '\\bno evidence of\\b')) ELSE 0 END)::BIGINT AS n FROM e, m GROUP BY 1 HAVING n > 0""")
def negation_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "conversations").select(F.explode(entities.clauses(F.coalesce("text", F.lit("")))).alias("c"))
    found = parts.select(F.explode(notes.negations(F.col("c"), F.lit("en"), MARKERS)).alias("x"))
    return found.filter(F.col("x.raw").isNotNull()).groupBy(F.lower("x.raw").alias("marker")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("marker") != "no evidence of")


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?i)(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)(?:\s*[-~–至]\s*(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?))?\s*(?:tablets|mg|ml|g|%|片)') AS x FROM documents)
SELECT doc_id, len(x)::INT AS doses, sha256(array_to_string(x, '|')) AS raws FROM d""")
def dose_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", notes.doses(F.coalesce("text", F.lit("")), UNITS).alias("x"))
    return found.select("doc_id", F.size("x").alias("doses"), F.sha2(F.array_join("x.raw", "|"), 256).alias("raws"))


@query("""SELECT role, CASE WHEN (contains(lower(text), 'the') OR contains(lower(text), 'and')) AND contains(lower(text), 'on') THEN 1 ELSE 0 END AS held, CASE WHEN contains(replace(lower(text), 'not an', ' '), 'an') THEN 1 ELSE 0 END AS out, count(*)::BIGINT AS n FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2, 3""")
def conjunctive_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = notes.conjunctive(F.col("text"), [[["the", "and"], ["on"]]])
    out = notes.excluded(F.col("text"), ["not an"], ["an"])
    return table(spark, sf_dir, "conversations").filter("text is not null").groupBy("role", held.cast("int").alias("held"), out.cast("int").alias("out")).agg(F.count(F.lit(1)).alias("n"))


BANDED = "p_size % 3 = 0"


@query(f"""WITH b AS (SELECT l_returnflag, p_size % 10 AS s, {BANDED} AS banded, l_linenumber * 10 AS age, l_linenumber % 3 = 0 AS no_age, {SEX} AS sex, l_quantity AS v FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT *, CASE WHEN no_age THEN NULL WHEN age BETWEEN 10 AND 29 THEN 1 WHEN age BETWEEN 30 AND 49 THEN 2 END AS band FROM b),
d AS (SELECT *, CASE WHEN NOT banded THEN CASE sex WHEN 'male' THEN s + 5 WHEN 'female' THEN s + 3 ELSE s + 3 END WHEN band = 1 THEN s + 2 WHEN band = 2 THEN CASE sex WHEN 'male' THEN s + 6 ELSE s + 1 END ELSE s + 1 END AS low,
  CASE WHEN NOT banded THEN s + 30 WHEN band = 1 THEN NULL WHEN band = 2 THEN s + 20 ELSE s + 20 END AS high, CASE WHEN NOT banded THEN sex = 'unknown' WHEN band = 1 THEN false WHEN band = 2 THEN sex = 'unknown' ELSE true END AS used_union FROM c)
SELECT used_union, CASE WHEN v < low THEN 'low' WHEN v > high THEN 'high' ELSE 'normal' END AS classification, count(*)::BIGINT AS n, sum(low)::DOUBLE AS lows FROM d GROUP BY 1, 2""")
def bounds_sex_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = (F.col("p_size") % 10).cast("double")
    bound = lambda both=None, male=None, female=None: F.struct(*((F.lit(None).cast("double") if v is None else s + v).alias(k) for k, v in (("any", both), ("male", male), ("female", female))))
    nothing = F.lit(None).cast(intervals.BOUND)
    band = lambda a, z, low, high: F.struct(F.lit(a).alias("age_min"), F.lit(z).alias("age_max"), low.alias("low"), high.alias("high"))
    bands = F.when(F.expr(BANDED), F.array(band(10, 29, bound(2), nothing), band(30, 49, bound(None, 6, 1), bound(20))))
    age = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber") * 10)
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    of = rows.select("l_quantity", intervals.resolved_bounds(bound(None, 5, 3), bound(30), bands, F.expr(SEX), age).alias("of")).select("l_quantity", "of.*")
    return of.groupBy("used_union", intervals.classify(F.col("l_quantity"), F.col("low"), F.col("high")).alias("classification")).agg(F.count(F.lit(1)).alias("n"), F.sum("low").alias("lows"))


@query("""WITH r AS (SELECT least(1, greatest(0, value / 200.0)) AS s, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS c FROM events), b AS (SELECT least(floor(s * 10), 9)::INT AS bin, count(*) AS n, avg(c) AS acc, avg(s) AS conf FROM r GROUP BY 1)
SELECT round(sum(abs(acc - conf) * n) / sum(n), 9) AS ece FROM b""")
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = metrics.reliability_bins(table(spark, sf_dir, "events"), F.col("value") / 200.0, F.col("event_id") % 3 == 0)
    return metrics.calibration_error(bins).select(F.round("ece", 9).alias("ece"))


@query("""SELECT count(*) FILTER (event_id % 4 <> 0) / count(*)::DOUBLE AS coverage, count(*) FILTER (event_id % 4 <> 0 AND event_id % 9 = 0) / (count(*) FILTER (event_id % 4 <> 0))::DOUBLE AS selective_risk FROM events""")
def risk_coverage_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.operating_point(table(spark, sf_dir, "events"), F.col("event_id") % 4 != 0, F.col("event_id") % 9 == 0)


@query("""WITH s AS (SELECT user_id, avg(CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.0 END) AS share FROM events GROUP BY 1) SELECT round(avg(share), 9) AS recall, count(share)::BIGINT AS samples FROM s""")
def extraction_macro_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 2 == 0)
    return evaluation.macro_average(table(spark, sf_dir, "events"), "user_id", hit).select(F.round("recall", 9).alias("recall"), "samples")


@query("""WITH r AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS p, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN true ELSE o_orderkey % 2 = 0 END AS g FROM orders)
SELECT count(*) FILTER (p IS NOT NULL AND g IS NOT NULL)::BIGINT AS n, count(*) FILTER (p = g)::BIGINT AS agreed FROM r""")
def grounding_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    predicted = evaluation.abnormal(F.element_at(F.array(*map(F.lit, ("unclassified", "normal", "low", "high", "critical"))), (k % 5 + 1).cast("int")))
    gold = F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, True).otherwise(k % 2 == 0)
    return evaluation.grounding_recall(table(spark, sf_dir, "orders"), predicted, gold).select("n", "agreed")


@query("""WITH g AS (SELECT DISTINCT p_name AS name, CASE WHEN length(p_name) % 3 = 0 THEN 'non-analyte' ELSE 'analyte' END AS kind, length(p_name) % 2 = 0 AS high FROM part WHERE length(p_name) % 5 <> 0)
SELECT coalesce(kind, 'unlabelled') AS kind, count(*)::BIGINT AS rows, count(*) FILTER (p_partkey % 4 <> 0)::BIGINT AS recognised, count(*) FILTER (coalesce(high, false))::BIGINT AS high_stakes, count(*) FILTER (coalesce(high, false) AND p_partkey % 3 = 0)::BIGINT AS confirmed FROM part LEFT JOIN g ON p_name = name GROUP BY 1""")
def corpus_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, n = table(spark, sf_dir, "part"), F.length("p_name")
    gold = parts.filter(n % 5 != 0).select(F.concat(F.lit(" "), "p_name").alias("name"), F.when(n % 3 == 0, "non-analyte").otherwise("analyte").alias("kind"), (n % 2 == 0).alias("high_stakes")).distinct()
    rows = parts.select(F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 4 != 0, "k").alias("key"), (F.col("p_partkey") % 3 == 0).alias("needs_confirm"))
    return evaluation.corpus_score(rows, gold)


@query("""SELECT event_type AS model, count(*)::BIGINT AS total, count(*) FILTER (event_id % 5 <> 0 AND event_id % 2 = 0)::BIGINT AS passed, count(*) FILTER (event_id % 5 <> 0 AND event_id % 2 = 1)::BIGINT AS failed, count(*) FILTER (event_id % 5 = 0)::BIGINT AS empty FROM events GROUP BY 1""")
def model_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 5 == 0, "  ").otherwise("x")
    return evaluation.by_model(table(spark, sf_dir, "events"), "event_type", text, F.col("event_id") % 2 == 0).withColumnRenamed("event_type", "model")


@query("""SELECT c_mktsegment, count(*)::BIGINT AS items, count(*) FILTER (c_custkey % 4 = 0)::BIGINT AS abstained, count(*) FILTER (c_custkey % 4 <> 0 AND c_custkey % 3 = 0)::BIGINT AS correct, count(*) FILTER (c_custkey % 4 <> 0 AND c_custkey % 3 <> 0)::BIGINT AS wrong, true AS whole FROM customer GROUP BY 1""")
def partition_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.outcomes(table(spark, sf_dir, "customer"), F.col("c_custkey") % 4 == 0, F.col("c_custkey") % 3 == 0, "c_mktsegment")


@query("""SELECT p_type, coalesce(median(p_size), 0)::DOUBLE AS middle, round(var_pop(p_size), 6) AS variance FROM part GROUP BY 1""")
def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_type").agg(evaluation.median(F.col("p_size")).alias("middle"), F.round(F.var_pop("p_size"), 6).alias("variance"))


@query("""WITH i AS (SELECT o_orderkey, list_transform(range(64), lambda k: ((o_orderkey * 7 + k * k * (o_orderkey % 5 + 1)) % 256)::DOUBLE) AS p FROM orders),
l AS (SELECT o_orderkey, p, list_transform(range(36), lambda k: (k // 6 + 1) * 8 + k % 6 + 1) AS spots FROM i),
v AS (SELECT o_orderkey, p, list_aggregate(list_transform(spots, lambda c: p[c - 7] + p[c + 9] + p[c] + p[c + 2] - 4 * p[c + 1]), 'var_pop') AS blur, list_sort(p)[61] AS paper FROM l)
SELECT o_orderkey, round(blur, 6) AS blur, len(list_filter(p, lambda x: x < paper * 0.75)) / 64.0::DOUBLE AS ink, blur >= 100 AND len(list_filter(p, lambda x: x < paper * 0.75)) / 64.0 >= 0.002 AS ok FROM v""")
def image_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pixels = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((k * 7 + i * i * (k % 5 + 1)) % 256).cast("double"))
    images = table(spark, sf_dir, "orders").select("o_orderkey", pixels.alias("pixels"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    return quality.assess(images).select("o_orderkey", F.round("blur", 6).alias("blur"), "ink", "ok")


@query("""SELECT event_id, greatest(1, ceil((event_id * 997 % 5000 - event_id * 31 % 4000) / 1000.0))::BIGINT AS wait, CASE WHEN event_type = 'click' THEN 9 ELSE 3 END AS burst FROM events""")
def retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("route"), F.lit(3).alias("limit"), evaluation.retry_after(F.col("event_id") * 997 % 5000, F.col("event_id") * 31 % 4000).alias("wait"))
    overrides = spark.createDataFrame([("click", 5, 1), ("click", 9, 2), ("view", 7, 1), ("view", None, 2)], "route string, value int, at int")
    return evaluation.limits_in_force(rows, overrides).select("event_id", "wait", F.col("limit").alias("burst"))


@query(f"""WITH {RULED_SQL}, r AS (SELECT * FROM w) SELECT l_returnflag, count(*) FILTER (list_contains(flags, 8) OR list_contains(flags, 13) OR (flips AND list_contains(flags, 14)))::BIGINT AS reviewed, count(*) FILTER (l_suppkey % 3 = 0 AND len(list_filter(flags, lambda x: x IN (1, 2, 3, 6, 7))) = 0)::BIGINT AS poor, count(*)::BIGINT AS n FROM r GROUP BY 1""")
def review_and_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.low_quality(ruled(spark, sf_dir), F.col("supplier") % 3 == 0)
    poor = F.exists("flags", lambda f: f["id"] == "H4-LOW-QUALITY-OVERRIDE") & F.col("needs_confirm")
    return rows.groupBy("l_returnflag").agg(F.count_if("needs_review").alias("reviewed"), F.count_if(poor).alias("poor"), F.count(F.lit(1)).alias("n"))


TERMS = ("help", "the", "an", "pain", "no")


@query("WITH t AS (SELECT unnest(['help', 'the', 'an', 'pain', 'no']) AS term) SELECT term, count(*)::BIGINT AS n FROM conversations, t WHERE regexp_matches(replace(replace(lower(text), '’', ''''), '‘', ''''), '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)') GROUP BY 1")
def emergency_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.array(*(F.when(entities.has_term(F.col("text"), t), t) for t in TERMS))
    return table(spark, sf_dir, "conversations").select(F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)::BIGINT AS n_recent FROM events")
def burst_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.burst_counts(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), 6 * 3600).select("event_id", "n_recent")


COST = "case event_type when 'purchase' then 5 when 'click' then 3 else 1 end"


@query(f"SELECT user_id, ts::DATE::VARCHAR AS day, sum({COST})::BIGINT AS spent FROM events GROUP BY 1, 2")
def daily_cost_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.daily_cost(table(spark, sf_dir, "events"), F.expr(COST).cast("long")).withColumn("day", F.col("day").cast("string"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.windowed_counts(table(spark, sf_dir, "events"), "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, session""")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.session_counts(table(spark, sf_dir, "events"), "2 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, {COST} AS cost, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
s(user_id, k, event_id, recent, day, spent, outcome) AS (
  SELECT user_id, 0::BIGINT, NULL::BIGINT, []::BIGINT[], -1::BIGINT, 0::BIGINT, '' FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT user_id, k, event_id, CASE WHEN said = 'admitted' THEN list_append(r, us) ELSE r END, d, CASE WHEN said = 'admitted' THEN sp + cost ELSE sp END, said FROM (
    SELECT *, CASE WHEN len(r) >= 3 THEN 'burst' WHEN sp + cost > 12 THEN 'daily' ELSE 'admitted' END AS said FROM (
      SELECT e.*, list_filter(s.recent, lambda t: t > e.us - 21600000000) AS r, e.us // 86400000000 AS d, CASE WHEN e.us // 86400000000 = s.day THEN s.spent ELSE 0 END AS sp FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)))
SELECT event_id, user_id, outcome FROM s WHERE k > 0""")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.admit(table(spark, sf_dir, "events"), F.expr(COST), burst=3, seconds=6 * 3600, daily=12)


@query("""WITH h AS (SELECT doc_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)), lambda a, c: xor(a, c) * 16777619 % 4294967296) AS hash FROM documents)
SELECT doc_id, hash, hash / 4294967296.0 < 0.34 AS held_out FROM h""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text.fnv1a(F.col("doc_id").cast("string")).alias("hash"))
    return docs.withColumn("held_out", F.col("hash") / 4294967296.0 < 0.34)


#: Rows of lineitem in a part.
ROWS_A_PART = 250_000


def positioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a page for each order: three columns, rows 30 apart, the others a little off, the second a number."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    # Pages meet their cells where their rows are, in parts that don't grow with the table.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // ROWS_A_PART))
    rows = lines.repartition(parts, "l_orderkey").distinct()
    lined = reconcile.occurrence(rows, ["l_orderkey"], ["l_linenumber", "l_partkey"])
    cells = lined.select(F.col("l_orderkey").alias("page_id"), F.col("ordinal"), "l_partkey", F.posexplode(F.array(F.lit(0.0), F.lit(120.0), F.lit(240.0))).alias("c", "x"))
    written = F.when(F.col("c") == 0, F.concat(F.lit("name "), "l_partkey")).when(F.col("c") == 1, F.col("l_partkey").cast("string")).otherwise("mg/dl")
    return cells.select("page_id", (F.col("ordinal") * 3 + F.col("c")).cast("long").alias("cell_id"), "x", (F.col("ordinal") * 30.0 + F.col("c") * 4).alias("y"), F.lit(80.0).alias("width"), F.lit(20.0).alias("height"), written.alias("text"))


@query("""WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem), o AS (SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS row, l_orderkey % 7 = 0 AND count(*) OVER (PARTITION BY l_orderkey) > 1 AS refused FROM r)
SELECT page_id, row * 3 + c AS cell_id, c AS "column", CASE WHEN NOT refused THEN row * 3 END AS anchor, refused FROM o, range(3) t(c)""")
def cell_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose order is divisible by 7 have a third column whose cells drift ever further down."""
    row = F.floor(F.col("cell_id") / 3)
    drifts = (F.col("page_id") % 7 == 0) & (F.col("cell_id") % 3 == 2)
    return geometry.bind_cells(positioned(spark, sf_dir).withColumn("y", F.col("y") + F.when(drifts, row * row * 11.0).otherwise(0.0)))


@query("""WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem), n AS (SELECT l_orderkey AS page_id, count(*) AS n FROM r GROUP BY 1)
SELECT page_id, 3::BIGINT AS columns, n::BIGINT AS aligned_rows, true AS has_results, CASE WHEN n < 3 THEN 'few rows' ELSE '' END AS reason FROM n""")
def table_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.table_structure(positioned(spark, sf_dir))


@query("""WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem), o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS ordinal, count(*) OVER (PARTITION BY l_orderkey, l_partkey) AS same FROM r)
SELECT l_orderkey AS page_id, ordinal::BIGINT AS ord, 'value' AS field, 'not-on-page' AS problem FROM o WHERE ordinal % 4 = 3""")
def row_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as printed, but every fourth with a value that the page lacks."""
    cells = positioned(spark, sf_dir)
    part = F.regexp_extract("text", "([0-9]+)$", 1)
    ordinal = F.floor(F.col("cell_id") / 3)
    claims = cells.filter("cell_id % 3 = 0").select("page_id", ordinal.cast("long").alias("ord"), F.col("text").alias("name"), F.when(ordinal % 4 == 3, F.concat(part, F.lit("?"))).otherwise(part).alias("value"), F.lit("mg/dl").alias("unit"), F.lit(None).cast("string").alias("printed_range"))
    return geometry.verify_rows(claims, cells)


AMOUNT_OUT = "case l_suppkey % 5 when 0 then l_quantity when 1 then l_quantity + 1 when 2 then l_quantity * 2 when 3 then l_quantity end"
RESULT_IN, RESULT_OUT = ("case {0} % 5 when 0 then '结果阳性' when 1 then 'Test POSITIVE.' when 2 then 'negative' when 3 then 'seropositive' else '阴性 positive' end".format(c) for c in ("l_partkey", "l_suppkey"))


@query(f"""WITH d AS (SELECT l_returnflag, l_partkey, l_suppkey, cast(l_quantity as double) AS a, cast({AMOUNT_OUT} as double) AS b FROM lineitem)
SELECT l_returnflag, f.f AS flag, count(*)::BIGINT AS n FROM (SELECT l_returnflag, unnest(CASE WHEN b IS NULL THEN ['R8-DOSE-NOT-PRESERVED'] WHEN l_suppkey % 5 = 3 THEN ['R8-DOSE-UNIT-DIMENSION-MISMATCH']
  WHEN a <> b THEN CASE WHEN greatest(a / b, b / a) >= 2 THEN ['R8-DOSE-NOT-PRESERVED', 'R8-DOSE-MAGNITUDE-DIVERGENCE'] ELSE ['R8-DOSE-NOT-PRESERVED'] END
  WHEN l_partkey % 3 = 0 THEN ['R8-DOSE-FREQUENCY-DROPPED'] ELSE [] END) AS f FROM d) f GROUP BY 1, 2""")
def dose_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dose per row against one of another amount or unit, or none."""
    amount = lambda x: F.col(x).cast("double").cast("string").alias("amount")
    none = F.lit(None).cast("string").alias("upper")
    dose = lambda x, unit: F.struct(F.col(x).alias("raw"), amount(x), none, F.lit("mass").alias("dimension") if unit is None else F.when(unit, "volume").otherwise("mass").alias("dimension"))
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey", "l_suppkey", F.col("l_quantity").cast("double").cast("string").alias("a"), F.expr(f"cast(cast({AMOUNT_OUT} as double) as string)").alias("b"))
    output = F.filter(F.array(dose("b", F.col("l_suppkey") % 5 == 3)), lambda o: o["amount"].isNotNull())
    found = fidelity.dose_hits(F.array(dose("a", None)), output, F.when(F.col("l_partkey") % 3 == 0, "bid"), F.lit(None).cast("string"))
    return rows.select("l_returnflag", F.explode(found).alias("h")).groupBy("l_returnflag", F.col("h.id").alias("flag")).agg(F.count(F.lit(1)).alias("n"))


POLARITY_SQL = "CASE WHEN contains({0}, '阳性') THEN 'positive' WHEN contains({0}, '阴性') THEN 'negative' WHEN regexp_matches(lower({0}), '\\bpositive\\b') THEN 'positive' WHEN regexp_matches(lower({0}), '\\bnegative\\b') THEN 'negative' END"


@query(f"""WITH t AS (SELECT {RESULT_IN} AS a, {RESULT_OUT} AS b FROM lineitem), p AS (SELECT a, b, {POLARITY_SQL.format('a')} AS x, {POLARITY_SQL.format('b')} AS y FROM t)
SELECT a, b, coalesce(x <> y, false) AS flipped, count(*)::BIGINT AS n FROM p GROUP BY 1, 2, 3""")
def result_polarity_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.expr(RESULT_IN).alias("a"), F.expr(RESULT_OUT).alias("b"))
    return rows.groupBy("a", "b", (F.size(fidelity.polarity_hits(F.col("a"), F.col("b"))) > 0).alias("flipped")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT l_orderkey AS id, max(CASE WHEN l_linenumber % 4 = 0 THEN 1 ELSE 0 END) AS own, max(CASE WHEN l_partkey % 3 > 0 THEN 1 ELSE 0 END) AS usable FROM lineitem GROUP BY 1),
lost AS (SELECT l_orderkey AS id, max(CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE 0 END) AS risk FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_partkey = a.l_partkey AND b.l_suppkey % 5 > 0) GROUP BY 1),
o AS (SELECT o_orderkey AS note_id, coalesce(own, 0) AS own, risk, CASE WHEN coalesce(usable, 0) = 0 THEN 'total-drop' WHEN o_orderkey % 11 = 0 THEN 'directives' WHEN risk IS NOT NULL THEN 'partial-drop' ELSE 'kept' END AS outcome
  FROM orders LEFT JOIN s ON s.id = o_orderkey LEFT JOIN lost ON lost.id = o_orderkey)
SELECT note_id, outcome, (CASE WHEN outcome IN ('total-drop', 'directives') THEN 2 WHEN outcome = 'partial-drop' THEN greatest(own, risk + 1) ELSE own END)::INTEGER AS action FROM o""")
def note_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as notes, lineitems as their segments; what a segment of a supplier divisible by 5 states is not covered."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "note_id")
    notes_ = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("note_id"), F.lit("x").alias("text"))
    segments = lines.select("note_id", F.when(F.col("l_partkey") % 3 > 0, "s").alias("source"), (F.col("l_linenumber") % 4 == 0).cast("int").alias("action"))
    keyed = lines.select("note_id", F.col("l_partkey").alias("key"), (F.col("l_partkey") % 2 == 0).alias("high_risk"), "l_suppkey")
    return fidelity.ground(notes_, segments, keyed.drop("l_suppkey"), keyed.filter("l_suppkey % 5 > 0"), notes_.filter("note_id % 11 = 0"))


#: Beginnings of texts: one syllable and a separator, doubled, first, two runs without one, CJK, Devanagari, a control, unassigned, not composed, blanks.
BO = ("\u0f42\u0f0b", "\u0f42\u0f0b\u0f0b", " \u0f0b\u0f42", "\u0f42 \u0f44 ", "\u8840", "\u0905\U0001f600$", "\u200b", "\u0f48\u0f77", "e\u0301", "   ")


@query(rf"""WITH t AS (SELECT [{", ".join(f"'{b}'" for b in BO)}][p_partkey % 10 + 1] || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS t FROM part),
f AS (SELECT unnest([{{'c': 'A1', 'n': (trim(t) = '')::INT}}, {{'c': 'A2', 'n': regexp_matches(t, '[\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}]')::INT}},
  {{'c': 'A3', 'n': len(regexp_extract_all(t, '[^\x{{0f00}}-\x{{0fff}}A-Za-z0-9 !"#%''()*+,\-./:;<=>?\[\]^_{{}}²µ×μ–−≤≥]'))}}, {{'c': 'A4', 'n': len(regexp_extract_all(t, '[\x{{0900}}-\x{{097f}}]'))}},
  {{'c': 'A5', 'n': len(regexp_extract_all(t, '[\x{{0f48}}\x{{0f6d}}-\x{{0f70}}\x{{0f77}}\x{{0f79}}\x{{0f98}}\x{{0fbd}}\x{{0fcd}}\x{{0fdb}}-\x{{0fff}}]')) + (nfc_normalize(t) <> t)::INT}},
  {{'c': 'A7', 'n': regexp_matches(t, '^\s*[\x{{0f0b}}\x{{0f0c}}]')::INT + contains(t, '་་')::INT + (len(list_filter(string_split(t, ' '), lambda r: regexp_matches(r, '[\x{{0f40}}-\x{{0fbc}}]'))) >= 2 AND NOT regexp_matches(t, '[\x{{0f0b}}\x{{0f0c}}]'))::INT}},
  {{'c': 'A9', 'n': len(regexp_extract_all(t, '[\x{{200b}}-\x{{200f}}\x{{202a}}-\x{{202e}}\x{{2060}}\x{{2066}}-\x{{2069}}\x{{feff}}]'))}}]) AS f FROM t) SELECT f.c AS "check", sum(f.n)::BIGINT AS n FROM f GROUP BY 1 HAVING sum(f.n) > 0""")
def well_formedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    begins = F.element_at(F.array(*map(F.lit, BO)), (F.col("p_partkey") % 10 + 1).cast("int"))
    texts = table(spark, sf_dir, "part").select(F.concat(begins, F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_name"))).alias("t"))
    return texts.select(F.explode(wellformed.findings(F.col("t"))).alias("f")).groupBy("f.check").agg(F.count(F.lit(1)).alias("n"))


#: Clauses with the directives that they state (kind, direction): marker, turned by a negation, an ambiguous word without a drug, a word that orders nothing, monitoring, halving.
ORDERS = (("Stop aspirin today", "en", ("hold",)), ("do not stop aspirin", "en", ("continue",)), ("hold the rail", "en", ()), ("hold this medication", "en", ("hold",)), ("停经三月", "zh", ()), ("停降压药", "zh", ("hold",)), ("继续观察", "zh", ()), ("cut the aspirin in half", "en", ("dose-change:down",)), ("do not increase aspirin", "en", ("dose-change:unknown",)), ("household", "en", ()))
ORDER_MARKERS = (("stop", "en", "hold", None, False), ("hold", "en", "hold", None, True), ("increase", "en", "dose-change", "up", False), ("停", "zh", "hold", None, True), ("继续", "zh", "continue", None, True))


@query(f"""WITH e(i, kinds) AS (VALUES {", ".join(f"({i}, {list(k)}::VARCHAR[])" for i, (_, _, k) in enumerate(ORDERS))}) SELECT o_orderkey AS id, array_to_string(kinds, ',') AS kinds FROM orders JOIN e ON o_orderkey % {len(ORDERS)} = i""")
def directive_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order states one of the clauses."""
    pick = lambda n: F.element_at(F.array(*(F.lit(o[n]) for o in ORDERS)), (F.col("o_orderkey") % len(ORDERS) + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", pick(0).alias("clause"), pick(1).alias("lang"))
    named = F.when(F.lower("clause").contains("aspirin"), F.array(F.struct(F.lit("aspirin").alias("raw"), F.lit("a").alias("id")))).otherwise(F.array().cast(notes.NAMED))
    found = notes.directives(F.col("clause"), F.col("lang"), named, ORDER_MARKERS, [("do not", "en"), ("不要", "zh")], ["观察"], [("medication", "en"), ("这个药", "zh")])
    kinds = F.transform(found, lambda d: F.concat_ws(":", d["kind"], d["direction"]))
    return rows.select(F.col("o_orderkey").alias("id"), F.array_join(kinds, ",").alias("kinds"))


#: A source and its translation, with the flags and the action that they get.
NEGATED = (
    ("未见占位", "No mass seen", (), 0), ("提示恶性", "no malignancy", ("R7-NEGATION-POLARITY-MISMATCH",), 2), ("未见占位", "A mass is seen", ("R7-NEGATION-POLARITY-MISMATCH",), 1),
    ("不能排除转移", "metastasis is excluded", ("R7-HEDGE-STRENGTH-WEAKENED", "R7-NEGATION-POLARITY-MISMATCH"), 2), ("未见左肺占位", "A mass is seen", ("R7-NEGATION-SCOPE-BROKEN",), 2),
    ("未见占位", "A mass with no malignancy", ("R7-NEGATION-RETARGETED",), 1), ("未见占位", "A mass with no effusion", (), 0), ("未见积液", "effusion", ("R7-NEGATION-POLARITY-MISMATCH",), 1), ("占位", "mass", (), 0),
)
FOUND = (("mass", {"zh": ["占位"], "en": ["mass"]}, False), ("malignancy", {"zh": ["恶性"], "en": ["malignan"]}, True), ("metastasis", {"zh": ["转移"], "en": ["metasta"]}, True))
NEGATION_MARKERS = (("未见", "zh", "absent", "firm", False), ("提示", "zh", "uncertain", "weak", False), ("no", "en", "absent", "firm", False))


@query(f"""WITH e(i, flags, action) AS (VALUES {", ".join(f"({i}, {list(f)}::VARCHAR[], {a})" for i, (_, _, f, a) in enumerate(NEGATED))}) SELECT action::INTEGER AS action, array_to_string(flags, ',') AS flags, count(*)::BIGINT AS n FROM lineitem JOIN e ON l_partkey % {len(NEGATED)} = i GROUP BY 1, 2""")
def negation_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda n: F.element_at(F.array(*(F.lit(o[n]) for o in NEGATED)), (F.col("l_partkey") % len(NEGATED) + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(pick(0).alias("a"), pick(1).alias("b"))
    found = [notes.negations(F.col(c), F.lit(of), NEGATION_MARKERS) for c, of in (("a", "zh"), ("b", "en"))]
    told = fidelity.negation_hits(*found, F.col("a"), F.col("b"), F.lit("zh"), F.lit("en"), FOUND, {"zh": ["不能排除"], "en": ["cannot exclude"]}, {"en": ["excluded", "ruled out"]}, {"zh": ["左肺"]})
    verdict = fidelity.verdict(told, F.array().cast("array<string>"))
    return rows.select(verdict.alias("v")).groupBy(F.col("v.action").alias("action"), F.array_join("v.flags", ",").alias("flags")).agg(F.count(F.lit(1)).alias("n"))
