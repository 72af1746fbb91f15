"""Queries over notes: entities of clauses, verdicts on segments, numbers, reviewers' verdicts.

Texts are those of documents and conversations, each with a note behind it that its id picks; segments are made of lineitem's
numbers. What SQL can't do by place it does by replacing what it has counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon
from ..operators import clause_entities as read
from ..operators import fidelity, notes, reconcile, segments
from .registry import query, table

#: A note behind each text.
NOTES = ("No evidence of metastasis, aspirin 100 mg BID.", "Cannot rule out a nodule; take Lipitor 10-20 mg", "Denies pain but possible mass", "Stop warfarin 3 days before, 1,000 steps", "R/O malignancy. Non-calcified, not enlarged", "Continue metformin 2 tablets and acarbose 50mg", "Unremarkable, no nodules, no mass. No no.", "Likely resolved vs pending; household")
NOTE = f"[{', '.join(repr(n) for n in NOTES)}]"
EN_MARKERS = sorted((m for m in lexicon.Lexicon().markers if m[1] == "en"), key=lambda m: -len(m[0]))
EN_DRUGS = sorted({(f, d) for f, d in lexicon.Lexicon().drugs if f.isascii()})


def doubled(words: str) -> str:
    """A pattern of a marker in a text whose signs stand twice, so that neighbours don't share one."""
    out = "".join(c if c.isalnum() else rf"[{c}]{{2}}" for c in words)
    return ("(^|[^a-z0-9])" if words[0].isalnum() else "()") + out + ("([^a-z0-9]|$)" if words[-1].isalnum() else "()")


def quoted(x: str) -> str:
    return x.replace("'", "''")


UNIT_WORDS = "|".join(u.replace("/", "[/]") for u in sorted(lexicon.Lexicon().units, key=lambda u: -len(u)))
DOSE_SQL = rf"(?i)(?:[0-9]{{1,3}}(?:,[0-9]{{3}})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)(?:\s*[-~–至]\s*(?:[0-9]{{1,3}}(?:,[0-9]{{3}})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?))?\s*(?:{UNIT_WORDS})"
STEPS = ",\n".join(
    f"s{i + 1} AS (SELECT * REPLACE (regexp_replace(t, '{quoted(doubled(m[0].lower()))}', '\\1##\\2', 'g') AS t, {'negated' if m[2] == 'absent' else 'uncertain'} + len(regexp_extract_all(t, '{quoted(doubled(m[0].lower()))}')) AS {'negated' if m[2] == 'absent' else 'uncertain'}) FROM s{i})"
    for i, m in enumerate(EN_MARKERS)
)
IDS = ", ".join(f"CASE WHEN regexp_matches(t, '{'|'.join(doubled(f) for f, x in EN_DRUGS if x == d)}') THEN '{d}' END" for d in sorted({d for _, d in EN_DRUGS}))


@query(rf"""WITH x AS (SELECT 'documents' AS source, doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'conversations', conv_id * 1000 + turn, coalesce(text, '') FROM conversations),
n AS MATERIALIZED (SELECT source, id, text || chr(10) || ({NOTE})[id % {len(NOTES)} + 1] AS text FROM x),
s0 AS (SELECT source, id, regexp_replace(lower(text), '([^a-z0-9])', '\1\1', 'g') AS t, 0::BIGINT AS negated, 0::BIGINT AS uncertain FROM n),
{STEPS},
g AS (SELECT source, id, array_to_string(list_sort(list_filter([{IDS}], lambda v: v IS NOT NULL)), ',') AS drugs FROM s0),
d AS (SELECT source, id, replace(text, chr(10), '。') AS t FROM n),
c AS (SELECT source, id, len(regexp_extract_all(t, '{DOSE_SQL}'))::BIGINT AS doses, len(regexp_extract_all(regexp_replace(t, '{DOSE_SQL}', '#', 'g'), '[0-9]+(?:[.,][0-9]+)?'))::BIGINT AS numbers FROM d)
SELECT source, id, negated, uncertain, doses, numbers, drugs FROM s{len(EN_MARKERS)} JOIN g USING (source, id) JOIN c USING (source, id)""")
def clause_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entities of each kind every text states, and which drugs."""
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "text")
    chats = table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    note = F.element_at(F.array(*map(F.lit, NOTES)), (F.col("id") % len(NOTES) + 1).cast("int"))
    texts = docs.unionByName(chats).select("source", "id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), note).alias("text"))
    found = read.clause_entities(texts.select("source", "id", "text"))
    is_ = lambda t: F.col("type") == t
    counts = found.groupBy("source", "id").agg(
        F.count_if(is_("negation") & (F.col("polarity") == "absent")).alias("negated"),
        F.count_if(is_("negation") & (F.col("polarity") == "uncertain")).alias("uncertain"),
        F.count_if(is_("dosage")).alias("doses"),
        F.count_if(is_("number")).alias("numbers"),
        F.array_join(F.sort_array(F.collect_set(F.when(is_("drug"), F.col("drug")))), ",").alias("drugs"),
    )
    none = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("negated", "uncertain", "doses", "numbers")}
    return texts.select("source", "id").join(counts, ["source", "id"], "left").withColumns(none | {"drugs": F.coalesce("drugs", F.lit(""))})


#: The amounts of a source and its translation, and which sentences they stand in.
OUT = "case l_suppkey % 5 when 0 then cast(l_quantity as int) when 1 then cast(l_quantity as int) + 1 when 2 then cast(l_quantity as int) * 2 when 3 then cast(l_quantity as int) end"
FROM_TEXT = "case l_partkey % 4 when 0 then concat('阿莫西林 ', a, ' 毫克 每日三次。') when 1 then concat('二甲双胍 ', a, 'mg 每日两次。') when 2 then concat('未见占位，', a, ' 天后复查。') else concat('继续服用华法林 ', a, ' 片。') end"
TO_TEXT = "case l_partkey % 4 when 0 then concat('Amoxicillin ', coalesce(b, ''), case when l_suppkey % 5 = 3 then ' mcg' else ' mg' end, ' three times daily.') when 1 then concat('Metformin ', coalesce(b, ''), case when l_suppkey % 5 = 3 then ' mcg.' else ' mg.' end) when 2 then concat(case when l_suppkey % 2 = 0 then 'No mass seen; recheck in ' else 'A mass is seen; recheck in ' end, coalesce(b, ''), ' days.') else concat('Continue aspirin ', coalesce(b, ''), case when l_suppkey % 5 = 3 then ' capsules.' else ' tablets.' end) end"


@query(f"""WITH r AS (SELECT l_partkey % 4 AS k, l_suppkey, cast(l_quantity as int) AS x, {OUT} AS y FROM lineitem),
d AS (SELECT *, CASE WHEN y IS NULL THEN ['{fidelity.NOT_PRESERVED}'] WHEN l_suppkey % 5 = 3 THEN ['{fidelity.UNIT_MISMATCH}'] WHEN x <> y THEN CASE WHEN greatest(x / y, y / x) >= 2 THEN ['{fidelity.NOT_PRESERVED}', '{fidelity.MAGNITUDE}'] ELSE ['{fidelity.NOT_PRESERVED}'] END
  WHEN k = 1 THEN ['{fidelity.FREQUENCY_DROPPED}'] ELSE []::VARCHAR[] END AS dose FROM r),
f AS (SELECT k, CASE k WHEN 2 THEN list_concat(['{segments.HIGH_RISK_PAIR}'], CASE WHEN y IS NULL OR x <> y THEN ['{fidelity.NUMBER_LOST}'] ELSE []::VARCHAR[] END, CASE WHEN l_suppkey % 2 = 1 THEN ['{fidelity.NEGATION_DIFFERS}'] ELSE []::VARCHAR[] END) WHEN 3 THEN list_concat(dose, ['{fidelity.DRUG_LOST}']) ELSE dose END AS flags FROM d)
SELECT k::BIGINT AS kind, array_to_string(flags, ',') AS flags, (CASE WHEN len(list_filter(flags, lambda v: v IN ('{fidelity.UNIT_MISMATCH}', '{fidelity.MAGNITUDE}', '{fidelity.DRUG_LOST}'))) > 0 THEN 2 WHEN len(list_filter(flags, lambda v: v <> '{segments.HIGH_RISK_PAIR}')) > 0 THEN 1 ELSE 0 END)::INTEGER AS action, count(*)::BIGINT AS n FROM f GROUP BY 1, 2, 3""")
def segment_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence a row and its translation, whose amount, unit, frequency, drug or negation may differ."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.expr("cast(cast(l_quantity as int) as string)").alias("a"), F.expr(f"cast({OUT} as string)").alias("b"))
    told = segments.segment_verdicts(rows.select((F.col("l_partkey") % 4).alias("kind"), F.expr(FROM_TEXT).alias("source"), F.expr(TO_TEXT).alias("output")))
    return told.groupBy("kind", F.array_join("flags", ",").alias("flags"), "action").agg(F.count(F.lit(1)).alias("n"))


PRICE = "cast(cast(l_extendedprice as int) as string)"


@query(f"""WITH r AS (SELECT l_suppkey % 5 AS k, cast(l_extendedprice as int) AS x FROM lineitem)
SELECT k::BIGINT AS kind, (CASE WHEN k IN (0, 1, 3) THEN 0 ELSE 1 END)::BIGINT AS lost, count(*)::BIGINT AS n FROM r GROUP BY 1, 2""")
def number_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number a row against itself, itself with a comma, another one, a dose range that begins with it, none."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("kind"), F.expr(PRICE).alias("x"), F.format_number(F.expr("cast(l_extendedprice as int)"), 0).alias("grouped"))
    output = F.expr("case kind when 0 then concat('about ', x, ' of them') when 1 then concat('about ', grouped, ' of them') when 2 then concat('about ', x, '1') when 3 then concat(x, '-9999999 mg') else 'about them' end")
    texts = rows.select("kind", F.concat("x", F.lit(" steps")).alias("a"), output.alias("b"))
    dosed = texts.withColumns({c: notes.doses(F.col(of), lexicon.Lexicon().units) for c, of in (("da", "a"), ("db", "b"))})
    hits = fidelity.number_hits(notes.bare_numbers(F.col("a"), F.col("da")), notes.bare_numbers(F.col("b"), F.col("db")), F.col("db"))
    return dosed.groupBy("kind", F.size(hits).cast("long").alias("lost")).agg(F.count(F.lit(1)).alias("n"))


ABSTAIN_WORD, STAKES_WORD, REASON_WORD = "case doc_id % 5 when 0 then ' TRUE ' when 1 then 'false' when 2 then '' when 3 then 'yes' end", "case doc_id % 4 when 0 then 'true' when 1 then 'x' when 2 then '' end", "case doc_id % 3 when 0 then ' ocr ' when 1 then 'nonsense' end"


@query(f"""WITH c AS (SELECT doc_id, quality = 1 AS abstain, toxic = 1 AS stakes, CASE WHEN doc_id % 2 = 0 THEN 'ambiguous' END AS reason FROM labels),
v AS (SELECT *, doc_id % 7 <> 0 AS given, {ABSTAIN_WORD} AS aw, {STAKES_WORD} AS sw, {REASON_WORD} AS rw FROM c),
m AS (SELECT *, CASE WHEN given AND coalesce(aw, '') <> '' THEN lower(trim(aw)) = 'true' ELSE abstain END AS a2, CASE WHEN given AND coalesce(sw, '') <> '' THEN lower(trim(sw)) = 'true' ELSE stakes END AS s2 FROM v)
SELECT doc_id, a2 AS should_abstain, s2 AS high_stakes, CASE WHEN NOT given THEN reason WHEN a2 THEN CASE WHEN trim(rw) = 'ocr' THEN 'ocr' ELSE reason END END AS reason FROM m""")
def verdict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as cases; reviewers' words for six of seven."""
    labels = table(spark, sf_dir, "labels")
    cases = labels.select("doc_id", (F.col("quality") == 1).alias("should_abstain"), (F.col("toxic") == 1).alias("high_stakes"), F.expr("CASE WHEN doc_id % 2 = 0 THEN 'ambiguous' END").alias("reason"))
    words = labels.filter("doc_id % 7 <> 0").select("doc_id", F.expr(ABSTAIN_WORD).alias("should_abstain"), F.expr(STAKES_WORD).alias("high_stakes"), F.expr(REASON_WORD).alias("reason"))
    return reconcile.merge_verdicts(cases, words, "doc_id", [], ["should_abstain", "high_stakes"], "reason", ["ambiguous", "ocr"], "should_abstain")
