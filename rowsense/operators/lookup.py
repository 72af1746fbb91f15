"""Name lookup: printed names against a dimension of entries, by alias, by specimen, and by an ordered cascade.

dim: key, names (array of names and aliases), specimen, ord. Facts keep their rows; a name without entry has null key.
The join's way is Spark's choice by the dimension's size. Defined results: null names match nothing; of tokens that two
entries share, the later entry (by ord) has it; an empty dimension matches nothing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import bilingual_pair, specimen_prefix
from ..functions.text import norm_name, trimmed, unit_key


def alias_tokens(dim: DataFrame, *by: str) -> DataFrame:
    """token (and the columns of by) with the key and specimen of the last entry that has it."""
    rows = dim.select("key", "specimen", "ord", F.explode(F.concat(F.array("key"), "names")).alias("name")).select(norm_name(F.col("name")).alias("token"), "key", "specimen", "ord").filter("token <> ''")
    return rows.groupBy("token", *by).agg(F.max_by(F.struct("key", "specimen"), F.struct("ord", "key")).alias("_e")).select("token", *by, F.col("_e.key").alias("key"), *([] if "specimen" in by else [F.col("_e.specimen").alias("entry_specimen")]))


def alias_lookup(facts: DataFrame, dim: DataFrame, name: str = "name") -> DataFrame:
    """facts with token, key and entry_specimen."""
    return facts.withColumn("token", norm_name(F.col(name))).join(alias_tokens(dim), "token", "left")


def scoped_lookup(facts: DataFrame, dim: DataFrame, name: str = "name", specimen: str = "specimen") -> DataFrame:
    """As alias_lookup, by specimen and token."""
    scoped = scoped_tokens(dim).withColumnRenamed("specimen", "_specimen")
    rows = facts.withColumn("token", norm_name(F.col(name)))
    return rows.join(scoped, (rows["token"] == scoped["token"]) & (rows[specimen] == scoped["_specimen"]), "left").drop(scoped["token"]).drop("_specimen")


def scoped_tokens(dim: DataFrame) -> DataFrame:
    """token, specimen and key of the names that stand for an entry only where its specimen is printed: scoped_names, or all
    names of a dimension without that column."""
    if "scoped_names" not in dim.columns:
        return alias_tokens(dim, "specimen")
    rows = dim.select("key", "specimen", "ord", F.explode("scoped_names").alias("name")).select(norm_name(F.col("name")).alias("token"), "key", "specimen", "ord").filter("token <> ''")
    return rows.groupBy("token", "specimen").agg(F.max_by("key", F.struct("ord", "key")).alias("key"))


BRACKET = r"[(（]([^)）]*)[)）]"


def _specimen_in_brackets(x: Column) -> Column:
    inner = trimmed(F.regexp_extract(x, BRACKET, 1))
    return F.when(inner.isin("尿", "尿液"), "urine").when(inner.isin("血", "血清", "血浆", "全血"), "blood")


def _forms(name: Column) -> list[Column]:
    """The name, and without a closing word for measuring."""
    return [trimmed(name), trimmed(F.regexp_replace(trimmed(name), "(测定|检测)$", ""))]


def _rest(x: Column) -> Column:
    return F.nullif(trimmed(specimen_prefix(x)["rest"]), F.lit(""))


def declared_specimens(name: Column) -> Column:
    """The specimens that a name itself tells, by a prefix or in brackets."""
    return F.array_distinct(F.array_compact(F.array(*(x for f in _forms(name) for x in (specimen_prefix(f)["specimen"], _specimen_in_brackets(f))))))


def name_candidates(name: Column) -> Column:
    """Weaker readings of a name in their order: without words for measuring, specimens in brackets, specimen prefixes."""
    bare = lambda x: F.when(_specimen_in_brackets(x).isNotNull(), trimmed(F.regexp_replace(x, f"^(.*?){BRACKET}", "$1")))
    readings = [y for f in _forms(name) for y in (f, bare(f), _rest(f), bare(_rest(f)), _rest(bare(f)), bare(_rest(bare(f))))]
    return F.filter(F.array_except(F.array_compact(F.array(*readings)), F.array(trimmed(name))), lambda x: x != "")


def lookup_cascade(facts: DataFrame, dim: DataFrame, name: str = "name", specimen: str = "specimen", declined: tuple[str, ...] = ("钙", "镁")) -> DataFrame:
    """facts with key and matched_by: scoped, direct, candidate or unmatched.

    A reading matches a scoped name by the printed specimen alone; any other name unless the specimens conflict. The name as
    printed comes first; then, unless the name tells two specimens or another than the printed one, its candidates in order
    under the specimen that it tells; then both halves of a bilingual pair, which mustn't disagree (those declined have no
    second reading). Each distinct name and specimen is looked up once and joined back, so no row needs a number."""
    n, s = F.col("_n"), F.col("_s")
    asked = facts.select(F.col(name).alias("_n"), F.col(specimen).alias("_s")).filter("_n is not null").distinct()
    told = declared_specimens(n)
    known = lambda x: F.coalesce(x.isin("urine", "blood"), F.lit(False))
    halted = (F.size("_told") > 1) | ((F.size("_told") == 1) & known(s) & (F.col("_told")[0] != s))
    effective = F.coalesce(F.try_element_at("_told", F.lit(1)), s)
    pair = bilingual_pair(n)
    one = lambda at, text, of: F.struct(F.lit(at).alias("at"), text.alias("text"), of.alias("of"))
    later = F.transform(name_candidates(n), lambda x, i: F.struct((i + 1).alias("at"), x.alias("text"), effective.alias("of")))
    halves = F.when(pair.isNotNull() & ~pair["cjk"].isin(*declined), F.array(one(98, pair["cjk"], effective), one(99, pair["latin"], effective))).otherwise(F.expr("cast(array() as array<struct<at:int,text:string,of:string>>)"))
    readings = F.when(halted, F.array(one(0, n, s))).otherwise(F.concat(F.array(one(0, n, s)), later, halves))
    rows = asked.withColumn("_told", told).select("_n", "_s", F.explode(readings).alias("_r")).select("_n", "_s", "_r.at", norm_name(F.col("_r.text")).alias("token"), F.col("_r.of").alias("of"))
    scoped = scoped_tokens(dim).select("token", F.col("specimen").alias("of"), F.col("key").alias("_scoped"))
    names = scoped.select("token", F.lit(True).alias("_is_scoped")).distinct()
    met = rows.join(alias_tokens(dim), "token", "left").join(scoped, ["token", "of"], "left").join(names, "token", "left")
    plain = F.when(~known(F.col("of")) | (F.col("entry_specimen") == F.col("of")), F.col("key"))
    by_scope = known(F.col("of")) & F.coalesce("_is_scoped", F.lit(False))
    found = met.withColumn("_key", F.when(by_scope, F.col("_scoped")).otherwise(F.coalesce(plain, F.when(known(F.col("of")), F.col("_scoped"))))).withColumn("_by", F.when(by_scope | plain.isNull(), "scoped").when(F.col("at") == 0, "direct").otherwise("candidate"))
    hit = found.filter("_key is not null")
    best = hit.groupBy("_n", "_s").agg(F.min(F.when(F.col("at") < 99, F.struct("at", "_key", "_by"))).alias("_m"), F.max(F.when(F.col("at") == 99, F.col("_key"))).alias("_latin"))
    agreed = F.when((F.col("_m.at") < 98) | F.col("_latin").isNull() | (F.col("_latin") == F.col("_m._key")), F.col("_m"))
    back = best.select("_n", "_s", agreed.alias("_m"))
    out = facts.join(back, facts[name].eqNullSafe(F.col("_n")) & facts[specimen].eqNullSafe(F.col("_s")), "left")
    return out.select(*(facts[c] for c in facts.columns), F.col("_m._key").alias("key"), F.coalesce("_m._by", F.lit("unmatched")).alias("matched_by"))


def unit_collisions(units: DataFrame, unit: str = "unit") -> DataFrame:
    """Comparison keys that more than one normalised unit has."""
    from ..functions.text import norm_unit

    return units.select(unit_key(F.col(unit)).alias("unit_key"), norm_unit(F.col(unit)).alias("unit")).groupBy("unit_key").agg(F.sort_array(F.collect_set("unit")).alias("units")).filter(F.size("units") > 1)


def first_factors(factors: DataFrame, factor: Column, *more: Column) -> DataFrame:
    """One row for each key and unit: the first by the column ord where there is one, else the least."""
    order = [F.col("ord")] if "ord" in factors.columns else []
    held = F.struct(*(c.alias(f"by{i}") for i, c in enumerate(order)), *(m.alias(f"m{i}") for i, m in enumerate(more)), factor.alias("f"))
    return factors.groupBy(F.col("key").alias("_k"), unit_key(F.col("from_unit")).alias("_u")).agg(F.min(held).alias("_first"))


def convert(facts: DataFrame, factors: DataFrame, key: str = "key", value: str = "value", unit: str = "unit", allowed: str | None = None) -> DataFrame:
    """facts with converted and converted_unit where factors (key, from_unit, to_unit, factor, ord) has the key and unit, by the
    first factor. allowed: a column of units that need no conversion, and so get none."""
    table = first_factors(factors, F.col("factor"), F.col("to_unit"))
    met = facts.join(table, (F.col(key) == F.col("_k")) & (unit_key(F.col(unit)) == F.col("_u")), "left")
    own = F.coalesce(F.exists(allowed, lambda a: unit_key(a) == unit_key(F.col(unit))), F.lit(False)) if allowed else F.lit(False)
    return met.withColumns({"converted_unit": F.when(~own, F.col("_first.m0")), "converted": F.when(~own, F.col(value) * F.col("_first.f"))}).drop("_k", "_u", "_first")


def adult_only(entries: DataFrame, age: Column, keys: Iterable[str], least_age: int = 18, bounds: Iterable[str] = ("ref_low", "ref_high", "critical_low", "critical_high")) -> DataFrame:
    """entries (key, interpretation and bounds), of which those with bands for adults alone lose them for the young, so that
    no one can read them, and become report-only. An unknown age keeps them."""
    young = F.coalesce((age < least_age) & (F.col("interpretation") == "ours") & F.col("key").isin(*keys), F.lit(False))
    return entries.withColumns({"interpretation": F.when(young, "report-only").otherwise(F.col("interpretation")), **{b: F.when(~young, F.col(b)) for b in bounds}})


def display_factor(facts: DataFrame, factors: DataFrame, key: str = "key", unit: str = "unit", allowed: str = "allowed_units") -> DataFrame:
    """facts with to_display: 1 where the unit is allowed as it is, the factor's inverse where one leads to the unit, else null."""
    table = first_factors(factors, F.col("factor")).select("_k", "_u", (1 / F.col("_first.f")).alias("_f"))
    met = facts.join(table, (F.col(key) == F.col("_k")) & (unit_key(F.col(unit)) == F.col("_u")), "left")
    own = F.exists(allowed, lambda a: unit_key(a) == unit_key(F.col(unit)))
    return met.withColumn("to_display", F.when(F.coalesce(own, F.lit(False)), 1.0).otherwise(F.col("_f"))).drop("_k", "_u", "_f")
