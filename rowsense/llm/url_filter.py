r"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for what no rule decides.

Host and path are cut from the url as written. A rule (verdict, host, path) fits its host and all subdomains where the url's path
starts with the rule's; the longest wins (host and path together, then the host alone, then block). Rules are a list, looked
up by joins on the last labels of a host, one for each number of labels that rules have, so rows never multiply.

The urls that rules decide are the labels. Features: length, depth, share of digits, entropy of characters, counts of
parameters, labels and hyphens, length of the host, and the smoothed share of blocked urls of the host's last and last two
labels. Those shares count all labelled urls; for training each fifth of the hosts is left out of its own shares. The trees
are fitted on at most SAMPLE distinct labelled urls with the smallest hashes; all else covers all rows.

Defined results: a null url, or one without `://`, has an empty host and path, no rule, and the trees' verdict; repeated rows are
judged alike; labels of one verdict alone teach nothing, so what no rule decides is allowed; an empty table gives no rows;
further columns of any name are left out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import whole, written

#: Distinct labelled urls that the trees are fitted on, at most; all else counts all rows.
SAMPLE = 20_000
#: Parts of the hosts, by hash, whose labels are left out of their own shares in training.
FOLDS = 5
#: Labelled urls of the overall share that each suffix's share starts with.
PRIOR = 10
TREES, DEPTH, STEP = 20, 4, 0.2
#: The rules of the query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEXICAL = ("length", "depth", "digits", "entropy", "parameters", "labels", "hyphens", "host_length")
FEATURES = (*LEXICAL, "share_1", "share_2")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z as a-z."""
    return F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), *LOWERED)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def lexical(url: Column, host: Column, path: Column) -> list[Column]:
    """LEXICAL features; an empty url has zeros."""
    n = F.char_length(url)
    some = F.greatest(n, F.lit(1))
    # Equal characters stand together when sorted, so runs are counts.
    runs = F.transform(F.regexp_extract_all(F.array_join(F.sort_array(F.split(url, "")), ""), F.lit(r"(?s)((.)\2*)"), F.lit(1)), lambda r: F.char_length(r).cast("double"))
    entropy = F.log2(some.cast("double")) - F.aggregate(runs, F.lit(0.0), lambda a, c: a + c * F.log2(c)) / some
    query = F.regexp_extract(url, r"(?s)\A[^?#]*\?([^#]*)", 1)
    count = lambda text, sign: (F.char_length(text) - F.char_length(F.translate(text, sign, ""))).cast("double")
    parts = lambda text, sign: F.size(F.filter(F.split(text, sign), lambda x: x != "")).cast("double")
    return [
        n.cast("double").alias("length"),
        parts(path, "/").alias("depth"),
        (count(url, "0123456789") / some).alias("digits"),
        entropy.alias("entropy"),
        parts(query, "&").alias("parameters"),
        parts(host, "[.]").alias("labels"),
        count(host, "-").alias("hyphens"),
        F.char_length(host).cast("double").alias("host_length"),
    ]


def suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def ruled(rows: DataFrame, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """rows (with host and path), and the rule that decides (host and path together; else null) with its verdict."""
    spark, by_labels = rows.sparkSession, defaultdict(lambda: defaultdict(list))
    for verdict, host, path in rules:
        by_labels[host.count(".") + 1][host].append({"path": path, "length": len(host) + len(path), "host_length": len(host), "blocks": verdict == "block", "rule": host + path, "verdict": verdict})
    kind = pa.list_(pa.struct([("path", pa.string()), ("length", pa.int32()), ("host_length", pa.int32()), ("blocks", pa.bool_()), ("rule", pa.string()), ("verdict", pa.string())]))
    held = []
    for labels, hosts in sorted(by_labels.items()):
        table = pa.table({f"_host_{labels}": list(hosts), f"_rules_{labels}": pa.array(list(hosts.values()), kind)})
        rows = rows.join(spark.createDataFrame(table), suffix(F.col("host"), labels) == F.col(f"_host_{labels}"), "left")
        held.append(f"_rules_{labels}")
    fitting = [F.filter(c, lambda r: F.startswith(F.col("path"), r["path"])) for c in held]
    # Without a rule for the host the array is null.
    ranks = [F.array_max(F.transform(f, lambda r: F.struct(r["length"], r["host_length"], r["blocks"], r["rule"], r["verdict"]))) for f in fitting]
    best = F.array_max(F.array(*ranks)) if ranks else F.lit(None).cast("struct<rule:string,verdict:string>")
    return rows.withColumn("_best", best).withColumn("rule", F.col("_best.rule")).withColumn("decided", F.col("_best.verdict")).drop("_best", *held, *(f"_host_{n}" for n in by_labels))


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url (null: empty), host, path."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), whole("url").alias("url"))
    return rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))


class Shares:
    """How many labelled urls each suffix has, and how many of them are blocked: in all, and of each fold of hosts."""

    def __init__(self, labelled: DataFrame) -> None:
        fold = F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")
        suffixes = F.explode(F.array(*(F.struct(F.lit(n).alias("labels"), suffix(F.col("host"), n).alias("suffix")) for n in (1, 2))))
        rows = labelled.select(suffixes.alias("of"), fold.alias("fold"), (F.col("decided") == "block").cast("long").alias("y"))
        of_fold = lambda k, what: F.coalesce(F.sum(F.when(F.col("fold") == k, what)), F.lit(0))
        cells = [F.array(*(of_fold(k, F.lit(1)) for k in range(FOLDS))).alias("n"), F.array(*(of_fold(k, F.col("y")) for k in range(FOLDS))).alias("y")]
        self.table = written(rows.groupBy("of.labels", "of.suffix").agg(*cells), "shares")
        add = lambda c: F.coalesce(F.sum(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))
        self.rows, self.blocked = self.table.filter("labels = 1").agg(add(F.col("n")), add(F.col("y"))).first()

    def both(self) -> bool:
        return 0 < self.blocked < self.rows

    def joined(self, rows: DataFrame, training: bool) -> DataFrame:
        """rows (with host), share_1 and share_2."""
        fold = F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")
        prior = self.blocked / self.rows
        for n in (1, 2):
            table = self.table.filter(F.col("labels") == n).select(F.col("suffix").alias("_suffix"), F.col("n").alias("_n"), F.col("y").alias("_y"))
            rows = rows.join(table, suffix(F.col("host"), n) == F.col("_suffix"), "left")
            total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x) - (F.get(c, fold) if training else F.lit(0))
            seen, hit = (F.coalesce(total(F.col(c)), F.lit(0)) for c in ("_n", "_y"))
            rows = rows.withColumn(f"share_{n}", (hit + PRIOR * prior) / (seen + PRIOR)).drop("_suffix", "_n", "_y")
        return rows


def vectors(rows: DataFrame) -> DataFrame:
    held = rows.select("*", *lexical(F.col("url"), F.col("host"), F.col("path")))
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(held)


def sampled(labelled: DataFrame, rows: int, distinct: int) -> DataFrame:
    """At most SAMPLE distinct labelled urls: those with the smallest hashes. A bar on the hash keeps about twice as many first."""
    h = F.xxhash64("url")
    bar = min(1.0, 2 * SAMPLE / max(distinct, 1))
    near = labelled if bar == 1.0 else labelled.filter(h < F.lit(int(-(2**63) + bar * 2**64)))
    return near.select("url", "host", "path", "decided").distinct().orderBy(h, "url").limit(SAMPLE)


def fit(labelled: DataFrame, shares: Shares) -> GBTClassificationModel:
    """Trees of labelled rows (url, host, path, decided)."""
    distinct = labelled.agg(F.approx_count_distinct("url")).first()[0]
    train = shares.joined(sampled(labelled, shares.rows, distinct), training=True)
    rows = vectors(train).select("features", (F.col("decided") == "block").cast("double").alias("label"), F.xxhash64("url").alias("h"), "url")
    # The bounded sample in one order, so that a rerun gives the same trees.
    held = written(rows.repartition(1).sortWithinPartitions("h", "url").select("features", "label"), "urls")
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7).fit(held)


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict and score (0 to 1: how likely a page that no rule decides is blocked; else null)."""
    rows = ruled(parsed(pages), list(rules))
    labelled = rows.filter(F.col("decided").isNotNull())
    shares = Shares(labelled)
    if not shares.both():
        return rows.select("page_id", "host", "path", "rule", F.coalesce("decided", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    model = fit(labelled, shares)
    scored = model.transform(vectors(shares.joined(rows, training=False)))
    score = F.when(F.col("decided").isNull(), F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("decided", F.when(score >= 0.5, "block").otherwise("allow")).alias("verdict"), score.alias("score"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), RULES)
