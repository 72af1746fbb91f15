"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions only.

1. Each source's target is its weight's part of the mix, stopped at `cap` times the source, with the excess reshared
   by weight (water filling, in closed form over the sources ordered by cap / weight).
2. A source's documents lie on a line of words in the order of a hash. The line is cut into blocks; blocks are drawn
   in passes, each in a keyed permutation of its own (swap-or-not rounds, a bijection for any number of blocks), until the
   source's quota is used; the last block is cut to the word.
3. The tree's root holds the block quotas of all sources. A node gives its left child half of its blocks, drawn
   without replacement: source by source a hypergeometric variate (inverse distribution function of a hashed uniform).
   Quotas are conserved exactly, and the leaves are the output shards.
4. A source's permuted draws go to the shards in turn by the leaves' quotas, so shards get disjoint draws: draws join the
   shards' stretches by source and range. Within a shard they are sorted by a hash.

Words are counted once: documents are written with their sizes and a number of their own; the mix's texts stay in the table
they come from, which is read again, and meet their draws by a hash of id and text, unless two rows have one. The line's prefix sums use buckets
of about the square root of a source's documents, so a source that holds most rows is many keys. A node of the tree is a row
with a number per source; the shards' stretches are a row per source and shard.

Defined results: null or blank text has size 0 and no draws; null is a source, the last one; rows with equal ids are
documents of their own; an empty table gives an empty mix; the documents' own columns, whatever their names, are carried
as they are (mix() replaces those named size, source_size, target or pieces).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import whole, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
#: Rounds of a permutation.
ROUNDS = 24


def words(text: str) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, rank, n_docs, source_size, target of rows with source and size."""
    sums = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    rank = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long")
    named = sums.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int")))
    limit = F.col("source_size") * F.lit(float(cap))
    everything, before = Window.partitionBy(), Window.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    filled = (
        named.withColumn("limit", limit)
        .withColumn("all_target", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("stopped", F.col("limit") * (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), zero)) <= F.col("weight") * (F.col("all_target") - F.coalesce(F.sum("limit").over(before), zero)))
    )
    stopped = lambda c: F.coalesce(F.sum(F.when(F.col("stopped"), F.col(c))).over(everything), zero)
    level = F.try_divide(F.col("all_target") - stopped("limit"), F.col("all_weight") - stopped("weight"))
    return filled.withColumn("level", level).select("source", "rank", "n_docs", "source_size", F.when(F.col("stopped"), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("weight"))).alias("target"))


def _log_factorial(n: Column) -> Column:
    x = F.greatest(n, F.lit(1)).cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(x * 6.283185307179586) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n <= 1, F.lit(0.0)).otherwise(series)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is made once."""
    return F.transform(F.array(value), body)[0]


def _hypergeometric(good: Column, bad: Column, drawn: Column, uniform: Column) -> Column:
    """How many of `drawn` draws without replacement are good; eight deviations around the mean are looked at."""
    total = good + bad
    mean = F.coalesce(F.try_divide(drawn.cast("double") * good, total), F.lit(0.0))
    spread = F.sqrt(mean * F.coalesce(F.try_divide(bad.cast("double"), total), F.lit(0.0))) * 8 + 2
    low = F.greatest(F.lit(0).cast("long"), drawn - bad, F.floor(mean - spread))
    high = F.greatest(low, F.least(drawn, good, F.ceil(mean + spread)))
    log_p = lambda k: -(_log_factorial(k) + _log_factorial(good - k) + _log_factorial(drawn - k) + _log_factorial(bad - drawn + k))
    # What a lambda uses again is bound first: it would be made anew for each element.
    logs = F.transform(F.sequence(low, high), log_p)
    shares = _bound(logs, lambda v: _bound(F.array_max(v), lambda top: F.transform(v, lambda y: F.exp(y - top))))
    start = F.struct(F.lit(0.0).alias("seen"), F.lit(-1).cast("long").alias("k"))

    def walked(v: Column, most: Column) -> Column:
        return F.aggregate(v, start, lambda a, y: F.when((a["seen"] > most) & (a["k"] >= 0), a).otherwise(F.struct((a["seen"] + y).alias("seen"), (a["k"] + 1).alias("k"))))

    walk = _bound(shares, lambda v: _bound(uniform * F.aggregate(v, F.lit(0.0), lambda a, y: a + y), lambda most: walked(v, most)))
    return low + F.greatest(walk["k"], F.lit(0).cast("long"))


def _uniform(*of: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") / float(1 << 53)


def splitting_tree(plan: DataFrame, levels: int, seed: int) -> DataFrame:
    """rank, shard, quota for the 2**levels shards of plan's rank and draws."""
    listed = F.sort_array(F.collect_list(F.struct("rank", F.col("draws").cast("long").alias("draws"))))
    node = plan.agg(listed.alias("all")).select(F.lit(0).cast("long").alias("node"), F.transform("all", lambda x: x["draws"]).alias("quotas"))
    for level in range(levels):
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q)
        start = F.struct(total.alias("rest"), F.floor(total / 2).cast("long").alias("drawn"), F.expr("cast(array() as array<bigint>)").alias("left"))

        at = level

        def draw(a: Column, q: Column) -> Column:
            u = _uniform(F.lit(seed), F.lit(at), F.col("node"), F.size(a["left"]))
            got = F.when(q > 0, _hypergeometric(q, a["rest"] - q, a["drawn"], u)).otherwise(F.lit(0).cast("long"))
            return F.transform(F.array(got), lambda x: F.struct((a["rest"] - q).alias("rest"), (a["drawn"] - x).alias("drawn"), F.concat(a["left"], F.array(x)).alias("left")))[0]

        left = F.aggregate("quotas", start, draw)["left"]
        node = node.select("node", "quotas", left.alias("left")).select(
            F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")), F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("quotas", "left", lambda q, x: q - x).alias("quotas")))).alias("child")
        ).select("child.*")
    return node.select(F.col("node").alias("shard"), F.posexplode("quotas").alias("rank", "quota")).select(F.col("rank").cast("long").alias("rank"), "shard", "quota")


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """A keyed bijection of 0 .. n - 1: in each round x and a partner (a keyed sum less x) swap places or not, as a hash of
    the larger of both says."""
    m = F.greatest(n, F.lit(1).cast("long"))

    def turn(v: Column, i: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, i), m) - v, m)
        return _bound(partner, lambda w: F.when(F.pmod(F.xxhash64(*key, i, F.greatest(v, w)), F.lit(2)) == 1, w).otherwise(v))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, turn)


def sized(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", carry: list[str] | None = None, seed: int = 17) -> DataFrame:
    """doc (a struct of the columns to carry, all if None), source, size, h (what orders the line) of each row."""
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns if carry is None or c in carry))
    return docs.select(doc.alias("doc"), F.col(source).alias("source"), words(text).alias("size"), F.xxhash64(F.lit(seed), F.col(doc_id), F.xxhash64(whole(text))).alias("h"))


NONE = "cast(array() as array<struct<pass:bigint,word_start:bigint,n_words:bigint,shard:bigint,order_key:bigint>>)"


def _of() -> Column:
    """What joins rows to their source's: null is a source."""
    return F.struct(F.col("source").alias("source")).alias("of")


def draws(base: DataFrame, block_words: int = 1024, shard_blocks: int = 4096, seed: int = 17, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> tuple[DataFrame, DataFrame]:
    """The sources' plan (of, source_size, target), and row, size, pieces of the rows that the mix draws. base: a written table of
    row, source, size, h."""
    long = lambda x: F.lit(x).cast("long")
    b = long(block_words)
    plan = source_targets(base.select("source", "size"), weights, share, cap)
    plan = (
        plan.withColumn("passes", F.floor(F.coalesce(F.expr("try_divide(round(target), source_size)").cast("double"), F.lit(0.0))).cast("long"))
        .withColumn("rest", F.round("target").cast("long") - F.col("passes") * F.col("source_size"))
        .withColumn("full", F.floor(F.col("source_size") / b).cast("long"))
        .withColumn("blocks", F.ceil(F.col("source_size") / b).cast("long"))
        .withColumn("draws", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / b).cast("long"))
        .withColumn("buckets", F.ceil(F.sqrt("n_docs")).cast("long"))
    )
    plan = written(plan, "targets")
    n = plan.agg(F.sum("draws")).first()[0] or 0
    levels = max(0, (max(1, -(-n // shard_blocks)) - 1).bit_length())
    # A shard's stretch of a source's draws, with the cells of the source's mean stretch that it touches.
    mean = F.greatest(F.ceil(F.col("draws") / (1 << levels)), long(1)).cast("long")
    quotas = splitting_tree(plan.select("rank", "draws"), levels, seed).join(plan.select("rank", mean.alias("mean")), "rank")
    until = F.sum("quota").over(Window.partitionBy("rank").orderBy("shard"))
    stretches = quotas.withColumn("until", until).filter("quota > 0").withColumn("since", F.col("until") - F.col("quota"))
    cells = F.sequence(F.floor(F.col("since") / F.col("mean")).cast("long"), F.floor((F.col("until") - 1) / F.col("mean")).cast("long"))
    stretches = written(stretches.select("rank", "shard", "since", "until", F.explode(cells).alias("cell")), "stretches")

    plan = plan.withColumn("mean", mean).withColumn("of", _of())
    thin = base.select("row", "size", "h", _of()).join(plan.select("of", "rank", "buckets", "passes", "rest", "full", "blocks", "mean"), "of").drop("of").withColumn("bucket", F.pmod("h", F.col("buckets")))
    # Running sums by bucket, then within buckets: two narrow steps in place of one window over a source.
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = thin.groupBy("rank", "bucket").agg(F.sum("size").alias("all")).select("rank", "bucket", F.coalesce(F.sum("all").over(before), long(0)).alias("start"))
    within = Window.partitionBy("rank", "bucket").orderBy("h", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    lined = thin.filter("size > 0").join(starts, ["rank", "bucket"]).withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(within), long(0)))
    blocks = F.sequence(F.floor(F.col("at") / b).cast("long"), F.floor((F.col("at") + F.col("size") - 1) / b).cast("long"))
    runs = lined.withColumn("j", F.explode(blocks)).withColumn("pass", F.explode(F.sequence(long(0), F.col("passes"))))
    placed = F.when(F.col("j") < F.col("full"), permuted(F.col("j"), F.col("full"), F.lit(seed), F.col("rank"), F.col("pass"))).otherwise(F.col("j"))
    last = F.floor(F.col("rest") / b).cast("long")
    cut = F.when((F.col("pass") < F.col("passes")) | (F.col("placed") < last), (F.col("j") + 1) * b).when(F.col("placed") == last, F.col("j") * b + F.col("rest") % b).otherwise(long(0))
    first = F.greatest(F.col("j") * b, F.col("at"))
    runs = runs.withColumn("placed", placed).withColumn("n_words", F.least(cut, F.col("at") + F.col("size")) - first).filter("n_words > 0")
    runs = runs.withColumn("position", F.col("pass") * F.col("blocks") + F.col("placed")).withColumn("word_start", first - F.col("at")).withColumn("cell", F.floor(F.col("position") / F.col("mean")).cast("long"))
    met = runs.join(stretches, ["rank", "cell"]).filter("position >= since and position < until")
    piece = F.struct("pass", "word_start", "n_words", "shard", F.xxhash64(F.lit(seed), F.col("rank"), F.col("position")).alias("order_key"))
    return plan, met.groupBy("row").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(piece)).alias("pieces"))


def drawn(rows: DataFrame, **how) -> DataFrame:
    """sized()'s doc and size, with source_size, target and pieces: what the mix takes of the document, each a run of its
    words for one shard; order_key orders a shard. how: as draws() has it."""
    base = written(rows.withColumn("row", F.monotonically_increasing_id()), "sized")
    plan, pieces = draws(base.select("row", "source", "size", "h"), **how)
    out = base.withColumn("of", _of()).join(plan.select("of", "source_size", "target"), "of").join(pieces.drop("size"), "row", "left")
    return out.select("doc", "size", "source_size", "target", F.coalesce("pieces", F.expr(NONE)).alias("pieces"))


def drawn_texts(rows: DataFrame, body: Column, **how) -> DataFrame:
    """doc, size, pieces of sized()'s rows that the mix draws. Texts aren't written: rows are read again, and their draws come by h."""
    lines = written(rows.select("source", "size", "h"), "lines")
    if not lines.filter("size > 0").groupBy("h").count().filter("count > 1").isEmpty():
        # Rows of one hash are told apart by a number, which holds in a written table alone.
        return drawn(rows, **how).select("doc", "size", "pieces")
    pieces = draws(lines.withColumn("row", F.col("h")), **how)[1]
    return rows.select("doc", "h").filter(body.rlike(WORD)).join(pieces, F.col("h") == F.col("row")).select("doc", "size", "pieces")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", carry: list[str] | None = None, **how) -> DataFrame:
    """docs' columns (those to carry) with size, source_size, target and pieces, for draws()'s parameters."""
    own = ("size", "source_size", "target", "pieces")
    rows = drawn(sized(docs, text, source, doc_id, carry), **how)
    keep = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in own and (carry is None or c in carry)]
    return rows.select(*keep, *own)


def mixed_texts(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **how) -> DataFrame:
    """The mix itself: docs' columns and shard, order_key, a row per run of a document's words that one shard gets in one
    pass, with those words as its text, dealt to shards and in each shard's order. Documents without words are not in it."""
    body = F.coalesce(F.col(f"doc.`{text}`"), F.lit(""))
    rows = drawn_texts(sized(docs, text, source, doc_id), body, **how)

    def longer(a: Column, x: Column) -> Column:
        """Neighbouring runs of one pass and shard as one."""
        last = F.try_element_at(a, F.lit(-1))
        joins = (F.size(a) > 0) & (last["pass"] == x["pass"]) & (last["shard"] == x["shard"]) & (last["word_start"] + last["n_words"] == x["word_start"])
        grown = F.struct(last["pass"].alias("pass"), last["word_start"].alias("word_start"), (last["n_words"] + x["n_words"]).alias("n_words"), last["shard"].alias("shard"), last["order_key"].alias("order_key"))
        return F.when(joins, F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(grown))).otherwise(F.concat(a, F.array(x)))

    pattern = r"(?s)([\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"
    # A text that is cut is read into words once; runs leave with their own words alone.
    joined = lambda ws, x: F.array_join(F.slice(ws, (x["word_start"] + 1).cast("int"), x["n_words"].cast("int")), "")
    placed = lambda x, part: F.struct(x["shard"].alias("shard"), x["order_key"].alias("order_key"), part.alias("text"))
    cut = F.exists("runs", lambda x: x["n_words"] < F.col("size"))
    parts = F.when(cut, _bound(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), lambda ws: F.transform("runs", lambda x: placed(x, joined(ws, x))))).otherwise(F.transform("runs", lambda x: placed(x, body)))
    rows = rows.select("doc", "size", body.alias("body"), F.aggregate("pieces", F.expr(NONE), longer).alias("runs")).select("doc", F.explode(parts).alias("run"))
    keep = [F.col("run.text").alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in ("shard", "order_key")]
    out = rows.select(*keep, F.col("run.shard").alias("shard"), F.col("run.order_key").alias("order_key"))
    return out.repartition("shard").sortWithinPartitions("shard", "order_key")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents, mixed to weights 5, 2, 1 and 150% of all words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + x["n_words"])
    return mix(docs, carry=["doc_id"]).select("doc_id", "size", "source_size", "target", taken.alias("taken"))
