"""Exact top-k inner products by norm-sorted blocks.

Vectors become whole numbers, so scores are exact. The vectors' second moments (a matrix of the dimension's size, summed
by partition) give the SVD's rotation; after it the first coordinates hold most of the length. Candidates are dealt into
blocks by descending length. Queries meet them in rounds, the longest first: one group of blocks, then 4, 16, 64 and so on.
Each round raises the queries' k-th scores so far, below which the next one prunes:

- a query skips a block when its length times the block's largest is below the bound;
- where the first rotated coordinates hold enough of the length to rule out pairs, their partial sum plus the product of the
  residual lengths (Cauchy-Schwarz) is an upper bound, and only blocks' candidates that some query may need are scored.

Bounds have a margin for rounding, pairs are pruned only strictly below, and full scores are integer sums. Blocks are scored
by one product of matrices: in 32-bit floats where lengths show that every partial sum is a whole number below 2**24, in
64-bit ones below 2**53, else in 64-bit integers or Python's whole numbers. Blocks travel in the narrowest integers that hold
them. A task has a cell of a grid, SIDE blocks of queries and of candidates, and gives each query's best k of the cell: no
row of pairs is made.

Defined results: vectors null, or with null or non-finite components, take no part; shorter vectors count as filled up
with zeros; ties go to the smaller id; rows with equal ids are candidates of their own, but never of a query with that id;
a null id is a candidate, after all others in ties; an empty table gives an empty result. Components of 2**62 and more in
absolute value after scaling, and results beyond 64 bits, are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release, written

NULL_ID = np.iinfo(np.int64).max
#: Blocks of queries, and of candidates, that a task multiplies with one another.
SIDE = 16
#: Queries of a block that are scored at a time; and the share of the squared length that the first rotated coordinates must hold to be asked.
TILE, CONCENTRATED = 512, 0.9
FOUND = "query_id long, vec_id long, score long"
FOUND_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def whole_vectors(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """vec_id, v (array<bigint>), norm of the rows that take part."""
    x = F.col(embedding).cast("array<double>")
    fit = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    v = F.transform(x, lambda y: F.floor(y * scale).cast("double"))
    checked = F.when(F.forall("v", lambda y: F.abs(y) < float(1 << 62)), F.col("v").cast("array<bigint>")).otherwise(F.raise_error(F.lit("a component is too large for a score")).cast("array<bigint>"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y))
    return vectors.filter(F.col(embedding).isNotNull()).filter(fit).select(F.coalesce(F.col(vec_id).cast("long"), F.lit(int(NULL_ID))).alias("vec_id"), v.alias("v")).select("vec_id", checked.alias("v"), norm.alias("norm"))


def matrix(batch: pa.RecordBatch, d: int, kind: type = np.float64) -> np.ndarray:
    lists = batch.column("v")
    n = np.diff(lists.offsets.to_numpy())
    out = np.zeros((batch.num_rows, d), kind)
    if len(n) and (n == d).all():
        out[:] = lists.flatten().to_numpy().reshape(-1, d)
    else:
        for i, row in enumerate(lists.to_pylist()):
            out[i, : len(row)] = row
    return out


def rotation(vectors: DataFrame, d: int, first: int) -> tuple[np.ndarray, float]:
    """The eigenvectors of the second moments, largest first: d by d, from one d by d sum a partition. Also the share of the first."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            m = matrix(batch, d)
            total += m.T @ m  # rounded where numbers are large: any rotation gives right results
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(d), d), pa.int32()), pa.array(np.tile(np.arange(d), d), pa.int32()), pa.array(total.ravel())], names=["i", "j", "s"])

    total = np.zeros((d, d))
    for i, j, s in vectors.select("v").mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s")).collect():
        total[i, j] = s
    values, turn = np.linalg.eigh(total)
    whole = values.sum()
    return turn[:, ::-1].copy(), float(values[::-1][:first].sum() / whole) if whole > 0 else 0.0


def block_bytes(rows: DataFrame, d: int, turn: np.ndarray | None, first: int, most: int) -> DataFrame:
    """Rows sorted by group within a partition, packed as matrices of at most `most` rows by id:
    group, ids, v (integers of `wide` bytes), r (the first rotated coordinates and the length of the rest, float64; empty without turn), top (largest norm)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column("group").to_numpy()
            cuts = np.flatnonzero(np.diff(groups)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(groups)], strict=True):
                for at in range(a, b, most):
                    part = batch.slice(at, min(most, b - at))
                    if not part.num_rows:
                        continue
                    ids = part.column("vec_id").to_numpy()
                    order = np.argsort(ids, kind="stable")
                    m = matrix(part, d, np.int64)[order]
                    wide = next(w for w in (2, 4, 8) if w == 8 or np.abs(m).max(initial=0) < 1 << (8 * w - 1))
                    r = b""
                    if turn is not None:
                        turned = m.astype(np.float64) @ turn
                        r = np.column_stack([turned[:, :first], np.linalg.norm(turned[:, first:], axis=1)]).astype("<f8").tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(groups[at])], pa.int64()), pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), pa.array([m.astype(f"<i{wide}").tobytes()], pa.binary()), pa.array([wide], pa.int32()), pa.array([r], pa.binary()), pa.array([float(part.column("norm").to_numpy().max())])],
                        names=["group", "ids", "v", "wide", "r", "top"],
                    )

    return rows.mapInArrow(pack, "group long, ids binary, v binary, wide int, r binary, top double")


class Block:
    """A block's ids, vectors, rotated vectors, lengths and largest length."""

    def __init__(self, x: dict, d: int) -> None:
        self.ids = np.frombuffer(x["ids"], "<i8")
        self.v = np.frombuffer(x["v"], f"<i{x['wide']}").reshape(-1, d)
        self.r = np.frombuffer(x["r"], "<f8").reshape(len(self.ids), -1) if x["r"] else None
        self.top = x["top"]
        self.lengths = np.linalg.norm(self.v.astype(np.float64), axis=1)
        self._as: dict[type, np.ndarray] = {}

    def floats(self, kind: type) -> np.ndarray:
        if kind not in self._as:
            self._as[kind] = self.v.astype(kind)
        return self._as[kind]


def ranked(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of each row's best k, by row."""
    order = np.lexsort((ids, -scores, rows))
    by_row = rows[order]
    starts = np.flatnonzero(np.r_[True, by_row[1:] != by_row[:-1]]) if len(by_row) else np.zeros(0, int)
    nth = np.arange(len(by_row)) - np.repeat(starts, np.diff(np.r_[starts, len(by_row)]))
    return order[nth < k]


def picked(scores: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of scores that reach their row's bound; of a row with many at least its best k by score, then column."""
    rows = np.flatnonzero(scores.max(axis=1) >= bound)
    scores, bound = scores[rows], bound[rows]
    hit = (scores >= bound[:, None]) & (scores > -np.inf)
    many = np.flatnonzero(np.count_nonzero(hit, axis=1) > max(64, 4 * k))
    if len(many):
        part = scores[many]
        kth = np.partition(part, part.shape[1] - k, axis=1)[:, -k]
        hit[many] &= part >= kth[:, None]
        # Ties go to smaller ids, and columns come by id.
        for i, least in zip(many.tolist(), kth.tolist(), strict=True):
            if np.count_nonzero(hit[i]) > max(64, 4 * k):
                tied = np.flatnonzero(hit[i] & (scores[i] == least))
                hit[i, tied[k:]] = False
    at, columns = np.nonzero(hit)
    return rows[at], columns


def own_pairs(q_ids: np.ndarray, c_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns with equal ids; c_ids ascend."""
    low, high = np.searchsorted(c_ids, q_ids, "left"), np.searchsorted(c_ids, q_ids, "right")
    rows = np.repeat(np.arange(len(q_ids)), high - low)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)


def score_block(q: Block, c: Block, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, id and score of the best k candidates of each query in one block, without queries and candidates
    whose bounds show that they can't matter."""
    none = np.zeros(0, np.int64)
    kept = [(none, none, none)]
    live = np.flatnonzero(q.lengths * c.top * (1 + 1e-5) + 1 >= bound)
    for at in range(0, len(live), TILE):
        rows = live[at : at + TILE]
        longest = float(q.lengths[rows].max()) * c.top * (1 + 1e-9)
        columns = np.arange(len(c.ids))
        if q.r is not None and c.r is not None:
            upper = q.r[rows] @ c.r.T + (q.lengths[rows] * c.top * 1e-5 + 1)[:, None]
            columns = np.flatnonzero((upper >= bound[rows][:, None]).any(axis=0))
            if not len(columns):
                continue
        if longest < float(1 << 53):
            kind = np.float32 if longest < float(1 << 24) else np.float64
            all_of = len(columns) == len(c.ids)
            scores = q.floats(kind)[rows] @ (c.floats(kind) if all_of else c.floats(kind)[columns]).T
            scores[own_pairs(q.ids[rows], c.ids[columns])] = -np.inf
            i, j = picked(scores, bound[rows], k)
            found = rows[i], c.ids[columns[j]], scores[i, j].astype(np.int64)
        else:
            found = wide_scores(q, c, rows, columns, k)
        keep = ranked(*found, k)
        kept.append(tuple(x[keep] for x in found))
    return tuple(np.concatenate(x) for x in zip(*kept, strict=True))


def wide_scores(q: Block, c: Block, rows: np.ndarray, columns: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As score_block, where floats don't hold the scores."""
    kept = []
    for i in rows.tolist():
        may = columns[c.ids[columns] != q.ids[i]]
        if not len(may):
            continue
        if q.lengths[i] * c.top < float(1 << 61):
            scores = c.v[may].astype(np.int64) @ q.v[i].astype(np.int64)
        else:
            exact = c.v[may].astype(object) @ q.v[i].astype(object)
            largest = sorted(exact, reverse=True)[:k]
            if any(not -(1 << 63) <= x < 1 << 63 for x in largest):
                raise ValueError("a score doesn't fit 64 bits")
            may, scores = may[exact >= largest[-1]], np.array([x for x in exact if x >= largest[-1]], np.int64)
        keep = np.lexsort((c.ids[may], -scores))[:k]
        kept.append((np.full(len(keep), i), c.ids[may][keep], scores[keep]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip((none, none, none), *kept, strict=True))


def meet_cell(asked: list[dict], here: list[dict], d: int, k: int) -> Iterator[pa.RecordBatch]:
    """Each query's best k of a cell's candidates. The longest blocks come first, and k of a block raise the bound for the next."""
    blocks = sorted((Block(x, d) for x in here), key=lambda c: -c.top)
    for x in asked:
        q = Block(x, d)
        known = {y["query_id"]: y["kth"] for y in x["kths"] or []}
        bound = np.array([known.get(i, -np.inf) for i in q.ids.tolist()], np.float64)
        best = (np.zeros(0, np.int64),) * 3
        for c in blocks:
            found = score_block(q, c, bound, k)
            if not len(found[0]):
                continue
            best = tuple(np.concatenate(y) for y in zip(best, found, strict=True))
            keep = ranked(*best, k)
            best = tuple(y[keep] for y in best)
            full = np.flatnonzero(np.bincount(best[0], minlength=len(q.ids)) >= k)
            least = np.full(len(q.ids), np.iinfo(np.int64).max)
            np.minimum.at(least, best[0], best[2])
            # A float may lie above the whole number that it stands for.
            bound[full] = np.maximum(bound[full], np.nextafter(least[full].astype(np.float64), -np.inf))
        yield pa.RecordBatch.from_arrays([pa.array(q.ids[best[0]]), pa.array(best[1]), pa.array(best[2])], schema=FOUND_ARROW)


def topk(vectors: DataFrame, queries: F.Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256, block: int = 4096, groups: int | None = None, first: int = 16) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each row that `queries` (a condition on vec_id) picks."""
    spark = vectors.sparkSession
    rows = written(whole_vectors(vectors, vec_id, embedding, scale), "vectors")
    d, n = rows.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n or not d:
        d = d or 1
    if not n:
        return empty
    first = min(first, d)
    turn, share = rotation(rows, d, first)
    if share < CONCENTRATED or first == d:
        turn = None
    groups = groups or max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // block)))
    # Cuts between blocks of candidates by norm, as many values as there are blocks.
    cuts = rows.select(F.percentile_approx("norm", [i / groups for i in range(1, groups)] or [0.5], 10000)).first()[0]
    group = F.lit(0).cast("long") if groups == 1 else F.lit(groups - 1).cast("long") - F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("norm"))).cast("long")
    # Equal norms fall to one group, so groups are split again by id.
    dealt = rows.withColumn("group", group)
    sizes = dict(dealt.groupBy("group").count().collect())
    salt = {g: max(1, -(-c // (2 * block))) for g, c in sizes.items()}
    salts = F.create_map(*(F.lit(int(x)) for kv in salt.items() for x in kv))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.try_element_at(salts, F.col("group").cast("int")))).repartition(sum(salt.values()), "group", "salt").sortWithinPartitions("group", F.desc("norm"))
    candidates = written(block_bytes(dealt.select("group", "vec_id", "v", "norm"), d, turn, first, block), "candidates")
    asked = rows.filter(queries).filter(F.col("vec_id") != F.lit(int(NULL_ID)))
    q_blocks = max(1, -(-asked.count() // block))
    q_rows = asked.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks))).repartition(q_blocks, "group").sortWithinPartitions("group")
    query_blocks = written(block_bytes(q_rows.select("group", "vec_id", "v", "norm"), d, turn, first, block), "queries")

    def meet(key: tuple, asked: pa.Table, here: pa.Table) -> pa.Table:
        return pa.Table.from_batches(meet_cell(asked.to_pylist(), here.to_pylist(), d, k) if asked.num_rows and here.num_rows else [], FOUND_ARROW)

    asking = query_blocks.select(F.col("group").alias("q_group"), "ids", "v", "wide", "r", "top")
    sides = -(-q_blocks // SIDE)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best_so_far, low, many = None, 0, 1
    while low < groups:
        # A grid: a task has up to SIDE blocks of queries and of one group's candidates, so blocks are copied, pairs of rows never.
        across = max(-(-max(salt[g] * 2, 1) // SIDE) for g in range(low, min(low + many, groups)) if g in salt) if any(low <= g < low + many for g in salt) else 1
        cell = F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))
        here = candidates.filter((F.col("group") >= low) & (F.col("group") < low + many)).select((F.col("group") - low).alias("at"), F.pmod(F.xxhash64("ids"), F.lit(across)).cast("int").alias("across"), cell.alias("down"), "ids", "v", "wide", "r", "top")
        if best_so_far is None:
            bounded = asking.withColumn("kths", F.lit(None).cast("array<struct<query_id:bigint,kth:bigint>>"))
        else:
            kth = best_so_far.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k)
            kths = kth.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).alias("q_group")).agg(F.collect_list(F.struct("query_id", "kth")).alias("kths"))
            bounded = asking.join(kths, "q_group", "left")
        placed = bounded.withColumn("down", F.pmod(F.col("q_group"), F.lit(sides)).cast("int"))
        asked_all = placed.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(min(many, groups - low) - 1).cast("long")))).withColumn("across", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
        grid = [F.col(c) for c in ("at", "across", "down")]
        found = asked_all.groupBy(*grid).cogroup(here.groupBy(*grid)).applyInArrow(meet, FOUND)
        if best_so_far is not None:
            found = found.unionByName(best_so_far.select("query_id", "vec_id", "score"))
        now = written(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "best")
        if best_so_far is not None:
            release(best_so_far)
        best_so_far, low, many = now, low + many, many * 4
    return best_so_far.select("query_id", "rank", F.when(F.col("vec_id") != F.lit(int(NULL_ID)), F.col("vec_id")).alias("vec_id"), "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 against all others, top 5."""
    return topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
