r"""Runs: maximal stretches of words that repeat with a period, by Crochemore's partition refinement.

Positions of a text fall into classes of equal factors of length 1, 2, 3, ... A class is split by the classes of the
positions behind its members; of the parts of a split class all but the largest are looked at in the next step (the
smaller-half strategy), so all splits of n words cost O(n log n). Each class is a linked list in the order of positions.
At length q, neighbours at distance q begin a square with the smallest period q; squares that begin at consecutive
positions are one run.

All texts of a batch are refined together as arrays: each text is a class of its own at first and ends in a position that
equals no other, so no factor reaches over its end. A text of n words leaves after length n / 2.

A task reads batches of texts one after another; texts never meet, so there is no shuffle, and a task needs memory for
WORDS words or for its longest text.

Words are `[^\x20\x09-\x0D]+`. Defined results: null, empty and blank texts have no words, no runs and the collapsed text
""; equal rows give equal rows; ids may be null or come again; an empty table gives no rows; a text of any length is read
whole; further columns of any name are left out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import whole

#: Texts are refined together up to so many words; a longer text is refined alone. Three numbers below 2**21 fit in 63 bits.
WORDS = 1 << 21
BITS = 21
#: Up to this length all neighbours are compared; beyond it, only those that were made neighbours and wait for their distance.
DENSE = 5
#: Fixed value: a run has so many words at least.
LEAST = 12
RUN = "struct<start:long,length:long,period:long>"
SCHEMA = f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])


def sorted_by(a: np.ndarray, b: np.ndarray, at: np.ndarray, packed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of (a, b, position), and which of them begin a new pair (a, b)."""
    if packed:
        key = np.sort((a << (2 * BITS)) | (b << BITS) | at)
        pair, at = key >> BITS, key & ((1 << BITS) - 1)
        return at, np.concatenate(([True], pair[1:] != pair[:-1]))
    order = np.lexsort((at, b, a))
    a, b, at = a[order], b[order], at[order]
    return at, np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))


def stretches(at: np.ndarray, period: int, least: int) -> np.ndarray:
    """Runs as rows (start, length, period) of the sorted starts of squares."""
    first = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))
    length = np.diff(np.append(first, at.size)) - 1 + 2 * period
    keep = length >= max(least, 2 * period)
    return np.stack((at[first][keep], length[keep], np.full(int(keep.sum()), period)), axis=1)


def runs_of(words: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Runs of texts that follow one another in words (numbers; equal words have equal numbers): rows (text, start, length,
    period) by text, start and period."""
    texts, spans = lengths.size, lengths + 1
    begin = np.cumsum(spans) - spans
    n = int(spans.sum())
    packed = n <= WORDS + (WORDS >> 3) and n < 1 << BITS
    text_of = np.repeat(np.arange(texts), spans)
    end = begin + lengths
    end_of = end[text_of]
    of_word = np.zeros(n, dtype=np.int64)
    inner = np.ones(n, dtype=bool)
    inner[end] = False
    of_word[inner] = words + 1

    # Length 1: a class per text and word. The slot n stands for no neighbour.
    cls, nxt, prv = np.empty(n + 1, dtype=np.int64), np.full(n + 1, n, dtype=np.int64), np.full(n + 1, n, dtype=np.int64)
    at, new = sorted_by(text_of, of_word, np.arange(n), packed)
    cls[at] = np.cumsum(new) - 1
    cls[n] = -1
    size = np.zeros(n + 1, dtype=np.int64)
    counts = np.bincount(cls[:n])
    size[: counts.size] = counts
    classes = counts.size
    linked = ~new[1:]
    nxt[at[:-1][linked]], prv[at[1:][linked]] = at[1:][linked], at[:-1][linked]
    small = at
    waits: dict[int, list[np.ndarray]] = defaultdict(list)
    found: list[np.ndarray] = []

    def wait(at: np.ndarray, gap: np.ndarray) -> None:
        fits = at + 2 * gap <= end_of[at]
        at, gap = at[fits], gap[fits]
        if at.size:
            order = np.argsort(gap, kind="stable")
            at, gap = at[order], gap[order]
            first = np.flatnonzero(np.concatenate(([True], gap[1:] != gap[:-1])))
            for lo, hi, g in zip(first.tolist(), [*first[1:].tolist(), at.size], gap[first].tolist(), strict=True):
                waits[g].append(at[lo:hi])

    length = 1
    while True:
        # Squares of the period `length`.
        if length < DENSE:
            here = np.flatnonzero((nxt[:n] - np.arange(n) == length) & (nxt[:n] < n))
            here = here[here + 2 * length <= end_of[here]]
        else:
            if length == DENSE:
                have = np.flatnonzero(nxt[:n] < n)
                have = have[nxt[have] - have >= DENSE]
                wait(have, nxt[have] - have)
            got = waits.pop(length, None)
            here = np.empty(0, dtype=np.int64)
            if got:
                here = np.unique(np.concatenate(got)) if len(got) > 1 else np.sort(got[0])
                here = here[(nxt[here] - here == length) & (nxt[here] < n)]
        if here.size:
            found.append(stretches(here, length, least))
        if length >= DENSE and not small.size and not waits:
            break
        # Length + 1: members before a small class leave their class, grouped by the class behind them.
        length += 1
        i = small - 1
        i = i[i >= 0]
        i = i[(size[cls[i]] > 1) & (end_of[i] - begin[text_of[i]] >= 2 * length) & (i != end_of[i])]
        if not i.size:
            small = i
            if length > DENSE and not waits:
                break
            continue
        by_class, _ = sorted_by(cls[i], np.zeros_like(i), i, packed)
        head = np.concatenate(([True], (prv[by_class[1:]] != by_class[:-1]) | (cls[by_class[1:]] != cls[by_class[:-1]])))
        before, after = prv[by_class[head]], nxt[by_class[np.append(head[1:], True)]]
        at, new = sorted_by(cls[i], cls[i + 1], i, packed)
        old_next = nxt[at]
        nxt[before], prv[after] = after, before
        inside = ~new[1:]
        nxt[at], prv[at] = n, n
        nxt[at[:-1][inside]], prv[at[1:][inside]] = at[1:][inside], at[:-1][inside]
        nxt[n] = prv[n] = n
        if length > DENSE:
            joined = (before < n) & (after < n)
            moved = np.flatnonzero((nxt[at] < n) & (nxt[at] != old_next))
            late = np.concatenate((before[joined], at[moved]))
            gap = np.concatenate((after[joined], nxt[at[moved]])) - late
            ripe = gap >= length
            if ripe.any():
                wait(late[ripe], gap[ripe])
        # Parts of each class: its groups, and what stays. The largest keeps the old number where nothing else stays.
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, at.size))
        of = cls[at[first]]
        lead = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        gone = np.add.reduceat(count, lead)
        most = np.maximum.reduceat(count, lead)
        stay = size[of[lead]] - gone
        groups = np.diff(np.append(lead, of.size))
        which = np.repeat(np.arange(lead.size), groups)
        # The first of the largest groups of each class.
        largest = np.flatnonzero(count == most[which])
        largest = largest[np.concatenate(([True], np.diff(which[largest]) != 0))]
        keeps = np.zeros(first.size, dtype=bool)
        keeps[largest[stay == 0]] = True
        number = np.where(keeps, of, classes + np.cumsum(~keeps) - 1)
        classes += int((~keeps).sum())
        size[of[lead]] = stay
        size[number] = count
        cls[at] = np.repeat(number, count)
        # Small are all parts but the largest; where what stays is larger than each group, all groups are.
        spared = np.zeros(first.size, dtype=bool)
        spared[largest[most >= stay]] = True
        part = at[~np.repeat(spared, count)]
        rest = of[lead][(stay > 0) & (most >= stay)]
        if rest.size:
            small = np.concatenate((part, members(rest, before, after, by_class, cls, nxt, prv, n)))
        else:
            small = part
    if not found:
        return np.empty((0, 4), dtype=np.int64)
    runs = np.concatenate(found)
    text = text_of[runs[:, 0]]
    order = np.lexsort((runs[:, 2], runs[:, 0]))
    return np.column_stack((text, runs[:, 0] - begin[text], runs[:, 1], runs[:, 2]))[order]


def members(of: np.ndarray, before: np.ndarray, after: np.ndarray, left: np.ndarray, cls: np.ndarray, nxt: np.ndarray, prv: np.ndarray, n: int) -> np.ndarray:
    """The positions of the classes `of`, from which others have left: from a member beside those that left, along the lists
    both ways. Such a class is no larger than a part that left it."""
    wanted = np.sort(of)
    seeds = np.concatenate((before, after))
    seeds = seeds[seeds < n]
    at = np.searchsorted(wanted, cls[seeds])
    seeds = seeds[(at < wanted.size) & (wanted[np.minimum(at, wanted.size - 1)] == cls[seeds])]
    seeds = np.unique(seeds)
    # One seed of each class.
    _, one = np.unique(cls[seeds], return_index=True)
    seeds = seeds[one]
    got, ahead, back = [seeds], seeds, seeds
    while ahead.size or back.size:
        ahead, back = nxt[ahead], prv[back]
        ahead, back = ahead[ahead < n], back[back < n]
        got += [ahead, back]
    return np.concatenate(got)


def read_batch(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """SCHEMA's rows of some texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    parts = pc.ascii_split_whitespace(texts)
    flat, of = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy()
    real = pc.not_equal(pc.binary_length(flat), 0)
    flat, of = flat.filter(real), of[real.to_numpy(zero_copy_only=False)]
    lengths = np.bincount(of, minlength=len(texts))
    begin = np.cumsum(lengths) - lengths
    runs = runs_of(flat.dictionary_encode().indices.to_numpy().astype(np.int64), lengths) if len(flat) else np.empty((0, 4), dtype=np.int64)
    edge = np.zeros(len(flat) + 1, dtype=np.int64)
    start = begin[runs[:, 0]] + runs[:, 1]
    np.add.at(edge, start + runs[:, 3], 1)
    np.add.at(edge, start + runs[:, 2], -1)
    kept = np.cumsum(edge[:-1]) == 0
    left = np.bincount(of[kept], minlength=len(texts))
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(left)), pa.int32()), flat.filter(pa.array(kept)))
    per = np.append(0, np.cumsum(np.bincount(runs[:, 0], minlength=len(texts)))).astype(np.int32)
    rows = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], names=["start", "length", "period"])
    return pa.RecordBatch.from_arrays([ids, pa.array(lengths.astype(np.int64)), pa.ListArray.from_arrays(pa.array(per), rows), pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())], schema=ARROW)


def cut(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows of at most WORDS words, taking two bytes for a word; a longer row comes alone."""
    lo = total = 0
    for i, s in enumerate((sizes // 2 + 2).tolist()):
        if total and total + s > WORDS:
            yield lo, i
            lo, total = i, 0
        total += s
    if lo < sizes.size:
        yield lo, sizes.size


def periodic_runs(docs: DataFrame) -> DataFrame:
    """n_words, runs by start and period, and the collapsed text of each row of (doc_id, text): of each run only the words of
    its first period stay, unless another run drops them; kept words are joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in cut(sizes):
                yield read_batch(batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def made_periodic(docs: DataFrame) -> DataFrame:
    """A tenth of the documents, by the checksum of doc_id, repeat words from some position on; null ids are left as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    n = F.size("words")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int")
    hit = F.coalesce(h % 10 == 0, F.lit(False))
    # Others have no words here, so their texts are not split.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text")).withColumn("words", F.when(hit, words(F.col("text"))))
    rows = rows.withColumn("a", F.when(n > 0, a)).withColumn("p", p)
    again = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return rows.select("doc_id", F.when(hit & (n > 0), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, some of which are made periodic first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(made_periodic(docs))
    # Longest first, then by smallest start and period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.select("doc_id", "runs", best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"), F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


# The checksum of a short ASCII text, bit by bit.
CRC32_SQL = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))))"
OP12_SQL = rf"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda v: v <> '') AS w,
    coalesce({CRC32_SQL.format("doc_id::VARCHAR")}, 1) AS h
  FROM documents
), e AS (
  SELECT doc_id, w, h, h // 10 AS g, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d
), f AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e
), t AS MATERIALIZED (
  SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM f
), word AS MATERIALIZED (
  SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM t
), pair AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM word x JOIN word y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i AND 2 * (y.i - x.i) <= x.n
), island AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pair
), stretch AS MATERIALIZED (
  SELECT doc_id, q AS period, min(i) AS start, count(*) + q AS length FROM island GROUP BY doc_id, q, k HAVING count(*) >= q AND count(*) + q >= 12
), run AS MATERIALIZED (
  SELECT * FROM stretch s WHERE NOT EXISTS (
    SELECT 1 FROM stretch r WHERE r.doc_id = s.doc_id AND r.period < s.period AND r.start <= s.start AND r.start + r.length >= s.start + s.length)
), best AS (
  SELECT doc_id, count(*) AS n_runs, first(start ORDER BY length DESC, start, period) AS start, first(length ORDER BY length DESC, start, period) AS length,
    first(period ORDER BY length DESC, start, period) AS period, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs
  FROM run GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM word v WHERE NOT EXISTS (
    SELECT 1 FROM run r WHERE r.doc_id = v.doc_id AND v.i >= r.start + r.period AND v.i < r.start + r.length) GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM t LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
