"""Document fingerprints by winnowing.

All k-grams of code points are hashed by a rolling polynomial; of every window of `window` neighbouring hashes the least
is chosen, the rightmost of equal ones, and each choice is kept once with its position. Any passage of
`window + k - 1` code points that two texts share has a chosen hash in common. Likeness is the share of distinct chosen
hashes that two fingerprints have in common (Jaccard).

Texts with few grams have narrower windows, down to every gram, so that their likeness doesn't hang on a few hashes: the widest
of STEPS of which SPARE go into the grams. What a wide window chooses a narrow one chooses too, so of two fingerprints with
different windows the finer is thinned to the other's window before they are compared.

A text shorter than k is one gram; a text with fewer grams than a window is one window. The empty text has an empty
fingerprint, and two empty fingerprints are alike (1.0). Ids may be null or come again, rows may come again, an empty table
gives no rows, further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import to_batch, whole

K, WINDOW = 24, 48
#: Windows of shorter texts, and how often a window goes into a text's grams at least.
STEPS, SPARE = (1, 2, 4, 8, 16, 32), 32
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept, and made anew when a longer text comes."""
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, 1 << 14), base, np.uint64)
        steps[0] = 1
        _powers[key] = np.multiply.accumulate(steps)
    return _powers[key][:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """32-bit hashes of all k-grams; of a shorter text, of the whole text."""
    n = len(points)
    k = min(k, n)
    # Prefix sums of c[j] * B**j; their difference over a gram, divided by B**i, is the gram's polynomial.
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
    h = (sums[k:] - sums[: n - k + 1]) * powers(INVERSE, n - k + 1)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(32)).astype(np.uint32)


def winnow(points: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the chosen grams, by position."""
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    h = gram_hashes(points, k)
    w = min(window, len(h))
    # Hash and position in one number: the least of a window is its least hash, of equal ones the rightmost.
    keys = (h.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    low, span = keys, 1
    while span * 2 <= w:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[: len(keys) - w + 1], low[w - span : w - span + len(keys) - w + 1])
    # Neighbouring windows choose the same gram or one further right, so equal choices are neighbours.
    chosen = low[np.r_[True, low[1:] != low[:-1]]]
    at = (np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))).astype(np.int64)
    return at, h[at]


def window_for(n: int, k: int, window: int) -> int:
    """The window of a text of n code points, at most the given one."""
    room = max(1, n - k + 1) // SPARE
    return window if room >= window else max([s for s in STEPS if s <= min(room, window)], default=1)


class Print:
    """A text's fingerprint, which can be thinned to a wider window."""

    def __init__(self, text: str, k: int, window: int) -> None:
        self.points, self.k = code_points(text), k
        self.window = window_for(len(self.points), k, window)
        self.at, self.h = winnow(self.points, k, self.window)
        self.distinct = {self.window: np.unique(self.h)}

    def hashes(self, window: int) -> np.ndarray:
        if window not in self.distinct:
            self.distinct[window] = np.unique(winnow(self.points, self.k, window)[1])
        return self.distinct[window]

    def like(self, other: Print) -> float:
        window = max(self.window, other.window)
        return likeness(self.hashes(window), other.hashes(window))


def as_text(at: np.ndarray, h: np.ndarray) -> str:
    """16 hex digits for each choice: hash, then position."""
    return np.column_stack([h.astype(">u4"), at.astype(">u4")]).astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two sorted arrays of distinct hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(both) - common)


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id and grams, an array of hash and position: the general form, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                lines = []
                for x in batch.slice(i, 64).to_pylist():
                    made = Print(x["body"], k, window)
                    lines.append((x["id"], [{"hash": a, "position": b} for a, b in zip(made.h.tolist(), made.at.tolist(), strict=True)]))
                yield to_batch(lines, schema)

    schema = pa.schema([("id", pa.string()), ("grams", pa.list_(pa.struct([("hash", pa.int64()), ("position", pa.int64())])))])
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), whole(text).alias("body"))
    return rows.mapInArrow(run, "id string, grams array<struct<hash:bigint,position:bigint>>")


def with_next(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (slot, doc_id, body, ghost) in partitions where each slot is a stretch of descending ids, sorted, ended by a
    ghost: the first row of the next slot (after the last: of the first). One shuffle; a task holds two rows at a time.

    Equal ids sort by text; a null id is after all others."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("body"))
    ids = rows.select("doc_id")
    n = ids.count()
    slots = max(1, min(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), n // 32))
    cuts = np.array(sorted(set(ids.select(F.percentile_approx("doc_id", [i / slots for i in range(1, slots)] or [0.5], 100000)).first()[0] or [])) if slots > 1 else [], np.int64)

    @F.pandas_udf("long")
    def slot_of(x):
        # A cut is the first id of the slots below it; the id itself goes with the larger ones' end. Null: the last slot.
        filled = x.fillna(np.iinfo(np.int64).min).astype("int64")
        return pd.Series((len(cuts) - np.searchsorted(cuts, filled, side="left")).astype("int64"))

    slotted = rows.withColumn("slot", slot_of("doc_id"))
    # First rows: ids of each slot by a narrow pass, then their texts by a join with as many rows as there are slots.
    first = ids.withColumn("slot", slot_of("doc_id")).groupBy("slot").agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"))
    firsts = sorted(first.collect(), key=lambda r: r["slot"])
    if not firsts:
        return slotted.withColumn("ghost", F.lit(False))
    before = {r["slot"]: firsts[i - 1]["slot"] for i, r in enumerate(firsts)}
    heads = spark.createDataFrame([(r["slot"], r["doc_id"], before[r["slot"]]) for r in firsts], "slot long, doc_id long, into long")
    ghosts = (
        slotted.join(F.broadcast(heads.withColumnRenamed("slot", "of").withColumnRenamed("doc_id", "head")), F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("slot") == F.col("of")))
        .groupBy(F.col("into").alias("slot"), "doc_id")
        .agg(F.min("body").alias("body"))
    )
    every = slotted.select("slot", "doc_id", "body", F.lit(False).alias("ghost")).unionByName(ghosts.select("slot", "doc_id", "body", F.lit(True).alias("ghost")))
    return every.repartition("slot").sortWithinPartitions("slot", "ghost", F.desc_nulls_last("doc_id"), "body")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
EDITED_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Each text's fingerprint, that of the text whose second half is the next document's start, and their likeness."""

    def made(now: tuple, nxt: tuple) -> tuple:
        i, body, own = now
        half = len(body) // 2
        # The last floor(n / 2) code points go, for as many from the next text, or all of it.
        edited = body[: len(body) - half] + nxt[1][:half]
        new = Print(edited, k, window)
        return i, len(body), hashlib.sha256(edited.encode()).hexdigest(), as_text(own.at, own.h), as_text(new.at, new.h), own.like(new), own.like(nxt[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, slot, lines, chars = None, None, [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                for x in batch.slice(i, 64).to_pylist():
                    now = (x["doc_id"], x["body"], Print(x["body"], k, window))
                    if last is not None and slot == x["slot"]:
                        lines.append(made(last, now))
                        chars += len(last[1])
                    last, slot = (None, None) if x["ghost"] else (now, x["slot"])
                    if len(lines) >= 256 or chars > 4_000_000:
                        yield to_batch(lines, EDITED_ARROW)
                        lines, chars = [], 0
        if lines:
            yield to_batch(lines, EDITED_ARROW)

    return with_next(docs, doc_id, text).mapInArrow(run, EDITED)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents and their edited texts."""
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
