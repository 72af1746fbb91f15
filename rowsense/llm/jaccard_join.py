"""N-gram Jaccard join: all links of similarity `num / den` or more, exactly, and their connected components.

A document's set is its distinct shingles of k words, as 64-bit hashes in ascending order. Documents with equal sets form a
class that one member stands for.

1. A first pass counts shingles in a table of 2**20 places, summed over all tasks, so its size doesn't grow with the data.
   It gives the shingles an order, rare places first, then by hash. Any order gives right results; this one keeps what many
   documents share out of the prefixes.
2. Sets that link share one of the first n - ceil(t n) + 1 shingles of each in that order (the prefix). Shingles that one
   class alone has in its prefix are done.
3. Stars. Twice, each class is paired with one centre a shingle, which joins most copies into clusters: as many pairs as
   rows, not all pairs of a group. Shingles whose classes all lie in one cluster are done.
4. Tiles. The classes of the shingles that are left meet by shingle, by band of set sizes (a set also visits the bands below,
   as linked sizes differ by a factor t at most), and, where a tile is large, by pair of blocks of it. In a tile, hashed
   parity bitmaps are compared: the bits in which two differ are no more than the shingles in which the sets differ, so
   their count bounds the overlap from above. Only pairs of different clusters that pass are kept.

Pairs of stars and tiles are verified by intersecting the sorted arrays. Nothing is sampled or capped: a tile of any size is
cut into blocks. Nodes of the graph are classes, by a number of their own: ids may be null or come again with another text.

Defined results: null and blank texts have empty sets and no links; texts with fewer than k words are one shingle; a
component's id is the smallest doc_id in it, null if all are null; classes with one smallest doc_id have one component_id
(but links of their own: classes() keeps them apart); an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold, mixed, release, to_batch, whole, written

#: Places of the table of counts; rows of a block of a tile; pairs' documents up to which their ids are broadcast.
PLACES, BLOCK, FEW_IDS = 1 << 20, 2048, 1_000_000
#: Bits of a hash by which prefixes meet: shingles that agree in them are candidates more, never links; 2**48 are enough for
#: a hundred terabytes of text, and every bit travels twice.
KEY_BITS = 48
#: Bytes that are hashed at once; words longer than this many bytes are hashed one by one.
CHUNK, LONG = 1 << 18, 1 << 16
BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A number for each byte; capital ASCII letters have those of the small ones.
BYTES = mixed(np.arange(256, dtype=np.uint64), 11)
BYTES[65:91] = BYTES[97:123]
ODD = mixed(np.arange(64, dtype=np.uint64), 12) | np.uint64(1)


def powers(of: int) -> np.ndarray:
    out = np.full(CHUNK, of, np.uint64)
    out[0] = 1
    return np.cumprod(out)


UP, DOWN = powers(BASE), powers(pow(BASE, -1, 1 << 64))


def words_of(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of the bytes, in which each of `cuts` is behind white space. A word's hash is a
    polynomial of its bytes modulo 2**64, mixed with its length: running sums give those of all words."""
    hashes, places, at, n = [], [], 0, len(raw)
    while at < n:
        end = min(n, at + CHUNK)
        if end < n:
            gaps = np.flatnonzero(SPACE[raw[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word fills the chunk
                while end < n and not SPACE[raw[end]]:
                    end += 1
                hashes.append(np.array([long_word(raw[at:end])], np.uint64))
                places.append(np.array([at]))
                at = end
                continue
        part = raw[at:end]
        space = np.ones(len(part) + 2, bool)
        space[1:-1] = SPACE[part]
        edges = np.flatnonzero(space[1:] != space[:-1])
        start, stop = edges[::2], edges[1::2]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTES[part] * UP[: len(part)], out=sums[1:])
        h = mixed((sums[stop] - sums[start]) * DOWN[start] + (stop - start).astype(np.uint64), 13)
        for i in np.flatnonzero(stop - start > LONG):
            h[i] = long_word(part[start[i] : stop[i]])
        hashes.append(h)
        places.append(start + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def long_word(raw: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(raw.tobytes().lower())


def shingle_sets(raw: np.ndarray, ends: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text of the bytes, by its end (behind a line feed), the distinct hashes of k neighbouring words, ascending."""
    h, start = words_of(raw, ends)
    last = np.searchsorted(start, ends)
    total = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        total += h[i : i + len(total)] * ODD[i]
    total = mixed(total, 14)
    out, a = [], 0
    for b in last.tolist():
        if b - a >= k:
            x = np.sort(total[a : b - k + 1])
            new = np.ones(len(x), bool)
            np.not_equal(x[1:], x[:-1], out=new[1:])
            out.append(x if new.all() else x[new])
        elif b > a:
            out.append(mixed((h[a:b] * ODD[: b - a]).sum(dtype=np.uint64, keepdims=True), 15 + b - a))
        else:
            out.append(np.zeros(0, np.uint64))
        a = b
    return out


def sets_of(batch: pa.RecordBatch, k: int, most: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The batch in parts of about so many bytes of `body`, each text of which ends with a line feed, and the texts' sets."""
    body = batch.column("body").cast(pa.large_string())
    ends = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
    data = np.frombuffer(body.buffers()[2], np.uint8) if ends[-1] else np.zeros(0, np.uint8)
    a = 0
    while a < len(body):
        b = max(a + 1, min(a + 512, int(np.searchsorted(ends, ends[a] + most, "right")) - 1))
        yield batch.slice(a, b - a), shingle_sets(data[ends[a] : ends[b]], ends[a + 1 : b + 1] - ends[a], k)
        a = b


def shingles(text: str, k: int) -> np.ndarray:
    """Distinct hashes of k neighbouring words of one text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass") + b"\n", np.uint8)
    return shingle_sets(raw, np.array([len(raw)]), k)[0]


def parity_bits(h: np.ndarray) -> bytes:
    """A power of two of bits, at least twice the set's size: each the parity of the number of hashes that fall on it."""
    size = 64
    while size < 2 * len(h):
        size *= 2
    # The low bits choose the place, so a bitmap's halves xor to that of half the size.
    count = np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(count.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: bytes, words: int) -> np.ndarray:
    x = np.frombuffer(bits, "<u8")
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def differing(a: bytes, b: bytes) -> int:
    """Places in which two bitmaps differ, the larger folded to the smaller's size."""
    words = min(len(a), len(b)) // 8
    return int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum())


def may_link(n_a, n_b, differ, num: int, den: int):
    """Whether sets of such sizes can link: overlap <= (n_a + n_b - differ) / 2, and den * overlap >= num * union."""
    return (den + num) * (n_a + n_b - differ) >= 2 * num * (n_a + n_b)


def links(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return den * common >= num * (len(both) - common)


def set_hash(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.astype("<u8").tobytes(), digest_size=16).digest() if len(h) else b""


def mark_of(text: str) -> Column:
    """With the id, what tells rows apart by their texts."""
    return F.unhex(F.md5(whole(text)))


def bodies(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), mark_of(text).alias("mark"), F.concat(whole(text), F.lit("\n")).alias("body"))


SIGNED = "doc_id long, mark binary, n long, set_hash binary, place int, counts binary"
SIGNED_ARROW = pa.schema([("doc_id", pa.int64()), ("mark", pa.binary()), ("n", pa.int64()), ("set_hash", pa.binary()), ("place", pa.int32()), ("counts", pa.binary())])


def signatures(docs: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """A row per document; and the counts of each task's shingles, in rows of 4096 places (n is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("jaccard")
        counts = np.zeros(PLACES, np.int64)
        for batch in batches:
            for part, sets in sets_of(batch, k):
                found = np.concatenate([*sets, np.zeros(0, np.uint64)])
                if len(found):
                    np.add.at(counts, (found >> np.uint64(44)).astype(np.int64), 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array([len(h) for h in sets], pa.int64()), pa.array([set_hash(h) for h in sets], pa.binary()), pa.nulls(part.num_rows, pa.int32()), pa.nulls(part.num_rows, pa.binary())], schema=SIGNED_ARROW)
        if counts.any():
            yield to_batch([(None, None, None, None, i, counts[i : i + 4096].astype("<i8").tobytes()) for i in range(0, PLACES, 4096)], SIGNED_ARROW)

    return bodies(docs, doc_id, text).mapInArrow(run, SIGNED)


def levels(signed: DataFrame) -> np.ndarray:
    """For each place, a number that rises with its count: 2**20 numbers at any size of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        done = []
        for batch in batches:
            for place, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one = np.frombuffer(raw, "<i8")
                if place != now:
                    if now is not None:
                        done.append((now, total.tobytes()))
                    now, total = place, one.copy()
                else:
                    total += one
        if now is not None:
            yield to_batch([*done, (now, total.tobytes())], pa.schema([("place", pa.int32()), ("counts", pa.binary())]))

    parts = signed.filter("n is null").select("place", "counts")
    got = parts.repartition("place").sortWithinPartitions("place").mapInArrow(run, "place int, counts binary").toArrow()
    out = np.zeros(PLACES)
    for place, raw in zip(got["place"].to_pylist(), got["counts"].to_pylist(), strict=True):
        out[place : place + 4096] = np.frombuffer(raw, "<i8")
    return np.minimum(np.log2(out + 1) * 1000, 65535).astype(np.uint16)


CLASSED = "doc_id long, mark binary, n long, set_hash binary, prefix array<bigint>, bits binary"


def prefixes(docs: DataFrame, level: np.ndarray, k: int, num: int, den: int, doc_id: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in sets_of(batch, k):
                firsts, bits = [], []
                for h in sets:
                    n = len(h)
                    # Sets ascend, so a stable sort by level puts equal levels in the order of hashes.
                    order = np.argsort(level[(h >> np.uint64(44)).astype(np.int64)], kind="stable")
                    firsts.append((h[order[: n - -(-num * n // den) + 1 if n else 0]] >> np.uint64(64 - KEY_BITS)).astype(np.int64))
                    bits.append(parity_bits(h) if n else b"")
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, firsts)]), pa.int32()), pa.array(np.concatenate([*firsts, np.zeros(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array([len(h) for h in sets], pa.int64()), pa.array([set_hash(h) for h in sets], pa.binary()), lists, pa.array(bits, pa.binary())], names=["doc_id", "mark", "n", "set_hash", "prefix", "bits"])

    return bodies(docs, doc_id, text).mapInArrow(run, CLASSED)


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def bounded(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose bitmaps allow a link. Sizes alone rule out most pairs, before any bitmap travels."""
    of = lambda side, what: reps.select(F.col("node").alias(side), F.col(what).alias(f"{what}_{side}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                columns = [part.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "bits_a", "bits_b")]
                kept = [(a, b) for a, b, n, m, x, y in zip(*columns, strict=True) if may_link(n, m, differing(x, y), num, den)]
                if kept:
                    yield to_batch(kept, PAIR)

    sized = pairs.join(of("a", "n"), "a").join(of("b", "n"), "b").filter(den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b"))
    return sized.join(of("b", "bits"), "b").join(of("a", "bits"), "a").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, num: int, den: int, doc_id: str, text: str) -> DataFrame:
    """Those of the pairs (a, b) that link, by their arrays. reps: node, set_hash, and the doc_id and mark of a row of each class."""
    pairs = written(pairs, "pairs")
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(reps.select("node", "set_hash", F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark")), "node"), "ids")
    wanted = F.broadcast(ids) if ids.count() <= FEW_IDS else ids

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in sets_of(batch, k):
                kept = [(node, h.astype("<u8").tobytes()) for node, same, h in zip(part.column("node").to_pylist(), part.column("set_hash").to_pylist(), sets, strict=True) if set_hash(h) == same]
                if kept:
                    yield to_batch(kept, pa.schema([("node", pa.int64()), ("h", pa.binary())]))

    rows = bodies(docs, doc_id, text).join(wanted, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of_mark")))
    # A row that comes again gives its set again.
    sets = written(rows.select("node", "set_hash", "body").mapInArrow(arrays, "node long, h binary"), "sets")
    once = sets if sets.groupBy("node").count().filter("count > 1").isEmpty() else sets.dropDuplicates(["node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                columns = [part.column(c).to_pylist() for c in ("a", "b", "h_a", "h_b")]
                kept = [(a, b) for a, b, x, y in zip(*columns, strict=True) if links(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), num, den)]
                if kept:
                    yield to_batch(kept, PAIR)

    of = lambda side: once.select(F.col("node").alias(side), F.col("h").alias(f"h_{side}"))
    found = written(pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(run, "a long, b long"), "links")
    release(pairs, ids, sets)
    return found


def all_stars(edges: DataFrame) -> bool:
    """Whether each node of the distinct edges (a, b), a > b, has one smaller neighbour or else only larger ones: then
    each b is the smallest of its component and no round can change an edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x")).select("x.*")
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of all nodes of edges (a, b): large and small stars in turn, until
    each node points at its component's smallest; the number of rounds grows with the logarithm of the nodes."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not all_stars(now):
        # Large star: a node's larger neighbours go to the smallest of it and its neighbours.
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        old, now = now, written(small, "edges")
        release(old)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def tile_pairs(cells: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that pass the bitmaps' bound within each cell (key, band, i, j): of one block, or between blocks i and j."""

    def near(rows: list[dict], i: int, j: int) -> Iterator[tuple[int, int]]:
        words = min(len(x["bits"]) for x in rows) // 8
        bits = np.stack([folded(x["bits"], words) for x in rows])
        n, cluster, node = (np.array([x[c] for x in rows]) for c in ("n", "cluster", "node"))
        home, block = np.array([x["home"] for x in rows]), np.array([x["block"] for x in rows])
        for at in np.flatnonzero(block == i).tolist():
            other = np.arange(at + 1, len(rows)) if i == j else np.flatnonzero(block == j)
            other = other[(cluster[other] != cluster[at]) & (home[other] | home[at])]
            other = other[den * np.minimum(n[other], n[at]) >= num * np.maximum(n[other], n[at])]
            if len(other):
                differ = np.bitwise_count(bits[other] ^ bits[at]).sum(axis=1, dtype=np.int64)
                for b in node[other[may_link(n[other], n[at], differ, num, den)]].tolist():
                    yield max(int(node[at]), b), min(int(node[at]), b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("jaccard")
        cell, rows, out = None, [], set()
        for batch in batches:
            # A few rows at a time, as bitmaps of long sets are large.
            for x in (x for at in range(0, batch.num_rows, 256) for x in batch.slice(at, 256).to_pylist()):
                key = (x["key"], x["band"], x["i"], x["j"])
                if key != cell:
                    if len(rows) > 1:
                        out.update(near(rows, cell[2], cell[3]))
                    cell, rows = key, []
                rows.append(x)
                if len(out) > 5000:
                    yield to_batch(list(out), PAIR)
                    out = set()
        if len(rows) > 1:
            out.update(near(rows, cell[2], cell[3]))
        if out:
            yield to_batch(list(out), PAIR)

    return cells.mapInArrow(run, "a long, b long")


def tiles(shared: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Cells of the tiles of (key, node, n, cluster)."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))).cast("int")
    # A set is at home in its band and visits those below; the margin of one band covers the rounding of logarithms.
    visits = F.explode(F.array(*(F.struct((F.col("own") - i).alias("band"), F.lit(i == 0).alias("home")) for i in range(3))))
    placed = shared.withColumn("own", band).withColumn("at", visits).select("key", "node", "n", "cluster", "at.*")
    counted = placed.groupBy("key", "band").agg(F.count(F.lit(1)).alias("members"), F.max("home").alias("lived"), F.min("cluster").alias("c0"), F.max("cluster").alias("c1")).filter("lived and c0 <> c1").select("key", "band", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    celled = placed.join(counted, ["key", "band"]).withColumn("block", block).withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")
    return celled.join(reps.select("node", "bits"), "node").repartition("key", "band", "i", "j").sortWithinPartitions("key", "band", "i", "j")


def alive(shared: DataFrame, clusters: DataFrame) -> DataFrame:
    """Those of the rows (key, node) whose key has nodes of different clusters, with their cluster."""
    now = written(shared.join(clusters, "node", "left").select("key", "node", F.coalesce("component", "node").alias("cluster")), "clustered")
    keys = now.groupBy("key").agg(F.min("cluster").alias("c0"), F.max("cluster").alias("c1")).filter("c0 <> c1").select("key")
    out = written(now.join(keys, "key"), "alive")
    release(now)
    return out


def rays(shared: DataFrame, *order: Column) -> DataFrame:
    """Pairs of each node and the centre of each of its keys: the node that is first in the order. Rows: key, node, cluster."""
    first = F.min(F.struct(*(x.alias(f"by{i}") for i, x in enumerate(order)), "node", "cluster")).alias("c")
    centre = shared.groupBy("key").agg(first).select("key", F.col("c.node").alias("centre"), F.col("c.cluster").alias("of"))
    return shared.join(centre, "key").filter("cluster <> of").select(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b")).distinct()


def classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Signatures of the rows, and of their classes: set_hash, node, component (a node), and the doc_id and mark of the class's
    row with the smallest doc_id (null only if all are)."""
    signed = written(signatures(docs, k, doc_id, text), "signatures")
    level = levels(signed)
    signed = signed.filter("n is not null").drop("place", "counts")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("least")
    same = [F.first(c).alias(c) for c in ("n", "prefix", "bits")]
    made = prefixes(docs, level, k, num, den, doc_id, text).filter("n > 0").groupBy("set_hash").agg(least, *same)
    # Numbers hold from here on, as the table is written once.
    reps = written(made.select(F.monotonically_increasing_id().alias("node"), "set_hash", "least.doc_id", "least.mark", "n", "prefix", "bits"), "classes")
    checked = lambda pairs: verified(bounded(pairs, reps, num, den), reps, docs, k, num, den, doc_id, text)

    # Sizes come back where tiles need them: most of these rows end here.
    entries = reps.select("node", F.explode("prefix").alias("key"))
    keys = entries.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("key")
    shared = written(entries.join(keys, "key").select("key", "node"), "shared")

    # Of many near copies, the one with the most shared shingles in its prefix has the fewest changes of its own.
    alone = shared.join(shared.groupBy("node").agg((-F.count(F.lit(1))).alias("least")), "node").withColumn("cluster", F.col("node"))
    found = checked(rays(alone, F.col("least"), F.xxhash64("node")))
    clusters = components(found)
    left = alive(shared, clusters)
    release(shared, clusters)
    more = checked(rays(left, F.xxhash64("key", "node")))
    found = found.union(more)
    clusters = components(found)
    last = alive(left.drop("cluster"), clusters)
    release(left, clusters)
    sized = last.join(reps.select("node", "n"), "node")
    more = checked(tile_pairs(tiles(sized, reps, num, den), num, den).distinct())
    release(last)
    joined = components(found.union(more))
    out = written(reps.join(joined, "node", "left").select("set_hash", "node", F.coalesce("component", "node").alias("component"), "doc_id", "mark"), "components")
    release(reps, joined, found, more)
    return signed, out


def jaccard_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row."""
    signed, found = classes(docs, k, num, den, doc_id, text)
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = found.join(least, "component").select("set_hash", "doc_id", "component_id")
    if not found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        # Classes with one smallest id.
        ids = written(components(of_class.filter("doc_id is not null").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))), "ids")
        of_class = of_class.join(ids.select(F.col("node").alias("component_id"), "component"), "component_id", "left").select("set_hash", F.coalesce("component", "component_id").alias("component_id"))
    out = signed.select("doc_id", "n", "set_hash").join(of_class.select("set_hash", "component_id"), "set_hash", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def least_rows(docs: DataFrame) -> DataFrame:
    """doc_id, mark of the row with the smallest id of each component of texts, and how many rows have both."""
    signed, found = classes(docs)
    least = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("least")).select(F.col("least.doc_id").alias("of_id"), F.col("least.mark").alias("of_mark"))
    rows = signed.filter("n > 0").groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("rows"))
    return least.join(rows, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of_mark"))).select("doc_id", "mark", "rows")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents: shingles of 4 words, similarity 0.85."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), k=4, num=85)


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d
), c AS MATERIALIZED (SELECT min(doc_id) AS rep, list_sort(g) AS k FROM s WHERE len(g) > 0 GROUP BY 2),
n AS MATERIALIZED (SELECT rep, len(k) AS n FROM c), e AS MATERIALIZED (SELECT rep, unnest(k) AS t FROM c),
o AS (SELECT a.rep AS x, b.rep AS y, count(*) AS i FROM e a JOIN e b ON a.t = b.t AND a.rep < b.rep GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM o JOIN n p ON p.rep = x JOIN n q ON q.rep = y WHERE 100 * i >= 85 * (p.n + q.n - i)),
u AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT rep AS v, rep AS m FROM c UNION SELECT u.y, r.m FROM r JOIN u ON u.x = r.v WHERE r.m < u.y),
f AS (SELECT v, min(m) AS m FROM r GROUP BY 1)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(f.m, s.doc_id) AS component_id
FROM s LEFT JOIN c ON c.k = list_sort(s.g) AND len(s.g) > 0 LEFT JOIN f ON f.v = c.rep
"""
