r"""Lexical retrieval packing: every token of every document lies in exactly one piece of one sequence.

1. Texts become token ids. Documents side by side are cut into the tokenizer's pieces as one array of code points; each
   distinct piece is looked up in a task's table that keeps the most frequent ones when it has become large; pieces it lacks
   are encoded together. A document's ids end with the end id. A worker holds nothing of it after its task.
2. Documents are dealt to shards of about `shard_docs` documents by a weighted min-hash of their tokens, so texts that share
   rare tokens tend to meet. A min-hash that many documents have is split by a second one; only what is still too large for
   a shard (groups of copies) is split by a hash.
3. In a shard, whole windows of long documents are sequences of their own. What remains of each document enters an inverted
   index with BM25 weights, whose document frequencies and mean length are those of all documents. All terms of
   a seed document return the unused neighbours with the highest scores, which greedily fill its window; the one that
   doesn't fit is cut, and its rest stays unused. So all sequences but a shard's last are full; the last is cut into
   sequences whose lengths are powers of two.

Bounds: a shard holds less than a window of each document at a time; the frequencies are at most one number per id of
the vocabulary. Defined results: null and empty texts are the end id alone; repeated rows are documents of their own;
a null doc_id is kept; an empty table gives no pieces; other columns don't matter.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, to_batch, whole, written

WINDOW, END, SHARD_DOCS = 2048, 1, 2048
#: Pieces that a task remembers, and those of them that it keeps when it has more; only those it lacks go through the tokenizer.
PIECES_HELD, PIECES_KEPT = 200_000, 100_000
#: Texts stand in arrays of about so many bytes, twice as many at most, where each row counts ROW_BYTES more; a longer text
#: comes alone, and is cut at spaces.
CHUNK_BYTES, ROW_BYTES = 1 << 20, 1 << 10
#: BM25's usual parameters.
K1, B = 1.2, 0.75
#: Texts with these characters or strings go through the tokenizer as a whole.
ODD = r"[\x1c-\x1f\x{180e}]|<\|"
#: Stands between texts; no text but odd ones has it.
BETWEEN = "\x1c"
#: Classes of code points in the tokenizer's own way of cutting texts, which its file states, and the endings
#: that it cuts off: 's|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+
SPACE, LETTER, NUMBER, OTHER = range(4)
CLASSES = (regex.compile(r"\s|\x1c"), SPACE), (regex.compile(r"\p{L}"), LETTER), (regex.compile(r"\p{N}"), NUMBER)
ENDINGS = "s", "t", "m", "d", "re", "ve", "ll"


class PieceTable(dict):
    """Piece to number, in the order in which pieces come; new ones are noted."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


class Ragged:
    """Lists of ids by number, one array behind another."""

    def __init__(self) -> None:
        self.ids, self.used = np.zeros(1 << 16, np.uint16), 0
        self.start, self.n = np.zeros(1 << 14, np.int64), 0

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(lengths) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[self.n + 1 : self.n + len(lengths) + 1] = self.used + np.cumsum(lengths)
        self.used += len(ids)
        self.n += len(lengths)

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the numbered lists in turn, and the lists' lengths."""
        first, lengths = self.start[numbers], self.start[numbers + 1] - self.start[numbers]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - lengths), lengths)
        return self.ids[at], lengths


def at_spaces(text: str, size: int) -> Iterator[str]:
    """The text's parts of about so many characters, which end before a space, as no token spans one."""
    at = 0
    while len(text) - at > size:
        end = text.find(" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end
    yield text[at:]


class Encoder:
    """ids of texts as the tokenizer gives them, by its pieces, which no token spans."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path, self.of_pieces = path, Tokenizer.from_file(path)
        # Pieces are normal and cut already.
        self.of_pieces.normalizer = normalizers.Sequence([])
        self.of_pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.of_pieces.get_vocab()
        self.size = max(vocabulary.values()) + 1
        if self.size > 1 << 16:
            raise ValueError("the vocabulary has ids beyond 16 bits")
        self.ends = np.zeros(self.size, bool)
        for word, i in vocabulary.items():
            self.ends[i] = word.endswith("</w>")
        self.pieces, self.piece_ids = PieceTable(), Ragged()
        # How many arrays had a piece, by its number.
        self.met = np.zeros(0, np.int32)
        # By code point, filled as they come: its lower case, and that one's class.
        self.lower, self.kind = np.zeros(0x110000, np.uint32), np.full(0x110000, -1, np.int8)

    @cached_property
    def tokenizer(self) -> object:
        """For odd texts, which few tasks have."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str, tokenizer: object = None) -> np.ndarray:
        return np.array((tokenizer or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)

    def learn(self) -> None:
        new, self.pieces.new = self.pieces.new, []
        for at in range(0, len(new), 512):
            some = new[at : at + 512]
            ids = self.ids(" ".join(some), self.of_pieces)
            last = np.flatnonzero(self.ends[ids]) if len(ids) else np.zeros(0, np.int64)
            if len(last) == len(some) and last[-1] == len(ids) - 1:
                self.piece_ids.add(ids, np.diff(np.r_[-1, last]))
            else:
                for x in some:
                    one = self.ids(x, self.of_pieces)
                    self.piece_ids.add(one, np.array([len(one)]))

    def forget(self, most: int) -> None:
        """Keeps pieces that more than one array had, those of the most arrays, so many at most."""
        kept = np.flatnonzero(self.met > 1)
        kept = kept[np.argsort(-self.met[kept], kind="stable")[:most]]
        pieces, ids = list(self.pieces), self.piece_ids.get(kept)
        self.pieces, self.piece_ids, self.met = PieceTable(), Ragged(), np.ones(len(kept), np.int32)
        self.pieces.update((pieces[i], n) for n, i in enumerate(kept.tolist()))
        self.piece_ids.add(*ids)

    def classes(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code points in lower case, and their classes."""
        kind = self.kind[codes]
        if (kind < 0).any():
            for c in np.unique(codes[kind < 0]).tolist():
                low = chr(c).lower()
                self.lower[c] = ord(low)
                self.kind[c] = next((k for of, k in CLASSES if of.fullmatch(low)), OTHER)
            kind = self.kind[codes]
        return self.lower[codes], kind

    def cut(self, texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
        """The pieces of all texts in turn, and how many come before each text's end."""
        # In lower case U+0130 alone is two code points.
        normal = [t if t.isascii() else unicodedata.normalize("NFC", t).replace("İ", "i̇") for t in texts]
        codes = np.frombuffer((BETWEEN.join(normal) + BETWEEN * 4).encode("utf-32-le"), "<u4")
        codes, kind = self.classes(codes)
        starts = kind != SPACE
        starts[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        marks = np.flatnonzero((codes == ord("'")) & starts)
        for ending in ENDINGS:
            n = len(ending)
            found = marks[np.logical_and.reduce([codes[marks + 1 + i] == ord(c) for i, c in enumerate(ending)])]
            starts[found + 1] = False
            starts[found + 1 + n] |= kind[found + 1 + n] == LETTER
        at = np.flatnonzero(starts)
        before = np.searchsorted(at, np.flatnonzero(codes == ord(BETWEEN))[: len(texts)])
        keep = kind != SPACE
        kept, first = codes[keep], np.append(np.flatnonzero(starts[keep]), np.count_nonzero(keep))
        if len(kept) and kept.max() > 0x7F:
            width = 1 + (kept > 0x7F).astype(np.int8) + (kept > 0x7FF) + (kept > 0xFFFF)
            first = np.append(0, np.cumsum(width, dtype=np.int64))[first]
            body = kept.tobytes().decode("utf-32-le").encode()
        else:
            body = kept.astype(np.uint8).tobytes()
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(first.astype(np.int32)), pa.py_buffer(body)), before

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in turn, and the texts' lengths."""
        if len(texts) != 1 or len(text := texts[0].as_py()) <= CHUNK_BYTES:
            return self.side_by_side(texts)
        ids = np.concatenate([self.side_by_side(pa.array([part]))[0] for part in at_spaces(text, CHUNK_BYTES // 4)])
        return ids, np.array([len(ids)])

    def side_by_side(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pieces) > PIECES_HELD:
            self.forget(PIECES_KEPT)
        odd = np.flatnonzero(pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False))
        bodies = texts.to_pylist()
        whole = {i: self.ids(bodies[i]) for i in odd.tolist()}
        pieces, before = self.cut(["" if i in whole else t for i, t in enumerate(bodies)])
        distinct = pieces.dictionary_encode()
        numbers = np.fromiter(map(self.pieces.__getitem__, distinct.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int64, len(distinct.dictionary))
        self.learn()
        self.met = np.append(self.met, np.zeros(len(self.pieces) - len(self.met), np.int32))
        self.met[numbers] += 1
        ids, lengths = self.piece_ids.get(numbers[distinct.indices.to_numpy()])
        ends = np.append(0, np.cumsum(lengths))[before]
        if not whole:
            return ids, np.diff(ends, prepend=0)
        rows = [whole.get(i, x) for i, x in enumerate(np.split(ids, ends[:-1]))]
        return np.concatenate(rows), np.array([len(x) for x in rows])


def hashed(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (x.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


@lru_cache(2)
def draws(size: int, salt: int = 77) -> tuple[np.ndarray, np.ndarray]:
    """Each id's rank, and the ids by rank, by a uniform number's exponential draw, divided by the rarity that a merge order
    tells: the least wins."""
    u = (hashed(np.arange(size), salt) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    order = np.argsort(-np.log(np.maximum(u, 1e-300)) / np.maximum(np.log2(np.arange(size) + 2.0) - 7.0, 0.05) ** 3, kind="stable").astype(np.int32)
    rank = np.zeros(size, np.int32)
    rank[order] = np.arange(size)
    return rank, order


def chunks(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch's rows in turn, so many at a time that their texts take about CHUNK_BYTES; a longer text comes alone."""
    size = pc.binary_length(batch.column(text)).to_numpy().astype(np.int64) + ROW_BYTES
    ends = np.diff(np.cumsum(size) // CHUNK_BYTES) > 0
    cuts = np.r_[0, np.flatnonzero(ends | (size[:-1] > CHUNK_BYTES)) + 1, batch.num_rows]
    for at, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if at < end:
            yield batch.slice(at, end - at)


TOKENS = "doc_id long, n_tokens long, ids binary, signature int, second int, checksum long, df binary"
TOKENS_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("signature", pa.int32()), ("second", pa.int32()), ("checksum", pa.int64()), ("df", pa.binary())])


def tokenized(docs: DataFrame, tokenizer: str, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document, and one per task that has only df: in how many of the task's documents each id is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(tokenizer)
        df, ranks = np.zeros(enc.size, np.int64), (draws(enc.size), draws(enc.size, 78))
        for batch in batches:
            for part in chunks(batch, 1):
                ids, lengths = enc.encode(part.column(1))
                ids = np.insert(ids, np.cumsum(lengths), end).astype("<u2")
                lengths = lengths + 1
                ends = np.cumsum(lengths)
                first = ends - lengths
                terms = np.sort(np.repeat(np.arange(len(lengths), dtype=np.uint32) << 16, lengths) | ids)
                df += np.bincount(terms[np.diff(terms, prepend=~terms[:1]) != 0] & 0xFFFF, minlength=enc.size)
                least = [order[np.minimum.reduceat(rank[ids], first)] for rank, order in ranks]
                raw = ids.tobytes()
                sums = [zlib.crc32(raw[2 * i : 2 * j]) for i, j in zip(first.tolist(), ends.tolist(), strict=True)]
                packed = pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(np.append(0, 2 * ends).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths), packed, *map(pa.array, least), pa.array(sums, pa.int64()), pa.nulls(len(lengths), pa.binary())], schema=TOKENS_ARROW)
        if df.any():
            yield to_batch([(None, None, None, None, None, None, df.astype("<i8").tobytes())], TOKENS_ARROW)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("body")).mapInArrow(lean(run), TOKENS)


def frequencies(tokens: DataFrame) -> np.ndarray:
    """In how many documents each id is: as many numbers as the vocabulary has ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column("df").to_pylist():
                one = np.frombuffer(raw, "<i8")
                total = one.copy() if total is None else total + one
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])

    got = tokens.filter(F.col("df").isNotNull()).select("df").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << 16, np.int64)
    out[got["id"].to_numpy()] = got["n"].to_numpy()
    return out


class Pool:
    """The unused documents of a shard and their inverted index."""

    def __init__(self, rows: list[tuple], idf: np.ndarray, mean: float) -> None:
        # rows: doc_id, document's tokens, tokens before the rest, the rest's ids.
        self.rows, self.left = rows, np.array([len(r[3]) for r in rows], np.int64)
        self.taken = np.zeros(len(rows), np.int64)
        found = [np.unique(r[3], return_counts=True) for r in rows]
        n = np.array([len(t) for t, _ in found])
        doc, term, tf = np.repeat(np.arange(len(rows)), n), np.concatenate([t for t, _ in found]), np.concatenate([c for _, c in found])
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.repeat(self.left, n) / max(mean, 1.0)))
        # Terms that many documents have are rows of a matrix, whose sums need no places; the others are lists of postings.
        often = np.bincount(term, minlength=len(idf)) * 8 >= len(rows)
        self.row_of = np.where(often, np.cumsum(often) - 1, -1)
        self.rows_of_often = np.zeros((int(often.sum()), len(rows)), np.float32)
        self.rows_of_often[self.row_of[term[often[term]]], doc[often[term]]] = weight[often[term]]
        doc, weight, term = (x[~often[term]] for x in (doc, weight, term))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.starts = np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.query = [t.astype(np.int64) for t, _ in found]
        self.next, self.used, self.indexed = 0, 0, len(rows)

    def forget_used(self) -> None:
        """Takes used documents out of the index, whenever they have become a fifth of it."""
        if self.used * 5 > self.indexed:
            keep = self.left[self.doc] > 0
            self.doc, self.weight = self.doc[keep], self.weight[keep]
            self.starts = np.r_[0, np.cumsum(keep)][self.starts]
            self.indexed -= self.used
            self.used = 0

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused documents, the best scores first; then those that share no term with the seed."""
        self.forget_used()
        first, n = self.starts[self.query[seed]], self.starts[self.query[seed] + 1] - self.starts[self.query[seed]]
        at = np.arange(n.sum()) + np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n)
        scores = np.bincount(self.doc[at], self.weight[at], minlength=len(self.rows))
        often = self.row_of[self.query[seed]]
        asked = np.zeros(len(self.rows_of_often), np.float32)
        asked[often[often >= 0]] = 1
        scores = scores + asked @ self.rows_of_often
        scores[self.left == 0] = 0
        many = 64
        while True:
            best = np.argpartition(-scores, many)[:many] if len(scores) > many else np.arange(len(scores))
            best = best[scores[best] > 0]
            best = best[np.lexsort((best, -scores[best]))]
            yield from best.tolist()
            if len(best) < many:
                break
            scores[best] = 0
        while self.next < len(self.rows):
            yield self.next
            self.next += self.left[self.next] == 0

    def take(self, i: int, room: int) -> tuple[int, int, int]:
        """Document, first and number of the ids taken."""
        n = min(room, int(self.left[i]))
        at = int(self.taken[i])
        self.taken[i] += n
        self.left[i] -= n
        self.used += not self.left[i]
        return i, at, n

    def sequences(self, window: int) -> Iterator[list[tuple[int, int, int]]]:
        for seed in range(len(self.rows)):
            while self.left[seed]:
                pieces = [self.take(seed, window)]
                room = window - pieces[0][2]
                if room:
                    for i in self.neighbours(seed):
                        if self.left[i]:
                            pieces.append(self.take(i, room))
                            room -= pieces[-1][2]
                        if not room:
                            break
                yield pieces


def by_powers(pieces: list[tuple[int, int, int]], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """One sequence if it is full, else sequences whose lengths are powers of two."""
    total = sum(n for _, _, n in pieces)
    sizes = [window] if total == window else [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    todo = list(reversed(pieces))
    for size in sizes:
        out = []
        while size:
            i, at, n = todo.pop()
            m = min(n, size)
            out.append((i, at, m))
            if m < n:
                todo.append((i, at + m, n - m))
            size -= m
        yield out


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
PACKED_ARROW = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])


def in_shards(rows: DataFrame, n: int, shard_docs: int) -> DataFrame:
    """The n rows with their shards: by the min-hash, where that gives too many by the second too, then by a hash."""
    parts = lambda docs: F.ceil(docs / shard_docs).cast("long")
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64("signature"), F.lit(max(1, -(-n // shard_docs)))))
    seconds = written(placed.groupBy("bucket", "second").agg(F.count(F.lit(1)).alias("docs")), "seconds")
    large = seconds.groupBy("bucket").agg(parts(F.sum("docs")).alias("subs"))
    seconds = seconds.join(large, "bucket").withColumn("sub", F.pmod(F.xxhash64("second"), F.col("subs")))
    sizes = seconds.groupBy("bucket", "subs", "sub").agg(parts(F.sum("docs")).alias("splits"))
    first = F.coalesce(F.sum("splits").over(Window.orderBy("bucket", "sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    shards = written(sizes.select("bucket", "subs", "sub", "splits", first.alias("first")), "shards")
    subs = shards.select("bucket", "subs").distinct()
    placed = placed.join(subs, "bucket").withColumn("sub", F.pmod(F.xxhash64("second"), F.col("subs")))
    met = placed.join(shards.drop("subs"), ["bucket", "sub"])
    return met.withColumn("shard", F.col("first") + F.pmod(F.xxhash64("doc_id", "checksum"), F.col("splits")))


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, shard_docs: int = SHARD_DOCS, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the piece's ids (unsigned 16-bit)."""
    tokens = written(tokenized(docs, tokenizer, end, doc_id, text), "tokens")
    df, rows = frequencies(tokens), tokens.filter(F.col("df").isNull()).drop("df")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).first()
    n, mean = total["n"], (total["t"] or 0) / max(1, total["n"])
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    dealt = in_shards(rows, n, shard_docs).select("shard", "doc_id", "n_tokens", "checksum", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, local, rests, lines = None, 0, [], []

        def line(d: int | None, all_tokens: int, start: int, ids: np.ndarray, offset: int) -> tuple:
            return d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), all_tokens, (shard << 28) + local, offset, ids.astype("<u2").tobytes() if with_ids else None

        def finish() -> Iterator[tuple]:
            nonlocal local
            if not rests:
                return
            pool = Pool(rests, idf, mean)
            for found in pool.sequences(window):
                for pieces in by_powers(found, window):
                    offset = 0
                    for i, at, m in pieces:
                        d, all_tokens, before, ids = rests[i]
                        yield line(d, all_tokens, before + at, ids[at : at + m], offset)
                        offset += m
                    local += 1

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for s, d, m, raw in zip(*(batch.slice(i, 256).column(c).to_pylist() for c in ("shard", "doc_id", "n_tokens", "ids")), strict=True):
                    if s != shard:
                        lines += finish()
                        shard, local, rests = s, 0, []
                    ids = np.frombuffer(raw, "<u2")
                    for at in range(0, m - window + 1, window):
                        lines.append(line(d, m, at, ids[at : at + window], 0))
                        local += 1
                    if m % window:
                        rests.append((d, m, m - m % window, ids[m - m % window :]))
                    if len(lines) >= 2048:
                        yield to_batch(lines, PACKED_ARROW)
                        lines = []
        lines += finish()
        for at in range(0, len(lines), 2048):
            yield to_batch(lines[at : at + 2048], PACKED_ARROW)

    return dealt.repartition("shard").sortWithinPartitions("shard", "doc_id", "checksum").mapInArrow(lean(run), PACKED)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents in windows of 2048 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, str(public_tokenizers.path("word_bpe_49k.json")), with_ids=False).drop("ids")
