r"""Toxicity by weak supervision.

1. A lexicon is induced from a bounded sample of labelled training rows: word stems whose log-odds for the label are high
   where they are dense. It joins a seed list of insults, and is dealt into several voters; so are the density of all
   lexicon words, patterns (address of a reader next to a lexicon word, shouting, runs of marks) and the absence of any
   hit. A voter says 1 (toxic), 0 (clean) or -1 (nothing).
2. All documents' vote patterns are counted. A generative label model is fitted to the counts by expectation
   maximisation: a class prior, and for each voter the chance of each vote given the class. The labelled sample's patterns
   count with their labels, scaled to the weight of all documents, so the classes can't drift to others that votes form. Pairs of voters whose votes
   still depend on each other given the class get a weight: a voter's evidence is divided by one plus the sum of its
   partial correlations, so voters that repeat each other aren't counted in full.
3. A linear classifier (logistic, on counts of lexicon words and on votes) is trained on the model's posteriors over the
   same bounded sample, and scores every whole text.

Labels are read only for rows whose crc32(doc_id as text) mod 5 isn't 0. Scores use the text alone.

Bounds: SAMPLE labelled rows, MOST_STEMS stems; vote patterns are at most 3 ** voters, in practice a few hundred.
Defined results: null text is empty; empty texts get the score of a text without hits; equal texts get equal scores;
repeated rows stay; a null doc_id isn't held out; with no labels at all the seed list alone is the lexicon.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import to_batch, whole, written

#: Seed insults in the four languages of the documents.
SEEDS = ("idiot", "idiots", "stupid", "moron", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "dumb", "imbecile", "filth", "vermin", "idiota", "estúpido", "imbécil", "basura", "asqueroso", "dummkopf", "abschaum", "widerlich", "dreckig", "idiotin", "stupide", "crétin", "ordure", "dégoûtant", "minable")
#: Words that address a reader.
ADDRESS = ("you", "your", "you're", "youre", "du", "dich", "ihr", "euch", "tu", "toi", "vous", "te", "usted", "eres")
SAMPLE, MOST_STEMS, DECKS = 12_000, 256, 4
#: Bytes of a stem; the share of a text's words from which a stem is dense in it.
SHORTEST, LONGEST, DENSE = 4, 8, 0.004
STRIP = b".,;:!?\"'()[]{}<>*#%$&~_-"


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def words_of(text: str) -> list[bytes]:
    """Words in lower case without marks at their ends, in order."""
    return [w.strip(STRIP) for w in text.lower().encode("utf-8", "surrogatepass").split()]


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """body and toxic of about `sample` training rows at most: all of them, or those with the smallest hashes of their ids."""
    train = labels.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = train.count()
    kept = written(train.filter(F.shiftrightunsigned(F.xxhash64("doc_id"), 33) < F.lit(int((1 << 31) * min(1.0, sample / max(1, n)) * 0.97) if n > sample else 1 << 31)), "train")
    # The side that is broadcast has at most about `sample` ids.
    texts = docs.select("doc_id", whole("text").alias("body")).join(F.broadcast(kept), "doc_id").select("body", "toxic")
    return written(texts, "sample")


def stems_of(words: list[bytes]) -> dict[bytes, int]:
    """Beginnings of SHORTEST to LONGEST bytes of the words that are dense in the text, with their counts."""
    n: dict[bytes, int] = {}
    for w in words:
        for k in range(SHORTEST, min(LONGEST, len(w)) + 1):
            n[w[:k]] = n.get(w[:k], 0) + 1
    return {s: c for s, c in n.items() if c >= DENSE * len(words)}


def induce_lexicon(sample: DataFrame, most: int = MOST_STEMS) -> list[bytes]:
    """Word stems by the log-odds of the label where they are dense, best first; none begins with another."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                seen: dict[bytes, list[int]] = {}
                for x in batch.slice(i, 256).to_pylist():
                    for s in stems_of(words_of(x["body"])):
                        got = seen.setdefault(s, [0, 0])
                        got[0] += x["toxic"]
                        got[1] += 1
                if seen:
                    yield to_batch([(s, *c) for s, c in seen.items()], pa.schema([("stem", pa.binary()), ("a", pa.int64()), ("n", pa.int64())]))

    totals = sample.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    bad, n = totals[0] or 0, totals[1]
    if not bad or bad == n:
        return []
    got = sample.select("body", F.col("toxic").cast("int").alias("toxic")).mapInArrow(count, "stem binary, a long, n long").groupBy("stem").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))
    good = n - bad
    odds = F.log(((F.col("a") + 0.5) / (bad + 1)) / ((F.col("n") - F.col("a") + 0.5) / (good + 1)))
    # Stems must be seen often enough and mean the label clearly; four times as many as are kept come here, for the choice.
    listed = got.withColumn("odds", odds).filter((F.col("a") >= max(5, 0.01 * bad)) & (F.col("odds") > 2.3)).orderBy(F.desc(F.col("odds") * F.sqrt("a")), F.desc(F.length("stem")), "stem").limit(4 * most)
    chosen: list[bytes] = []
    for r in listed.collect():
        s = bytes(r["stem"])
        if len(chosen) < most and not any(s.startswith(c) or c.startswith(s) for c in chosen):
            chosen.append(s)
    return chosen


class Voters:
    """Votes and features of a text. cut: the density of lexicon words that best parts the labels of the sample."""

    def __init__(self, lexicon: list[bytes], cut: float = 0.01) -> None:
        self.seeds = {w.encode() for w in SEEDS}
        self.stems = sorted(set(lexicon) | {w[:LONGEST] for w in self.seeds})
        self.place = {s: i for i, s in enumerate(self.stems)}
        self.deck = {s: i % DECKS for i, s in enumerate(lexicon)}
        self.address = {w.encode() for w in ADDRESS}
        self.marks = re.compile(r"[!?]{3,}")
        self.cut = cut
        self.names = [*(f"deck {i}" for i in range(DECKS)), "seeds", "address", "shouting", "marks", "density", "density, strict", "density, mild", "no hit", "two stems"]

    def hits(self, text: str) -> tuple[list[bytes], dict[bytes, list[int]]]:
        """The words, and for each lexicon stem in the text the places of its words."""
        words = words_of(text)
        found: dict[bytes, list[int]] = {}
        first = {w: s for w in set(words) for k in range(SHORTEST, LONGEST + 1) if (s := w[:k]) in self.place and len(s) == k}
        if first:
            for i, w in enumerate(words):
                if w in first:
                    found.setdefault(first[w], []).append(i)
        return words, found

    def look(self, text: str) -> tuple[tuple[int, ...], dict[int, int], int]:
        """Votes, hits by stem, number of words."""
        words, found = self.hits(text)
        n, total = max(1, len(words)), sum(map(len, found.values()))
        per_deck = [0] * DECKS
        for s, at in found.items():
            if s in self.deck:
                per_deck[self.deck[s]] += len(at)
        votes = [1 if c >= self.cut / 3 * n and c else -1 for c in per_deck]
        votes.append(1 if self.seeds.intersection(words) else -1)
        near = any(self.address.intersection(words[max(0, i - 3) : i + 4]) for at in found.values() for i in at)
        votes.append(1 if near else -1)
        votes.append(1 if total and sum(map(str.isupper, text)) > 0.5 * len(text) else -1)
        votes.append(1 if total and self.marks.search(text) else -1)
        for up, down in ((1.0, 1.0), (1.2, 0.8), (0.9, 0.5)):
            votes.append(1 if total and total >= up * self.cut * n else 0 if total < down * self.cut * n or not total else -1)
        votes.append(-1 if total else 0)
        votes.append(1 if len(found) >= 2 and total >= self.cut * n else 0 if not total else -1)
        return tuple(votes), {self.place[s]: len(at) for s, at in found.items()}, len(words)

    def size(self) -> int:
        return len(self.stems) + 2 * len(self.names) + 2

    def features(self, votes: tuple[int, ...], hits: dict[int, int], n: int) -> np.ndarray:
        """Each stem's density, their sum's, and the votes; densities in cuts, up to 5."""
        x = np.zeros(self.size())
        for i, c in hits.items():
            x[i] = min(5.0, c / max(1, n) / self.cut) / 5
        v = np.array(votes)
        x[len(self.stems) : -2] = np.r_[v == 1, v == 0]
        x[-2] = min(5.0, sum(hits.values()) / max(1, n) / self.cut)
        x[-1] = 1
        return x


def best_cut(density: np.ndarray, toxic: np.ndarray) -> float:
    """The density at or above which texts are called toxic with the fewest errors; between the two values that it parts."""
    order = np.argsort(-density, kind="stable")
    d, y = density[order], toxic[order]
    gain = np.r_[0, np.cumsum(2 * y - 1)].astype(float)
    ends = np.r_[True, d[1:] != d[:-1], True] if len(d) else np.array([True])
    gain[~ends] = -np.inf
    at = int(np.argmax(gain))
    if not 0 < at < len(d):
        return 0.01
    return float(max(1e-4, (d[at - 1] + d[at]) / 2))


class LabelModel:
    """The generative model: prior, chance of each vote given the class, and weights against dependence."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, marked: np.ndarray | None = None, rounds: int = 60) -> None:
        """marked: for each pattern, how many labelled rows are clean and toxic."""
        n, self.m = counts.sum(), patterns.shape[1]
        marked = np.zeros((len(counts), 2)) if marked is None or not marked.sum() else marked * (n / marked.sum())
        onehot = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)  # pattern, voter, vote
        # Begin with the majority of the votes, each voter taken to be better than chance.
        lean = (patterns == 1).sum(1) - (patterns == 0).sum(1)
        post = 1 / (1 + np.exp(-2.0 * lean))
        for _ in range(rounds):
            w1, w0 = counts * post + marked[:, 1], counts * (1 - post) + marked[:, 0]
            self.prior = (w1.sum() + 1) / (n + marked.sum() + 2)
            self.given = np.log(np.stack([(np.einsum("p,pmv->mv", w, onehot) + 0.1) / (w.sum() + 0.3) for w in (w0, w1)]))
            # Of votes beyond what the class explains: correlations of residuals over all patterns.
            expected = post[:, None] * np.exp(self.given[1, :, 2]) + (1 - post)[:, None] * np.exp(self.given[0, :, 2])
            rest = onehot[:, :, 2] - expected
            cov = np.einsum("p,pi,pj->ij", counts, rest, rest) / n
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            dependence = np.clip(cov / np.outer(sd, sd), 0, 1)
            np.fill_diagonal(dependence, 0)
            self.weight = 1 / (1 + dependence.sum(1))
            post = self.posterior(onehot)

    def posterior(self, onehot: np.ndarray) -> np.ndarray:
        logit = np.log(self.prior / (1 - self.prior)) + np.einsum("pmv,mv,m->p", onehot, self.given[1] - self.given[0], self.weight)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def of(self, patterns: np.ndarray) -> np.ndarray:
        return self.posterior(np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float))


def train_linear(x: np.ndarray, p: np.ndarray, many: np.ndarray, l2: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels of rows that stand for `many` each, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (many * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + l2 * np.eye(len(w)), x.T @ (many * (q - p)) + l2 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Voters, np.ndarray]:
    rows = labelled_sample(docs, labels, sample)
    lexicon = induce_lexicon(rows)
    first = Voters(lexicon)

    def densities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            looked = [first.look(b) for b in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(h.values()) / max(1, n) for _, h, n in looked], pa.float64()), batch.column("toxic").cast(pa.int64())], names=["density", "toxic"])

    # The bounded sample's distinct densities and labels, with counts: nearly all are 0.
    parted = rows.select("body", F.col("toxic").cast("long").alias("toxic")).mapInArrow(densities, "density double, toxic long").groupBy("density", "toxic").count().toArrow().sort_by([("density", "ascending"), ("toxic", "ascending")])
    many = parted["count"].to_numpy()
    voters = Voters(lexicon, best_cut(np.repeat(parted["density"].to_numpy(), many), np.repeat(parted["toxic"].to_numpy(), many)))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, int] = {}
            for i in range(0, batch.num_rows, 256):
                for body in batch.slice(i, 256).column("body").to_pylist():
                    key = voters.look(body)[0]
                    found[key] = found.get(key, 0) + 1
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in found], pa.list_(pa.int32())), pa.array(list(found.values()), pa.int64())], names=["votes", "n"])

    counted = docs.select(whole("text").alias("body")).mapInArrow(votes, "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    if not counted:
        return voters, np.zeros(voters.size())

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            looked = [voters.look(b) for b in batch.column("body").to_pylist()]
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([list(v) for v, _, _ in looked], ints), pa.array([list(h) for _, h, _ in looked], ints), pa.array([list(h.values()) for _, h, _ in looked], ints), pa.array([n if h else 0 for _, h, n in looked], pa.int32()), batch.column("toxic").cast(pa.int32())], names=["votes", "at", "n", "words", "toxic"])

    # The bounded sample's votes and hits; rows without hits are few distinct ones, with counts.
    keys = ["votes", "at", "n", "words", "toxic"]
    got = rows.select("body", "toxic").mapInArrow(seen, "votes array<int>, at array<int>, n array<int>, words int, toxic int").groupBy(*keys).count().orderBy(*keys).collect()
    if not got:
        return voters, np.zeros(voters.size())
    place, marked = {tuple(r["votes"]): i for i, r in enumerate(counted)}, np.zeros((len(counted), 2))
    for r in got:
        if (i := place.get(tuple(r["votes"]))) is not None:
            marked[i, int(r["toxic"] > 0)] += r["count"]
    model = LabelModel(np.array([r["votes"] for r in counted]), np.array([float(r["n"]) for r in counted]), marked)
    post, many = model.of(np.array([r["votes"] for r in got])), np.array([r["count"] for r in got], float)
    x = np.array([voters.features(tuple(r["votes"]), dict(zip(r["at"], r["n"], strict=True)), r["words"]) for r in got])
    return voters, train_linear(x, post, many)


def score(docs: DataFrame, voters: Voters, w: np.ndarray) -> DataFrame:
    """docs' rows with score (0 to 1): of the whole text."""
    columns = [c for c in docs.columns if c != "score"]
    kept = docs.select(*columns)
    body = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                x = np.array([voters.features(*voters.look(t or "")) for t in part.column(body).to_pylist()])
                s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s)], names=[*columns, "score"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields]).add("score", DoubleType()))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with score, by a model fitted to docs and labels."""
    return score(docs, *fit(docs, labels, sample))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents, scored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity(docs, labels).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
