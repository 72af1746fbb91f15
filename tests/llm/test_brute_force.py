"""Queries without SQL, and the pipeline's stages, against plain versions over whole tables."""

import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rowsense.llm import queries
from rowsense.llm.toxicity import toxicity

SF = "/root/testdata/sf0.001"
SPACE = r"[^\x20\x09-\x0D]+"
#: Kind, pattern, group, least length.
SECRETS = [("assign", re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 8), ("access", re.compile(r"(AKIA[A-Z0-9]+)"), 1, 16), ("hex", re.compile(r"([0-9a-f]+)"), 1, 32)]


def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def spans(text):
    """(start, kind's place, kind, end) of each secret."""
    out = []
    for k, (kind, pattern, group, least) in enumerate(SECRETS):
        out += [(*m.span(), k, kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted((a, k, kind, b) for a, b, k, kind in out)


def test_secrets(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_secret_scan"](spark, SF).collect()}
    docs = documents()
    assert len(got) == len(docs)
    for d in docs:
        found = spans(d["text"] or "")
        line = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in found)
        r = got[d["doc_id"]]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(f[2] == k for f in found) for k in ("assign", "access", "hex"))
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest() and r["spans"] == line


def targets(sizes):
    """Shares by weight of 150 % of all sizes, none above twice its source's."""
    sources = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    total, done = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in sources if s not in done]
        rest = total - sum(done.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return done | share
        done |= {s: 2.0 * sizes[s] for s in over}


def test_mix(spark):
    docs = documents()
    size = {d["doc_id"]: len(re.findall(SPACE, d["text"] or "")) for d in docs}
    of = Counter()
    for d in docs:
        of[d["source"]] += size[d["doc_id"]]
    goal = targets(of)
    rows = queries.QUERIES["op6_mixing"](spark, SF).collect()
    assert len(rows) == len(docs)
    source = {d["doc_id"]: d["source"] for d in docs}
    taken = Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], of[s]) and abs(r["target"] - goal[s]) < 1e-6 * max(1, goal[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 1 for s in of)
    again = {r["doc_id"]: r["taken"] for r in queries.QUERIES["op6_mixing"](spark, SF).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def shingles(text):
    w = re.findall(SPACE, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def kept_of_copies(docs):
    """The smallest id of each component of documents whose shingles agree to 0.8; those without words all stay."""
    sets = {d["doc_id"]: shingles(d["text"]) for d in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    pairs = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i for i in sets if not sets[i] or find(i) == i}


def redacted(text):
    out, at = "", 0
    for a, _, kind, b in spans(text):
        if b > at:
            out, at = out + text[at : max(a, at)] + f"[{kind}]", b
    return out + text[at:]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "jaccard_join", "secret_scan", "mixing", "packing"]
    step = dict(corpus_pipeline.STAGES)
    before = {d["doc_id"]: d for d in documents()}

    clean = step["toxicity"](spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    toxic = {r["doc_id"] for r in toxicity(docs.select("doc_id", "text"), labels).filter(F.col("score") >= 0.5).collect()}
    held = {r["doc_id"]: r.asDict() for r in clean.collect()}
    assert clean.columns == docs.columns and held == {i: d for i, d in before.items() if i not in toxic}

    unique = step["jaccard_join"](spark, spark.createDataFrame(list(held.values()), docs.schema), SF)
    kept = {r["doc_id"]: r.asDict() for r in unique.collect()}
    assert unique.columns == docs.columns and kept == {i: held[i] for i in kept_of_copies(held.values())}

    safe = step["secret_scan"](spark, spark.createDataFrame(list(kept.values()), docs.schema), SF)
    shown = {r["doc_id"]: r.asDict() for r in safe.collect()}
    assert safe.columns == docs.columns and {i: r["text"] for i, r in shown.items()} == {i: None if d["text"] is None else redacted(d["text"]) for i, d in kept.items()}
    assert all(r["n_chars"] == len(r["text"] or "") for r in shown.values())

    mixed = step["mixing"](spark, spark.createDataFrame(list(shown.values()), docs.schema), SF)
    rows = [r.asDict() for r in mixed.collect()]
    of, taken = Counter(), Counter()
    for d in shown.values():
        of[d["source"]] += len(re.findall(SPACE, d["text"] or ""))
    for r in rows:
        assert (r["text"] or "") in (shown[r["doc_id"]]["text"] or "") and r["n_chars"] == len(r["text"])
        taken[r["source"]] += len(re.findall(SPACE, r["text"]))
    goal = targets(of)
    assert mixed.columns == docs.columns and all(abs(taken[s] - goal[s]) <= 1 for s in of)

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    packed = step["packing"](spark, spark.createDataFrame(rows, docs.schema), SF).collect()
    want = Counter()
    for r in rows:
        want[tuple([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1])] += 1
    total = sum(len(t) * n for t, n in want.items())
    assert sum(p["length"] for p in packed) == total
    sequences = defaultdict(list)
    for p in packed:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(got.columns)
