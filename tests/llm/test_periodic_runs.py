"""Runs of words: brute force over every period, and odd rows."""

import random
import zlib

import numpy as np

from rowsense.llm import periodic_runs

DOCS = "doc_id long, text string"


def brute(w, least=12):
    """Every maximal stretch of every period, without those that have a smaller one."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 2 * q) and not any(all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts(rng, many):
    for _ in range(many):
        n, k = rng.randint(0, 70), rng.choice([1, 2, 3, 30])
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(2, 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        yield w


def test_runs_of_many_texts_at_once():
    rng = random.Random(5)
    for _ in range(150):
        docs = list(texts(rng, rng.randint(1, 6)))
        flat = np.array([x for d in docs for x in d], dtype=np.int64)
        for least in (1, 12):
            got = [tuple(r) for r in periodic_runs.runs_of(flat, np.array([len(d) for d in docs]), least).tolist()] if flat.size else []
            assert got == [(k, *r) for k, d in enumerate(docs) for r in brute(d, least)]


def test_unpacked_keys_give_the_same(monkeypatch):
    docs = list(texts(random.Random(7), 40))
    flat, lengths = np.array([x for d in docs for x in d], dtype=np.int64), np.array([len(d) for d in docs])
    packed = periodic_runs.runs_of(flat, lengths)
    monkeypatch.setattr(periodic_runs, "WORDS", 1)
    assert periodic_runs.runs_of(flat, lengths).tolist() == packed.tolist()


def test_batches_cover_all_rows_and_keep_long_ones_alone():
    cuts = list(periodic_runs.cut(np.array([10, 10, 10 * periodic_runs.WORDS, 3, 0])))
    assert cuts == [(0, 2), (2, 3), (3, 5)]
    assert list(periodic_runs.cut(np.array([], dtype=np.int64))) == []


def damaged(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def test_odd_rows_and_damage(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randint(0, 90)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (None, "a b " * 9), (203, "a\x0bb\x0ca\rb\ta\nb a b a b a b a b"), (204, "é é é é " * 8), (1, rows[1][1]), (205, "x " * 50000 + "y")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS runs", "2 AS words", "3 AS a", "4 AS h")
    got = periodic_runs.periodic_runs(periodic_runs.made_periodic(df)).collect()
    assert len(got) == len(rows)
    seen = sorted((str(r["doc_id"]), r["n_words"], [(x["start"], x["length"], x["period"]) for x in r["runs"]], r["collapsed"]) for r in got)
    expected = []
    for doc_id, text in rows:
        w = damaged(doc_id, text)
        runs = [(0, 50000, 1)] if doc_id == 205 and len(set(w)) == 2 else brute(w)
        out = {i for s, n, q in runs for i in range(s + q, s + n)}
        expected.append((str(doc_id), len(w), runs, b" ".join(x for i, x in enumerate(w) if i not in out).decode()))
    assert seen == sorted(expected)
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0
