"""Fingerprints: brute force of the whole query, short texts against all grams, odd rows."""

import hashlib
import random

from rowsense.llm import fingerprints as fp

ROWS = "doc_id long, text string"


def grams(text, k=fp.K):
    k = min(k, len(text))
    return [text[i : i + k] for i in range(len(text) - k + 1)] if text else []


def chosen(text, window):
    """The least hash of every window, the rightmost of equal ones, with places; hashes one gram at a time."""
    h = [int(fp.gram_hashes(fp.code_points(g), len(g))[0]) for g in grams(text)]
    w, out = min(window, len(h)), {}
    for i in range(len(h) - w + 1 if h else 0):
        at = min(range(i, i + w), key=lambda j: (h[j], -j))
        out[at] = h[at]
    return out


def plain(rows):
    """What the query gives, by lists: doc_id, length, digest, fingerprints and both likenesses."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    likeness = lambda a, b, w: (lambda x, y: len(x & y) / len(x | y) if x | y else 1.0)(set(chosen(a, w).values()), set(chosen(b, w).values()))
    shown = lambda t: "".join(f"{h:08x}{at:08x}" for at, h in sorted(chosen(t, fp.window_for(len(t), fp.K, fp.WINDOW)).items()))
    out = []
    for n, (i, t) in enumerate(rows):
        nxt = rows[(n + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        wide = [max(fp.window_for(len(x), fp.K, fp.WINDOW) for x in (t, o)) for o in (edited, nxt)]
        out.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(t), shown(edited), round(likeness(t, edited, wide[0]), 9), round(likeness(t, nxt, wide[1]), 9)))
    return sorted(out)


def test_query_equals_a_plain_version(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abc é\U0001f600") for _ in range(rng.choice([0, 5, 23, 24, 60, 150, 900, 2600])))) for i in range(60)]
    rows += [(60, None), (61, ""), (None, "x y z " * 20), (3, rows[3][1]), (3, rows[3][1]), (4, "another text of one id")]
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS slot", "'g' AS ghost", "2 AS body", "3 AS head")
    got = sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in fp.compare_edited(df).collect())
    assert got == plain(rows)
    assert fp.compare_edited(df.limit(0)).count() == 0
    assert plain([(1, "one")]) == sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in fp.compare_edited(spark.createDataFrame([(1, "one")], ROWS)).collect())


def test_short_texts_are_as_alike_as_their_grams():
    rng = random.Random(4)
    for n in (60, 100, 150, 300, 600):
        errors = []
        for _ in range(60):
            a, b = ("".join(rng.choice("abcdefghij ") for _ in range(n)) for _ in range(2))
            edited = a[: n - n // 2] + b[: n // 2]
            x, y = set(grams(a)), set(grams(edited))
            errors.append(abs(fp.Print(a, fp.K, fp.WINDOW).like(fp.Print(edited, fp.K, fp.WINDOW)) - len(x & y) / len(x | y)))
        assert sum(errors) / len(errors) < 0.05, (n, sum(errors) / len(errors))


def test_long_passages_always_meet():
    rng = random.Random(5)
    made = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    for _ in range(100):
        shared = made(fp.WINDOW + fp.K - 1)
        a, b = (fp.Print(made(rng.randint(0, 3000)) + shared + made(rng.randint(0, 3000)), fp.K, fp.WINDOW) for _ in range(2))
        assert a.like(b) > 0


def test_a_wider_window_chooses_among_what_a_narrow_one_does():
    text = "".join(random.Random(6).choice("ab") for _ in range(500))
    sets = [set(fp.winnow(fp.code_points(text), fp.K, w)[0].tolist()) for w in (1, 2, 4, 8, 16, 32, 48)]
    assert all(b <= a for a, b in zip(sets, sets[1:]))
