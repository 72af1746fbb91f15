"""Repair of conversations: an exhaustive search of edits, and odd rows."""

import hashlib
import heapq
import random
import re

from rowsense.llm import conversation_repair as repair

ROWS = "conv_id long, turn long, role string, text string"


def faults(rows):
    """Rows of one conversation in order, each with its fault."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    out, seen = [], set()
    for turn, role, text in rows:
        shown = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def cheapest(rows):
    """Least (cost, audit) with the repaired lines, by Dijkstra over (row, role initials so far)."""
    goal = re.compile(r"(s?(ua)+)?")
    states = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "ua"}, "ua": {"u": "u"}}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, lines = heapq.heappop(heap)
        if at == len(rows) and (state in ("", "ua")):
            assert goal.fullmatch("".join(x[0] for x in lines))
            return cost, audit, list(lines)
        if (at, state, audit) in done or len(audit) > 3 * len(rows) + 2:
            continue
        done.add((at, state, audit))
        for role in ("user", "assistant"):
            if role[0] in states[state]:
                heapq.heappush(heap, (cost + 2, audit + "I", at, states[state][role[0]], (*lines, f"{role}:")))
        if at < len(rows):
            _, role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] in states[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, states[state][role[0]], (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if new[0] in states[state]:
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, states[state][new[0]], (*lines, f"{new}:{text}")))
    raise AssertionError


def dynamic(rows):
    """The same for long conversations, row by row with whole audits."""
    best = {"": (0, "", [])}
    states = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "ua"}, "ua": {"u": "u"}}
    needed = {"": "user", "s": "user", "u": "assistant", "ua": "user"}

    def opened(b):
        out = [(s, c, a, x) for s, (c, a, x) in b.items()]
        for _ in range(2):
            out += [(states[s][needed[s][0]], c + 2, a + "I", [*x, f"{needed[s]}:"]) for s, c, a, x in out]
        return out

    for _, role, text, fault in rows:
        new = {}
        for s, c, a, x in opened(best):
            ways = [(s, c + 3, a + "D", x)]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                ways.append((states[s][needed[s][0]], c + 2 + more, a + "R", [*x, f"{needed[s]}:{text}"]))
                if role[:1] in states[s]:
                    ways.append((states[s][role[0]], c + more, a + "K", [*x, f"{role}:{text}"]))
            for t, *way in ways:
                if t not in new or way[:2] < list(new[t][:2]):
                    new[t] = tuple(way)
        best = new
    ends = [(c, a, x) for s, c, a, x in opened(best) if s in ("", "ua")]
    return min(ends, key=lambda e: e[:2])


def expected(rows, solve):
    held = faults(rows)
    initials = [r[1][:1] for r in held]
    turns = [r[0] for r in held if r[0] is not None]
    count = lambda f: sum(r[3] == f for r in held)
    cost, audit, lines = solve(held)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, lines


def results(df):
    planned = repair.repair(df).cache()
    shown = {r["conv_id"]: r["repaired_sha256"] for r in repair.digests(repair.repaired(df, planned, in_order=True)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], shown.get(r["conv_id"], empty)) for r in planned.collect()}


def some_rows(rng, conv, n, span):
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No!", "what", "ok ", " ", "", None, "so? \n", "é", "a.b"]
    return [(conv, rng.choice([None, *range(span)]) if rng.random() < 0.1 else rng.randrange(span), rng.choices(roles, (6, 6, 2, 1, 1, 1))[0], rng.choice(texts) if rng.random() < 0.5 else f"t{rng.randrange(10**6)}.") for _ in range(n)]


def check(spark, rows, solve):
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS segment", "'x' AS digest", "2 AS kind", "'y' AS audit")
    got = results(df)
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        *counts, lines = expected([r[1:] for r in rows if r[0] == conv], solve)
        assert got[conv] == (*counts, hashlib.sha256("\n".join(lines).encode()).hexdigest()), conv


def test_short_conversations_equal_an_exhaustive_search(spark):
    rng = random.Random(2)
    check(spark, [r for c in [None, *range(60)] for r in some_rows(rng, c, rng.randint(1, 7), 9)], cheapest)


def test_long_conversations_over_many_pieces_and_segments(spark):
    rng = random.Random(4)
    rows = some_rows(rng, 1, 900, 700) + some_rows(rng, 2, 300, 3) + some_rows(rng, 3, 130, 100000)
    rows += [(4, None, "user", "same.")] * 200 + [(5, i, "user" if i % 2 == 0 else "assistant", f"{i}.") for i in range(600)]
    check(spark, rows, dynamic)


def test_rows_by_segment_are_the_rows_in_order(spark):
    rng = random.Random(9)
    df = spark.createDataFrame(some_rows(rng, 1, 400, 900) + some_rows(rng, 2, 20, 9), ROWS)
    planned = repair.repair(df).cache()
    assert sorted(map(tuple, repair.repaired(df, planned).collect())) == sorted(map(tuple, repair.repaired(df, planned, in_order=True).collect()))


def test_groups_end_where_a_segment_does():
    import pyarrow as pa

    schema = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64())])
    rows = [(c, s) for c in (None, 0, 1) for s in (None, 0, 1) for _ in range(5)]
    batches = [pa.RecordBatch.from_pylist([dict(conv_id=c, segment=s) for c, s in rows[i : i + 4]], schema) for i in range(0, len(rows), 4)]
    got = [[tuple(r.values()) for r in t.to_pylist()] for t in repair.groups(iter(batches), 7)]
    assert [r for t in got for r in t] == rows and len(got) > 3
    assert all(a[-1] != b[0] for a, b in zip(got, got[1:]))


def test_nothing_and_dropped(spark):
    df = spark.createDataFrame([], ROWS)
    assert repair.repair(df).count() == 0 and repair.digests(repair.repaired(df, repair.repair(df), True)).count() == 0
