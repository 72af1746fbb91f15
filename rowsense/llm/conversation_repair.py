r"""Repair of a conversation's structure at the least cost, with an audit of every edit.

A repaired conversation's role initials are `(s?(ua)+)?`. Rows are kept (K, free), get the role user or assistant (R, 2),
are deleted (D, 3; blank and repeated rows must be), and empty rows of user or assistant are inserted (I, 2); a truncated
row that isn't deleted adds 1. Of the cheapest edits the one with the least audit in ASCII order is taken.

The states of the grammar are nothing yet, after s, after u, after a. Rows of a conversation are cut into segments by turn
(SPAN turn numbers each), dealt to tasks by the hash of conversation and segment, and cut there into pieces of PIECE rows.
In a batch of pieces a recursive DuckDB query advances one row of all pieces with each recursion and keeps, for each state
that a piece may begin in and each that it may end in, the least cost with its least audit. Pieces of a conversation are
then put together in order, four states at a time, so even one that holds a third of all rows never lies in one task as rows;
rows meet in order only where they are read out, as a sorted stream of which one batch is held.

Audits of one state are compared as they grow: after the same rows none is the beginning of another, since each ends in the
letter of the last row, so the lesser one stays the lesser.

Defined results: null roles and texts are one space; rows sort by turn (null first), role and the digest of their text; a row
is repeated if an earlier one has its role and text, copies of one row too; a null conv_id is a conversation of its own; an
empty table gives no rows; further columns of any name are left out; rows of one turn number of one conversation lie in
one segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import to_batch, written

SPAN, PIECE = 256, 64
#: Rows that a task hands to DuckDB at once, at least.
BATCH = 50_000
#: What edits cost; the grammar by (state, initial); what an inserted row or a new role is in each state.
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEEDED = {NOTHING: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
#: Inserts that end a conversation in each state.
CLOSING = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
BLANK, OPEN_END = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"

WAYS = "array<struct<s:int,t:int,cost:long,audit:string>>"
COUNTED = ("blank", "duplicate", "truncated", "illegal", "turns")
PIECES = f"conv_id long, segment long, piece long, {', '.join(f'{c} long' for c in COUNTED)}, head string, tail string, low long, high long, ways {WAYS}"
PIECES_ARROW = pa.schema([*((c, pa.int64()) for c in ("conv_id", "segment", "piece", *COUNTED)), ("head", pa.string()), ("tail", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("ways", pa.list_(pa.struct([("s", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])
SEGMENTS = "array<struct<segment:long,state:int,audit:string>>"
PLAN = f"conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, segments {SEGMENTS}"
PLAN_ARROW = pa.schema([*((c, pa.int64()) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("segments", pa.list_(pa.struct([("segment", pa.int64()), ("state", pa.int32()), ("audit", pa.string())])))])
TURNS = "conv_id long, edit string, role string, text string"
TURNS_ARROW = pa.schema([("conv_id", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def moves() -> list[tuple[int, int, str | None, str, int, bool]]:
    """What one row allows: state before, state after, the initial it takes (null: any), letters, cost, and whether the row stays.
    Up to two rows are inserted before it; more lead to states that fewer reach."""
    out = []
    for state in NEEDED:
        at, letters = state, ""
        for _ in range(3):
            spent = INSERT * len(letters)
            out += [(state, to, c, letters + "K", spent, True) for (x, c), to in NEXT.items() if x == at]
            out.append((state, NEXT[at, NEEDED[at][0]], None, letters + "R", spent + REROLE, True))
            out.append((state, at, None, letters + "D", spent + DELETE, False))
            at, letters = NEXT[at, NEEDED[at][0]], letters + "I"
    return out


# `rows` holds whole segments. A row's place in its segment gives its piece and its place there.
PIECES_SQL = f"""
WITH RECURSIVE placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id, segment ORDER BY turn NULLS FIRST, role, digest) - 1 AS place FROM rows
), ordered AS MATERIALIZED (
  SELECT conv_id, segment, turn, initial, blank, truncated, place,
    late OR row_number() OVER (PARTITION BY conv_id, segment, turn, role, digest ORDER BY place) > 1 AS again,
    turn IS NOT NULL AND row_number() OVER (PARTITION BY conv_id, segment, turn ORDER BY place) = 1 AS new_turn
  FROM placed
), faults AS MATERIALIZED (
  SELECT conv_id, segment, turn, initial, new_turn, place // {PIECE} AS piece, place % {PIECE} AS k,
    dense_rank() OVER (ORDER BY conv_id, segment, place // {PIECE}) AS id,
    blank, again AND NOT blank AS duplicate, truncated AND NOT blank AND NOT again AS truncated,
    lag(initial) OVER (PARTITION BY conv_id, segment, place // {PIECE} ORDER BY place) AS before
  FROM ordered
), best(id, k, s, t, cost, audit) AS (
  SELECT DISTINCT id, 0::BIGINT, x, x, 0::BIGINT, '' FROM faults, range(4) AS states(x) WHERE k = 0
  UNION ALL
  SELECT id, k, s, t, cost, audit FROM (
    SELECT b.id, b.k + 1 AS k, b.s, m.after AS t, b.cost + m.cost + CASE WHEN f.truncated AND m.stays THEN {CUT_OFF} ELSE 0 END AS cost, b.audit || m.letters AS audit
    FROM best b JOIN faults f ON f.id = b.id AND f.k = b.k JOIN moves m ON m.state = b.t
    WHERE NOT m.stays OR (NOT f.blank AND NOT f.duplicate AND (m.initial IS NULL OR m.initial = f.initial))
  ) QUALIFY row_number() OVER (PARTITION BY id, s, t ORDER BY cost, audit) = 1
), counts AS (
  SELECT id, any_value(conv_id) AS conv_id, any_value(segment) AS segment, any_value(piece) AS piece, count(*) AS n,
    count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(truncated) AS truncated,
    count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count_if(new_turn) AS turns,
    first(initial ORDER BY k) AS head, last(initial ORDER BY k) AS tail, min(turn) AS low, max(turn) AS high
  FROM faults GROUP BY id
)
SELECT conv_id, segment, piece, {', '.join(f'any_value({c})::BIGINT AS {c}' for c in COUNTED)}, any_value(head) AS head, any_value(tail) AS tail,
  any_value(low) AS low, any_value(high) AS high, list({{'s': s::INTEGER, 't': t::INTEGER, 'cost': cost, 'audit': audit}} ORDER BY s, t) AS ways
FROM counts c JOIN best b ON b.id = c.id AND b.k = c.n GROUP BY c.id, conv_id, segment, piece
"""


def prepared(rows: DataFrame) -> DataFrame:
    """conv_id, segment, turn, role, digest, text of each row; nulls are one space."""
    held = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return held.select("conv_id", F.floor(F.col("turn") / SPAN).alias("segment"), "turn", "role", F.sha2("text", 256).alias("digest"), "text")


def faulty(rows: DataFrame) -> DataFrame:
    """prepared() rows without their texts, with what is wrong with each by itself, and whether an earlier turn says the same.
    Only digests are grouped, and only those that come again are joined."""
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    marked = rows.select("conv_id", "segment", "turn", "role", "digest", F.substr("role", F.lit(1), F.lit(1)).alias("initial"), (~F.col("text").rlike(BLANK)).alias("blank"), (~F.col("text").rlike(OPEN_END)).alias("truncated"), order.alias("order"))
    again = rows.groupBy("conv_id", "role", "digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    of = again.select(F.col("conv_id").alias("of_conv"), F.col("role").alias("of_role"), F.col("digest").alias("of_digest"), "first")
    met = marked.join(of, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("role") == F.col("of_role")) & (F.col("digest") == F.col("of_digest")), "left")
    return met.select("conv_id", "segment", "turn", "role", "digest", "initial", "blank", "truncated", F.coalesce(F.col("order") > F.col("first"), F.lit(False)).alias("late"))


def groups(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Tables of at least so many rows (but the last) that end where a segment does; rows come by conversation and segment."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < least:
            continue
        table = pa.Table.from_batches(held)
        conv, segment = table.column("conv_id"), table.column("segment")
        last, end = (conv[-1].as_py(), segment[-1].as_py()), table.num_rows
        lo, hi = 0, end
        # The first row of the last segment: rows are sorted, so a binary search finds it.
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if (conv[mid].as_py(), segment[mid].as_py()) == last else (mid + 1, hi)
        if lo:
            yield table.slice(0, lo)
            held = table.slice(lo).combine_chunks().to_batches()
            count = end - lo
    if held:
        yield pa.Table.from_batches(held)


def pieces(rows: DataFrame) -> DataFrame:
    """PIECES of faulty() rows: counts, and the best edits between any two states, of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        con.execute("CREATE TABLE moves (state INTEGER, after INTEGER, initial VARCHAR, letters VARCHAR, cost BIGINT, stays BOOLEAN)")
        con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?, ?)", moves())
        for table in groups(batches, BATCH):
            con.register("rows", table)
            yield from con.sql(PIECES_SQL).to_arrow_table().cast(PIECES_ARROW).to_batches(10_000)
            con.unregister("rows")
        con.close()

    return rows.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment").mapInArrow(run, PIECES)


class Plan:
    """The pieces of one conversation put together in order. A path is (path before, segment, state before, audit)."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.tail, self.low, self.high = conv_id, None, None, None
        self.counts = dict.fromkeys(COUNTED, 0)
        # state: cost, rank among the states' audits, path
        self.best: dict[int, tuple[int, int, tuple | None]] = {NOTHING: (0, 0, None)}

    def add(self, x: dict) -> None:
        for c in COUNTED:
            self.counts[c] += x[c]
        if self.tail is not None and self.tail + x["head"] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.tail = x["tail"]
        if x["low"] is not None:
            self.low = x["low"] if self.low is None else min(self.low, x["low"])
            self.high = x["high"] if self.high is None else max(self.high, x["high"])
        found: dict[int, tuple[int, int, str, int]] = {}
        for way in x["ways"]:
            if way["s"] in self.best:
                cost, rank, _ = self.best[way["s"]]
                key = (cost + way["cost"], rank, way["audit"], way["s"])
                if way["t"] not in found or key < found[way["t"]]:
                    found[way["t"]] = key
        order = {t: i for i, t in enumerate(sorted(found, key=lambda t: found[t][1:3]))}
        self.best = {t: (cost, order[t], (self.best[s][2], x["segment"], s, audit)) for t, (cost, _, audit, s) in found.items()}

    def row(self) -> tuple:
        end = min(self.best, key=lambda t: (self.best[t][0] + INSERT * len(CLOSING[t]), self.best[t][1], CLOSING[t]))
        cost, _, path = self.best[end]
        parts = [CLOSING[end]]
        segments: list[list] = []
        while path:
            path, segment, state, audit = path
            if segments and segments[-1][0] == segment:
                segments[-1][1] = state
                segments[-1][2].append(audit)
            else:
                segments.append([segment, state, [*parts, audit]])
                parts = []
        segments.reverse()
        done = [{"segment": s, "state": x, "audit": "".join(reversed(a))} for s, x, a in segments]
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.counts["turns"]
        return self.conv_id, gaps, *(self.counts[c] for c in COUNTED[:4]), cost + INSERT * len(CLOSING[end]), "".join(s["audit"] for s in done), done


def plans(found: DataFrame) -> DataFrame:
    """PLAN of each conversation of pieces()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for x in batch.to_pylist():
                if now is None or now.conv_id != x["conv_id"]:
                    if now is not None:
                        done.append(now.row())
                    now = Plan(x["conv_id"])
                now.add(x)
            if len(done) >= 1000:
                yield to_batch(done, PLAN_ARROW)
                done = []
        if now is not None:
            done.append(now.row())
        if done:
            yield to_batch(done, PLAN_ARROW)

    return found.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "piece").mapInArrow(run, PLAN)


def repair(rows: DataFrame) -> DataFrame:
    """PLAN of each conversation of (conv_id, turn, role, text): counts, gaps, cost, audit, and the audit by segment."""
    return plans(pieces(faulty(prepared(rows))))


class Writer:
    """Reads a segment's rows by its audit."""

    def __init__(self, state: int, audit: str) -> None:
        self.state, self.audit, self.at = state, audit, 0

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            role = NEEDED[self.state]
            self.state = NEXT[self.state, role[0]]
            yield "I", role, ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            role = NEEDED[self.state] if edit == "R" else role
            self.state = NEXT[self.state, role[0]]
            yield edit, role, text


def repaired(rows: DataFrame, planned: DataFrame, in_order: bool = False) -> DataFrame:
    """TURNS: the rows of repaired conversations with the edit that made each, by a sorted stream of audits and rows.

    Dealt by conversation and segment, or by conversation alone, then in the order of the conversations' turns."""
    audits = planned.select("conv_id", F.explode("segments").alias("of")).select("conv_id", "of.segment", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("text"), "of.state", "of.audit")
    texts = prepared(rows).select("conv_id", "segment", F.lit(1).alias("kind"), "turn", "role", "digest", "text", F.lit(None).cast("int").alias("state"), F.lit(None).cast("string").alias("audit"))
    keys = ["conv_id"] if in_order else ["conv_id", "segment"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, conv_id = None, None
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                if x["kind"] == 0:
                    if writer is not None:
                        out += [(conv_id, *y) for y in writer.inserted()]
                    writer, conv_id = Writer(x["state"], x["audit"]), x["conv_id"]
                else:
                    out += [(conv_id, *y) for y in writer.turn(x["role"], x["text"])]
            if out:
                yield to_batch(out, TURNS_ARROW)
        out = [(conv_id, *y) for y in writer.inserted()] if writer is not None else []
        if out:
            yield to_batch(out, TURNS_ARROW)

    dealt = audits.unionByName(texts).repartition(*keys).sortWithinPartitions("conv_id", "segment", "kind", "turn", "role", "digest")
    return dealt.select("conv_id", "kind", "role", "text", "state", "audit").mapInArrow(run, TURNS)


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of `role:text` lines of repaired(in_order=True), joined by newlines."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv_id, seen, done = False, None, None, []
        for batch in batches:
            for x in batch.to_pylist():
                if not begun or conv_id != x["conv_id"]:
                    if begun:
                        done.append((conv_id, seen.hexdigest()))
                    begun, conv_id, seen = True, x["conv_id"], hashlib.sha256()
                else:
                    seen.update(b"\n")
                seen.update(f"{x['role']}:{x['text']}".encode())
            if len(done) >= 1000:
                yield to_batch(done, schema)
                done = []
        if begun:
            done.append((conv_id, seen.hexdigest()))
        if done:
            yield to_batch(done, schema)

    return turns.mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text), some of which are dropped, emptied, cut off, repeated or given to the user, by a checksum."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    held = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), what.alias("what")).filter("what <> 0")
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("what") == 3, 2).otherwise(1)))
    return held.select("conv_id", "turn", F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("time")).drop("time")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged, then repaired."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    broken = damaged(rows)
    planned = written(repair(broken), "plans")
    shown = digests(repaired(broken, planned, in_order=True)).withColumnRenamed("conv_id", "of_shown")
    made = planned.drop("segments").withColumnRenamed("conv_id", "of_plan")
    ids = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    met = ids.join(made, F.col("conv_id").eqNullSafe(F.col("of_plan")), "left").join(shown, F.col("conv_id").eqNullSafe(F.col("of_shown")), "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    nothing: Column = F.lit(hashlib.sha256(b"").hexdigest())
    return met.select("conv_id", *(count(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


# The checksum of a short ASCII text, bit by bit; edits by (letter, state before, state after, cost, inserted role).
OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id FROM conversations
), hashed AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(id) + 1), lambda i: ascii(substr(id, i, 1))::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))) % 20 AS what FROM crc
), hurt AS (
  SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
    CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN what = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE what <> 0
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS shown FROM hurt
), row_ AS MATERIALIZED (
  SELECT conv_id, turn, role, text, k, n, role[1] AS initial, shown = '' AS blank,
    shown <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
    shown <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) = 1 AND shown[-1] NOT IN ('.', '!', '?') AS cut,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY k) AS before
  FROM placed
), ins(state, letters, to_state, said, cost) AS (
  VALUES (0, '', 0, []::VARCHAR[], 0), (1, '', 1, [], 0), (2, '', 2, [], 0), (3, '', 3, [], 0),
    (0, 'I', 2, ['user:'], 2), (1, 'I', 2, ['user:'], 2), (2, 'I', 3, ['assistant:'], 2), (3, 'I', 2, ['user:'], 2),
    (0, 'II', 3, ['user:', 'assistant:'], 4), (1, 'II', 3, ['user:', 'assistant:'], 4), (2, 'II', 2, ['assistant:', 'user:'], 4), (3, 'II', 3, ['user:', 'assistant:'], 4)
), grammar(state, initial, to_state) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), best(conv_id, k, state, cost, audit, said) AS (
  SELECT conv_id, 0::BIGINT, 0, 0::BIGINT, '', []::VARCHAR[] FROM row_ WHERE k = 0
  UNION ALL
  SELECT conv_id, k, state, cost, audit, said FROM (
    SELECT b.conv_id, b.k + 1 AS k, g.to_state AS state, b.cost + i.cost + CASE WHEN r.cut THEN 1 ELSE 0 END + e.cost AS cost, b.audit || i.letters || e.edit AS audit,
      list_concat(b.said, i.said, [CASE WHEN e.edit = 'K' THEN r.role WHEN g.initial = 'a' THEN 'assistant' ELSE 'user' END || ':' || r.text]) AS said
    FROM best b JOIN row_ r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.k = b.k JOIN ins i ON i.state = b.state JOIN grammar g ON g.state = i.to_state
      JOIN (VALUES ('K', 0), ('R', 2)) e(edit, cost) ON (e.edit = 'K' AND r.initial = g.initial) OR (e.edit = 'R' AND g.initial <> 's')
    WHERE NOT r.blank AND NOT r.again
    UNION ALL
    SELECT b.conv_id, b.k + 1, i.to_state, b.cost + i.cost + 3, b.audit || i.letters || 'D', list_concat(b.said, i.said)
    FROM best b JOIN row_ r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.k = b.k JOIN ins i ON i.state = b.state
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1
), count_ AS (
  SELECT conv_id, max(n) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(again) AS duplicate, count_if(cut) AS truncated,
    count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM row_ GROUP BY conv_id
), ended AS (
  SELECT b.conv_id, b.cost + i.cost AS cost, b.audit || i.letters AS audit, list_concat(b.said, i.said) AS said
  FROM best b JOIN count_ c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.k JOIN ins i ON i.state = b.state
  WHERE (b.state = 0 AND i.letters = '') OR i.to_state = 3
  QUALIFY row_number() OVER (PARTITION BY b.conv_id ORDER BY b.cost + i.cost, b.audit || i.letters) = 1
)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN count_ c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""
