"""Usage limits: sliding bursts, daily pools of cost, and admission, which depends on what was admitted before.

Counts are windows; admission is a stream of each user's events in order, in batch by sorted partitions and online by
Spark's state. Defined results: rows without user or time take no part in admission; ties in time go by event_id."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def burst_counts(events: DataFrame, seconds: int, by: tuple[str, ...] = ("user_id", "event_type")) -> DataFrame:
    """events with n_recent: events of the same key within so many seconds up to this one."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(*by).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("n_recent", F.count(F.lit(1)).over(w))


def daily_cost(events: DataFrame, cost: Column) -> DataFrame:
    """user_id, day, spent: one aggregation with partial sums."""
    return events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum(cost).alias("spent"))


def windowed_counts(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """Tumbling counts by type; on a stream with a watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def session_counts(events: DataFrame, gap: str) -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", gap)
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


class Admission:
    """One user's state: the times admitted within the window, and what the day has cost."""

    def __init__(self, burst: int, seconds: int, daily: int) -> None:
        self.burst, self.micros, self.daily = burst, seconds * 1_000_000, daily
        self.recent: deque[int] = deque()
        self.day, self.spent = -1, 0

    def ask(self, at: int, cost: int) -> str:
        while self.recent and self.recent[0] <= at - self.micros:
            self.recent.popleft()
        if at // 86_400_000_000 != self.day:
            self.day, self.spent = at // 86_400_000_000, 0
        if len(self.recent) >= self.burst:
            return "burst"
        if self.spent + cost > self.daily:
            return "daily"
        self.recent.append(at)
        self.spent += cost
        return "admitted"

    def ends(self) -> int:
        """From when on the state says nothing: the last admission has left the window, and the day is over."""
        return max(self.recent[-1] + self.micros if self.recent else 0, (self.day + 1) * 86_400_000_000)


def admit(events: DataFrame, cost: Column, burst: int = 3, seconds: int = 60, daily: int = 60) -> DataFrame:
    """event_id, user_id, outcome (admitted, burst, daily). Each user's events come in order as a sorted stream; a task
    holds one user's window."""
    schema = pa.schema([("event_id", pa.int64()), ("user_id", pa.int64()), ("outcome", pa.string())])
    rows = events.filter("user_id is not null and ts is not null").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), cost.cast("long").alias("cost"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, state = None, None
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                if state is None or x["user_id"] != user:
                    user, state = x["user_id"], Admission(burst, seconds, daily)
                out.append(state.ask(x["at"], x["cost"]))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("event_id"), batch.column("user_id"), pa.array(out)], schema=schema)

    return rows.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id").mapInArrow(run, "event_id long, user_id long, outcome string")


class Limiter(StatefulProcessor):
    """A user's admissions on a stream, in the order of time whatever the order of arrival.

    Events wait in a list until the watermark has passed them; a timer at the first of them takes those that it has passed, in
    order, and asks the limits. When none waits, the timer stands where the limits have nothing left to remember - the window
    behind the last admission, or the end of its day - and there the user's state goes."""

    def __init__(self, burst: int, seconds: int, daily: int) -> None:
        self.limits = burst, seconds, daily

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event_id long, at long, cost long")
        self.kept = handle.getValueState("kept", "recent array<long>, day long, spent long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        new = [(int(i), int(t), int(c)) for f in rows for i, t, c in zip(f.event_id, f.ts.astype("datetime64[us]").astype("int64"), f.cost, strict=True)]
        self.waiting.appendList(new)
        self.wake(min(at for _, at, _ in new))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((tuple(int(x) for x in r) for r in self.waiting.get()), key=lambda r: (r[1], r[0])) if self.waiting.exists() else []
        due, later = [r for r in held if r[1] <= passed], [r for r in held if r[1] > passed]
        state = self.read()
        outcomes = [state.ask(at, cost) for _, at, cost in due]
        ends = state.ends()
        if not later and ends <= passed:
            self.waiting.clear()
            self.kept.clear()
        else:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
            self.kept.update((list(state.recent), state.day, state.spent))
            self.wake(later[0][1] if later else ends)
        if due:
            yield pd.DataFrame({"event_id": [r[0] for r in due], "user_id": [int(key[0])] * len(due), "outcome": outcomes})

    def close(self) -> None:
        pass

    def read(self) -> Admission:
        state = Admission(*self.limits)
        if self.kept.exists():
            recent, state.day, state.spent = self.kept.get()
            state.recent = deque(int(x) for x in recent)
            state.day, state.spent = int(state.day), int(state.spent)
        return state

    def wake(self, at: int) -> None:
        """A timer in whole milliseconds, not before the given time."""
        self.handle.registerTimer(-(-at // 1000))


def admit_stream(events: DataFrame, burst: int = 3, seconds: int = 60, daily: int = 60, late: str = "10 minutes") -> DataFrame:
    """admit() on a stream (event_id, user_id, ts, cost): each event's outcome once the watermark has passed it.

    Rows later than `late` are dropped, as Spark does behind a watermark. Needs RocksDB as the store of state
    (spark.sql.streaming.stateStore.providerClass)."""
    rows = events.filter("user_id is not null and ts is not null").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("cost").cast("long").alias("cost"))
    timed = rows.withWatermark("ts", late).groupBy("user_id")
    return timed.transformWithStateInPandas(Limiter(burst, seconds, daily), "event_id long, user_id long, outcome string", "Append", "EventTime")
