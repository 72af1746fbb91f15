"""Admission on a stream against the same events in one batch; late rows, and state that ends."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rowsense.streaming import limits

ROWS = "event_id long, user_id long, ts timestamp, cost long"
START = dt.datetime(2024, 1, 1, 6, 0)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def replay(spark, batches, folder, **limit):
    """Each batch is a file, read one at a time; outcomes by event, the user's rows of state at the end."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"{folder}/in/{i:03d}")
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    query = limits.admit_stream(stream, **limit).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination(600)
    assert query.exception() is None
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    dropped = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress if p["stateOperators"])
    return {r["event_id"]: r["outcome"] for r in spark.read.parquet(f"{folder}/out").collect()}, states, dropped


def test_stream_equals_batch(rocks, tmp_path):
    rng = random.Random(1)
    events = [(i, rng.randrange(4), START + dt.timedelta(seconds=i * 20 + rng.randrange(30), microseconds=rng.randrange(10**6)), rng.randint(1, 5)) for i in range(160)]
    # Out of order within what the watermark allows; the last event lets all others pass.
    order = sorted(events, key=lambda e: e[2] + dt.timedelta(seconds=rng.randrange(240)))
    end = [(10_000, 99, START + dt.timedelta(days=3), 1)]
    batches = [order[i : i + 40] for i in range(0, len(order), 40)] + [end, [(10_001, 98, START + dt.timedelta(days=6), 1)]]
    limit = {"burst": 2, "seconds": 300, "daily": 60}
    got, states, dropped = replay(rocks, batches, str(tmp_path), late="10 minutes", **limit)
    batch = limits.admit(rocks.createDataFrame(events, ROWS), F.col("cost"), **limit)
    expected = {r["event_id"]: r["outcome"] for r in batch.collect()}
    assert {i: o for i, o in got.items() if i < 10_000} == expected and set(expected.values()) == {"admitted", "burst", "daily"}
    assert dropped == 0
    # Days later nothing of the first users is left.
    assert states[-1] < max(states)


def test_late_rows_are_dropped_and_users_without_events_forgotten(rocks, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    batches = [[(1, 7, at(0), 1), (2, None, at(0), 1)], [(3, 8, at(60), 1)], [(4, 7, at(1), 1), (5, 7, at(61), 1)], [(6, 9, at(3000), 1), (8, 7, at(2), 1)], [(7, 9, at(6000), 1)]]
    got, _, dropped = replay(rocks, batches, str(tmp_path), late="1 minute", burst=1, seconds=60, daily=9)
    # Event 4 comes before the watermark that passes it is in force; event 8 comes behind it.
    assert got == {1: "admitted", 4: "admitted", 3: "admitted", 5: "admitted", 6: "admitted"} and dropped == 1
