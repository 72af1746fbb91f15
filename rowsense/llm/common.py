"""What the operators share: the folder all executors see, written tables, and Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, with its scheme, so that Spark and pyarrow look for it in one file system.

    Where that is unset, a session on one machine takes its warehouse; a cluster must name a folder that all its machines share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    uri = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toUri()
    return f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getPath().rstrip('/')}/rowsense/{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: lineage ends here, and its size is known to the planner."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for df in tables:
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
            if "/rowsense/" in file:
                path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path.getParent(), True)


_kept: tuple[str, object] | None = None


def hold(stage: str, make: Callable[[], object] = lambda: None) -> object:
    """What a stage holds in a worker between its tasks. Workers are used again, so the next stage that asks drops it."""
    global _kept
    if _kept is None or _kept[0] != stage:
        _kept = None
        _kept = (stage, make())
    return _kept[1]


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: the worker, which waits for further stages beside others, gives back what Arrow took for the task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return task


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64-bit numbers, each bit of which depends on all of x's."""
    with np.errstate(over="ignore"):
        h = (x.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def by_chunks(make: Callable[[list[dict]], Iterable[tuple]], schema: pa.Schema, rows: int = 256) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: make() turns at most so many rows (dicts) into tuples of the schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                got = list(make(batch.slice(at, rows).to_pylist()))
                if got:
                    yield to_batch(got, schema)

    return run


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def whole(column: str) -> F.Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))
