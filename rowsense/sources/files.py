"""Strict and lenient reads of files, and their sinks. Strict reads fail rather than repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The first line's names, without a byte order mark; an error where there is none or a name stands twice."""
    first = spark.read.option("header", False).option("multiLine", True).csv(path).first()
    if first is None or first[0] is None:
        raise ValueError("the CSV has no header")
    names = [str(x or "").lstrip("\ufeff").strip() for x in first]
    twice = {n for n in names if names.count(n) > 1}
    if twice or "" in names:
        raise ValueError(f"columns stand twice or have no name: {sorted(twice)}")
    return names


def read_csv_strict(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Quoted CSV with a header; ragged rows and unended quotes are errors when rows are read."""
    names = header_of(spark, path)
    schema = schema or StructType.fromDDL(", ".join(f"`{n}` string" for n in names))
    if [f.name for f in schema] != names:
        raise ValueError(f"the header is {names}, not {[f.name for f in schema]}")
    return spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", enforceSchema=False).csv(path)


def read_csv_items(spark: SparkSession, path: str, column: str, items: str) -> DataFrame:
    """Lenient: rows whose column holds a JSON array of the type items, which isn't empty; others are left out."""
    rows = spark.read.options(header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE").csv(path)
    return rows.withColumn(column, F.from_json(column, items, {"mode": "PERMISSIVE"})).filter(F.col(column).isNotNull() & (F.size(column) > 0))


def read_json_strict(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).options(multiLine=True, mode="FAILFAST").json(path)


def read_images(spark: SparkSession, folder: str, most_bytes: int = 4 << 20) -> tuple[DataFrame, DataFrame]:
    """Accepted images and rejects with their reason."""
    rows = spark.read.format("binaryFile").load(folder)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    reason = F.when(~kind.isin("jpg", "jpeg", "png", "webp", "gif"), "type").when(F.col("length") > most_bytes, "size").when(F.col("length") == 0, "empty")
    marked = rows.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null").select("path", "length", "reason")


def must_have_rows(df: DataFrame, what: str) -> DataFrame:
    """df, or an error where it has no rows: an empty extract is a failure, not a result."""
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def write_csv(df: DataFrame, path: str) -> None:
    """Header, and quotes where a value needs them."""
    df.write.options(header=True, quote='"', escape='"', emptyValue="").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)
