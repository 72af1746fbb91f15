"""Secret scans by an incremental blob ledger.

Every version of every path is content-addressed by the SHA-256 of its text. A ledger table holds one row per
(blob, rule, rule version) that has been scanned, with the spans found, also when there are none. A run scans only
the pairs that the ledger lacks, appends them, and joins the findings back to all paths that hold the blob.

Defined results: null text is the empty text (no findings); equal rows each get their own output row; a null path
stays null; other columns of the input don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_chunks, shared_dir, whole

#: Rule, version, pattern, the group whose length counts, the least length. In the order of kinds.
RULES = (
    ("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", 1, r"[0-9a-f]+", 0, 32),
)
#: One of these is in every text with an assignment.
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
HEX_RUN = b"\x01" * 32
TO_HEX = bytes(1 if c in b"0123456789abcdef" else 0 for c in range(256))
LEDGER = "blob string, rule string, version int, spans array<struct<start:int,end:int>>"


def spans_of(text: str, rule: str, pattern: re.Pattern, group: int, least: int) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches in code points; those too short are dropped, but have used up their text."""
    if rule == "access" and "AKIA" not in text:
        return []
    if rule == "assign":
        low = text.lower()
        if not any(w in low for w in WORDS):
            return []
    if rule == "hex":
        if HEX_RUN not in text.encode("latin-1", "replace").translate(TO_HEX):
            return []
        # A match takes a maximal run, so asking for the length in the pattern finds the same ones.
        return [m.span() for m in re.finditer(r"[0-9a-f]{%d,}" % least, text)]
    return [m.span() for m in pattern.finditer(text) if len(m[group]) >= least]


def addressed(versions: DataFrame, path: str, text: str) -> DataFrame:
    body = whole(text)
    return versions.select(F.col(path).alias("path"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path_key"), body.alias("body"), F.sha2(body, 256).alias("blob"))


def scan_unseen(versions: DataFrame, ledger: str, path: str, text: str, rules: Iterable[tuple] = RULES) -> None:
    """Scans blob and rule-version pairs that the ledger (a Parquet path) lacks, and appends them to it."""
    spark, rules = versions.sparkSession, tuple(rules)
    rows = addressed(versions, path, text)
    pairs = F.explode(F.array(*(F.struct(F.lit(r[0]).alias("rule"), F.lit(r[1]).alias("version")) for r in rules)))
    # One path of each blob brings its text; copies don't travel.
    blobs = rows.groupBy("blob").agg(F.min("path_key").alias("path_key"))
    known = read_ledger(spark, ledger)
    if known is None:
        todo = blobs.withColumn("rules", F.lit([r[0] for r in rules]))
    else:
        seen = known.select("blob", "rule", "version").distinct()
        todo = blobs.select("blob", "path_key", pairs.alias("p")).select("blob", "path_key", "p.*").join(seen, ["blob", "rule", "version"], "left_anti").groupBy("blob", "path_key").agg(F.collect_set("rule").alias("rules"))
    compiled = {r[0]: (r[1], re.compile(r[2], re.ASCII), r[3], r[4]) for r in rules}

    def scan(got: list[dict]) -> Iterable[tuple]:
        for x in got:
            for rule in x["rules"]:
                version, pattern, group, least = compiled[rule]
                found = spans_of(x["body"], rule, pattern, group, least)
                yield x["blob"], rule, version, [{"start": a, "end": b} for a, b in found]

    schema = pa.schema([("blob", pa.string()), ("rule", pa.string()), ("version", pa.int32()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
    texts = rows.select("blob", "path_key", "body").join(todo, ["blob", "path_key"])
    texts.mapInArrow(by_chunks(scan, schema), LEDGER).write.mode("append").option("compression", "zstd").parquet(ledger)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The ledger, or None if nothing has been written yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(LEDGER).parquet(ledger)


def secret_scan(versions: DataFrame, ledger: str | None = None, path: str = "doc_id", text: str = "text", rules: Iterable[tuple] = RULES) -> DataFrame:
    """A row per input row: path, blob, findings array<struct<start, kind, rule, end>> by start, then kind."""
    rules = tuple(rules)
    ledger = ledger or f"{shared_dir(versions.sparkSession)}/ledger"
    scan_unseen(versions, ledger, path, text, rules)
    kinds = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r[0], i)))
    current = F.lit(False)
    for r in rules:
        current |= (F.col("rule") == r[0]) & (F.col("version") == r[1])
    # Of a pair, repeated rows may have put equal lines into the ledger; a set keeps one. At most one line a rule.
    hits = (
        read_ledger(versions.sparkSession, ledger)
        .filter(current & (F.size("spans") > 0))
        .groupBy("blob")
        .agg(F.collect_set(F.struct(kinds[F.col("rule")].alias("kind"), F.col("rule"), F.col("spans"))).alias("lines"))
        .select("blob", F.array_sort(F.flatten(F.transform("lines", lambda x: F.transform(x["spans"], lambda s: F.struct(s["start"].alias("start"), x["kind"].alias("kind"), x["rule"].alias("rule"), s["end"].alias("end")))))).alias("findings"))
    )
    rows = addressed(versions, path, text).select("path", "blob")
    none = F.expr("cast(array() as array<struct<start:int,kind:int,rule:string,end:int>>)")
    return rows.join(hits, "blob", "left").select("path", "blob", F.coalesce("findings", none).alias("findings"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents against a new ledger."""
    found = secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spans = F.array_join(F.transform("findings", lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("findings", lambda s: s["rule"] == kind)).cast("long").alias(f"n_{kind}")
    return found.withColumn("spans", spans).select(F.col("path").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2("spans", 256).alias("base_sha256"), "spans")
