"""A training corpus from documents: without toxic texts, without near copies, without secrets, mixed, packed.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps with the columns of documents; the last one
gives the packed pieces. run() writes each stage's rows as Parquet in the shared folder and reads them for the next.

Defined results: null and blank texts are kept up to the mix, which takes words and so leaves them out; rows are copies by their texts
alone, whether ids are null or come again; an empty table gives no pieces; further columns of documents are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsense.llm.common import release, written
from rowsense.llm.jaccard_join import least_rows, mark_of
from rowsense.llm.mixing import mixed_texts
from rowsense.llm.packing import pack
from rowsense.llm.secret_scan import secret_scan
from rowsense.llm.toxicity import toxicity

#: From this score on a document is rejected as toxic.
TOXIC = 0.5


def rest_of(docs: DataFrame) -> Column:
    """All columns but the text in one, so that a stage's own names can't clash with them."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("doc")


def as_documents(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """docs' columns again from doc and text, some of them new."""
    return rows.select(*(F.col("text") if c == "text" else new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below TOXIC, by a model of these documents and the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held = docs.select("doc_id", "text", rest_of(docs))
    return as_documents(toxicity(held, labels).filter(F.col("score") < TOXIC), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each component of texts; documents without words are nobody's copies."""
    keep = written(least_rows(docs.select("doc_id", "text")), "kept")
    rows = docs.select(rest_of(docs), F.col("doc_id").cast("long").alias("doc_id"), "text", mark_of("text").alias("mark"))
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    of = keep.select(F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark"), "rows")
    kept = rows.filter(worded).join(of, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of_mark")))
    out = as_documents(rows.filter(~worded).unionByName(kept.filter("rows = 1").select(*rows.columns)), docs)
    if keep.filter("rows > 1").isEmpty():
        return out
    # Only rows of one id and one text are repeats.
    return out.unionByName(as_documents(kept.filter("rows > 1").dropDuplicates(["doc_id", "mark"]), docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's span is replaced by its kind in brackets."""
    body = F.coalesce(F.col("text"), F.lit(""))
    hits = secret_scan(docs.select("doc_id", "text")).filter(F.size("findings") > 0).groupBy("blob").agg(F.min("findings").alias("findings"))
    rows = docs.select(rest_of(docs), "text", F.sha2(body, 256).alias("blob")).join(hits, "blob", "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    # Spans come by start; one that begins within another adds what reaches beyond it.
    step = lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.substr("text", a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), F.lit("["), s["rule"], F.lit("]")).alias("out")))
    done = F.aggregate("findings", start, step)
    text = F.when(F.col("findings").isNull(), F.col("text")).otherwise(F.concat(done["out"], F.substr("text", done["at"] + 1)))
    return as_documents(rows.withColumn("text", text), docs, n_chars=n_chars())


def n_chars() -> Column:
    return F.char_length(F.coalesce("text", F.lit(""))).cast("long")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, in the order of shards: a row per pass that takes it. A document that the
    mix takes up to a word ends there."""
    mixed = mixed_texts(docs.select("doc_id", "source", "text", rest_of(docs)))
    return as_documents(mixed, docs, n_chars=n_chars())


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids."""
    return pack(docs.select("doc_id", "text"), str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("toxicity", drop_toxic), ("jaccard_join", drop_near_copies), ("secret_scan", redact_secrets), ("mixing", mix_sources), ("packing", pack_windows)]
#: No SQL can train the model of the first stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if i:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
