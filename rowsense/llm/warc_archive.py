"""WARC archives, index first.

Tasks write their rows as gzip members, one per record, to archive files in a shared folder, and return an index row
per record: file, offset, length, URL and digest. The index is a table that Spark commits, so it names only the files
of tasks that succeeded; a lost or repeated task leaves a file that no index row names. Reading goes from the index:
the chosen rows are dealt by stretch of a file, sorted by offset, and near byte ranges are read at once.

Of records with equal payloads of at least `least` bytes, the one with the largest id is the response and the others
are revisits without payload. The rule needs digests only, so pages aren't shuffled: digests that occur twice or more
make a table, which joins the pages by digest in the way its size allows.

Defined results: null html is the empty payload; rows with equal payload and equal largest id are all responses; a null
id is below all others, and where all ids of a payload are null its rows are responses; a null URL is written empty.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, to_batch, whole, written

INDEX = "file string, offset long, length long, url string, digest string, record_type string, page_id long"
INDEX_ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64())])
#: Bytes after which a new archive file begins; bytes between two records up to which their ranges are read at once; most bytes of one read.
ARCHIVE_BYTES, GAP_BYTES, READ_BYTES = 256 << 20, 64 << 10, 8 << 20
DATE = "2026-01-01T00:00:00Z"


def base32_sha1(body: Column) -> Column:
    """Upper-case base32 of SHA-1: five hex digits are four base-32 digits."""
    digits = F.upper(F.sha1(body))
    parts = [F.lpad(F.conv(F.substr(digits, F.lit(i), F.lit(5)), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, digest, bytes, keeper (the response's id where the row is a revisit, else null)."""
    body = whole("html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("html"), base32_sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))
    thin = rows.filter(F.col("bytes") >= least)
    twice = written(thin.groupBy("digest", "bytes").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "copies")
    joined = rows.join(twice, ["digest", "bytes"], "left")
    keeper = F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return joined.select("page_id", "url", "html", "digest", "bytes", keeper.alias("keeper"))


def record(page_id: int | None, url: str | None, html: str, digest: str, keeper: int | None) -> bytes:
    """One WARC/1.1 record. A revisit names its response and tells the payload's length, as it has none itself."""
    payload = html.encode()
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if keeper is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {clean}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if keeper is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{keeper}>"]
    block = b"" if keeper is not None else payload
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut or has bytes left over")
    return fields, rest[:n]


def write_archives(pages: DataFrame, folder: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives below folder and gives their index, a committed table. No row is shuffled for it."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        task, out, at, file = TaskContext.get(), None, 0, ""
        try:
            for batch in batches:
                for i in range(0, batch.num_rows, 200):
                    lines = []
                    for x in batch.slice(i, 200).to_pylist():
                        if out is None or at >= archive_bytes:
                            if out is not None:
                                out.close()
                            file = f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:12]}.warc.gz"
                            out, at = fs.open_output_stream(f"{base}/{file}", compression=None), 0
                        member = gzip.compress(record(x["page_id"], x["url"], x["html"], x["digest"], x["keeper"]), compresslevel=4, mtime=0)
                        out.write(member)
                        lines.append((file, at, len(member), x["url"], x["digest"], "response" if x["keeper"] is None else "revisit", x["page_id"]))
                        at += len(member)
                    if lines:
                        yield to_batch(lines, INDEX_ARROW)
        finally:
            if out is not None:
                out.close()

    return written(with_roles(pages, least).mapInArrow(write, INDEX), "index")


RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORDS_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def ranges(rows: list[dict]) -> Iterator[list[dict]]:
    """Rows sorted by file and offset, in runs that one read takes."""
    run: list[dict] = []
    for x in rows:
        if run and (x["file"] != run[-1]["file"] or x["offset"] - run[-1]["offset"] - run[-1]["length"] > GAP_BYTES or x["offset"] + x["length"] - run[0]["offset"] > READ_BYTES):
            yield run
            run = []
        run.append(x)
    if run:
        yield run


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the index rows, each checked against its digest and, where the index has it, its id."""

    def number(urn: str) -> int | None:
        return int(urn[len("<urn:page:") : -1]) if len(urn) > len("<urn:page:>") else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        opened, name = None, None
        for batch in batches:
            for run in ranges(batch.to_pylist()):
                if run[0]["file"] != name:
                    opened, name = fs.open_input_file(f"{base}/{run[0]['file']}"), run[0]["file"]
                first, last = run[0]["offset"], run[-1]["offset"] + run[-1]["length"]
                got, lines = memoryview(opened.read_at(last - first, first)), []
                for x in run:
                    member = got[x["offset"] - first : x["offset"] - first + x["length"]]
                    head, body = parse_record(zlib.decompress(member, wbits=31))
                    digest, size, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"]), head["WARC-Type"]
                    if kind == "response" and (len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest) or digest != x["digest"]:
                        raise ValueError(f"{name} at {x['offset']}: payload and digest differ")
                    refers = number(head["WARC-Refers-To"]) if kind == "revisit" else None
                    lines.append((number(head["WARC-Record-ID"]), head["WARC-Target-URI"], body if payloads else None, size, digest, kind, refers))
                yield to_batch(lines, RECORDS_ARROW)

    stretch = F.floor(F.col("offset") / READ_BYTES)
    return index.repartition("file", stretch).sortWithinPartitions("file", "offset").mapInArrow(read, RECORDS)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written and read back."""
    folder = f"{shared_dir(spark)}/warc"
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), folder)
    return read_records(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS last,
    array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::INT >> (5 * (3 - i % 4)::INT)) & 31)::INT, 1)), '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""
