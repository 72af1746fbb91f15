"""Packets of rows for reviewers: CSV files with a manifest that says who reviews, and what each file holds.

A Spark data source. Writing, each task writes one file and tells its digest; only when all tasks have ended is the manifest
written, and a packet without a manifest isn't one: a task that fails leaves nothing that can be read. Writing over a packet
makes a new one, with a new id. Reading, each file is a partition, and is refused if its digest isn't the manifest's; a packet
whose reviewer isn't named is refused too, unless it is asked for as a blank one.

Reviewers fill packets in with programs that change files, so sealed() gives a packet its digests anew once it is filled in.

    spark.dataSource.register(Packets)
    rows.write.format("packet").mode("append").option("path", uri).save()
    sealed(uri, name="...", contact="...")
    spark.read.format("packet").schema("id string, bo string").load(uri)

Defined results: nulls are empty fields, and empty fields null; columns are read by name, a column of the schema that a file lacks
is an error, further ones are left out; a byte order mark is skipped; an empty packet has a manifest and no rows."""

from __future__ import annotations

import csv
import datetime
import hashlib
import io
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StringType, StructField, StructType

MANIFEST = "manifest.json"


def at(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{posixpath.abspath(uri)}")


def read_file(uri: str, file: str) -> bytes:
    fs, base = at(uri)
    with fs.open_input_stream(f"{base}/{file}", compression=None) as f:
        return f.read()


def write_file(uri: str, file: str, data: bytes) -> None:
    fs, base = at(uri)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/{file}", compression=None) as f:
        f.write(data)


def delete_files(uri: str, files: list[str]) -> None:
    fs, base = at(uri)
    for file in files:
        if fs.get_file_info(f"{base}/{file}").type == pyarrow.fs.FileType.File:
            fs.delete_file(f"{base}/{file}")


def manifest_of(uri: str) -> dict:
    try:
        return json.loads(read_file(uri, MANIFEST))
    except FileNotFoundError:
        raise FileNotFoundError(f"{MANIFEST} is missing from {uri}. Every packet must carry the manifest that identifies its reviewer. Nothing was imported.") from None


def sealed(uri: str, name: str, contact: str, date: str | None = None) -> dict:
    """The manifest of a packet that its reviewer has filled in: their name, and its files' digests as they are now."""
    held = manifest_of(uri)
    files = [{"file": f["file"], "sha256": hashlib.sha256(read_file(uri, f["file"])).hexdigest()} for f in held["files"]]
    held |= {"reviewer_name": name.strip(), "reviewer_contact": contact.strip(), "review_date": date or datetime.date.today().isoformat(), "files": files}
    write_file(uri, MANIFEST, json.dumps(held, ensure_ascii=False, indent=1).encode())
    return held


@dataclass
class PacketFile(InputPartition):
    file: str
    sha256: str

    def __init__(self, file: str, sha256: str) -> None:
        super().__init__((file, sha256))
        self.file, self.sha256 = file, sha256


class PacketReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.uri, self.names, self.blank = options["path"], schema.names, options.get("blank", "false").lower() == "true"

    def partitions(self) -> list[PacketFile]:
        held = manifest_of(self.uri)
        if not held.get("packet_id"):
            raise ValueError(f"{MANIFEST} has an empty packet id. Nothing was imported.")
        if not self.blank and not (held.get("reviewer_name") and held.get("reviewer_contact")):
            raise ValueError(f"{MANIFEST} in {self.uri} is missing the reviewer's name or contact. An anonymous packet cannot evidence a second opinion. Nothing was imported.")
        return [PacketFile(f["file"], f["sha256"]) for f in held["files"]] or [PacketFile("", "")]

    def read(self, partition: PacketFile) -> Iterator[tuple]:
        if not partition.file:
            return
        raw = read_file(self.uri, partition.file)
        if hashlib.sha256(raw).hexdigest() != partition.sha256:
            raise ValueError(f"{partition.file} has changed since its manifest was written. Nothing was imported.")
        rows = csv.DictReader(io.StringIO(raw.decode("utf-8-sig"), newline=""), strict=True)
        missing = [n for n in self.names if n not in (rows.fieldnames or ())]
        if missing:
            raise ValueError(f"{partition.file} is missing required columns: {', '.join(missing)}.")
        for row in rows:
            if None in row or None in row.values():
                raise ValueError(f"{partition.file}: a row has another number of fields than the header.")
            yield tuple(row[n] or None for n in self.names)


@dataclass
class Written(WriterCommitMessage):
    file: str
    sha256: str


class PacketWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        self.uri, self.names, self.overwrite, self.packet = options["path"], schema.names, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        text = io.StringIO(newline="")
        out = csv.writer(text, lineterminator="\n")
        out.writerow(self.names)
        for row in rows:
            out.writerow(["" if v is None else str(v) for v in row])
        raw = text.getvalue().encode()
        # A task that is tried again writes another file; only what commit() hears of belongs to the packet.
        file = f"{self.packet}-{uuid.uuid4().hex}.csv"
        write_file(self.uri, file, raw)
        return Written(file, hashlib.sha256(raw).hexdigest())

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        old = []
        try:
            old = [f["file"] for f in manifest_of(self.uri)["files"]]
        except FileNotFoundError:
            pass
        if old and not self.overwrite:
            delete_files(self.uri, [m.file for m in done])
            raise FileExistsError(f"{self.uri} holds a packet already; overwrite it to make a new one.")
        held = {"packet_id": self.packet, "reviewer_name": "", "reviewer_contact": "", "review_date": "", "files": [{"file": m.file, "sha256": m.sha256} for m in sorted(done, key=lambda m: m.file)]}
        write_file(self.uri, MANIFEST, json.dumps(held, indent=1).encode())
        delete_files(self.uri, old)

    def abort(self, messages: list[Written | None]) -> None:
        delete_files(self.uri, [m.file for m in messages if m is not None])


class Packets(DataSource):
    """Format "packet", see above. Options: path; blank (true: read a packet without a reviewer)."""

    @classmethod
    def name(cls) -> str:
        return "packet"

    def schema(self) -> StructType:
        """All columns of the first file, as texts."""
        held = manifest_of(self.options["path"])
        if not held["files"]:
            raise ValueError("an empty packet needs a schema")
        first = read_file(self.options["path"], held["files"][0]["file"]).decode("utf-8-sig")
        return StructType([StructField(n, StringType()) for n in next(csv.reader(io.StringIO(first, newline="")))])

    def reader(self, schema: StructType) -> PacketReader:
        return PacketReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> PacketWriter:
        return PacketWriter(self.options, schema, overwrite)
