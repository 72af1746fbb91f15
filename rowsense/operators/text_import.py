"""Planning an import of reviewed texts, and applying what a plan accepts.

Each reviewed row is skipped, refused with a reason, or written, by the first rule that holds: joins bring in the entry that a
row names, how often its id stands in the packet and in the corpus, and its spans of its file; the rules are one ordered
decision. A file's text never travels with a row: its entries' spans are cut from it once, and its edits applied in one pass.
Names that more than one id would have are refused last, over accepted and existing names: by counting a name's ids; only messages name them
all, so a plan's text grows with the square of a name's ids, and its rows alone (judge_import) don't. Edits are spans of a file: they
must not overlap and must find what they expect; they are applied from the end.

Defined results: a null or blank new text is skipped; rows are told apart by their place; spans count code points from 0, ends
exclusive; a file with a faulty edit isn't changed and says why."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import invariants, wellformed

EDIT = "struct<start:int,end:int,expected:string,replacement:string,id:string>"
SAID = "array<struct<check:string,message:string>>"
#: Ids of a name whose messages a task makes, about: a message names all others.
PART = 1024


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(rf"\A{wellformed.BLANK}*\z")


def cut(text: str, start: int | None, end: int | None) -> str | None:
    """The span of a text, as Spark's substr gives it."""
    if start is None or end is None:
        return None
    a = start if start >= 0 else 0 if start == -1 else len(text) + start + 1
    b = a + end - start
    return text[max(a, 0) : max(b, 0)] if b > a else ""


SPANS = ("start", "end", "current_start", "current_end")


def spans_of(entries: DataFrame, files: DataFrame) -> DataFrame:
    """_file, _start, _end, _current_start, _current_end of entries whose file has a content, and the texts there: _node, _current.
    A row holds one file with its spans."""
    schema = pa.schema([("_file", pa.string()), *((f"_{c}", pa.int64()) for c in SPANS), ("_node", pa.string()), ("_current", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file, content = batch.column("file")[i].as_py(), batch.column("content")[i].as_py()
                held = batch.column("spans")[i].values
                for at in range(0, len(held), 4096):
                    spans = list(zip(*(c.to_pylist() for c in held.slice(at, 4096).flatten()), strict=True))
                    texts = [(cut(content, a, b), cut(content, c, d)) for a, b, c, d in spans]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([file] * len(spans), *zip(*spans, strict=True), *zip(*texts, strict=True)), schema, strict=True)], schema=schema)

    of_file = entries.filter("file IS NOT NULL").groupBy("file").agg(F.collect_set(F.struct(*(F.col(c).cast("long").alias(c) for c in SPANS))).alias("spans"))
    ddl = "_file string, " + ", ".join(f"_{c} long" for c in SPANS) + ", _node string, _current string"
    return of_file.join(files.filter("content IS NOT NULL").select("file", "content"), "file").mapInArrow(run, ddl)


def judge_import(rows: DataFrame, entries: DataFrame, files: DataFrame, packets: dict[str, bool], vocabulary: tuple[str, ...] = invariants.UNITS) -> DataFrame:
    """place, id, packet, status, checks (what is wrong, without messages), and the file and edit of a written row, of tables as plan_import
    reads them. A row's size doesn't grow with how many ids share its name."""
    return _judged(rows, entries, files, packets, vocabulary)[0].select("place", "id", "packet", "status", "checks", "file", "edit")


def plan_import(rows: DataFrame, entries: DataFrame, files: DataFrame, packets: dict[str, bool], vocabulary: tuple[str, ...] = invariants.UNITS) -> DataFrame:
    """place, id, packet, status, diagnostics (array of check and message), and the edit of a written row.

    rows: place, packet, id, source_hash, key, zh, en, bo, extra (further columns that the reviewer saw, as a map);
    entries: id, file, start, end (the entry's span), source_hash, field, key, zh, en, extra, current (the text that the edit replaces,
    with its span current_start, current_end), replaceable (whether that is a fallback), wrap (a format for the new text), zh_literal,
    zh_holders, excluded, existing (a curated name, or null); files: file, content. packets: kind to whether its rows are names."""
    judged, names, both = _judged(rows, entries, files, packets, vocabulary)
    ids = names.groupBy(F.col("name").alias("_name")).agg(F.sort_array(F.collect_list("id")).alias("_ids"))
    # Rows meet the ids of their names last, so that no message is shuffled; a name of many ids is dealt to many tasks.
    parts = lambda shared: F.ceil(F.array_max(F.transform(shared, lambda x: x["n"])) / PART)
    alike = both.select(F.col("_shared").alias("_of")).distinct().withColumn("_each", F.explode("_of"))
    others = alike.join(ids, F.col("_each.name") == F.col("_name")).groupBy("_of").agg(F.sort_array(F.collect_list(F.struct("_name", "_ids"))).alias("_with"))
    others = others.withColumn("_to", F.explode(F.sequence(F.lit(0).cast("long"), parts(F.col("_of")) - 1)))
    at = F.when(F.col("_shared").isNull(), F.xxhash64("place")).otherwise(F.pmod(F.xxhash64("id"), parts(F.col("_shared"))))
    out = judged.withColumn("_part", at).join(others, (F.col("_shared") == F.col("_of")) & (F.col("_part") == F.col("_to")), "left")
    message = lambda x: F.concat(F.lit("Tibetan reference name collides with "), F.array_join(F.array_remove(x["_ids"], F.col("id")), ", "), F.lit("."))
    clash = F.transform("_with", lambda x: F.struct(F.lit("B12").alias("check"), message(x).alias("message")))
    return out.select("place", "id", "packet", "status", F.coalesce("_said", clash, F.array().cast(SAID)).alias("diagnostics"), "file", "edit")


def _judged(rows: DataFrame, entries: DataFrame, files: DataFrame, packets: dict[str, bool], vocabulary: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their status, checks and edit, what is said of a row but for its names (_said), and its names that others have too, with the
    number of their ids (_shared); the id and name of all that share a name; and such names by id."""
    full = rows.withColumn("_full", ~blank(F.col("bo")))
    of_id = full.filter("_full").groupBy("id").agg(F.count(F.lit(1)).alias("_times"))
    one = entries.groupBy("id").agg(F.count(F.lit(1)).alias("_matches"), F.any_value(F.struct(*(c for c in entries.columns if c != "id"))).alias("e"))
    cuts = spans_of(one.select("e.*"), files)
    same = [F.col("e.file") == F.col("_file"), *(F.col(f"e.{c}").cast("long").eqNullSafe(F.col(f"_{c}")) for c in SPANS)]
    placed = one.join(cuts, same, "left").withColumn("_content", F.col("_file").isNotNull()).drop("_file", *(f"_{c}" for c in SPANS))
    met = full.join(of_id, "id", "left").join(placed, "id", "left")
    e = lambda c: F.col("e").getField(c)
    is_name = F.coalesce(*(F.when(F.col("packet") == k, F.lit(v)) for k, v in packets.items()))
    node, current = F.col("_node"), F.col("_current")
    # What the reviewer saw beside the text, if it has changed.
    extras = F.array_sort(F.map_keys(F.map_filter(F.coalesce(e("extra"), F.create_map().cast("map<string,string>")), lambda k, v: ~v.eqNullSafe(F.element_at(F.coalesce("extra", F.create_map().cast("map<string,string>")), k)))))
    seen = F.concat(F.array_compact(F.array(F.when(~F.col("zh").eqNullSafe(e("zh")), "zh"), F.when(~F.col("en").eqNullSafe(e("en")), "en"))), extras)
    holders = invariants.found(F.coalesce("bo", F.lit("")), r"(\{[^{}]*\})")
    literal = F.regexp_replace(F.coalesce("bo", F.lit("")), r"\{[^{}]*\}", "")
    wrong = invariants.template_diagnostics(e("zh_literal"), literal, e("zh_holders"), holders, vocabulary)
    seconds = F.when(F.coalesce(e("zh_literal").contains("秒"), F.lit(False)), F.array(F.struct(F.lit("DECISION").alias("check"), F.lit("Resolve what seconds are called before importing this row.").alias("message")))).otherwise(F.array().cast(SAID))
    no = lambda c: F.coalesce(c, F.lit(False))
    say = lambda check, *message: F.array(F.struct(F.lit(check).alias("check"), F.concat(*(m if isinstance(m, Column) else F.lit(m) for m in message)).alias("message")))
    refusal = (
        F.when(is_name.isNull(), say("IDENTITY", "Unknown reviewer packet kind."))
        .when(no(F.col("_times") > 1), say("IDENTITY", "The packet contains this non-empty id more than once."))
        .when(F.col("_matches").isNull(), say("IDENTITY", "Target id is absent; it moved or was deleted."))
        .when(F.col("_matches") > 1, say("IDENTITY", "Target id is ambiguous in the current tree (", F.col("_matches").cast("string"), " matches)."))
        .when(is_name & (~no(e("field") == "name") | (F.col("key").isNotNull() & ~no(F.col("key") == e("key")))), say("IDENTITY", "Glossary-name row no longer identifies the same reference name and key."))
        .when(~is_name & (e("field").isNotNull() | no(e("excluded"))), say("IDENTITY", "Floor row now points to reference content or an explicitly excluded direct-bo call."))
        .when(~no(F.col("_content")), say("IDENTITY", "Current source file ", F.coalesce(e("file"), F.lit("")), " is unavailable."))
        .when(~no(e("replaceable")), say("OVERWRITE", "The current bo value is not a fallback; refusing to overwrite direct or redirected copy."))
        .when(~no((e("source_hash") == F.col("source_hash")) & (F.sha2(node, 256) == F.col("source_hash"))), say("B13", "Source drift: expected ", F.substring(F.coalesce("source_hash", F.lit("")), 1, 8), ", got ", F.substring(F.coalesce(e("source_hash"), F.lit("")), 1, 8), ". Re-export and re-review."))
        .when(F.size(seen) > 0, say("PACKET", "Reviewer-visible fields differ from the fresh export (", F.array_join(seen, ", "), "). Re-export and re-review."))
        .when(~no(current == e("current")), say("AST", "Re-parsed bo initializer disagrees with the fresh extractor."))
        .when(e("zh_literal").isNull(), say("SOURCE", "ZH source is not statically reviewable."))
        .when((e("zh_literal") == "") & (F.size(F.coalesce(e("zh_holders"), F.array().cast("array<string>"))) == 0), say("EMPTY-SOURCE", "This is a structural empty-text sentinel; non-empty bo would create visible copy."))
        .when(F.size(wrong) > 0, F.concat(wrong, seconds))
    )
    edit = F.struct(e("current_start").alias("start"), e("current_end").alias("end"), e("current").alias("expected"), F.replace(e("wrap"), F.lit("{}"), F.to_json(F.struct(F.col("bo").alias("b"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("bo").alias("b")))) - 6)).alias("replacement"), F.col("id").alias("id")).cast(EDIT)
    judged = met.select("place", "id", "packet", "_full", refusal.alias("_refusal"), e("file").alias("file"), edit.alias("_edit"), F.when(no(is_name), literal).alias("_name"))
    # Names of accepted rows and existing ones: those that two ids have are refused. An accepted id has two at most, a new and an existing one.
    accepted = judged.filter("_full AND _refusal IS NULL AND _name IS NOT NULL").select("id", F.col("_name").alias("name"))
    names = accepted.unionByName(entries.filter("field = 'name' AND existing IS NOT NULL").select("id", F.col("existing").alias("name"))).filter("id IS NOT NULL").distinct()
    names = names.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("name"))).filter("n > 1")
    both = names.groupBy(F.col("id").alias("_clash")).agg(F.min(F.struct("name", "n")).alias("_least"), F.max(F.struct("name", "n")).alias("_most")).select("_clash", F.array_distinct(F.array("_least", "_most")).alias("_shared"))
    out = judged.join(both, (F.col("id") == F.col("_clash")) & F.col("_name").isNotNull() & F.col("_refusal").isNull() & F.col("_full"), "left")
    status = F.when(~F.col("_full"), "skipped").when(F.col("_refusal").isNotNull() | F.col("_shared").isNotNull(), "refused").otherwise("written")
    said = F.when(~F.col("_full"), F.array().cast(SAID)).otherwise(F.col("_refusal").cast(SAID))
    checks = F.coalesce(F.transform("_said", lambda x: x["check"]), F.transform("_shared", lambda _: F.lit("B12")), F.array().cast("array<string>"))
    written = F.col("status") == "written"
    return out.withColumn("status", status).withColumn("_said", said).select("place", "id", "packet", "status", checks.alias("checks"), F.when(written, F.col("file")).alias("file"), F.when(written, F.col("_edit")).alias("edit"), "_said", "_shared"), names, both


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """file, content, problem of the files that edits (file, edit) change. An edit that overlaps another, or that doesn't find what it expects,
    leaves its file as it is."""
    by_place = Window.partitionBy("file").orderBy("edit.start", "edit.end")
    checked = edits.withColumn("_before", F.lag("edit.end").over(by_place))
    held = checked.groupBy("file").agg(F.sort_array(F.collect_list("edit"), asc=False).alias("_edits"), F.bool_or(F.coalesce(F.col("edit.start") < F.col("_before"), F.lit(False))).alias("_overlap"))
    met = held.join(files, "file", "left")
    return met.select("file", "content", "_edits", "_overlap").mapInArrow(_edited, "file string, content string, problem string")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files with their edits, the last first: the content that they leave, and what is wrong."""
    for batch in batches:
        for i in range(batch.num_rows):
            file, content, overlap = (batch.column(c)[i].as_py() for c in ("file", "content", "_overlap"))
            edits = list(zip(*(c.to_pylist() for c in batch.column("_edits")[i].values.flatten()), strict=True))
            moved = None if content is None else next((e[4] for e in edits if e[2] is None or cut(content, e[0], e[1]) != e[2]), None)
            problem = f"Missing source file {file}." if content is None else f"Overlapping replacements in {file}." if overlap else f"{moved} changed between validation and application." if moved is not None else None
            if problem is None:
                content = _replaced(content, edits)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (file, content, problem)], names=["file", "content", "problem"])


def _replaced(content: str, edits: list[tuple]) -> str | None:
    """The content after edits (start, end, expected, replacement, id) that don't overlap and come from the end; null if a part is."""
    if any(x is None for e in edits for x in (e[0], e[1], e[3])):
        return None
    if any(not 0 <= e[0] <= e[1] for e in edits):
        for start, end, _, new, _ in edits:
            content = content[: max(start, 0)] + new + cut(content, end, end + len(content) + 1)
        return content
    parts, at = [], len(content)
    for start, end, _, new, _ in edits:
        parts += [content[end:at], new]
        at = min(at, start)
    return "".join(reversed([*parts, content[:at]]))
