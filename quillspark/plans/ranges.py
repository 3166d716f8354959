"""Queries of large files that are read in ranges (SRC02, SRC17 to SRC19)."""

from __future__ import annotations

import json
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.plans.declare import Table, query
from quillspark.plans.ingest import fresh_folder
from quillspark.sources import ranges as R


def write_lines(rows: DataFrame, path: str, by: str, order: str) -> None:
    """Rows (by, order, value) as files of lines, one for each value of ``by``, each in its order."""
    rows.repartition(by).sortWithinPartitions(by, order).select(by, "value").write.partitionBy(by).text(path)


def write_objects(rows: DataFrame, path: str) -> None:
    """Rows (part, key, value: JSON) as JSON objects of many entries, one for each part, in the order of keys."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, out = None, 0, []
        for batch in batches:
            for now, key, value in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "value")), strict=True):
                if part not in (None, now):
                    out.append((part, nth, "}"))
                sign, nth = ("{", 0) if part != now else (",", nth)
                part = now
                out.append((part, nth, f"{sign} {json.dumps(key, ensure_ascii=False)}: {value}"))
                nth += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["part", "nth", "value"])
                out = []
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([nth]), pa.array(["}"])], ["part", "nth", "value"])

    dealt = rows.select(F.col("part").cast("string").alias("part"), "key", "value").repartition("part").sortWithinPartitions("part", "key")
    dealt.mapInArrow(lines, "part string, nth long, value string").sortWithinPartitions("part", "nth").select("part", "value").write.partitionBy("part").text(path)


@query("SELECT url AS key, page_id, html FROM pages")
def src17_object_entries(table: Table) -> DataFrame:
    """Pages written as huge JSON objects by URL, and read again entry by entry in ranges."""
    pages = table("pages")
    path = fresh_folder(pages, "objects")
    write_objects(pages.select(F.floor(F.col("page_id") / 5000).alias("part"), F.col("url").alias("key"), F.to_json(F.struct("page_id", "html")).alias("value")), path)
    entries = R.json_entries(pages.sparkSession, path)
    return entries.select("key", F.from_json("value", "page_id long, html string").alias("v")).select("key", "v.page_id", "v.html")


@query(
    """WITH firsts AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id // 20 ORDER BY lpad(conv_id::VARCHAR, 12, '0')) AS nth, count(*) AS turns, count(*) FILTER (role = 'user') AS users FROM conversations GROUP BY conv_id)
       SELECT lpad(conv_id::VARCHAR, 12, '0') AS key, CASE WHEN conv_id % 3 = 0 THEN ['source', 'url'] ELSE ['url'] END AS missing, CASE WHEN turns <> users THEN ['roles/users'] ELSE [] END AS uneven, false AS passed FROM firsts WHERE nth <= 3"""
)
def src18_schema_audit(table: Table) -> DataFrame:
    """The first three conversations of each huge object against the fields and equal lengths that they should have."""
    c = table("conversations").groupBy("conv_id").agg(F.array_agg("role").alias("roles"), F.array_agg(F.when(F.col("role") == "user", F.col("turn"))).alias("users"))
    source = F.when(F.col("conv_id") % 3 != 0, F.lit("a"))
    rows = c.select(F.floor(F.col("conv_id") / 20).alias("part"), F.lpad(F.col("conv_id").cast("string"), 12, "0").alias("key"), F.to_json(F.struct("roles", "users", source.alias("source"))).alias("value"))
    path = fresh_folder(rows, "audited")
    write_objects(rows, path)
    found = R.schema_audit(R.json_entries(rows.sparkSession, path), ["roles", "source", "url", "users"], [("roles", "users")])
    return found.select("key", "missing", "uneven", "passed")


def write_tar(members: DataFrame, path: str) -> None:
    """Members (archive, name, content: bytes) as TAR archives, each written by one task in the order of names."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A row is what stands between two magics, since those are the separators of the text that is written.
        archive, nth, held = None, 0, b""
        for batch in batches:
            rows = []
            for name, member, content in zip(*(batch.column(c).to_pylist() for c in ("archive", "name", "content")), strict=True):
                info = tarfile.TarInfo(member)
                info.size = len(content)
                header = info.tobuf(tarfile.USTAR_FORMAT)
                if name != archive:
                    if archive is not None:
                        rows.append((archive, nth, held + bytes(1024)))
                    archive, nth, held = name, 0, b""
                rows.append((archive, nth, held + header[:257]))
                nth, held = nth + 1, header[262:] + content + bytes(-len(content) % 512)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], ["archive", "nth", "value"])
        if archive is not None:
            yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([nth]), pa.array([held + bytes(1024)], pa.binary())], ["archive", "nth", "value"])

    dealt = members.repartition("archive").sortWithinPartitions("archive", "name").mapInArrow(rows_of, "archive string, nth long, value binary")
    dealt.sortWithinPartitions("archive", "nth").select("archive", F.col("value").cast("string").alias("value")).write.partitionBy("archive").option("lineSep", R.MAGIC.decode()).text(path)


@query("SELECT page_id AS id, 'pages/' || lpad(page_id::VARCHAR, 8, '0') || '.html' AS name, octet_length(encode(html))::BIGINT AS size, sha256(html) AS digest FROM pages WHERE page_id % 3 = 0")
def src19_tar_members(table: Table) -> DataFrame:
    """Members of TAR archives of pages that are asked for by path, by path without case, by base name, or by stem."""
    pages, number = table("pages"), F.col("page_id")
    name = F.format_string("%08d.html", number)
    path = fresh_folder(pages, "archives")
    write_tar(pages.select((number % 7).cast("string").alias("archive"), F.concat(F.lit("pages/"), name).alias("name"), F.coalesce(F.encode("html", "utf-8"), F.lit(b"")).alias("content")), path)
    asked = [F.concat(F.lit("./pages/"), name), F.upper(F.concat(F.lit("pages/"), name)), F.concat(F.lit("other\\"), name), F.format_string("other/%08d.jpeg", number)]
    wanted = pages.where(number % 3 == 0).select(number.alias("id"), F.element_at(F.array(*asked), (F.floor(number / 3) % 4 + 1).cast("int")).alias("member"))
    found = R.tar_contents(pages.sparkSession, path, wanted)
    return found.select("id", "name", "size", F.sha2("content", 256).alias("digest"))


@query(
    """WITH lines AS (SELECT event_id, event_id // 5000 AS file, row_number() OVER (PARTITION BY event_id // 5000 ORDER BY event_id) AS line FROM events)
       SELECT file, line, unnest(CASE WHEN event_id % 11 = 0 THEN ['not JSON'] WHEN event_id % 13 = 0 THEN ['not an object'] WHEN event_id % 17 = 0 THEN ['no id'] WHEN event_id % 19 = 0 THEN ['low value', 'no id'] ELSE [] END) AS fault
       FROM lines WHERE event_id % 7 <> 0"""
)
def src02_line_faults(table: Table) -> DataFrame:
    """Events as files of JSON lines, some blank, broken, no objects or without an id: each fault under its file and the number of its line."""
    e, i = table("events"), F.col("event_id")
    good = F.to_json(F.struct(F.when(~((i % 17 == 0) | (i % 19 == 0)), i).alias("id"), F.when((i % 19 == 0) & (i % 17 != 0), F.lit(-1)).otherwise(F.lit(1)).alias("value")))
    line = F.when(i % 7 == 0, F.lit("  ")).when(i % 11 == 0, F.lit('{"id": ')).when(i % 13 == 0, F.lit("[1, 2]")).otherwise(good)
    path = fresh_folder(e, "lines")
    write_lines(e.select(F.floor(i / 5000).alias("part"), "event_id", line.alias("value")), path, "part", "event_id")
    rules = {"low value": F.try_variant_get("row", "$.value", "int") < 0, "no id": F.try_variant_get("row", "$.id", "long").isNull()}
    found = R.json_line_faults(e.sparkSession, path, rules)
    return found.select(F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("file"), "line", "fault")
