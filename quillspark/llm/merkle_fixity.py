"""Merkle fixity audit of WARC replicas.

Records are hashed, and ranges of offsets of an archive form a tree: a leaf hashes the
records that start within its range, in order, a higher node the sixteen ranges below it.
Replicas are compared from the roots down, and only below nodes that differ.  Each replica
has the offsets of its own bytes: what stands behind a lost byte has moved, and is told
apart from what is corrupt.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import checkpointed, skew_join, unused

LEAF_BYTES, FANOUT = 65_536, 16
END = "\r\n\r\n"
_VERSION = re.compile(rb"WARC/1\.\d\r\n")
_LENGTH = re.compile(rb"^content-length:[ \t]*(\d{1,15})(?!\d)", re.I | re.M)
_MEMBER = b"\x1f\x8b\x08"
_ID = re.compile(rb"^warc-record-id:[ \t]*<?(?:urn:record:)?([^>\r\n]*)", re.I | re.M)


# --- archives and their records -------------------------------------------------------------------


def warc_record(record_id: Column, uri: Column, payload: Column) -> Column:
    """The text of a WARC resource record; null parts are empty."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END),
    )
    return F.concat(head, body, F.lit(END))


def write_archives(records: DataFrame, folder: str, compression: str = "none") -> None:
    """Writes ``records`` (archive, nth, record) as one WARC file an archive, in the order of nth.

    A record is the text of ``warc_record``.  An archive is written by one task: it should
    be of the usual size of WARC files, a gigabyte at most.  Of a null record only the
    end of a record is written; an empty table writes no file.
    """
    bare = F.expr(f"left(record, length(record) - {len(END)})")  # the writer ends each row with the end of a record
    rows = records.repartition("archive").sortWithinPartitions("archive", "nth").select("archive", bare.alias("value"))
    rows.write.partitionBy("archive").option("lineSep", END).option("compression", compression).text(folder)


def inflated(content: bytes, piece: int = 1 << 16) -> Iterator[tuple[int, int, bytes, bool]]:
    """(offset, length, inflated bytes, whether whole) of the members of a gzip file.

    Of a damaged or cut-off member, the bytes that can be read; then on where the next one
    seems to start.  Bytes that belong to no member are a damaged one.
    """
    view, at = memoryview(content), 0
    while at < len(content):
        member, parts, end, whole = zlib.decompressobj(31), [], at, False
        try:
            while end < len(content) and not member.eof:
                parts.append(member.decompress(view[end : end + piece]))
                end += piece
            whole = member.eof
        except zlib.error:
            pass
        if whole:
            end = min(end, len(content)) - len(member.unused_data)
        else:
            following = content.find(_MEMBER, at + 1)
            end = following if following >= 0 else len(content)
        yield at, end - at, b"".join(parts), whole
        at = end


def records_in(content: bytes) -> Iterator[tuple[int, int, str | None, str, int]]:
    """(offset, length, record id, digest, place in the file) of the records of a WARC file.

    A record goes as far as its Content-Length says, if another or the end follows there;
    else, as in a damaged file, to where the next one starts.  Offsets are those of the
    inflated bytes; the place is the offset itself or, in a gzipped file, that of the member in which
    the record starts.  A member that cannot be read whole gives a record of its own beside what it still
    holds: "unreadable:" and its place, without length, with the digest of its bytes as they stand.
    """
    parts, size, starts, places, unreadable, plain = [], 0, [], [], [], content[:2] != _MEMBER[:2]
    if not plain:
        for at, length, data, whole in inflated(content):
            if not whole:
                unreadable.append((size, 0, f"unreadable:{at}", hashlib.sha256(content[at : at + length]).hexdigest(), at))
            if data:
                starts.append(size)
                places.append(at)
                parts.append(data)
                size += len(data)
        content = b"".join(parts)
    at = 0
    while at < len(content):
        head = content.find(END.encode(), at)
        said = _LENGTH.search(content, at, head) if head >= 0 else None
        end = head + 2 * len(END) + int(said[1]) if said else -1
        cut_off = _VERSION.search(content, at + 5, max(at + 5, head))  # the next record starts within this one's head
        if cut_off or end != len(content) and content[end : end + 5] != b"WARC/":
            following = _VERSION.search(content, at + 5)
            end = following.start() if following else len(content)
        name = _ID.search(content, at, max(at, head if head >= 0 else end))
        place = at if plain else places[bisect_right(starts, at) - 1]
        yield at, end - at, name[1].decode("utf-8", "replace") if name else None, hashlib.sha256(content[at:end]).hexdigest(), place
        at = end
    yield from unreadable


def read_archives(spark: SparkSession, folder: str, places: bool = False) -> DataFrame:
    """archive, offset, length, record_id, digest (and place, if asked for) of the WARC files under ``folder``, plain or gzipped, by record or as a whole.

    A task holds one file.  No file ends the audit, however damaged: see ``records_in``.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                found = list(zip(*records_in(content.as_py()), strict=True)) or [(), (), (), (), ()]
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                columns = [pa.array(c, t) for c, t in zip(found, types, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([archive] * len(found[0]), pa.string()), *columns], ["archive", "offset", "length", "record_id", "digest", "place"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.coalesce(F.nullif(F.regexp_extract("path", "archive=([^/]+)/", 1), F.lit("")), F.element_at(F.split("path", "/"), -1))
    found = files.select(name.alias("archive"), "content").mapInArrow(split, "archive string, offset long, length long, record_id string, digest string, place long")
    return found if places else found.drop("place")


# --- trees ----------------------------------------------------------------------------------------


def leaves(records: DataFrame) -> DataFrame:
    """archive, level 0, range, hash of ``records`` (archive, offset, length, digest); no hash where an offset or digest is null.

    Of records repeated whole, the leaf holds one and their number, so it is never larger
    than what 64 KB can start.
    """
    each = F.struct("offset", F.coalesce("length", F.lit(-1).cast("long")).alias("length"), "digest")
    text = F.array_join(F.transform(F.array_sort(F.collect_set(F.when(F.col("offset").isNotNull(), each))), lambda r: F.concat_ws(":", r["offset"], r["length"], r["digest"])), "\n")
    keyed = records.groupBy("archive", F.floor(F.col("offset") / LEAF_BYTES).alias("range"))
    unsure = F.bool_or(F.col("offset").isNull() | F.col("digest").isNull())
    node = keyed.agg(F.when(~unsure, F.sha2(F.concat_ws("\n", F.count(F.lit(1)).cast("string"), text), 256)).alias("hash"))
    return node.select("archive", F.lit(0).alias("level"), "range", "hash")


def above(nodes: DataFrame, level: int) -> DataFrame:
    """The level over ``nodes``: each node hashes up to FANOUT neighbouring ranges in order; none has a hash above one that has none."""
    children = F.array_sort(F.collect_list(F.struct("range", "hash")))
    text = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["range"], c["hash"])), "\n")
    keyed = nodes.groupBy("archive", F.floor(F.col("range") / FANOUT).alias("range"))
    return keyed.agg(F.when(F.count("hash") == F.count(F.lit(1)), F.sha2(text, 256)).alias("hash")).select("archive", F.lit(level).alias("level"), "range", "hash")


def tree(records: DataFrame, levels: int) -> list[DataFrame]:
    """The levels of the trees of all archives, leaves first; the last holds the roots."""
    found = [checkpointed(leaves(records))]
    for level in range(1, levels):
        found.append(checkpointed(above(found[-1], level)))
    return found


def levels_for(longest: int) -> int:
    """Levels that bring an archive whose last offset is ``longest`` under one root."""
    n, ranges = 1, longest // LEAF_BYTES + 1
    while ranges > 1:
        n, ranges = n + 1, -(-ranges // FANOUT)
    return n


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """archive, range of the nodes that are not known to be equal."""
    other = b.select("archive", "range", F.col("hash").alias("other"))
    both = skew_join(a.select("archive", "range", "hash"), other, ["archive", "range"], "left").where(~F.coalesce(F.col("hash") == F.col("other"), F.lit(False)))
    more = skew_join(other, a.select("archive", "range"), ["archive", "range"], "left_anti")
    return both.select("archive", "range").unionByName(more.select("archive", "range"))


def _suspects(left: DataFrame, right: DataFrame) -> DataFrame:
    """archive, range of the leaves that differ, found by descent from the roots."""
    levels = levels_for(max(r.agg(F.max("offset")).first()[0] or 0 for r in (left, right)))
    a, b = tree(left, levels), tree(right, levels)
    found = checkpointed(_differing(a[-1], b[-1]))
    for level in range(levels - 2, -1, -1):
        if found.isEmpty():
            break
        parents = found.withColumnRenamed("range", "parent")
        under = [skew_join(t[level].withColumn("parent", F.floor(F.col("range") / FANOUT)), parents, ["archive", "parent"], "left_semi") for t in (a, b)]
        found = checkpointed(_differing(*under))
    return found


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """archive, record_id, offset, length, digest, status of the records that differ between two replicas (the first five columns).

    Records are known by archive and record_id, null being a name like any other.  Status is
    "corrupt" (``right`` has the record, but not its bytes; a null digest is never known to
    be the same), "moved" (it has the bytes elsewhere), "missing" (it lacks the record) or
    "extra" (only ``right`` has it; its own offset).  Equal replicas give no rows, as do empty
    ones; repeated rows are one; of records that share a name, each is held against all.
    Offsets and lengths are 64 bits wide, so archives may be of any size.
    """
    suspects = _suspects(left, right)
    name, body = ["archive", "record_id"], ["length", "digest"]
    inside = []
    for records in (left, right):
        keyed = records.select(*name, "offset", *body).distinct().withColumn("range", F.floor(F.col("offset") / LEAF_BYTES))
        inside.append(checkpointed(skew_join(keyed, suspects, ["archive", "range"], "left_semi").drop("range")))
    ours, theirs = inside
    seen = ours
    for flag, keys in (("_same", [*name, "offset", *body]), ("_elsewhere", [*name, *body]), ("_known", name)):
        seen = skew_join(seen, theirs.select(*keys).distinct().withColumn(flag, F.lit(True)), keys, "left")
    sure = F.col("digest").isNotNull()
    status = F.when(F.col("_known").isNull(), "missing").when(sure & F.col("_same"), "intact").when(sure & F.col("_elsewhere"), "moved").otherwise("corrupt")
    extra = skew_join(theirs, ours.select(*name).distinct(), name, "left_anti").withColumn("status", F.lit("extra"))
    return seen.select(*name, "offset", *body, status.alias("status")).where("status <> 'intact'").unionByName(extra)


def fixity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each record of ``left`` (with all its columns) and its status: intact, or as ``audit`` says; a column status of its own is replaced."""
    keys, found = ["archive", "record_id", "offset", "length", "digest"], unused("_found", left)
    told = audit(left, right).where("status <> 'extra'").withColumnRenamed("status", found)
    return skew_join(left, told, keys, "left").withColumn("status", F.coalesce(found, F.lit("intact"))).drop(found)
