"""Large single files read in byte ranges by many tasks: numbered lines, one huge JSON object, TAR archives.

Spark's text source cuts a file at any separator, so what stands between two separators is
a row whose place is known by its range and its order there.  Small sums over the ranges
tell where each one starts: its line number, its offset, whether it begins within a string
and how deep.  Then every task reads its own ranges; what crosses a border is put together
afterwards.  Nothing passes one task but a few numbers a range or a member.
"""

from __future__ import annotations

import re
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators.exchange import settled, skew_join

BROADCAST_RANGES = 100_000  # ranges whose sums are broadcast (a row of some 100 bytes each); more are joined
MAGIC = b"ustar"
SPECIAL_BYTES = 65_536  # of long names and extended headers


def chunks(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """file, file_size, block, seq, value (bytes) of what stands between separators (line ends if none is given).

    A file's rows are in the order of block (where their range starts) and seq; seq counts
    on by one within a range.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    found = (reader.option("lineSep", separator) if separator else reader).text(path)
    where = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "file"), ("file_size", "file_size"), ("file_block_start", "block"))]
    return found.select(*where, F.monotonically_increasing_id().alias("seq"), F.col("value").cast("binary").alias("value"))


def _placed(rows: DataFrame, starts: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` of their range in ``starts`` (file, block, ...); ranges that Spark cut otherwise in the meantime are an error."""
    keys, starts = ["file", "block"], starts.select("file", "block", *columns)
    if starts.count() <= BROADCAST_RANGES:
        joined = rows.join(F.broadcast(starts), keys, "left")
    else:
        joined = skew_join(rows, starts, keys, "left").repartition(*keys).sortWithinPartitions(*keys, "seq")
    sure = F.when(F.col(columns[0]).isNull(), F.raise_error(F.lit("the ranges of a file changed between two passes: set spark.sql.files.minPartitionNum"))).otherwise(F.col(columns[0]))
    return joined.withColumn(columns[0], sure)


def _before(column: Column) -> Column:
    """The sum of ``column`` over a file's earlier ranges."""
    return F.coalesce(F.sum(column).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


# --- lines ----------------------------------------------------------------------------------------


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value of all lines of the files under ``path``, blank ones too."""
    lines = chunks(spark, path)
    sizes = settled(lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first")))
    starts = settled(sizes.select("file", "block", "first", _before(F.col("n")).alias("before")))
    line = F.col("before") + F.col("seq") - F.col("first") + 1
    return _placed(lines, starts, ["first", "before"]).select("file", line.alias("line"), F.col("value").cast("string").alias("value"))


def json_line_faults(spark: SparkSession, path: str, rules: dict[str, Column] | None = None) -> DataFrame:
    """file, line, fault of the lines of JSON under ``path`` that are not objects, or break one of ``rules``.

    Blank lines are none.  Faults are "not JSON", "not an object", or the name of each rule
    (a condition on the VARIANT column row, null counting as kept) that holds.
    """
    lines = numbered_lines(spark, path).where(~F.col("value").rlike(r"^\s*$")).withColumn("row", F.try_parse_json("value"))
    kind = F.schema_of_variant("row")
    own = F.when(F.col("row").isNull(), F.array(F.lit("not JSON"))).when(~kind.startswith("OBJECT"), F.array(F.lit("not an object")))
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in (rules or {}).items()])) if rules else F.array().cast("array<string>")
    return lines.select("file", "line", F.explode(F.coalesce(own, broken)).alias("fault"))


def read_json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, line and the columns of ``schema`` of lines of JSON, all of which must be objects: else an error that names the first bad line's file and number."""
    worst = json_line_faults(spark, path).agg(F.min(F.struct("file", "line", "fault")).alias("f")).first()["f"]
    if worst is not None:
        raise ValueError(f"{worst['file']}:{worst['line']} is {worst['fault']}")
    lines = numbered_lines(spark, path).where(~F.col("value").rlike(r"^\s*$"))
    return lines.select("file", "line", F.from_json("value", schema).alias("row")).select("file", "line", "row.*")


# --- one JSON object of many entries ------------------------------------------------------------------

_SUMS = pa.schema([("file", pa.string()), ("file_size", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("bytes", pa.int64()), ("quotes", pa.int64()), ("outside", pa.int64()), ("inside", pa.int64())])
_ENTRIES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("offset", pa.int64()), ("text", pa.binary())])
_STRUCTURE = re.compile(rb'["{}\[\],]')
_STRING_END = re.compile(rb'(?:[^"\\]++|\\.)*+"', re.S)
WHOLE, END, THROUGH, START = 0, 1, 2, 3  # parts of entries that cross ranges, in the order of a range


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _depth_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range: its chunks, bytes and quotes, and how the depth changes if it starts outside of a string, and if inside."""
    key, sums = None, []
    for batch in batches:
        done = []
        for file, size, block, value in zip(*(batch.column(c) for c in ("file", "file_size", "block", "value")), strict=True):
            here = (file.as_py(), size.as_py(), block.as_py())
            if here != key:
                if key:
                    done.append((*key, *sums))
                key, sums = here, [0, 0, 0, 0, 0]
            chunk = value.as_py()
            parts = re.sub(rb"(?s)\\.", b"", chunk).split(b'"')
            steps = [sum(text.count(c) for c in (b"{", b"[")) - sum(text.count(c) for c in (b"}", b"]")) for text in (b"".join(parts[::2]), b"".join(parts[1::2]))]
            steps[(len(parts) - 1) % 2] -= 1  # the separator closes what is open, where it is outside
            odd = sums[2] % 2
            sums[0] += 1
            sums[1] += len(chunk) + 1
            sums[2] += len(parts) - 1
            sums[3] += steps[odd]
            sums[4] += steps[1 - odd]
        if done:
            yield _batch(done, _SUMS)
    if key:
        yield _batch([(*key, *sums)], _SUMS)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries at depth 1 of each range, and the parts of those that cross its borders."""
    key, rows = None, []
    held: list[bytes] = []
    in_string = fresh = False  # fresh: the entry at hand started in this range
    depth = at = start = left = 0

    def add(part: int, text: bytes) -> None:
        if part == WHOLE and not text.strip():
            return
        blank = len(text) - len(text.lstrip()) if part == WHOLE else 0
        rows.append((*key, part, start + blank, text))

    def close() -> None:
        nonlocal fresh
        add(WHOLE if fresh else END, b"".join(held))
        held.clear()
        fresh = True

    def leave() -> None:
        if key and depth > 0:
            add(START if fresh else THROUGH, b"".join(held))

    for batch in batches:
        for file, block, n, unsealed, d, s, offset, value in zip(*(batch.column(c) for c in ("file", "block", "n", "unsealed", "depth", "in_string", "offset", "value")), strict=True):
            here = (file.as_py(), block.as_py())
            if here != key:
                leave()
                key, in_string, depth, at, left = here, s.as_py(), d.as_py(), offset.as_py(), n.as_py()
                held.clear()
                fresh, start = False, at
            left -= 1
            chunk, p, begin = value.as_py() + (b"" if unsealed.as_py() and not left else b"}"), 0, 0
            while p < len(chunk):
                if in_string:
                    found = _STRING_END.match(chunk, p)
                    if not found:
                        break
                    in_string, p = False, found.end()
                    continue
                found = _STRUCTURE.search(chunk, p)
                if not found:
                    break
                p, sign = found.end(), found[0]
                if sign == b'"':
                    in_string = True
                elif sign in b"{[":
                    depth += 1
                    if depth == 1:
                        held.clear()
                        fresh, begin, start = True, p, at + p
                elif sign in b"}]":
                    depth -= 1
                    if depth == 0:
                        held.append(chunk[begin : p - 1])
                        close()
                        begin = p
                elif depth == 1:
                    held.append(chunk[begin : p - 1])
                    close()
                    begin, start = p, at + p
            held.append(chunk[begin:])
            at += len(chunk)
        if rows:
            yield _batch(rows, _ENTRIES)
            rows.clear()
    leave()
    if rows:
        yield _batch(rows, _ENTRIES)


def json_entries(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """file, offset, key, value (JSON) and fault of the entries of the files under ``path``, each one huge JSON object.

    Offsets are those of the entries' first bytes.  A file that ends within an entry, or
    an entry that is no key and value, is an error that names file and offset; if not
    strict, such entries have a fault, and a value of null.  Keys that repeat stay.
    """
    rows = chunks(spark, path, "}")
    sums = settled(rows.mapInArrow(_depth_sums, "file string, file_size long, block long, n long, bytes long, quotes long, outside long, inside long"))
    placed = sums.withColumns({"offset": _before(F.col("bytes")), "in_string": _before(F.col("quotes")) % 2 == 1})
    placed = placed.withColumn("change", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside"))).withColumn("depth", _before(F.col("change")))
    # The last chunk of a file has no separator, unless the file ends with one; the size of a compressed file does not tell, but whether all is closed then.
    last = F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull()
    beyond = F.col("offset") + F.col("bytes") - F.col("file_size")
    placed = settled(placed.withColumn("unsealed", last & F.when(beyond.isin(0, 1), beyond == 1).otherwise(F.col("depth") + F.col("change") != 0)))
    told = _placed(rows.drop("file_size"), placed, ["n", "unsealed", "depth", "in_string", "offset"])
    found = told.mapInArrow(_entries, "file string, block long, part int, offset long, text binary")
    found = settled(found)
    opened = F.last(F.when(F.col("part") == START, F.col("offset")), ignorenulls=True).over(Window.partitionBy("file").orderBy("block", "part"))
    crossing = found.where(F.col("part") != WHOLE).withColumn("entry", opened).groupBy("file", "entry")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("block", "part", "text"))), lambda p: p["text"])
    crossing = crossing.agg(F.aggregate(texts, F.lit(b""), lambda a, b: F.concat(a, b)).alias("text"), F.max((F.col("part") == END).cast("int")).alias("closed"))
    blank = F.length(F.regexp_extract(F.col("text").cast("string"), r"^\s*", 0))
    crossing = crossing.withColumn("blank", blank).where((F.col("closed") == 0) | (F.col("blank") < F.length("text")))
    every = found.where(F.col("part") == WHOLE).select("file", "offset", "text", F.lit(1).alias("closed")).unionByName(crossing.select("file", (F.col("entry") + F.col("blank")).alias("offset"), "text", "closed"))
    text, pair = F.col("text").cast("string"), r'(?s)^\s*("(?:[^"\\]++|\\.)*+")\s*:\s*(\S.*)$'
    key = F.get(F.from_json(F.concat(F.lit("["), F.regexp_extract(text, pair, 1), F.lit("]")), "array<string>"), 0)
    value = F.regexp_replace(F.regexp_extract(text, pair, 2), r"\s+$", "")
    fault = F.when(F.col("closed") == 0, "not closed").when(~text.rlike(pair) | F.get_json_object(value, "$").isNull() & (value != "null"), "not an entry")
    entries = every.select("file", "offset", key.alias("key"), F.when(fault.isNull(), value).alias("value"), fault.alias("fault"))
    if strict:
        worst = entries.where("fault is not null").agg(F.min(F.struct("file", "offset", "fault")).alias("f")).first()["f"]
        if worst is not None:
            raise ValueError(f"{worst['file']}: the entry at byte {worst['offset']} is {worst['fault']}")
    return entries


def schema_audit(entries: DataFrame, required: list[str], pairs: list[tuple[str, str]], first: int = 3) -> DataFrame:
    """file, key, missing (sorted), uneven, passed of the ``first`` entries of each file, by offset: required fields, and pairs of lists that must be equally long."""
    nth = F.row_number().over(Window.partitionBy("file").orderBy("offset"))
    some = entries.withColumn("nth", nth).where(F.col("nth") <= first)
    fields = F.from_json("value", "map<string,string>")
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.coalesce(F.map_keys(fields), F.array().cast("array<string>"))))
    length = lambda name: F.coalesce(F.json_array_length(F.get_json_object("value", f"$.{name}")), F.lit(0))
    uneven = F.array_compact(F.array(*[F.when(length(a) != length(b), F.lit(f"{a}/{b}")) for a, b in pairs]))
    return some.select("file", "key", missing.alias("missing"), uneven.alias("uneven"), ((F.size(missing) == 0) & (F.size(uneven) == 0)).alias("passed"))


# --- TAR archives -------------------------------------------------------------------------------------

_HEADS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("size", pa.int64()), ("head", pa.binary()), ("tail", pa.binary())])
_WALK = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("name", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("link", pa.string()), ("fault", pa.string()),
    ("block", pa.int64()), ("seq", pa.int64()), ("skip", pa.int64()), ("length", pa.int64()), ("at", pa.int64()),
])
_KINDS = {tarfile.REGTYPE: "file", tarfile.AREGTYPE: "file", tarfile.CONTTYPE: "file", tarfile.DIRTYPE: "folder", tarfile.SYMTYPE: "link", tarfile.LNKTYPE: "link"}


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and last bytes of each chunk: all of a header's, and of long names where the chunk before announces one."""
    key, before = None, b""
    for batch in batches:
        rows = []
        for file, block, seq, value in zip(*(batch.column(c) for c in ("file", "block", "seq", "value")), strict=True):
            here, data = (file.as_py(), block.as_py()), value.as_py()
            special = here != key or before[-101:-100] in (b"L", b"K", b"x", b"g", b"X")
            key = here
            rows.append((*here, seq.as_py(), len(data), data[: 250 + (SPECIAL_BYTES if special else 0)], data[-257:]))
            before = (before + MAGIC + data[-257:])[-257:] if len(data) < 257 else data[-257:]
        if rows:
            yield _batch(rows, _HEADS)


class _Walk:
    """The headers of one archive, each found where the one before says: so what looks like a header within a member is none."""

    def __init__(self, file: str):
        self.file, self.known, self.active = file, [], []
        self.end = self.header = 0
        self.name = self.link = self.size = None  # what long names and extended headers say of the next member
        self.lost = False

    def read(self, a: int, b: int) -> bytes | None:
        parts, at = [], a
        for start, data in self.known:
            if start <= at < start + len(data):
                parts.append(data[at - start : b - start])
                at += len(parts[-1])
        return b"".join(parts) if at >= b else None

    def chunk(self, block: int, seq: int, size: int, head: bytes, tail: bytes, nth: int) -> Iterator[tuple]:
        start = self.end
        if nth:
            self.known.append((start, MAGIC))
            start += len(MAGIC)
        first, self.end = self.end, start + size
        self.known += [(start, head), (self.end - len(tail), tail)]
        if self.lost and nth and (first - 257) % 512 == 0:  # on with the next header that is sound
            self.header = first - 257
        while self.end >= self.header + 512:
            data = self.read(self.header, self.header + 512)
            try:
                info = tarfile.TarInfo.frombuf(data, "utf-8", "surrogateescape") if data and self.header >= 0 else None
            except tarfile.HeaderError:
                info = None
            if info is None:
                if not self.lost:
                    yield (self.file, self.header, None, None, None, None, "no header", *[None] * 5)
                self.lost = True
                break
            body = self.header + 512
            length = info.size if info.type in (*tarfile.REGULAR_TYPES, b"L", b"K", b"x", b"g", b"X") else 0
            if info.type in (b"L", b"K", b"x", b"g", b"X"):
                if self.end < body + length:
                    break
                said = self.read(body, body + length)
                if info.type == b"L":
                    self.name = (said or b"").rstrip(b"\0").decode("utf-8", "replace")
                elif info.type == b"K":
                    self.link = (said or b"").rstrip(b"\0").decode("utf-8", "replace")
                elif info.type == b"x":
                    self.extended(said or b"")
            else:
                length = self.size if self.size is not None and info.type in tarfile.REGULAR_TYPES else length
                name = (self.name or info.name).encode("utf-8", "replace").decode("utf-8")
                link = (self.link or info.linkname).encode("utf-8", "replace").decode("utf-8") or None
                kind = _KINDS.get(info.type, "other")
                yield (self.file, self.header, name, kind, length, link, None, *[None] * 5)
                if kind == "file":
                    self.active.append((self.header, body, body + length))
                self.name = self.link = self.size = None
            self.lost = False
            self.header = body + -(-length // 512) * 512
        for header, a, b in self.active:
            low, high = max(a, first), min(b, self.end)
            if low < high:
                yield (self.file, header, *[None] * 5, block, seq, low - first, high - low, low - a)
        self.active = [x for x in self.active if x[2] > self.end]
        keep = min(self.header, self.end - 1024) if not self.lost else self.end - 1024
        self.known = [(s, d) for s, d in self.known if s + len(d) > keep]

    def extended(self, said: bytes) -> None:
        at = 0
        while at < len(said):
            length, _, _ = said[at:].partition(b" ")
            if not length.isdigit() or not int(length):
                return
            key, _, value = said[at + len(length) + 1 : at + int(length) - 1].partition(b"=")
            if key == b"path":
                self.name = value.decode("utf-8", "replace")
            elif key == b"linkpath":
                self.link = value.decode("utf-8", "replace")
            elif key == b"size" and value.isdigit():
                self.size = int(value)
            at += int(length)

    def finish(self, zeros: bool) -> Iterator[tuple]:
        """The end of an archive is a block of zeros, or its last byte; members that go on behind it are cut off."""
        if self.lost and zeros:
            yield (self.file, self.header, None, None, None, None, "end", *[None] * 5)
        elif not self.lost and self.header < self.end and (self.read(self.header, self.end) or b"?").strip(b"\0"):
            yield (self.file, self.header, None, None, None, None, "cut off", *[None] * 5)
        for header, _, _ in self.active:
            yield (self.file, header, None, None, None, None, "cut off", *[None] * 5)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walk, nth, zeros = None, 0, False
    for batch in batches:
        rows = []
        for file, block, seq, size, head, tail in zip(*(batch.column(c) for c in ("file", "block", "seq", "size", "head", "tail")), strict=True):
            if walk is None or walk.file != file.as_py():
                if walk:
                    rows += walk.finish(zeros)
                walk, nth = _Walk(file.as_py()), 0
            zeros = not tail.as_py().strip(b"\0")
            rows += walk.chunk(block.as_py(), seq.as_py(), size.as_py(), head.as_py(), tail.as_py(), nth)
            nth += 1
        if rows:
            yield _batch(rows, _WALK)
    if walk and (rows := list(walk.finish(zeros))):
        yield _batch(rows, _WALK)


def _tar_walk(rows: DataFrame) -> DataFrame:
    heads = rows.mapInArrow(_heads, "file string, block long, seq long, size long, head binary, tail binary")
    ddl = "file string, offset long, name string, kind string, size long, link string, fault string, block long, seq long, skip long, length long, at long"
    return settled(heads.repartition("file").sortWithinPartitions("file", "block", "seq").mapInArrow(_walked, ddl))


def tar_index(spark: SparkSession, path: str) -> DataFrame:
    """file, offset (of the header), name, kind, size, link, fault of the members of the TAR archives under ``path``, plain or gzipped.

    Long names and extended headers are resolved.  What is no archive of the ustar kind, or
    is cut off, has rows with a fault, and members behind a damaged header are found again.
    """
    return _index(_tar_walk(chunks(spark, path, MAGIC.decode())))


def _index(walked: DataFrame) -> DataFrame:
    told = walked.where("seq is null")
    # A missing header within the zeros at the end is the end.
    ends = told.where("fault = 'end'").select("file", "offset").withColumn("ended", F.lit(True))
    kept = skew_join(told.where("fault is null or fault <> 'end'"), ends, ["file", "offset"], "left")
    return kept.where("fault is null or fault <> 'no header' or ended is null").select("file", "offset", "name", "kind", "size", "link", "fault")


def _safe(name: Column) -> Column:
    plain = F.regexp_replace(F.replace(name, F.lit("\\"), F.lit("/")), r"/(\./|/)+", "/")
    return F.regexp_replace(plain, r"^[./]+", "")


def matched_members(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """``members`` (name, ...) that one of ``wanted`` (id, member) asks for, with its id: by the path, else without case, else by the base name, else by its stem.

    A level counts where it names one wanted row alone; of rows that ask for one path the
    greatest id counts.  Paths are relative; absolute ones and those that go up are an error.
    """
    up = lambda c: F.replace(c, F.lit("\\"), F.lit("/")).rlike(r"^/|(^|/)\.\.(/|$)")
    check = lambda c: F.when(up(c), F.raise_error(F.concat(F.lit("path leads out of the archive: "), c))).otherwise(_safe(c))
    base = lambda c: F.lower(F.element_at(F.split(c, "/"), -1))
    stem = lambda c: F.regexp_replace(base(c), r"(?<=.)\.[^.]+$", "")
    asked = settled(wanted.select("id", check(F.col("member")).alias("path")).groupBy("path").agg(F.max("id").alias("id")))
    found = members.withColumn("_path", check(F.col("name")))
    for level, of in enumerate((lambda c: c, F.lower, base, stem)):
        one = asked.groupBy(of(F.col("path")).alias("_key")).agg(F.max("id").alias(f"_id{level}"), F.count(F.lit(1)).alias("_n"))
        one = one.where("_n = 1").drop("_n") if level > 1 else one.drop("_n")
        found = skew_join(found.withColumn("_key", of(F.col("_path"))), one, ["_key"], "left").drop("_key")
    levels = [f"_id{k}" for k in range(4)]
    return found.withColumn("id", F.coalesce(*levels)).where("id is not null").drop("_path", *levels)


def tar_contents(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """file, offset, name, size, content of the files in the TAR archives under ``path``; with ``wanted`` (id, member), those alone and their id.

    Archives are read in ranges, members put together from the ranges they cross.  Links
    and faults are errors.  Of members that match one id, the last of the last file counts.
    """
    rows = chunks(spark, path, MAGIC.decode())
    walked = _tar_walk(rows)
    index = _index(walked)
    bad = index.where("fault is not null or kind = 'link'").agg(F.min(F.struct("file", "offset", F.coalesce("fault", F.lit("a link")).alias("fault"))).alias("f")).first()["f"]
    if bad is not None:
        raise ValueError(f"{bad['file']}: at byte {bad['offset']}: {bad['fault']}")
    members = index.where("kind = 'file'").select("file", "offset", "name", "size")
    if wanted is not None:
        members = matched_members(members, wanted)
        members = members.withColumn("_last", F.max(F.struct("file", "offset")).over(Window.partitionBy("id"))).where("_last.file = file and _last.offset = offset").drop("_last")
    members = settled(members)
    parts = skew_join(walked.where("seq is not null").select("file", "offset", "block", "seq", "skip", "length", "at"), members.select("file", "offset"), ["file", "offset"], "left_semi")
    # Only the first chunk of a file has no separator before it; it is half a header and no content.
    pieces = skew_join(rows.select("file", "block", "seq", "value"), settled(parts), ["file", "block", "seq"], "inner").withColumn("data", F.concat(F.lit(MAGIC), "value"))
    pieces = pieces.select("file", "offset", "at", F.substring("data", (F.col("skip") + 1).cast("int"), F.col("length").cast("int")).alias("piece"))
    joined = F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda p: p["piece"]), F.lit(b""), lambda a, b: F.concat(a, b))
    whole = pieces.groupBy("file", "offset").agg(joined.alias("content"))
    return skew_join(members, whole, ["file", "offset"], "left").withColumn("content", F.coalesce("content", F.lit(b"")))
