"""Best-fit packing of token sequences by minimum bin slack.

A plan needs only how many pieces there are of each length, at most ``size`` numbers
however large the corpus.  For each bin, a bitset dynamic programme over the lengths
still available finds the fullest feasible combination with the longest of them; the
combination is removed as often as the counts allow.  Pieces then find their places by
their rank among the pieces of their length, which Spark counts in salted groups.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import checkpointed, rows_of, small

SIZE = 2048
END = 0  # the id that ends each document
TOKENIZER = "byte_bpe_50k.json"
LEAST_SALTS, ROWS_A_SALT = 256, 100_000

#: Fixed value: the pattern by which byte-level BPE files of this kind cut texts into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 65_536  # characters encoded at once
#: A cut before a lone space or line end between two other characters never splits a word of the pattern.
_SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Special tokens, very long blanks, and characters whose class may differ between versions of Unicode.
_UNUSUAL = re.compile(r"<\||\s{1000}|[^\x00-\u052f\u2010-\u2027\u2030-\u205e\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")
_encoders: dict[str, Callable[[str], bytes]] = {}


def token_bytes(tokenizer: str = TOKENIZER) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian 32-bit numbers.

    ``tokenizer`` is the path of a file of ``tokenizers``, or the name of a public one.  The
    vocabulary of a byte-level BPE file is given to ``tiktoken``, which finds the same ids
    in a third of the time; unusual texts, and those of other files, go to ``tokenizers``.
    """
    if tokenizer not in _encoders:
        _encoders[tokenizer] = _encoder(tokenizer)
    return _encoders[tokenizer]


def byte_ranks(described: dict) -> dict[bytes, int] | None:
    """Each token's bytes and id, if ids follow the order of merges and words the pattern; else None."""
    model, words = described["model"], described["pre_tokenizer"] or {}
    if model["type"] != "BPE" or words.get("type") != "ByteLevel" or words.get("add_prefix_space") or not words.get("use_regex", True) or described["normalizer"]:
        return None
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if any(model["vocab"].get(m) != k for k, m in enumerate(merges, 256)):
        return None
    # Byte-level files write printable bytes as themselves, the others as the letters from U+0100 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    letters = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    special = {t["content"] for t in described["added_tokens"]}
    return {bytes(map(letters.__getitem__, t)): k for t, k in model["vocab"].items() if t not in special}


def _encoder(tokenizer: str) -> Callable[[str], bytes]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if "/" not in tokenizer:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path(tokenizer))
    with open(tokenizer, encoding="utf-8") as file:
        ranks = byte_ranks(json.load(file))
    fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None
    slow: list[Tokenizer] = []

    def ids_of(text: str) -> bytes:
        if fast is not None and not _UNUSUAL.search(text):
            return np.array(fast.encode_ordinary(text), "<u4").tobytes()
        if not slow:
            slow.append(Tokenizer.from_file(tokenizer))
        return np.array(slow[0].encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(text: str) -> bytes:
        out, at = [], 0
        while fast is not None and len(text) - at > LONG and (found := _SAFE.search(text, at + LONG)) is not None:
            out.append(ids_of(text[at : found.start()]))
            at = found.start()
        return b"".join([*out, ids_of(text[at:])])

    return encode


def cut(length: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: ``size`` each, but for the first."""
    if length <= size:
        return [(0, length)]
    first = length % size or size
    return [(0, first), *((s, size) for s in range(first, length, size))]


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: what each row of ``docs`` (doc_id, text) is cut into."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = token_bytes(tokenizer), np.array([END], "<u4").tobytes()
        for batch in small(batches):
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text or "") + end
                out += [(doc, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, size))]
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return found.mapInArrow(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) of the combination that fills ``room`` most, of ``lengths`` in descending order.

    Bit i of a set says that some combination of the lengths so far sums to i.
    """
    mask, reach = (1 << (room + 1)) - 1, 1
    trail = []
    for n in lengths:
        if n > room or not counts[n]:
            continue
        before, left, take = reach, min(counts[n], room // n), 1
        while left:
            take = min(take, left)
            reach |= (reach << (n * take)) & mask
            left, take = left - take, take * 2
        if reach != before:
            trail.append((n, before))
            if reach >> room & 1:
                break
    total, chosen = reach.bit_length() - 1, []
    for n, before in reversed(trail):
        times = 0
        while not before >> total & 1:
            total, times = total - n, times + 1
        if times:
            chosen.append((n, times))
    return chosen


def slack_plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, times, first bin, offset) of runs of places, for ``counts`` of each length.

    Pieces of rank first rank, ... of a length fill bins first bin, ..., ``times`` in each,
    side by side from the offset.
    """
    left = {n: c for n, c in counts.items() if c}
    order = sorted(left, reverse=True)
    used = dict.fromkeys(left, 0)
    runs, bins = [], 0
    while order:
        longest = order[0]
        left[longest] -= 1
        inside = dict(fullest(order, left, size - longest))
        left[longest] += 1
        inside[longest] = inside.get(longest, 0) + 1
        repeat, offset = min(left[n] // k for n, k in inside.items()), 0
        for n, k in sorted(inside.items(), reverse=True):
            runs.append((n, used[n], k * repeat, k, bins, offset))
            used[n] += k * repeat
            left[n] -= k * repeat
            offset += k * n
        bins += repeat
        order = [n for n in order if left[n]]
    return runs


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, size: int = SIZE) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and an end id; a null text is empty and so one id long.  Longer
    ones than ``size`` are cut; the first piece may be shorter.  A sequence's pieces follow
    each other without gaps from 0.  Repeated rows are packed as often as they occur;
    other columns are ignored; texts are read whole, however long; an empty table gives no rows.
    """
    found = checkpointed(pieces(docs, tokenizer, size).withColumn("row_id", F.monotonically_increasing_id()))
    whole = found.where(F.col("length") == size)
    rest = found.where(F.col("length") < size)
    salts = LEAST_SALTS
    while salts * ROWS_A_SALT < rest.count():
        salts *= 2
    rest = rest.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = checkpointed(rest.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    counts = {row["length"]: row["n"] for row in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # under ``size`` rows
    plan = rows_of(docs.sparkSession, slack_plan(counts, size), "run_length long, first_rank long, ranks long, times long, first_bin long, run_offset long")
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row_id"))
    ranked = rest.withColumn("nth", nth).join(groups.drop("n"), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("nth") - 1)
    where = (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("ranks"))
    inside = F.col("rank") - F.col("first_rank")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # The plan's rows depend on ``size`` alone, not on the corpus: it is broadcast.
    placed = ranked.join(F.broadcast(plan), where).select(
        *columns,
        (F.col("first_bin") + F.floor(inside / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("run_offset") + (inside % F.col("times")) * F.col("length")).cast("long").alias("offset"),
    )
    return placed.unionByName(whole.select(*columns, (-1 - F.col("row_id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
