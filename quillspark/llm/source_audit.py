"""How the sources of a language diverge from each other and from the language: counts of terms in mergeable byte tries.

Each task makes radix tries of its documents' terms over UTF-8 bytes, one for each language,
whose leaves hold a counter for each source.  A trie is kept in preorder: a leaf tells the
depth at which its path leaves that of the leaf before, and the bytes below.  Tries are cut
below common prefixes and the pieces of a prefix, from all tasks, merged; a prefix with too
many leaves is cut further down first, so that no merge outgrows its task.  A merged trie is
walked in UTF-8 order, and the walk streams the divergence of source pairs and each source's
best terms.
"""

from __future__ import annotations

import struct
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from quillspark.llm.common import checkpointed, skew_join, written
from quillspark.operators.exchange import grouped_rank

SCALE = 1_000_000_000  # shares are counted in billionths
HELD = 600_000  # entries (language, source, term) that a task counts before they go to tries and out
HEAD = 2  # bytes of the first prefixes
MOST_LEAVES = 500_000  # leaves of all tasks below a prefix that one merge holds
MOST_HEADS = 10_000  # prefixes with more than that, up to which they are broadcast; more are joined
FOLD = 4096  # pieces of a prefix whose counts are added up at once
COMPARED = 32  # bytes in which neighbours are compared
GROUPS = 2048  # groups (language, source) whose pairs a walk adds up at once
CELLS = 500_000  # shares compared in one vector step
PIECE = 1 << 20  # bytes of a text that are split into terms at once

#: Bytes that end a term become blanks, and only A to Z become small letters: all bytes from 0x80 on belong to terms.
FOLDED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    text, at = text.translate(FOLDED), 0
    while at < len(text):
        end = text.find(b" ", at + piece)
        yield text[at : end if end >= 0 else len(text)].split()
        at = end if end >= 0 else len(text)


# --- tries ---


class Trie(NamedTuple):
    """A radix trie in preorder: its terms in UTF-8 order, the bytes that each shares with the one before, its documents, and its counters from ``first`` on."""

    terms: list[bytes]
    shared: np.ndarray
    docs: np.ndarray
    first: np.ndarray  # one more than terms
    sources: np.ndarray  # places in ``names``
    counts: np.ndarray
    names: list[str]


def trie_of(docs: dict[bytes, int], counts: dict[str, dict[bytes, int]]) -> Trie:
    """The trie of terms with their documents and, for each source, their counts."""
    terms = sorted(docs)
    place = dict(zip(terms, range(len(terms)), strict=True))
    names = sorted(counts)
    leaf = [np.fromiter(map(place.__getitem__, counts[s]), np.int64, len(counts[s])) for s in names]
    n = np.concatenate([np.fromiter(counts[s].values(), np.int64, len(counts[s])) for s in names])
    source = np.repeat(np.arange(len(names)), [len(x) for x in leaf])
    leaf = np.concatenate(leaf)
    order = np.argsort(leaf, kind="stable")
    first = np.concatenate(([0], np.cumsum(np.bincount(leaf, minlength=len(terms)))))
    return Trie(terms, shared_bytes(terms), np.fromiter(map(docs.__getitem__, terms), np.int64, len(terms)), first, source[order], n[order], names)


def shared_bytes(terms: list[bytes]) -> np.ndarray:
    """How many bytes each term has in common with the one before, as far as their first COMPARED bytes tell."""
    cells = np.array(terms, f"S{COMPARED}").view(np.uint8).reshape(len(terms), COMPARED)
    same = np.zeros(len(terms), np.int64)
    same[1:] = np.cumprod((cells[1:] == cells[:-1]) & (cells[1:] > 0), axis=1, dtype=np.uint8).sum(axis=1)
    return same


_WIDTHS = (np.uint8, np.uint16, np.uint32, np.uint64)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, each as narrow as it may be."""
    parts = []
    for numbers in arrays:
        most = int(numbers.max(initial=0))
        width = 0 if most < 1 << 8 else 1 if most < 1 << 16 else 2 if most < 1 << 32 else 3
        parts += [struct.pack("<BI", width, len(numbers)), numbers.astype(_WIDTHS[width]).tobytes()]
    return b"".join(parts)


def _unpacked(packed: bytes, n: int) -> tuple[list[np.ndarray], int]:
    arrays, at = [], 0
    for _ in range(n):
        width, size = struct.unpack_from("<BI", packed, at)
        arrays.append(np.frombuffer(packed, _WIDTHS[width], size, at + 5).astype(np.int64))
        at += 5 + size * (1 << width)
    return arrays, at


def pieces(trie: Trie, depth: int) -> Iterator[tuple[bytes, int, list[str], bytes]]:
    """(head, leaves, sources, subtrie) for each run of terms with the same first ``depth`` bytes."""
    if not (terms := trie.terms):
        return
    heads = np.array(terms, f"S{depth}")  # (no term has a zero byte)
    starts = np.concatenate(([0], np.flatnonzero(heads[1:] != heads[:-1]) + 1))
    trie.shared[starts] = 0
    for i, j in zip(starts, [*starts[1:], len(terms)], strict=True):
        a, b = trie.first[i], trie.first[j]
        used, source = np.unique(trie.sources[a:b], return_inverse=True)
        tails = [t[s:] for t, s in zip(terms[i:j], trie.shared[i:j].tolist(), strict=True)]
        sizes = np.fromiter(map(len, tails), np.int64, j - i)
        numbers = _packed(trie.shared[i:j], sizes, trie.docs[i:j], np.diff(trie.first[i : j + 1]), source, trie.counts[a:b])
        yield terms[i][:depth], int(j - i), [trie.names[k] for k in used], numbers + b"".join(tails)


def trie_in(sources: list[str], subtrie: bytes) -> Trie:
    """The trie that ``pieces`` wrote."""
    (shared, sizes, docs, n, source, counts), at = _unpacked(subtrie, 6)
    terms, term = [], b""
    for keep, size in zip(shared.tolist(), sizes.tolist(), strict=True):
        term = term[:keep] + subtrie[at : at + size]
        at += size
        terms.append(term)
    return Trie(terms, shared, docs, np.concatenate(([0], np.cumsum(n))), source, counts, sources)


class Merge:
    """Tries that are added up; memory goes with their distinct terms."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.names: dict[str, int] = {}
        self.docs: list[tuple[np.ndarray, np.ndarray]] = []  # (leaf, documents)
        self.counts: list[tuple[np.ndarray, np.ndarray]] = []  # (leaf << 32 | source, count)

    def add(self, trie: Trie) -> None:
        place = self.place
        leaf = np.fromiter([place.setdefault(term, len(place)) for term in trie.terms], np.int64, len(trie.terms))
        names = np.fromiter([self.names.setdefault(s, len(self.names)) for s in trie.names], np.int64, len(trie.names))
        self.docs.append((leaf, trie.docs))
        self.counts.append((np.repeat(leaf, np.diff(trie.first)) << 32 | names[trie.sources], trie.counts))
        if len(self.docs) >= FOLD:
            self.fold()

    def fold(self) -> None:
        for parts in (self.docs, self.counts):
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, at, np.concatenate([n for _, n in parts]))
            parts[:] = [(keys, sums)]

    def trie(self, least: int) -> Trie:
        """The sum, without the terms of fewer than ``least`` documents."""
        self.fold()
        (_, docs), (keys, counts) = self.docs[0], self.counts[0]
        terms = [t for t in sorted(self.place) if docs[self.place[t]] >= least]
        leaf = np.fromiter(map(self.place.__getitem__, terms), np.int64, len(terms))
        to = np.full(len(docs), -1)
        to[leaf] = np.arange(len(terms))
        new = to[keys >> 32]
        order = np.flatnonzero(new >= 0)[np.argsort(new[new >= 0], kind="stable")]
        first = np.concatenate(([0], np.cumsum(np.bincount(new[order], minlength=len(terms)))))
        return Trie(terms, np.zeros(len(terms), np.int64), docs[leaf], first, (keys & 0xFFFFFFFF)[order], counts[order], list(self.names))


# --- counting and merging ---

PIECES = pa.schema([("lang", pa.string()), ("head", pa.binary()), ("leaves", pa.int64()), ("sources", pa.list_(pa.string())), ("subtrie", pa.binary())])
PIECES_DDL = "lang string, head binary, leaves long, sources array<string>, subtrie binary"
TERMS_DDL = "lang string, term binary, docs long, total long, sources array<string>, counts array<long>"


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 1024) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _counting(most: int, depth: int):
    """The tries of a task's documents, in pieces below prefixes of ``depth`` bytes; out they go whenever ``most`` entries are counted."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        docs: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[tuple]:
            for lang in sorted(docs):
                found, by_source = docs.pop(lang), counts.pop(lang)
                if found:
                    yield from ((lang, *piece) for piece in pieces(trie_of(found, by_source), depth))

        held = 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for lang, source, text in zip(batch.column("lang"), batch.column("source"), texts, strict=True):
                lang, seen = lang.as_py(), set()
                group = counts[lang][source.as_py()]
                held -= len(group)
                for terms in terms_of(text.as_py()):
                    group.update(terms)
                    seen.update(terms)
                held += len(group)
                docs[lang].update(seen)
                if held >= most:
                    yield from _batches(out(), PIECES)
                    held = 0
        yield from _batches(out(), PIECES)

    return counted


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, Trie]]:
    for batch in batches:
        for lang, head, sources, subtrie in zip(*map(batch.column, ("lang", "head", "sources", "subtrie")), strict=True):
            yield lang.as_py(), head.as_py(), trie_in(sources.as_py(), subtrie.as_py())


def _cutting(depth: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(((lang, *piece) for lang, _, trie in _rows(batches) for piece in pieces(trie, depth)), PIECES)

    return cut


def _merging(least: int):
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, _), run in groupby(_rows(batches), lambda row: row[:2]):
            merge = Merge()
            for _, _, trie in run:
                merge.add(trie)
            trie = merge.trie(least)
            if trie.terms:
                total = np.add.reduceat(trie.counts, trie.first[:-1])
                sources = pa.ListArray.from_arrays(pa.array(trie.first, pa.int32()), pa.array(trie.names, pa.string()).take(pa.array(trie.sources)))
                counts = pa.ListArray.from_arrays(pa.array(trie.first, pa.int32()), pa.array(trie.counts))
                whole = pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(trie.terms), pa.string()), pa.array(trie.terms, pa.binary()), pa.array(trie.docs), pa.array(total), sources, counts],
                    ["lang", "term", "docs", "total", "sources", "counts"],
                )
                yield from (whole.slice(at, 8192) for at in range(0, whole.num_rows, 8192))

    return merged


def kept_terms(docs: DataFrame, least_docs: int = 3) -> DataFrame:
    """lang, term (bytes), docs, total, sources, counts of the terms in at least ``least_docs`` documents of their language.

    Written once; rows lie in the order of lang and term.
    """
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    level, depth, closed = written(read.mapInArrow(_counting(HELD, HEAD), PIECES_DDL)), HEAD, []
    while True:
        sums = level.groupBy("lang", "head").agg(F.sum("leaves").alias("n")).where((F.col("n") > MOST_LEAVES) & (F.octet_length("head") == depth))
        full = checkpointed(sums.select("lang", "head"))
        n = full.count()
        if not n:
            break
        keys = ["lang", "head"]
        whole, rest = (level.join(F.broadcast(full), keys, how) if n <= MOST_HEADS else skew_join(level, full, keys, how) for how in ("left_anti", "left_semi"))
        closed.append(whole)
        depth *= 2
        level = written(rest.mapInArrow(_cutting(depth), PIECES_DDL))
    # All pieces of a prefix come to one range, next to each other; ranges are cut between prefixes.
    every = reduce(DataFrame.unionByName, [*closed, level])
    return written(every.repartitionByRange("lang", "head").sortWithinPartitions("lang", "head").mapInArrow(_merging(least_docs), TERMS_DDL))


# --- divergence ---


class Groups(NamedTuple):
    """The groups of a language that a walk looks at."""

    index: dict[str, int]
    sums: np.ndarray  # of counts over the kept terms


def _shares(counts: np.ndarray, sums: np.ndarray | int, n_terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (sum + n_terms)), exactly."""
    if counts.max(initial=0) >= 9_000_000_000:  # the product leaves 64 bits
        return (1 + SCALE * (counts.astype(object) + 1) // (sums + n_terms)).astype(np.int64)
    return 1 + SCALE * (counts + 1) // (sums + n_terms)


def _gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _walk(langs: dict[str, tuple[int, int]], left: dict[str, Groups], right: dict[str, Groups], top: int, terms: bool, cells_at_once: int):
    """Streams kept terms in UTF-8 order; gives rows (lang, source, part, item, value) of what one task has seen.

    ``pair``: sums over its terms for each source in ``left`` and each other one in ``right``.
    ``term``: the best ``top`` terms of each source in ``left``; of equal ones the first stays.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[str, np.ndarray] = {}
        best: dict[str, list[list[tuple[int, bytes]]]] = {}
        floors: dict[str, np.ndarray] = {}
        for batch in batches:
            names, lang_of = np.unique(np.array(batch.column("lang").to_pylist(), dtype=object), return_inverse=True)
            sizes = np.diff(batch.column("sources").offsets.to_numpy())
            row_of = np.repeat(np.arange(batch.num_rows), sizes)
            coded = batch.column("sources").flatten().dictionary_encode()
            counts, codes, totals = batch.column("counts").flatten().to_numpy(), coded.indices.to_numpy(), batch.column("total").to_numpy()
            for k, lang in enumerate(names):
                n_terms, lang_sum = langs[lang]
                a, b, inside = left[lang], right[lang], lang_of[row_of] == k
                place = np.cumsum(lang_of == k) - 1
                cells = []
                for groups in (a, b):
                    to = np.array([groups.index.get(s, -1) for s in coded.dictionary.to_pylist()], np.int64)[codes]
                    cells.append((place[row_of[inside & (to >= 0)]], to[inside & (to >= 0)], counts[inside & (to >= 0)]))
                if lang not in pairs:
                    pairs[lang] = np.zeros((len(a.sums), len(b.sums)), np.int64)
                _add_pairs(pairs[lang], int((lang_of == k).sum()), cells[0], cells[1], a.sums, b.sums, n_terms, cells_at_once)
                if terms:
                    at, group, n = cells[0]
                    q = _shares(totals[lang_of == k], lang_sum, n_terms)[at]
                    p = _shares(n, a.sums[group], n_terms)
                    gain = _gain(p, q)
                    if lang not in best:
                        best[lang], floors[lang] = [[] for _ in a.sums], np.full(len(a.sums), -1)
                    items = batch.column("term").filter(pa.array(lang_of == k))
                    for e in np.flatnonzero((p > q) & (gain > floors[lang][group])).tolist():
                        found = best[lang][group[e]]
                        found.append((-int(gain[e]), items[int(at[e])].as_py()))
                        if len(found) >= 4 * top:
                            found[:] = sorted(found)[:top]
                            floors[lang][group[e]] = -found[-1][0]

        def rows() -> Iterator[tuple]:
            for lang, sums in pairs.items():
                for source, i in left[lang].index.items():
                    for other, j in right[lang].index.items():
                        if source != other:
                            yield lang, source, "pair", other.encode(), int(sums[i, j])
            for lang, lists in best.items():
                for source, i in left[lang].index.items():
                    for value, item in sorted(lists[i])[:top]:
                        yield lang, source, "term", item, -value

        yield from _batches(rows(), WALKED)

    return walk


WALKED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.binary()), ("value", pa.int64())])


def _add_pairs(into: np.ndarray, n: int, left: tuple, right: tuple, left_sums: np.ndarray, right_sums: np.ndarray, n_terms: int, cells: int, width: int = 32) -> None:
    """Adds the gains of ``n`` terms to the matrix of pairs, a block of sources against a block of sources at a time.

    Terms that occur in neither block have one gain for each pair, added at once.
    """
    for i in range(0, len(left_sums), width):
        a = left_sums[i : i + width]
        at_a = (left[1] >= i) & (left[1] < i + width)
        for j in range(0, len(right_sums), width):
            b = right_sums[j : j + width]
            at_b = (right[1] >= j) & (right[1] < j + width)
            seen = np.unique(np.concatenate((left[0][at_a], right[0][at_b])))
            step = max(1, cells // (len(a) * len(b)))
            block = into[i : i + width, j : j + width]
            for k in range(0, len(seen), step):
                some = seen[k : k + step]
                shares = []
                for (at, group, counts), chosen, first, sums in ((left, at_a, i, a), (right, at_b, j, b)):
                    chosen = chosen & (at >= some[0]) & (at <= some[-1])
                    dense = np.zeros((len(some), len(sums)), np.int64)
                    dense[np.searchsorted(some, at[chosen]), group[chosen] - first] = counts[chosen]
                    shares.append(_shares(dense, sums, n_terms))
                block += _gain(shares[0][:, :, None], shares[1][:, None, :]).sum(axis=0)
            if n > len(seen):
                none = [_shares(np.zeros(len(sums), np.int64), sums, n_terms) for sums in (a, b)]
                block += (n - len(seen)) * _gain(none[0][:, None], none[1][None, :])


def divergence(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: how each source of ``docs`` (text, lang, source) diverges.

    Terms are runs of letters and of bytes from 0x80 on, only A to Z lower-cased; a language
    keeps those in at least ``least_docs`` of its documents.  A share is 1 + floor(SCALE *
    (count + 1) / (sum of counts + kept terms)), and p against q gains floor((p - q)^2 / q).
    Part ``pair``: each other source of the language, with the gains of all kept terms added
    up (0 without kept terms), all ranks.  Part ``term``: the kept terms that the source uses
    more than its language does, ranks to ``top``.  Ranks go by value, then by item in UTF-8.

    Null texts, languages and sources are ''; repeated rows are documents of their own; sources
    without terms have pairs; texts are read whole, however long; other columns are ignored;
    an empty table gives no rows.  All arithmetic is exact.
    """
    terms = kept_terms(docs, least_docs)
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("total").alias("lang_sum"))
    used = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("sum"))
    occurring = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = skew_join(skew_join(occurring, used, ["lang", "source"], "left"), langs, ["lang"], "left").fillna(0, ["sum", "n_terms", "lang_sum"])
    groups = checkpointed(groups)
    none = groups.where("n_terms = 0").select("lang", "source")
    if groups.count() > GROUPS:
        nth = grouped_rank(groups.withColumn("all", F.lit(1)), ["all"], [F.col("lang"), F.col("source")], "nth")
        groups = checkpointed(nth.withColumn("block", F.floor((F.col("nth") - 1) / GROUPS)).drop("all", "nth"))
    else:
        groups = groups.withColumn("block", F.lit(0).cast("long"))
    told = groups.where("n_terms > 0")
    ends = told.groupBy("block").agg(F.min("lang").alias("first"), F.max("lang").alias("last")).orderBy("block").collect()  # a row for each GROUPS groups
    found = none.join(none.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    found = found.select("lang", "source", F.lit("pair").alias("part"), F.col("item").cast("binary").alias("item"), F.lit(0).cast("long").alias("value"))
    for a in ends:
        rows = told.where(F.col("block") == a["block"]).collect()  # at most GROUPS rows
        for b in ends:
            if a["first"] > b["last"] or b["first"] > a["last"]:
                continue
            others = rows if a["block"] == b["block"] else told.where(F.col("block") == b["block"]).collect()
            found = found.unionByName(_walked(terms, rows, others, top, a["block"] == b["block"]))
    parts = checkpointed(found)
    sums = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = sums.withColumn("rank", F.row_number().over(order))
    best = parts.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.unionByName(best).withColumn("item", F.col("item").cast("string"))


def _walked(terms: DataFrame, rows: list[Row], others: list[Row], top: int, own: bool) -> DataFrame:
    sides = []
    for side in (rows, others):
        by_lang: dict[str, list[Row]] = defaultdict(list)
        for row in side:
            by_lang[row["lang"]].append(row)
        sides.append({lang: Groups({r["source"]: k for k, r in enumerate(found)}, np.array([r["sum"] for r in found], np.int64)) for lang, found in by_lang.items()})
    langs = {r["lang"]: (r["n_terms"], r["lang_sum"]) for r in rows if r["lang"] in sides[1]}
    read = terms.where(F.col("lang").isin(list(langs))).select("lang", "term", "total", "sources", "counts")
    return read.mapInArrow(_walk(langs, *sides, top, own, CELLS), "lang string, source string, part string, item binary, value long")
