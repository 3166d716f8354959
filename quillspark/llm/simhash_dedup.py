"""Near-duplicate detection: SimHash fingerprints compared bit-sliced.

Fingerprints that may lie within the radius meet in buckets of equal bits.  A block of
whole buckets is stored as vertical bit planes; one pass over the planes updates the
distances of a tile of fingerprints to all of the block with carry-save counters, and a
tile is abandoned once all its distances exceed the radius.  Blocks answer with a
spanning forest, never with all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import checkpointed, connected_components, skew_join, small

SEED = 42
RADIUS = 3
SIGNATURE = tuple(range(42, 58))  # seeds of the sixteen words of a similarity signature
FORESTS = 3  # spanning forests of each bucket whose pairs are held against their exact similarity first
COLUMNS = 4096  # shingles of a bucket that are counted at once
FEW = 32  # shingles under which the angle tells too little, and every pair that shares a key is a candidate
BANDS, BAND_MINIMA = 16, 4  # at a similarity of 0.8, all bands miss one pair in 4,000
HASHES_AT_ONCE = 1 << 17
BLOCK = 2048  # fingerprints compared with each other at once
TILE = 256
_LANES = np.uint64(0x0101010101010101)
_ORDERS = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2**63, (BANDS, BAND_MINIMA, 2), np.uint64) * np.uint64(2) + np.uint64(1)


# --- fingerprints -----------------------------------------------------------------------------


def shingles(text: bytes, words: int) -> list[bytes]:
    """Runs of ``words`` words of ``text``, A-Z lower-cased, joined by spaces; all words where they are fewer."""
    found = text.lower().split()
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    line, ends, at = b" ".join(found), [], -1
    for w in found:
        ends.append(at := at + 1 + len(w))
    starts = [0, *[e + 1 for e in ends]]
    return [line[s:e] for s, e in zip(starts, ends[words - 1 :], strict=False)]


def majorities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each of the neighbouring groups of ``sizes`` hashes: the number whose bits are set in over half of them (0 for none)."""
    out, n = np.zeros(len(sizes), np.uint64), sizes[sizes > 0]
    if not len(n):
        return out
    parts = -(-n // 255)  # eight counters of a byte in a word, 255 hashes at most before they are emptied
    groups = np.cumsum(parts) - parts
    starts = np.repeat(np.cumsum(n) - n, parts) + 255 * (np.arange(parts.sum()) - np.repeat(groups, parts))
    counts = np.empty((len(n), 64), np.int64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, starts)
        counts[:, k::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), groups, axis=0, dtype=np.int64)
    out[sizes > 0] = np.packbits(counts * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def band_keys(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """BANDS keys for each of the neighbouring groups of ``sizes`` hashes, each of BAND_MINIMA least hashes (0 for no hashes).

    Two groups share a key with the probability of their Jaccard similarity to the power of BAND_MINIMA.
    """
    out, n = np.zeros((len(sizes), BANDS), np.uint64), sizes[sizes > 0]
    if not len(n):
        return out
    starts = np.cumsum(n) - n
    for band in range(BANDS):
        key = np.full(len(n), band + 1, np.uint64)
        for flip, odd in _ORDERS[band]:
            key = _mixed(key ^ np.minimum.reduceat((hashes ^ flip) * odd, starts), SEED)
        out[sizes > 0, band] = key
    return out


def fingerprints(docs: DataFrame, words: int = 3, seeds: tuple[int, ...] = (SEED,), repeats: bool = True) -> DataFrame:
    """doc_id, fp (array<long>: a fingerprint for each seed), keys, shingles of each row of ``docs`` (doc_id, text).

    A text without words has fingerprints of zero, as a null text has. With repeats false
    a shingle counts once, keys has the text's bands and shingles the set of its shingles,
    as numbers of 32 bits; else both are empty.  Seeds after the first mix the first one's
    hashes anew.
    """

    def found(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        sizes, joined = np.array(list(map(len, hashes)), np.int64), np.concatenate(hashes)
        fps = [majorities(joined if k == 0 else _mixed(joined, seed), sizes) for k, seed in enumerate(seeds)]
        keys = np.zeros((len(sizes), 0), np.uint64) if repeats else band_keys(joined, sizes)
        return np.column_stack(fps), keys, [] if repeats else [np.unique((h >> np.uint64(32)).astype(np.uint32)) for h in hashes]

    def lists(parts: list[np.ndarray], rows: int) -> pa.Array:
        flat = np.concatenate(parts) if parts else np.zeros((0, 1), np.uint64)
        ends = np.arange(rows + 1, dtype=np.int32) * flat.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.reshape(-1).view(np.int64)))

    def sets(parts: list[list[np.ndarray]], rows: int) -> pa.Array:
        each = [s for part in parts for s in part] or [np.zeros(0, np.uint32)] * rows
        ends = np.cumsum([0, *map(len, each)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint32), *each]).view(np.int32)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = []
            pending, size = [], 0
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                h = np.array([xxhash.xxh64_intdigest(s, seeds[0]) for s in shingles(raw or b"", words)], np.uint64)
                pending.append(h if repeats else np.unique(h))
                size += len(h)
                if size >= HASHES_AT_ONCE:
                    out.append(found(pending))
                    pending, size = [], 0
            if pending:
                out.append(found(pending))
            n = batch.num_rows
            columns = [batch.column("doc_id"), lists([f for f, _, _ in out], n), lists([k for _, k, _ in out], n), sets([s for _, _, s in out], n)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "keys", "shingles"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(rows, "doc_id long, fp array<long>, keys array<long>, shingles array<int>")


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


# --- comparison -------------------------------------------------------------------------------


def near_rows(words: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tiles (rows, near) of the rows of ``words`` (n x words, uint64): near[k, j] is one more than the distance of
    rows[k] < j where that is within ``radius`` bits, else 0.

    Rows without a near one do not appear.
    """
    n, width = words.shape
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    lanes = -(-n // 64)
    padded = np.zeros((width * 64, lanes * 64), np.uint8)
    padded[:, :n] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)  # bit b of all fingerprints, side by side
    order = np.argsort(np.abs(bits.mean(axis=0) - 0.5), kind="stable")  # the planes that tell most apart come first
    levels = max(1, radius.bit_length())
    for start in range(0, n, TILE):
        rows = np.arange(start, min(n, start + TILE))
        first = start // 64  # earlier fingerprints have met these rows already
        others = np.arange(first * 64, lanes * 64)[None, :]
        over = np.packbits((others <= rows[:, None]) | (others >= n), axis=1, bitorder="little").view(np.uint64)
        counters = [np.zeros_like(over) for _ in range(levels)]
        for step, b in enumerate(order, 1):
            carry = planes[b, first:][None, :] ^ (np.uint64(0) - bits[rows, b].astype(np.uint64))[:, None]
            for c in counters:
                carry, c[...] = carry & c, carry ^ c
            over |= carry
            if step % 8 == 0 and step > radius:
                alive = (~_exceeds(counters, over, radius)).any(axis=1)
                if alive.mean() < 0.7:
                    rows, over, counters = rows[alive], over[alive], [c[alive] for c in counters]
                    if not len(rows):
                        break
        if len(rows):
            within = ~_exceeds(counters, over, radius)
            some = within.any(axis=1)
            if some.any():
                full = np.zeros((int(some.sum()), n), np.uint16)
                lanes_of = lambda plane: np.unpackbits(plane[some].view(np.uint8), axis=1, bitorder="little")[:, : n - first * 64]
                near = full[:, first * 64 :]
                for level, c in enumerate(counters):
                    near += lanes_of(c).astype(np.uint16) << np.uint16(level)
                near += np.uint16(1)
                near *= lanes_of(within)
                yield rows[some], full


def _exceeds(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is above ``radius``: a bit-sliced comparison from the highest plane down."""
    above, equal = over.copy(), ~over
    for level in range(len(counters) - 1, -1, -1):
        if radius >> level & 1:
            equal = equal & counters[level]
        else:
            above |= equal & counters[level]
            equal = equal & ~counters[level]
    return above


def _forest(ids: np.ndarray, words: np.ndarray, radius: int, parent: dict[int, int]) -> None:
    """Joins in ``parent`` (a union-find over ids) what lies within the radius in one block."""
    label = np.arange(len(ids))
    for rows, near in near_rows(words, radius):
        for i, others in zip(rows, near > 0, strict=True):
            met = np.append(label[others], label[i])
            low = met.min()
            if (met != low).any():
                label[np.isin(label, met)] = low
    for i in np.flatnonzero(label != np.arange(len(ids))):
        a, b = _root(parent, int(ids[i])), _root(parent, int(ids[label[i]]))
        if a != b:
            parent[max(a, b)] = min(a, b)


def _root(parent: dict[int, int], x: int) -> int:
    while (up := parent.setdefault(x, x)) != x:
        parent[x] = x = parent.setdefault(up, up)
    return x


def least_forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the edges i-j between n nodes, listed from the nearest on, make the spanning forest of the nearest."""
    label, live, chosen = np.arange(n), np.arange(len(i)), [np.zeros(0, np.intp)]
    while True:
        a, b = label[i[live]], label[j[live]]
        apart = a != b
        live, a, b = live[apart], a[apart], b[apart]
        if not len(live):
            return np.concatenate(chosen)
        best = np.full(n, len(i))  # the nearest edge that leaves each tree
        np.minimum.at(best, a, live)
        np.minimum.at(best, b, live)
        picked = np.unique(best[best < len(i)])
        chosen.append(picked)
        a, b = label[i[picked]], label[j[picked]]
        while (a != b).any():
            low, parent = np.minimum(a, b), np.arange(n)
            np.minimum.at(parent, a, low)
            np.minimum.at(parent, b, low)
            while (parent[parent] != parent).any():
                parent = parent[parent]
            label, a, b = parent[label], parent[a], parent[b]


def _nearest(keys: np.ndarray, ids: np.ndarray, words: np.ndarray, radius: int, forests: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges (a, b) of one block, those of its buckets' first spanning forests, and (key, id) of the rows that have more pairs.

    The first forest is that of the nearest pairs within the radius, each other that of the
    pairs the ones before left.
    """
    i, j, distance = _near_pairs(keys, words, radius)
    order = np.lexsort((j, i, distance))
    i, j, a, b = i[order], j[order], [ids[:0]], [ids[:0]]
    for _ in range(forests):
        chosen = least_forest(len(ids), i, j)
        a.append(ids[i[chosen]])
        b.append(ids[j[chosen]])
        i, j = np.delete(i, chosen), np.delete(j, chosen)
    rest = np.unique(np.concatenate((i, j)))
    return np.concatenate(a), np.concatenate(b), keys[rest], ids[rest]


def _near_pairs(keys: np.ndarray, words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of the rows of one key within the radius."""
    found = [(np.zeros(0, np.intp), np.zeros(0, np.intp), np.zeros(0, np.uint16))]
    for rows, near in near_rows(words, radius):
        k, j = np.nonzero(near)
        same = keys[rows[k]] == keys[j]
        found.append((rows[k][same], j[same], near[k[same], j[same]]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def bucket_edges(keyed: DataFrame, radius: int, forests: int = 0) -> DataFrame:
    """Edges (a, b) that join all rows (key, id, fp) within ``radius`` bits of each other that share a key.

    Buckets must be bounded: each is compared whole, in blocks that hold several; rows
    alone in their bucket meet none. Only ids, fingerprints and a forest of a task's rows
    are in memory.  With ``forests``, edges are pairs within the radius: those of so many
    forests of each bucket (``_nearest``), and a row (id, null, key) tells of one that has
    more there; there keys below zero are those of buckets without a radius, whose pairs
    are all near.  Else they join a task's rows to the least of each component.
    """

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        keys, ids, words = np.zeros(0, np.int64), np.zeros(0, np.int64), None

        def settle(last: bool) -> None:
            nonlocal keys, ids, words
            while len(keys) and (last or keys[0] != keys[-1]):
                ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys) if last else 0)
                ends = ends[ends > 0]
                cut = ends[max(0, np.searchsorted(ends, BLOCK, side="right") - 1)]
                free = forests > 0 and keys[0] < 0
                if free and keys[cut - 1] >= 0:
                    cut = np.searchsorted(keys, 0)
                elif cut < min(BLOCK, len(keys)) // 2 and not last and len(keys) < BLOCK:
                    return
                if cut > 1 and forests:
                    pairs.append(_nearest(keys[:cut], ids[:cut], words[:cut], 64 * words.shape[1] if free else radius, forests))
                elif cut > 1:
                    _forest(ids[:cut], words[:cut], radius, parent)
                keys, ids, words = keys[cut:], ids[cut:], words[cut:]

        def drop_single(last: bool) -> None:
            nonlocal keys, ids, words
            same = keys[1:] == keys[:-1]
            met = np.append(False, same) | np.append(same, False)
            met[-1:] |= not last  # the last bucket may go on
            keys, ids, words = keys[met], ids[met], words[met]

        def found() -> Iterator[pa.RecordBatch]:
            for a, b, key, more in pairs:
                yield _edge_batch(a, b, None)
                yield _edge_batch(more, None, key)
            pairs.clear()

        for batch in batches:
            k, i = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id"))
            w = _words_of(batch)
            keys, ids = np.concatenate([keys, k]), np.concatenate([ids, i])
            words = w if words is None else np.concatenate([words, w])
            drop_single(last=False)
            if len(keys) >= 4 * BLOCK:
                settle(last=False)
                yield from found()
        if len(keys):
            drop_single(last=True)
        settle(last=True)
        yield from found()
        joined = [(x, _root(parent, x)) for x in list(parent)]
        joined = [p for p in joined if p[0] != p[1]]
        yield _edge_batch(np.array([x for x, _ in joined], np.int64), np.array([r for _, r in joined], np.int64), None)

    out = keyed.repartition("key").sortWithinPartitions("key", "id").select("key", "id", "fp").mapInArrow(edges, "a long, b long, key long")
    return out if forests else out.select("a", "b")


def _edge_batch(*columns: np.ndarray | None) -> pa.RecordBatch:
    rows = max(len(c) for c in columns if c is not None)
    return pa.RecordBatch.from_arrays([pa.nulls(rows, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in columns], ["a", "b", "key"])


def _words_of(batch: pa.RecordBatch) -> np.ndarray:
    n = batch.num_rows
    return batch.column("fp").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(n, -1) if n else np.zeros((0, 1), np.uint64)


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share."""
    shared, row = np.zeros((len(sets), len(sets)), np.float32), np.repeat(np.arange(len(sets)), list(map(len, sets)))
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times[column] > 1
    row, column = row[several], np.unique(column[several], return_inverse=True)[1]
    for at in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        some = (column >= at) & (column < at + COLUMNS)
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[row[some], column[some] - at] = 1
        shared += has @ has.T
    return shared


def exact_bucket_edges(keyed: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Edges (a, b) that connect all rows (key, id, fp, label, shingles) which share a key, lie within ``radius`` and have a Jaccard similarity of ``similarity``.

    Rows of one label count as connected.  A bucket's exact similarities are counted in its
    own task, so no pair leaves it but those that connect.  Buckets must be bounded.
    """

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                words, held = _words_of(batch), batch.column("shingles")
                for at, (key, i, label) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "id", "label")), strict=True)):
                    yield key, i, label, words[at], held[at].values.to_numpy(zero_copy_only=False)

        for key, run in groupby(rows(), lambda r: r[0]):
            _, ids, labels, words, sets = zip(*run, strict=True)
            ids, labels, sizes = np.array(ids), np.unique(labels, return_inverse=True)[1], np.array(list(map(len, sets)))
            if labels.max() == 0:
                continue
            i, j, _ = _near_pairs(np.zeros(len(ids)), np.stack(words), 64 * len(words[0]) if key < 0 else radius)
            apart = labels[i] != labels[j]
            i, j = i[apart], j[apart]
            both = _shared(sets)[i, j]
            alike = both >= similarity * (sizes[i] + sizes[j] - both) - 1e-6
            i, j = i[alike], j[alike]
            chosen = least_forest(labels.max() + 1, labels[i], labels[j])
            yield pa.RecordBatch.from_arrays([pa.array(ids[i[chosen]], pa.int64()), pa.array(ids[j[chosen]], pa.int64())], ["a", "b"])

    dealt = keyed.repartition("key").sortWithinPartitions("key").select("key", "id", "fp", "label", "shingles")
    return dealt.mapInArrow(edges, "a long, b long")


def nearest_links(keyed: DataFrame, radius: int, sets: DataFrame | None, similarity: float) -> tuple[DataFrame, DataFrame | None]:
    """Edges (a, b) of rows (key, id, fp) that share a key and lie within ``radius``, and the rows (key, id) that have more such pairs.

    Without ``sets`` the edges connect all of them, and no row has more.  With them, edges
    are the nearest pairs of each bucket that are ``similar``.
    """
    if sets is None:
        return checkpointed(bucket_edges(keyed, radius)), None
    offered = checkpointed(bucket_edges(keyed, radius, FORESTS))
    passed = checkpointed(similar(offered.where("key is null").select("a", "b"), sets, similarity))
    return passed, offered.where("key is not null").select("key", F.col("a").alias("id"))


def exact_links(more: DataFrame, linked: DataFrame, fps: DataFrame, radius: int, sets: DataFrame, similarity: float) -> DataFrame | None:
    """Edges (a, b) that connect all rows (key, id) in ``more`` which share a key and are alike, but for those ``linked`` (id, component) already; None if there is nothing left."""
    rest = checkpointed(skew_join(more, linked.withColumnRenamed("component", "label"), ["id"], "left").withColumn("label", F.coalesce("label", "id")))
    several = rest.groupBy("key").agg((F.min("label") != F.max("label")).alias("several")).where("several").select("key")
    rest = checkpointed(skew_join(rest, several, ["key"], "left_semi"))
    if rest.isEmpty():
        return None
    asked = skew_join(skew_join(fps, rest.select("id").distinct(), ["id"], "left_semi"), sets.select("id", "shingles"), ["id"], "inner")
    return checkpointed(exact_bucket_edges(skew_join(rest, checkpointed(asked), ["id"], "inner"), radius, similarity))


# --- exact search within a small radius ---------------------------------------------------------


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def links_within(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect all rows (id, fp long; fps distinct) within ``radius`` bits of each other.

    Two fingerprints within the radius agree on one of radius + 1 parts of their bits, and
    again on one of as many parts of the rest.  Buckets of over half a block are divided so,
    as often as it takes; since fingerprints are distinct, those that agree on all but 15
    bits are at most 2^15, so no bucket stays unbounded, whatever the data.
    """
    parts = radius + 1
    level = fps.select("id", "fp", F.lit(0).cast("long").alias("known"), F.lit(0).cast("long").alias("key"))
    edges: DataFrame | None = None
    depth = 0
    while True:
        keys = []
        # ``known`` has the bits that a bucket's rows share already; each part is a run of the others.
        for part in range(parts):
            mask = _next_mask(F.col("known"), part, parts, depth)
            keys.append(F.struct(mask.alias("mask"), F.col("known").bitwiseOR(mask).alias("now")))
        wide = level.withColumn("p", F.explode(F.array(*keys)))
        wide = wide.select("id", "fp", F.col("p.now").alias("known"), F.xxhash64("key", "p.mask", F.col("fp").bitwiseAND(F.col("p.mask"))).alias("key"))
        wide = checkpointed(wide) if depth else wide
        full = wide.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK // 2).select("key")
        full = checkpointed(full)
        last = depth >= 4 or full.isEmpty()
        if last:
            ready = wide
        else:
            marked = checkpointed(skew_join(wide, full.withColumn("full", F.lit(True)), ["key"], "left"))
            ready = marked.where("full is null")
        found = bucket_edges(ready.select("key", "id", F.array("fp").alias("fp")), radius)
        edges = found if edges is None else edges.unionByName(found)
        if last:
            return edges
        level, depth = marked.where("full").select("id", "fp", "known", "key"), depth + 1


def _masks(radius_parts: int, depth: int) -> dict[int, list[int]]:
    """For each set of known bits at ``depth``: the masks of its parts."""
    known = {0: 0}
    for d in range(depth + 1):
        out: dict[int, list[int]] = {}
        for k in known:
            bits = [b for b in range(64) if not k >> b & 1]
            cuts = [round(len(bits) * i / radius_parts) for i in range(radius_parts + 1)]
            out[k] = [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]
        if d == depth:
            return out
        known = {k | m: 0 for k, masks in out.items() for m in masks}
    return {}


def _next_mask(known: Column, part: int, parts: int, depth: int) -> Column:
    table = _masks(parts, depth)
    if depth == 0:
        return F.lit(_signed(table[0][part]))
    pairs = [F.lit(_signed(x)) for k, masks in table.items() for x in (k, masks[part])]
    return F.element_at(F.create_map(*pairs), known)


def signature_links(sigs: DataFrame, radius: int, sets: DataFrame | None = None, similarity: float = 0.8) -> DataFrame:
    """Edges (a, b) that connect all rows (id, fp: array of 64-bit words, keys; fps distinct) within ``radius`` bits that share a key.

    With ``sets`` (id, shingles), links have an exact similarity too: the nearest pairs of
    each bucket are held against it first, which connects most (``nearest_links``), and rows that
    have more pairs are compared whole at last, unless they are connected (``exact_links``).
    Keys shared by more than half a block of rows are dealt into salted blocks; then what
    each block found alike is represented by one row, and the representatives meet again,
    as long as that joins more.  This only saves work: at last all rows of these keys that
    are not connected yet are compared across the blocks.
    """
    wide = sigs.select("id", "fp", F.explode("keys").alias("key"))
    full = _crowded(wide)
    crowded = not full.isEmpty()
    found, more = nearest_links(_dealt(wide, full), radius, sets, similarity)
    edges = found
    if crowded:
        held = level = checkpointed(skew_join(wide, full.select("key"), ["key"], "left_semi"))
        inside = held.select(F.col("id").alias("to")).distinct()
        before = held.count()
        while not full.isEmpty():
            # A row that was joined to one of a smaller id here is stood for by it, or by what stands for that.
            joined = found.where("a <> b").select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("to"))
            level = checkpointed(skew_join(level, skew_join(joined, inside, ["to"], "left_semi").select("id").distinct(), ["id"], "left_anti"))
            rows = level.count()
            if rows == before:
                break
            before, full = rows, _crowded(level)
            found, _ = nearest_links(_dealt(level, full), radius, sets, similarity)
            edges = edges.unionByName(found)
    elif more is None or more.isEmpty():
        return edges
    linked = connected_components(edges)
    if crowded:
        found, further = nearest_links(_across_blocks(held, linked), radius, sets, similarity)
        edges = edges.unionByName(found)
        more = more if further is None else more.unionByName(further)
    rest = None if more is None else exact_links(more, linked, sigs.select("id", "fp"), radius, sets, similarity)
    return edges if rest is None else edges.unionByName(rest)


def _like(key: Column, other: str = "key") -> Column:
    """A key of the same side of zero as ``other``."""
    return F.when(F.col(other) < 0, key.bitwiseOR(F.lit(-(2**63)))).otherwise(key.bitwiseAND(F.lit(2**63 - 1)))


def _crowded(wide: DataFrame) -> DataFrame:
    """key, blocks of the keys of more than half a block of rows."""
    full = wide.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK // 2)
    return checkpointed(full.select("key", F.ceil(F.col("n") / (BLOCK // 2)).alias("blocks")))


def _dealt(wide: DataFrame, full: DataFrame) -> DataFrame:
    """``wide`` with the rows of each of the ``full`` keys dealt into blocks."""
    if full.isEmpty():
        return wide
    salt = F.pmod(F.xxhash64("id", F.lit(BANDS)), F.coalesce("blocks", F.lit(1)).cast("long"))
    return skew_join(wide, full, ["key"], "left").withColumn("key", _like(F.xxhash64("key", salt))).drop("blocks")


def _across_blocks(held: DataFrame, linked: DataFrame) -> DataFrame:
    """Buckets (key, id, fp) in which all rows of ``held`` that share a key meet, but for those that are in one component of ``linked``.

    Large components have blocks of their own, the others are pooled whole.  Every two
    blocks of a key meet, and each pool meets itself, unless one component has both.
    """
    half = BLOCK // 2
    rows = skew_join(held, linked, ["id"], "left").withColumn("component", F.coalesce("component", "id"))
    sizes = checkpointed(rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")))
    large = F.col("n") > half // 4
    pools = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("components"), F.sum(F.when(~large, F.col("n"))).alias("pooled")).where("components > 1")
    sizes = skew_join(sizes, checkpointed(pools), ["key"], "inner").select(
        "key", "component", F.when(large, F.col("component")).alias("owner"), F.ceil(F.when(large, F.col("n")).otherwise(F.col("pooled")) / half).alias("blocks")
    )
    salt = F.pmod(F.xxhash64(F.when(F.col("owner").isNull(), F.col("component")).otherwise(F.col("id")), F.lit(BANDS)), F.col("blocks"))
    rows = skew_join(rows, checkpointed(sizes), ["key", "component"], "inner")
    rows = checkpointed(rows.select("key", "id", "fp", "owner", F.xxhash64("owner", salt).alias("block")))
    blocks = checkpointed(rows.select("key", "owner", "block").distinct())
    others = blocks.select("key", F.col("owner").alias("owner_b"), F.col("block").alias("block_b"))
    pairs = skew_join(blocks, others, ["key"], "inner").where("block < block_b and not owner <=> owner_b or block <= block_b and owner is null and owner_b is null")
    pairs = pairs.withColumn("pair", _like(F.xxhash64("key", "block", "block_b")))
    sides = pairs.select("key", "block", "pair").unionByName(pairs.select("key", F.col("block_b").alias("block"), "pair")).distinct()
    return skew_join(rows, sides, ["key", "block"], "inner").select(F.col("pair").alias("key"), "id", "fp")


def similar(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs ``edges`` (a, b) whose ``sets`` (id, shingles) have a Jaccard similarity of ``similarity`` or more."""
    pairs = checkpointed(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    held = checkpointed(skew_join(sets.select("id", "shingles"), asked, ["id"], "left_semi"))
    pairs = skew_join(pairs, held.select(F.col("id").alias("a"), F.col("shingles").alias("x")), ["a"], "inner")
    pairs = skew_join(pairs, held.select(F.col("id").alias("b"), F.col("shingles").alias("y")), ["b"], "inner")
    both, all_of_both = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    return pairs.where(both >= similarity * (all_of_both - both) - 1e-9).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, slack: float = 0.045) -> DataFrame:
    """doc_id, group_id, kept of each row of ``docs`` (doc_id, text) that has words.

    Documents are linked when the Jaccard similarity of their sets of ``words``-word shingles
    (a shorter text is one shingle) is ``similarity`` or more.  Candidates share the least of
    their shingles' hashes in one of BANDS ways, and sixteen SimHash words of theirs lie
    within the angle of that similarity, widened by ``slack`` as a share of the bits (four
    standard errors), if both have FEW shingles or more; nearest first, they are then held
    against the exact similarity, until all that pass are connected.  One
    document of each group stays, that of the smallest doc_id (null last); of rows that
    repeat a doc_id and its text all stay or go.  Texts without words, null ones too, are
    in no row; very long texts are read whole; an empty table gives no rows; other columns
    are ignored.
    """
    cosine = 2 * similarity / (1 + similarity)
    radius = int(64 * len(SIGNATURE) * (float(np.arccos(cosine)) / np.pi + slack))
    found = fingerprints(docs.where(F.col("text").rlike("[^\\x20\\x09-\\x0D]")), words, SIGNATURE, repeats=False)
    found = checkpointed(found.withColumn("row_id", F.monotonically_increasing_id()))
    nodes = checkpointed(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min("row_id").alias("id"), F.min("keys").alias("keys"), F.min(F.size("shingles")).alias("size")))
    sets = found.select(F.col("row_id").alias("id"), "shingles")
    # A pair of which one has under FEW shingles meets under a key below zero, which asks for no angle; all others under one above.
    below, above = (F.transform("keys", lambda k: _like(k, side)) for side in ("minus", "plus"))
    keys = F.concat(F.when(F.col("size") * similarity < FEW, below).otherwise(F.array()), F.when(F.col("size") >= FEW, above).otherwise(F.array()))
    sided = nodes.withColumns({"minus": F.lit(-1), "plus": F.lit(1)}).select("id", "fp", keys.alias("keys"))
    linked = connected_components(signature_links(sided, radius, sets, similarity))
    groups = skew_join(nodes.drop("keys", "size"), linked, ["id"], "left").withColumn("component", F.coalesce("component", "id"))
    smallest = groups.groupBy("component").agg(F.min("first").alias("group_id"))
    classes = skew_join(groups.select("fp", "component"), smallest, ["component"], "inner").select("fp", "group_id")
    return skew_join(found.select("doc_id", "fp"), classes, ["fp"], "inner").select("doc_id", "group_id", F.col("doc_id").eqNullSafe(F.col("group_id")).alias("kept"))


def keep_one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; texts without words all stay, as in ``near_duplicates``.

    Rows of a null doc_id stay or go together; very long texts are read whole; an empty table gives no rows.
    """
    decided = near_duplicates(docs, words, similarity)
    dropped = decided.groupBy("doc_id").agg(F.max("kept").alias("stays")).where("not stays").select("doc_id")
    return skew_join(docs, dropped, ["doc_id"], "left_anti")


def near_components(docs: DataFrame, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest
    doc_id reachable.  Texts without words, null ones too, have fingerprint zero and link
    like any other.  Rows of equal fingerprints are one node; other columns are ignored;
    an empty table gives no rows.
    """
    found = checkpointed(fingerprints(docs, words).select("doc_id", F.col("fp")[0].alias("fp")))
    nodes = checkpointed(found.groupBy("fp").agg(F.min("doc_id").alias("first")).withColumn("id", F.monotonically_increasing_id()))
    linked = connected_components(links_within(nodes.select("id", "fp"), radius))
    groups = skew_join(nodes, linked, ["id"], "left").withColumn("component", F.coalesce("component", "id"))
    smallest = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = skew_join(groups.select("fp", "component"), smallest, ["component"], "inner").select("fp", "component_id")
    out = skew_join(found, classes, ["fp"], "inner")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
