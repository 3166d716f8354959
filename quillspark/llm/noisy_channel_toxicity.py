"""Toxicity: texts are restored through a noisy channel, then scored.

Words written in leetspeak, spaced out or drawn out are lattices of characters.  The
best path under a character language model of the whole corpus, found by Viterbi search,
restores them.  What words and word beginnings tell about the label is counted on a
bounded sample of labelled rows, and a logistic curve turns a text's most telling words
into a score.
"""

from __future__ import annotations

import heapq
import math
import re
import string
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import checkpointed, skew_join, small

#: Labelled rows that the classifier is fitted on, at most: those of the smallest hashes.
SAMPLE = 20_000
#: Word beginnings that are features, besides the whole word.
BEGINNINGS = (3, 4, 5, 6, 7)
LEAST_TOXIC = 4
TELLING = 1.0
CACHED_WORDS = 150_000

# Characters and the letters they stand for in leetspeak.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "&": "a",
}
_LETTERS = string.ascii_lowercase + "".join(chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha())
_CLASS = np.zeros(256, np.int32)
_CLASS[[ord(c) for c in _LETTERS]] = np.arange(1, len(_LETTERS) + 1)
_NUMBER = {c: k for k, c in enumerate(_LETTERS, 1)}
CLASSES = len(_LETTERS) + 1  # 0: whatever is no letter

_SPACED = re.compile(r"(?<!\S)\S(?:[ .\-_*]\S){3,}(?!\S)")
_DRAWN_OUT = re.compile(r"(.)\1\1")
_EDGE = string.punctuation + "¡¿«»…"


# --- the character language model -----------------------------------------------------------------


def trigram_counts(docs: DataFrame) -> DataFrame:
    """trigram, n: how often each three classes of characters follow each other in all texts of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in small(batches):
            joined = "  ".join(t for t in batch.column("text").to_pylist() if t).lower().encode("latin-1", "replace")
            for at in range(0, max(0, len(joined) - 2), 1 << 22):
                k = _CLASS[np.frombuffer(joined[at : at + (1 << 22) + 2], np.uint8)]
                if len(k) > 2:
                    total += np.bincount((k[:-2] * CLASSES + k[1:-1]) * CLASSES + k[2:], minlength=CLASSES**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["trigram", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "trigram long, n long")
    return counted.groupBy("trigram").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) for all classes: trigrams backed off to bigrams and letters. Its size is that of the alphabet cubed."""
    n = np.zeros(CLASSES**3)
    for row in trigram_counts(docs).collect():  # CLASSES ** 3 rows at most
        n[row["trigram"]] = row["n"]
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    one = (n.sum(axis=(0, 1)) + 1) / (n.sum() + CLASSES)
    pairs = n.sum(axis=0)
    two = (pairs + 5 * one) / (pairs.sum(axis=1, keepdims=True) + 5)
    three = (n + 5 * two[None]) / (n.sum(axis=2, keepdims=True) + 5)
    return np.log(three).astype(np.float32)


# --- decoding ---------------------------------------------------------------------------------------


def arcs(word: str) -> list[tuple[int, int, str, float]]:
    """The lattice of a lower-case word: (from, to, letters, log probability of being written so)."""
    found, i = [], 0
    while i < len(word):
        c, j = word[i], i + 1
        while j < len(word) and word[j] == c:
            j += 1
        readings = [(c, 0.0)] if c in _NUMBER else [(r, -1.0) for r in LEET.get(c, "")]
        for letter, cost in readings:
            found += [(k, k + 1, letter, cost) for k in range(i, j)]
            if j - i > 1:
                found.append((i, j, letter, cost - 1.5))
            if j - i > 2:
                found.append((i, j, letter * 2, cost - 1.5))
        if c not in _NUMBER:
            found += [(k, k + 1, "", -2.5 if readings else -0.5) for k in range(i, j)]
        i = j
    return found


def restore(word: str, model: np.ndarray) -> str:
    """The likeliest letters behind a lower-case word: Viterbi search over its lattice, states being the last two letters.

    Of equally likely readings the first by the alphabet wins.  Time and memory grow with
    the length of the word alone.
    """
    leaving: dict[int, list] = {}
    for start, to, letters, cost in arcs(word):
        leaving.setdefault(start, []).append((to, letters, cost))
    best: dict[int, dict] = {0: {(0, 0): (0.0, None)}}  # at each place, of each state: its score, and (the entry before, letters)
    for at in range(len(word)):
        for (a, b), entry in best.pop(at, {}).items():
            for to, letters, cost in leaving.get(at, ()):
                x, y, s = a, b, entry[0] + cost
                for letter in letters:
                    k = _NUMBER[letter]
                    s += float(model[x, y, k])
                    x, y = y, k
                states = best.setdefault(to, {})
                if s > states.get((x, y), (-math.inf,))[0]:
                    states[x, y] = (s, (entry, letters) if letters else entry[1])
    ends = [(s + float(model[a, b, 0]), before) for (a, b), (s, before) in best.get(len(word), {}).items()]
    top = max((s for s, _ in ends), default=0.0)
    return min((_read(before) for s, before in ends if s == top), default="")


def _read(before: tuple | None) -> str:
    letters = []
    while before is not None:
        letters.append(before[1])
        before = before[0][1]
    return "".join(reversed(letters))


def restorer(model: np.ndarray) -> Callable[[str], str]:
    """A function from a lower-case word to its restored letters; plain words have one path and are their own."""

    def word(raw: str) -> str:
        inner = raw.strip(_EDGE)
        if inner.isalpha() and not _DRAWN_OUT.search(inner):
            return inner
        if any(c.isalpha() for c in raw):
            return restore(raw if len(inner) < 2 or raw[:1] in LEET or raw[-1:] in LEET and not raw.endswith(raw[-1] * 2) else inner, model)
        return ""

    return word


def words_of(text: str) -> set[str]:
    """The distinct lower-case words of a text; letters that stand alone in a row of four or more count as one word too."""
    low = text.lower()
    found = set(low.split())
    for spaced in _SPACED.findall(low):
        found.add(re.sub(r"[\s.\-_*]", "", spaced))
    return found


def features(word: str) -> list[str]:
    return [f"={word}", *[word[:k] for k in BEGINNINGS if len(word) >= k]] if len(word) > 2 else []


# --- what tells toxic texts ---------------------------------------------------------------------------


def _sketch(text: str) -> int:
    """Equal for copies and, mostly, for near copies: the least hash of three words in a row."""
    w = text.lower().split()
    return min((xxhash.xxh64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=0)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` labelled rows (text, toxic, half) outside the held-out fold, one of each group of copies."""
    named = labels.where(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    one = named.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    # ``chosen`` has ``sample`` rows at most.
    rows = texts.join(F.broadcast(chosen), "doc_id")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            marks = pa.array([np.uint64(_sketch(t)).view(np.int64) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "text", "toxic")] + [marks], ["doc_id", "text", "toxic", "mark"])

    rows = checkpointed(rows.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(sketched, "doc_id long, text string, toxic int, mark long"))
    first = rows.groupBy("mark", "toxic").agg(F.min("doc_id").alias("doc_id"))
    return rows.join(first, ["mark", "toxic", "doc_id"], "left_semi").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int"))


def _counted(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """feature, t, c: in how many toxic and how many clean texts of ``rows`` each feature is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, seen = lru_cache(CACHED_WORDS)(restorer(model)), (Counter(), Counter())
        for batch in small(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen[toxic].update({f for w in words_of(text) for f in features(read(w))})
        found = list(seen[0] | seen[1])
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(pa.array([seen[k][f] for f in found], pa.int64()) for k in (1, 0))], ["feature", "t", "c"])

    counted = rows.select("text", "toxic").mapInArrow(count, "feature string, t long, c long")
    return counted.groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def telling_features(rows: DataFrame, model: np.ndarray) -> dict[str, float]:
    """Feature: how far, at the least, the odds of a toxic text rise with it (a logarithm).

    All features that occur in LEAST_TOXIC toxic texts are weighed; the sample of labelled
    rows bounds their number.
    """
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    odds = F.log(t / (toxic + 1)) - F.log(c / (clean + 1))
    weighed = _counted(rows, model).where(F.col("t") >= LEAST_TOXIC).select("feature", (odds - 1.3 * F.sqrt(1 / t + 1 / c)).alias("least"))
    return {r["feature"]: r["least"] for r in weighed.where(F.col("least") > TELLING).collect()}


def profiler(told: dict[str, float], model: np.ndarray) -> Callable[[str], tuple[float, float, float, float]]:
    """A function from a text to its three most telling words' weights and the number of telling ones (a logarithm)."""
    read, known = restorer(model), {}

    def weight(word: str) -> float:
        if len(known) >= CACHED_WORDS:
            known.clear()
        w = known[word] = max((told.get(f, 0.0) for f in features(read(word))), default=0.0)
        return w

    def profile(text: str) -> tuple[float, float, float, float]:
        words = list(words_of(text))
        weights = list(map(known.get, words))
        if None in weights:
            weights = [weight(w) if x is None else x for w, x in zip(words, weights, strict=True)]
        top = heapq.nlargest(3, filter(None, weights))
        return (*top, *[0.0] * (3 - len(top)), math.log1p(sum(1 for x in weights if x)))

    return profile


def _profiled(rows: DataFrame, told: dict[str, float], model: np.ndarray, keep: list[str], types: str) -> DataFrame:
    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profile = profiler(told, model)
        for batch in small(batches):
            found = [profile(t or "") for t in batch.column("text").to_pylist()]
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(c, pa.float64()) for c in columns], [*keep, "a", "b", "c", "d"])

    return rows.select(*keep, "text").mapInArrow(profiles, f"{types}, a double, b double, c double, d double")


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression, the constant first: Newton's method with a ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    ``labels`` (doc_id, toxic) are learned from outside the fold of crc32(doc_id) mod 5 = 0 only,
    on at most ``sample`` rows; the language model counts every text.  Null texts are empty, and
    empty texts get the score of a text without telling words; without labels of both kinds
    the score is the share of toxic labels.  Texts and words are read whole, however long;
    repeated rows get equal scores; a doc_id labelled twice counts as toxic if either label
    says so; other columns are ignored; an empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = checkpointed(training_rows(docs, labels, sample))
    model = language_model(texts)
    # Words are judged on one half and the curve fitted on the other, so that it sees them as it will elsewhere.
    told = telling_features(rows.where("half = 0"), model)
    fitted = [(r["toxic"], r["a"], r["b"], r["c"], r["d"]) for r in _profiled(rows.where("half = 1"), told, model, ["toxic"], "toxic int").collect()]
    data = np.array(fitted, float).reshape(-1, 5)
    curve = fit_curve(data[:, 1:], data[:, 0]) if len(data) else np.zeros(5)
    told = telling_features(rows, model)
    z = F.lit(float(curve[0]))
    for c, w in zip("abcd", curve[1:], strict=True):
        z = z + F.col(c) * F.lit(float(w))
    scored = _profiled(texts, told, model, ["doc_id"], "doc_id long").withColumn("score", 1 / (1 + F.exp(-z)))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns; rows that share a doc_id go together.

    Null and empty texts are scored like any other, and rows of a null doc_id go or stay
    together; very long texts are read whole; an empty table gives no rows.
    """
    toxic = score_toxicity(docs, labels).where("predicted = 1").select("doc_id").distinct()
    return skew_join(docs, toxic, ["doc_id"], "left_anti")
