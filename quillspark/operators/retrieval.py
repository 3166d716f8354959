"""Retrieval: BM25, chunking, dense scores, evidence formatting and coverage.

An inverted index is a join: the terms of the queries select their postings before
anything is shuffled by document, and document frequencies are counted for those terms
alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.batches import few
from quillspark.operators.exchange import settled, skew_join

K1, B = 1.2, 0.75
QUERY_BLOCK, VECTOR_BLOCK = 2048, 16_384  # of dense vectors that meet in one task
SCOPE = 4_000_000  # characters, and pairs of a query and a document, of a corpus that is scored in one task
FEW = 100_000  # terms of queries that every task may hold


def _few(terms: DataFrame) -> bool:
    return terms.limit(FEW + 1).count() <= FEW


def _sent(df: DataFrame, terms: DataFrame) -> DataFrame:
    """``df``, of no more rows than ``terms``, to be sent to every task where these are few, so that no postings are shuffled to meet it."""
    return F.broadcast(df) if _few(terms) else df  # bounded by FEW


def _counted(hashed: DataFrame, only: np.ndarray | None) -> DataFrame:
    """``hashed`` with length, how many terms a row has, and its different terms with their counts instead of all of them; with ``only``, those among it (sorted)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, 256):
            lists = batch["terms"]
            lengths = lists.value_lengths()
            t, row = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), lengths.fill_null(0).to_numpy())
            if only is not None:
                mine = np.isin(t, only)
                t, row = t[mine], row[mine]
            by = np.lexsort((t, row))
            t, row = t[by], row[by]
            first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (row[1:] != row[:-1])])) if len(t) else np.zeros(0, np.int64)
            tf = np.diff(np.append(first, len(t))).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=len(lists)))]).astype(np.int32)
            terms = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(t[first]), pa.array(tf)], ["term", "tf"]))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keys], lengths.cast(pa.int32()), terms], names=[*keys, "length", "terms"])

    keys = [c for c in hashed.columns if c != "terms"]
    told = [f"`{c}` {hashed.schema[c].dataType.simpleString()}" for c in keys]
    return hashed.mapInArrow(count, ", ".join([*told, "length int", "terms array<struct<term: bigint, tf: bigint>>"]))


def _weighed(queries: DataFrame, documents: DataFrame, tokens: Callable[[Column], Column], query_id: str, doc_id: str, text: str, scope: list[str], apart: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(query, term) of the queries' distinct terms, and (document, term, part, df, n_docs) of all postings of these terms; with ``apart`` a column more of each.

    Terms travel as 64-bit hashes, and every document is read into such numbers once.
    """
    of_query, of_doc = ([c] for c in apart) if apart else ([], [])
    hashed = lambda df, *keys: df.select(*keys, *scope, F.transform(tokens(F.col(text)), lambda t: F.xxhash64(t)).alias("terms"))
    terms = settled(hashed(queries, query_id, *of_query).select(query_id, *of_query, *scope, F.explode(F.array_distinct("terms")).alias("term")))
    wanted, known = terms.select(*scope, "term").distinct(), _few(terms)
    only = np.unique(terms.select("term").distinct().toArrow()["term"].to_numpy()) if known else None  # bounded by FEW
    held = settled(_counted(hashed(documents, doc_id, *of_doc), only))
    stats = held.groupBy(*scope).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean_length"))
    postings = held.select(doc_id, *of_doc, *scope, "length", F.explode("terms").alias("_t")).select(doc_id, *of_doc, *scope, "length", "_t.term", "_t.tf")
    if scope or not known:
        postings = settled(postings.join(_sent(wanted, terms), [*scope, "term"], "left_semi"))
    spread = settled(postings.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df")))
    weighed = skew_join(postings, _sent(spread, terms), [*scope, "term"], "inner")
    weighed = weighed.join(stats, scope) if scope else weighed.crossJoin(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    return terms, weighed.select(doc_id, *of_doc, *scope, "term", part.alias("part"), "df", "n_docs")


def bm25(
    queries: DataFrame, documents: DataFrame, tokens: Callable[[Column], Column], query_id: str, doc_id: str, text: str = "text",
    within: str | None = None, digits: int = 6,
) -> DataFrame:
    """query_id, doc_id, score > 0 for each query and each document with a term of it.

    ``within`` names a column of both tables: documents then form a corpus of their own for
    each of its values.  Of such corpora those of up to SCOPE characters and pairs of rows
    are scored in one task each, so that their texts are shuffled and not their terms.
    Scores are rounded so that the order of addition cannot turn ties.
    """
    if within is None:
        return _summed(_parts(queries, documents, tokens, query_id, doc_id, text, []), query_id, doc_id, digits)
    asked, held = queries.where(F.col(within).isNotNull()), documents.where(F.col(within).isNotNull())
    sized = lambda df, n: df.groupBy(within).agg(F.count(F.lit(1)).cast("double").alias(n), F.sum(F.length(text)).alias(f"{n}_chars"))
    sizes = skew_join(sized(asked, "_q"), sized(held, "_d"), [within], "inner")
    large = settled(sizes.where((F.coalesce("_q_chars", F.lit(0)) + F.coalesce("_d_chars", F.lit(0)) > SCOPE) | (F.col("_q") * F.col("_d") > SCOPE)).select(within))
    if large.isEmpty():
        return _summed(_in_tasks(asked, held, tokens, query_id, doc_id, text, within), query_id, doc_id, digits)
    apart = F.broadcast(large) if _few(large) else large
    rest = _in_tasks(asked.join(apart, within, "left_anti"), held.join(apart, within, "left_anti"), tokens, query_id, doc_id, text, within)
    joined = _parts(asked.join(apart, within, "left_semi"), held.join(apart, within, "left_semi"), tokens, query_id, doc_id, text, [within])
    return _summed(joined.select(query_id, doc_id, "part").unionByName(rest), query_id, doc_id, digits)


def _parts(queries: DataFrame, documents: DataFrame, tokens: Callable[[Column], Column], query_id: str, doc_id: str, text: str, scope: list[str]) -> DataFrame:
    """(query, document, part) for each term that both have."""
    terms, weighed = _weighed(queries, documents, tokens, query_id, doc_id, text, scope)
    return skew_join(_sent(terms, terms), weighed.select(doc_id, *scope, "term", "part"), [*scope, "term"], "inner")


def _scored(queries: pa.Table, documents: pa.Table) -> pa.Table:
    """id, doc, part: the sum of all parts of each query (id, terms) and each document (doc, terms) of one corpus that have a term in common."""
    asked, held = queries["terms"].combine_chunks(), documents["terms"].combine_chunks()
    lengths = held.value_lengths().drop_null().to_numpy()
    flat = lambda lists: (np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy()), lists.flatten().to_numpy(zero_copy_only=False))
    (q, wanted), (d, t) = flat(asked), flat(held)
    every = np.unique(wanted)
    at = np.searchsorted(every, t)
    mine = every[np.minimum(at, len(every) - 1)] == t if len(every) else np.zeros(len(t), bool)
    cells, tf = np.unique(at[mine] * max(1, len(held)) + d[mine], return_counts=True)
    term, doc = cells // max(1, len(held)), cells % max(1, len(held))
    df = np.bincount(term, minlength=len(every))
    length = held.value_lengths().fill_null(0).to_numpy()[doc]
    part = np.log(1 + (len(held) - df[term] + 0.5) / (df[term] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / (lengths.mean() if len(lengths) else 1)))
    starts, found = np.concatenate([[0], np.cumsum(df)]), []
    ends = np.searchsorted(q, np.arange(len(asked) + 1))
    for i in range(len(asked)):
        terms = np.unique(np.searchsorted(every, wanted[ends[i] : ends[i + 1]]))
        n = df[terms]
        places = np.repeat(starts[terms] - np.cumsum(n) + n, n) + np.arange(n.sum())
        total = np.bincount(doc[places], part[places], minlength=len(held))
        met = np.flatnonzero(total)
        found.append((np.full(len(met), i), met, total[met]))
    x, y, total = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return pa.table([queries["id"].combine_chunks().take(pa.array(x)), documents["doc"].combine_chunks().take(pa.array(y)), pa.array(total.astype(np.float64))], names=["id", "doc", "part"])


def _in_tasks(queries: DataFrame, documents: DataFrame, tokens: Callable[[Column], Column], query_id: str, doc_id: str, text: str, within: str) -> DataFrame:
    """(query, document, part) as ``_parts`` gives them, summed, each corpus scored in one task; texts are shuffled before they are read into terms."""
    read = F.transform(tokens(F.col("text")), lambda t: F.xxhash64(t)).alias("terms")
    sides = [df.select(F.col(within).alias(scope), F.col(key).alias(name), F.col(text).alias("text")).repartition(scope).select(scope, name, read) for df, key, name, scope in ((queries, query_id, "id", "_qs"), (documents, doc_id, "doc", "_ds"))]
    kinds = [df.schema[name].dataType.simpleString() for df, name in zip(sides, ("id", "doc"), strict=True)]
    found = sides[0].groupBy("_qs").cogroup(sides[1].groupBy("_ds")).applyInArrow(_scored, f"id {kinds[0]}, doc {kinds[1]}, part double")
    return found.select(F.col("id").alias(query_id), F.col("doc").alias(doc_id), "part")


def _summed(parts: DataFrame, query_id: str, doc_id: str, digits: int) -> DataFrame:
    return parts.groupBy(query_id, doc_id).agg(F.round(F.sum("part"), digits).alias("score")).where("score > 0")


def bm25_top(
    queries: DataFrame, documents: DataFrame, tokens: Callable[[Column], Column], query_id: str, doc_id: str, k: int, text: str = "text", digits: int = 6, common: float = 0.1,
    without: DataFrame | None = None, apart: tuple[str, str] | None = None,
) -> DataFrame:
    """The ``k`` documents of highest ``bm25`` score for each query, ties to the smaller id, with rank; without scoring them all.

    Terms in more than a share ``common`` of the documents would pair each query with most of
    them.  The k-th best sum over the other terms bounds the result from below; where what
    the common terms can add at most cannot reach it, documents without a rare term are
    out, and so are those whose rare terms and that most fall short.  Only the rest have
    their common terms added.  Queries without such a bound are scored in full.

    Pairs (query_id, doc_id) in ``without`` are out, and so are, with ``apart``, those whose
    values of these columns, one of the queries and one of the documents, are equal or
    null; documents count in the frequencies of terms all the same.
    """
    terms, weighed = _weighed(queries, documents, tokens, query_id, doc_id, text, [], apart)
    (of_query, of_doc), fit = (([apart[0]], [apart[1]]), F.col(apart[0]) != F.col(apart[1])) if apart else (([], []), F.lit(True))
    out = settled(without.select(query_id, doc_id).distinct()) if without is not None else None
    allowed = lambda pairs: pairs if out is None else skew_join(pairs, out, [query_id, doc_id], "left_anti")
    weighed = weighed.withColumn("rare", F.col("df") <= common * F.col("n_docs"))
    if not _few(terms):
        weighed = settled(weighed)
    of_terms = weighed.groupBy("term").agg(F.max("part").alias("most"), F.any_value("rare").alias("rare"))
    asked = settled(skew_join(terms, of_terms, ["term"], "inner"))
    of_all = lambda df: _sent(df, terms)
    spare = asked.groupBy(query_id).agg(F.coalesce(F.sum(F.when(~F.col("rare"), F.col("most"))), F.lit(0.0)).alias("spare"))
    partial = skew_join(of_all(asked.where("rare").select(query_id, *of_query, "term")), weighed.where("rare").select(doc_id, *of_doc, "term", "part"), ["term"], "inner").where(fit)
    partial = settled(allowed(partial.groupBy(query_id, doc_id).agg(F.sum("part").alias("sum"))))
    bound = top_k(partial, query_id, k, doc_id, "sum").where(F.col("rank") == k).select(query_id, F.col("sum").alias("bound"))
    bounds = settled(spare.join(bound, query_id, "left"))
    slack = 2 * 10.0**-digits  # rounded scores may tie where sums differ
    pruned = bounds.where(F.col("bound") > F.col("spare") + slack)
    close = partial.join(pruned, query_id).where(F.col("sum") + F.col("spare") + slack >= F.col("bound"))
    close = settled(close.select(query_id, doc_id, "sum"))
    extra = skew_join(close.select(query_id, doc_id), asked.where("not rare").select(query_id, "term"), [query_id], "inner")
    extra = skew_join(extra, weighed.where("not rare").select(doc_id, "term", "part"), [doc_id, "term"], "inner").select(query_id, doc_id, "part")
    some = _summed(close.select(query_id, doc_id, F.col("sum").alias("part")).unionByName(extra), query_id, doc_id, digits)
    open_ones = bounds.where(~F.coalesce(F.col("bound") > F.col("spare") + slack, F.lit(False))).select(query_id)
    full = skew_join(of_all(asked.join(open_ones, query_id, "left_semi").select(query_id, *of_query, "term")), weighed.select(doc_id, *of_doc, "term", "part"), ["term"], "inner").where(fit)
    return top_k(some.unionByName(allowed(_summed(full, query_id, doc_id, digits))), query_id, k, doc_id)


def top_k(scored: DataFrame, by: str | list[str], k: int, tie: str, score: str = "score") -> DataFrame:
    """The ``k`` rows of highest score for each ``by``, ties to the smaller ``tie``, with their rank from 1."""
    keys = [by] if isinstance(by, str) else by
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def spaced_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def word_chunks(tokens: Column, size: int = 320, overlap: int = 48) -> Column:
    """Runs of ``size`` tokens, each sharing ``overlap`` with the next; the last ends with the array.

    Pass a column of a table, not an expression: it is read once for each chunk.
    """
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.size(tokens) - size) / F.lit(float(step)))).cast("int")
    starts = F.when(F.size(tokens) > 0, F.transform(F.sequence(F.lit(0), last), lambda k: k * step)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct((s + 1).alias("start"), F.array_join(F.slice(tokens, s + 1, size), " ").alias("text")))


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(left: Column, right: Column) -> Column:
    return dot(left, right) / F.sqrt(dot(left, left) * dot(right, right))


def _rows_of(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _best_of_block(query_ids: np.ndarray, q: np.ndarray, q_norms: np.ndarray, ids: np.ndarray, x: np.ndarray, norms: np.ndarray, gap: float) -> list[tuple]:
    """Arrays (query, vector, score) of the vectors whose cosine comes within ``gap`` of a query's largest, the least id of each such score.

    A matrix product finds them; their scores are then summed from the first component to the last, as ``dot`` does.
    """
    _, copy = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_inverse=True)
    by = np.lexsort((ids, copy.ravel()))
    copy = copy.ravel()[by]
    kept = np.sort(by[np.arange(len(by)) - np.searchsorted(copy, copy) < 2])  # of equal vectors two: one may be the query itself
    ids, x, norms, found = ids[kept], x[kept], norms[kept], []
    for at in range(0, len(q), 256):
        qi, qs, qn = query_ids[at : at + 256], q[at : at + 256], q_norms[at : at + 256]
        score = qs @ x.T / np.sqrt(qn[:, None] * norms[None])
        score[qi[:, None] == ids[None]] = -np.inf
        i, j = np.nonzero((score >= score.max(axis=1, keepdims=True) - gap) & (score > -np.inf))
        total = np.zeros(len(i))
        for c in range(x.shape[1]):
            total = total + qs[i, c] * x[j, c]
        exact = total / np.sqrt(qn[i] * norms[j])
        by = np.lexsort((ids[j], exact, i))
        i, j, exact = i[by], j[by], exact[by]
        first = np.ones(len(i), bool)
        first[1:] = (i[1:] != i[:-1]) | (exact[1:] != exact[:-1])
        found.append((qi[i[first]], ids[j[first]], exact[first]))
    return found


def nearest_of_group(vectors: DataFrame, queries: DataFrame, group: str, vec_id: str = "vec_id", digits: int = 9) -> DataFrame:
    """For each query (query_id, q, group): the other vector of its group with the largest cosine, the smallest id on ties.

    A block of queries and a block of vectors of a group are one task's matrix product.
    Pairs that have no cosine (nulls, unequal lengths) come last; those of vectors that have
    no norm of a usual size are scored one by one.
    """
    norm = lambda x: dot(F.col(x), F.col(x))
    v = settled(vectors.where(F.col(group).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(group).alias("g"), F.col("embedding").alias("x"), norm("embedding").alias("norm")))
    asked = settled(queries.where(F.col(group).isNotNull()).select(F.col("query_id").cast("long").alias("id"), F.col(group).alias("g"), F.col("q").alias("x"), norm("q").alias("norm")))
    plain, odd = F.col("norm").between(1e-150, 1e150), F.col("norm").isNotNull() & ~F.col("norm").between(1e-150, 1e150)
    sized = lambda df: df.where(plain).withColumn("d", F.size("x"))
    blocks = lambda df, n, name: df.groupBy("g", "d").agg(F.ceil(F.count(F.lit(1)) / n).cast("int").alias(name))
    plan = settled(skew_join(blocks(sized(v), VECTOR_BLOCK, "blocks"), blocks(sized(asked), QUERY_BLOCK, "parts"), ["g", "d"], "inner"))
    deal = lambda df, own, n_own, other, n_other: skew_join(sized(df), plan, ["g", "d"], "inner").withColumn(own, F.pmod(F.xxhash64("id"), F.col(n_own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))).drop("blocks", "parts")
    gap = 10.0**-digits + 1e-11

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        n, m, found = left.num_rows, right.num_rows, []
        if n and m:
            found = _best_of_block(left["id"].to_numpy(), _rows_of(left["x"], n), left["norm"].to_numpy(), right["id"].to_numpy(), _rows_of(right["x"], m), right["norm"].to_numpy(), gap)
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(c) for c in columns], names=["query_id", "id", "score"])

    keys = ["g", "d", "part", "block"]
    scored = deal(asked, "part", "parts", "block", "blocks").groupBy(*keys).cogroup(deal(v, "block", "blocks", "part", "parts").groupBy(*keys)).applyInArrow(best, "query_id long, id long, score double")
    one = asked.select(F.col("id").alias("query_id"), "g", F.col("x").alias("q"), "norm")
    rest = [one.where(odd).drop("norm").join(v.where("norm is not null").select("id", "g", "x"), "g"), one.where(plain).drop("norm").join(v.where(odd).select("id", "g", "x"), "g")]
    rest = [pairs.where("query_id <> id").select("query_id", "id", cosine(F.col("q"), F.col("x")).alias("score")) for pairs in rest] if not v.where(odd).isEmpty() or not asked.where(odd).isEmpty() else []
    # The first other id of the group, for queries that have a cosine with none.
    first = v.groupBy("g").agg(F.min("id").alias("a"))
    second = skew_join(v.select("g", "id"), first, ["g"], "inner").where("id <> a").groupBy("g").agg(F.min("id").alias("b"))
    ends = settled(skew_join(first, second, ["g"], "left"))
    last = skew_join(one.select("query_id", "g"), ends, ["g"], "inner").select("query_id", F.when(F.col("a") == F.col("query_id"), F.col("b")).otherwise(F.col("a")).alias("id"), F.lit(None).cast("double").alias("score")).where("id is not null")
    every = reduce(DataFrame.unionByName, [scored, *rest, last])
    found = every.groupBy("query_id").agg(F.max(F.struct(F.round("score", digits).alias("score"), (-F.col("id")).alias("order"))).alias("b"))
    return found.select("query_id", (-F.col("b.order")).alias(vec_id), F.col("b.score").alias("score"))


def ranked_lines(items: Column) -> Column:
    """Texts of an array as numbered lines."""
    return F.array_join(F.transform(items, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n")


def parsed_ranked_lines(block: Column) -> Column:
    """The inverse of ``ranked_lines``: texts of the lines that begin with a number."""
    lines = F.filter(F.split(block, "\n"), lambda line: line.rlike(r"^\d+\. "))
    return F.transform(lines, lambda line: F.regexp_replace(line, r"^\d+\. ", ""))


def phrase_coverage(phrases: DataFrame, documents: DataFrame, tokens: Callable[[Column], Column], phrase_id: str, doc_id: str) -> DataFrame:
    """phrase_id, doc_id: the first document (by id) that holds each phrase of two words or more as a run of tokens.

    Documents are looked up by the rarest of a phrase's runs of two tokens; only ids meet
    there, and the texts of documents that are candidates are read once those are known.
    """
    pairs = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(t) - 2), lambda i: F.xxhash64(F.get(t, i), F.get(t, i + 1))))
    line = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    wanted = phrases.select(F.col(phrase_id).alias("_phrase"), tokens(F.col("phrase")).alias("p")).where(F.size("p") >= 2)
    wanted = settled(wanted.select("_phrase", line(F.col("p")).alias("needle"), F.explode(pairs(F.col("p"))).alias("pair")))
    asked = wanted.select("pair").distinct()
    held = documents.select(F.col(doc_id).alias("_doc"), tokens(F.col("text")).alias("t")).where(F.size("t") >= 2)
    met = settled(skew_join(held.select("_doc", F.explode(pairs(F.col("t"))).alias("pair")), asked, ["pair"], "left_semi"))
    often = met.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    rarest = skew_join(wanted, often, ["pair"], "left").groupBy("_phrase", "needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pair")).alias("r")).where("r.n > 0")
    open_pairs = settled(skew_join(met, rarest.select("_phrase", "needle", F.col("r.pair").alias("pair")), ["pair"], "inner").drop("pair"))
    texts = skew_join(held.select("_doc", line(F.col("t")).alias("hay")), open_pairs.select("_doc").distinct(), ["_doc"], "left_semi")
    found = skew_join(open_pairs, texts, ["_doc"], "inner").where(F.contains("hay", "needle"))
    return found.groupBy(F.col("_phrase").alias(phrase_id)).agg(F.min("_doc").alias(doc_id))
