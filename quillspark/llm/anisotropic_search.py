"""Maximum inner product search over score-aware, anisotropically quantised vectors.

Codes of four bits for every two dimensions are chosen to lose little of what scores
depend on: the residual along a vector is penalised more than the residual across it.
A search scans table sums over the codes of blocks of vectors, and reranks the best of
each block by exact inner products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import checkpointed

#: Vectors that the codebooks are fitted on, at most: those of the smallest hashes.
SAMPLE = 8192
CENTRES, WIDTH = 16, 2  # a code of four bits for each two dimensions
THRESHOLD = 0.2  # scores above this share of the norm are the ones that matter
BLOCK, QUERY_BLOCK, TILE = 16_384, 4096, 256
LEAST_BLOCK, LEAST_BLOCKS = 512, 32  # small tables are cut into up to 32 blocks of 512 vectors at least
RERANK = 48  # a block's best by table sums, for each query: these and all that tie with the last get exact products


def parallel_weight(dim: int, threshold: float = THRESHOLD) -> float:
    """How many times more an error along a vector of ``dim`` numbers counts than one across it."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def _padded(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % WIDTH)))


def encode(x: np.ndarray, books: np.ndarray, weight: float, rounds: int = 2) -> np.ndarray:
    """Codes (n x parts, uint8) of ``x`` by coordinate descent on ||r||^2 + (weight - 1) <r, x/|x|>^2."""
    x = _padded(x)
    parts = books.shape[0]
    unit = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).reshape(len(x), parts, WIDTH)
    x = x.reshape(len(x), parts, WIDTH)
    across = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)  # n x parts x centres
    along = ((x[:, :, None, :] - books[None]) * unit[:, :, None, :]).sum(axis=3)
    codes = across.argmin(axis=2)
    rows = np.arange(len(x))
    total = along[rows[:, None], np.arange(parts)[None], codes].sum(axis=1)
    for _ in range(rounds):
        for m in range(parts):
            rest = total - along[rows, m, codes[:, m]]
            best = (across[:, m] + (weight - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(axis=1)
            codes[:, m] = best
            total = rest + along[rows, m, best]
    return codes.astype(np.uint8)


def fit_codebooks(x: np.ndarray, rounds: int = 3, seed: int = 5) -> np.ndarray:
    """Codebooks (parts x 16 x 2) fitted to ``x`` (n x dim), by turns of encoding and weighted least squares."""
    weight = parallel_weight(x.shape[1])
    x = _padded(x.astype(np.float64))
    parts, random = x.shape[1] // WIDTH, np.random.Generator(np.random.PCG64(seed))
    books = np.stack([x[random.integers(0, len(x), CENTRES), m * WIDTH : (m + 1) * WIDTH] for m in range(parts)])
    for _ in range(6):  # plain k-means of each part to begin with
        for m in range(parts):
            part = x[:, m * WIDTH : (m + 1) * WIDTH]
            near = ((part[:, None] - books[m][None]) ** 2).sum(axis=2).argmin(axis=1)
            for k in range(CENTRES):
                if (mine := near == k).any():
                    books[m, k] = part[mine].mean(axis=0)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    for _ in range(rounds):
        codes = encode(x, books, weight)
        column = (np.arange(parts)[None, :, None] * CENTRES + codes[:, :, None]) * WIDTH + np.arange(WIDTH)[None, None, :]
        column = column.reshape(len(x), -1)
        spread = np.zeros((len(x), parts * CENTRES * WIDTH))
        np.put_along_axis(spread, column, unit, axis=1)
        count, sums = np.zeros(spread.shape[1]), np.zeros(spread.shape[1])
        np.add.at(count, column, 1.0)
        np.add.at(sums, column, x)
        norms = (unit * x).sum(axis=1)
        left = np.diag(count + 1e-6) + (weight - 1) * spread.T @ spread
        right = sums + 1e-6 * books.reshape(-1) + (weight - 1) * spread.T @ norms
        books = np.linalg.solve(left, right).reshape(parts, CENTRES, WIDTH)
    return books


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def best_of_block(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, query_ids: np.ndarray, q: np.ndarray, books: np.ndarray, k: int):
    """(query_id, vec_id, score) of each query's ``k`` best in a block: table sums, then exact products."""
    order = np.argsort(ids, kind="stable")
    ids, x, codes = ids[order], x[order], codes[order]
    n, parts = codes.shape
    if parts % 2:
        codes, books = np.pad(codes, ((0, 0), (0, 1))), np.pad(books, ((0, 1), (0, 0), (0, 0)))
    pairs = codes[:, 0::2].astype(np.intp) * CENTRES + codes[:, 1::2]  # two codes of four bits make a byte
    found = []
    for at in range(0, len(query_ids), TILE):
        qs, qi = q[at : at + TILE], query_ids[at : at + TILE]
        split = np.pad(_padded(qs), ((0, 0), (0, books.shape[0] * WIDTH - _padded(qs).shape[1]))).reshape(len(qs), -1, WIDTH)
        table = np.einsum("mcw,qmw->mcq", books, split)
        table = (table[0::2, :, None] + table[1::2, None]).reshape(-1, CENTRES * CENTRES, len(qs))
        scale = 30_000 / np.maximum(np.abs(table).max(axis=(1)).sum(axis=0), 1e-30)
        table = np.rint(table * scale).astype(np.int16)
        sums = np.zeros((n, len(qs)), np.int16)
        for m in range(table.shape[0]):
            sums += table[m][pairs[:, m]]
        if n > RERANK + 1:
            least = np.partition(sums, n - RERANK - 1, axis=0)[n - RERANK - 1]
            i, j = np.nonzero(sums >= least[None])  # all that tie with the last are reranked too
        else:
            i, j = (a.ravel() for a in np.indices((n, len(qs))))
        i, j = (a[ids[i] != qi[j]] for a in (i, j))
        score = np.concatenate([(x[i[s : s + 65_536]] * qs[j[s : s + 65_536]]).sum(axis=1) for s in range(0, len(i), 65_536)] or [np.zeros(0)])
        by = np.lexsort((ids[i], -score, j))
        i, j, score = i[by], j[by], score[by]
        rank = np.arange(len(j)) - np.searchsorted(j, j)
        found.append((qi[j[rank < k]], ids[i[rank < k]], score[rank < k]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part; a vec_id that repeats counts once, with the least of its vectors."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    some = F.exists(x, lambda v: v != 0)
    kept = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(fine & some)
    return kept.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(x.cast("array<double>")).alias("embedding"))


def search(vectors: DataFrame, is_query: str = "vec_id % 20 = 0", k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` rows of largest inner product, ties to smaller vec_id.

    ``vectors`` has vec_id and embedding; rows for which ``is_query`` holds are queries, and
    every row but the query's own is a candidate.  Vectors that are null, zero or hold null
    or non-finite numbers take no part, nor do those of another dimension than most have (of
    equally frequent ones, the smaller).  A vec_id that repeats is one candidate.  Where all
    candidates tie, those of smaller vec_id come first; other columns are ignored; an empty
    table gives no rows.  Blocks are of hashes of vec_id and their number depends on the
    rows alone, so every cluster finds the same.  Each pair of a block of vectors and a
    block of queries is one bounded task.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    able = checkpointed(usable(vectors))
    usual = able.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        return spark.createDataFrame([], schema)
    rows = able.where(F.size("embedding") == usual["d"])
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    books = fit_codebooks(np.stack(sample["embedding"].to_numpy()))
    weight = parallel_weight(usual["d"])

    def coded(batches):
        for batch in batches:
            x = _matrix(batch.column("embedding"), batch.num_rows)
            codes = [encode(x[a : a + 2048], books, weight) for a in range(0, len(x), 2048)]
            flat = [c.tobytes() for block in codes for c in block]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flat, pa.binary())], ["vec_id", "embedding", "codes"])

    count, asked = rows.count(), rows.where(is_query).count()
    blocks = max(-(-count // BLOCK), min(-(-count // LEAST_BLOCK), LEAST_BLOCKS))
    query_blocks = max(1, -(-asked // QUERY_BLOCK))
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = rows.mapInArrow(coded, "vec_id long, embedding array<double>, codes binary")
    index = index.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("part", everywhere(query_blocks))
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "embedding")
    queries = queries.withColumn("part", F.pmod(F.xxhash64("query_id", F.lit(2)), F.lit(query_blocks)).cast("int")).withColumn("block", everywhere(blocks))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        codes = np.frombuffer(b"".join(left["codes"].to_pylist()), np.uint8).reshape(left.num_rows, -1)
        ids, query_ids = left["vec_id"].to_numpy(), right["query_id"].to_numpy()
        x, q = _matrix(left["embedding"], left.num_rows), _matrix(right["embedding"], right.num_rows)
        return pa.table([pa.array(c) for c in best_of_block(ids, x, codes, query_ids, q, books, k)], names=names)

    found = index.groupBy("block", "part").cogroup(queries.groupBy("block", "part")).applyInArrow(scan, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
