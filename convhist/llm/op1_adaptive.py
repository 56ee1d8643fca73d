"""Approximate nearest neighbours by inner product: lists, and an adaptive scan of their dimensions.

Vectors get one more dimension that makes all norms equal, so the largest inner product is the smallest distance, and are
turned by a random rotation. Centroids from a bounded sample split them into lists; a query probes its nearest lists
until they hold a share of all vectors that the sample shows to be enough. Within a list the dimensions are read in column blocks: from the first d of D,
the distance is estimated at D/d times the partial one, and a candidate is given up once that exceeds the k-th best so far
by the factor (1 + eps / sqrt(d))^2, a test that a true neighbour fails with small probability. What is left is scored
exactly on the original vectors, in double precision, summed from the first dimension on.

Skew: a list is dealt out in blocks of at most about LIST_BLOCK vectors by a hash of the id, its queries in chunks of
QUERY_CHUNK, so copies of one vector never meet in one task.

Bounds: centroids come from at most TRAIN_ROWS vectors (those with the least id hash), there are at most MAX_LISTS lists,
and the driver holds one row per list. Every vector is indexed.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors
of different lengths are searched apart, the driver holds one row per length; a repeated (id, vector) counts once; rows with the query's id are no
candidates; ties go to the smaller id; rows with a null id take no part; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convhist.llm.common import materialize

TRAIN_ROWS = 20_000
MAX_LISTS = 1024
LIST_BLOCK = 4096
QUERY_CHUNK = 8192
#: Recall that the probed lists are to have, and the sample's vectors asked to learn what share of all that takes.
TARGET_RECALL = 0.95
ASKED_ROWS = 500
_turns: dict[tuple[int, int], np.ndarray] = {}


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same on every worker."""
    if (dim, seed) not in _turns:
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
        _turns[dim, seed] = q * np.sign(np.diag(r))
    return _turns[dim, seed]


def turned(vectors: np.ndarray, square: float, seed: int, query: bool = False) -> np.ndarray:
    """Vectors with the dimension that makes their squared norms `square` (queries: 0), rotated."""
    rest = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(0.0, square - np.einsum("ij,ij->i", vectors, vectors)))
    return np.column_stack((vectors, rest)) @ rotation(vectors.shape[1] + 1, seed)


def centroids(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm on distinct starting vectors."""
    distinct = np.unique(sample, axis=0)
    centers = distinct[np.random.default_rng(seed).permutation(len(distinct))[:lists]].copy()
    for _ in range(rounds):
        label = nearest_lists(sample, centers, 1)[:, 0]
        sums = np.zeros_like(centers)
        np.add.at(sums, label, sample)
        count = np.bincount(label, minlength=len(centers))
        centers[count > 0] = sums[count > 0] / count[count > 0, None]
    return centers


def nearest_lists(vectors: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    near = 0.5 * np.einsum("ij,ij->i", centers, centers) - vectors @ centers.T
    return near.argmin(axis=1)[:, None] if n == 1 else np.argsort(near, axis=1, kind="stable")[:, :n]


def adaptive_scan(rows: np.ndarray, queries: np.ndarray, k: int, width: int = 16, eps: float = 2.1, step: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that survive: the k nearest of each query and few more.

    Rows are read in parts of growing size, so that the first ones set the limits. While many pairs of a part are left, a
    column block is one matrix product over all of them; then the pairs left are followed one by one.
    """
    n, dim = rows.shape
    best = np.full((len(queries), k), np.inf)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    a = 0
    while a < n:
        part, limit, d = rows[a : a + step], best[:, -1], 0
        total, alive, pairs = np.zeros((len(queries), len(part))), True, None
        while d < dim:
            asked, given = queries[:, d : d + width], part[:, d : d + width]
            d = min(d + width, dim)
            bound = limit * (1 + eps / math.sqrt(d)) ** 2 + 1e-9 if d < dim else limit + 1e-9
            if pairs is None:
                total += np.einsum("ij,ij->i", asked, asked)[:, None] + np.einsum("ij,ij->i", given, given)[None, :] - 2 * asked @ given.T
                alive = alive & (total * (dim / d) <= bound[:, None])
                if d == dim or 8 * np.count_nonzero(alive) < alive.size:
                    pairs = np.nonzero(alive)
                    q, x = pairs
                    so_far = total[q, x]
            else:
                more = given[x] - asked[q]
                so_far = so_far + np.einsum("ij,ij->i", more, more)
                keep = so_far * (dim / d) <= bound[q]
                q, x, so_far = q[keep], x[keep], so_far[keep]
        found.append((q, x + a, so_far))
        dense = np.full((len(queries), len(part)), np.inf)
        dense[q, x] = so_far
        best = np.sort(np.partition(np.concatenate((best, dense), axis=1), k - 1, axis=1)[:, :k], axis=1)
        a += len(part)
        step = min(4 * step, 1024)
    q, x, so_far = (np.concatenate(c) for c in zip(*found, strict=True))
    keep = so_far <= best[q, -1] * (1 + 1e-9) + 1e-9
    return q[keep], x[keep]


def exact_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed from the first dimension on, so equal vectors have equal scores."""
    total = np.zeros(len(left))
    for i in range(left.shape[1]):
        total += left[:, i] * right[:, i]
    return total


def learned_share(sample: np.ndarray, placed: np.ndarray, asked: np.ndarray, centers: np.ndarray, neighbours: int) -> float:
    """Share of all vectors that the nearest lists must hold to have TARGET_RECALL of the neighbours of a sample's vectors.

    `placed` and `asked` are the sample turned as vectors and its first ASKED_ROWS turned as queries.
    """
    n = len(asked)
    scores = sample[:n] @ sample.T
    scores[np.arange(n), np.arange(n)] = -np.inf
    near = np.argpartition(-scores, neighbours - 1, axis=1)[:, :neighbours]
    lists = nearest_lists(placed, centers, 1)[:, 0]
    order = nearest_lists(asked, centers, len(centers))
    held = np.cumsum(np.bincount(lists, minlength=len(centers))[order], axis=1) / len(sample)
    place = np.argsort(order, axis=1)
    return float(np.quantile(np.take_along_axis(held, np.take_along_axis(place, lists[near], axis=1), axis=1), TARGET_RECALL, method="higher"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _assign(centers: np.ndarray, square: float, dim: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = nearest_lists(turned(_matrix(batch.column("vec"), dim), square, seed), centers, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), pa.array(lists.astype(np.int32))], names=["vec_id", "vec", "list"])

    return run


def _probe(centers: np.ndarray, sizes: np.ndarray, need: float, dim: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                order = nearest_lists(turned(_matrix(batch.column("vec"), dim), 0.0, seed, query=True), centers, len(centers))
                held = np.cumsum(sizes[order], axis=1)
                n = np.minimum((held < need).sum(axis=1) + 1, len(centers))
                probes = [o[:c].astype(np.int32) for o, c in zip(order, n, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), pa.array(probes, pa.list_(pa.int32()))], names=["vec_id", "vec", "lists"])

    return run


def _scan_block(k: int, dim: int, square: float, seed: int, eps: float):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        names, kinds = ["query_id", "vec_id", "score"], (pa.int64(), pa.int64(), pa.float64())
        if not vectors.num_rows or not queries.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        ids, query_ids = vectors.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
        plain, asked = _matrix(vectors.column("vec"), dim), _matrix(queries.column("vec"), dim)
        keep = np.unique(np.column_stack((ids.astype(np.float64), plain)), axis=0, return_index=True)[1] if len(np.unique(ids)) < len(ids) else np.argsort(ids)
        ids, plain = ids[keep], plain[keep]
        rows, wanted = turned(plain, square, seed), turned(asked, 0.0, seed, query=True)
        out = []
        for a in range(0, len(wanted), 256):
            q, x = adaptive_scan(rows, wanted[a : a + 256], k + 1, eps=eps)  # one more: the query's own row may be among them
            q += a
            other = ids[x] != query_ids[q]
            q, x = q[other], x[other]
            scores = exact_scores(asked[q], plain[x])
            order = np.lexsort((ids[x], -scores, q))
            q, x, scores = q[order], x[order], scores[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            top = place < k
            out.append((query_ids[q[top]], ids[x[top]], scores[top]))
        return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def valid_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vec): rows that take part."""
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).filter(finite).filter(F.exists("vec", lambda v: v != 0.0))


def search(table: DataFrame, is_query: Column, k: int = 20, probe_share: float | None = None, eps: float = 2.1, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query. is_query: over vec_id and vec.

    probe_share trades recall for work. If it isn't given, it is learnt from the sample: see `learned_share`. A sample's
    neighbours are no nearer than those among all vectors, so the share learnt errs to the safe side.
    """
    rows = valid_vectors(table, id_col, vector_col)
    norm = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)
    shapes = rows.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("square")).orderBy("dim").collect()  # one row per length
    out = table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [_search_length(rows.filter(F.size("vec") == s["dim"]), is_query, s["dim"], s["n"], s["square"], k, probe_share, eps, seed) for s in shapes]
    if len(found) < 2:
        return found[0] if found else out
    best = reduce(DataFrame.union, found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_length(rows: DataFrame, is_query: Column, dim: int, n: int, square: float, k: int, probe_share: float | None, eps: float, seed: int) -> DataFrame:
    """The nearest of each query among the n vectors of one length."""
    sample = rows.select("vec_id", "vec").orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRAIN_ROWS).select("vec").toArrow()
    lists = max(1, min(MAX_LISTS, round(math.sqrt(n) / 2)))
    sample = _matrix(sample.column("vec"), dim)
    turned_sample = turned(sample, square, seed)
    centers = centroids(turned_sample, lists)
    if probe_share is None:
        neighbours = min(len(sample) - 1, max(1, round(k * len(sample) / n)))
        asked_sample = turned(sample[:ASKED_ROWS], 0.0, seed, query=True)
        probe_share = learned_share(sample, turned_sample, asked_sample, centers, neighbours) if neighbours else 1.0
    placed = materialize(rows.mapInArrow(_assign(centers, square, dim, seed), "vec_id long, vec array<double>, list int"))
    sizes = np.zeros(len(centers), dtype=np.int64)
    for r in placed.groupBy("list").count().collect():  # one row per list
        sizes[r["list"]] = r["count"]
    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    need = max(probe_share * n, min(n, 2000))
    asked = materialize(queries.mapInArrow(_probe(centers, sizes, need, dim, seed), "vec_id long, vec array<double>, lists array<int>")).withColumn("list", F.explode("lists")).drop("lists")
    waiting = np.zeros(len(centers), dtype=np.int64)
    for r in asked.groupBy("list").count().collect():
        waiting[r["list"]] = r["count"]
    blocks, chunks = (F.element_at(F.array(*[F.lit(int(max(1, -(-v // size)))) for v in values]), F.col("list") + 1) for values, size in ((sizes, LIST_BLOCK), (waiting, QUERY_CHUNK)))
    each = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    vectors = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int")).withColumn("chunk", each(chunks))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), chunks).cast("int")).withColumn("block", each(blocks))
    keys = ["list", "block", "chunk"]
    found = vectors.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_scan_block(k, dim, square, seed, eps), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(vectors: dict[int, np.ndarray], queries: list[int], k: int) -> dict[int, list[tuple[int, float]]]:
    ids = np.array(sorted(vectors))
    rows = np.stack([vectors[i] for i in ids]).astype(np.float64)
    out = {}
    for q in queries:
        scores = exact_scores(rows, np.broadcast_to(vectors[q].astype(np.float64), rows.shape))
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(scores[i])) for i in order]
    return out


def op1_adaptive_search(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
