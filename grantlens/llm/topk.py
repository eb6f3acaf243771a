"""Exact top-k search by inner product on norm-sorted, SVD-rotated vectors.

Each shard sorts its vectors by falling length. A block of queries walks down them in tiles: it stops when even the longest
vector left cannot reach the k-th score by Cauchy-Schwarz, and within a tile only vectors whose partial product over the first
rotated dimensions plus the product of the residual lengths can reach it are scored in full. The rotation comes from the
singular vectors of a bounded sample (`sample_rows`), and being orthogonal changes no product; a wrong one costs time only.
Scores are products of integers, and are exact. Partial lists of k from each shard are merged for each query.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part, neither as query nor as
candidate; vectors of unequal dimension are filled up with zeros; a row is not its own candidate, nor are other rows with
its id; ties go to the smaller id; components and scores beyond 64 bits are the nearest 64-bit number; with fewer than k candidates all are returned; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read
from .shards import shard_count, visit, whole

K = 5
QUERY_EVERY = 50
SCALE = 256
LEAST_ROWS, MOST_ROWS = 4096, 65536
SAMPLE_ROWS = 2048
#: Components up to here give products that doubles hold exactly; larger ones are multiplied as Python integers.
EXACT = float(2**22)
TILE = 1024


def rotation(vectors: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray | None:
    """Right singular vectors of at most sample_rows vectors, those whose ids hash lowest."""
    rows = vectors.orderBy(F.xxhash64("id")).limit(sample_rows).select("v").collect()
    if not rows:
        return None
    width = max(len(r.v) for r in rows)
    x = np.array([r.v + [0.0] * (width - len(r.v)) for r in rows])
    top = np.abs(x).max()
    return np.linalg.svd(x / top if top > 0 else x, full_matrices=True)[2].T


class Shard:
    def __init__(self, ids: np.ndarray, x: np.ndarray, turn: np.ndarray, k: int):
        size = np.linalg.norm(x, axis=1)
        order = np.lexsort((ids, -size))
        self.ids, self.x, self.size, self.turn, self.k = ids[order], x[order], size[order], turn, k
        self.width = x.shape[1]
        self.big = np.abs(x).max(initial=0) > EXACT
        y = self.rotate(self.x)
        self.head = max(1, y.shape[1] // 4)
        self.y = np.ascontiguousarray(y[:, : self.head])
        self.rest = np.sqrt(np.maximum(0, self.size**2 - (self.y**2).sum(1)))

    def rotate(self, x: np.ndarray) -> np.ndarray:
        d = len(self.turn)
        if x.shape[1] < d:
            x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
        return x[:, :d] @ self.turn if x.shape[1] == d else np.hstack((x[:, :d] @ self.turn, x[:, d:]))

    def scores(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.big or np.abs(q).max(initial=0) > EXACT:
            return np.array([[sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for v in x] for u in q], object).reshape(len(q), len(x))
        return q @ x.T

    def __call__(self, qid: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        width = max(self.width, q.shape[1])
        q = np.pad(q, ((0, 0), (0, width - q.shape[1])))
        x = self.x if self.width == width else np.pad(self.x, ((0, 0), (0, width - self.width)))
        length = np.linalg.norm(q, axis=1)
        turned = self.rotate(q)
        head = turned[:, : self.head]
        rest = np.sqrt(np.maximum(0, length**2 - (head**2).sum(1)))
        best: list[list[tuple]] = [[] for _ in qid]
        floor = np.full(len(qid), -np.inf)  # the k-th score so far
        live = np.arange(len(qid))
        for at in range(0, len(self.ids), TILE):
            # no vector from here on is longer; equal scores may still win by id
            slack = 1e-9 * length[live] * self.size[at] + 1e-6
            live = live[length[live] * self.size[at] + slack >= floor[live]]
            if not len(live):
                break
            part = slice(at, at + TILE)
            bound = head[live] @ self.y[part].T + np.outer(rest[live], self.rest[part])
            bound += 1e-9 * np.outer(length[live], self.size[part]) + 1e-6
            may = bound >= floor[live, None]
            rows = np.flatnonzero(may.any(1))
            full = self.scores(q[live[rows]], x[part])
            for r, score in zip(rows, full, strict=True):
                i = live[r]
                hit = np.flatnonzero(may[r] & (score >= floor[i]))
                hit = hit[self.ids[at + hit] != qid[i]]
                if len(hit):
                    merged = best[i] + [(-int(s), int(j)) for s, j in zip(score[hit], self.ids[at + hit], strict=True)]
                    merged.sort()
                    best[i] = merged[: self.k]
                    if len(best[i]) == self.k:
                        floor[i] = -best[i][-1][0]
        flat = [(int(i), j, max(-(2**63), min(2**63 - 1, -s))) for i, b in zip(qid, best, strict=True) for s, j in b]
        return pa.RecordBatch.from_arrays([pa.array([f[c] for f in flat], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, query: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest products of each query; vectors and query have (id, v, n), v whole numbers."""
    turn = rotation(vectors)
    turn = np.zeros((0, 0)) if turn is None else turn
    shards = shard_count(vectors, vectors.count(), LEAST_ROWS, MOST_ROWS)
    partial = visit(vectors, query, shards, lambda ids, x, _: Shard(ids, x, turn, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer products for each fiftieth vector against all others."""
    rows = read(spark, sf_dir, "embeddings").where(whole(F.col("embedding")) & F.col("vec_id").isNotNull())
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    vectors = rows.select(F.col("vec_id").cast("long").alias("id"), v.alias("v"), F.lit(1).cast("long").alias("n"))
    return top_k(vectors, vectors.where(F.col("id") % QUERY_EVERY == 0))


SQL = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""
