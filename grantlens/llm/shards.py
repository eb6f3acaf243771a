"""Vectors in shards, each visited by a stream of query vectors: shared by the searches on vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import make_room


def shard_count(df: DataFrame, n: int, least_rows: int, most_rows: int) -> int:
    """As many shards as the session has cores, but none below least_rows; more when a shard would pass most_rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(cores, -(-n // least_rows)), -(-n // most_rows))


def whole(vector: Column) -> Column:
    """Whether a vector is neither null nor empty and has no null or non-finite component."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ok, F.lit(False))


def spread(shards: int) -> list[int]:
    """One number for each shard such that hash partitioning into as many partitions puts each in one of its own."""

    def turn(x: int, n: int) -> int:
        return (x << n | x >> (32 - n)) & 0xFFFFFFFF

    def place(i: int) -> int:  # Spark's hash of an int (Murmur3, seed 42), modulo the partitions
        h = 42 ^ turn(i * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
        h = (turn(h, 13) * 5 + 0xE6546B64 & 0xFFFFFFFF) ^ 4
        h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        h ^= h >> 16
        return (h - (h >> 31 << 32)) % shards

    found: dict[int, int] = {}
    i = 0
    while len(found) < shards:
        found.setdefault(place(i), i)
        i += 1
    return [found[k] for k in range(shards)]


def visit(rows: DataFrame, queries: DataFrame, shards: int, make: Callable, schema: str) -> DataFrame:
    """Apply make(ids, vectors, extra) -> search once to each shard, and search(ids, vectors) -> RecordBatch to its queries.

    rows and queries have (id long, v array<double>, n long). Each row goes to one shard; each query to all. A shard's rows come
    first in its partition, then queries in blocks, so a task holds one shard and one block.
    """
    names = F.array(*[F.lit(x) for x in spread(shards)])
    own = rows.select("id", "v", "n", F.get(names, F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).alias("shard"), F.lit(0).alias("kind"))
    ask = queries.select("id", "v", "n", F.explode(names).alias("shard"), F.lit(1).alias("kind"))
    dealt = own.union(ask).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        current, ids, vectors, extra, search = None, [], [], [], None
        for batch in batches:
            for block in range(0, batch.num_rows, 512):
                part = batch.slice(block, 512)
                shard = part.column(3).to_numpy(zero_copy_only=False)
                kind = part.column(4).to_numpy(zero_copy_only=False)
                at = np.concatenate(([0], np.flatnonzero(np.diff(shard) | np.diff(kind)) + 1, [len(shard)]))
                for a, b in zip(at[:-1], at[1:], strict=True):
                    if shard[a] != current:
                        current, ids, vectors, extra, search = shard[a], [], [], [], None
                    piece = part.slice(a, b - a)
                    v = _matrix(piece.column(1))
                    i = piece.column(0).to_numpy(zero_copy_only=False)
                    if kind[a] == 0:
                        ids.append(i)
                        vectors.append(v)
                        extra.append(piece.column(2).to_numpy(zero_copy_only=False))
                        continue
                    if not ids:
                        continue  # a shard without rows
                    if search is None:
                        width = max(x.shape[1] for x in vectors)
                        search = make(np.concatenate(ids), np.concatenate([_wide(x, width) for x in vectors]), np.concatenate(extra))
                        vectors = []
                        ids = [0]
                    out = search(i, v)
                    if out is not None and out.num_rows:
                        yield out

    return dealt.mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as one matrix; shorter rows are filled with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    width = int(sizes.max()) if len(sizes) else 0
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))
