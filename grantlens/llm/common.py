"""What the corpus operators share: tables, scratch space, components of graphs, vectorised word hashes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Python gets about so many bytes at once while a table is written (a longer row is a batch of its own).
BATCH_BYTES_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Scratch:
    """Parquet tables in the shared folder of spark.checkpoint.dir, which cut lineage and outlive executors.

    Where a local session (tests) names no folder, a temporary one is used and set, and removed at the end. On a cluster the folder
    must be named. The tables that a returned plan reads stay until clear() or until the folder is emptied.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get(CHECKPOINT_CONF, None)
        if not base:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError(f"{CHECKPOINT_CONF} must name a folder that the driver and all executors share")
            own = tempfile.mkdtemp(prefix="grantlens-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            base = f"file://{own}"
            spark.conf.set(CHECKPOINT_CONF, base)
        self.spark, self.root = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str, batch_rows: int | None = None) -> DataFrame:
        """Write and reread a table; batch_rows bounds the rows that Python gets at once meanwhile, BATCH_BYTES their bytes."""
        wanted = {BATCH_BYTES_CONF: str(BATCH_BYTES)} | ({BATCH_CONF: str(batch_rows)} if batch_rows else {})
        before = {name: self.spark.conf.get(name) for name in wanted}
        try:
            for name, value in wanted.items():
                self.spark.conf.set(name, value)
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(table))
        finally:
            for name, value in before.items():
                self.spark.conf.set(name, value)
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, table: str) -> None:
        """Delete a table that no returned plan reads any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(table))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        """Delete all tables."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Let Spark's cleaner delete shuffle files and broadcasts of plans that are finished with."""
        gc.collect()
        give_back()
        self.spark._jvm.System.gc()


_held: dict[Any, Any] = {}


def held(key: Any, make: Callable[[], Any]) -> Any:
    """An object that a Python worker keeps between tasks; workers serve many operators, and keep the object of one."""
    if key not in _held:
        make_room()
        _held[key] = make()
    return _held[key]


_trimmed = [0.0]


def make_room() -> None:
    """Let go of what another operator keeps in this worker, and now and then of memory that is free."""
    if not _held and time.monotonic() < _trimmed[0] + 5:
        return
    if _held:
        _held.clear()
        gc.collect()
    _trimmed[0] = time.monotonic()
    give_back()


def give_back() -> None:
    """Return memory that this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


#: A side of at most so many narrow rows is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 500_000


def sided(df: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A side of a join of few columns of numbers: broadcast if it has been counted and is small, else built by partition."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df.hint("shuffle_hash")


def components(scratch: Scratch, edges: DataFrame, tag: str) -> DataFrame:
    """(id, component_id) of each vertex of edges (a, b): the smallest id that it reaches.

    Alternating large-star and small-star rounds until every component is a star about its smallest id. Minima are taken by
    partial aggregation and joined back, so a vertex with very many neighbours is never gathered in one task. Each round is
    written to scratch.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # within a partition a spanning forest holds the same components with fewer edges
    now, i = scratch.save(both.mapInArrow(_forest, "a long, b long").distinct(), f"{tag}-0"), 0
    while not _all_stars(now):
        pair = now.select(F.col("a").alias("u"), F.col("b").alias("v"))
        und = pair.union(pair.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = und.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = und.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low2.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        now, i = scratch.save(small, f"{tag}-{i + 1}"), i + 1
        scratch.drop(f"{tag}-{i - 1}")
    roots = now.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return roots.union(now.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())


def _all_stars(edges: DataFrame) -> bool:
    """Whether no vertex of edges (a, b), a > b, has two smaller neighbours, or a smaller and a larger one."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("b").alias("v"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("e"))
    return ends.groupBy("e.v").agg(F.sum("e.down").alias("down"), F.max("e.up").alias("up")).where("down > 1 OR down = 1 AND up = 1").isEmpty()


def joined_components(scratch: Scratch, labels: DataFrame, edges: DataFrame, tag: str) -> DataFrame:
    """labels (id, component_id) after further edges (a, b): only the components that the edges join are worked on."""
    named = lambda end: F.coalesce(F.col(f"{end}_component"), F.col(end)).alias(end)
    side = lambda end: labels.select(F.col("id").alias(end), F.col("component_id").alias(f"{end}_component"))
    between = edges.join(side("a"), "a", "left").join(side("b"), "b", "left").select(named("a"), named("b"))
    new = components(scratch, between, f"{tag}-between")
    moved = labels.join(new.select(F.col("id").alias("component_id"), F.col("component_id").alias("now")), "component_id", "left")
    return scratch.save(moved.select("id", F.coalesce("now", "component_id").alias("component_id")).union(new).distinct(), f"{tag}-joined")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of each batch that union-find needs, in blocks of bounded size."""
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        up: dict[int, int] = {}
        keep = []

        def root(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                up.setdefault(min(x, y), min(x, y))
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))


def with_components(rows: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """rows with component_id; a row without links is its own component."""
    named = labels.select(F.col("id").alias(key), "component_id")
    return rows.join(named, key, "left").withColumn("component_id", F.coalesce("component_id", key))


# ---------------------------------------------------------------- texts as byte arrays

SLICE_BYTES = 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, x in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
        if size > 4 * SLICE_BYTES:  # a very long text: not kept
            return _powers.pop("up"), _powers.pop("down")
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes; a longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: Spans longer than this are hashed one by one.
_LONG_SPAN = 64
#: Masks of the first bytes of a word of eight.
KEPT = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span of data: eight bytes at a time through the finaliser, BLAKE2b for long ones."""
    size = end - start
    h = mix(size.astype(np.uint64) + _BASE)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    at_byte = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    left = np.flatnonzero(size <= _LONG_SPAN) if len(size) and size.max() > _LONG_SPAN else np.arange(len(size))
    for k in range(0, _LONG_SPAN, 8):
        left = left[size[left] > k]
        if not len(left):
            break
        h[left] = mix((h[left] ^ (at_byte[start[left] + k] & KEPT[np.minimum(size[left] - k, 8)])) * _BASE)
    for i in np.flatnonzero(size > _LONG_SPAN).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+; words do not cross bounds."""
    inside = ~WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end of each word of the lower-cased rows that bounds delimit in data."""
    starts, ends = word_spans(data, bounds)
    rows = np.searchsorted(bounds, starts, "right") - 1
    return span_hash(data, starts, ends), rows, starts, ends


def batches_of(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)
