"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its words (lower-cased, hashed into 2**WORD_BITS places, weights log(1 + count) scaled to length one),
statistics of its structure, and the metadata column n_chars where the table has it. The machine scores

    b + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)

in time linear in the number of features that are not zero. It is fitted by Adam on at most ROWS_PER_CLASS labelled rows of each
class, whose class weights restore the proportions among all labelled rows, so the score stays a probability. Statistics
are scaled by medians and quartiles of those rows. The model has (2**WORD_BITS + statistics) x (RANK + 1) numbers.

Edge cases: null and empty texts have all statistics zero and a score; texts are read whole; repeated rows score
alike; null or absent n_chars counts as the text's own length; ids with two labels, null labels and labels without document are
not used; when a class has no rows every score is the share of good rows among those used (1 without any); an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, give_back, make_room, read, slices, span_hash, text_bytes, word_spans
from .labels import remainder, sample, scored, verdicts

THRESHOLD = 0.7
ROWS_PER_CLASS = 3000
WORD_BITS = 16
RANK = 8
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.01, 1e-4
_class = {
    "upper": [*range(65, 91)],
    "lower": [*range(97, 123)],
    "digit": [*range(48, 58)],
    "bang": [*b"!?"],
    "bar": [*b"|<>{}[]=_*#/\\@&%$^~+"],
    "stop": [*b".,;:"],
    "white": [32, 9, 10, 11, 12, 13],
    "line": [10],
    "high": [*range(128, 256)],
}
_tables = {k: np.isin(np.arange(256), v) for k, v in _class.items()}
STATISTICS = [*_class, "bytes", "words", "distinct", "top", "repeat", "length", "lines", "meta"]


def features(texts: pa.Array, n_chars: pa.Array | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows a to b: a, b, row, place and weight of each distinct word, and the matrix of statistics."""
    make_room()
    data, offsets = text_bytes(texts)
    meta = None if n_chars is None else n_chars.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    for a, b in slices(offsets):
        part, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        n = np.diff(bounds)
        per = np.maximum(n, 1)
        stats = np.zeros((b - a, len(STATISTICS)))
        for j, table in enumerate(_tables.values()):
            sums = np.concatenate(([0], np.cumsum(table[part], dtype=np.int64)))
            stats[:, j] = (sums[bounds[1:]] - sums[bounds[:-1]]) / per
        starts, ends = word_spans(part, bounds)
        rows = np.searchsorted(bounds, starts, "right") - 1
        hashes = span_hash(LOWER[part], starts, ends)
        words = np.bincount(rows, minlength=b - a)
        some = np.maximum(words, 1)
        order = np.lexsort((hashes, rows))
        r, h = rows[order], hashes[order]
        first = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])))) if len(r) else np.zeros(0, int)
        count = np.diff(np.append(first, len(r)))
        r, h = r[first], h[first]
        distinct = np.bincount(r, minlength=b - a)
        top = np.zeros(b - a)
        np.maximum.at(top, r, count)
        again = (rows[1:] == rows[:-1]) & (hashes[1:] == hashes[:-1])
        column = dict(zip(STATISTICS, range(len(STATISTICS)), strict=True))
        stats[:, column["bytes"]] = np.log1p(n)
        stats[:, column["words"]] = np.log1p(words)
        stats[:, column["distinct"]] = distinct / some
        stats[:, column["top"]] = top / some
        stats[:, column["repeat"]] = np.bincount(rows[1:][again], minlength=b - a) / some
        stats[:, column["length"]] = np.bincount(rows, ends - starts, minlength=b - a) / some
        stats[:, column["lines"]] = _repeated_lines(part, bounds)
        chars = n if meta is None else np.where(np.isfinite(meta[a:b]) & (meta[a:b] >= 0), meta[a:b], n)
        stats[:, column["meta"]] = np.log1p(chars)
        weight = np.log1p(count)
        norm = np.sqrt(np.bincount(r, weight**2, minlength=b - a))
        yield a, b, r, (h & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64), weight / np.maximum(norm, 1e-9)[r], stats


def _repeated_lines(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Share of each row's lines that an earlier line of the row equals."""
    cut = np.flatnonzero(data == 10)
    starts = np.union1d(bounds[:-1], cut + 1)
    starts = starts[starts < len(data)]
    if not len(starts):
        return np.zeros(len(bounds) - 1)
    ends = np.append(starts[1:], len(data))
    rows = np.searchsorted(bounds, starts, "right") - 1
    hashes = span_hash(data, starts, ends - (data[ends - 1] == 10))
    keys = np.unique(np.stack((rows.astype(np.uint64), hashes), 1), axis=0)
    lines = np.bincount(rows, minlength=len(bounds) - 1)
    return 1 - np.bincount(keys[:, 0].astype(np.int64), minlength=len(bounds) - 1) / np.maximum(lines, 1) * (lines > 0) - (lines == 0)


class Machine:
    """A factorisation machine; word places come first, statistics after them."""

    def __init__(self, base: float):
        self.base = base
        self.w: np.ndarray | None = None
        self.v: np.ndarray | None = None
        self.b = 0.0
        self.mid = self.span = None

    def dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mid) / self.span, -4, 4) / 2

    def margins(self, n: int, r: np.ndarray, i: np.ndarray, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Scores before the sigmoid, by the sum-of-squares identity; r is sorted."""
        words = 1 << WORD_BITS
        sums = np.zeros((n, RANK))
        squares = z**2 @ (self.v[words:].astype(float) ** 2).sum(1)
        linear = z @ self.w[words:] + self.b
        if len(r):
            at = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            vx = self.v[i] * x[:, None].astype(np.float32)
            sums[r[at]] = np.add.reduceat(vx, at, axis=0)
            squares[r[at]] += np.add.reduceat((vx**2).sum(1), at)
            linear[r[at]] += np.add.reduceat(self.w[i] * x, at)
        sums += z @ self.v[words:]
        return linear + 0.5 * ((sums**2).sum(1) - squares)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, seed: int = 7) -> None:
        """rows: places, weights and statistics of each labelled text."""
        if not 0 < y.sum() < len(y):
            return
        words, d = 1 << WORD_BITS, len(STATISTICS)
        stats = np.array([s for _, _, s in rows])
        low, self.mid, high = np.percentile(stats, [25, 50, 75], axis=0)
        self.span = np.maximum(np.maximum(high - low, stats.std(0) / 2), 1e-4)
        z_all = self.dense(stats)
        rng = np.random.default_rng(seed)
        self.w = np.zeros(words + d, np.float32)
        self.v = rng.normal(0, 0.05, (words + d, RANK)).astype(np.float32)
        theta = [self.w, self.v]
        m, s = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
        mb = sb = 0.0
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for a in range(0, len(order), BATCH):
                pick = order[a : a + BATCH]
                r = np.repeat(np.arange(len(pick)), [len(rows[k][0]) for k in pick])
                i = np.concatenate([rows[k][0] for k in pick])
                x = np.concatenate([rows[k][1] for k in pick]).astype(np.float32)
                z = z_all[pick]
                p = 1 / (1 + np.exp(-np.clip(self.margins(len(pick), r, i, x, z), -30, 30)))
                g = (p - y[pick]) * weight[pick] / len(pick)
                sums = z @ self.v[words:]
                if len(r):
                    at = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
                    sums[r[at]] += np.add.reduceat(self.v[i] * x[:, None], at, axis=0)
                # gradients by place: words that occur and all statistics
                place = np.concatenate((i, np.tile(np.arange(words, words + d), len(pick))))
                row = np.concatenate((r, np.repeat(np.arange(len(pick)), d)))
                value = np.concatenate((x, z.ravel()))
                gw = g[row] * value
                gv = gw[:, None] * (sums[row] - self.v[place] * value[:, None])
                by = np.argsort(place, kind="stable")
                keys, start = np.unique(place[by], return_index=True)
                step += 1
                for k, grad in enumerate((np.add.reduceat(gw[by], start), np.add.reduceat(gv[by], start, axis=0))):
                    grad = grad + DECAY * theta[k][keys]
                    m[k][keys] = 0.9 * m[k][keys] + 0.1 * grad
                    s[k][keys] = 0.999 * s[k][keys] + 0.001 * grad**2
                    theta[k][keys] -= RATE * (m[k][keys] / (1 - 0.9**step)) / (np.sqrt(s[k][keys] / (1 - 0.999**step)) + 1e-7)
                mb, sb = 0.9 * mb + 0.1 * g.sum(), 0.999 * sb + 0.001 * g.sum() ** 2
                self.b -= RATE * (mb / (1 - 0.9**step)) / (np.sqrt(sb / (1 - 0.999**step)) + 1e-7)

    def score(self, texts: pa.Array, n_chars: pa.Array | None) -> np.ndarray:
        out = np.full(len(texts), self.base)
        if self.w is not None:
            for a, b, r, i, x, stats in features(texts, n_chars):
                out[a:b] = 1 / (1 + np.exp(-np.clip(self.margins(b - a, r, i, x, self.dense(stats)), -30, 30)))
        return out


def _columns(docs: DataFrame) -> list[str]:
    meta = [c for c, kind in docs.dtypes if c == "n_chars" and kind in ("bigint", "int", "smallint", "double", "float")]
    return ["doc_id", "text", *meta]


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column(batch.num_columns - 1)
        meta = batch.column(2) if batch.num_columns == 4 else None
        for a, b, r, i, x, stats in features(batch.column(1), meta):
            at = np.searchsorted(r, np.arange(b - a + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(i, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.float32())),
                    pa.array(list(stats), pa.list_(pa.float64())),
                    labels.slice(a, b - a),
                ],
                names=["doc_id", "places", "weights", "stats", "label"],
            )


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Machine:
    """A machine fitted on at most rows_per_class labelled rows of each class; their features come to the driver."""
    chosen = sample(labels, "quality", rows_per_class).select("doc_id", "label")
    columns = _columns(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *columns[2:]).join(F.broadcast(chosen), "doc_id")  # bounded by rows_per_class
    made = rows.mapInArrow(_features_of, "doc_id long, places array<int>, weights array<float>, stats array<double>, label int").toArrow().sort_by([("doc_id", "ascending")])
    y = made.column("label").to_numpy().astype(float)
    # shares of the classes among all labelled rows that may be used
    share = dict(labels.where("quality IN (0, 1)").where(remainder(F.col("doc_id")) != 2).groupBy("quality").count().collect())
    good = share.get(1, 0) / max(1, sum(share.values())) if share else 1.0
    machine = Machine(float(good))
    if len(y):
        weight = np.where(y == 1, good / max(y.mean(), 1e-9), (1 - good) / max(1 - y.mean(), 1e-9))
        places, weights = made.column("places").combine_chunks(), made.column("weights").combine_chunks()
        flat_i, flat_x, at = places.flatten().to_numpy().astype(np.int64), weights.flatten().to_numpy(), np.concatenate(([0], np.cumsum(np.diff(places.offsets.to_numpy()))))
        stats = made.column("stats").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
        machine.fit([(flat_i[a:b], flat_x[a:b], s) for a, b, s in zip(at[:-1], at[1:], stats, strict=True)], y, weight)
        del made, places, weights, flat_i, flat_x, stats
    give_back()
    return machine


def score(docs: DataFrame, machine: Machine, keep: bool = False) -> DataFrame:
    """docs with the score of each text, all columns kept or (doc_id, score)."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # (2**WORD_BITS + statistics) x (RANK + 1) numbers

    def make() -> Callable:
        return lambda batch: sent.value.score(batch.column(1).cast(pa.string()), batch.column(2) if batch.num_columns > 2 else None)

    return scored(docs, _columns(docs), make, keep)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text."""
    docs = read(spark, sf_dir, "documents")
    return verdicts(score(docs, fit(docs, read(spark, sf_dir, "labels"))), THRESHOLD)
