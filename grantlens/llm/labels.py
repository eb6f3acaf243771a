"""Which labelled rows a classifier may see, and its scores as a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column) -> Column:
    """crc32 of the id's decimal text modulo 4; 2 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def usable(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label, fold) of labelled rows that are not held out. Rows without id or label, and ids with two labels, are not used."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    return rows.withColumn("fold", remainder(F.col("doc_id")).cast("int")).where("fold <> 2")


def sample(labels: DataFrame, label: str, rows_per_class: int) -> DataFrame:
    """(doc_id, label, fold) of at most rows_per_class usable rows of each class, lowest hash first.

    Its size has that bound, so it may be broadcast.
    """
    rows = usable(labels, label)
    order = (F.xxhash64("doc_id", F.lit(17)), F.col("doc_id"))
    return rows.where("label = 0").orderBy(*order).limit(rows_per_class).union(rows.where("label = 1").orderBy(*order).limit(rows_per_class))


def class_weights(labels: DataFrame, label: str, rows_per_class: int) -> np.ndarray:
    """How many usable rows of class 0 and of class 1 each row of sample() stands for."""
    n = dict(usable(labels, label).groupBy("label").count().collect())
    return np.array([max(1.0, n.get(k, 0) / rows_per_class) for k in (0, 1)])


def scored(docs: DataFrame, columns: list[str], score: Callable[[], Callable[[pa.RecordBatch], np.ndarray]], keep: bool) -> DataFrame:
    """docs with a column of scores.

    score() is called once a task and gives a function of batches of `columns`. With keep, all columns of docs stay and the score's
    column has a name that none of them has; without, the result is (doc_id, score).
    """
    name = "score"
    while keep and name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    rows = docs if keep else docs.select(*columns)
    places = [rows.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = score()
        for batch in batches:
            values = pa.array(f(pa.RecordBatch.from_arrays([batch.column(i) for i in places], names=columns)), pa.float64())
            if keep:
                yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["doc_id", "score"])

    schema = rows.schema if keep else rows.select("doc_id").schema
    from pyspark.sql.types import DoubleType, StructType

    return rows.mapInArrow(run, StructType([*schema.fields]).add(name, DoubleType()))


def verdicts(scores: DataFrame, threshold: float) -> DataFrame:
    held = remainder(F.col("doc_id")) == 2
    return scores.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 60, counts: np.ndarray | None = None) -> np.ndarray:
    """Weights of a ridge logistic regression by damped Newton steps; the last is the constant. A row may count as several."""
    counts = np.ones(len(y)) if counts is None else counts
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    pull = np.full(len(w), ridge)
    pull[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (counts * p * (1 - p))) @ x + np.diag(pull + 1e-9), x.T @ (counts * (p - y)) + pull * w)
        w -= step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
    return w
