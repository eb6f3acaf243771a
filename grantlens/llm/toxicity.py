"""Toxicity by class-conditional Kneser-Ney models of characters.

Both classes have counts of five-character n-grams from labelled documents. Each is discounted and backs off to one shared model of
four, three, two characters and one, interpolated order by order: there an n-gram counts as often as there are different
characters before it, over all documents of the corpus. So a form that neither class has seen
costs both the same, and inflections of rare expressions share what their stems have shown.

A document's evidence is the difference of the two log-likelihoods: normalised by its length, and for its three most toxic
words. A logistic regression on these gives the score; it is fitted on a third of the labelled rows, by class counts that leave
their n-grams out, and then scores by counts that hold them as well. Where a class has more than ROWS_PER_CLASS rows, each row used counts for those that it stands for, so the classes keep
their proportions.

Texts are lower-cased, punctuation counts as space, and of each character 12 bits are kept. Class counts come from at most ROWS_PER_CLASS labelled rows of
each class; the shared counts come from every document and grow with the corpus. An n-gram that neither class has seen has a ratio
that follows from its first four characters alone, and without evidence if neither class has seen those. So the model that is sent to
executors holds every n-gram and every context of the labelled rows used, and loses none: it grows with their text, not with the
corpus. They are found by a hash index of about as many places as entries.

Edge cases: null and empty texts score by their length alone; texts of any length are read whole; repeated rows score alike; ids
without label, labels without document and null labels are not used; when a class has no rows, every score is the
weighted share of toxic rows among those used (0 without any); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Scratch, give_back, make_room, mix, read, slices, text_bytes
from .labels import class_weights, logistic, sample, scored, verdicts

THRESHOLD = 0.3
ROWS_PER_CLASS = 12_000
ORDER = 5
BITS = 12
DISCOUNT = 0.75
RIDGE = 0.1
_fold = np.arange(1 << BITS, dtype=np.uint64)
_fold[[c for c in b" \t\n\v\f\r.,!?;:|\"()"]] = 32
#: marks a key that is a context
_CONTEXT = np.uint64(1 << BITS * ORDER)
_SPACE, _LAST = np.uint64(32), np.uint64((1 << BITS) - 1)
#: n-grams in memory before a task sums them up
_HELD = 1 << 21


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of texts as numbers of BITS bits a place, one for each character and one for the end, and the bounds of texts."""
    low = [(t or "").lower() for t in texts]
    count = np.array([len(t) + 1 for t in low], np.int64)
    sizes = count + ORDER - 1  # spaces before and after each text
    pad = " " * (ORDER - 1)
    joined = "".join([f"{pad}{t} " for t in low])
    units = _fold[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32) & np.uint32(_LAST)]
    n = max(0, len(units) - ORDER + 1)
    key = np.zeros(n, np.uint64)
    for i in range(ORDER):
        key = (key << np.uint64(BITS)) | units[i : i + n]
    # those that span two texts go
    bounds = np.concatenate(([0], np.cumsum(count)))
    first = np.repeat(np.cumsum(sizes) - sizes - bounds[:-1], count)
    return key[first + np.arange(len(first))], bounds


def _runs(texts: pa.Array, most: int) -> Iterator[tuple[int, int, list[str | None]]]:
    """Runs a to b of texts with about `most` bytes."""
    make_room()
    _, offsets = text_bytes(texts)
    for a, b in slices(offsets, most):
        yield a, b, texts.slice(a, b - a).to_pylist()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, label, n) for batches (text, label); label -1 where there is none to count."""
    held: dict[int, list] = {}
    many: dict[int, int] = {}

    def flush(label: int) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in held[label]])
        order = np.argsort(keys)
        keys, n = keys[order], np.concatenate([n for _, n in held[label]])[order]
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        keys, n = keys[at], np.add.reduceat(n, at)
        held[label], many[label] = [(keys, n)], len(keys)
        return keys, n

    for batch in batches:
        labels = batch.column(1).to_numpy(zero_copy_only=False)
        for a, b, texts in _runs(batch.column(0), SLICE_BYTES):
            key, bounds = grams(texts)
            own = np.repeat(labels[a:b], np.diff(bounds))
            for label in np.unique(own):
                keys, n = np.unique(key[own == label], return_counts=True)
                label = int(label)
                held.setdefault(label, []).append((keys, n))
                many[label] = many.get(label, 0) + len(keys)
                if many[label] > _HELD:
                    flush(label)
                    if many[label] > _HELD // 2:
                        yield _rows(label, *held[label][0])
                        held[label], many[label] = [], 0
    for label in held:
        if held[label]:
            yield _rows(label, *flush(label))


def _rows(label: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(np.full(len(keys), label, np.int32)), pa.array(n.astype(np.int64))], names=["gram", "label", "n"])


class Ratios:
    """The log-likelihood ratios of n-grams and contexts by an index of their hashes."""

    def __init__(self, key: np.ndarray, ratio: np.ndarray):
        self.bits = max(1, len(key).bit_length())
        h = mix(key)
        order = np.argsort(h)
        # entries stand in the order of their hashes, those of place i from start[i]
        self.key, self.ratio = key[order], np.concatenate((ratio[order], [0])).astype(np.float32)
        self.start = np.searchsorted(h[order] >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    def places(self, key: np.ndarray) -> np.ndarray:
        """Where each key's entry is; -1 without one."""
        slot = (mix(key) >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.start[slot], self.start[slot + 1]
        found = np.full(len(key), -1, np.int32)
        todo = np.flatnonzero(at < end)
        while len(todo):
            same = self.key[at[todo]] == key[todo]
            found[todo[same]] = at[todo[same]]
            todo = todo[~same]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return found

    def ratios(self, key: np.ndarray) -> np.ndarray:
        at = self.places(key)
        unseen = np.flatnonzero(at < 0)
        at[unseen] = self.places((key[unseen] >> np.uint64(BITS)) | _CONTEXT)
        return self.ratio[at]  # the last is 0

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """For each row: the mean ratio, those of its three most toxic words, and the log of its length."""
        out = np.zeros((len(texts), 5))
        for a, b, part in _runs(texts, SLICE_BYTES):
            key, bounds = grams(part)
            sums = np.concatenate(([0.0], np.cumsum(self.ratios(key), dtype=np.float64)))
            n = np.diff(bounds)
            out[a:b, 0] = (sums[bounds[1:]] - sums[bounds[:-1]]) / n
            out[a:b, 4] = np.log(n)
            ends = np.flatnonzero((key & _LAST) == _SPACE) + 1  # each row's last n-gram is one
            row = np.searchsorted(bounds, ends - 1, "right") - 1
            word = np.diff(sums[np.concatenate(([0], ends))])
            first = np.searchsorted(row, np.arange(b - a))
            for j in (1, 2, 3):
                top = np.maximum.reduceat(word, first)
                out[a:b, j] = np.maximum(top, -20)
                hit = np.flatnonzero(word == top[row])
                word[hit[np.unique(row[hit], return_index=True)[1]]] = -20.0
        return out


class Model:
    """The regression on the evidence that a table of ratios gives; the table is a broadcast."""

    def __init__(self, table: Broadcast | None):
        self.table = table
        self.weights: np.ndarray | None = None
        self.mean = self.scale = None
        self.base = 0.0

    @staticmethod
    def design(evidence: np.ndarray) -> np.ndarray:
        mean, w1, w2, w3, n = evidence.T
        return np.column_stack((np.clip(mean, -0.1, 0.3) * 20, np.maximum(mean, 0) * 20, w1 / 5, w2 / 5, w3 / 5, n, w1 / 5 * n, np.minimum(w1, 12) / 5, np.maximum(w1 - 10, 0) / 5))

    def fit(self, evidence: np.ndarray, y: np.ndarray, counts: np.ndarray | None = None) -> None:
        """The regression on rows of evidence; counts is how many rows each stands for, one by default."""
        counts = np.ones(len(y)) if counts is None else counts
        if len(y):
            self.base = float(np.average(y, weights=counts))
        if len(y) and 0 < y.sum() < len(y):
            x = self.design(evidence)
            self.mean = np.average(x, axis=0, weights=counts)
            self.scale = np.maximum(np.sqrt(np.average((x - self.mean) ** 2, axis=0, weights=counts)), 1e-6)
            self.weights = logistic((x - self.mean) / self.scale, y, RIDGE, counts=counts)

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.base)
        x = (self.design(self.table.value.evidence(texts)) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """A model from labelled rows (the regression on fold 3 by the counts of folds 0 and 1, scores by those of all three) and the n-grams of all documents."""
    chosen = scratch.save(sample(labels, "toxic", rows_per_class), "toxic-sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    use = texts.join(F.broadcast(chosen), "doc_id", "left")  # bounded by rows_per_class
    # label + 2 in the fold that the regression learns from, -1 without label: every document's n-grams are in the shared counts
    label = F.when(F.col("fold") == 3, F.col("label") + 2).otherwise(F.coalesce("label", F.lit(-1)))
    counted = use.select("text", label.cast("int").alias("label")).mapInArrow(_counts, "gram long, label int, n long")
    per = lambda *k: F.sum(F.when(F.col("label").isin(*k), F.col("n")).otherwise(0))
    sums = (per(1).alias("toxic_part"), per(0).alias("ordinary_part"), per(1, 3).alias("toxic"), per(0, 2).alias("ordinary"))
    table = scratch.save(counted.groupBy("gram").agg(*sums), "grams", 4000)
    shared = scratch.save(_shared(table, scratch), "shared")
    part = _sent(_ratios(table.select("gram", F.col("toxic_part").alias("toxic"), F.col("ordinary_part").alias("ordinary")), shared))
    check = use.where("fold = 3").select("text", "label").mapInArrow(_evidence_of(part), "e array<double>, label int").toArrow()
    y = check.column("label").to_numpy()
    evidence = check.column("e").combine_chunks().flatten().to_numpy().reshape(-1, 5)
    model = Model(_sent(_ratios(table.select("gram", "toxic", "ordinary"), shared)))
    model.fit(evidence, y.astype(float), class_weights(labels, "toxic", rows_per_class)[y])
    part.destroy()
    for name in ("grams", "kinds", "shared", "toxic-sample"):
        scratch.drop(name)
    give_back()
    return model


def _sent(ratios: DataFrame) -> Broadcast:
    """The table of n-grams and contexts of the rows chosen on all executors: 12 bytes for each entry and about 4 for each place."""
    entries = ratios.toArrow()
    return ratios.sparkSession.sparkContext.broadcast(Ratios(entries.column("key").to_numpy().astype(np.uint64), entries.column("ratio").to_numpy()))


def _shared(table: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, shared): the chance of the last of ORDER - 1 characters after those before, in the model that both classes back off to.

    In each order an n-gram counts once for each different character before it.
    """
    last = lambda c, k: F.col(c).bitwiseAND((1 << BITS * k) - 1)
    kinds = scratch.save(table.groupBy(last("gram", ORDER - 1).alias("g")).agg(F.count("*").alias("n")), "kinds")
    orders = [kinds]
    for k in range(ORDER - 2, 0, -1):
        orders.append(orders[-1].groupBy(last("g", k).alias("g")).agg(F.count("*").alias("n")))
    chance = None
    for k, rows in enumerate(reversed(orders), 1):
        # a context's group is no larger than the alphabet of 2**BITS characters
        same = Window.partitionBy("context")
        rows = rows.withColumn("context", F.shiftright("g", BITS)).withColumn("all_n", F.sum("n").over(same)).withColumn("all_kinds", F.count("*").over(same))
        if chance is None:
            p = F.col("n") / F.col("all_n")
        else:
            rows = rows.withColumn("lower", last("g", k - 1)).join(chance.select(F.col("g").alias("lower"), F.col("shared").alias("q")), "lower")
            p = (F.col("n") - DISCOUNT + DISCOUNT * F.col("all_kinds") * F.col("q")) / F.col("all_n")
        chance = rows.select("g", p.alias("shared"))
    return chance


def _ratios(table: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, ratio): the log of how much likelier its last character is for the toxic class, for each n-gram that a class has seen;
    and of how much likelier an unseen one is, for each context."""
    low = F.col("gram").bitwiseAND((1 << BITS * (ORDER - 1)) - 1)
    counts = table.select("gram", "toxic", "ordinary", F.shiftright("gram", BITS).alias("context"), low.alias("low"))
    backoff = shared.withColumnRenamed("g", "low")
    grams = counts.where("toxic + ordinary > 0")
    seen = lambda c: F.sum((F.col(c) > 0).cast("int"))
    sums = [f(c).alias(f"{c}_{name}") for c in ("toxic", "ordinary") for name, f in (("sum", F.sum), ("kinds", seen))]
    context = grams.groupBy("context").agg(*sums)
    rows = grams.join(context, "context").join(backoff, "low")

    def chance(c: str) -> Column:
        kept = F.greatest(F.col(c) - F.lit(DISCOUNT), F.lit(0.0))
        return F.when(F.col(f"{c}_sum") > 0, (kept + DISCOUNT * F.col(f"{c}_kinds") * F.col("shared")) / F.col(f"{c}_sum")).otherwise(F.col("shared"))

    def unseen(c: str) -> Column:
        """chance of an n-gram that the class has not seen, without the factor `shared` that both classes have."""
        return F.when(F.col(f"{c}_sum") > 0, DISCOUNT * F.col(f"{c}_kinds") / F.col(f"{c}_sum")).otherwise(F.lit(1.0))

    ratio = lambda f: F.log(f("toxic") / f("ordinary")).cast("float").alias("ratio")
    return rows.select(F.col("gram").alias("key"), ratio(chance)).union(context.select(F.col("context").bitwiseOR(1 << BITS * ORDER).alias("key"), ratio(unseen)))


def _evidence_of(sent: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = sent.value.evidence(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(e), pa.list_(pa.float64())), batch.column(1)], names=["e", "label"])

    return run


def score(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """docs with the score of each text, all columns kept or (doc_id, score)."""
    return scored(docs, ["doc_id", "text"], lambda: lambda batch: model.score(batch.column(1).cast(pa.string())), keep)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text."""
    docs = read(spark, sf_dir, "documents")
    return verdicts(score(docs, fit(docs, read(spark, sf_dir, "labels"), Scratch(spark, "toxicity"))), THRESHOLD)
