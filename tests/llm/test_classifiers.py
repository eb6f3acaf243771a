import zlib
from collections import Counter

import numpy as np
import pytest

from grantlens.llm import quality_fm, registry, toxicity
from grantlens.llm.common import Scratch

from .cases import TEXTS, documents, empty


def labels(spark, rows=None):
    return spark.createDataFrame(rows or [(3 * i, i % 2, (i + 1) % 2) for i in range(len(TEXTS))] + [(0, 0, 0), (None, 1, 1), (3, None, None), (999, 1, 1)], "doc_id long, quality int, toxic int")


def test_awkward_documents(spark):
    docs = documents(spark)
    for table in (labels(spark), labels(spark).where("1 = 0"), labels(spark).where("quality = 1")):
        model = toxicity.fit(docs, table, Scratch(spark, "t"))
        machine = quality_fm.fit(docs, table)
        for scored in (toxicity.score(docs, model, keep=True), quality_fm.score(docs, machine, keep=True)):
            name = next(c for c in scored.columns if c not in docs.columns)
            assert name == "_score" and scored.count() == docs.count()
            assert scored.where(f"{name} IS NULL OR NOT {name} BETWEEN 0 AND 1").count() == 0
        assert toxicity.score(empty(spark), model).count() == 0 and quality_fm.score(empty(spark), machine).count() == 0
    assert toxicity.fit(empty(spark), labels(spark), Scratch(spark, "t")).weights is None
    assert quality_fm.fit(empty(spark), labels(spark)).w is None


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    m = quality_fm.Machine(0.5)
    words, d = 1 << quality_fm.WORD_BITS, len(quality_fm.STATISTICS)
    m.w, m.v, m.b = rng.normal(size=words + d).astype(np.float32), rng.normal(size=(words + d, quality_fm.RANK)).astype(np.float32), 0.3
    i, x, z = np.array([5, 9, 70]), np.array([0.5, 1.0, 0.2]), rng.normal(size=(2, d))
    r = np.array([0, 0, 1])
    got = m.margins(2, r, i, x, z)
    for row in range(2):
        place = np.concatenate((i[r == row], np.arange(words, words + d)))
        value = np.concatenate((x[r == row], z[row]))
        want = 0.3 + m.w[place] @ value + sum(float(m.v[p] @ m.v[q]) * value[a] * value[b] for a, p in enumerate(place) for b, q in enumerate(place) if a < b)
        assert got[row] == pytest.approx(want, rel=1e-4)


def test_grams_are_of_one_row_each():
    key, bounds = toxicity.grams(["Ab, c", None, "", "É" * 3])
    assert np.diff(bounds).tolist() == [6, 1, 1, 4]
    n = toxicity.ORDER
    padded = " " * (n - 1) + "ab  c" + " "
    assert key[:6].tolist() == [sum(ord(c) << 12 * (n - 1 - i) for i, c in enumerate(padded[k : k + n])) for k in range(6)]
    assert key[8] & 4095 == ord("é")


@pytest.mark.parametrize(("name", "label", "sf", "least", "rank", "recall"), [("op5_toxicity", "toxic", "0.1", 0.95, 0.94, 0.8), ("op5_toxicity", "toxic", "0.01", 0.9, 0.8, 0.6), ("op6_quality", "quality", "0.01", 0.95, 0.95, 0.9)])
def test_held_out_accuracy(spark, name, label, sf, least, rank, recall):
    data = f"/root/testdata/sf{sf}"
    rows = registry.QUERIES[name](spark, data).collect()
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    assert len(rows) == float(sf) * 100_000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= least * len(held)
    # held-out rows of the rarer class: how well scores rank them, and how many are found
    rare = 1 if label == "toxic" else 0
    ours = [r.score if rare else -r.score for r in held if truth[r.doc_id] == rare]
    theirs = [r.score if rare else -r.score for r in held if truth[r.doc_id] != rare]
    assert sum((a > b) + 0.5 * (a == b) for a in ours for b in theirs) >= rank * len(ours) * len(theirs)
    found = [r.predicted == rare for r in held if truth[r.doc_id] == rare]
    assert len(found) > 5 and sum(found) >= recall * len(found)


def test_toxicity_keeps_class_proportions(spark):
    # 300 toxic rows among 3600: a cap of 300 rows a class uses all of them and every eleventh of the others
    rng = np.random.default_rng(3)
    rows = [(i, " ".join([f"word{rng.integers(50)}" for _ in range(20)] + ["vile"] * int(rng.random() < (0.7 if i % 12 == 0 else 0.1)))) for i in range(3600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame([(i, int(i % 12 == 0)) for i in range(3600)], "doc_id long, toxic int")
    got = [toxicity.score(docs, toxicity.fit(docs, table, Scratch(spark, "t"), rows_per_class=most)).toPandas().score.mean() for most in (300, 10_000)]
    assert got[1] == pytest.approx(1 / 12, abs=0.05)
    assert got[0] == pytest.approx(got[1], abs=0.08)


def test_counted_rows_are_repeated_rows():
    rng = np.random.default_rng(5)
    evidence, y = rng.normal(size=(60, 5)) * 0.1, (np.arange(60) % 3 == 0).astype(float)
    counts = np.where(y == 1, 1, 7)
    one, other = (toxicity.Model(None) for _ in range(2))
    one.fit(evidence, y, counts)
    other.fit(np.repeat(evidence, counts, axis=0), np.repeat(y, counts))
    assert one.base == pytest.approx(other.base) and one.weights == pytest.approx(other.weights, abs=1e-6)


def test_no_gram_is_evicted(spark):
    # a table of few places, and frequent n-grams that no labelled row holds
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"word{rng.integers(300)}" for _ in range(40)) + (" vile" if i % 4 == 0 else "")) for i in range(200)]
    rows += [(1000 + i, " ".join(f"word{rng.integers(5000)}" for _ in range(200))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(docs, table, Scratch(spark, "t"))
    # the same by hand: counts of each class, backoff counts of all documents
    count, every = (Counter(), Counter()), set()
    for i, text in rows:
        keys = toxicity.grams([text])[0].tolist()
        every.update(keys)
        if i < 200 and zlib.crc32(str(i).encode()) % 4 != 2:
            count[int(i % 4 == 0)].update(keys)
    bits, d = toxicity.BITS, toxicity.DISCOUNT
    # shared counts: of each n-gram of four characters and fewer, the different characters before it
    orders = {5: every}
    for n in (4, 3, 2, 1):
        orders[n] = Counter(k & ((1 << n * bits) - 1) for k in set(orders[n + 1]))
    history = {n: (Counter(), Counter()) for n in orders}
    for n in (4, 3, 2, 1):
        for k, m in orders[n].items():
            history[n][0][k >> bits] += m
            history[n][1][k >> bits] += 1

    def backoff(n, k):
        k &= (1 << n * bits) - 1
        all_n, all_kinds = (h[k >> bits] for h in history[n])
        if n == 1:
            return orders[1][k] / all_n
        return (orders[n][k] - d + d * all_kinds * backoff(n - 1, k)) / all_n

    total, kinds = (Counter(), Counter()), (Counter(), Counter())
    for c in (0, 1):
        for k, n in count[c].items():
            total[c][k >> bits] += n
            kinds[c][k >> bits] += 1

    def chance(c, k):
        shared = backoff(4, k)
        n = total[c][k >> bits]
        return (max(count[c][k] - d, 0) + d * kinds[c][k >> bits] * shared) / n if n else shared

    keys = sorted(every)
    want = [np.log(chance(1, k) / chance(0, k)) for k in keys]
    assert model.table.value.ratios(np.array(keys, np.uint64)) == pytest.approx(np.array(want), abs=1e-5)
    assert len(keys) > 500 and any(k not in count[0] and k not in count[1] and w for k, w in zip(keys, want, strict=True))
