import hashlib

import pytest
from pyspark.sql import functions as F

from grantlens.llm import suffix_dedup
from grantlens.llm.common import Scratch

from .cases import documents, empty


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for b in data:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = []
    for b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def run(docs, spark, **options):
    made = suffix_dedup.cut(docs, suffix_dedup.repeated_spans(docs, Scratch(spark, "t"), **options))
    name = next(c for c in made.columns if c not in docs.columns)
    return made, name


@pytest.mark.parametrize(("length", "core"), [(200, 100), (40, 20)])
def test_equals_brute_force(spark, length, core):
    docs = documents(spark).repartition(3)
    made, name = run(docs, spark, length=length, core=core)
    assert [c for c in made.columns if c != name] == docs.columns
    rows = made.select("text", f"{name}.*").collect()
    want = brute([r.text for r in rows], length)
    got = [(r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows]
    assert got == want and sum(w[1] for w in want) > 1000


@pytest.mark.parametrize("sizes", [{"hot_runs": 1, "piece": 300}, {"held": 50}, {"hot_runs": 1, "sampled": 1}, {"hot_runs": 2, "sampled": 1, "held": 7}, {"hot_runs": 1, "sampled": 2}])
def test_sizes_change_no_result(spark, sizes):
    # hot runs by window, with and without knowing their cores before, families sent on when few entries are held
    docs = documents(spark).repartition(3)
    made, name = run(docs, spark, length=60, core=30, sizes=suffix_dedup.Sizes(**sizes))
    rows = made.select("text", f"{name}.n_removed", f"{name}.n_spans").collect()
    assert [(r.n_removed, r.n_spans) for r in rows] == [w[1:3] for w in brute([r.text for r in rows], 60)]


def test_line_that_most_texts_hold(spark):
    # a core with hundreds of different runs, and windows of one text among them
    import random

    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    line = " ".join(rng.choices(words, k=9))  # shorter than a window, longer than a core
    long = " ".join(rng.choices(words, k=30))
    texts = [f"{' '.join(rng.choices(words, k=20))} {line if i % 3 else long} {' '.join(rng.choices(words, k=20))}" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for sizes in ({}, {"hot_runs": 20, "sampled": 4}, {"hot_runs": 20, "sampled": 4, "held": 100}, {"hot_runs": 20}):
        made, name = run(docs, spark, length=60, core=30, sizes=suffix_dedup.Sizes(**sizes))
        rows = made.select("text", f"{name}.n_removed", f"{name}.n_spans").collect()
        want = brute([r.text for r in rows], 60)
        assert [(r.n_removed, r.n_spans) for r in rows] == [w[1:3] for w in want] and sum(w[1] for w in want) > 100 * len(long)


@pytest.mark.parametrize("core", [5, 8, 30])
def test_fingerprints_are_of_the_strings_alone(core):
    import numpy as np

    rng = np.random.default_rng(4)
    # two symbols, their exchange and powers of two as lengths: what cancels in sums of plain bytes
    signs = np.array([bin(i).count("1") & 1 for i in range(128)])
    blocks = [np.where(signs ^ swap, 65, 97).astype(np.uint8) for swap in (0, 1)]
    data = np.concatenate([rng.integers(97, 99, 40).astype(np.uint8), blocks[0], blocks[1], blocks[0], blocks[0], blocks[1]])
    length = 128
    at = np.arange(len(data) - length + 1)
    keys = suffix_dedup._window_keys(data, np.array([0]), np.array([len(at)]), length, core)
    texts = [data[i : i + length].tobytes() for i in at]
    assert len(set(texts)) < len(texts) and len({*zip(keys.tolist(), texts, strict=True)}) == len(set(texts)) == len(set(keys.tolist()))
    one = suffix_dedup.anchors(data, length, core)
    two = suffix_dedup.anchors(data[7:], length, core)
    runs = {data[s : s + r + length - 1].tobytes(): w for w, s, r in zip(*(x.tolist() for x in one[1:4]), strict=True)}
    again = {data[7 + s : 7 + s + r + length - 1].tobytes(): w for w, s, r in zip(*(x.tolist() for x in two[1:4]), strict=True)}
    assert len(set(runs.values())) == len(runs) and all(runs[t] == w for t, w in again.items() if t in runs) and runs.keys() & again.keys()


def test_family_levels():
    import numpy as np

    rng = np.random.default_rng(1)
    family, got, every = suffix_dedup.Family(1), [], []
    for _ in range(40):
        key = rng.integers(0, 400, 25).astype(np.uint64)
        value = np.arange(len(every), len(every) + 25)[:, None]
        every += key.tolist()
        got += family.add(key, key, np.zeros(25, bool), value)[:, 0].tolist()
    want = [i for i, k in enumerate(every) if every.count(k) > 1]
    assert sorted(got) == want and len(family.levels) <= 7


def test_text_and_empty(spark):
    docs = documents(spark)
    made = suffix_dedup.cut(docs, suffix_dedup.repeated_spans(docs, Scratch(spark, "t"), 50, 25), as_text=True)
    name = next(c for c in made.columns if c not in docs.columns)
    assert dict(made.select(f"{name}.*").dtypes)["kept"] == "string" and made.where(F.col(f"{name}.kept").isNull()).count() == 0
    assert run(empty(spark), spark)[0].count() == 0
