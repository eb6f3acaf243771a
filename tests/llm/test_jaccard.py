import random
import re

import pytest

from grantlens.llm import jaccard
from grantlens.llm.common import Scratch

from .cases import documents, empty

LOW = {i: i + 32 for i in range(65, 91)}


def brute(rows, words, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        sets.append(frozenset(zip(*[w[k:] for k in range(words)], strict=False)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [(i, len(s), root(i)) for (i, _), s in zip(rows, sets, strict=True)]


def run(spark, rows, words=3, percent=90):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS id", "3 AS component_id", "4 AS keys")
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df, Scratch(spark, "t"), words, percent).collect())


@pytest.mark.parametrize(("words", "percent", "small"), [(3, 90, 32), (3, 90, 0), (5, 80, 32), (5, 80, 3), (1, 60, 0), (1, 60, 32)])
def test_equals_brute_force(spark, monkeypatch, words, percent, small):
    monkeypatch.setattr(jaccard, "SMALL_TILE", small)
    rnd = random.Random(words)
    rows = []
    for g in range(12):
        base = [f"w{rnd.randint(0, 300)}" for _ in range(rnd.randint(5, 150))]
        for _ in range(rnd.randint(1, 7)):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, len(own) // 12))):
                own[rnd.randrange(len(own))] = f"e{rnd.randint(0, 10**6)}"
            rows.append((1000 * (g % 3) + len(rows), " ".join(own)))
    common = " ".join(f"c{k}" for k in range(12))
    rows += [(9000 + k, f"{common} {' '.join(f'u{k}x{j}' for j in range(rnd.randint(1, 9)))}") for k in range(60)]  # a frequent line
    assert run(spark, rows, words, percent) == sorted(brute(rows, words, percent))


def test_large_tiles_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL_TILE", 4)
    monkeypatch.setattr(jaccard, "TILE_BLOCK", 5)
    monkeypatch.setattr(jaccard, "FEW_TILES", 1)
    rnd = random.Random(8)
    line = [f"c{k}" for k in range(14)]
    rows = [(k, " ".join([*line, *(f"u{rnd.randint(0, 3)}x{j}" for j in range(rnd.randint(0, 12)))])) for k in range(90)]
    assert run(spark, rows, 2, 70) == sorted(brute(rows, 2, 70))
    assert len({c for _, _, c in run(spark, rows, 2, 70)}) > 1


def thue_morse(n, zero, one):
    return "".join(one if bin(i).count("1") % 2 else zero for i in range(n))


@pytest.mark.parametrize("n", [64, 65, 1024, 2048, 4096])
def test_long_words_that_polynomials_confuse(spark, n):
    x, y = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
    rows = [(1, x), (2, y), (3, f"one {x} two three"), (4, f"one {y} two three"), (5, x)]
    assert run(spark, rows) == [(1, 1, 1), (2, 1, 2), (3, 2, 3), (4, 2, 4), (5, 1, 1)]


def test_links_rest_on_words(spark):
    from grantlens.llm import common

    docs = spark.createDataFrame([(1, "aa bb cc dd"), (2, "aa bb cc dd"), (3, "ee ff gg hh"), (4, None)], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a long, b long")
    assert [tuple(r) for r in jaccard.verify(docs, pairs, common.Scratch(spark, "t"), "t", 3, 90).collect()] == [(1, 2)]
    assert jaccard.words_of("Zwei  Wörter\x1cx".encode(), 2) == {(b"zwei", "Wörter\x1cx".encode().replace(b"W", b"w"))}
    assert jaccard.words_of(b" ", 3) == set() and jaccard.words_of(b"A b", 3) == {(b"a", b"b")}


@pytest.mark.parametrize("few", [1, 1000])
def test_few_tiles_first_or_all(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard, "FEW_TILES", few)
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(w if rnd.random() > 0.03 else f"e{rnd.randint(0, 999)}" for w in base)) for k in range(60)]
    assert run(spark, rows, 2, 80) == sorted(brute(rows, 2, 80))


def test_awkward_documents(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).where("doc_id IS NOT NULL").collect()]
    got = run(spark, rows)
    assert got == sorted(brute(rows, 3, 90))
    null = jaccard.join(documents(spark), Scratch(spark, "t")).where("doc_id IS NULL").collect()
    assert [(r.n_shingles, r.component_id) for r in null] == [(1, None)]
    assert jaccard.join(empty(spark), Scratch(spark, "t")).count() == 0


def test_signatures_bound_from_above():
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(1)
    texts = [" ".join(str(rnd.randint(0, 60)) for _ in range(rnd.randint(3, 200))) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(texts)], names=["doc_id", "text"])
    for _, _, at, _, v in jaccard.sets_of(batch.column(1), 3):
        sets = [set(v[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
    for x in sets:
        for y in sets:
            low = min(len(x), len(y))
            if 100 * len(x & y) >= 90 * len(x | y):
                bits = [jaccard.bits_of(np.array([len(s)]))[0] for s in (x, y)]
                maps = []
                for s, b in zip((x, y), bits, strict=True):
                    m = np.zeros(b, np.uint8)
                    for h in s:
                        m[int(jaccard.mix(np.array([h], np.uint64) ^ jaccard._MULTIPLIERS[5])[0]) & (int(b) - 1)] ^= 1
                    maps.append(np.packbits(m, bitorder="little").tobytes())
                assert jaccard._may(len(x), len(y), *maps, 90) and low
