import numpy as np

from grantlens.llm import hnsw
from grantlens.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int"


def check(spark, rows, monkeypatch=None):
    got = {r.vec_id: r for r in hnsw.near_duplicates(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "2 AS id", "3 AS v"), Scratch(spark, "t")).collect()}
    assert len(got) == len(rows)
    good = {i: np.array(e, float) for i, e, _ in rows if e and all(x is not None and np.isfinite(x) for x in e) and any(e)}
    width = max((len(v) for v in good.values()), default=1)
    ids = sorted(good)
    x = np.array([np.pad(good[i], (0, width - len(good[i]))).astype(np.float32).astype(float) for i in ids]).reshape(len(ids), width)
    x /= np.linalg.norm(x, axis=1, keepdims=True) if len(ids) else 1
    link = x @ x.T >= 0.95
    up = list(range(len(ids)))
    for _ in ids:
        up = [min(up[j] for j in np.flatnonzero(link[i])) for i in range(len(ids))]
    for k, i in enumerate(ids):
        assert got[i].n_links == link[k].sum() - 1, i
        assert got[i].component_id == ids[up[k]] and got[i].kept == (got[i].component_id == i)
    for i, _, _ in rows:
        if i not in good:
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "LEAST_ROWS", 300)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(500, 16))
    rows = [*centres, *(centres[7] + rng.normal(size=(250, 16)) * 0.05), *(centres[9] + rng.normal(size=(40, 16)) * 0.05), *[centres[11]] * 30]
    check(spark, [(int(i), [float(v) for v in r], 0) for i, r in zip(rng.permutation(len(rows)), rows, strict=True)])


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    check(spark, [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 1), (3, None, 0), (4, [0.0, 0.0], 0), (5, [1.0, None], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [], 0), (9, [1.0, 0.0, 0.0], 0), (10, [1e30, 1e29], None), (11, [-1.0, 0.0], 0), (12, [1e-30, 0.0], 0)])
    assert hnsw.near_duplicates(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).count() == 0
    check(spark, [(1, [1.0, 0.0], 0)])
