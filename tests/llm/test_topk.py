import numpy as np
from pyspark.sql import functions as F

from grantlens.llm import topk

SCHEMA = "id long, v array<double>, n long"


def check(spark, x, ids, k, queries):
    rows = [(int(i), [float(c) for c in v], 1) for i, v in zip(ids, x, strict=True)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in topk.top_k(df, df.where(F.col("id").isin(queries)), k).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in queries:
        own = next(v for i, v, _ in rows if i == q)
        want = sorted((-sum(int(a) * int(b) for a, b in zip(own, v, strict=False)), i) for i, v, _ in rows if i != q)[:k]
        assert sorted(got.get(q, [])) == [(n, i, -s) for n, (s, i) in enumerate(want, 1)]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_ROWS", 200)
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(900, 12)) * rng.lognormal(size=(900, 1)) * 20)
    x[100:160] = x[99]  # ties
    check(spark, x, rng.permutation(900) * 3, 5, [0, 3, 300, 2400])


def test_few_rows_unequal_widths_and_large_numbers(spark):
    check(spark, [[1, 2], [3], [1e9, 5, 1], [-1e9, 1, 1]], [1, 2, 3, 4], 5, [1, 3])
    check(spark, [[1, 2]], [7], 5, [7])


def test_awkward_vectors(spark, tmp_path):
    nan = float("nan")
    rows = [(0, [0.1, 0.2]), (50, None), (100, [nan, 1.0]), (1, [0.5, 0.5]), (2, [1.0, None]), (3, []), (150, [0.0, 0.0]), (None, [0.3, 0.3])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "1 AS rank").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in topk.op9_top_k(spark, str(tmp_path)).collect())
    a, b = [25, 51], [128, 128]
    assert got == [(0, 1, 1, a[0] * b[0] + a[1] * b[1]), (0, 2, 150, 0), (150, 1, 0, 0), (150, 2, 1, 0)]
    spark.createDataFrame([(0, [3e38, 1.0]), (1, [3e38, -3e38]), (2, [0.0, 0.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/big/embeddings.parquet")
    assert sorted((r.vec_id, r.score) for r in topk.op9_top_k(spark, f"{tmp_path}/big").collect()) == [(1, 2**63 - 1), (2, 0)]
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/e/embeddings.parquet")
    assert topk.op9_top_k(spark, f"{tmp_path}/e").count() == 0
