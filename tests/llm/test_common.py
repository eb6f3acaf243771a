import random
import re

import numpy as np
import pyarrow as pa
import pytest

from grantlens.llm import common
from grantlens.llm.common import Scratch


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5000, 6000 + i) for i in range(300)] + [(7, 7), (-5, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.id: r.component_id for r in common.components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long").repartition(5), "c").collect()}
    assert got == {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}
    assert common.components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long"), "c").count() == 0


def test_components_grow_by_further_links(spark):
    scratch = Scratch(spark, "t")
    labels = common.components(scratch, spark.createDataFrame([(1, 2), (2, 3), (10, 11), (20, 21)], "a long, b long"), "c")
    more = spark.createDataFrame([(11, 3), (30, 31), (40, 21), (5, 40), (3, 1)], "a long, b long")
    got = {r.id: r.component_id for r in common.joined_components(scratch, labels, more, "d").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 20: 5, 21: 5, 40: 5, 5: 5, 30: 30, 31: 30}
    same = common.joined_components(scratch, labels, more.where("1 = 0"), "e")
    assert same.count() == labels.count()


def test_long_chains_have_one_component(spark):
    chain = spark.range(3000).selectExpr("(id * 7919) % 3001 AS a", "((id + 1) * 7919) % 3001 AS b").repartition(7)
    assert {r.component_id for r in common.components(Scratch(spark, "t"), chain, "c").collect()} == {0}


def test_hashes_of_spans_of_any_length():
    rnd = random.Random(2)
    text = bytes(rnd.choice(b"ab") for _ in range(3000))
    spans = [(0, n) for n in range(140)] + [(a, a + n) for n in (1, 7, 8, 9, 63, 64, 65, 2048) for a in (1, 2, 3000 - n)]
    start, end = np.array(spans).T
    found = common.span_hash(np.frombuffer(text, np.uint8), start, end).tolist()
    by_text = dict(zip([text[a:b] for a, b in spans], found, strict=True))
    assert [by_text[text[a:b]] for a, b in spans] == found and len(set(by_text.values())) == len(by_text)
    assert common.span_hash(np.zeros(0, np.uint8), np.zeros(0, int), np.zeros(0, int)).tolist() == []


def test_a_cluster_must_name_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://there:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        Scratch(Session(), "t")


def test_words_of_rows():
    texts = ["Two  words", None, "", "é\tx\x0by\x1cz", "end ", "nospace"]
    data, offsets = common.text_bytes(pa.array(texts))
    h, row, start, end = common.word_hashes(data, offsets)
    assert [(r, bytes(data[a:b]).decode()) for r, a, b in zip(row, start, end, strict=True)] == [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    again = common.word_hashes(*common.text_bytes(pa.array(["x words"])))[0]
    assert again[1] == h[1] and len(set(h.tolist())) == len(h)


def test_slices_cover_rows():
    offsets = np.array([0, 3, 3, 50, 51, 52, 200])
    got = list(common.slices(offsets, 10))
    assert [a for a, _ in got[1:]] == [b for _, b in got[:-1]] and got[0][0] == 0 and got[-1][1] == 6
    assert list(common.slices(np.array([0]))) == []


def test_workers_keep_one_operators_table():
    a = common.held("a", lambda: [1])
    assert common.held("a", lambda: [2]) is a
    common.held("b", lambda: [3])
    assert common.held("a", lambda: [4]) == [4]
    common.make_room()


def test_sided(spark):
    small = common.sided(spark.range(10))
    assert "broadcast" in small._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in common.sided(spark.range(10), 5)._jdf.queryExecution().logical().toString().lower()


def test_each_shard_has_a_partition(spark):
    from pyspark.sql import functions as F

    from grantlens.llm.shards import spread

    for n in (1, 2, 7, 30):
        df = spark.createDataFrame([(x,) for x in spread(n)], "s int").repartition(n, "s")
        assert df.select(F.spark_partition_id()).distinct().count() == n
