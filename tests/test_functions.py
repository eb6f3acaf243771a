import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from grantlens.functions import exprs, stats


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("111 (contact); 222", "111"), ("9; 222 (contact)", "222"), ("7; 8", "7"), ("", ""), (None, None)])
def test_contact(spark, text, want):
    df = spark.createDataFrame([(text,)], "p string")
    assert df.select(exprs.contact_pi_id("p")).first()[0] == want


def test_mechanism_family_order(spark):
    want = {"R01": "research", "DP2": "research", "ZIA": "intramural", "U54": "center_core", "U19": "center_core", "U01": "research", "P30": "center_core", "D43": "training_career", "R25": "training_career", "T32": "training_career", "N01": "other", "": "other", None: "other", " r01 ": "research"}
    df = spark.createDataFrame([(k,) for k in want], "a string")
    assert {r.a: r.f for r in df.select("a", exprs.mechanism_family("a").alias("f")).collect()} == want


def test_foa(spark):
    df = spark.createDataFrame([(x,) for x in ["RFA-1", " rfa-2", "PAS-3", "PA-4", "NOT-5", "X", "", None]], "f string")
    rows = df.select("f", exprs.foa_type("f").alias("a"), exprs.foa_type_lenient("f").alias("b"), exprs.guide_url("f").alias("u")).collect()
    assert [r.a for r in rows] == ["RFA", "OTHER", "PAS", "PA", "NOTICE", "OTHER", "NONE", "NONE"]
    assert [r.b for r in rows] == ["RFA", "RFA", "PAS", "PA", "NOTICE", "OTHER", "NONE", "NONE"]
    assert rows[1].u.endswith("/rfa-files/RFA-2.html") and rows[4].u.endswith("/notice-files/NOT-5.html")


def test_ic_code_and_ages(spark):
    df = spark.createDataFrame([("nci ", 2000), ("XX", 0), ("NIMH", 1999)], "i string, y int")
    assert [tuple(r) for r in df.select(exprs.ic_code("i"), exprs.age_bucket("y", 2004)).collect()] == [("CA", "0-4y"), ("XX", "UNKNOWN"), ("MH", "5-9y")]


def test_names(spark):
    assert one(spark, exprs.normalize_name(F.lit("  Doe,  Jane A. "))) == "doe jane a"
    assert one(spark, exprs.normalize_name(F.lit("Muñoz, É."))) == "muñoz é"
    assert one(spark, exprs.normalize_institution(F.lit("The University of Foo, School of Medicine at Bar Bar"))) == "foo bar bar"


def test_terms(spark):
    assert one(spark, exprs.terms(F.lit("<a b><c>"))) == ["a b", "c"]
    assert one(spark, exprs.terms(F.lit("a; b ,c;"))) == ["a", "b", "c"]
    assert one(spark, exprs.terms(F.lit(None).cast("string"))) == []


def test_split_node(spark):
    a, b = exprs.split_node(F.lit("DATASET:GEO:GSE1"))
    assert one(spark, a) == "DATASET" and one(spark, b) == "GEO:GSE1"


def test_accessions(spark):
    text = "Raw data are in GSE12345 and phs000123.v1.p1. " + "x" * 80 + " plain SRR123456, " + "y" * 80 + " IL10 SDY1 TCGA-AB-1234 and gse99; GSE12345"
    got = one(spark, exprs.accessions(F.lit(text)))
    assert [(m.accession, m.repository, m.start) for m in got] == [("GSE12345", "GEO", text.index("GSE12345")), ("phs000123.v1.p1", "dbGaP", text.index("phs")), ("SRR123456", "SRA", text.index("SRR")), ("TCGA-AB-1234", "TCGA", text.index("TCGA"))]
    by = {m.accession: m.confidence for m in got}
    assert by["GSE12345"] == 0.97 and by["SRR123456"] == 0.9
    assert one(spark, exprs.accessions(F.lit(None).cast("string"))) == []


def test_years():
    assert exprs.parse_years("2020") == [2020] and exprs.parse_years("2022:2020,1999") == [2020, 2021, 2022, 1999] and exprs.parse_years("") is None


def test_casts(spark):
    df = spark.createDataFrame([("1,234.9", "Yes", "25%"), ("", "no", "0.5"), (None, "?", "x")], "n string, b string, r string")
    assert [tuple(r) for r in df.select(exprs.lenient_int("n"), exprs.yes_no("b"), exprs.rate("r")).collect()] == [(1234, True, 0.25), (None, False, 0.5), (None, None, None)]


def table(spark, values):
    return spark.createDataFrame([(f"k{i:03}", float(v)) for i, v in enumerate(values)], "k string, v double").selectExpr("k", "CAST(v AS DECIMAL(18,2)) AS v")


def test_concentration(spark):
    row = stats.concentration(table(spark, [1, 1, 1, 97]), "k", "v").first()
    assert (row.n, row.total, row.top1_pct_share) == (4, 100.0, 0.97)
    assert row.gini == pytest.approx((4 + 1 - 2 * (1 + 2 + 3 + 100) / 100) / 4, abs=1e-6)
    # the top tenth of 25 rows is two: halves go to the even number
    assert stats.concentration(table(spark, [1] * 25), "k", "v").first().top10_pct_share == pytest.approx(2 / 25)


def test_spearman_and_quartiles(spark):
    df = spark.createDataFrame([("a", 1.0, 4.0), ("b", 2.0, 3.0), ("c", 3.0, 2.0), ("d", 4.0, 1.0)], "k string, x double, y double")
    assert stats.spearman(df, "x", "y", "k").first().spearman == -1.0
    assert stats.spearman(df.limit(2), "x", "y", "k").first().spearman is None
    ten = stats.floor_quartile(table(spark, range(10)), "v", ["k"])
    assert [r.n for r in ten.groupBy("quartile").agg(F.count("*").alias("n")).orderBy("quartile").collect()] == [2, 2, 2, 4]
    assert stats.floor_quartile(table(spark, [1, 2]), "v", ["k"]).where("quartile IS NOT NULL").count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_ordinal(spark, descending):
    df = spark.range(500).selectExpr("id", "CASE WHEN id = 7 THEN 0 ELSE ((id * 7919) % 101 - 20) * 1.37D END AS v")
    got = [r.id for r in stats.ordinal(df, "v", ["id"], "r", descending).orderBy("r").collect()]
    rows = [(r.v * (-1 if descending else 1), r.id) for r in df.collect()]
    assert got == [i for _, i in sorted(rows)]


def test_tiles(spark):
    for n in (0, 3, 10, 13):
        df = table(spark, range(n)) if n else table(spark, [1]).where("1 = 0")
        got = [r.t for r in stats.tiles(df, "v", ["k"], 4, "t").orderBy("v").collect()]
        want = [r.t for r in df.withColumn("t", F.ntile(4).over(Window.orderBy("v"))).orderBy("v").collect()]
        assert got == want


def test_nearest_rank_and_change(spark):
    steps = F.array(*[F.struct(F.lit(u).alias("upto"), F.lit(v).alias("v")) for u, v in ((1, 1), (2, 2), (3, 3), (4, 4))])
    assert one(spark, stats.nearest_rank(steps, F.lit(4), 0.5)) == 3 and one(spark, stats.nearest_rank(steps, F.lit(4), 1.0)) == 4
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 25.0), ("a", 5, 21.5)], "s string, y int, v double")
    assert df.groupBy("s").agg(*stats.relative_change("v", "y")).first().pct_change == -0.14


def test_systematic_sample(spark):
    n, cap = 97, 10
    got = [int(r.v) for r in stats.systematic_sample(table(spark, range(n)), "v", ["k"], cap).orderBy("v").collect()]
    assert got == [i * n // cap for i in range(cap)]
    assert stats.systematic_sample(table(spark, range(5)), "v", ["k"], cap).count() == 5
