import json

import pytest

from grantlens import cli
from grantlens.sources import standin

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("store")
    standin.awards(spark, DATA).write.parquet(f"{root}/awards")
    standin.publinks(spark, DATA).write.parquet(f"{root}/publinks")
    standin.metrics(spark, DATA).write.parquet(f"{root}/metrics")
    standin.citers(spark, DATA).write.parquet(f"{root}/citers")
    spark.createDataFrame([("N1", "Stroke care", ["U0101000001"], True), ("N2", "other", ["X"], False)], "nct_id string, title string, grants array<string>, has_results boolean").selectExpr("*", "title AS condition").write.parquet(f"{root}/trials")
    spark.createDataFrame([("1", "About grants"), ("2", "Else")], "pmid string, title string").write.parquet(f"{root}/articles")
    spark.createDataFrame([("a",), ("a",), ("b",)], "assay string").write.parquet(f"{root}/assays")
    spark.createDataFrame([(1999, 0.2), (2001, 0.3)], "fiscal_year int, rate double").write.parquet(f"{root}/success_rates")
    return str(root)


def run(capsys, store, *argv):
    code = cli.main([*argv, "--store", store])
    got = capsys.readouterr()
    return code, got.out, got.err


@pytest.mark.parametrize("command", ["concentration", "latency", "foa-types", "trend", "mechanisms", "productivity", "per-grant", "top-pis", "graph-coverage", "graph-stats", "translation-scan", "open-science", "support", "coverage", "conditions", "benchmarks"])
def test_commands(spark, capsys, store, command):
    code, out, _ = run(capsys, store, command, "--json")
    assert code == 0 and (command == "coverage" or all(isinstance(json.loads(x), dict) for x in out.splitlines()))


def test_text_commands(spark, capsys, store):
    assert run(capsys, store, "get", "U0101000001")[0] == 0
    assert "condition" in run(capsys, store, "condition", "diabetes care")[1]
    assert run(capsys, store, "search", "building", "--years", "1996:1997", "--rows", "2")[0] == 0
    assert "## 1. " in run(capsys, store, "brief", "all")[1]
    assert "## 1. " in run(capsys, store, "meta-brief")[1]
    assert "RFA" in run(capsys, store, "foa", "rfa-ca-1")[1]


def test_more_commands(spark, capsys, store, tmp_path):
    assert [json.loads(x)["pmid"] for x in run(capsys, store, "pubs-search", "grants", "--json")[1].splitlines()] == ["1"]
    assert json.loads(run(capsys, store, "assays", "--json")[1].splitlines()[0])["records"] == 2
    assert [json.loads(x)["fiscal_year"] for x in run(capsys, store, "success-rates", "--json")[1].splitlines()] == [2001]
    assert {json.loads(x)["family"] for x in run(capsys, store, "per-grant", "--family", "intramural", "--json")[1].splitlines()} == {"intramural"}
    code, out, _ = run(capsys, store, "graph-build", "U0101000001", "--json", "--rows", "5000", "--out", f"{tmp_path}/graph")
    made = [json.loads(json.loads(x)["json"]) for x in out.splitlines()]
    assert code == 0 and {"funded_trial", "produced", "has_pi"} <= {m.get("predicate") for m in made}
    assert spark.read.parquet(f"{tmp_path}/graph/edges").count() + spark.read.parquet(f"{tmp_path}/graph/nodes").count() == len(made)
    assert "Stroke" in run(capsys, store, "brief", "Study", "--condition", "stroke")[1]
    assert run(capsys, store, "redundancy", "--json")[0] == 0
    out = run(capsys, store, "benchmark", "glp1ra", "--json")[1]
    assert [json.loads(x)["check"] for x in out.splitlines()] == ["min_awards", "ics_any", "condition", "trials", "drugs"]


def test_refusals(spark, capsys, store):
    assert run(capsys, store, "search")[0] == 2
    assert run(capsys, store, "labels", "x")[0] == 2
