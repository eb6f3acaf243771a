"""Portfolio tables made from the order tables that the tests and benchmarks have.

One customer is one core grant, one order one award-year, one part a publication. The expressions are plain SQL that Spark and other
engines read alike, so an oracle can use the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ACTIVITY = "CASE c_custkey % 8 WHEN 0 THEN 'R01' WHEN 1 THEN 'U01' WHEN 2 THEN 'P30' WHEN 3 THEN 'T32' WHEN 4 THEN 'U54' WHEN 5 THEN 'ZIA' WHEN 6 THEN 'DP2' ELSE 'N01' END"
CORE = f"{_ACTIVITY} || lpad(CAST(c_custkey % 25 AS STRING), 2, '0') || lpad(CAST(c_custkey AS STRING), 6, '0')"
#: Grants of customers in debt were renumbered: no link names their new number, so they have no output, and links name numbers without award.
RENUMBERED = f"{CORE} || CASE WHEN c_acctbal < 0 THEN 'X' ELSE '' END"
AWARDS = {
    "application_id": "o_orderkey",
    "core_project_num": RENUMBERED,
    "full_project_num": f"'5' || {RENUMBERED} || '-' || CAST(year(o_orderdate) AS STRING)",
    "activity_code": _ACTIVITY,
    "ic": "c_mktsegment",
    "ic_name": "'Institute of ' || c_mktsegment",
    "fiscal_year": "CAST(year(o_orderdate) AS INT)",
    "funding_mechanism": "o_orderstatus",
    "org_name": "'Org ' || CAST(c_custkey % 97 AS STRING)",
    "org_state": "'S' || CAST(c_nationkey AS STRING)",
    "org_country": "'UNITED STATES'",
    "foa_number": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'RFA-' || CAST(c_custkey AS STRING) WHEN '2' THEN 'PAR-' || CAST(c_custkey AS STRING) WHEN '3' THEN 'PA-' || CAST(c_custkey AS STRING) WHEN '5' THEN 'NOT-' || CAST(c_custkey AS STRING) END",
    "pi_ids": "CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 3 = 0 THEN CAST(9000 + c_custkey % 7 AS STRING) || '; ' || CAST(c_custkey % 400 AS STRING) || ' (contact)' ELSE CAST(c_custkey % 400 AS STRING) END",
    "pi_names": "CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 3 = 0 THEN 'CO, PI' || CAST(c_custkey % 7 AS STRING) || '; LEAD, PI' || CAST(c_custkey % 400 AS STRING) || ' (contact)' ELSE 'LEAD, PI' || CAST(c_custkey % 400 AS STRING) END",
    "project_title": "'Study of ' || c_mktsegment || ' by ' || c_name",
    "total_cost": "o_totalprice",
}
PUBLINKS = {"pmid": "CAST(l_partkey AS STRING)", "core_project_num": CORE, "pub_year": "CAST(year(l_shipdate) AS INT)"}
TRIALS = {"nct_id": "'NCT' || lpad(CAST(event_id AS STRING), 8, '0')", "title": "event_type", "core": CORE, "has_results": "value > 50"}
METRICS = {
    "pmid": "CAST(p_partkey AS STRING)",
    "pub_year": "CAST(1995 + p_size % 12 AS INT)",
    "rcr": "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_retailprice / 1000 END",
    "apt": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 100 END",
    "has_pmc": "p_partkey % 3 <> 0",
}


def _columns(mapping: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in mapping.items())


#: The same tables for an oracle, as common table expressions.
CTE = f"""awards AS (SELECT {_columns(AWARDS)} FROM orders JOIN customer ON o_custkey = c_custkey),
publinks AS (SELECT DISTINCT {_columns(PUBLINKS)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
metrics AS (SELECT {_columns(METRICS)} FROM part),
reported AS (SELECT {_columns(TRIALS)} FROM (SELECT *, user_id AS c_custkey FROM events) e)"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each award-year."""
    joined = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer"), _on("o_custkey", "c_custkey"))
    return joined.selectExpr(*[f"{e} AS {c}" for c, e in AWARDS.items()])


def publinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (pmid, core_project_num, pub_year)."""
    lines = _read(spark, sf_dir, "lineitem")
    joined = lines.join(_read(spark, sf_dir, "orders"), _on("l_orderkey", "o_orderkey")).join(_read(spark, sf_dir, "customer"), _on("o_custkey", "c_custkey"))
    return joined.selectExpr(*[f"{e} AS {c}" for c, e in PUBLINKS.items()]).distinct()


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation metrics of publications."""
    return _read(spark, sf_dir, "part").selectExpr(*[f"{e} AS {c}" for c, e in METRICS.items()])


def reported_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nct_id, title, core, has_results): trials and the grant number that they report, here an event and its user's."""
    return _read(spark, sf_dir, "events").withColumnRenamed("user_id", "c_custkey").selectExpr(*[f"{e} AS {c}" for c, e in TRIALS.items()])


def citers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid, citer): a publication's clinical citers, here parts that follow it by number, up to three."""
    part = _read(spark, sf_dir, "part")
    return part.selectExpr("CAST(p_partkey AS STRING) AS pmid", "explode(sequence(1, 3)) AS k", "p_partkey", "p_size").where("k <= p_size % 4 AND k <= p_partkey % 4").selectExpr("pmid", "CAST(p_partkey + 7 * k AS STRING) AS citer")


def _on(a: str, b: str):
    from pyspark.sql import functions as F

    return F.col(a) == F.col(b)
