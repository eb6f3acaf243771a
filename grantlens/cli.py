"""Commands over a store of awards and links: python -m grantlens.cli COMMAND --store FOLDER."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs
from .operators import grants, graph, lookup, portfolio, topics
from .sources import bulk, records


def show(df: DataFrame, as_json: bool, rows: int) -> None:
    """A small result as JSON lines or as a table, with a note where rows are left out."""
    got = df.limit(rows + 1).collect()
    if as_json:
        for r in got[:rows]:
            print(json.dumps(r.asDict(recursive=True), default=str))
    else:
        cells = [df.columns, *[["" if v is None else str(v) for v in r] for r in got[:rows]]]
        wide = [max(len(c[i]) for c in cells) for i in range(len(df.columns))]
        for c in cells:
            print("  ".join(x.ljust(w) for x, w in zip(c, wide, strict=True)).rstrip())
    if len(got) > rows:
        print(f"only the first {rows} rows", file=sys.stderr)


COMMANDS = [
    "build", "search", "get", "pubs", "metrics", "trials", "trial", "productivity", "per-grant", "latency", "foa-types", "concentration", "top-pis", "trend", "mechanisms", "coverage",
    "graph-stats", "graph-coverage", "neighbors", "redundancy", "translation", "translation-scan", "open-science", "support", "meta-brief", "pulse", "conditions", "condition",
    "nam", "nam-areas", "brief", "report", "benchmarks", "benchmark", "foa", "labels", "mortality", "prevalence", "graph-build", "pubs-search", "assays", "success-rates", "download",
]
#: Tables that a command needs besides awards and links.
NEEDS = {
    "metrics": ["metrics"], "trials": ["trials"], "trial": ["trials"], "translation": ["metrics", "citers"], "translation-scan": ["metrics", "citers"], "open-science": ["metrics"],
    "support": ["metrics"], "meta-brief": ["metrics", "citers"], "labels": ["labels"], "pubs-search": ["articles"], "assays": ["assays"], "success-rates": ["success_rates"], "brief": ["metrics"], "mortality": ["mortality"], "prevalence": ["prevalence"],
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="grantlens", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("text", nargs="?", help="search text, grant number, announcement number or title")
    p.add_argument("--store", default=str(bulk.data_dir() / "store"))
    p.add_argument("--awards", nargs="*", default=[], help="CSV files of awards")
    p.add_argument("--links", nargs="*", default=[], help="CSV files of links")
    p.add_argument("--ic")
    p.add_argument("--years", help="2020, 2018:2022 or a list")
    p.add_argument("--by", default="ic", choices=["ic", "family", "fiscal_year", "mechanism", "age"])
    p.add_argument("--floor", type=float, default=250_000)
    p.add_argument("--family", help="only grants of this mechanism family")
    p.add_argument("--condition", help="condition whose outcomes a brief or report adds")
    p.add_argument("--kind", choices=list(bulk.KINDS), default="projects")
    p.add_argument("--since", type=int, default=2000)
    p.add_argument("--rows", type=int, default=50)
    p.add_argument("--json", action="store_true")
    p.add_argument("--out")
    return p


def _with_terms(awards: DataFrame, store: dict[str, DataFrame]) -> DataFrame:
    """awards with terms: those of the store, or else the words of their titles."""
    if "terms" not in store:
        return awards.withColumn("terms", F.split(F.lower("project_title"), "[^a-z0-9]+"))
    terms = store["terms"].groupBy(F.col("core").alias("core_project_num")).agg(F.collect_set("term").alias("terms"))  # a grant's terms
    return awards.join(terms, "core_project_num", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


def _benchmark(awards: DataFrame, store: dict[str, DataFrame], b: tuple) -> DataFrame:
    own = awards.where(exprs.contains_any("project_title", [b[2].lower()]) & F.col("fiscal_year").between(b[3], b[4]))
    return topics.checks(own, b[6], topic=b[5] or b[2], trials=_reported(store), labels=store.get("labels"))


def _reported(store: dict[str, DataFrame]) -> DataFrame | None:
    """(nct_id, title, core) of the store's trials, one row for each grant number that a trial reports."""
    if "trials" not in store or "grants" not in store["trials"].columns:
        return None
    return store["trials"].select("nct_id", "title", F.explode("grants").alias("core"))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    years = exprs.parse_years(a.years)
    if a.command == "search" and not (a.text or years or a.ic):
        print("at least one filter is needed", file=sys.stderr)
        return 2
    if a.command == "download":
        for y in years or []:
            print(bulk.yearly(a.kind, y))
        return 0
    spark = SparkSession.builder.appName("grantlens").getOrCreate()
    if a.command == "build":
        bulk.build(spark, a.awards, a.links, a.store)
        return 0
    if a.command == "conditions":
        show(topics.conditions(spark).drop("keywords"), a.json, a.rows)
        return 0
    if a.command == "benchmarks":
        show(spark.createDataFrame([b[:5] for b in topics.BENCHMARKS], "key string, label string, query string, first_year int, last_year int"), a.json, a.rows)
        return 0
    if a.command == "foa":
        one = spark.createDataFrame([(a.text,)], "foa_number string")
        show(one.select("foa_number", exprs.foa_type_lenient("foa_number").alias("type"), exprs.guide_url("foa_number").alias("url")), a.json, a.rows)
        return 0
    store = bulk.connect(spark, a.store)
    awards, links = store["awards"], store["publinks"]
    if missing := [t for t in NEEDS.get(a.command, []) if t not in store]:
        print(f"the store has no table {', '.join(missing)}", file=sys.stderr)
        return 2
    year = years[0] if years and len(years) == 1 else None
    if a.command == "meta-brief":
        print(topics.render(a.text or "all", topics.meta_brief(awards, links, store["metrics"], store["citers"], trials=_reported(store))))
        return 0
    if a.command in ("brief", "report"):
        scope = awards.where(portfolio.in_scope(a.ic, None, contact=False))
        if a.text:
            scope = scope.where(exprs.contains_any("project_title", [a.text.lower()]))
        if a.command == "report" and a.ic and years:
            tables = topics.report(awards, links, a.ic, years, a.condition, store.get("metrics"), store.get("trials"), store.get("labels"), store.get("mortality"))
        else:
            tables = topics.brief(scope, links, store["metrics"], _reported(store), store.get("abstracts"), store.get("mortality"), store.get("labels"), a.text or "", a.condition, years)
        text = topics.render(a.text or a.ic or "all", tables)
        Path(a.out).write_text(text) if a.out else print(text)
        return 0
    if a.command == "graph-build":
        nodes, edges = graph.award_graph(awards, links, a.text or "", _reported(store), store.get("terms"))
        if a.out:
            graph.write_graph(nodes, edges, a.out)
        show(graph.graph_json(nodes, edges).select("json") if a.json else graph.graph_stats(nodes, edges), a.json, a.rows)
        return 0
    made = {
        "search": lambda: grants.search(awards, a.text, years, [a.ic] if a.ic else None, limit=a.rows),
        "get": lambda: grants.get(awards, a.text),
        "metrics": lambda: lookup.search(store["metrics"], "pmid", a.rows, pmid=a.text),
        "trials": lambda: lookup.search(store["trials"], "nct_id", a.rows, title=a.text),
        "trial": lambda: store["trials"].where(store["trials"].nct_id == a.text),
        "per-grant": lambda: grants.pubs_per_dollar(awards, links, a.floor).where(F.lit(True) if a.family is None else F.col("family") == a.family),
        "pubs-search": lambda: lookup.search(store["articles"], "pmid", a.rows, title=a.text),
        "assays": lambda: records.assay_summary(store["assays"], a.rows),
        "success-rates": lambda: store["success_rates"].where(F.col("fiscal_year") >= a.since).orderBy("fiscal_year"),
        "nam-areas": lambda: topics.nam_areas(awards.groupBy("core_project_num").agg(F.min("project_title").alias("t")), "core_project_num", F.col("t")),
        "top-pis": lambda: portfolio.top_funded_pis(awards, a.ic, year, a.rows),
        "graph-coverage": lambda: graph.stratified_coverage(graph.award_nodes(awards), graph.publication_edges(links), "produced", a.by if a.by in ("ic", "mechanism", "age") else "ic", max(years) if years else datetime.now(UTC).year),
        "translation": lambda: grants.translation_lineage(awards, links, store["metrics"], store["citers"], a.text),
        "translation-scan": lambda: grants.translation(awards, links, store["metrics"], store["citers"], a.rows),
        "open-science": lambda: grants.open_science(links, store["metrics"]),
        "support": lambda: grants.support_vs_impact(awards, links, store["metrics"]),
        "pulse": lambda: topics.pulse(awards.where(exprs.contains_any("project_title", next((c[2] for c in topics.CONDITIONS if c[0] == a.text), [(a.text or "").lower()]))), years or list(range(2008, 2018))),
        "condition": lambda: spark.createDataFrame([(a.text,)], "text string").select("text", topics.resolve_condition("text").alias("condition")),
        "nam": lambda: topics.nam_map(awards.where(exprs.contains_any("project_title", [(a.text or "").lower()])).groupBy("core_project_num").agg(F.min("project_title").alias("t")), "core_project_num", F.col("t")),
        "benchmark": lambda: _benchmark(awards, store, next(b for b in topics.BENCHMARKS if b[0] == a.text)),
        "labels": lambda: lookup.labels_for_indication(store["labels"], a.text or "", "application_number", a.rows),
        "mortality": lambda: store["mortality"].where(F.col("cause_name") == a.text).orderBy("year"),
        "prevalence": lambda: lookup.prevalence(store["prevalence"], a.text or ""),
        "pubs": lambda: links.where(links.core_project_num == a.text),
        "productivity": lambda: portfolio.funding_vs_output(awards, links, a.ic, year, a.floor),
        "latency": lambda: portfolio.latency_summary(awards, links, a.ic, years),
        "foa-types": lambda: portfolio.foa_type_productivity(awards, links, a.ic, year),
        "concentration": lambda: portfolio.funding_concentration(awards, a.ic, year),
        "trend": lambda: portfolio.funding_trend(awards),
        "mechanisms": lambda: portfolio.mechanism_productivity(awards, links),
        "coverage": lambda: portfolio.link_coverage(awards, links, a.by if a.by in ("ic", "family", "fiscal_year") else "ic"),
        "graph-stats": lambda: graph.graph_stats(*graph.portfolio_graph(awards, links)),
        "neighbors": lambda: graph.neighbors(graph.portfolio_graph(awards, links)[1], a.text),
        "redundancy": lambda: grants.redundancy(_with_terms(awards, store))["pairs"],
    }[a.command]()
    show(made, a.json, a.rows)
    return 0


if __name__ == "__main__":
    sys.exit(main())
