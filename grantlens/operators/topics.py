"""Conditions and new-approach methods in texts, a condition's pulse, briefs, expectation checks, reports."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs, stats
from . import grants, lookup, portfolio
from .portfolio import MONEY

# Key, label, keywords, cause of death, prevalence measure, drug indication, main institute.
CONDITIONS = [
    ("heart_disease", "Heart disease", ["heart disease", "cardiovascular", "coronary", "myocardial", "cardiac", "atherosclerosis", "ischemic heart"], "Heart disease", "Coronary heart disease among adults", "heart failure", "NHLBI"),
    ("cancer", "Cancer", ["cancer", "carcinoma", "tumor", "tumour", "oncolog", "neoplasm", "malignan", "leukemia", "lymphoma", "melanoma"], "Cancer", "Cancer (non-skin) or melanoma among adults", "cancer", "NCI"),
    ("diabetes", "Diabetes", ["diabetes", "diabetic", "insulin", "glycemic", "hyperglycemia", "type 2 diabetes", "type 1 diabetes"], "Diabetes", "Diagnosed diabetes among adults", "type 2 diabetes", "NIDDK"),
    ("stroke", "Stroke", ["stroke", "cerebrovascular", "ischemic stroke"], "Stroke", "Stroke among adults", "ischemic stroke", "NINDS"),
    ("alzheimers", "Alzheimer's disease", ["alzheimer", "dementia", "neurodegenerative", "amyloid", "tauopathy", "cognitive decline"], "Alzheimer's disease", None, "Alzheimer's disease", "NIA"),
    ("copd", "Chronic lower respiratory disease (COPD)", ["copd", "chronic obstructive", "emphysema", "chronic lower respiratory", "chronic bronchitis"], "CLRD", "Chronic obstructive pulmonary disease among adults", "chronic obstructive pulmonary disease", "NHLBI"),
    ("kidney_disease", "Kidney disease", ["kidney", "renal", "nephro", "chronic kidney", "ckd", "end-stage renal"], "Kidney disease", "Chronic kidney disease among adults", "chronic kidney disease", "NIDDK"),
    ("suicide", "Suicide / self-harm", ["suicide", "self-harm", "self harm", "suicidal"], "Suicide", "Depression among adults", "major depressive disorder", "NIMH"),
    ("influenza_pneumonia", "Influenza and pneumonia", ["influenza", "pneumonia", "respiratory infection"], "Influenza and pneumonia", None, "influenza", "NIAID"),
    ("overdose_injury", "Unintentional injury / overdose", ["overdose", "opioid", "substance use", "drug abuse", "addiction", "unintentional injur"], "Unintentional injuries", None, "opioid use disorder", "NIDA"),
]

# New-approach methods and the words that tell them.
NAM_METHODS = {
    "organ_on_chip": ["organ-on-chip", "organ on a chip", "microphysiological", "tissue chip", "organ-on-a-chip"],
    "ipsc": ["induced pluripotent", "ipsc", "ips cell", "ips-derived"],
    "organoid": ["organoid", "cerebral organoid", "spheroid"],
    "in_silico": ["in silico", "computational toxicolog", "qsar", "in-silico"],
    "hts_in_vitro": ["high-throughput screen", "high throughput screen", "in vitro screen", "tox21", "toxcast"],
    "skin_sensitization": ["skin sensitization", "dpra", "keratinosens", "h-clat", "llna"],
    "3d_culture": ["3d culture", "three-dimensional culture", "bioprint"],
}


# Preclinical areas and the text that finds their grants.
NAM_AREAS = {"immunology": "immunology", "ad_adrd": "Alzheimer", "cardiometabolic": "cardiometabolic"}


def conditions(spark: SparkSession) -> DataFrame:
    """The crosswalk as a table, in its order."""
    rows = [(i, *c) for i, c in enumerate(CONDITIONS)]
    return spark.createDataFrame(rows, "ordinal int, key string, label string, keywords array<string>, cause string, measure string, indication string, primary_ic string")


def matching(text: Column | str, groups: dict[str, list[str]]) -> Column:
    """Names of the groups of which a word occurs in the text, in order."""
    text = F.col(text) if isinstance(text, str) else text
    hits = lambda low: F.array(*[F.when(exprs.contains_word(low, words), F.lit(name)) for name, words in groups.items()])
    return F.array_compact(exprs.let(F.lower(F.coalesce(text, F.lit(""))), hits))


def match_conditions(text: Column | str) -> Column:
    return matching(text, {c[0]: c[2] for c in CONDITIONS})


def resolve_condition(text: Column | str) -> Column:
    """An exact key, else the first condition that matches, else null."""
    text = F.col(text) if isinstance(text, str) else text
    key = F.lower(F.trim(text))
    return F.when(key.isin([c[0] for c in CONDITIONS]), key).otherwise(F.get(match_conditions(text), 0))


def condition_of(topic: str) -> tuple | None:
    """The condition that a topic names: by its key, else the first of which a keyword occurs."""
    low = topic.strip().lower()
    return next((c for c in CONDITIONS if c[0] == low), None) or next((c for c in CONDITIONS if any(w in topic.lower() for w in c[2])), None)


def nam_areas(rows: DataFrame, key: str, text: Column, areas: dict[str, str] | None = None) -> DataFrame:
    """(area, grants_scanned, grants_with_nam, note) for the grants whose text names an area; all areas are found in one pass."""
    areas = NAM_AREAS if areas is None else areas
    first = rows.select(F.col(key).alias("grant"), matching(text, {a: [w.lower()] for a, w in areas.items()}).alias("areas"), matching(text, NAM_METHODS).alias("methods"))
    counts = first.select("methods", F.explode("areas").alias("area")).groupBy("area").agg(F.count("*").alias("grants_scanned"), F.count_if(F.size("methods") > 0).alias("grants_with_nam"))
    share = F.round(100 * F.col("grants_with_nam") / F.col("grants_scanned")).cast("long").cast("string")
    note = F.concat(F.col("grants_with_nam").cast("string"), F.lit("/"), F.col("grants_scanned").cast("string"), F.lit(" grants ("), share, F.lit("%) mention a method; no mention means unknown"))
    return counts.withColumn("note", note)


def nam_map(rows: DataFrame, key: str, text: Column, examples: int = 5) -> DataFrame:
    """Methods in grants' texts: method, grants, first examples, grants scanned and grants with any method."""
    first = rows.select(F.col(key).alias("grant"), matching(text, NAM_METHODS).alias("methods"))
    scanned = first.agg(F.count("*").alias("grants_scanned"), F.count_if(F.size("methods") > 0).alias("grants_with_nam"))
    each = first.select("grant", F.explode("methods").alias("method"))
    counts = each.groupBy("method").agg(F.count("*").alias("grants"))
    # only the first few of each method come together
    first_few = each.distinct().withColumn("r", F.row_number().over(Window.partitionBy("method").orderBy("grant"))).where(F.col("r") <= examples)
    few = first_few.groupBy("method").agg(F.array_join(F.array_sort(F.collect_list("grant")), ",").alias("examples"))
    return counts.join(F.broadcast(few), "method").join(F.broadcast(scanned))  # a row for each method, one row


def pulse(awards: DataFrame, years: list[int], per_year_cap: int | None = None) -> DataFrame:
    """Active grants and funding of each year; with a cap, of the first award-years of a year, and whether it was reached."""
    rows = awards.where(F.col("fiscal_year").isin(years))
    seen = rows.groupBy("fiscal_year").agg(F.count("*").alias("records"))
    if per_year_cap:
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("fiscal_year").orderBy("application_id"))).where(F.col("r") <= per_year_cap)
    sums = rows.groupBy("fiscal_year").agg(F.count_distinct(grants.grant_key()).alias("grants"), portfolio.cost().cast("double").alias("funding"))
    capped = F.col("records") > per_year_cap if per_year_cap else F.lit(False)
    return sums.join(seen, "fiscal_year").withColumn("capped", capped)


def series_change(series: DataFrame, by: str, value: str, year: str) -> DataFrame:
    """First and last value of each series and their relative change."""
    return series.groupBy(by).agg(*stats.relative_change(value, year))


def top_entities(awards: DataFrame, n: int = 10) -> DataFrame:
    """(kind, name, grants, funding, rank): institutes, mechanisms, institutions and investigators by how many grants they have.

    Each grant counts once, with its first record and that record's cost.
    """
    once = awards.withColumn("grant", grants.grant_key()).groupBy("grant").agg(F.min_by(F.struct("ic", "activity_code", "org_name", "pi_names", "total_cost"), F.struct("fiscal_year", "application_id")).alias("g"))
    people = F.transform(F.split(F.coalesce("g.pi_names", F.lit("")), ";"), lambda x: F.trim(F.replace(x, F.lit("(contact)"), F.lit(""))))
    single = [F.struct(F.lit(kind).alias("kind"), F.col(f"g.{c}").alias("name")) for kind, c in (("ic", "ic"), ("mechanism", "activity_code"), ("institution", "org_name"))]
    pairs = F.concat(F.array(*single), F.transform(people, lambda x: F.struct(F.lit("pi").alias("kind"), x.alias("name"))))
    each = once.select(F.explode(pairs).alias("p"), F.col("g.total_cost").alias("cost")).where("p.name <> ''")
    counts = each.groupBy("p.kind", "p.name").agg(F.count("*").alias("grants"), F.coalesce(F.sum(F.col("cost").cast(MONEY)).cast("double"), F.lit(0.0)).alias("funding"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("grants"), "name"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


@dataclass
class Expect:
    """What a portfolio should show."""

    min_awards: int = 0
    ics_any: list[str] = field(default_factory=list)
    condition_key: str | None = None
    expect_trials: bool = False
    expect_drugs: bool = False


# Key, label, query, first and last year, condition, expectations.
BENCHMARKS = [
    ("exposome", "Exposome & chronic disease", "exposome", 2018, 2024, None, Expect(40, ["NIEHS"])),
    ("pfas_cardiometabolic", "PFAS & cardiometabolic disease", "PFAS", 2018, 2024, None, Expect(30, ["NIEHS"])),
    ("climate_health", "Climate change & human health", "climate change health", 2018, 2024, None, Expect(20, ["NIEHS", "FIC"])),
    ("ai_biomedical", "AI / ML for biomedical discovery", "machine learning", 2018, 2024, None, Expect(200, ["NLM", "NIGMS", "NIBIB"])),
    ("glp1ra", "GLP-1 receptor agonists", "GLP-1", 2018, 2024, "diabetes", Expect(30, ["NIDDK", "NHLBI"], "diabetes", True, True)),
    ("alzheimers_dmt", "Alzheimer's disease-modifying therapies", "Alzheimer", 2018, 2024, "alzheimers", Expect(80, ["NIA"], "alzheimers", True, True)),
    ("long_covid", "Long COVID (PASC)", "post-acute sequelae SARS-CoV-2", 2021, 2024, None, Expect(10, ["NHLBI", "NIAID"], None, True)),
    ("crispr_therapeutics", "CRISPR / gene-editing therapeutics", "CRISPR gene editing", 2018, 2024, None, Expect(50, ["NHGRI", "NHLBI", "NIAID"])),
]


def checks(awards: DataFrame, expect: Expect, top: int = 10, topic: str = "", trials: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """(check, passed, detail) for a portfolio's awards, for what is expected only: enough grants, an expected institute among the top,
    the topic's condition, trials that report one of its grants (nct_id, core), and labels for its condition (indication)."""
    spark = awards.sparkSession
    n = awards.agg(F.count_distinct(grants.grant_key()).alias("n"))
    rows = [n.select(F.lit("min_awards").alias("check"), (F.col("n") >= expect.min_awards).alias("passed"), F.concat(F.col("n").cast("string"), F.lit(f" awards (expected >= {expect.min_awards})")).alias("detail"))]
    if expect.ics_any:
        wanted = spark.createDataFrame([(x,) for x in expect.ics_any], "name string")
        hits = top_entities(awards, top).where("kind = 'ic'").join(F.broadcast(wanted), "name", "left_semi").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("hit"))
        rows.append(hits.select(F.lit("ics_any"), F.col("hit") != "", F.concat(F.lit("top institutes among those expected: "), "hit")))
    found = condition_of(expect.condition_key or topic)
    if expect.condition_key is not None:
        own = condition_of(topic)
        told, wanted_label = own[1] if own else "none", found[1] if found else expect.condition_key
        rows.append(spark.createDataFrame([("condition", told == wanted_label, f"condition {told} (expected {wanted_label})")], "check string, passed boolean, detail string"))
    counted = lambda name, df, what: df.select(F.lit(name), F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(what)))
    none = spark.range(1).select(F.lit(0).cast("long").alias("n"))
    if expect.expect_trials:
        own_grants = awards.select(grants.grant_key().alias("core")).distinct()
        linked = none if trials is None else trials.join(own_grants, "core", "left_semi").agg(F.count_distinct("nct_id").alias("n"))
        rows.append(counted("trials", linked, " linked trials"))
    if expect.expect_drugs:
        drugs = none if labels is None or found is None else lookup.count(labels, indication=found[5]).withColumnRenamed("total", "n")
        rows.append(counted("drugs", drugs, " approved drugs"))
    return reduce(DataFrame.union, rows)


CAVEATS = [
    "Links are mostly those that registries state; they miss publications, so outputs are a floor.",
    "Datasets are found in abstracts by pattern: inferred, not stated.",
    "Recent awards have had less time to produce.",
]
CONDITION_CAVEAT = "Health outcomes stand beside the portfolio; they are not its effect."
SOURCES = ["Award registry (awards, publication links)", "Article index and citation metrics", "Trial registry"]


def brief(awards: DataFrame, publinks: DataFrame, metrics: DataFrame, trials: DataFrame | None = None, abstracts: DataFrame | None = None, deaths: DataFrame | None = None, labels: DataFrame | None = None, topic: str = "", condition: str | None = None, years: list[int] | None = None, sample_awards: int = 12) -> dict[str, DataFrame]:
    """The tables of a portfolio brief, by section; each is small.

    Publications, trials and datasets are of a sample: the grants with the largest single record; how many of them have any is told.
    trials has (nct_id, title, core), abstracts (core_project_num, text). A condition, given or named by the topic, adds its outcome.
    """
    spark, key = awards.sparkSession, grants.grant_key()
    scope = awards.where(F.col("fiscal_year").isin(years)) if years else awards
    sample = scope.withColumn("core", key).where("core IS NOT NULL").groupBy("core").agg(F.max("total_cost").alias("cost")).orderBy(F.desc_nulls_last("cost"), "core").limit(sample_awards)
    links = publinks.select(F.col("core_project_num").alias("core"), "pmid").distinct().join(sample.select("core"), "core", "left_semi")
    own_trials = (spark.createDataFrame([], "nct_id string, title string, core string") if trials is None else trials.select("nct_id", "title", "core")).join(sample.select("core"), "core", "left_semi").distinct()
    texts = spark.createDataFrame([], "core string, text string") if abstracts is None else abstracts.select(F.col("core_project_num").alias("core"), "text").join(sample.select("core"), "core", "left_semi")
    datasets = texts.select("core", F.explode(exprs.accessions("text")).alias("m")).select("core", F.concat("m.repository", F.lit(":"), "m.accession").alias("dataset")).distinct()
    has = lambda df, name: df.agg(F.count_distinct("core").alias(name))
    parts = [sample.agg(F.count("*").alias("sampled")), has(links, "with_publication"), has(own_trials, "with_trial"), has(datasets, "with_dataset"), links.agg(F.count("*").alias("publications"))]
    lines = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string")
    found = condition_of(condition or topic)
    out = {
        "query": lines([f"topic {topic or 'all'}", f"years {min(years)}-{max(years)}" if years else "all years"]),
        "totals": scope.agg(F.count_distinct(key).alias("grants"), F.count("*").alias("award_years"), F.sum(F.col("total_cost").cast(MONEY)).cast("double").alias("funding")),
        "by_year": portfolio.funding_trend(scope),
        "entities": top_entities(scope, 5),
        "publications": grants.top_publications(links, metrics),
        "trials": own_trials.groupBy("nct_id").agg(F.min("title").alias("title")).orderBy("nct_id").limit(10),
        "datasets": datasets.select("dataset").distinct().orderBy("dataset").limit(15),
        "sample_coverage": reduce(lambda a, b: a.join(F.broadcast(b)), parts),  # one row each
        "concentration": portfolio.funding_concentration(scope),
        "latency": portfolio.latency_summary(scope, publinks),
        "mechanisms": portfolio.mechanism_productivity(scope, publinks),
        "coverage": portfolio.link_coverage(scope, publinks, "ic", 1),
    }
    if found:
        change = [] if deaths is None else [deaths.where(F.col("cause_name") == found[3]).agg(*stats.relative_change("aadr", "year"))]
        drugs = [] if labels is None else [lookup.count(labels, indication=found[5]).withColumnRenamed("total", "approved_drugs")]
        out["outcome"] = reduce(lambda a, b: a.join(F.broadcast(b)), [spark.createDataFrame([(found[1],)], "condition string"), *change, *drugs])  # one row each
    out["caveats"] = lines([*CAVEATS, *([CONDITION_CAVEAT] if found else [])])
    out["sources"] = lines([*SOURCES, *(["Mortality series", "Drug labels"] if found else [])])
    return out


def meta_brief(awards: DataFrame, publinks: DataFrame, metrics: DataFrame, citers: DataFrame, sample_grants: int = 8, words: DataFrame | None = None, trials: DataFrame | None = None) -> dict[str, DataFrame]:
    """Totals, investigators and mechanisms, translation of the best-funded grants, similar grants, open science, impact against support."""
    titles = awards.withColumn("id", grants.grant_key()).groupBy("id").agg(F.min("project_title").alias("t")).select("id", F.split(F.lower("t"), "[^a-z0-9]+").alias("words"))
    terms = awards.withColumn("terms", F.split(F.lower("project_title"), "[^a-z0-9]+"))
    best = awards.withColumn("core_project_num", grants.grant_key()).groupBy("core_project_num").agg(portfolio.cost().alias("f")).orderBy(F.desc("f"), "core_project_num").limit(sample_grants).select("core_project_num")
    share = grants.open_science(publinks.join(best, "core_project_num", "left_semi"), metrics)
    of_trials = awards.sparkSession.createDataFrame([], "core string") if trials is None else trials.select("core")
    parts = [
        awards.agg(F.count_distinct(grants.grant_key()).alias("grants"), portfolio.cost().cast("double").alias("funding")),
        best.agg(F.count("*").alias("sampled")),
        share.agg(F.round(F.sum(F.col("pmc_fraction").cast("decimal(18,3)")).cast("double") / F.count("pmc_fraction"), 3).alias("pmc_fraction")),
        best.join(of_trials.select(F.col("core").alias("core_project_num")), "core_project_num", "left_semi").agg(F.count("*").alias("grants_with_trial")),
        grants.redundancy(terms, min_terms=4)["totals"].select("cross_pi"),
    ]
    return {
        "summary": reduce(lambda a, b: a.join(F.broadcast(b)), parts),  # one row each
        "entities": top_entities(awards, 5).where("kind IN ('pi', 'mechanism')"),
        "translation": grants.translation(awards, publinks, metrics, citers, sample_grants).orderBy(F.desc("clinical_reach"), F.coalesce("mean_apt", F.lit(0.0)).desc(), "grant"),
        "similar": grants.similar_grants(titles if words is None else words),
        "open_science": grants.open_science(publinks, metrics).agg(F.count("*").alias("grants"), F.sum("pubs").alias("pubs"), F.sum("in_pmc").alias("in_pmc")),
        "support": grants.support_vs_impact(awards, publinks, metrics).groupBy("quartile").agg(F.count("*").alias("pis"), F.round(F.sum(F.col("rcr_per_million").cast("decimal(18,6)")).cast("double") / F.count("*"), 6).alias("mean_rcr_per_million")),
    }


def render(title: str, tables: dict[str, DataFrame], rows: int = 20) -> str:
    """A brief as Markdown: a numbered section for each table, with at most `rows` rows and a note where there are more."""
    out = [f"# Portfolio brief: {title}", ""]
    for i, (name, df) in enumerate(tables.items(), 1):
        got = df.limit(rows + 1).collect()
        out += [f"## {i}. {name.replace('_', ' ').capitalize()}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in got[:rows]]
        out += [f"\nThe first {rows} rows." if len(got) > rows else "", ""]
    return "\n".join(out)


def report(awards: DataFrame, publinks: DataFrame, ic: str, years: list[int], condition: str | None = None, metrics: DataFrame | None = None, trials: DataFrame | None = None, labels: DataFrame | None = None, deaths: DataFrame | None = None, sample: int = 250) -> dict[str, DataFrame]:
    """An institute's report: trend, concentration, mechanisms, coverage, latency, a sample of publications and its citation ratios.

    A condition adds its trials (condition, has_results), approved labels (indication) and change in mortality (cause_name, year, aadr);
    one that is not known raises, and without one the report says nothing of outcomes.
    """
    found = None if (condition or "").strip().lower() in ("", "none", "-", "na") else condition_of(condition)
    if found is None and (condition or "").strip().lower() not in ("", "none", "-", "na"):
        raise ValueError(f"unknown condition {condition!r}")
    own = awards.where(F.col("ic") == exprs.ic_code(F.lit(ic))).where(F.col("fiscal_year").isin(years))
    chosen = portfolio.sample_linked_pmids(own, publinks, n=sample)
    out = {
        "trend": portfolio.funding_trend(own),
        "concentration": portfolio.funding_concentration(own.where(F.col("fiscal_year") == max(years))),
        "mechanisms": portfolio.mechanism_productivity(own, publinks),
        "coverage": portfolio.link_coverage(own, publinks, "family", 1),
        "latency": portfolio.latency_summary(own, publinks),
        "sample": chosen,
    }
    if metrics is not None:
        rcr = chosen.join(metrics.select("pmid", "rcr"), "pmid", "left")
        out["citation"] = rcr.agg(F.count("*").alias("sampled"), F.count("rcr").alias("rated"), F.round(F.median("rcr"), 6).alias("median_rcr"))
    if found:
        parts = []
        if trials is not None:
            parts.append(lookup.search(trials, "", None, condition=found[1]).agg(F.count("*").alias("trials"), F.count_if("has_results").alias("trials_with_results")))
        if labels is not None:
            parts.append(lookup.count(labels, indication=found[5]).withColumnRenamed("total", "approved_drugs"))
        if deaths is not None:
            parts.append(deaths.where((F.col("cause_name") == found[3]) & F.col("year").isin(years)).agg(*stats.relative_change("aadr", "year")))
        if parts:
            out["outcome"] = reduce(lambda a, b: a.join(F.broadcast(b)), parts).withColumn("caveat", F.lit(CONDITION_CAVEAT))  # one row each
    return out
