"""Analyses of award-years and publication links: concentration, output per dollar, latency, coverage.

awards: one row for each award-year; publinks: distinct (pmid, core_project_num, pub_year). Money is added as DECIMAL(18, 2), so sums do
not depend on order. Link tables are joined after both sides are reduced to the key, never before a sum of costs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs, stats

MONEY = "decimal(18,2)"
#: The link-poor start years need time to show output; a first link before the start is censored, not zero.


def with_contact(awards: DataFrame) -> DataFrame:
    """awards with contact_pi_id and contact_pi_name."""
    return awards.withColumn("contact_pi_id", exprs.contact_pi_id("pi_ids")).withColumn("contact_pi_name", exprs.contact_pi_name("pi_names"))


def in_scope(ic: str | None = None, years: list[int] | int | None = None, contact: bool = True) -> Column:
    """Awards with cost, in an institute and years; with a contact investigator unless told otherwise."""
    scope = F.col("total_cost") > 0
    if contact:
        scope &= F.col("contact_pi_id") != ""
    if ic:
        scope &= F.col("ic") == exprs.ic_code(F.lit(ic))
    if years:
        scope &= F.col("fiscal_year").isin([years] if isinstance(years, int) else years)
    return scope


def cost() -> Column:
    return F.sum(F.col("total_cost").cast(MONEY))


def per_million(count: Column, funding: Column) -> Column:
    return F.when(funding > 0, count / (funding / 1e6))


def funding_by_pi(awards: DataFrame, ic: str | None = None, year: int | None = None) -> DataFrame:
    rows = with_contact(awards).where(in_scope(ic, year))
    return rows.groupBy("contact_pi_id").agg(F.min("contact_pi_name").alias("pi_name"), cost().alias("funding"), F.count("*").alias("awards"))


def funding_concentration(awards: DataFrame, ic: str | None = None, year: int | None = None) -> DataFrame:
    """n_pis, total_funding, shares of the top 1, 5 and 10 percent, Gini."""
    row = stats.concentration(funding_by_pi(awards, ic, year), "contact_pi_id", "funding")
    return row.withColumnsRenamed({"n": "n_pis", "total": "total_funding"})


def funding_concentration_by_ic(awards: DataFrame) -> DataFrame:
    """The same for each institute, in one plan: ranks within the institute."""
    by = with_contact(awards).where(in_scope()).groupBy("ic", "contact_pi_id").agg(cost().alias("funding"))
    part = Window.partitionBy("ic")
    ranked = by.withColumn("rank", F.row_number().over(part.orderBy(F.desc("funding"), "contact_pi_id"))).withColumn("n", F.count("*").over(part))
    tops = [F.sum(F.when(F.col("rank") <= stats.share_of_top(f, F.col("n")), F.col("funding"))).cast("double").alias(f"t{round(100 * f)}") for f in (0.01, 0.05, 0.1)]
    rows = ranked.groupBy("ic").agg(F.count("*").alias("n_pis"), F.sum("funding").cast("double").alias("total_funding"), F.sum(F.col("rank") * F.col("funding")).cast("double").alias("w"), *tops)
    shares = [F.round(F.col(f"t{p}") / F.col("total_funding"), 6).alias(f"top{p}_pct_share") for p in (1, 5, 10)]
    gini = F.round((F.col("n_pis") + 1 - 2 * (F.col("w") / F.col("total_funding"))) / F.col("n_pis"), 6).alias("gini")
    return rows.select("ic", "n_pis", "total_funding", *shares, gini)


def top_funded_pis(awards: DataFrame, ic: str | None = None, year: int | None = None, top_n: int = 15) -> DataFrame:
    rows = funding_by_pi(awards, ic, year).orderBy(F.desc("funding"), "contact_pi_id").limit(top_n)
    return rows.select(F.col("contact_pi_id").alias("pi_id"), "pi_name", F.col("funding").cast("double").alias("funding"), "awards")


def funding_trend(awards: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Funding and active grants for each fiscal year."""
    return awards.where("total_cost > 0").groupBy(*by, "fiscal_year").agg(cost().cast("double").alias("funding"), F.count_distinct("core_project_num").alias("grants"))


def output_by_pi(awards: DataFrame, publinks: DataFrame, ic: str | None = None, year: int | None = None, floor: float = 250_000) -> DataFrame:
    """contact_pi_id, funding, pubs (distinct), for investigators with at least `floor` of funding."""
    rows = with_contact(awards).where(in_scope(ic, year))
    funding = rows.groupBy("contact_pi_id").agg(cost().alias("funding"))
    # one row for each investigator and core before the links are joined
    cores = rows.select("contact_pi_id", "core_project_num").distinct()
    pubs = cores.join(publinks.select("core_project_num", "pmid").distinct(), "core_project_num").groupBy("contact_pi_id").agg(F.count_distinct("pmid").alias("pubs"))
    joined = funding.join(pubs, "contact_pi_id", "left").fillna(0, ["pubs"]).where(F.col("funding") >= floor)
    return joined


def funding_vs_output(awards: DataFrame, publinks: DataFrame, ic: str | None = None, year: int | None = None, floor: float = 250_000, tiles: bool = False) -> DataFrame:
    """Bins of investigators by funding: n, funding range, mean pubs, mean pubs per million.

    Quartiles of floor(n / 4) with the remainder on top, or with `tiles` ntile(4). Below four investigators there are no bins.
    """
    rows = output_by_pi(awards, publinks, ic, year, floor)
    if tiles:
        rows = stats.tiles(rows, "funding", ["contact_pi_id"], 4, "quartile")
    else:
        rows = stats.floor_quartile(rows, "funding", ["contact_pi_id"]).where("quartile IS NOT NULL")
    funding = F.col("funding").cast("double")
    rate = (F.col("pubs") / (funding / 1e6)).cast("decimal(28,12)")
    return rows.groupBy("quartile").agg(
        F.count("*").alias("n"),
        F.min(funding).alias("min_funding"),
        F.max(funding).alias("max_funding"),
        F.round(F.sum("funding").cast("double") / F.count("*"), 4).alias("mean_funding"),
        F.round(F.sum("pubs") / F.count("*"), 6).alias("mean_pubs"),
        F.round(F.sum(rate).cast("double") / F.count("*"), 6).alias("mean_pubs_per_million"),
    )


def funding_output_correlation(awards: DataFrame, publinks: DataFrame, ic: str | None = None, year: int | None = None, floor: float = 250_000) -> DataFrame:
    """n, rank correlation of funding with pubs per million, and whether there were enough investigators."""
    rows = output_by_pi(awards, publinks, ic, year, floor)
    rows = rows.withColumn("rate", F.round(F.col("pubs") / (F.col("funding").cast("double") / 1e6), 9))
    return stats.spearman(rows, "funding", "rate", "contact_pi_id").withColumn("too_few", F.col("n") < 4)


def output_latency(awards: DataFrame, publinks: DataFrame, ic: str | None = None, years: list[int] | None = None) -> DataFrame:
    """core_project_num, start_year, first_pub, latency (null where censored).

    The years choose award-years first, so a grant starts with its first year in scope.
    """
    rows = awards.where(F.col("core_project_num").isNotNull())
    if ic:
        rows = rows.where(F.col("ic") == exprs.ic_code(F.lit(ic)))
    if years:
        rows = rows.where(F.col("fiscal_year").isin(years))
    start = rows.groupBy("core_project_num").agg(F.min("fiscal_year").alias("start_year"))
    first = publinks.groupBy("core_project_num").agg(F.min("pub_year").alias("first_pub"))
    joined = start.join(first, "core_project_num", "left")
    return joined.withColumn("latency", F.when(F.col("first_pub") >= F.col("start_year"), F.col("first_pub") - F.col("start_year")))


def latency_summary(awards: DataFrame, publinks: DataFrame, ic: str | None = None, years: list[int] | None = None) -> DataFrame:
    """Grants, with output, censored, nearest-rank quartiles and interpolated ones."""
    # one row for each latency: at most as many as there are years
    each = output_latency(awards, publinks, ic, years).groupBy("latency").agg(F.count("*").alias("n"))
    known = each.where("latency IS NOT NULL").withColumn("upto", F.sum("n").over(Window.orderBy("latency")))
    steps = F.sort_array(F.collect_list(F.struct("upto", F.col("latency").cast("long").alias("v"))))
    found = known.agg(steps.alias("steps"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_with_output"), F.percentile("latency", [0.25, 0.5, 0.75], F.col("n")).alias("q"))
    row = found.join(F.broadcast(each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_grants"))))  # one row each
    rank = [stats.nearest_rank(F.col("steps"), F.col("n_with_output"), p).alias(f"p{round(100 * p)}_years") for p in (0.25, 0.5, 0.75)]
    inter = [F.round(F.col("q")[i], 6).alias(f"q{p}_interpolated") for i, p in enumerate((25, 50, 75))]
    return row.select("n_grants", "n_with_output", (F.col("n_grants") - F.col("n_with_output")).alias("n_censored"), *rank, *inter)


def grant_panel(awards: DataFrame, publinks: DataFrame, ic: str | None = None, years: list[int] | None = None, floor: float = 100_000) -> DataFrame:
    """One row for each grant with at least `floor` of funding: activity, start, announcement type, funding, pubs."""
    rows = awards.where((F.col("total_cost") > 0) & F.col("core_project_num").isNotNull())
    if ic:
        rows = rows.where(F.col("ic") == exprs.ic_code(F.lit(ic)))
    if years:
        rows = rows.where(F.col("fiscal_year").isin(years))
    grants = rows.groupBy("core_project_num").agg(F.min("activity_code").alias("activity"), F.min("fiscal_year").alias("start_fy"), F.max("foa_number").alias("foa_number"), cost().alias("funding"))
    pubs = publinks.groupBy("core_project_num").agg(F.count_distinct("pmid").alias("pubs"))
    joined = grants.where(F.col("funding") >= floor).join(pubs, "core_project_num", "left").fillna(0, ["pubs"])
    return joined.select("core_project_num", "activity", "start_fy", exprs.foa_type("foa_number").alias("foa_type"), F.col("funding").cast("double").alias("funding"), "pubs")


def foa_type_productivity(awards: DataFrame, publinks: DataFrame, ic: str | None = None, year: int | None = None) -> DataFrame:
    """Awards, funding, distinct pubs and pubs per million for each announcement type."""
    rows = awards.where(in_scope(ic, year, contact=False)).withColumn("foa_type", exprs.foa_type("foa_number"))
    funding = rows.groupBy("foa_type").agg(F.count("*").alias("awards"), cost().alias("funding"))
    cores = rows.select("foa_type", "core_project_num").distinct()
    pubs = cores.join(publinks.select("core_project_num", "pmid").distinct(), "core_project_num").groupBy("foa_type").agg(F.count_distinct("pmid").alias("pubs"))
    joined = funding.join(pubs, "foa_type", "left").fillna(0, ["pubs"]).withColumn("funding", F.col("funding").cast("double"))
    return joined.withColumn("pubs_per_million", F.round(per_million(F.col("pubs"), F.col("funding")), 6))


def mechanism_productivity(awards: DataFrame, publinks: DataFrame, floor: float = 100_000) -> DataFrame:
    """Grants, funding, pubs, median and mean pubs per million for each mechanism family."""
    panel = grant_panel(awards, publinks, floor=floor).withColumn("family", exprs.mechanism_family("activity"))
    rate = F.round(F.col("pubs") / (F.col("funding") / 1e6), 9)
    return panel.withColumn("rate", rate).groupBy("family").agg(
        F.count("*").alias("grants"),
        F.sum(F.col("funding").cast(MONEY)).cast("double").alias("funding"),
        F.sum("pubs").alias("pubs"),
        F.round(F.median("rate"), 6).alias("median_rate"),
        F.round(F.sum(F.col("rate").cast("decimal(28,9)")).cast("double") / F.count("*"), 6).alias("mean_rate"),
    )


def link_coverage(awards: DataFrame, publinks: DataFrame, by: str, min_grants: int = 50) -> DataFrame:
    """Grants with a link of all grants in each stratum: ic, family or fiscal_year (a grant's first)."""
    grants = awards.where("core_project_num IS NOT NULL").groupBy("core_project_num").agg(F.min("ic").alias("ic"), F.min("activity_code").alias("activity_code"), F.min("fiscal_year").alias("fiscal_year"))
    stratum = exprs.mechanism_family("activity_code") if by == "family" else F.col(by)
    linked = publinks.select("core_project_num", F.lit(1).alias("linked")).distinct()
    rows = grants.join(linked, "core_project_num", "left").groupBy(stratum.cast("string").alias("stratum")).agg(F.count("*").alias("grants"), F.count("linked").alias("linked"))
    return rows.where(F.col("grants") >= min_grants).withColumn("coverage", F.round(F.col("linked") / F.col("grants"), 6))


def sample_linked_pmids(awards: DataFrame, publinks: DataFrame, ic: str | None = None, years: list[int] | None = None, n: int = 250) -> DataFrame:
    """The first n linked publications by number."""
    rows = awards.where(in_scope(ic, years, contact=False)).select("core_project_num").distinct()
    return publinks.join(rows, "core_project_num", "left_semi").select("pmid").distinct().orderBy("pmid").limit(n)


def regression(panel: DataFrame, reference: str = "PA", least: int = 30) -> DataFrame:
    """log1p(pubs) by announcement type, log funding, activity and start year: coefficient and percent difference of each type.

    Least squares with explicit dummies, so that the reference type is the one named. Categories with fewer than `least` grants go.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = panel.where(F.col("foa_type").isin("RFA", "PAR", "PAS", "PA") & (F.col("funding") > 0))
    for c in ("activity", "foa_type"):
        rows = rows.join(rows.groupBy(c).count().where(F.col("count") >= least).select(c), c, "left_semi")
    levels = {c: [r[0] for r in rows.select(c).distinct().orderBy(c).collect()] for c in ("foa_type", "activity", "start_fy")}  # a few dozen categories
    base = {"foa_type": reference if reference in levels["foa_type"] else (levels["foa_type"] or [None])[0]}
    names, columns = ["log_funding"], [F.log("funding").alias("log_funding")]
    for c, values in levels.items():
        for v in values:
            if v != base.get(c, values[0]):
                names.append(f"{c}={v}")
                columns.append((F.col(c) == v).cast("double").alias(f"{c}={v}"))
    empty = panel.sparkSession.createDataFrame([], "term string, beta double, pct_diff double, reference string")
    if not levels["foa_type"]:
        return empty  # no category is large enough
    data = rows.select(F.log1p("pubs").alias("label"), *columns)
    fitted = LinearRegression(solver="normal", standardization=False).fit(VectorAssembler(inputCols=names, outputCol="features").transform(data))
    made = [(n, float(b)) for n, b in zip(names, fitted.coefficients, strict=True) if n.startswith("foa_type=")]
    out = panel.sparkSession.createDataFrame(made, "term string, beta double")
    return out.withColumn("pct_diff", (F.exp("beta") - 1) * 100).withColumn("reference", F.lit(base["foa_type"]))
