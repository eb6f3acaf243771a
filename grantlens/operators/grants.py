"""Grants and investigators: search, output per dollar, support against impact, translation, redundancy, open science."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs, stats
from .portfolio import cost, per_million


def search(awards: DataFrame, text: str | None = None, years: list[int] | None = None, ics: list[str] | None = None, activities: list[str] | None = None, pi_name: str | None = None, pi_ids: list[str] | None = None, limit: int = 100) -> DataFrame:
    """Award-years that pass all filters given, latest first."""
    if not (text or years or ics or activities or pi_name or pi_ids):
        raise ValueError("at least one filter is needed")
    keep = F.lit(True)
    if text:
        keep &= F.contains(F.lower("project_title"), F.lit(text.lower()))
    if years:
        keep &= F.col("fiscal_year").isin(years)
    if ics:
        keep &= F.col("ic").isin(ics)
    if activities:
        keep &= F.col("activity_code").isin(activities)
    if pi_name:
        keep &= F.contains(F.lower("pi_names"), F.lit(pi_name.lower()))
    if pi_ids:
        keep &= F.arrays_overlap(F.regexp_extract_all("pi_ids", F.lit("([0-9]+)"), F.lit(1)), F.array(*map(F.lit, pi_ids)))
    return awards.where(keep).orderBy(F.desc("fiscal_year"), "application_id").limit(limit)


def get(awards: DataFrame, number: str) -> DataFrame:
    """The latest award-year of a core or full project number."""
    return awards.where((F.col("core_project_num") == number) | (F.col("full_project_num") == number)).orderBy(F.desc("fiscal_year"), "application_id").limit(1)


def grant_key() -> Column:
    return F.coalesce(exprs.filled("core_project_num"), "full_project_num")


def pubs_per_dollar(awards: DataFrame, publinks: DataFrame, floor: float = 250_000, max_grants: int = 400) -> DataFrame:
    """Links (not distinct publications) per million for the best-funded grants, with what was eligible and whether that was capped."""
    grants = awards.withColumn("grant", grant_key()).groupBy("grant").agg(cost().alias("funding"), F.min_by("activity_code", F.struct("fiscal_year", "application_id")).alias("activity"))
    grants = grants.where(F.col("funding") >= floor)
    ranked = stats.with_total(stats.ordinal(grants, "funding", ["grant"], "rank", descending=True), "eligible")
    kept = ranked.where(F.col("rank") <= max_grants)
    links = publinks.groupBy(F.col("core_project_num").alias("grant")).agg(F.count("*").alias("links"))
    rows = kept.join(links, "grant", "left").fillna(0, ["links"]).withColumn("funding", F.col("funding").cast("double"))
    rate = F.round(per_million(F.col("links"), F.col("funding")), 6)
    return rows.select("grant", exprs.mechanism_family("activity").alias("family"), "funding", "links", rate.alias("pubs_per_million"), "eligible", (F.col("eligible") > max_grants).alias("capped"))


def pi_support(awards: DataFrame, floor: float = 150_000, first_only: bool = False) -> DataFrame:
    """pi, funding, grants: every investigator of an award gets its full cost (or the first only)."""
    ids = F.regexp_extract_all(F.coalesce("pi_ids", F.lit("")), F.lit("([0-9]+)"), F.lit(1))
    rows = awards.withColumn("pi", F.explode(F.array_distinct(F.slice(ids, 1, 1) if first_only else ids)))
    return rows.groupBy("pi").agg(cost().alias("funding"), F.count_distinct(grant_key()).alias("grants")).where(F.col("funding") >= floor)


def support_vs_impact(awards: DataFrame, publinks: DataFrame, metrics: DataFrame, floor: float = 150_000, max_pis: int = 60) -> DataFrame:
    """Summed citation ratio per million for a systematic sample of investigators by funding, in quartiles.

    One chain of joins for all investigators; publications without a ratio count as 0.
    """
    chosen = stats.systematic_sample(pi_support(awards, floor), "funding", ["pi"], max_pis)
    ids = F.regexp_extract_all(F.coalesce("pi_ids", F.lit("")), F.lit("([0-9]+)"), F.lit(1))
    cores = awards.select(F.explode(F.array_distinct(ids)).alias("pi"), "core_project_num").distinct()
    pubs = chosen.select("pi").join(cores, "pi").join(publinks, "core_project_num").select("pi", "pmid").distinct()
    impact = pubs.join(metrics.select("pmid", "rcr"), "pmid", "left").groupBy("pi").agg(F.count("*").alias("pubs"), F.sum(F.coalesce("rcr", F.lit(0)).cast("decimal(18,6)")).cast("double").alias("rcr_sum"))
    rows = chosen.join(impact, "pi", "left").fillna(0, ["pubs", "rcr_sum"])
    rows = rows.withColumn("rcr_per_million", F.round(F.col("rcr_sum") / (F.col("funding").cast("double") / 1e6), 6))
    return stats.floor_quartile(rows, "funding", ["pi"]).withColumn("funding", F.col("funding").cast("double"))


def translation(awards: DataFrame, publinks: DataFrame, metrics: DataFrame, citers: DataFrame, max_grants: int | None = None) -> DataFrame:
    """For each grant: publications, clinical citers reached, mean translation potential, years from start to the first citer.

    Two hops by equality joins. A first citer before the start gives no latency.
    """
    grants = awards.withColumn("grant", grant_key()).groupBy("grant").agg(F.min("fiscal_year").alias("start_year"), cost().alias("funding"), F.min_by("project_title", "application_id").alias("title"))
    if max_grants:
        grants = grants.orderBy(F.desc("funding"), "grant").limit(max_grants)
    links = grants.select("grant").join(publinks.select(F.col("core_project_num").alias("grant"), "pmid").distinct(), "grant")
    apt = links.join(metrics.select("pmid", "apt"), "pmid", "left").groupBy("grant").agg(F.count("*").alias("pubs"), F.round(F.sum(F.col("apt").cast("decimal(18,6)")).cast("double") / F.count("apt"), 3).alias("mean_apt"))
    reach = links.join(citers, "pmid").select("grant", "citer").distinct().join(metrics.select(F.col("pmid").alias("citer"), F.col("pub_year").alias("citer_year")), "citer", "left")
    reach = reach.groupBy("grant").agg(F.count("*").alias("clinical_reach"), F.min("citer_year").alias("first_citer_year"))
    rows = grants.join(apt, "grant", "left").join(reach, "grant", "left").fillna(0, ["pubs", "clinical_reach"])
    latency = F.when(F.col("first_citer_year") >= F.col("start_year"), F.col("first_citer_year") - F.col("start_year"))
    return rows.select("grant", "title", "start_year", "pubs", "clinical_reach", "mean_apt", latency.alias("latency_years"))


def translation_lineage(awards: DataFrame, publinks: DataFrame, metrics: DataFrame, citers: DataFrame, core: str) -> DataFrame:
    """One grant's lineage with its first eight citers in text order."""
    own = awards.where(grant_key() == core)
    row = translation(own, publinks.where(F.col("core_project_num") == core), metrics, citers)
    examples = publinks.where(F.col("core_project_num") == core).join(citers, "pmid").agg(F.array_join(F.slice(F.array_sort(F.collect_set("citer")), 1, 8), ",").alias("example_citers"))
    return row.join(examples)


def similar_grants(grants: DataFrame, min_jaccard: float = 0.4, min_terms: int = 8, max_grants: int | None = None, top: int | None = 25) -> DataFrame:
    """Pairs of grants (id, words array) by Jaccard similarity, by an inverted index on the rarest words of each distinct set.

    Two sets of similarity t share one of the first n - ceil(t n) + 1 words of each in order of rarity, so frequent words join no one.
    Equal sets are one class. The threshold holds before rounding. For the `top` pairs high thresholds are tried first: where they
    give enough pairs, the rest is lower and need not be looked at; and of each class only its first `top` + 1 ids can be among them.
    """
    sized = grants.select("id", F.array_sort(F.array_distinct("words")).alias("words")).where(F.size("words") >= min_terms)
    if max_grants:
        sized = sized.orderBy("id").limit(max_grants)
    members = sized
    if top:
        members = sized.withColumn("r", F.row_number().over(Window.partitionBy("words").orderBy("id"))).where(F.col("r") <= top + 1).drop("r")
    within = _pairs_of_classes(members, None)
    if not top:
        return within.union(_pairs_of_classes(members, _similar_classes(sized, min_jaccard)))
    best = lambda rows: rows.orderBy(F.desc("jaccard"), "a", "b").limit(top)
    found = best(within)
    for t in sorted({max(min_jaccard, x) for x in (0.9, 0.7, min_jaccard)}, reverse=True):
        if found.count() == top:
            break
        found = best(within.union(_pairs_of_classes(members, _similar_classes(sized, t))))
    return found


def _similar_classes(sized: DataFrame, t: float) -> DataFrame:
    """(wa, wb) of unequal sets of words with similarity t or more; each pair once, wa < wb."""
    sets = sized.select("words").distinct().withColumn("n", F.size("words"))
    each = sets.select("words", "n", F.explode("words").alias("word"))
    often = each.groupBy("word").agg(F.count("*").alias("df"))
    order = Window.partitionBy("words").orderBy("df", "word")
    # a set's place of the word leaves so many words that may still be shared
    prefix = each.join(often, "word").withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * t - 1e-9) + 1)
    near = (F.col("a.word") == F.col("b.word")) & (F.col("a.words") < F.col("b.words")) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * t - 1e-9)
    pairs = prefix.alias("a").join(prefix.alias("b"), near).select(F.col("a.words").alias("wa"), F.col("b.words").alias("wb")).distinct()
    return pairs.where(_jaccard() >= t)


def _jaccard() -> Column:
    shared = F.size(F.array_intersect("wa", "wb"))
    return shared / (F.size("wa") + F.size("wb") - shared)


def _pairs_of_classes(members: DataFrame, classes: DataFrame | None) -> DataFrame:
    """(a, b, n_shared, jaccard, shared_terms), a < b, of ids in similar classes (wa, wb), or within classes."""
    x, y = members.select(F.col("id").alias("x"), F.col("words").alias("wa")), members.select(F.col("id").alias("y"), F.col("words").alias("wb"))
    if classes is None:
        rows = x.join(y, (F.col("wa") == F.col("wb")) & (F.col("x") < F.col("y")))
    else:
        rows = classes.join(x, "wa").join(y, "wb")
    shared = F.array_intersect("wa", "wb")
    return rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.size(shared).cast("long").alias("n_shared"), F.round(_jaccard(), 6).alias("jaccard"), F.array_join(F.slice(F.array_sort(shared), 1, 12), " ").alias("shared_terms"))


def redundancy(awards: DataFrame, min_jaccard: float = 0.4, min_terms: int = 8, max_grants: int = 80, top: int = 25) -> dict[str, DataFrame]:
    """Pairs of a portfolio's first max_grants grants with alike terms: the closest, and one row of totals.

    awards has terms (array). A grant has the first of its records with most terms, and the investigators of that record and of later
    ones. same_pi tells one team's programme from pairs worth a look.
    """
    ids = F.regexp_extract_all(F.coalesce("pi_ids", F.lit("")), F.lit("([0-9]+)"), F.lit(1))
    rows = awards.withColumn("grant", grant_key()).where("grant IS NOT NULL").select("grant", "application_id", "project_title", F.array_sort(F.array_distinct(F.transform("terms", F.lower))).alias("words"), ids.alias("pis"))
    richest = F.max_by(F.struct("words", F.col("project_title").alias("title"), F.col("application_id").alias("at")), F.struct(F.size("words"), -F.col("application_id")))
    grants = rows.groupBy("grant").agg(F.min("application_id").alias("seen"), richest.alias("g")).select("grant", "seen", "g.*").where(F.size("words") >= min_terms)
    grants = grants.orderBy("seen").limit(max_grants)
    pis = rows.join(grants.select("grant", "at"), "grant").where("application_id >= at").groupBy("grant").agg(F.array_distinct(F.flatten(F.collect_list("pis"))).alias("pis"))
    known = grants.join(pis, "grant")
    pairs = similar_grants(grants.select(F.col("grant").alias("id"), "words"), min_jaccard, min_terms, top=None)
    side = lambda c: known.select(F.col("grant").alias(c), F.col("title").alias(f"title_{c}"), F.col("pis").alias(f"pis_{c}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("same_pi", F.arrays_overlap("pis_a", "pis_b")).withColumn("jaccard", F.round("jaccard", 3))
    totals = grants.agg(F.count("*").alias("grants_analyzed")).join(F.broadcast(pairs.agg(F.count("*").alias("n_pairs"), F.count_if(~F.col("same_pi")).alias("cross_pi"))))  # one row each
    return {"pairs": pairs.orderBy(F.desc("jaccard"), "a", "b").limit(top).select("a", "b", "title_a", "title_b", "jaccard", "shared_terms", "same_pi"), "totals": totals}


def open_science(publinks: DataFrame, metrics: DataFrame) -> DataFrame:
    """Share of each grant's publications in an open archive."""
    rows = publinks.select("core_project_num", "pmid").distinct().join(metrics.select("pmid", "has_pmc"), "pmid")
    return rows.groupBy("core_project_num").agg(F.count("*").alias("pubs"), F.count_if("has_pmc").alias("in_pmc")).withColumn("pmc_fraction", F.round(F.col("in_pmc") / F.col("pubs"), 3))


def open_science_signals(abstracts: DataFrame, publinks: DataFrame, metrics: DataFrame, trials: DataFrame) -> DataFrame:
    """For each grant of abstracts (core_project_num, text): publications, share in an open archive, datasets that its abstract names, and
    whether a trial (core) reports its number. Each is a floor: an abstract names few datasets, and few grants are trials."""
    found = F.transform(exprs.accessions("text"), lambda m: F.concat(m["repository"], F.lit(":"), m["accession"]))
    rows = abstracts.select("core_project_num", F.array_join(found, ";").alias("dataset_accessions"))
    links = publinks.groupBy("core_project_num").agg(F.count_distinct("pmid").alias("publications"))
    trial = trials.select(F.col("core").alias("core_project_num"), F.lit(True).alias("has_registered_trial")).distinct()
    out = rows.join(links, "core_project_num", "left").join(open_science(publinks, metrics).select("core_project_num", "pmc_fraction"), "core_project_num", "left").join(trial, "core_project_num", "left")
    return out.fillna(0, ["publications"]).fillna(False, ["has_registered_trial"])


def support_correlation(rows: DataFrame) -> DataFrame:
    """Rank correlation of funding with summed citation ratio per million over the rows of support_vs_impact."""
    return stats.spearman(rows.select("pi", "funding", "rcr_per_million"), "funding", "rcr_per_million", "pi")


def top_publications(publinks: DataFrame, metrics: DataFrame, n: int = 10) -> DataFrame:
    rows = publinks.select("pmid").distinct().join(metrics, "pmid", "left")
    return rows.orderBy(F.coalesce("rcr", F.lit(0.0)).desc(), "pmid").limit(n).select("pmid", "rcr", "apt")

