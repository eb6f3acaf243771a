"""Records of public registries from their JSON and sheets, as typed columns. Missing keys are null, never errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs


def _path(c: str, *paths: str) -> Column:
    """The first of several JSON paths that has a value."""
    found = [exprs.filled(F.get_json_object(c, p)) for p in paths]
    return F.coalesce(*found) if len(found) > 1 else found[0]


def awards_from_json(df: DataFrame, c: str) -> DataFrame:
    """Award records: names of keys differ between versions of the registry, so the first that is there counts."""
    p = lambda *paths: _path(c, *paths)
    pis = F.from_json(F.get_json_object(c, "$.principal_investigators"), "array<struct<profile_id: long, first_name: string, last_name: string, full_name: string, is_contact_pi: boolean>>")
    named = F.transform(
        F.coalesce(pis, F.array().cast("array<struct<profile_id: long, first_name: string, last_name: string, full_name: string, is_contact_pi: boolean>>")),
        lambda x: F.struct(x["profile_id"].alias("profile_id"), F.coalesce(exprs.filled(F.trim(x["full_name"])), F.concat_ws(" ", x["first_name"], x["last_name"])).alias("full_name"), F.coalesce(x["is_contact_pi"], F.lit(False)).alias("is_contact")),
    )
    return df.select(
        p("$.appl_id", "$.application_id").try_cast("long").alias("application_id"),
        p("$.project_num", "$.project_number").alias("project_number"),
        p("$.core_project_num").alias("core_project_num"),
        p("$.project_title", "$.title").alias("project_title"),
        p("$.abstract_text", "$.abstract").alias("abstract"),
        p("$.fiscal_year", "$.fy").try_cast("int").alias("fiscal_year"),
        p("$.agency_ic_admin.abbreviation", "$.agency_ic_admin.code", "$.agency_ic_admin").alias("ic"),
        p("$.agency_ic_admin.name").alias("ic_name"),
        p("$.activity_code").alias("activity_code"),
        p("$.award_type").alias("award_type"),
        F.struct(p("$.organization.org_name", "$.organization.name").alias("name"), p("$.organization.org_city", "$.organization.city").alias("city"), p("$.organization.org_state", "$.organization.state").alias("state"), p("$.organization.org_country", "$.organization.country").alias("country")).alias("organization"),
        named.alias("principal_investigators"),
        p("$.award_amount", "$.total_cost").try_cast("double").alias("total_cost"),
        _terms(c).alias("terms"),
        p("$.opportunity_number", "$.foa_number").alias("foa_number"),
        p("$.full_study_section.name", "$.full_study_section").alias("study_section"),
    )


def _terms(c: str) -> Column:
    raw = F.get_json_object(c, "$.terms")
    listed = F.from_json(raw, "array<string>")
    return F.when(F.startswith(F.trim(raw), F.lit("[")), listed).otherwise(exprs.terms(raw))


def publication_links_from_json(df: DataFrame, c: str) -> DataFrame:
    return df.select(_path(c, "$.coreproject", "$.core_project_num").alias("core_project_num"), _path(c, "$.pmid").alias("pmid"), _path(c, "$.applid", "$.appl_id").try_cast("long").alias("application_id"))


def articles_from_json(df: DataFrame, c: str) -> DataFrame:
    """Article summaries: year from a loose date, title without its full stop, identifiers by kind, authors' names."""
    ids = F.from_json(F.get_json_object(c, "$.articleids"), "array<struct<idtype: string, value: string>>")
    pick = lambda kind: F.get(F.filter(ids, lambda x: x["idtype"] == kind), 0)["value"]
    authors = F.from_json(F.get_json_object(c, "$.authors"), "array<struct<name: string>>")
    return df.select(
        _path(c, "$.uid").alias("pmid"),
        F.rtrim(F.regexp_replace(F.trim(_path(c, "$.title")), r"\.+$", "")).alias("title"),
        _path(c, "$.fulljournalname", "$.source").alias("journal"),
        exprs.first_year(_path(c, "$.pubdate")).alias("year"),
        F.transform(authors, lambda a: a["name"]).alias("authors"),
        pick("doi").alias("doi"),
        pick("pmc").alias("pmcid"),
        F.from_json(F.get_json_object(c, "$.pubtype"), "array<string>").alias("pub_types"),
    )


def metrics_from_json(df: DataFrame, c: str) -> DataFrame:
    """Citation metrics; numbers as text are read, "Yes" and "No" are booleans, rows without a number go."""
    number = lambda k: _path(c, f"$.{k}").try_cast("double")
    rows = df.select(
        _path(c, "$.pmid").alias("pmid"),
        _path(c, "$.year").try_cast("int").alias("year"),
        _path(c, "$.title").alias("title"),
        _path(c, "$.journal").alias("journal"),
        number("relative_citation_ratio").alias("rcr"),
        number("nih_percentile").alias("percentile"),
        _path(c, "$.citation_count").try_cast("int").alias("citation_count"),
        number("citations_per_year").alias("citations_per_year"),
        number("expected_citations_per_year").alias("expected_citations_per_year"),
        number("field_citation_rate").alias("field_citation_rate"),
        exprs.yes_no(_path(c, "$.is_research_article")).alias("is_research_article"),
        exprs.yes_no(_path(c, "$.is_clinical")).alias("is_clinical"),
        number("apt").alias("apt"),
        F.filter(F.split(F.regexp_replace(F.coalesce(F.get_json_object(c, "$.cited_by_clin"), F.lit("")), r"[\[\]\",]", " "), " +"), lambda x: x != "").alias("clinical_citers"),
        _path(c, "$.doi").alias("doi"),
    )
    return rows.where("pmid IS NOT NULL")


def trials_from_json(df: DataFrame, c: str) -> DataFrame:
    """Trials: nested modules flattened, phases joined, interventions as "TYPE: name", core grant numbers from secondary ids."""
    m = lambda path: f"$.protocolSection.{path}"
    strings = lambda path: F.from_json(F.get_json_object(c, m(path)), "array<string>")
    pairs = F.from_json(F.get_json_object(c, m("armsInterventionsModule.interventions")), "array<struct<type: string, name: string>>")
    ids = F.from_json(F.get_json_object(c, m("identificationModule.secondaryIdInfos")), "array<struct<id: string, type: string, domain: string, link: string>>")
    up = lambda x: F.upper(F.coalesce(x, F.lit("")))
    has = lambda x, s: F.contains(x, F.lit(s))
    funder = F.filter(ids, lambda x: (up(x["type"]) == "NIH") | has(up(x["domain"]), "NIH") | has(F.coalesce(x["link"], F.lit("")), "nih.gov") | ((up(x["type"]) == "OTHER_GRANT") & has(up(x["id"]), "NIH")))
    grants = F.array_distinct(F.filter(F.transform(funder, lambda x: exprs.grant_number(F.coalesce(x["id"], F.lit("")))), lambda g: g != ""))
    references = F.from_json(F.get_json_object(c, m("referencesModule.references")), "array<struct<pmid: string, type: string, citation: string>>")
    return df.select(
        _path(c, m("identificationModule.nctId")).alias("nct_id"),
        _path(c, m("identificationModule.briefTitle"), m("identificationModule.officialTitle")).alias("title"),
        _path(c, m("statusModule.overallStatus")).alias("status"),
        _path(c, m("statusModule.startDateStruct.date")).alias("start_date"),
        _path(c, m("statusModule.completionDateStruct.date"), m("statusModule.primaryCompletionDateStruct.date")).alias("completion_date"),
        _path(c, m("sponsorCollaboratorsModule.leadSponsor.name")).alias("sponsor"),
        F.array_join(strings("designModule.phases"), "/").alias("phase"),
        _path(c, m("designModule.studyType")).alias("study_type"),
        _path(c, m("designModule.enrollmentInfo.count")).try_cast("int").alias("enrollment"),
        strings("conditionsModule.conditions").alias("conditions"),
        F.transform(pairs, lambda x: F.concat_ws(": ", exprs.filled(x["type"]), x["name"])).alias("interventions"),
        F.coalesce(grants, F.array().cast("array<string>")).alias("grants"),
        references.alias("references"),
        F.coalesce(F.get_json_object(c, "$.hasResults").try_cast("boolean"), F.lit(False)).alias("has_results"),
    )


def labels_from_json(df: DataFrame, c: str) -> DataFrame:
    """Drug labels: first names and the first 300 characters of the indication."""
    first = lambda k: F.get(F.from_json(F.get_json_object(c, k), "array<string>"), 0)
    names = {"brand_name": "brand_name", "generic_name": "generic_name", "manufacturer_name": "manufacturer", "application_number": "application_number", "route": "route"}
    return df.select(*[first(f"$.openfda.{k}").alias(v) for k, v in names.items()], F.substring(first("$.indications_and_usage"), 1, 300).alias("indication"))


def mortality(df: DataFrame, cause: str | None = None, state: str = "United States", years: list[int] | None = None) -> DataFrame:
    """Deaths and adjusted rates by year from rows of text."""
    rows = df.select(exprs.lenient_int("year").cast("int").alias("year"), "cause_name", "state", exprs.lenient_int("deaths").alias("deaths"), F.col("aadr").try_cast("double").alias("aadr"))
    if cause:
        rows = rows.where(F.col("cause_name") == cause)
    rows = rows.where(F.col("state") == state)
    return rows.where(F.col("year").isin(years)) if years else rows


def assay_summary(df: DataFrame, top: int = 10) -> DataFrame:
    """(assay, records) of the most frequent assays, with all records and assays counted."""
    counts = df.groupBy("assay").agg(F.count("*").alias("records"))
    total = df.agg(F.count("*").alias("n_records"), F.count_distinct("assay").alias("n_assays"))
    return counts.orderBy(F.desc("records"), "assay").limit(top).join(F.broadcast(total))


def resolve_foa(numbers: DataFrame, hits: DataFrame) -> DataFrame:
    """For each number: the hit that is it in any case, else the first hit, else what the number itself tells.

    numbers has (foa_number); hits has (foa_number, pos, number, title, agency, status).
    """
    exact = F.lower("number") == F.lower("foa_number")
    best = hits.groupBy("foa_number").agg(F.min_by(F.struct("number", "title", "agency", "status"), F.struct(~exact, "pos")).alias("h"))
    rows = numbers.join(best, "foa_number", "left")
    return rows.select("foa_number", exprs.foa_type_lenient("foa_number").alias("type"), exprs.guide_url("foa_number").alias("url"), "h.title", "h.agency", "h.status", F.col("h").isNull().alias("derived"))


def success_rates(df: DataFrame, since: int | None = None) -> DataFrame:
    """(fiscal_year, reviewed, awarded, rate) from a sheet's cells; footnotes go, percentages become fractions."""
    year = exprs.lenient_int("fy").cast("int")
    rows = df.where(year >= max(1900, since or 0))
    return rows.select(year.alias("fiscal_year"), exprs.lenient_int("reviewed").alias("reviewed"), exprs.lenient_int("awarded").alias("awarded"), exprs.rate("rate").alias("rate"))
