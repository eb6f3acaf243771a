"""Queries by name, each a plan over the tables of a folder, and the SQL that gives the same rows elsewhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs, stats
from ..operators import grants, graph, lookup, portfolio, topics
from ..sources import records, standin
from ..sources.standin import CTE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
YEARS = [1995, 1996, 1997, 1998, 1999]
IC = "BUILDING"
THIS_YEAR = 2002


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def _read(s: SparkSession, d: str, t: str) -> DataFrame:
    return s.read.parquet(f"{d}/{t}.parquet")


def _int(*columns: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns({c: F.col(c).cast("long") for c in columns})


# ---------------------------------------------------------------- oracle fragments

_PI = """award_pi AS (SELECT *, coalesce(nullif(trim(regexp_extract(pi_ids, '([0-9]+) *\\(contact\\)', 1)), ''), trim(split_part(pi_ids, ';', 1))) AS contact_pi_id,
  coalesce(nullif(trim(regexp_extract(pi_names, '([^;]+)\\(contact\\)', 1)), ''), trim(split_part(pi_names, ';', 1))) AS contact_pi_name FROM awards)"""
_SCOPE = "contact_pi_id <> '' AND total_cost > 0"
_MONEY = "sum(CAST(total_cost AS DECIMAL(18,2)))"


def _quoted(codes: list[str]) -> str:
    return ", ".join(f"'{c}'" for c in codes)


_FAMILY = (
    "CASE WHEN {0} = '' THEN 'other' WHEN starts_with({0}, 'DP') THEN 'research' WHEN starts_with({0}, 'Z') THEN 'intramural' WHEN {0} IN ("
    + _quoted(exprs.CENTER_CODES)
    + ") OR regexp_matches({0}, '^[PSGC]') THEN 'center_core' WHEN {0} IN ("
    + _quoted(exprs.TRAINING_CODES)
    + ") OR regexp_matches({0}, '^[TFK]') THEN 'training_career' WHEN regexp_matches({0}, '^[RU]') THEN 'research' ELSE 'other' END"
)
_FOA = "CASE WHEN coalesce(foa_number, '') = '' THEN 'NONE' " + " ".join(f"WHEN starts_with(foa_number, '{x}') THEN '{kind}'" for x, kind, _ in exprs.FOA_PREFIXES) + " ELSE 'OTHER' END"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join((CTE, *ctes)) + "\n"


def _a(s: SparkSession, d: str) -> DataFrame:
    return standin.awards(s, d)


def _p(s: SparkSession, d: str) -> DataFrame:
    return standin.publinks(s, d)


# ---------------------------------------------------------------- concentration and trend

_SHARES = "{0} AS n_pis, CAST(sum(f) AS DOUBLE) AS total_funding, " + ", ".join(f"round(CAST(sum(CASE WHEN r <= greatest(1, round_even(n * CAST({p / 100} AS DOUBLE), 0)) THEN f END) AS DOUBLE) / CAST(sum(f) AS DOUBLE), 6) AS top{p}_pct_share" for p in (1, 5, 10)) + ", round((count(*) + 1 - 2 * (CAST(sum(r * f) AS DOUBLE) / CAST(sum(f) AS DOUBLE))) / count(*), 6) AS gini"


@query(_with(_PI, f"b AS (SELECT contact_pi_id k, {_MONEY} f FROM award_pi WHERE {_SCOPE} GROUP BY 1)", "r AS (SELECT *, row_number() OVER (ORDER BY f DESC, k) r, count(*) OVER () n FROM b)") + f"SELECT {_SHARES.format('count(*)')} FROM r")
def funding_concentration(s, d):
    return portfolio.funding_concentration(_a(s, d))


@query(_with(_PI, f"b AS (SELECT ic, contact_pi_id k, {_MONEY} f FROM award_pi WHERE {_SCOPE} GROUP BY 1, 2)", "r AS (SELECT *, row_number() OVER (PARTITION BY ic ORDER BY f DESC, k) r, count(*) OVER (PARTITION BY ic) n FROM b)") + f"SELECT ic, {_SHARES.format('count(*)')} FROM r GROUP BY ic")
def funding_concentration_by_ic(s, d):
    return portfolio.funding_concentration_by_ic(_a(s, d))


@query(_with(_PI) + f"SELECT contact_pi_id AS pi_id, min(contact_pi_name) AS pi_name, CAST({_MONEY} AS DOUBLE) AS funding, count(*) AS awards FROM award_pi WHERE {_SCOPE} GROUP BY 1 ORDER BY {_MONEY} DESC, 1 LIMIT 15")
def top_funded_pis(s, d):
    return portfolio.top_funded_pis(_a(s, d))


@query(_with() + f"SELECT fiscal_year, CAST({_MONEY} AS DOUBLE) AS funding, count(DISTINCT core_project_num) AS grants FROM awards WHERE total_cost > 0 GROUP BY 1")
def funding_trend(s, d):
    return portfolio.funding_trend(_a(s, d))


@query(_with() + f"SELECT ic, fiscal_year, CAST({_MONEY} AS DOUBLE) AS funding, count(DISTINCT core_project_num) AS grants FROM awards WHERE total_cost > 0 GROUP BY 1, 2")
def funding_trend_by_ic(s, d):
    return portfolio.funding_trend(_a(s, d), ("ic",))


# ---------------------------------------------------------------- funding against output

_OUTPUT = [
    _PI,
    f"f AS (SELECT contact_pi_id k, {_MONEY} funding FROM award_pi WHERE {_SCOPE} GROUP BY 1)",
    f"u AS (SELECT a.contact_pi_id k, count(DISTINCT l.pmid) pubs FROM award_pi a JOIN publinks l ON a.core_project_num = l.core_project_num WHERE {_SCOPE} GROUP BY 1)",
    "o AS (SELECT f.k, funding, coalesce(pubs, 0) pubs FROM f LEFT JOIN u ON f.k = u.k WHERE funding >= 250000)",
]
_BINS = """SELECT CAST(quartile AS INT) AS quartile, count(*) AS n, CAST(min(funding) AS DOUBLE) AS min_funding, CAST(max(funding) AS DOUBLE) AS max_funding, round(CAST(sum(funding) AS DOUBLE) / count(*), 4) AS mean_funding,
  round(CAST(sum(pubs) AS DOUBLE) / count(*), 6) AS mean_pubs, round(CAST(sum(CAST(pubs / (CAST(funding AS DOUBLE) / 1e6) AS DECIMAL(28,12))) AS DOUBLE) / count(*), 6) AS mean_pubs_per_million FROM q GROUP BY 1"""


@query(_with(*_OUTPUT, "q AS (SELECT *, least((row_number() OVER (ORDER BY funding, k) - 1) // (count(*) OVER () // 4), 3) + 1 AS quartile FROM o)") + _BINS)
def funding_vs_output_quartiles(s, d):
    return portfolio.funding_vs_output(_a(s, d), _p(s, d))


@query(_with(*_OUTPUT, "q AS (SELECT *, ntile(4) OVER (ORDER BY funding, k) AS quartile FROM o)") + _BINS)
def funding_vs_output_ntile(s, d):
    return portfolio.funding_vs_output(_a(s, d), _p(s, d), tiles=True)


@query(
    _with(*_OUTPUT, "r AS (SELECT row_number() OVER (ORDER BY funding, k) rx, row_number() OVER (ORDER BY round(pubs / (CAST(funding AS DOUBLE) / 1e6), 9), k) ry FROM o)")
    + "SELECT count(*) AS n, CASE WHEN count(*) >= 3 THEN round(1 - 6 * sum((rx - ry) * (rx - ry)) / (CAST(count(*) AS DOUBLE) * (CAST(count(*) AS DOUBLE) * count(*) - 1)), 6) END AS spearman, count(*) < 4 AS too_few FROM r"
)
def funding_vs_output_spearman(s, d):
    return portfolio.funding_output_correlation(_a(s, d), _p(s, d))


# ---------------------------------------------------------------- latency

_LATENCY = [
    f"st AS (SELECT core_project_num c, min(fiscal_year) s FROM awards WHERE fiscal_year IN ({', '.join(map(str, YEARS))}) GROUP BY 1)",
    "fp AS (SELECT core_project_num c, min(pub_year) p FROM publinks GROUP BY 1)",
    "lat AS (SELECT st.c, s, p, CASE WHEN p >= s THEN p - s END AS l FROM st LEFT JOIN fp ON st.c = fp.c)",
]


@query(_with(*_LATENCY) + "SELECT c AS core_project_num, s AS start_year, p AS first_pub, l AS latency FROM lat")
def output_latency(s, d):
    return portfolio.output_latency(_a(s, d), _p(s, d), years=YEARS)


@query(
    _with(*_LATENCY, "z AS (SELECT count(*) n, count(l) k, list_sort(list(l) FILTER (WHERE l IS NOT NULL)) v, quantile_cont(l, [0.25, 0.5, 0.75]) q FROM lat)")
    + "SELECT n AS n_grants, k AS n_with_output, n - k AS n_censored, "
    + ", ".join(f"CAST(v[1 + least(k - 1, CAST(floor(k * {p}) AS BIGINT))] AS BIGINT) AS p{round(100 * p)}_years" for p in (0.25, 0.5, 0.75))
    + ", "
    + ", ".join(f"round(q[{i + 1}], 6) AS q{p}_interpolated" for i, p in enumerate((25, 50, 75)))
    + " FROM z"
)
def output_latency_summary(s, d):
    return portfolio.latency_summary(_a(s, d), _p(s, d), years=YEARS)


# ---------------------------------------------------------------- panel, announcement types, mechanisms, coverage

_PANEL = f"""panel AS (SELECT g.c AS core_project_num, activity, start_fy, {_FOA} AS foa_type, CAST(f AS DOUBLE) AS funding, coalesce(pubs, 0) AS pubs
  FROM (SELECT core_project_num c, min(activity_code) activity, min(fiscal_year) start_fy, max(foa_number) foa_number, {_MONEY} f FROM awards WHERE total_cost > 0 GROUP BY 1) g
  LEFT JOIN (SELECT core_project_num c, count(DISTINCT pmid) pubs FROM publinks GROUP BY 1) u ON g.c = u.c WHERE f >= 100000)"""


@query(_with(_PANEL) + "SELECT * FROM panel")
def grant_panel(s, d):
    return portfolio.grant_panel(_a(s, d), _p(s, d))


@query(
    _with(f"t AS (SELECT *, {_FOA} AS foa_type FROM awards WHERE total_cost > 0)", f"f AS (SELECT foa_type, count(*) awards, CAST({_MONEY} AS DOUBLE) funding FROM t GROUP BY 1)", "u AS (SELECT foa_type, count(DISTINCT pmid) pubs FROM t JOIN publinks l ON t.core_project_num = l.core_project_num GROUP BY 1)")
    + "SELECT f.foa_type, awards, funding, coalesce(pubs, 0) AS pubs, round(CASE WHEN funding > 0 THEN coalesce(pubs, 0) / (funding / 1e6) END, 6) AS pubs_per_million FROM f LEFT JOIN u ON f.foa_type = u.foa_type"
)
def foa_type_productivity(s, d):
    return portfolio.foa_type_productivity(_a(s, d), _p(s, d))


@query(
    _with(_PANEL, f"m AS (SELECT *, {_FAMILY.format('activity')} AS family, round(pubs / (funding / 1e6), 9) AS rate FROM panel)")
    + "SELECT family, count(*) AS grants, CAST(sum(CAST(funding AS DECIMAL(18,2))) AS DOUBLE) AS funding, CAST(sum(pubs) AS BIGINT) AS pubs, round(median(rate), 6) AS median_rate, round(CAST(sum(CAST(rate AS DECIMAL(28,9))) AS DOUBLE) / count(*), 6) AS mean_rate FROM m GROUP BY 1"
)
def mechanism_productivity(s, d):
    return portfolio.mechanism_productivity(_a(s, d), _p(s, d))


def _coverage_sql(value: str) -> str:
    return (
        _with("g AS (SELECT core_project_num c, min(ic) ic, min(activity_code) activity_code, min(fiscal_year) fiscal_year FROM awards GROUP BY 1)", "k AS (SELECT DISTINCT core_project_num c FROM publinks)")
        + f"SELECT CAST({value} AS VARCHAR) AS stratum, count(*) AS grants, count(k.c) AS linked, round(CAST(count(k.c) AS DOUBLE) / count(*), 6) AS coverage FROM g LEFT JOIN k ON g.c = k.c GROUP BY 1 HAVING count(*) >= 20"
    )


for _by, _value in (("ic", "ic"), ("family", _FAMILY.format("activity_code")), ("fiscal_year", "fiscal_year")):
    query(_coverage_sql(_value), f"coverage_by_{'year' if _by == 'fiscal_year' else _by}")(lambda s, d, by=_by: portfolio.link_coverage(_a(s, d), _p(s, d), by, 20))


@query(_with() + "SELECT DISTINCT l.pmid FROM publinks l JOIN awards a ON l.core_project_num = a.core_project_num WHERE total_cost > 0 ORDER BY 1 LIMIT 250")
def sample_linked_pmids(s, d):
    return portfolio.sample_linked_pmids(_a(s, d), _p(s, d))


# ---------------------------------------------------------------- grants and investigators

_PER_DOLLAR = [
    f"g AS (SELECT core_project_num AS grant_key, {_MONEY} f, arg_min(activity_code, (fiscal_year, application_id)) activity FROM awards GROUP BY 1 HAVING {_MONEY} >= 250000)",
    "r AS (SELECT *, row_number() OVER (ORDER BY f DESC, grant_key) rank, count(*) OVER () eligible FROM g)",
    "k AS (SELECT core_project_num c, count(*) links FROM publinks GROUP BY 1)",
]


def _per_dollar_sql(cap: int) -> str:
    return _with(*_PER_DOLLAR) + f"SELECT grant_key AS grant, {_FAMILY.format('activity')} AS family, CAST(f AS DOUBLE) AS funding, coalesce(links, 0) AS links, round(coalesce(links, 0) / (CAST(f AS DOUBLE) / 1e6), 6) AS pubs_per_million, eligible, eligible > {cap} AS capped FROM r LEFT JOIN k ON grant_key = c WHERE rank <= {cap}"


@query(_per_dollar_sql(400).replace("AS grant,", 'AS "grant",'))
def pubs_per_dollar_capped(s, d):
    return grants.pubs_per_dollar(_a(s, d), _p(s, d), max_grants=400)


@query(_per_dollar_sql(10**9).replace("AS grant,", 'AS "grant",'))
def pubs_per_dollar_ranked(s, d):
    return grants.pubs_per_dollar(_a(s, d), _p(s, d), max_grants=10**9)


_SUPPORT = [
    "e AS (SELECT unnest(list_distinct(regexp_extract_all(coalesce(pi_ids, ''), '([0-9]+)', 1))) AS pi, * FROM awards)",
    f"ps AS (SELECT pi, {_MONEY} AS funding, count(DISTINCT core_project_num) AS grants FROM e GROUP BY 1 HAVING {_MONEY} >= 150000)",
]
_SAMPLE = "sm AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY funding, pi) - 1 AS r, count(*) OVER () AS n FROM ps) WHERE n <= 60 OR r IN (SELECT CAST(floor(i * n / 60) AS BIGINT) FROM range(60) t(i)))"


@query(_with(*_SUPPORT, _SAMPLE) + "SELECT pi, CAST(funding AS DOUBLE) AS funding, grants FROM sm")
def pi_stratified_sample(s, d):
    return stats.systematic_sample(grants.pi_support(_a(s, d)), "funding", ["pi"], 60).withColumn("funding", F.col("funding").cast("double"))


@query(
    _with(*_SUPPORT, _SAMPLE, "pp AS (SELECT DISTINCT sm.pi, l.pmid FROM sm JOIN (SELECT DISTINCT pi, core_project_num FROM e) x ON sm.pi = x.pi JOIN publinks l ON x.core_project_num = l.core_project_num)", "im AS (SELECT pi, count(*) pubs, CAST(sum(CAST(coalesce(rcr, 0) AS DECIMAL(18,6))) AS DOUBLE) AS rcr_sum FROM pp LEFT JOIN metrics m ON pp.pmid = m.pmid GROUP BY 1)")
    + "SELECT sm.pi, CAST(funding AS DOUBLE) AS funding, grants, coalesce(pubs, 0) AS pubs, coalesce(rcr_sum, 0) AS rcr_sum, round(coalesce(rcr_sum, 0) / (CAST(funding AS DOUBLE) / 1e6), 6) AS rcr_per_million, CAST(least((row_number() OVER (ORDER BY funding, sm.pi) - 1) // (count(*) OVER () // 4), 3) + 1 AS INT) AS quartile FROM sm LEFT JOIN im ON sm.pi = im.pi"
)
def pi_support_vs_rcr(s, d):
    return grants.support_vs_impact(_a(s, d), _p(s, d), standin.metrics(s, d))


@query(
    _with(*_SUPPORT, _SAMPLE, "pp AS (SELECT DISTINCT sm.pi, l.pmid FROM sm JOIN (SELECT DISTINCT pi, core_project_num FROM e) x ON sm.pi = x.pi JOIN publinks l ON x.core_project_num = l.core_project_num)", "im AS (SELECT pi, CAST(sum(CAST(coalesce(rcr, 0) AS DECIMAL(18,6))) AS DOUBLE) AS rcr_sum FROM pp LEFT JOIN metrics m ON pp.pmid = m.pmid GROUP BY 1)")
    + "SELECT count(*) AS n, round(1 - 6 * sum((rx - ry) * (rx - ry)) / (CAST(count(*) AS DOUBLE) * (CAST(count(*) AS DOUBLE) * count(*) - 1)), 6) AS spearman FROM (SELECT row_number() OVER (ORDER BY funding, sm.pi) rx, row_number() OVER (ORDER BY round(coalesce(rcr_sum, 0) / (CAST(funding AS DOUBLE) / 1e6), 6), sm.pi) ry FROM sm LEFT JOIN im ON sm.pi = im.pi)"
)
def pi_support_spearman(s, d):
    return grants.support_correlation(grants.support_vs_impact(_a(s, d), _p(s, d), standin.metrics(s, d)))


_CITERS = "citers AS (SELECT CAST(p_partkey AS VARCHAR) AS pmid, CAST(p_partkey + 7 * k AS VARCHAR) AS citer FROM part, range(1, 4) t(k) WHERE k <= p_size % 4 AND k <= p_partkey % 4)"
_TRANSLATION = [
    _CITERS,
    f"g AS (SELECT core_project_num c, min(fiscal_year) s, {_MONEY} f, arg_min(project_title, application_id) title FROM awards GROUP BY 1)",
    "l AS (SELECT DISTINCT core_project_num c, pmid FROM publinks)",
    "ap AS (SELECT c, count(*) pubs, round(CAST(sum(CAST(apt AS DECIMAL(18,6))) AS DOUBLE) / count(apt), 3) mean_apt FROM l LEFT JOIN metrics m ON l.pmid = m.pmid GROUP BY 1)",
    "re AS (SELECT c, count(*) reach, min(m.pub_year) fy FROM (SELECT DISTINCT c, citer FROM l JOIN citers x ON l.pmid = x.pmid) y LEFT JOIN metrics m ON y.citer = m.pmid GROUP BY 1)",
    "tr AS (SELECT g.c AS \"grant\", title, s AS start_year, coalesce(pubs, 0) AS pubs, coalesce(reach, 0) AS clinical_reach, mean_apt, CASE WHEN fy >= s THEN fy - s END AS latency_years FROM g LEFT JOIN ap ON g.c = ap.c LEFT JOIN re ON g.c = re.c)",
]
_CORE = "U0101000001"


@query(_with(*_TRANSLATION) + "SELECT * FROM tr")
def translation_scan(s, d):
    return grants.translation(_a(s, d), _p(s, d), standin.metrics(s, d), standin.citers(s, d))


@query(_with(*_TRANSLATION) + f"SELECT tr.*, (SELECT array_to_string((list_sort(list(DISTINCT citer)))[1:8], ',') FROM l JOIN citers x ON l.pmid = x.pmid WHERE c = '{_CORE}') AS example_citers FROM tr WHERE \"grant\" = '{_CORE}'")
def translation_lineage(s, d):
    return grants.translation_lineage(_a(s, d), _p(s, d), standin.metrics(s, d), standin.citers(s, d), _CORE)


@query(
    _with(*_TRANSLATION, f"t2 AS (SELECT {_FAMILY.format('substr(\"grant\", 1, 3)')} AS technology, * FROM tr)")
    + "SELECT technology, count(*) AS grants, max(clinical_reach) AS max_reach, CAST(median(clinical_reach) AS DOUBLE) AS median_reach, round(CAST(sum(CAST(mean_apt AS DECIMAL(18,3))) AS DOUBLE) / count(mean_apt), 6) AS mean_apt FROM t2 GROUP BY 1"
)
def technology_comparison(s, d):
    rows = grants.translation(_a(s, d), _p(s, d), standin.metrics(s, d), standin.citers(s, d)).withColumn("technology", exprs.mechanism_family(F.substring("grant", 1, 3)))
    mean = F.sum(F.col("mean_apt").cast("decimal(18,3)")).cast("double") / F.count("mean_apt")
    return rows.groupBy("technology").agg(F.count("*").alias("grants"), F.max("clinical_reach").alias("max_reach"), F.median("clinical_reach").alias("median_reach"), F.round(mean, 6).alias("mean_apt"))


@query(_with("x AS (SELECT DISTINCT core_project_num, pmid FROM publinks)") + "SELECT core_project_num, count(*) AS pubs, count(*) FILTER (WHERE has_pmc) AS in_pmc, round(CAST(count(*) FILTER (WHERE has_pmc) AS DOUBLE) / count(*), 3) AS pmc_fraction FROM x JOIN metrics m ON x.pmid = m.pmid GROUP BY 1")
def open_science_fraction(s, d):
    return grants.open_science(_p(s, d), standin.metrics(s, d))


@query(_with("x AS (SELECT DISTINCT pmid FROM publinks)") + "SELECT x.pmid, rcr, apt FROM x LEFT JOIN metrics m ON x.pmid = m.pmid ORDER BY coalesce(rcr, 0) DESC, x.pmid LIMIT 10")
def top_publications(s, d):
    return grants.top_publications(_p(s, d), standin.metrics(s, d))


_WORDS = "list_distinct(list_filter(regexp_extract_all(lower(p_name || ' ' || p_brand || ' ' || p_type), '[a-z0-9#]+'), lambda w: w <> ''))"


@query(
    f"""WITH g AS (SELECT p_partkey AS id, {_WORDS} AS w FROM part), z AS (SELECT * FROM g WHERE len(w) >= 3),
e AS (SELECT id, len(w) AS n, unnest(w) AS t FROM z), x AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS k, array_to_string((list_sort(list(a.t)))[1:12], ' ') AS shared_terms FROM e a JOIN e b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2, 3, 4)
SELECT a, b, k AS n_shared, round(CAST(k AS DOUBLE) / (na + nb - k), 6) AS jaccard, shared_terms FROM x WHERE CAST(k AS DOUBLE) / (na + nb - k) >= 0.4 ORDER BY jaccard DESC, a, b LIMIT 25"""
)
def term_jaccard_pairs(s, d):
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")), F.lit("([a-z0-9#]+)"), F.lit(1))
    return grants.similar_grants(_read(s, d, "part").select(F.col("p_partkey").alias("id"), words.alias("words")), 0.4, 3)


@query(_with() + "SELECT * FROM awards WHERE lower(project_title) LIKE '%building%' AND fiscal_year IN (1996, 1997, 1998) AND activity_code IN ('R01', 'U01') ORDER BY fiscal_year DESC, application_id LIMIT 100")
def award_search_filters(s, d):
    return grants.search(_a(s, d), "BUILDING", exprs.parse_years("1998:1996"), activities=["R01", "U01"])


@query(_with() + f"SELECT * FROM awards WHERE core_project_num = '{_CORE}' OR full_project_num = '{_CORE}' ORDER BY fiscal_year DESC, application_id LIMIT 1")
def award_point_lookup(s, d):
    return grants.get(_a(s, d), _CORE)


@query(_with() + f"SELECT pmid, pub_year FROM publinks WHERE core_project_num = '{_CORE}'")
def award_publications(s, d):
    return _p(s, d).where(F.col("core_project_num") == _CORE).select("pmid", "pub_year")


@query(_with() + f"SELECT l.pmid, m.rcr, m.apt FROM publinks l LEFT JOIN metrics m ON l.pmid = m.pmid WHERE core_project_num = '{_CORE}'")
def linked_publication_metrics(s, d):
    links = _p(s, d).where(F.col("core_project_num") == _CORE)
    return links.join(standin.metrics(s, d).select("pmid", "rcr", "apt"), "pmid", "left").select("pmid", "rcr", "apt")


# ---------------------------------------------------------------- scalar functions


@query(_with(_PI) + "SELECT application_id, contact_pi_id, contact_pi_name FROM award_pi")
def contact_pi_parse(s, d):
    return portfolio.with_contact(_a(s, d)).select("application_id", "contact_pi_id", "contact_pi_name")


@query(_with() + f"SELECT application_id, {_FOA} AS foa_type, {_FOA.replace('foa_number', 'upper(trim(foa_number))')} AS foa_type_lenient FROM awards")
def foa_type_scalar(s, d):
    return _a(s, d).select("application_id", exprs.foa_type("foa_number").alias("foa_type"), exprs.foa_type_lenient("foa_number").alias("foa_type_lenient"))


@query(_with() + "SELECT DISTINCT foa_number, 'https://grants.nih.gov/grants/guide/' || CASE WHEN foa_number LIKE 'RFA-%' THEN 'rfa' WHEN foa_number LIKE 'NOT-%' THEN 'notice' ELSE 'pa' END || '-files/' || foa_number || '.html' AS url FROM awards WHERE foa_number IS NOT NULL")
def guide_url(s, d):
    return _a(s, d).where("foa_number IS NOT NULL").select("foa_number", exprs.guide_url("foa_number").alias("url")).distinct()


@query(_with() + f"SELECT activity_code, {_FAMILY.format('activity_code')} AS family, count(*) AS n FROM awards GROUP BY 1, 2")
def mechanism_family_scalar(s, d):
    return _a(s, d).groupBy("activity_code", exprs.mechanism_family("activity_code").alias("family")).agg(F.count("*").alias("n"))


@query(_with() + f"SELECT fiscal_year, CASE WHEN {THIS_YEAR} - fiscal_year < 5 THEN '0-4y' WHEN {THIS_YEAR} - fiscal_year < 10 THEN '5-9y' ELSE '10y+' END AS age, count(*) AS n FROM awards GROUP BY 1, 2")
def age_bucket(s, d):
    return _a(s, d).groupBy("fiscal_year", exprs.age_bucket("fiscal_year", THIS_YEAR).alias("age")).agg(F.count("*").alias("n"))


_IC_NAME = "CASE n_nationkey % 5 WHEN 0 THEN ' nci ' WHEN 1 THEN 'NIAID' WHEN 2 THEN 'niehs' WHEN 3 THEN 'CA' ELSE n_name END"


@query(f"WITH n AS (SELECT n_nationkey, {_IC_NAME} AS name FROM nation) SELECT n_nationkey, CASE upper(trim(name)) WHEN 'NCI' THEN 'CA' WHEN 'NIAID' THEN 'AI' WHEN 'NIEHS' THEN 'ES' ELSE upper(trim(name)) END AS code FROM n")
def ic_code(s, d):
    return _read(s, d, "nation").selectExpr("n_nationkey", f"{_IC_NAME} AS name").select("n_nationkey", exprs.ic_code("name").alias("code"))


@query("SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(' Dr. ' || c_name || ', Jr.'), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS name, 'building ' || CAST(c_custkey AS VARCHAR) AS institution FROM customer")
def normalize_names(s, d):
    institution = F.concat(F.lit("The University of Building #"), F.col("c_custkey").cast("string"), F.lit(", School of Medicine"))
    return _read(s, d, "customer").select("c_custkey", exprs.normalize_name(F.concat(F.lit(" Dr. "), "c_name", F.lit(", Jr."))).alias("name"), exprs.normalize_institution(institution).alias("institution"))


@query("SELECT doc_id, CAST(nullif(regexp_extract(source || ' ' || CAST(1990 + doc_id % 40 AS VARCHAR) || ' Mar', '(\\d{4})', 1), '') AS INT) AS year, CASE WHEN doc_id % 3 = 0 THEN TRUE WHEN doc_id % 3 = 1 THEN FALSE END AS flag, CAST(doc_id // 2 AS BIGINT) AS n, CAST(CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE 0.25 END AS DOUBLE) AS share FROM documents")
def lenient_casts(s, d):
    k = F.col("doc_id")
    return _read(s, d, "documents").select(
        "doc_id",
        exprs.first_year(F.concat_ws(" ", "source", (1990 + k % 40).cast("string"), F.lit("Mar"))).alias("year"),
        exprs.yes_no(F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "No").otherwise("-")).alias("flag"),
        exprs.lenient_int(F.concat((k / 2).cast("string"), F.lit(""))).alias("n"),
        exprs.rate(F.when(k % 2 == 0, "50.0%").otherwise("0.25")).alias("share"),
    )


# ---------------------------------------------------------------- identities

_MENTIONS = "SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 2 = 0 THEN 'Doe, J.' ELSE 'doe j' END || CAST(o_custkey % 50 AS STRING) AS full_name, CASE WHEN o_custkey % 3 = 0 THEN o_custkey END AS profile_id, CASE WHEN o_custkey % 7 = 0 THEN 'ORC-' || CAST(o_custkey AS STRING) END AS orcid, CASE WHEN o_custkey % 5 <> 0 THEN 'Org ' || CAST(o_custkey % 10 AS STRING) END AS institution FROM orders"
_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(
    f"""WITH m AS ({_MENTIONS}), k AS (SELECT *, CASE WHEN orcid IS NOT NULL THEN 'orcid:' || lower(orcid) WHEN profile_id IS NOT NULL THEN 'profile:' || CAST(profile_id AS VARCHAR) WHEN institution IS NOT NULL THEN 'name:' || {_NORM.format('full_name')} || '|inst:' || lower(institution) ELSE 'name:' || {_NORM.format('full_name')} END AS key,
CASE WHEN orcid IS NOT NULL THEN 'orcid' WHEN profile_id IS NOT NULL THEN 'profile_id' WHEN institution IS NOT NULL THEN 'name+institution' ELSE 'name' END AS by_ FROM m),
v AS (SELECT key, string_agg(full_name, '; ' ORDER BY p) AS full_name_variants FROM (SELECT key, full_name, min(pos) p FROM k GROUP BY 1, 2) GROUP BY 1),
i AS (SELECT key, string_agg(institution, '; ' ORDER BY p) AS institution_variants FROM (SELECT key, institution, min(pos) p FROM k WHERE institution IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT k.key, arg_min(full_name, pos) AS display_name, min(by_) AS resolved_by, count(*) AS mention_count, any_value(full_name_variants) AS full_name_variants, any_value(institution_variants) AS institution_variants FROM k LEFT JOIN v ON k.key = v.key LEFT JOIN i ON k.key = i.key GROUP BY 1"""
)
def pi_disambiguation(s, d):
    _read(s, d, "orders").createOrReplaceTempView("orders")
    return graph.resolve_pis(s.sql(_MENTIONS))


@query(
    """WITH m AS (SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 2 = 0 THEN 'Org ' ELSE 'ORG University ' END || CAST(o_custkey % 40 AS VARCHAR) AS name, CASE WHEN o_custkey % 4 = 0 THEN 'ROR' || CAST(o_custkey % 40 AS VARCHAR) END AS ror_id FROM orders),
k AS (SELECT *, CASE WHEN ror_id IS NOT NULL THEN 'ror:' || lower(ror_id) ELSE 'name:' || replace(lower(name), 'university ', '') END AS key, CASE WHEN ror_id IS NOT NULL THEN 'ror' ELSE 'name' END AS by_ FROM m),
v AS (SELECT key, string_agg(name, '; ' ORDER BY p) AS name_variants FROM (SELECT key, name, min(pos) p FROM k GROUP BY 1, 2) GROUP BY 1)
SELECT k.key, arg_min(name, pos) AS display_name, min(by_) AS resolved_by, count(*) AS mention_count, any_value(name_variants) AS name_variants FROM k JOIN v ON k.key = v.key GROUP BY 1"""
)
def institution_disambiguation(s, d):
    k = F.col("o_custkey")
    rows = _read(s, d, "orders").select(F.col("o_orderkey").alias("pos"), F.concat(F.when(F.col("o_orderkey") % 2 == 0, "Org ").otherwise("ORG University "), (k % 40).cast("string")).alias("name"), F.when(k % 4 == 0, F.concat(F.lit("ROR"), (k % 40).cast("string"))).alias("ror_id"))
    return graph.resolve_institutions(rows)


# ---------------------------------------------------------------- graph

_EDGES = """pe AS (SELECT DISTINCT 'AWARD:' || core_project_num AS subject, 'produced' AS predicate, 'PUBLICATION:' || pmid AS object FROM publinks),
ee AS (SELECT 'AWARD:' || core_project_num AS subject, 'has_pi' AS predicate, 'PI:' || unnest(regexp_extract_all(coalesce(pi_ids, ''), '([0-9]+)', 1)) AS object FROM awards
  UNION SELECT 'AWARD:' || core_project_num, 'awarded_to', 'INSTITUTION:' || org_name FROM awards WHERE org_name <> ''
  UNION SELECT 'AWARD:' || core_project_num, 'funded_by', 'IC:' || ic FROM awards WHERE ic <> ''
  UNION SELECT 'AWARD:' || core_project_num, 'under_foa', 'FOA:' || foa_number FROM awards WHERE foa_number <> ''),
ed AS (SELECT *, 'publication_link_table' AS method FROM pe UNION ALL SELECT *, 'project_field' FROM ee),
nd AS (SELECT DISTINCT node_id, split_part(node_id, ':', 1) AS node_type FROM (SELECT subject AS node_id FROM ed UNION SELECT object FROM ed UNION SELECT 'AWARD:' || core_project_num FROM awards)),
an AS (SELECT 'AWARD:' || core_project_num AS node_id, arg_max(project_title, (fiscal_year, application_id)) AS project_title, max(fiscal_year) AS fiscal_year, arg_max(ic, (fiscal_year, application_id)) AS ic, arg_max(activity_code, (fiscal_year, application_id)) AS activity_code, arg_max(total_cost, (fiscal_year, application_id)) AS total_cost FROM awards GROUP BY 1)"""


def _g(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return graph.portfolio_graph(_a(s, d), _p(s, d))


@query(_with(_EDGES) + "SELECT subject, predicate, object, 'award_registry' AS source, 'publication_link_table' AS method, TRUE AS authoritative, CAST(1 AS DOUBLE) AS confidence, 'pmid:' || substr(object, 13) AS evidence_pointer FROM pe")
def edges_award_publication(s, d):
    return graph.publication_edges(_p(s, d))


@query(_with(_EDGES) + "SELECT subject, predicate, object, method FROM ed")
def edges_all(s, d):
    return _g(s, d)[1].select("subject", "predicate", "object", "method")


@query(_with(_EDGES) + "SELECT node_id, 'AWARD' AS node_type, project_title, fiscal_year, ic, activity_code, total_cost FROM an")
def graph_award_nodes(s, d):
    return graph.award_nodes(_a(s, d))


@query(_with(_EDGES) + "SELECT 'node_type' AS kind, node_type AS name, count(*) AS n FROM nd GROUP BY 2 UNION ALL SELECT 'predicate', predicate, count(*) FROM ed GROUP BY 2 UNION ALL SELECT 'source', 'award_registry', count(*) FROM ed UNION ALL SELECT 'authority', 'authoritative', count(*) FROM ed")
def graph_stats(s, d):
    return graph.graph_stats(*_g(s, d))


@query(_with(_EDGES) + f"SELECT object AS node_id, predicate FROM ed WHERE subject = 'AWARD:{_CORE}'")
def graph_neighbors(s, d):
    return graph.neighbors(_g(s, d)[1], f"AWARD:{_CORE}")


@query(_with(_EDGES, "p AS (SELECT unnest(['produced', 'has_pi', 'under_foa', 'funded_trial']) AS predicate)") + "SELECT p.predicate, count(DISTINCT subject) AS numerator, (SELECT count(*) FROM an) AS denominator, round(CAST(count(DISTINCT subject) AS DOUBLE) / (SELECT count(*) FROM an), 6) AS coverage, count(subject) AS authoritative, CAST(0 AS BIGINT) AS inferred FROM p LEFT JOIN (SELECT * FROM ed WHERE subject IN (SELECT node_id FROM an)) ed ON p.predicate = ed.predicate GROUP BY 1")
def coverage_report(s, d):
    return graph.coverage(graph.award_nodes(_a(s, d)), _g(s, d)[1], ["produced", "has_pi", "under_foa", "funded_trial"])


_WHOLE = """ab AS (SELECT DISTINCT 'AWARD:' || core_project_num AS subject, 'about' AS predicate, 'TOPIC_TERM:' || lower(ic) AS object FROM awards UNION SELECT 'AWARD:' || core_project_num, 'about', 'TOPIC_TERM:' || lower(activity_code) FROM awards),
ft AS (SELECT DISTINCT 'AWARD:' || core AS subject, 'funded_trial' AS predicate, 'CLINICAL_TRIAL:' || nct_id AS object FROM reported WHERE core IN (SELECT core_project_num FROM awards)),
wh AS (SELECT *, 'award_registry' AS source FROM ed UNION ALL SELECT *, 'project_field', 'award_registry' FROM ab UNION ALL SELECT *, 'reported_grant_number', 'trial_registry' FROM ft)"""


def _whole(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    terms = _a(s, d).select(F.col("core_project_num").alias("core"), F.explode(F.array("ic", "activity_code")).alias("term")).distinct()
    return graph.portfolio_graph(_a(s, d), _p(s, d), None, standin.reported_trials(s, d), terms)


@query(_with(_EDGES, _WHOLE) + "SELECT subject, predicate, object, source, method FROM wh")
def edges_with_topics_and_trials(s, d):
    return _whole(s, d)[1].select("subject", "predicate", "object", "source", "method")


@query(_with(_EDGES, _WHOLE, "o AS (SELECT * FROM wh WHERE subject IN (SELECT node_id FROM an))") + "SELECT predicate, 'source' AS kind, source AS name, count(*) AS n FROM o GROUP BY 1, 3 UNION ALL SELECT predicate, 'method', method, count(*) FROM o GROUP BY 1, 3")
def coverage_by_source_and_method(s, d):
    return graph.coverage_by(graph.award_nodes(_a(s, d)), _whole(s, d)[1])


@query(_with(_EDGES, _WHOLE, "o AS (SELECT * FROM wh WHERE subject IN (SELECT node_id FROM an))") + "SELECT predicate, count(DISTINCT subject) AS numerator, count(*) AS authoritative, CAST(0 AS BIGINT) AS inferred, (SELECT count(*) FROM an) AS denominator, round(CAST(count(DISTINCT subject) AS DOUBLE) / (SELECT count(*) FROM an), 6) AS coverage FROM o GROUP BY 1")
def coverage_of_all_predicates(s, d):
    return graph.coverage(graph.award_nodes(_a(s, d)), _whole(s, d)[1])


@query(_with(_EDGES, _WHOLE) + f"SELECT subject, predicate, object FROM wh WHERE subject = 'AWARD:{_CORE}'")
def award_graph_edges(s, d):
    terms = _a(s, d).select(F.col("core_project_num").alias("core"), F.explode(F.array("ic", "activity_code")).alias("term")).distinct()
    return graph.award_graph(_a(s, d), _p(s, d), _CORE, standin.reported_trials(s, d), terms)[1].select("subject", "predicate", "object")


@query(_with() + "SELECT 'INSTITUTION:' || org_name AS node_id, 'INSTITUTION' AS node_type, org_name AS name, arg_max(org_state, (fiscal_year, application_id)) AS state FROM awards GROUP BY org_name")
def graph_institution_nodes(s, d):
    rows = graph.attributed(_a(s, d), standin.reported_trials(s, d)).where("node_type = 'INSTITUTION'")
    return rows.select("node_id", "node_type", F.col("attributes.name").alias("name"), F.col("attributes.state").alias("state"))


for _by, _value in (("ic", "ic"), ("mechanism", "activity_code"), ("age", f"CASE WHEN {THIS_YEAR} - fiscal_year < 5 THEN '0-4y' WHEN {THIS_YEAR} - fiscal_year < 10 THEN '5-9y' ELSE '10y+' END")):
    query(_with(_EDGES) + f"SELECT {_value} AS stratum, count(k.subject) AS numerator, count(*) AS denominator, round(CAST(count(k.subject) AS DOUBLE) / count(*), 6) AS coverage FROM an LEFT JOIN (SELECT DISTINCT subject FROM pe) k ON node_id = k.subject GROUP BY 1", f"stratified_coverage_{_by}")(
        lambda s, d, by=_by: graph.stratified_coverage(graph.award_nodes(_a(s, d)), graph.publication_edges(_p(s, d)), "produced", by, THIS_YEAR)
    )


# ---------------------------------------------------------------- texts

#: Whole texts, with a sentence at the end that names a grant, datasets or a topic, as the given texts name none.
_TEXT = "coalesce(text, '') || "
_TRIAL_TEXT = _TEXT + "' U.S. Grant 5' || CASE WHEN doc_id % 4 = 0 THEN 'r 01 dk' ELSE 'R01CA' END || lpad(CAST(doc_id AS STRING), 6, '0') || '-03'"


@query(f"SELECT doc_id, regexp_extract(upper(replace({_TRIAL_TEXT}, ' ', '')), '{exprs.GRANT_NUMBER}', 0) AS grant_number FROM documents")
def grant_numbers_from_text(s, d):
    return _read(s, d, "documents").selectExpr("doc_id", f"{_TRIAL_TEXT} AS t").select("doc_id", exprs.grant_number("t").alias("grant_number"))


_ACCESSION_TEXT = _TEXT + "' Data are deposited as GSE' || CAST(1000 + doc_id AS STRING) || ' and phs' || lpad(CAST(doc_id AS STRING), 6, '0') || '.v1.p1; see GSE' || CAST(1000 + doc_id AS STRING) || ', gene IL10, SRR' || CAST(10000 + doc_id AS STRING)"
_ACCESSION = "|".join(f"(?:{x})" for _, x in exprs.ACCESSIONS)
#: Matches with their places: after the pieces and matches before them.
_MATCHES = f"""t AS (SELECT doc_id, {_ACCESSION_TEXT} AS t FROM documents), s AS (SELECT doc_id, t, regexp_extract_all(t, '{_ACCESSION}') AS ms, string_split_regex(t, '{_ACCESSION}') AS ps FROM t),
u AS (SELECT doc_id, t, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: coalesce(list_sum(list_transform(ps[1:i], lambda p: length(p))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: length(p))), 0))) AS start FROM s),
v AS (SELECT doc_id, {"CASE " + " ".join(f"WHEN regexp_full_match(m, '{x}') THEN '{name}'" for name, x in exprs.ACCESSIONS) + " END"} AS repository, m, CAST(start AS INT) AS start,
  CASE WHEN regexp_matches(lower(substr(t, CAST(greatest(start - 60, 0) + 1 AS BIGINT), CAST(start + length(m) + 60 - greatest(start - 60, 0) AS BIGINT))), '{"|".join(exprs.ACCESSION_CUES)}') THEN CAST(0.97 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS confidence FROM u),
w AS (SELECT doc_id, repository, CASE WHEN repository = 'dbGaP' THEN m ELSE upper(m) END AS accession, start, confidence FROM v),
found AS (SELECT doc_id, repository, accession, arg_min(start, (-confidence, start)) AS start, max(confidence) AS confidence FROM w GROUP BY 1, 2, 3)"""


@query(f"WITH {_MATCHES} SELECT doc_id, accession, repository, start, confidence FROM found")
def accession_mentions(s, d):
    rows = _read(s, d, "documents").selectExpr("doc_id", f"{_ACCESSION_TEXT} AS t").withColumn("m", F.explode(exprs.accessions("t")))
    return rows.select("doc_id", "m.accession", "m.repository", "m.start", "m.confidence")


_TOPIC = _TEXT + "CASE doc_id % 6 WHEN 0 THEN ' Insulin and Coronary risk' WHEN 1 THEN ' adrenal organoid models' WHEN 2 THEN ' Cancer' WHEN 3 THEN ' iPSC QSAR in silico' ELSE ' ' || source END"


def _topics(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "documents").selectExpr("doc_id", f"{_TOPIC} AS topic")


def _any(words: list[str], text: str) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


@query("WITH t AS (SELECT doc_id, " + _TOPIC + " AS topic FROM documents) SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_any(c[2], 'topic')} THEN '{c[0]}' END" for c in topics.CONDITIONS) + "], lambda x: x IS NOT NULL), ',') AS conditions FROM t")
def condition_match(s, d):
    return _topics(s, d).select("doc_id", F.array_join(topics.match_conditions("topic"), ",").alias("conditions"))


_NAMED = f"CASE WHEN doc_id % 6 = 4 THEN ' Stroke ' ELSE {_TOPIC} END"  # a key alone, or a whole text


@query("WITH t AS (SELECT doc_id, " + _NAMED + " AS topic FROM documents) SELECT doc_id, CASE WHEN lower(trim(topic)) IN (" + ", ".join(f"'{c[0]}'" for c in topics.CONDITIONS) + ") THEN lower(trim(topic)) " + " ".join(f"WHEN {_any(c[2], 'topic')} THEN '{c[0]}'" for c in topics.CONDITIONS) + " END AS condition FROM t")
def condition_resolve(s, d):
    return _read(s, d, "documents").selectExpr("doc_id", f"{_NAMED} AS topic").select("doc_id", topics.resolve_condition("topic").alias("condition"))


_NAM = "WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang, " + _TOPIC + " AS topic FROM documents), m AS (" + " UNION ALL ".join(f"SELECT id, lang, '{k}' AS method FROM t WHERE {_any(v, 'topic')}" for k, v in topics.NAM_METHODS.items()) + ")"


@query(_NAM + " SELECT method, count(*) AS grants, array_to_string((list_sort(list(id)))[1:5], ',') AS examples, (SELECT count(*) FROM t) AS grants_scanned, (SELECT count(DISTINCT id) FROM m) AS grants_with_nam FROM m GROUP BY 1")
def nam_method_map(s, d):
    return topics.nam_map(_topics(s, d).withColumn("id", F.col("doc_id").cast("string")), "id", F.col("topic"))


_NAM_AREAS = {"models": "Organoid", "risk": "risk", "silico": "in silico"}


@query(_NAM + ", ar AS (" + " UNION ALL ".join(f"SELECT '{a}' AS area, id FROM t WHERE contains(lower(topic), '{w.lower()}')" for a, w in _NAM_AREAS.items()) + "), c AS (SELECT area, count(*) AS n, count(*) FILTER (WHERE id IN (SELECT id FROM m)) AS k FROM ar GROUP BY 1) SELECT area, n AS grants_scanned, k AS grants_with_nam, CAST(k AS VARCHAR) || '/' || CAST(n AS VARCHAR) || ' grants (' || CAST(CAST(round(100 * k / n) AS BIGINT) AS VARCHAR) || '%) mention a method; no mention means unknown' AS note FROM c")
def nam_areas(s, d):
    return topics.nam_areas(_topics(s, d), "doc_id", F.col("topic"), _NAM_AREAS)


# ---------------------------------------------------------------- pulse, brief, report


@query(_with() + f"SELECT fiscal_year, count(DISTINCT core_project_num) AS grants, CAST({_MONEY} AS DOUBLE) AS funding, count(*) AS records, FALSE AS capped FROM awards WHERE fiscal_year IN (1995, 1996, 1997, 1998, 1999) GROUP BY 1")
def pulse_funding_by_year(s, d):
    return topics.pulse(_a(s, d), YEARS)


@query(_with("c AS (SELECT *, row_number() OVER (PARTITION BY fiscal_year ORDER BY application_id) AS r, count(*) OVER (PARTITION BY fiscal_year) AS records FROM awards WHERE fiscal_year IN (1995, 1996, 1997, 1998, 1999))") + f"SELECT fiscal_year, count(DISTINCT core_project_num) AS grants, CAST({_MONEY} AS DOUBLE) AS funding, any_value(records) AS records, any_value(records) > 100 AS capped FROM c WHERE r <= 100 GROUP BY 1")
def pulse_funding_capped(s, d):
    return topics.pulse(_a(s, d), YEARS, per_year_cap=100)


@query(_with(f"y AS (SELECT ic, fiscal_year, CAST({_MONEY} AS DOUBLE) AS f FROM awards GROUP BY 1, 2)") + "SELECT ic, arg_min(f, fiscal_year) AS first_value, arg_max(f, fiscal_year) AS last_value, round((arg_max(f, fiscal_year) - arg_min(f, fiscal_year)) / arg_min(f, fiscal_year), 6) AS pct_change FROM y GROUP BY 1")
def series_pct_change(s, d):
    series = _a(s, d).groupBy("ic", "fiscal_year").agg(portfolio.cost().cast("double").alias("f"))
    return topics.series_change(series, "ic", "f", "fiscal_year")


_TOP = [
    "once AS (SELECT core_project_num AS g, " + ", ".join(f"arg_min({c}, (fiscal_year, application_id)) AS {c}" for c in ("ic", "activity_code", "org_name", "pi_names", "total_cost")) + " FROM awards GROUP BY 1)",
    "kinds AS (SELECT 'ic' AS kind, ic AS name, total_cost AS cost FROM once UNION ALL SELECT 'mechanism', activity_code, total_cost FROM once UNION ALL SELECT 'institution', org_name, total_cost FROM once UNION ALL SELECT 'pi', unnest(list_transform(string_split(pi_names, ';'), lambda x: trim(replace(x, '(contact)', '')))), total_cost FROM once)",
    "ranked AS (SELECT kind, name, count(*) AS grants, CAST(sum(CAST(cost AS DECIMAL(18,2))) AS DOUBLE) AS funding, CAST(row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, name) AS INT) AS rank FROM kinds WHERE name <> '' GROUP BY 1, 2)",
]


@query(_with(*_TOP) + "SELECT kind, name, grants, funding, rank FROM ranked WHERE rank <= 10")
def brief_top_entities(s, d):
    return topics.top_entities(_a(s, d))


@query(_with() + f"SELECT count(DISTINCT core_project_num) AS grants, count(*) AS award_years, CAST({_MONEY} AS DOUBLE) AS funding FROM awards")
def brief_totals(s, d):
    return topics.brief(_a(s, d), _p(s, d), standin.metrics(s, d))["totals"]


@query(
    _with(*_TOP, "h AS (SELECT string_agg(name, ',' ORDER BY name) AS hit FROM ranked WHERE kind = 'ic' AND rank <= 10 AND name IN ('BUILDING', 'NONE'))", "n AS (SELECT count(DISTINCT core_project_num) AS n FROM awards)", "r AS (SELECT count(DISTINCT nct_id) AS n FROM reported WHERE core IN (SELECT core_project_num FROM awards))", "dr AS (SELECT count(*) AS n FROM part WHERE contains(lower(p_type), 'ischemic stroke'))")
    + """SELECT 'min_awards' AS "check", n >= 40 AS passed, CAST(n AS VARCHAR) || ' awards (expected >= 40)' AS detail FROM n UNION ALL SELECT 'ics_any', coalesce(hit, '') <> '', 'top institutes among those expected: ' || coalesce(hit, '') FROM h
UNION ALL SELECT 'condition', TRUE, 'condition Stroke (expected Stroke)' UNION ALL SELECT 'trials', n > 0, CAST(n AS VARCHAR) || ' linked trials' FROM r UNION ALL SELECT 'drugs', n > 0, CAST(n AS VARCHAR) || ' approved drugs' FROM dr"""
)
def benchmark_checks(s, d):
    return topics.checks(_a(s, d), topics.Expect(40, ["BUILDING", "NONE"], "stroke", True, True), topic="Cerebrovascular care", trials=standin.reported_trials(s, d), labels=_labels(s, d))


_ABSTRACT = "'Counts are deposited under GSE' || CAST(1000 + c_custkey AS STRING) || '; reads: SRP' || CAST(20000 + c_custkey % 7 AS STRING)"
_ABSTRACTS = f"abstracts AS (SELECT {standin.RENUMBERED} AS core_project_num, {_ABSTRACT} AS text, CAST(1000 + c_custkey AS VARCHAR) AS gse, CAST(20000 + c_custkey % 7 AS VARCHAR) AS srp FROM customer)"


def _abstracts(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "customer").selectExpr(f"{standin.RENUMBERED} AS core_project_num", f"{_ABSTRACT} AS text")


_SAMPLED = [_ABSTRACTS, "sample AS (SELECT core_project_num AS core, max(total_cost) AS cost FROM awards GROUP BY 1 ORDER BY cost DESC, core LIMIT 12)", "sl AS (SELECT DISTINCT core_project_num AS core, pmid FROM publinks WHERE core_project_num IN (SELECT core FROM sample))"]


def _brief(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return topics.brief(_a(s, d), _p(s, d), standin.metrics(s, d), standin.reported_trials(s, d), _abstracts(s, d), _deaths(s, d), _labels(s, d), "Stroke in BUILDING")


@query(_with(*_SAMPLED) + "SELECT (SELECT count(*) FROM sample) AS sampled, (SELECT count(DISTINCT core) FROM sl) AS with_publication, (SELECT count(DISTINCT core) FROM reported WHERE core IN (SELECT core FROM sample)) AS with_trial, (SELECT count(DISTINCT core_project_num) FROM abstracts WHERE core_project_num IN (SELECT core FROM sample)) AS with_dataset, (SELECT count(*) FROM sl) AS publications")
def brief_sample_coverage(s, d):
    return _brief(s, d)["sample_coverage"]


@query(_with(*_SAMPLED) + "SELECT nct_id, min(title) AS title FROM reported WHERE core IN (SELECT core FROM sample) GROUP BY 1 ORDER BY 1 LIMIT 10")
def brief_trials(s, d):
    return _brief(s, d)["trials"]


@query(_with(*_SAMPLED) + "SELECT DISTINCT dataset FROM (SELECT unnest(['GEO:GSE' || gse, 'SRA:SRP' || srp]) AS dataset FROM abstracts WHERE core_project_num IN (SELECT core FROM sample)) ORDER BY 1 LIMIT 15")
def brief_datasets(s, d):
    return _brief(s, d)["datasets"]


@query(_with(*_SAMPLED) + "SELECT x.pmid, rcr, apt FROM (SELECT DISTINCT pmid FROM sl) x LEFT JOIN metrics m ON x.pmid = m.pmid ORDER BY coalesce(rcr, 0) DESC, x.pmid LIMIT 10")
def brief_publications(s, d):
    return _brief(s, d)["publications"]


@query("SELECT 'Stroke' AS condition, CAST(NULL AS DOUBLE) AS first_value, CAST(NULL AS DOUBLE) AS last_value, CAST(NULL AS DOUBLE) AS pct_change, (SELECT count(*) FROM part WHERE contains(lower(p_type), 'ischemic stroke')) AS approved_drugs")
def brief_outcome(s, d):
    return _brief(s, d)["outcome"]


@query(_with(_ABSTRACTS, "u AS (SELECT core_project_num AS c, count(DISTINCT pmid) AS publications FROM publinks GROUP BY 1)", "f AS (SELECT core_project_num AS c, round(CAST(count(*) FILTER (WHERE has_pmc) AS DOUBLE) / count(*), 3) AS pmc_fraction FROM (SELECT DISTINCT core_project_num, pmid FROM publinks) x JOIN metrics m ON x.pmid = m.pmid GROUP BY 1)")
    + "SELECT a.core_project_num, 'GEO:GSE' || gse || ';SRA:SRP' || srp AS dataset_accessions, coalesce(publications, 0) AS publications, pmc_fraction, a.core_project_num IN (SELECT core FROM reported) AS has_registered_trial FROM abstracts a LEFT JOIN u ON a.core_project_num = u.c LEFT JOIN f ON a.core_project_num = f.c")
def open_science_signals(s, d):
    return grants.open_science_signals(_abstracts(s, d), _p(s, d), standin.metrics(s, d), standin.reported_trials(s, d))


_TERMS = "lower(project_title || ' ' || ic_name || ' ' || activity_code || ' ' || org_state || CASE WHEN fiscal_year % 2 = 1 THEN ' ' || org_name ELSE '' END)"
_REDUNDANT = [
    f"x AS (SELECT core_project_num AS g, application_id AS i, project_title AS title, list_sort(list_distinct(string_split({_TERMS}, ' '))) AS w, regexp_extract_all(coalesce(pi_ids, ''), '([0-9]+)', 1) AS pis FROM awards)",
    "y AS (SELECT g, min(i) AS seen, arg_min(w, (-len(w), i)) AS w, arg_min(title, (-len(w), i)) AS title, arg_min(i, (-len(w), i)) AS at FROM x GROUP BY 1)",
    "z AS (SELECT * FROM y WHERE len(w) >= 8 ORDER BY seen LIMIT 80)",
    "k AS (SELECT z.g, list_distinct(flatten(list(x.pis))) AS pis FROM z JOIN x ON z.g = x.g AND x.i >= z.at GROUP BY 1)",
    "pr AS (SELECT a.g AS a, b.g AS b, a.title AS title_a, b.title AS title_b, list_intersect(a.w, b.w) AS s, len(a.w) + len(b.w) AS n, list_has_any(p.pis, q.pis) AS same_pi FROM z a JOIN z b ON a.g < b.g JOIN k p ON a.g = p.g JOIN k q ON b.g = q.g)",
    "pj AS (SELECT *, CAST(len(s) AS DOUBLE) / (n - len(s)) AS j FROM pr WHERE CAST(len(s) AS DOUBLE) / (n - len(s)) >= 0.4)",
]


def _with_terms(s: SparkSession, d: str) -> DataFrame:
    return _a(s, d).withColumn("terms", F.split(F.expr(_TERMS), " "))


@query(_with(*_REDUNDANT) + "SELECT a, b, title_a, title_b, round(j, 3) AS jaccard, array_to_string(list_sort(s)[1:12], ' ') AS shared_terms, same_pi FROM pj ORDER BY jaccard DESC, a, b LIMIT 25")
def redundancy_pairs(s, d):
    return grants.redundancy(_with_terms(s, d))["pairs"]


@query(_with(*_REDUNDANT) + "SELECT (SELECT count(*) FROM z) AS grants_analyzed, count(*) AS n_pairs, count(*) FILTER (WHERE NOT same_pi) AS cross_pi FROM pj")
def redundancy_totals(s, d):
    return grants.redundancy(_with_terms(s, d))["totals"]


@query(_with() + f"SELECT fiscal_year, CAST({_MONEY} AS DOUBLE) AS funding, count(DISTINCT core_project_num) AS grants FROM awards WHERE total_cost > 0 AND ic = '{IC}' AND fiscal_year IN ({', '.join(map(str, YEARS))}) GROUP BY 1")
def portfolio_report_trend(s, d):
    return topics.report(_a(s, d), _p(s, d), IC, YEARS)["trend"]


def _report(s: SparkSession, d: str) -> dict[str, DataFrame]:
    trials = _read(s, d, "events").selectExpr("CASE WHEN event_type = 'click' THEN 'After Stroke' ELSE event_type END AS condition", "value > 50 AS has_results")
    return topics.report(_a(s, d), _p(s, d), IC, YEARS, "stroke", standin.metrics(s, d), trials, _labels(s, d).withColumn("indication", F.replace("indication", F.lit("PROMO"), F.lit("Ischemic stroke"))), _deaths(s, d).withColumn("cause_name", F.when(F.col("cause_name") == IC, "Stroke").otherwise(F.col("cause_name"))))


@query(_with(f"c AS (SELECT DISTINCT pmid FROM publinks WHERE core_project_num IN (SELECT core_project_num FROM awards WHERE total_cost > 0 AND ic = '{IC}' AND fiscal_year IN ({', '.join(map(str, YEARS))})) ORDER BY 1 LIMIT 250)") + "SELECT count(*) AS sampled, count(rcr) AS rated, round(median(rcr), 6) AS median_rcr FROM c LEFT JOIN metrics m ON c.pmid = m.pmid")
def portfolio_report_citation(s, d):
    return _report(s, d)["citation"]


@query(
    _with(f"y AS (SELECT fiscal_year AS year, round(CAST({_MONEY} AS DOUBLE) / 1e6, 4) AS aadr FROM awards WHERE ic = '{IC}' AND fiscal_year IN ({', '.join(map(str, YEARS))}) GROUP BY 1)")
    + f"SELECT (SELECT count(*) FROM events WHERE event_type = 'click') AS trials, (SELECT count(*) FROM events WHERE event_type = 'click' AND value > 50) AS trials_with_results, (SELECT count(*) FROM part WHERE contains(p_type, 'PROMO')) AS approved_drugs, arg_min(aadr, year) AS first_value, arg_max(aadr, year) AS last_value, round((arg_max(aadr, year) - arg_min(aadr, year)) / arg_min(aadr, year), 6) AS pct_change, '{topics.CONDITION_CAVEAT}' AS caveat FROM y"
)
def portfolio_report_outcome(s, d):
    return _report(s, d)["outcome"]


@query()
def rfa_regression(s, d):
    return portfolio.regression(portfolio.grant_panel(_a(s, d), _p(s, d)))


# ---------------------------------------------------------------- sources

_AWARD_JSON = """to_json(named_struct('appl_id', application_id, 'project_num', full_project_num, 'core_project_num', core_project_num, 'project_title', project_title, 'fiscal_year', fiscal_year, 'agency_ic_admin', named_struct('abbreviation', ic, 'name', ic_name), 'activity_code', activity_code, 'organization', named_struct('org_name', org_name, 'org_state', org_state), 'award_amount', total_cost, 'terms', concat('<', lower(ic), '><', activity_code, '>'), 'opportunity_number', foa_number))"""


@query(_with() + "SELECT application_id, full_project_num AS project_number, core_project_num, project_title, fiscal_year, ic, activity_code, total_cost, org_name, org_state, foa_number, lower(ic) || ';' || activity_code AS terms FROM awards")
def json_normalize_award(s, d):
    rows = records.awards_from_json(_a(s, d).selectExpr(f"{_AWARD_JSON} AS json"), "json")
    return rows.select("application_id", "project_number", "core_project_num", "project_title", "fiscal_year", "ic", "activity_code", "total_cost", F.col("organization.name").alias("org_name"), F.col("organization.state").alias("org_state"), "foa_number", F.array_join("terms", ";").alias("terms"))


@query(_with() + "SELECT pmid, pub_year AS year, rcr, has_pmc AS is_clinical FROM metrics")
def json_normalize_metrics(s, d):
    made = F.to_json(F.struct(F.col("pmid").cast("long").alias("pmid"), F.col("pub_year").alias("year"), F.col("rcr").alias("relative_citation_ratio"), F.when(F.col("has_pmc"), "Yes").otherwise("No").alias("is_clinical")))
    return records.metrics_from_json(standin.metrics(s, d).select(made.alias("json")), "json").select("pmid", "year", "rcr", "is_clinical")


@query("SELECT 'NCT' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS nct_id, event_type AS title, 'PHASE1/PHASE2' AS phase, 'DRUG: ' || event_type AS interventions, 'R01CA' || lpad(CAST(event_id % 1000 AS VARCHAR), 6, '0') AS grants FROM events")
def json_normalize_trial(s, d):
    e = _read(s, d, "events")
    number = F.concat(F.lit("5R01 CA"), F.lpad((F.col("event_id") % 1000).cast("string"), 6, "0"), F.lit("-02"))
    ident = F.struct(F.concat(F.lit("NCT"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("nctId"), F.col("event_type").alias("briefTitle"), F.array(F.struct(F.lit("NIH").alias("type"), number.alias("id"))).alias("secondaryIdInfos"))
    design = F.struct(F.array(F.lit("PHASE1"), F.lit("PHASE2")).alias("phases"))
    arms = F.struct(F.array(F.struct(F.lit("DRUG").alias("type"), F.col("event_type").alias("name"))).alias("interventions"))
    made = F.to_json(F.struct(F.struct(ident.alias("identificationModule"), design.alias("designModule"), arms.alias("armsInterventionsModule")).alias("protocolSection")))
    return records.trials_from_json(e.select(made.alias("json")), "json").select("nct_id", "title", "phase", F.array_join("interventions", ";").alias("interventions"), F.array_join("grants", ";").alias("grants"))


@query("SELECT CAST(year(o_orderdate) AS INT) AS fiscal_year, CAST(count(*) AS BIGINT) AS reviewed, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS awarded, round(CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) / count(*), 4) AS rate FROM orders GROUP BY 1")
def success_rate_clean(s, d):
    o = _read(s, d, "orders").groupBy(F.year("o_orderdate").cast("string").alias("fy")).agg(F.count("*").cast("string").alias("reviewed"), F.count_if(F.col("o_orderstatus") == "F").cast("string").alias("awarded"))
    raw = o.withColumn("rate", F.concat(F.round(100 * F.col("awarded").cast("double") / F.col("reviewed").cast("double"), 4).cast("string"), F.lit("%"))).union(s.sql("SELECT 'a footnote', NULL, NULL, NULL"))
    return records.success_rates(raw).withColumn("rate", F.round("rate", 4))


# ---------------------------------------------------------------- registries


def _trials(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "events").select(F.concat(F.lit("NCT"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("nct_id"), F.col("event_type").alias("condition"), F.col("props").alias("detail"), (F.col("value") > 50).alias("has_results"), F.array(F.concat(F.lit("R01CA"), F.lpad((F.col("event_id") % 1000).cast("string"), 6, "0"))).alias("grants"))


_TRIALS = "trials AS (SELECT 'NCT' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS nct_id, event_type AS condition, props AS detail, value > 50 AS has_results, 'R01CA' || lpad(CAST(event_id % 1000 AS VARCHAR), 6, '0') AS number FROM events)"
_LABELS = "labels_ AS (SELECT p_partkey AS label_id, p_name AS brand, p_type AS indication FROM part)"
_DEATHS = "deaths AS (SELECT c_mktsegment AS cause_name, CAST(year(o_orderdate) AS INT) AS year, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1e6, 4) AS aadr FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
_AREAS = "areas AS (SELECT c_mktsegment AS measure, 'S' || CAST(c_nationkey AS VARCHAR) AS state, 2001 AS year, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END AS value FROM customer)"


def _labels(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "part").selectExpr("p_partkey AS label_id", "p_name AS brand", "p_type AS indication")


def _deaths(s: SparkSession, d: str) -> DataFrame:
    return _a(s, d).groupBy(F.col("ic").alias("cause_name"), F.col("fiscal_year").alias("year")).agg(F.round(portfolio.cost().cast("double") / 1e6, 4).alias("aadr"))


def _areas(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "customer").selectExpr("c_mktsegment AS measure", "'S' || CAST(c_nationkey AS STRING) AS state", "2001 AS year", "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END AS value")


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'the ') AND contains(lower(lang), 'en') ORDER BY doc_id LIMIT 20")
def article_search(s, d):
    return lookup.search(_read(s, d, "documents"), "doc_id", 20, text="The ", lang="EN").select("doc_id", "lang")


@query("SELECT count(*) AS total FROM documents WHERE contains(lower(text), 'the ')")
def article_count(s, d):
    return lookup.count(_read(s, d, "documents"), text="the ")


_IDS = [5, 3, 999_999_999, 8, 1]


@query(f"SELECT CAST(i - 1 AS INT) AS pos, pmid, rcr FROM (SELECT CAST(unnest({_IDS}) AS VARCHAR) AS k, generate_subscripts({_IDS}, 1) AS i) JOIN (SELECT {', '.join(f'{e} AS {c}' for c, e in standin.METRICS.items())} FROM part) m ON k = pmid ORDER BY pos")
def metrics_in_order(s, d):
    ids = s.createDataFrame([(i, str(k)) for i, k in enumerate(_IDS)], "pos int, id string")
    return lookup.in_order(ids, standin.metrics(s, d).select("pmid", "rcr"), "pmid").select("pos", "pmid", "rcr")


@query(f"WITH {_TRIALS} SELECT nct_id, condition FROM trials WHERE contains(lower(condition), 'click') ORDER BY nct_id LIMIT 50")
def trial_search(s, d):
    return lookup.search(_trials(s, d), "nct_id", 50, condition="click").select("nct_id", "condition")


@query(f"WITH {_TRIALS} SELECT count(*) AS total FROM trials WHERE contains(lower(condition), 'click')")
def trial_count(s, d):
    return lookup.count(_trials(s, d), condition="click")


@query(f"WITH {_TRIALS} SELECT nct_id, condition FROM trials WHERE number = 'R01CA000007'")
def trials_of_grant(s, d):
    return graph.trials_of_grant(_trials(s, d), "r01ca000007").select("nct_id", "condition")


@query(f"WITH {_TRIALS} SELECT 'AWARD:' || number AS subject, 'funded_trial' AS predicate, 'CLINICAL_TRIAL:' || nct_id AS object, TRUE AS authoritative FROM trials")
def edges_award_trial(s, d):
    return graph.trial_edges(_trials(s, d)).select("subject", "predicate", "object", "authoritative")


@query(f"WITH {_MATCHES} SELECT 'PUBLICATION:' || CAST(doc_id AS VARCHAR) AS subject, 'DATASET:' || repository || ':' || accession AS object, FALSE AS authoritative FROM found WHERE repository = 'GEO'")
def edges_publication_dataset(s, d):
    rows = _read(s, d, "documents").selectExpr("CAST(doc_id AS STRING) AS pmid", f"{_ACCESSION_TEXT} AS text")
    return graph.dataset_edges(rows).where(F.startswith("object", F.lit("DATASET:GEO:"))).select("subject", "object", "authoritative")


@query(f"WITH {_LABELS} SELECT label_id, indication, (SELECT count(*) FROM labels_ WHERE contains(lower(indication), 'promo')) AS total FROM labels_ WHERE contains(lower(indication), 'promo') ORDER BY label_id LIMIT 20")
def labels_for_indication(s, d):
    return lookup.labels_for_indication(_labels(s, d), "Promo", "label_id").select("label_id", "indication", "total")


@query(f"WITH {_AREAS} SELECT count(value) AS areas, round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(value), 4) AS mean_prevalence FROM areas WHERE measure = 'BUILDING' AND state = 'S3'")
def prevalence_mean(s, d):
    return lookup.prevalence_mean(_areas(s, d), IC, "S3")


@query("SELECT p_brand AS assay, count(*) AS records, (SELECT count(*) FROM part) AS n_records, (SELECT count(DISTINCT p_brand) FROM part) AS n_assays FROM part GROUP BY 1 ORDER BY records DESC, assay LIMIT 10")
def chemical_assay_summary(s, d):
    return records.assay_summary(_read(s, d, "part").select(F.col("p_brand").alias("assay")))


@query(
    """WITH n AS (SELECT DISTINCT 'RFA-' || CAST(c_custkey AS VARCHAR) AS foa_number, c_custkey AS k FROM customer), h AS (SELECT foa_number, k, CASE WHEN k % 3 = 0 THEN 'exact' WHEN k % 3 = 1 THEN 'first' END AS title FROM n)
SELECT foa_number, 'RFA' AS type, title, title IS NULL AS derived FROM h"""
)
def foa_resolve(s, d):
    k = F.col("c_custkey")
    numbers = _read(s, d, "customer").select(F.concat(F.lit("RFA-"), k.cast("string")).alias("foa_number"), k.alias("k"))
    hits = numbers.where("k % 3 < 2").select("foa_number", F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit("other").alias("number"), F.lit("first").alias("title")), F.struct(F.lit(1).alias("pos"), F.when(F.col("k") % 3 == 0, F.lower("foa_number")).otherwise("x").alias("number"), F.when(F.col("k") % 3 == 0, "exact").otherwise("second").alias("title")))).alias("h"))
    hits = hits.select("foa_number", "h.*", F.lit("A").alias("agency"), F.lit("posted").alias("status"))
    return records.resolve_foa(numbers.select("foa_number"), hits).select("foa_number", "type", "title", "derived")


@query(
    _with(_TRIALS, _LABELS, _DEATHS, _AREAS)
    + f"""SELECT (SELECT count(DISTINCT core_project_num) FROM awards WHERE contains(lower(project_title), 'building') AND fiscal_year IN (1995, 1996, 1997, 1998, 1999)) AS grants,
(SELECT CAST({_MONEY} AS DOUBLE) FROM awards WHERE contains(lower(project_title), 'building') AND fiscal_year IN (1995, 1996, 1997, 1998, 1999)) AS funding,
(SELECT count(*) FROM awards WHERE contains(lower(project_title), 'building') AND fiscal_year IN (1995, 1996, 1997, 1998, 1999)) AS award_years,
(SELECT count(*) FROM trials WHERE contains(lower(condition), 'click')) AS trials, (SELECT count(*) FROM trials WHERE contains(lower(condition), 'click') AND has_results) AS trials_with_results, (SELECT count(*) FROM labels_ WHERE contains(lower(indication), 'promo')) AS labels,
(SELECT round((arg_max(aadr, year) - arg_min(aadr, year)) / arg_min(aadr, year), 6) FROM deaths WHERE cause_name = 'BUILDING') AS mortality_change,
(SELECT count(value) FROM areas WHERE measure = 'BUILDING') AS areas, (SELECT round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(value), 4) FROM areas WHERE measure = 'BUILDING') AS mean_prevalence"""
)
def condition_pulse(s, d):
    return lookup.condition_pulse(_a(s, d), _trials(s, d), _labels(s, d), _deaths(s, d), _areas(s, d), ["building"], "click", "promo", IC, IC, YEARS)


def _meta(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return topics.meta_brief(_a(s, d), _p(s, d), standin.metrics(s, d), standin.citers(s, d), trials=standin.reported_trials(s, d))


@query(
    _with("best AS (SELECT core_project_num AS c FROM awards GROUP BY 1 ORDER BY " + _MONEY + " DESC, 1 LIMIT 8)", "f AS (SELECT core_project_num AS c, round(CAST(count(*) FILTER (WHERE has_pmc) AS DOUBLE) / count(*), 3) AS pmc_fraction FROM (SELECT DISTINCT core_project_num, pmid FROM publinks) x JOIN metrics m ON x.pmid = m.pmid WHERE core_project_num IN (SELECT c FROM best) GROUP BY 1)", *[x.replace(_TERMS, "regexp_replace(lower(project_title), '[^a-z0-9]+', ' ', 'g')").replace(">= 8", ">= 4") for x in _REDUNDANT])
    + f"SELECT (SELECT count(DISTINCT core_project_num) FROM awards) AS grants, (SELECT CAST({_MONEY} AS DOUBLE) FROM awards) AS funding, (SELECT count(*) FROM best) AS sampled, (SELECT round(CAST(sum(CAST(pmc_fraction AS DECIMAL(18,3))) AS DOUBLE) / count(*), 3) FROM f) AS pmc_fraction, (SELECT count(*) FROM best WHERE c IN (SELECT core FROM reported)) AS grants_with_trial, (SELECT count(*) FROM pj WHERE NOT same_pi) AS cross_pi"
)
def meta_brief_summary(s, d):
    return _meta(s, d)["summary"]


@query(_with(*_TRANSLATION, "best AS (SELECT c FROM g ORDER BY f DESC, c LIMIT 8)") + 'SELECT tr.* FROM tr JOIN best ON "grant" = best.c')
def meta_brief_translation(s, d):
    return _meta(s, d)["translation"]


@query(_with("x AS (SELECT DISTINCT core_project_num, pmid FROM publinks)") + "SELECT count(DISTINCT core_project_num) AS grants, count(*) AS pubs, count(*) FILTER (WHERE has_pmc) AS in_pmc FROM x JOIN metrics m ON x.pmid = m.pmid")
def meta_brief_open_science(s, d):
    return _meta(s, d)["open_science"]


@query(_with(_EDGES.replace("pe AS", "pe AS", 1)) + "SELECT split_part(object, ':', 1) AS node_type, count(DISTINCT object) AS n FROM ee GROUP BY 1")
def award_entities(s, d):
    return graph.entity_edges(_a(s, d)).groupBy(exprs.split_node("object")[0].alias("node_type")).agg(F.count_distinct("object").alias("n"))
