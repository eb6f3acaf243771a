import pytest
from pyspark.sql import functions as F

from grantlens.operators import grants, graph, portfolio, topics

AWARD = "application_id long, core_project_num string, full_project_num string, activity_code string, ic string, fiscal_year int, foa_number string, pi_ids string, pi_names string, project_title string, org_name string, total_cost double"


def award(i, core, fy, cost, pi="1", activity="R01", ic="CA", foa=None, title="t"):
    return (i, core, f"5{core}-01", activity, ic, fy, foa, pi, "A, B", title, "Org", cost)


@pytest.fixture(scope="module")
def awards(spark):
    rows = [award(1, "A", 2000, 1e6, "1"), award(2, "A", 2001, 1e6, "1"), award(3, "B", 2005, 1e6, "2 (contact); 3"), award(4, "C", 2010, 1e6, "4"), award(5, "D", 2010, 1e6, ""), award(6, "E", 2011, 0.0, "5"), award(7, None, 2011, 1e6, None)]
    return spark.createDataFrame(rows, AWARD)


@pytest.fixture(scope="module")
def links(spark):
    return spark.createDataFrame([("p1", "A", 2003), ("p2", "A", 2004), ("p2", "A", 2005), ("p3", "B", 2004)], "pmid string, core_project_num string, pub_year int")


def test_concentration_leaves_blank_contacts_out(awards):
    row = portfolio.funding_concentration(awards).first()
    assert (row.n_pis, row.total_funding) == (3, 4e6)


def test_links_do_not_multiply_costs(awards, links):
    bins = portfolio.output_by_pi(awards, links)
    assert bins.agg(F.sum("funding")).first()[0] == 4_000_000
    assert {r.contact_pi_id: r.pubs for r in bins.collect()} == {"1": 2, "2": 1, "4": 0}
    assert portfolio.funding_output_correlation(awards, links).first().too_few


def test_latency_censors(awards, links):
    rows = {r.core_project_num: r.latency for r in portfolio.output_latency(awards, links).collect()}
    assert rows["A"] == 3 and rows["B"] is None and rows["C"] is None  # B's first link is before its start
    s = portfolio.latency_summary(awards, links).first()
    assert (s.n_grants, s.n_with_output, s.n_censored, s.p50_years) == (5, 1, 4, 3)


def test_years_choose_award_years_first(awards, links):
    rows = {r.core_project_num: r.start_year for r in portfolio.output_latency(awards, links, years=[2001]).collect()}
    assert rows == {"A": 2001}


def test_pubs_per_dollar_counts_links_and_tells_caps(awards, links):
    rows = grants.pubs_per_dollar(awards.where("core_project_num IS NOT NULL"), links, max_grants=1).collect()
    assert [(r.grant, r.links, r.eligible, r.capped) for r in rows] == [("A", 3, 4, True)]


def test_every_investigator_gets_the_full_cost(awards):
    rows = {r.pi: float(r.funding) for r in grants.pi_support(awards).collect()}
    assert rows["2"] == rows["3"] == 1e6 and rows["1"] == 2e6
    assert "3" not in {r.pi for r in grants.pi_support(awards, first_only=True).collect()}


def test_translation(spark):
    a = spark.createDataFrame([award(1, "G", 2012, 1e6)], AWARD)
    l = spark.createDataFrame([("p1", "G", 2013), ("p2", "G", 2014)], "pmid string, core_project_num string, pub_year int")
    m = spark.createDataFrame([("p1", 2013, 0.3), ("p2", 2014, 0.1), ("c1", 2018, None), ("c2", 2020, None)], "pmid string, pub_year int, apt double")
    c = spark.createDataFrame([("p1", "c1"), ("p2", "c1"), ("p2", "c2")], "pmid string, citer string")
    row = grants.translation_lineage(a, l, m, c, "G").first()
    assert (row.pubs, row.clinical_reach, row.mean_apt, row.latency_years, row.example_citers) == (2, 2, 0.2, 6, "c1,c2")


def test_similar_grants_equals_brute_force(spark):
    import random

    rnd = random.Random(3)
    sets = {i: sorted(rnd.sample(range(30), rnd.randint(6, 14))) for i in range(60)}
    df = spark.createDataFrame([(i, [str(w) for w in s] * 2) for i, s in sets.items()], "id long, words array<string>")
    got = {(r.a, r.b): r.jaccard for r in grants.similar_grants(df, 0.4, 8, top=None).collect()}
    want = {}
    for i in sets:
        for j in sets:
            if i < j and min(len(sets[i]), len(sets[j])) >= 8:
                k = len(set(sets[i]) & set(sets[j]))
                if k / (len(sets[i]) + len(sets[j]) - k) >= 0.4:
                    want[i, j] = pytest.approx(k / (len(sets[i]) + len(sets[j]) - k), abs=1e-6)
    assert got == want


def test_search_needs_a_filter(awards):
    with pytest.raises(ValueError, match="filter"):
        grants.search(awards)
    assert grants.search(awards, pi_ids=["3"]).count() == 1


def test_edges_collapse_and_coverage(spark, awards, links):
    nodes, edges = graph.portfolio_graph(awards.where("core_project_num IS NOT NULL"), links)
    assert edges.groupBy("subject", "predicate", "object").count().where("count > 1").count() == 0
    rows = {r.predicate: r for r in graph.coverage(graph.award_nodes(awards.where("core_project_num IS NOT NULL")), edges, ["produced", "funded_trial"]).collect()}
    assert (rows["produced"].numerator, rows["produced"].denominator) == (2, 5) and rows["funded_trial"].numerator == 0
    last = graph.collapse(spark.createDataFrame([("s", "p", "o", 1, "a"), ("s", "p", "o", 2, "b")], "subject string, predicate string, object string, at int, method string"), "at")
    assert last.first().method == "b"


def test_trials_and_datasets(spark):
    trials = spark.createDataFrame([("N1", ["R01CA000001"]), ("N2", [])], "nct_id string, grants array<string>")
    assert graph.trial_edges(trials).count() == 1 and graph.trials_of_grant(trials, "r01ca000001").count() == 1
    edges = graph.dataset_edges(spark.createDataFrame([("1", "deposited as GSE1234"), ("2", None)], "pmid string, text string")).collect()
    assert [(e.object, e.authoritative, e.confidence) for e in edges] == [("DATASET:GEO:GSE1234", False, 0.97)]


def test_identities_never_merge_unequal_ids(spark):
    rows = [(1, "Doe, J", 1, None, "X"), (2, "Doe, J.", 1, None, "Y"), (3, "Doe, J", 2, None, "X"), (4, "Doe J", None, None, "Univ X"), (5, "doe j", None, None, "X"), (6, "Z", None, " O1", None), (7, "Y", None, "o1", "Q")]
    got = {r.key: r for r in graph.resolve_pis(spark.createDataFrame(rows, "pos long, full_name string, profile_id long, orcid string, institution string")).collect()}
    assert set(got) == {"profile:1", "profile:2", "name:doe j|inst:x", "orcid:o1"}
    assert got["profile:1"].full_name_variants == "Doe, J; Doe, J." and got["profile:1"].institution_variants == "X; Y" and got["orcid:o1"].mention_count == 2


def test_topics(spark):
    df = spark.createDataFrame([("Insulin and coronary risk",), ("cancer",), ("nothing",), (None,)], "t string")
    rows = df.select(topics.match_conditions("t").alias("m"), topics.resolve_condition("t").alias("r")).collect()
    assert rows[0].m == ["heart_disease", "diabetes"] and rows[0].r == "heart_disease" and rows[1].r == "cancer" and rows[2].r is None and rows[3].m == []
    assert topics.conditions(spark).count() == 10


def test_investigators_without_number_have_their_name(spark):
    a = spark.createDataFrame([award(1, "A", 2000, 1.0, "12 (contact); ; 7"), award(2, "B", 2000, 1.0, None)], AWARD).withColumn("pi_names", F.when(F.col("application_id") == 1, "DOE, J (contact);ROE, R;"))
    edges = graph.entity_edges(a).where("predicate = 'has_pi'").collect()
    assert sorted(e.object for e in edges) == ["PI:12", "PI:7", "PI:ROE, R"]
    names = {r.node_id: r.attributes for r in graph.attributed(a).collect()}
    assert names["PI:12"] == {"name": "DOE, J"} and names["PI:7"] == {} and names["AWARD:B"]["title"] == "t"


def test_redundancy(spark):
    words = [f"w{k}" for k in range(10)]
    rows = [(award(1, "A", 2000, 1.0, "1"), words), (award(2, "A", 2001, 1.0, "9"), words[:3]), (award(3, "B", 2000, 1.0, "2"), [*words[:9], "X"]), (award(4, "C", 2000, 1.0, "3"), ["q"] * 12), (award(5, "D", 2000, 1.0, "9"), [w.upper() for w in words])]
    df = spark.createDataFrame([(*a, w) for a, w in rows], AWARD + ", terms array<string>")
    made = grants.redundancy(df)
    assert [(r.a, r.b, r.jaccard, r.same_pi) for r in made["pairs"].collect()] == [("A", "D", 1.0, True), ("A", "B", 0.818, False), ("B", "D", 0.818, False)]
    assert tuple(made["totals"].first()) == (3, 3, 2)


@pytest.mark.parametrize("top", [1, 3, 10, 500])
def test_closest_pairs_are_those_of_all(spark, top):
    import random

    rnd = random.Random(top)
    sets = [sorted(rnd.sample(range(14), rnd.randint(4, 8))) for _ in range(12)]
    df = spark.createDataFrame([(i, [str(w) for w in rnd.choice(sets)]) for i in range(70)], "id long, words array<string>")
    every = sorted(((-r.jaccard, r.a, r.b) for r in grants.similar_grants(df, 0.3, 4, top=None).collect()))
    assert [(-r.jaccard, r.a, r.b) for r in grants.similar_grants(df, 0.3, 4, top=top).collect()] == every[:top]


def test_regression_is_least_squares(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    kinds, acts = ["RFA", "PA", "PAR"], ["R01", "U01"]
    rows = [(kinds[rng.integers(3)], acts[rng.integers(2)], int(2000 + rng.integers(3)), float(np.exp(rng.normal(12, 1))), int(rng.integers(20))) for _ in range(400)]
    got = {r.term: (r.beta, r.pct_diff) for r in portfolio.regression(spark.createDataFrame(rows, "foa_type string, activity string, start_fy int, funding double, pubs long")).collect()}
    x = np.array([[1, np.log(f), k == "PAR", k == "RFA", a == "U01", y == 2001, y == 2002] for k, a, y, f, _ in rows], float)
    beta = np.linalg.lstsq(x, np.log1p([r[4] for r in rows]), rcond=None)[0]
    assert got["foa_type=PAR"][0] == pytest.approx(beta[2], abs=1e-6) and got["foa_type=RFA"][0] == pytest.approx(beta[3], abs=1e-6)
    assert got["foa_type=RFA"][1] == pytest.approx(100 * (np.exp(beta[3]) - 1), abs=1e-4)


def test_reports_refuse_unknown_conditions(awards, links):
    with pytest.raises(ValueError, match="unknown condition"):
        topics.report(awards, links, "CA", [2000], "nothing known")
    assert "outcome" not in topics.report(awards, links, "CA", [2000], " none ")
    assert topics.condition_of("ALZHEIMERS")[0] == "alzheimers" and topics.condition_of("insulin pumps")[0] == "diabetes" and topics.condition_of("x") is None


def test_pulse_cap_is_told(awards):
    rows = {r.fiscal_year: r for r in topics.pulse(awards, [2010, 2011], per_year_cap=1).collect()}
    assert rows[2010].capped and rows[2010].grants == 1


def test_checks_and_brief(awards, links, spark):
    rows = {r.check: r.passed for r in topics.checks(awards, topics.Expect(3, ["CA"])).collect()}
    assert rows == {"min_awards": True, "ics_any": True}
    text = topics.render("x", {"trend": portfolio.funding_trend(awards)}, rows=2)
    assert "## 1. Trend" in text and "The first 2 rows." in text
