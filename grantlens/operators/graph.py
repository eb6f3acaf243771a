"""A graph of awards and what they lead to: edges with provenance, coverage, identities.

Nodes are (node_id, node_type, attributes); edges are (subject, predicate, object, source, method, authoritative, confidence,
evidence_pointer). Node ids are "TYPE:id". Edges are an open table: new linkers add rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from .grants import grant_key


def edge(subject: Column, predicate: str, object_: Column, source: str, method: str, authoritative: bool = True, confidence: Column | None = None, evidence: Column | None = None) -> list[Column]:
    return [
        subject.alias("subject"),
        F.lit(predicate).alias("predicate"),
        object_.alias("object"),
        F.lit(source).alias("source"),
        F.lit(method).alias("method"),
        F.lit(authoritative).alias("authoritative"),
        (F.lit(1.0) if confidence is None else confidence).alias("confidence"),
        (F.lit(None).cast("string") if evidence is None else evidence).alias("evidence_pointer"),
    ]


def node(kind: str, x: Column | str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(x) if isinstance(x, str) else x)


def publication_edges(publinks: DataFrame) -> DataFrame:
    """Each award's publications, as the funder's link table states them."""
    rows = publinks.where("pmid IS NOT NULL AND core_project_num IS NOT NULL").select("core_project_num", "pmid").distinct()
    return rows.select(*edge(node("AWARD", "core_project_num"), "produced", node("PUBLICATION", "pmid"), "award_registry", "publication_link_table", evidence=F.concat(F.lit("pmid:"), "pmid")))


def trial_edges(trials: DataFrame) -> DataFrame:
    """Each award's trials, from grant numbers that trials report; trials has (nct_id, grants array)."""
    rows = trials.select("nct_id", F.explode(F.array_distinct("grants")).alias("core"))
    return rows.select(*edge(node("AWARD", "core"), "funded_trial", node("CLINICAL_TRIAL", "nct_id"), "trial_registry", "reported_grant_number", evidence=F.col("nct_id")))


def trials_of_grant(trials: DataFrame, core: str) -> DataFrame:
    """Trials that report this grant number themselves, whatever a search for it found."""
    return trials.where(F.array_contains(F.transform("grants", F.upper), core.upper()))


def dataset_edges(texts: DataFrame) -> DataFrame:
    """Datasets that publications (pmid, text) mention: inferred, with the confidence of the pattern and its surroundings."""
    rows = texts.withColumn("m", F.explode(exprs.accessions("text")))
    return rows.select(*edge(node("PUBLICATION", "pmid"), "mentions_dataset", node("DATASET", F.concat("m.repository", F.lit(":"), "m.accession")), "text_mining", "accession_pattern", False, F.col("m.confidence"), F.concat(F.lit("pmid:"), "pmid", F.lit(" ~ '"), "m.surface_form", F.lit("'"))))


def investigators(awards: DataFrame) -> DataFrame:
    """awards once for each of their investigators, with pi (the profile number, or the name where there is none) and pi_name."""
    entry = lambda c: F.split(F.coalesce(c, F.lit("")), ";")
    each = awards.withColumn("__i", F.explode(F.arrays_zip(entry("pi_ids").alias("number"), entry("pi_names").alias("name"))))
    name = exprs.filled(F.trim(F.regexp_replace(F.coalesce("__i.name", F.lit("")), r"\(contact\)", "")))
    number = exprs.filled(F.regexp_extract(F.coalesce("__i.number", F.lit("")), "([0-9]+)", 1))
    return each.withColumn("pi", F.coalesce(number, name)).withColumn("pi_name", name).drop("__i").where("pi IS NOT NULL")


def entity_edges(awards: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """has_pi, awarded_to, funded_by, under_foa and about edges of awards; terms has (core, term)."""
    core = awards.withColumn("core", grant_key())
    subject = node("AWARD", "core")
    make = lambda rows, predicate, object_: rows.select(*edge(subject, predicate, object_, "award_registry", "project_field"))
    parts = [
        make(investigators(core), "has_pi", node("PI", "pi")),
        make(core.where("org_name <> ''"), "awarded_to", node("INSTITUTION", "org_name")),
        make(core.where("ic <> ''"), "funded_by", node("IC", "ic")),
        make(core.where("foa_number <> ''"), "under_foa", node("FOA", "foa_number")),
    ]
    if terms is not None:
        parts.append(make(terms.where("term <> ''"), "about", node("TOPIC_TERM", F.lower("term"))))
    return collapse(reduce(DataFrame.unionByName, parts))


def collapse(edges: DataFrame, order: str | None = None) -> DataFrame:
    """One edge for each (subject, predicate, object): the last in `order`, or any of equals."""
    keys = ["subject", "predicate", "object"]
    if order is None:
        return edges.dropDuplicates(keys)
    rest = [c for c in edges.columns if c not in keys]
    return edges.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("e")).select(*keys, *[f"e.{c}" for c in rest])


def award_nodes(awards: DataFrame) -> DataFrame:
    """Award nodes; of several award-years the last that has a value gives each attribute."""
    rows = awards.withColumn("core", grant_key())
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("fiscal_year", "application_id"))).alias(c)
    return rows.groupBy(node("AWARD", "core").alias("node_id")).agg(F.lit("AWARD").alias("node_type"), *[last(c) for c in ("project_title", "fiscal_year", "ic", "activity_code", "total_cost")])


def nodes(awards: DataFrame, edges: DataFrame) -> DataFrame:
    """All nodes: awards, and whatever edges end in."""
    ends = edges.select(F.col("subject").alias("node_id")).union(edges.select("object")).union(awards.select(node("AWARD", grant_key()))).distinct()
    return ends.withColumn("node_type", exprs.split_node("node_id")[0])


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): nodes by type, edges by predicate, by source, and by whether a source states them."""
    by = lambda rows, kind, name: rows.groupBy(F.lit(kind).alias("kind"), name.alias("name")).agg(F.count("*").alias("n"))
    return (
        by(nodes, "node_type", F.col("node_type"))
        .union(by(edges, "predicate", F.col("predicate")))
        .union(by(edges, "source", F.col("source")))
        .union(by(edges, "authority", F.when(F.col("authoritative"), "authoritative").otherwise("inferred")))
    )


def neighbors(edges: DataFrame, node_id: str, predicate: str | None = None, node_type: str | None = None) -> DataFrame:
    rows = edges.where(F.col("subject") == node_id)
    if predicate:
        rows = rows.where(F.col("predicate") == predicate)
    if node_type:
        rows = rows.where(exprs.split_node("object")[0] == node_type)
    return rows.select(F.col("object").alias("node_id"), "predicate").distinct()


def attributed(awards: DataFrame, trials: DataFrame | None = None) -> DataFrame:
    """(node_id, node_type, attributes) of award, investigator, institution, institute, announcement and trial nodes: a map of what is
    known, from the last record that has it."""
    rows = investigators_or_none(awards.withColumn("core", grant_key()))
    at = F.struct("fiscal_year", "application_id")
    attributes = lambda **c: F.map_filter(F.create_map(*[x for k, v in c.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at))
    made = [
        rows.groupBy(node("AWARD", "core").alias("node_id")).agg(attributes(title=last("project_title"), fiscal_year=last("fiscal_year"), ic=last("ic"), activity_code=last("activity_code"), total_cost=last("total_cost")).alias("attributes")),
        rows.where("pi IS NOT NULL").groupBy(node("PI", "pi").alias("node_id")).agg(attributes(name=last("pi_name")).alias("attributes")),
        rows.where("org_name <> ''").groupBy(node("INSTITUTION", "org_name").alias("node_id"), "org_name").agg(attributes(name=F.col("org_name"), state=last("org_state") if "org_state" in rows.columns else F.lit(None)).alias("attributes")).drop("org_name"),
        rows.where("ic <> ''").select(node("IC", "ic").alias("node_id"), attributes(name=F.col("ic")).alias("attributes")).dropDuplicates(["node_id"]),
        rows.where("foa_number <> ''").select(node("FOA", "foa_number").alias("node_id"), attributes(name=F.col("foa_number")).alias("attributes")).dropDuplicates(["node_id"]),
    ]
    if trials is not None:
        made.append(trials.groupBy(node("CLINICAL_TRIAL", "nct_id").alias("node_id")).agg(attributes(title=F.min("title")).alias("attributes")))
    return reduce(DataFrame.unionByName, made).withColumn("node_type", exprs.split_node("node_id")[0])


def investigators_or_none(awards: DataFrame) -> DataFrame:
    """As investigators, but awards without any stay, with null."""
    none = awards.join(investigators(awards).select("application_id").distinct(), "application_id", "left_anti").select("*", F.lit(None).cast("string").alias("pi"), F.lit(None).cast("string").alias("pi_name"))
    return investigators(awards).unionByName(none)


def coverage(subjects: DataFrame, edges: DataFrame, predicates: list[str] | None = None) -> DataFrame:
    """For each predicate (by default those that subjects have): subjects that have it, all subjects, share, edges by authority.

    subjects has node_id.
    """
    spark = subjects.sparkSession
    own = edges.join(subjects.select(F.col("node_id").alias("subject")), "subject", "left_semi")
    names = spark.createDataFrame([(p,) for p in predicates], "predicate string") if predicates else own.select("predicate").distinct()
    all_ = subjects.agg(F.count("*").alias("denominator"))
    own = own.where(F.col("predicate").isin(predicates)) if predicates else own
    found = own.groupBy("predicate").agg(F.count_distinct("subject").alias("numerator"), F.count_if("authoritative").alias("authoritative"), F.count_if(~F.col("authoritative")).alias("inferred"))
    rows = F.broadcast(names).join(found, "predicate", "left").fillna(0).join(F.broadcast(all_))  # a row for each predicate, one row
    return rows.withColumn("coverage", F.round(F.when(F.col("denominator") > 0, F.col("numerator") / F.col("denominator")).otherwise(0.0), 6))


def coverage_by(subjects: DataFrame, edges: DataFrame) -> DataFrame:
    """(predicate, kind, name, n): edges of the subjects by source and by method."""
    own = edges.join(subjects.select(F.col("node_id").alias("subject")), "subject", "left_semi")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in ("source", "method")])
    return own.select("predicate", F.explode(kinds).alias("k")).groupBy("predicate", "k.kind", "k.name").agg(F.count("*").alias("n"))


def stratified_coverage(award_nodes: DataFrame, edges: DataFrame, predicate: str, by: str, current_year: int) -> DataFrame:
    """Coverage of one predicate by ic, mechanism or age; awards without a value are UNKNOWN."""
    if by not in ("ic", "mechanism", "age"):
        raise ValueError(f"unknown stratifier {by!r}: ic, mechanism or age")
    value = exprs.age_bucket("fiscal_year", current_year) if by == "age" else F.coalesce(exprs.filled("ic" if by == "ic" else "activity_code"), F.lit("UNKNOWN"))
    has = edges.where(F.col("predicate") == predicate).select(F.col("subject").alias("node_id"), F.lit(1).alias("has")).distinct()
    rows = award_nodes.join(has, "node_id", "left").groupBy(value.alias("stratum")).agg(F.count("has").alias("numerator"), F.count("*").alias("denominator"))
    return rows.withColumn("coverage", F.round(F.col("numerator") / F.col("denominator"), 6))


def resolve_pis(mentions: DataFrame) -> DataFrame:
    """Investigators of mentions (pos, full_name, profile_id, orcid, institution): key, first name, variants and institutions as first seen."""
    key, by = exprs.pi_key("orcid", "profile_id", "full_name", "institution")
    return _resolved(mentions.withColumn("key", key).withColumn("resolved_by", by), "full_name", institutions=True)


def resolve_institutions(mentions: DataFrame) -> DataFrame:
    """Institutions of mentions (pos, name, ror_id)."""
    key, by = exprs.institution_key("ror_id", "name")
    return _resolved(mentions.withColumn("key", key).withColumn("resolved_by", by), "name", institutions=False)


def _resolved(rows: DataFrame, name: str, institutions: bool) -> DataFrame:
    # distinct variants with their first place come first, so that a cluster's list is of variants, not of mentions
    def variants(c: str) -> DataFrame:
        first = rows.where(exprs.filled(c).isNotNull()).groupBy("key", c).agg(F.min("pos").alias("p"))
        return first.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", c))), lambda s: s[c]), "; ").alias(f"{c}_variants"))

    out = rows.groupBy("key").agg(F.min_by(name, "pos").alias("display_name"), F.min("resolved_by").alias("resolved_by"), F.count("*").alias("mention_count")).join(variants(name), "key", "left")
    return out.join(variants("institution"), "key", "left") if institutions else out


def portfolio_graph(awards: DataFrame, publinks: DataFrame, max_awards: int | None = None, trials: DataFrame | None = None, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a portfolio's grants; with max_awards, of the first grants by latest year and number.

    trials has (nct_id, core), terms (core, term); of both, what belongs to the grants is taken.
    """
    if max_awards:
        first = awards.withColumn("core", grant_key()).groupBy("core").agg(F.max("fiscal_year").alias("fy"), F.min("application_id").alias("a")).orderBy(F.desc("fy"), "a").limit(max_awards)
        awards = awards.withColumn("core", grant_key()).join(first.select("core"), "core", "left_semi")
        publinks = publinks.join(first.select(F.col("core").alias("core_project_num")), "core_project_num", "left_semi")
    own = awards.select(grant_key().alias("core")).distinct()
    edges = entity_edges(awards, None if terms is None else terms.join(own, "core", "left_semi")).unionByName(publication_edges(publinks))
    if trials is not None:
        reported = trials.join(own, "core", "left_semi").groupBy("nct_id").agg(F.collect_set("core").alias("grants"))  # the few that a trial reports
        edges = edges.unionByName(trial_edges(reported))
    return nodes(awards, edges), edges


def award_graph(awards: DataFrame, publinks: DataFrame, number: str, trials: DataFrame | None = None, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The graph about one award, by core or full project number."""
    own = awards.where((F.col("core_project_num") == number) | (F.col("full_project_num") == number))
    cores = own.select(grant_key().alias("core_project_num")).distinct()
    return portfolio_graph(own, publinks.join(cores, "core_project_num", "left_semi"), None, trials, terms)


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, id, json): each node and edge as one JSON object."""
    node_json = nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), F.to_json(F.struct(F.col("node_id").alias("id"), *[c for c in nodes.columns if c != "node_id"])).alias("json"))
    return node_json.union(edges.select(F.lit("edge"), F.concat_ws(" ", "subject", "predicate", "object"), F.to_json(F.struct(*edges.columns))))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Parquet tables `nodes` and `edges`, and JSON lines of both, in a folder."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("predicate").parquet(f"{path}/edges")
    graph_json(nodes, edges).select("kind", "json").write.mode("overwrite").partitionBy("kind").text(f"{path}/json")


def first_of(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("r")).select(key, "r.*")
