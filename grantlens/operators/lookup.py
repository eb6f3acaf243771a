"""Searches, counts and lookups in registry tables: articles, trials, drug labels, mortality, prevalence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs


def _contains(c: str | Column, text: str) -> Column:
    return F.contains(F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), F.lit(text.lower()))


def search(table: DataFrame, key: str, limit: int | None = None, **texts: str | None) -> DataFrame:
    """Rows whose columns contain the texts given, in any case, in order of the key."""
    conditions = [_contains(c, t) for c, t in texts.items() if t]
    rows = table.where(reduce(lambda a, b: a & b, conditions)) if conditions else table
    return rows.orderBy(key).limit(limit) if limit is not None else rows


def count(table: DataFrame, **texts: str | None) -> DataFrame:
    """One row: how many rows contain the texts."""
    return search(table, "", None, **texts).agg(F.count("*").alias("total"))


def in_order(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Records of ids (pos, id) in their order; ids without a record are left out."""
    return ids.join(table.withColumnRenamed(key, "id"), "id").orderBy("pos").withColumnRenamed("id", key)


def labels_for_indication(labels: DataFrame, indication: str, key: str, limit: int = 20) -> DataFrame:
    """The first labels with an indication, each with how many there are in all; none when there is none."""
    hits = search(labels, key, None, indication=indication)
    total = hits.agg(F.count("*").alias("total"))
    return hits.orderBy(key).limit(limit).join(F.broadcast(total))  # one row


def prevalence(rows: DataFrame, measure: str, state: str | None = None, year: int | None = None) -> DataFrame:
    keep = F.col("measure") == measure
    if state:
        keep &= F.col("state") == state
    if year:
        keep &= F.col("year") == year
    return rows.where(keep)


def prevalence_mean(rows: DataFrame, measure: str, state: str | None = None, year: int | None = None) -> DataFrame:
    """Areas and the mean of values that there are."""
    value = F.col("value").cast("decimal(18,4)")
    return prevalence(rows, measure, state, year).agg(F.count("value").alias("areas"), F.round(F.sum(value).cast("double") / F.count("value"), 4).alias("mean_prevalence"))


def condition_pulse(awards: DataFrame, trials: DataFrame, labels: DataFrame, deaths: DataFrame, areas: DataFrame, keywords: list[str], condition: str, indication: str, cause: str, measure: str, years: list[int], state: str | None = None) -> DataFrame:
    """One row for a condition: grants and funding in years, trials and those with results, approved labels, change in mortality, mean prevalence.

    Totals of funding keep award-years without a core number; grants count those with one.
    """
    own = awards.where(exprs.contains_any("project_title", keywords) & F.col("fiscal_year").isin(years))
    money = own.agg(F.count_distinct("core_project_num").alias("grants"), F.sum(F.col("total_cost").cast("decimal(18,2)")).cast("double").alias("funding"), F.count("*").alias("award_years"))
    series = deaths.where(F.col("cause_name") == cause)
    first = F.min_by("aadr", F.when(F.col("aadr").isNotNull(), F.col("year")))
    last = F.max_by("aadr", F.when(F.col("aadr").isNotNull(), F.col("year")))
    change = series.agg(F.round((last - first) / first, 6).alias("mortality_change"))
    found = search(trials, "", None, condition=condition).agg(F.count("*").alias("trials"), F.count_if("has_results").alias("trials_with_results"))
    parts = [money, found, count(labels, indication=indication).withColumnRenamed("total", "labels"), change, prevalence_mean(areas, measure, state)]
    return reduce(lambda a, b: a.join(F.broadcast(b)), parts)  # one row each
