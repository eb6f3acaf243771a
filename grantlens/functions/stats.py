"""Statistics on aggregated tables: ranks, shares, Gini, rank correlation, quartiles, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Buckets of values: sixteen for each power of two.
PER_OCTAVE = 16


def value_bucket(value: Column) -> Column:
    """A whole number that never falls as the value grows; a few thousand different ones cover all doubles."""
    v = value.cast("double")
    size = F.floor(PER_OCTAVE * F.log2(F.abs(v))).cast("int")
    return F.when(v > 0, size).when(v < 0, F.lit(-100_000) - size).otherwise(F.lit(-50_000))


def with_total(df: DataFrame, name: str) -> DataFrame:
    """df with its number of rows: one row, broadcast."""
    return df.join(F.broadcast(df.agg(F.count("*").alias(name))))


def ordinal(df: DataFrame, value: str, ties: list[str], name: str, descending: bool = False) -> DataFrame:
    """Number rows from 1 by value, ties in order of the tie columns.

    No task sorts all rows: rows are numbered within buckets of like values, and the sizes of the buckets before are added. The buckets
    do not depend on the data, and there are at most a few thousand, so their sizes may be broadcast.
    """
    dealt = df.withColumn("__b", value_bucket(F.col(value)) * (-1 if descending else 1))
    sizes = dealt.groupBy("__b").agg(F.count("*").alias("__c"))
    before = sizes.select("__b", (F.sum("__c").over(Window.orderBy("__b")) - F.col("__c")).alias("__n"))
    first = F.col(value).desc() if descending else F.col(value).asc()
    place = F.row_number().over(Window.partitionBy("__b").orderBy(first, *ties))
    return dealt.join(F.broadcast(before), "__b").withColumn(name, (place + F.col("__n")).cast("long")).drop("__b", "__n")


def share_of_top(fraction: float, n: Column) -> Column:
    """How many rows a top fraction has: half-even rounding, at least one."""
    return F.greatest(F.lit(1), F.bround(n * F.lit(float(fraction))).cast("long"))


def concentration(df: DataFrame, key: str, value: str, fractions: tuple[float, ...] = (0.01, 0.05, 0.10)) -> DataFrame:
    """One row: n, total, share of the top fractions, Gini. value is exact (decimal)."""
    ranked = with_total(ordinal(df, value, [key], "rank", descending=True), "n")
    v = F.col(value)
    aggs = [F.sum(F.when(F.col("rank") <= share_of_top(f, F.col("n")), v)).alias(f"top{round(100 * f)}") for f in fractions]
    # ascending place of a row is n + 1 - rank, so the cumulative sums add up to sum(rank * value)
    row = ranked.agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.sum(F.col("rank") * v).alias("weighted"), *aggs)
    total = F.col("total").cast("double")
    shares = [F.round(F.col(f"top{round(100 * f)}").cast("double") / total, 6).alias(f"top{round(100 * f)}_pct_share") for f in fractions]
    gini = (F.col("n") + 1 - 2 * (F.col("weighted").cast("double") / total)) / F.col("n")
    return row.select(F.col("n"), total.alias("total"), *shares, F.round(gini, 6).alias("gini"))


def spearman(df: DataFrame, x: str, y: str, tie: str) -> DataFrame:
    """One row (n, spearman): correlation of ordinal ranks, ties in order of `tie`; null below three rows."""
    ranked = ordinal(ordinal(df, x, [tie], "rx"), y, [tie], "ry")
    d = (F.col("rx") - F.col("ry")).cast("long")
    row = ranked.agg(F.count("*").alias("n"), F.sum(d * d).alias("d2"))
    n = F.col("n").cast("double")
    return row.select("n", F.when(F.col("n") >= 3, F.round(1 - 6 * F.col("d2") / (n * (n * n - 1)), 6)).alias("spearman"))


def floor_quartile(df: DataFrame, value: str, ties: list[str], name: str = "quartile") -> DataFrame:
    """Quartiles of floor(n / 4) rows each, the remainder in the last; null below four rows."""
    ranked = with_total(ordinal(df, value, ties, "__r"), "__n")
    size = F.floor(F.col("__n") / 4)
    quartile = F.when(size > 0, F.least(F.floor((F.col("__r") - 1) / F.greatest(size, F.lit(1))), F.lit(3)) + 1)
    return ranked.withColumn(name, quartile.cast("int")).drop("__r", "__n")


def tiles(df: DataFrame, value: str, ties: list[str], k: int, name: str) -> DataFrame:
    """k tiles whose sizes differ by one at most, the larger ones first."""
    ranked = with_total(ordinal(df, value, ties, "__r"), "__n")
    size, extra, place = F.floor(F.col("__n") / k), F.col("__n") % k, F.col("__r") - 1
    large = extra * (size + 1)
    tile = F.when(place < large, F.floor(place / (size + 1))).otherwise(extra + F.floor((place - large) / F.greatest(size, F.lit(1)))) + 1
    return ranked.withColumn(name, tile.cast("int")).drop("__r", "__n")


def nearest_rank(steps: Column, total: Column, p: float) -> Column:
    """The value of steps (upto, v) that covers place floor(p total), counted from 0 and at most the last; null without any."""
    place = F.least(total - 1, F.floor(total * F.lit(float(p))))
    return F.get(F.filter(steps, lambda s: s["upto"] > place), 0)["v"]


def relative_change(value: str, by: str) -> list[Column]:
    """First and last value in order of `by` among rows that have one, and their relative change."""
    first, last = F.min_by(value, F.when(F.col(value).isNotNull(), F.col(by))), F.max_by(value, F.when(F.col(value).isNotNull(), F.col(by)))
    return [first.alias("first_value"), last.alias("last_value"), F.round(F.when(first != 0, (last - first) / first), 6).alias("pct_change")]


def systematic_sample(df: DataFrame, value: str, ties: list[str], cap: int) -> DataFrame:
    """Rows floor(i n / cap) of the order for i below cap; all rows if there are no more."""
    ranked = with_total(ordinal(df, value, ties, "__r"), "__n")
    place = F.col("__r") - 1
    # a place is chosen when some i has floor(i n / cap) = place
    i = F.ceil(place * cap / F.col("__n"))
    chosen = (F.col("__n") <= cap) | ((F.floor(i * F.col("__n") / cap) == place) & (i < cap))
    return ranked.where(chosen).drop("__r", "__n")
