"""Top lists, ranks and running shares.

Global ranks and running sums never order all elements in one partition: elements with the same count are interchangeable, so
what is ordered are the distinct counts (or lengths), with the number of elements that have each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, groups: list[str], by: list) -> DataFrame:
    """The first k rows of each group; partitions keep only their own first k before the shuffle."""
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*groups).orderBy(*by)))
    return ranked.where(F.col("rank") <= k)


def top_n(df: DataFrame, n: int, by: list) -> DataFrame:
    return df.orderBy(*by).limit(n)


def slice_of(df: DataFrame, first: int, rows: int, by: list) -> DataFrame:
    """Rows first to first + rows - 1 (from 0) in the given order; partitions keep only what may be among them."""
    return df.orderBy(*by).offset(first).limit(rows)


def count_steps(df: DataFrame, groups: list[str], n: str = "n") -> DataFrame:
    """(groups, n, elements, first_rank, last_rank, share_before, share_to): the rank-size curve in steps of equal count, the largest count first."""
    steps = df.groupBy(*groups, n).agg(F.count("*").alias("elements"))
    order = W.partitionBy(*groups).orderBy(F.desc(n))
    to = order.rowsBetween(W.unboundedPreceding, 0)
    total = F.sum(F.col(n) * F.col("elements")).over(W.partitionBy(*groups))
    last, mass = F.sum("elements").over(to), F.sum(F.col(n) * F.col("elements")).over(to)
    return steps.withColumn("last_rank", last).withColumn("first_rank", last - F.col("elements") + 1).withColumn("share_to", mass / total).withColumn("share_before", (mass - F.col(n) * F.col("elements")) / total)


def running_share(df: DataFrame, groups: list[str], x: str, n: str = "n") -> DataFrame:
    """Adds the cumulative share of n in the order of x, for tables with few distinct x (lengths, labels, months)."""
    part = W.partitionBy(*groups)
    to = part.orderBy(x).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("share", F.sum(n).over(to) / F.sum(n).over(part))


def ranks_below(df: DataFrame, groups: list[str], threshold: float, n: str = "n") -> DataFrame:
    """(groups, x_max): the number of ranks whose cumulative share is below the threshold."""
    steps = count_steps(df, groups, n)
    total = F.sum(F.col(n) * F.col("elements")).over(W.partitionBy(*groups))
    room = (F.lit(threshold) * total - F.col("share_before") * total) / F.col(n)
    whole = F.least(F.col("elements"), F.greatest(F.lit(0), F.ceil(room - 1e-9) - 1))
    return steps.withColumn("k", whole).groupBy(*groups).agg(F.sum("k").cast("long").alias("x_max"))


def relative_height_cut(df: DataFrame, groups: list[str], x: str, threshold: float, n: str = "n") -> DataFrame:
    """(groups, x_max): the largest x whose n exceeds the threshold times the largest n."""
    top = df.withColumn("top", F.max(n).over(W.partitionBy(*groups)))
    return top.where(F.col(n) > F.col("top") * threshold).groupBy(*groups).agg(F.max(x).alias("x_max"))


def max_scaled(df: DataFrame, groups: list[str], n: str = "n", digits: int = 0) -> DataFrame:
    """Adds score: n as a percentage of the group's largest, rounded half to even."""
    return df.withColumn("score", F.bround(100 * F.col(n) / F.max(n).over(W.partitionBy(*groups)), digits))


def min_max_scaled(df: DataFrame, groups: list[str], x: str) -> DataFrame:
    part = W.partitionBy(*groups)
    low, high = F.min(x).over(part), F.max(x).over(part)
    return df.withColumn("scaled", F.try_divide((F.col(x) - low) * 100, high - low))


def standardised(df: DataFrame, groups: list[str], x: str) -> DataFrame:
    part = W.partitionBy(*groups)
    return df.withColumn("z", F.try_divide(F.col(x) - F.avg(x).over(part), F.stddev_pop(x).over(part)))


def normalised(df: DataFrame, groups: list[str], n: str = "n") -> DataFrame:
    return df.withColumn("p", F.col(n) / F.sum(n).over(W.partitionBy(*groups)))


def reciprocal_rank_fusion(df: DataFrame, item: str, rank: str = "rank", k: int = 60) -> DataFrame:
    return df.groupBy(item).agg(F.sum(1 / (F.lit(k) + F.col(rank))).alias("rrf")).orderBy(F.desc("rrf"), item)
