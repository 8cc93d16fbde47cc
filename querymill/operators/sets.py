"""Unions, intersections and pairwise overlaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_logs(*logs: DataFrame) -> DataFrame:
    """All rows of all logs; a column that a log lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)


def shared_top(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a whose keys b has as well."""
    return a.join(b.select(*keys).distinct(), keys, "left_semi")


def pairwise_shared(df: DataFrame, group: str, item: str) -> DataFrame:
    """(ds1, ds2, shared): how many items each pair of groups has in common, from (group, item) with few groups: each item lists its
    groups, and pairs are made within that list."""
    listed = df.select(group, item).distinct().groupBy(item).agg(F.array_sort(F.collect_set(group)).alias("g"))
    firsts = listed.select("g", F.posexplode("g").alias("at", "ds1"))
    pairs = firsts.select("ds1", F.explode(F.expr("slice(g, at + 2, size(g))")).alias("ds2"))
    return pairs.groupBy("ds1", "ds2").agg(F.count("*").alias("shared"))


def overlap_statistics(df: DataFrame, group: str, item: str, groups: list[str], target: str) -> DataFrame:
    """(target_mean, rest_mean, rest_var, rest_std): of the sizes of pairwise_shared, for the pairs with the target group and for the others; pairs that share
    nothing count with 0; variance and deviation are those of a population."""
    names = sorted(groups)
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :]]
    spine = df.sparkSession.createDataFrame(pairs, "ds1 string, ds2 string")
    rows = spine.join(pairwise_shared(df, group, item), ["ds1", "ds2"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    own = (F.col("ds1") == target) | (F.col("ds2") == target)
    rest = F.when(~own, F.col("shared"))
    return rows.agg(F.avg(F.when(own, F.col("shared"))).alias("target_mean"), F.avg(rest).alias("rest_mean"), F.var_pop(rest).alias("rest_var"), F.stddev_pop(rest).alias("rest_std"))


def in_all(df: DataFrame, group: str, item: str, groups: int) -> DataFrame:
    """The rows whose item occurs in all groups."""
    common = df.groupBy(item).agg(F.count_distinct(group).alias("k")).where(F.col("k") == groups).select(item)
    return df.join(common, item, "left_semi")
