"""Group counts, distinct counts and overlaps between logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.functions import time
from querymill.operators.filters import TIMESTAMP

MOST_LOGS = 10_000  # rows of a table of log sizes


def group_count(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def sorted_count(df: DataFrame, *keys: str, by: list[Column] | None = None) -> DataFrame:
    """Group counts, the largest first; ties by the keys."""
    return group_count(df, *keys).orderBy(*(by or [F.desc("n"), *keys]))


def merge_counts(df: DataFrame, *keys: str, n: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(n).alias("n"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def sum_and_unique(df: DataFrame, n: str = "n") -> DataFrame:
    """Of a table of counts: their sum and how many there are."""
    return df.agg(F.sum(n).alias("total"), F.count("*").alias("unique"))


def distinct_count(df: DataFrame, value: Column, name: str = "n") -> DataFrame:
    return df.agg(F.count_distinct(value).alias(name))


def distinct_estimate(df: DataFrame, value: Column, name: str = "n") -> DataFrame:
    """HyperLogLog with 2^16 registers."""
    return df.agg(F.approx_count_distinct(value, 0.0044).alias(name))


def log_overlap(a: DataFrame, b: DataFrame, value: Column) -> DataFrame:
    """(a, b, either, both, share_a, share_b) of two logs, exactly: distinct values once with a flag for each log, then sums."""
    flags = a.select(value.alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(value.alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    one = flags.where("v is not null").groupBy("v").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    sums = one.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.count("*").alias("either"), F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("both"))
    return sums.withColumn("share_a", F.round(F.try_divide("both", "a"), 6)).withColumn("share_b", F.round(F.try_divide("both", "b"), 6))


def log_overlap_estimate(a: DataFrame, b: DataFrame, value: Column) -> DataFrame:
    """The same from mergeable sketches: one pass over each log, and |A and B| = |A| + |B| - |A or B|."""
    sketch = lambda df, n: df.where(value.isNotNull()).agg(F.hll_sketch_agg(value, 16).alias(n))
    both = sketch(a, "sa").join(sketch(b, "sb"), F.lit(True))  # one row each
    either = F.hll_sketch_estimate(F.hll_union("sa", "sb"))
    out = both.select(F.hll_sketch_estimate("sa").alias("a"), F.hll_sketch_estimate("sb").alias("b"), either.alias("either"))
    return out.withColumn("both", F.col("a") + F.col("b") - F.col("either"))


def _spine(df: DataFrame, first: int, last: int) -> DataFrame:
    return df.sparkSession.range(first, last + 1).select(F.col("id").alias("year"))


def annual_overlap(a: DataFrame, b: DataFrame, value: Column, first: int = 1999, last: int = 2022) -> DataFrame:
    """(year, a, b, both, share_a, share_b): distinct values of each year of a that b holds too. Years without rows have zeros and null shares."""
    years = a.where(value.isNotNull() & time.year_range(F.col(TIMESTAMP), first, last)).select(time.year(F.col(TIMESTAMP)).alias("year"), value.alias("v")).distinct()
    other = b.where(value.isNotNull()).select(value.alias("v")).distinct().withColumn("hit", F.lit(1))
    size = other.agg(F.count("*").alias("b"))
    own = years.join(other, "v", "left").groupBy("year").agg(F.count("*").alias("a"), F.count("hit").alias("both"))
    rows = _spine(a, first, last).join(own, "year", "left").join(F.broadcast(size), F.lit(True))
    zero = F.lit(0).cast("long")
    rows = rows.select("year", F.coalesce("a", zero).alias("a"), "b", F.coalesce("both", zero).alias("both"))
    return rows.withColumn("share_a", F.round(F.try_divide("both", "a"), 6)).withColumn("share_b", F.round(F.try_divide("both", "b"), 6))


def annual_overlap_estimate(a: DataFrame, b: DataFrame, value: Column, first: int = 1999, last: int = 2022) -> DataFrame:
    """The same from sketches in one pass over each log: a sketch for each year, united with the one of b."""
    years = a.where(value.isNotNull() & time.year_range(F.col(TIMESTAMP), first, last)).groupBy(time.year(F.col(TIMESTAMP)).alias("year")).agg(F.hll_sketch_agg(value, 16).alias("sa"))
    other = b.where(value.isNotNull()).agg(F.hll_sketch_agg(value, 16).alias("sb"))
    rows = years.join(F.broadcast(other), F.lit(True)).select("year", F.hll_sketch_estimate("sa").alias("a"), F.hll_sketch_estimate("sb").alias("b"), F.hll_sketch_estimate(F.hll_union("sa", "sb")).alias("either"))
    zero = F.lit(0).cast("long")
    rows = _spine(a, first, last).join(rows, "year", "left")
    return rows.select("year", F.coalesce("a", zero).alias("a"), F.coalesce("b", zero).alias("b"), F.coalesce(F.col("a") + F.col("b") - F.col("either"), zero).alias("both"))


def annual_flags(df: DataFrame, flag: str, n: str = "n") -> DataFrame:
    """(year, hit, miss, ratio) from (year, flag, n)."""
    hit, miss = F.sum(F.when(F.col(flag), F.col(n)).otherwise(0)), F.sum(F.when(F.col(flag), 0).otherwise(F.col(n)))
    return df.groupBy("year").agg(hit.alias("hit"), miss.alias("miss"), F.round(hit / F.sum(n), 6).alias("ratio"))


def pair_overlaps(df: DataFrame, group: str, value: Column, groups: list[str]) -> DataFrame:
    """(ds1, ds2, a, b, either, both, share_a, share_b, all_logs, share_all) for every pair of a few logs, exactly: each distinct value once with the set of its logs,
    then a count for each such set (at most 2 ** logs rows). all_logs is the number of distinct values of all logs together, share_all what part of it the pair shares."""
    names = sorted(groups)
    bit = F.lit(0).cast("long")
    for k, name in enumerate(names):
        bit = F.when(F.col(group) == name, F.lit(1 << k).cast("long")).otherwise(bit)
    sets = df.where(F.col(group).isin(names) & value.isNotNull()).groupBy(value.alias("v")).agg(F.bit_or(bit).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    pairs = [(x, y) for x in range(len(names)) for y in range(x + 1, len(names))]
    listed = F.array(*[F.struct(F.lit(names[x]).alias("ds1"), F.lit(names[y]).alias("ds2"), F.lit(1 << x).cast("long").alias("x"), F.lit(1 << y).cast("long").alias("y")) for x, y in pairs])
    rows = sets.select("s", "n", F.explode(listed).alias("p")).select("s", "n", "p.*")
    in_x, in_y = F.col("s").bitwiseAND(F.col("x")) != 0, F.col("s").bitwiseAND(F.col("y")) != 0
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0).cast("long"))
    out = rows.groupBy("ds1", "ds2").agg(total(in_x).alias("a"), total(in_y).alias("b"), total(in_x | in_y).alias("either"), total(in_x & in_y).alias("both"), F.sum("n").alias("all_logs"))
    share = lambda of: F.round(F.try_divide("both", of), 6)
    return out.select("ds1", "ds2", "a", "b", "either", "both", share("a").alias("share_a"), share("b").alias("share_b"), "all_logs", share("all_logs").alias("share_all"))


def pair_overlap_estimates(df: DataFrame, group: str, value: Column, groups: list[str]) -> DataFrame:
    """(ds1, ds2, a, b, either, both) from one sketch for each log, made in one pass, and |A and B| = |A| + |B| - |A or B|."""
    names = sorted(groups)
    sketch = lambda name: F.hll_sketch_agg(F.when(F.col(group) == name, value), 16)
    one = df.where(F.col(group).isin(names) & value.isNotNull()).agg(*[sketch(n).alias(f"s{k}") for k, n in enumerate(names)])
    pair = lambda x, y: F.struct(F.lit(names[x]).alias("ds1"), F.lit(names[y]).alias("ds2"), F.hll_sketch_estimate(f"s{x}").alias("a"), F.hll_sketch_estimate(f"s{y}").alias("b"), F.hll_sketch_estimate(F.hll_union(f"s{x}", f"s{y}")).alias("either"))
    rows = one.select(F.explode(F.array(*[pair(x, y) for x in range(len(names)) for y in range(x + 1, len(names))])).alias("p")).select("p.*")
    return rows.withColumn("both", F.col("a") + F.col("b") - F.col("either"))


def _few(sizes: DataFrame) -> DataFrame:
    if sizes.limit(MOST_LOGS + 1).count() > MOST_LOGS:
        raise ValueError("more rows of sizes than MOST_LOGS")
    return sizes


def share_of_sizes(counts: DataFrame, sizes: DataFrame, keys: list[str], n: str = "n", size: str = "size") -> DataFrame:
    """Adds share: n by the size of its log, from a table of few sizes; null where the log has none."""
    return counts.join(F.broadcast(_few(sizes.select(*keys, size))), keys, "left").withColumn("share", F.try_divide(n, size))
