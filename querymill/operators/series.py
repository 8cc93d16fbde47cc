"""Month series of queries: dense grids, shares of the total, correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def dense_months(series: DataFrame, item: str, first: str = "2004-01-01", last: str = "2022-12-01") -> DataFrame:
    """(time, item, n) for every month of the range and every item: missing counts are 0. The grid is unnested from a list of months, so its
    size is items times months and nothing is crossed."""
    items = series.select(item).distinct()
    grid = items.withColumn("time", F.explode(F.transform(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))))
    return grid.join(series.select("time", item, "n"), ["time", item], "left").select("time", item, F.coalesce("n", F.lit(0)).alias("n"))


def share_of_total(series: DataFrame, totals: DataFrame, item: str) -> DataFrame:
    """Adds share: n by the month's total; a month without total counts as 1."""
    # totals has a row for each month
    joined = series.join(F.broadcast(totals.select("time", F.col("n").alias("total"))), "time", "left")
    return joined.withColumn("share", F.col("n") / F.coalesce("total", F.lit(1)))


def correlation(a: DataFrame, b: DataFrame, item: str, x: str = "x") -> DataFrame:
    """(item, correlation): population Pearson of two series by item, joined by time; null where a series is constant."""
    pairs = a.select("time", item, F.col(x).alias("u")).join(b.select("time", item, F.col(x).alias("v")), ["time", item])
    u, v = F.col("u"), F.col("v")
    cov = F.avg(u * v) - F.avg(u) * F.avg(v)
    spread = F.sqrt(F.greatest(F.lit(0.0), F.avg(u * u) - F.avg(u) * F.avg(u))) * F.sqrt(F.greatest(F.lit(0.0), F.avg(v * v) - F.avg(v) * F.avg(v)))
    return pairs.groupBy(item).agg(F.when(spread > 1e-12, cov / spread).alias("correlation"))
