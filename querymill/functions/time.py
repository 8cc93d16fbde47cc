"""Calendar expressions over epoch seconds, in UTC."""

from __future__ import annotations

from calendar import timegm

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def timestamp(epoch: Column) -> Column:
    return F.timestamp_seconds(epoch)


def year(epoch: Column) -> Column:
    return F.year(timestamp(epoch)).cast("long")


def month(epoch: Column) -> Column:
    return F.date_format(timestamp(epoch), "yyyy-MM")


def parse_month(text: Column) -> Column:
    """The first day of a month given as yyyy-MM; null for other texts."""
    return F.try_to_date(text, "yyyy-MM")


def week(epoch: Column) -> Column:
    """Year and Monday-first week 00 to 53; days before the first Monday are in week 00."""
    t = timestamp(epoch)
    n = F.floor((F.dayofyear(t) + 6 - F.weekday(t)) / 7)
    return F.concat(F.year(t).cast("string"), F.lit("-"), F.lpad(n.cast("string"), 2, "0"))


BUCKETS = {"yearly": year, "monthly": month, "weekly": week}


def year_range(epoch: Column, first: int, last: int) -> Column:
    """Whether the year is in the range, as bounds of the epoch itself, which reach the Parquet scan."""
    return (epoch >= timegm((first, 1, 1, 0, 0, 0))) & (epoch < timegm((last + 1, 1, 1, 0, 0, 0)))


def month_spine(spark: SparkSession, first: str = "2004-01-01", last: str = "2022-12-01") -> DataFrame:
    """(time): every month of the range as yyyy-MM."""
    months = F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr("interval 1 month")))
    return spark.range(1).select(months.alias("d")).select(F.date_format("d", "yyyy-MM").alias("time"))
