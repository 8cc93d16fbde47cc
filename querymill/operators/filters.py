"""Row filters. Unless said otherwise, rows with a null in the tested column are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.functions import text, time

QUERY, TIMESTAMP, PROVIDER = "serp_query_text_url", "serp_timestamp", "search_provider_name"
# fixed values: four outliers of one log
BLACKLIST = ["茅聵驴茅聡聦猫聹聵猫聸聸忙卤", "#FreeMariaButina", "พระชัยหลวงพ่อโสธรปี 2505", "é\x98¿é\x87\x8cè\x9c\x98è\x9b\x9bæ±"]


def not_listed(df: DataFrame, values: list[str] = BLACKLIST, column: str = QUERY) -> DataFrame:
    """Nulls stay, as they are no listed value."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(values))


def listed(df: DataFrame, values: list[str], column: str = QUERY) -> DataFrame:
    return df.where(F.col(column).isin(values))


def without_replacement(df: DataFrame, column: str = QUERY) -> DataFrame:
    return df.where(~text.has_replacement(F.col(column)))


def not_empty(df: DataFrame, column: str = QUERY) -> DataFrame:
    return df.where(F.length(column) > 0)


def not_null(df: DataFrame, column: str = TIMESTAMP) -> DataFrame:
    return df.where(F.col(column).isNotNull())


def years(df: DataFrame, first: int, last: int, column: str = TIMESTAMP) -> DataFrame:
    """Keeps the years of the range and adds `year`; the range is pushed to the scan."""
    return df.where(time.year_range(F.col(column), first, last)).withColumn("year", time.year(F.col(column)))


def equals(df: DataFrame, value, column: str = PROVIDER) -> DataFrame:
    return df.where(F.col(column) == value)


def flagged(df: DataFrame, flag: str) -> DataFrame:
    """The rows whose flag is true."""
    return df.where(F.col(flag))


def rewritten(df: DataFrame, column: str, texts: dict[str, str]) -> DataFrame:
    """Literal values of a column replaced by others; what isn't listed stays."""
    return df.replace(texts, subset=[column]) if texts else df


def lengths(df: DataFrame, values: list[int] = (14, 16, 24), column: str = "character_count") -> DataFrame:
    return df.where(F.col(column).isin(list(values)))


def shorter_than(df: DataFrame, n: int = 2, column: str = QUERY) -> DataFrame:
    return df.withColumn("character_count", text.char_count(F.col(column))).where(F.col("character_count") < n)


def language(df: DataFrame, mode: str = "corrected", code: str = "en", text_col: str = QUERY, label_col: str = "serp_query_text_url_language") -> DataFrame:
    """corrected: the label names the language; reference: the query text contains the code, as published numbers were made."""
    if mode == "reference":
        return df.where(F.contains(F.col(text_col), F.lit(code)))
    return df.where(F.lower(label_col).startswith(code))


def not_urlish(df: DataFrame, column: str) -> DataFrame:
    return df.where(~F.col(column).rlike(text.URLISH))
