"""Named analyses: functions from a log (or from another analysis' result) to a table.

Rows with a null query are dropped where an analysis needs the text, and rows with a null timestamp where it needs the time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T

from querymill.functions import questions as q
from querymill.functions import text, time
from querymill.operators import aggregates as agg
from querymill.operators import filters as flt
from querymill.operators import models, sampling
from querymill.operators import windows as win
from querymill.operators.filters import PROVIDER, QUERY, TIMESTAMP
from querymill.operators.sets import union_logs

Analysis = Callable[..., DataFrame]
REGISTRY: dict[str, Analysis] = {}


def analysis(name: str) -> Callable[[Analysis], Analysis]:
    def add(f: Analysis) -> Analysis:
        REGISTRY[name] = f
        return f

    return add


def run(spark: SparkSession, name: str, logs: list[DataFrame], **options) -> DataFrame:
    """Runs an analysis over the union of the logs. Analyses that rules stand in for (entities, personal data, intent, embeddings) take model=…, a function
    that loads one (see operators.models); it then runs in place of the rules."""
    if name not in REGISTRY:
        raise KeyError(f"unknown analysis {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](union_logs(*logs), **options)


def _texts(df: DataFrame) -> DataFrame:
    return df.where(F.col(QUERY).isNotNull())


def _timed(df: DataFrame) -> DataFrame:
    return df.where(F.col(TIMESTAMP).isNotNull())


# cleaning and filters


@analysis("clean-query-log")
def clean_query_log(df: DataFrame) -> DataFrame:
    return flt.not_empty(flt.without_replacement(flt.not_listed(df)))


@analysis("debug")
def debug(df: DataFrame) -> DataFrame:
    return df


@analysis("filter-aql-outlier")
def filter_outliers(df: DataFrame) -> DataFrame:
    return flt.not_listed(df)


@analysis("get-too-short-queries")
def too_short(df: DataFrame) -> DataFrame:
    return agg.sorted_count(flt.shorter_than(df, 2), QUERY, "character_count")


@analysis("sort-grouped-data")
def sort_grouped(df: DataFrame) -> DataFrame:
    return agg.sorted_count(_texts(df), QUERY)


@analysis("filter-google-queries")
def filter_provider(df: DataFrame, provider: str = "google") -> DataFrame:
    return flt.equals(df, provider).select(QUERY, TIMESTAMP, PROVIDER)


@analysis("filter-urls")
def filter_urls(df: DataFrame, column: str = "word") -> DataFrame:
    """Inferred: the name is known, its body is not."""
    return flt.not_urlish(df, column)


@analysis("transform-timestamps")
def transform_timestamps(df: DataFrame, mode: str = "weekly") -> DataFrame:
    return _timed(df).select(QUERY, TIMESTAMP, time.BUCKETS[mode](F.col(TIMESTAMP)).alias("time"))


# counts


@analysis("get-query-frequency")
def query_frequency(df: DataFrame) -> DataFrame:
    return agg.sorted_count(_texts(df), QUERY)


REGISTRY["query-frequencies"] = query_frequency


@analysis("sum-rows")
def sum_rows(df: DataFrame) -> DataFrame:
    return agg.row_count(df)


@analysis("count-deduplicated-queries")
def count_distinct(df: DataFrame, exact: bool = True) -> DataFrame:
    return (agg.distinct_count if exact else agg.distinct_estimate)(df, F.col(QUERY))


@analysis("count-deduplicated-lowercase-queries")
def count_distinct_lower(df: DataFrame, exact: bool = True) -> DataFrame:
    return (agg.distinct_count if exact else agg.distinct_estimate)(df, F.lower(QUERY))


# elements


@analysis("extract-chars")
def extract_chars(df: DataFrame) -> DataFrame:
    return agg.sorted_count(_texts(df).select(F.explode(text.characters(F.col(QUERY))).alias("char")), "char")


def words(df: DataFrame) -> DataFrame:
    return _texts(df).select(F.explode(text.tokens(F.col(QUERY))).alias("word"))


@analysis("extract-words")
def extract_words(df: DataFrame) -> DataFrame:
    return agg.sorted_count(words(df), "word")


@analysis("extract-words-merge")
def merge_words(df: DataFrame, n: str = "n") -> DataFrame:
    return agg.merge_counts(df.where("word is not null"), "word", n=n)


ENTITY = T.StructType([T.StructField("entity", T.StringType()), T.StructField("entity_label", T.StringType())])


def entities(df: DataFrame, model: models.Load | None = None) -> DataFrame:
    if model is not None:
        return models.extract(_texts(df), QUERY, ENTITY, model)
    return _texts(df).select(F.explode(text.entities(F.col(QUERY))).alias("e")).select("e.*")


@analysis("extract-named-entities")
def extract_entities(df: DataFrame, model: models.Load | None = None) -> DataFrame:
    return agg.sorted_count(entities(df, model), "entity", "entity_label")


@analysis("extract-search-operators")
def extract_operators(df: DataFrame) -> DataFrame:
    return agg.group_count(_texts(df).select(F.explode(text.operators_present(F.col(QUERY))).alias("operator")), "operator")


@analysis("search-operators-count")
def operator_counts(df: DataFrame) -> DataFrame:
    return agg.group_count(_texts(df).select(text.operator_count(F.col(QUERY)).alias("operator_count")), "operator_count")


@analysis("extract-presidio-pii")
def pii(df: DataFrame, least: float = 0.7, model: models.Load | None = None) -> DataFrame:
    """One row for each hit."""
    if model is not None:
        return models.extract(_texts(df), QUERY, ENTITY, model).select("entity_label")
    return _texts(df).select(F.explode(text.pii_labels(F.col(QUERY), least)).alias("entity_label"))


@analysis("extract-gliner-pii")
def pii_entities(df: DataFrame, model: models.Load | None = None) -> DataFrame:
    """Every hit with its text."""
    if model is not None:
        return agg.sorted_count(models.extract(_texts(df), QUERY, ENTITY, model), "entity", "entity_label")
    rows = _texts(df).select(F.explode(text.pii_hits(F.col(QUERY))).alias("e")).select("e.*")
    return agg.sorted_count(rows, "entity", "entity_label")


@analysis("group-presidio-pii")
def group_pii(df: DataFrame) -> DataFrame:
    return agg.group_count(df, "entity_label")


# lengths


@analysis("get-lengths")
def get_lengths(df: DataFrame, level: str = "queries") -> DataFrame:
    """queries: three lengths of every row (queries aren't deduplicated). words and named-entities: lengths of every distinct element of an extraction."""
    if level == "queries":
        t = F.col(QUERY)
        return _texts(df).select(QUERY, text.char_count(t).alias("character_count"), text.token_count(t).alias("word_count"), F.size(text.entities(t)).cast("long").alias("entity_count"))
    if level == "words":
        return df.withColumn("character_count", text.char_count(F.col("word")))
    if level == "named-entities":
        return df.withColumn("character_count", text.char_count(F.col("entity"))).withColumn("word_count", text.token_count(F.col("entity")))
    raise ValueError(f"unknown level {level!r}")


def length_frequencies(df: DataFrame, column: str, weighted: bool = False) -> DataFrame:
    """Counts rows of a length table: of distinct elements for words and entities. weighted counts each as often as it occurs."""
    return agg.merge_counts(df, column) if weighted else agg.group_count(df, column)


for _name, _column in (("character-count-frequencies", "character_count"), ("word-count-frequencies", "word_count"), ("entity-count-frequencies", "entity_count")):
    REGISTRY[_name] = lambda df, weighted=False, column=_column: length_frequencies(df, column, weighted)


@analysis("query-length-chars")
def query_length_chars(df: DataFrame) -> DataFrame:
    return agg.group_count(_texts(df).select(text.char_count(F.col(QUERY)).alias("character_count")), "character_count")


@analysis("query-length-words")
def query_length_words(df: DataFrame) -> DataFrame:
    return agg.group_count(_texts(df).select(text.whitespace_word_count(F.col(QUERY)).alias("word_count")), "word_count")


@analysis("aql-anomaly")
def anomaly(df: DataFrame) -> DataFrame:
    return agg.sorted_count(flt.lengths(df), QUERY, "character_count")


@analysis("named-entities-count")
def entity_total(df: DataFrame) -> DataFrame:
    """Inferred: the number of entities in all queries."""
    return _texts(df).agg(F.coalesce(F.sum(F.size(text.entities(F.col(QUERY))).cast("long")), F.lit(0)).alias("n"))


# models


@analysis("query-intent")
def query_intent(df: DataFrame, model: models.Load | None = None) -> DataFrame:
    if model is not None:
        return agg.group_count(models.predict(_texts(df).select(QUERY), QUERY, "query_intent", T.StringType(), model), "query_intent")
    return agg.group_count(_texts(df).select(text.intent(F.col(QUERY)).alias("query_intent")), "query_intent")


@analysis("questions")
def question_counts(df: DataFrame) -> DataFrame:
    return agg.group_count(_texts(df).select(q.is_question(F.col(QUERY)).alias("is_question")), "is_question")


@analysis("get-embeddings")
def embeddings(df: DataFrame, share: float = 0.1, model: models.Load | None = None) -> DataFrame:
    if model is not None:
        return models.predict(sampling.fraction(_texts(df), share, QUERY).select(QUERY), QUERY, "embeddings", T.ArrayType(T.FloatType()), model)
    return sampling.fraction(_texts(df), share, QUERY).select(QUERY, text.embedding(F.col(QUERY)).alias("embeddings"))


# time


@analysis("query-chart-by-year")
def chart_by_year(df: DataFrame) -> DataFrame:
    return agg.sorted_count(_timed(_texts(df)).select(time.year(F.col(TIMESTAMP)).alias("year"), QUERY), "year", QUERY, by=[F.desc("year"), F.desc("n"), QUERY])


@analysis("get-annual-top-queries")
def annual_top(df: DataFrame, k: int = 25) -> DataFrame:
    """Of a chart (year, query, n): the k most frequent of each year; ties by text."""
    return win.top_k(df, k, ["year"], [F.desc("n"), QUERY]).drop("rank")


@analysis("get-temporal-query-frequency")
def temporal_frequency(df: DataFrame, queries: list[str] | None = None, head: int = 100) -> DataFrame:
    """Monthly counts of given queries, by default of the log's most frequent ones."""
    rows = _timed(_texts(df)).select(time.month(F.col(TIMESTAMP)).alias("time"), QUERY)
    if queries is not None:
        return agg.group_count(flt.listed(rows, queries), "time", QUERY)
    # as many rows as head says
    top = win.top_n(agg.group_count(rows, QUERY), head, [F.desc("n"), QUERY]).select(QUERY)
    return agg.group_count(rows.join(F.broadcast(top), QUERY, "left_semi"), "time", QUERY)


@analysis("get-monthly-google-queries")
def monthly_counts(df: DataFrame) -> DataFrame:
    return agg.group_count(_timed(df).select(time.month(F.col(TIMESTAMP)).alias("time")), "time")


@analysis("get-temporal-url-proportion")
def url_proportion(df: DataFrame) -> DataFrame:
    return agg.group_count(_timed(_texts(df)).select(time.year(F.col(TIMESTAMP)).alias("year"), text.has_url(F.col(QUERY)).alias("is_url")), "year", "is_url")


@analysis("get-email-proportion")
def email_proportion(df: DataFrame) -> DataFrame:
    return agg.group_count(_texts(df).select(text.has_email(F.col(QUERY)).alias("is_email")), "is_email")


@analysis("get-repl-char-proportion")
def replacement_proportion(df: DataFrame, first: int = 1998, last: int = 2022) -> DataFrame:
    return agg.group_count(flt.years(_texts(df), first, last).select(text.has_replacement(F.col(QUERY)).alias("is_repl_char"), "year"), "is_repl_char", "year")


@analysis("aql-get-words-2006")
def words_of_years(df: DataFrame, first: int = 2000, last: int = 2006) -> DataFrame:
    return words(flt.without_replacement(flt.years(_texts(df), first, last)))


@analysis("filter-by-year-clean-repl-char")
def year_without_replacement(df: DataFrame, year: int = 2006) -> DataFrame:
    return agg.sorted_count(flt.without_replacement(flt.years(_texts(df), year, year)), QUERY, "serp_url")


@analysis("count-regular")
def annual_overlap(df: DataFrame, other: DataFrame, exact: bool = True) -> DataFrame:
    return (agg.annual_overlap if exact else agg.annual_overlap_estimate)(df, other, F.col(QUERY))


@analysis("count-lowercase")
def annual_overlap_lower(df: DataFrame, other: DataFrame, exact: bool = True) -> DataFrame:
    return (agg.annual_overlap if exact else agg.annual_overlap_estimate)(df, other, F.lower(QUERY))


@analysis("get-deduplication-results")
def overlap_report(df: DataFrame, other: DataFrame, exact: bool = True) -> DataFrame:
    return (agg.log_overlap if exact else agg.log_overlap_estimate)(df, other, F.col(QUERY))
