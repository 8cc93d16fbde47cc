"""Registered queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querymill.functions import questions as q
from querymill.functions import text, time
from querymill.operators import aggregates as agg
from querymill.operators import filters as flt
from querymill.operators import sampling, series, sets, stats, vectors
from querymill.operators import windows as win
from querymill.operators.filters import QUERY, TIMESTAMP
from querymill.plans import analyses as an
from querymill.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LOGS = ["aol", "aql", "ms-marco", "orcas"]
GOOGLE = "quandex"  # stands for the provider whose queries are studied over time


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def log(spark: SparkSession, sf: str, name: str | None = None) -> DataFrame:
    df = table(spark, sf, "query_log")
    return df.where(F.col("dataset") == name) if name else df


# SQL fragments
_Q = "serp_query_text_url"
_TOKENS = f"regexp_extract_all({_Q}, '{text.TOKEN.replace(chr(39), chr(39) * 2)}')"
_WORDS = f"(select dataset, serp_timestamp, unnest({_TOKENS}) as word from query_log where {_Q} is not null)"
_PROPER = f"regexp_extract_all({_Q}, '{text.PROPER}')"
_YEARS = f"list_filter({_TOKENS}, lambda x: regexp_matches(x, '^(19|20)[0-9]{{2}}$'))"
_ENTITY_COUNT = f"len({_PROPER}) + len({_YEARS})"
_ENTITIES = f"""(select dataset, unnest({_PROPER}) as entity, 'PROPER-Capitalised words' as entity_label from query_log where {_Q} is not null
  union all select dataset, unnest({_YEARS}), 'DATE-Years' from query_log where {_Q} is not null)"""
_TS = "make_timestamp(serp_timestamp * 1000000)"
_YEAR = f"year({_TS})"
_MONTH = f"strftime({_TS}, '%Y-%m')"
_OPS = "[" + ", ".join(f"'{o}'" for o in text.OPERATORS) + "]"
_RLIKE = lambda p: f"regexp_matches({_Q}, '{p}')"
_LIST = ", ".join("'" + b.replace("'", "''") + "'" for b in flt.BLACKLIST)


# cleaning and filters


@query(f"select record_id, {_Q} from query_log where {_Q} not in ({_LIST}) and not contains({_Q}, '{text.REPLACEMENT}') and length({_Q}) > 0")
def clean_query_log(spark, sf):
    return an.clean_query_log(log(spark, sf)).select("record_id", QUERY)


@query(f"select record_id from query_log where {_Q} is null or {_Q} not in ({_LIST})")
def filter_outliers(spark, sf):
    return an.filter_outliers(log(spark, sf)).select("record_id")


@query(f"select {_Q}, length({_Q}) as character_count, count(*) as n from query_log where length({_Q}) < 2 group by all")
def too_short_queries(spark, sf):
    return an.too_short(log(spark, sf))


@query(f"select {_Q}, serp_timestamp, search_provider_name from query_log where search_provider_name = '{GOOGLE}'")
def filter_by_provider(spark, sf):
    return an.filter_provider(log(spark, sf), GOOGLE)


@query("select record_id from query_log where lower(serp_query_text_url_language) like 'en%'")
def filter_language(spark, sf):
    return flt.language(log(spark, sf)).select("record_id")


@query(f"select record_id from query_log where contains({_Q}, 'en')")
def filter_language_reference(spark, sf):
    return flt.language(log(spark, sf), "reference").select("record_id")


@query("select word, record_id from extract_words where not regexp_matches(word, 'http|www\\.|\\.com|\\.net|\\.org|\\.int|\\.edu')")
def filter_urls(spark, sf):
    return an.filter_urls(table(spark, sf, "extract_words")).select("word", "record_id")


@query(f"select record_id, {_YEAR} as year from query_log where {_YEAR} between 2004 and 2006")
def filter_by_years(spark, sf):
    return flt.years(log(spark, sf), 2004, 2006).select("record_id", "year")


@query(f"select {_Q}, serp_url, count(*) as n from query_log where {_YEAR} = 2006 and not contains({_Q}, '{text.REPLACEMENT}') group by all")
def filter_by_year_clean_repl_char(spark, sf):
    return an.year_without_replacement(log(spark, sf))


@query(f"select {_Q}, length({_Q}) as character_count, count(*) as n from query_log where length({_Q}) in (14, 16, 24) group by all")
def anomaly_lengths(spark, sf):
    return an.anomaly(an.get_lengths(log(spark, sf)))


# counts


@query(f"select {_Q}, count(*) as n from query_log where {_Q} is not null group by 1")
def query_frequencies(spark, sf):
    return an.query_frequency(log(spark, sf))


@query("select count(*) as n from query_log")
def sum_rows(spark, sf):
    return an.sum_rows(log(spark, sf))


@query(f"select count(distinct {_Q}) as n from query_log")
def count_distinct(spark, sf):
    return an.count_distinct(log(spark, sf))


@query(f"select count(distinct lower({_Q})) as n from query_log")
def count_distinct_lower(spark, sf):
    return an.count_distinct_lower(log(spark, sf))


@query(f"select count(distinct {_Q}) as n, 1.0::double as estimate_by_exact, true as close from query_log")
def count_distinct_hll(spark, sf):
    """The exact count, the estimate divided by it to one digit, and whether the estimate is within three standard errors."""
    df = log(spark, sf)
    both = agg.distinct_estimate(df, F.col(QUERY), "e").join(agg.distinct_count(df, F.col(QUERY), "n"), F.lit(True))
    return both.select("n", F.round(F.try_divide("e", "n"), 1).alias("estimate_by_exact"), (F.abs(F.col("e") - F.col("n")) <= F.greatest(F.lit(3.0), F.col("n") * 0.0123)).alias("close"))


@query(f"select char, count(*) as n from (select unnest(string_split(replace({_Q}, ' ', ''), '')) as char from query_log where {_Q} is not null) where char <> '' group by 1")
def extract_chars(spark, sf):
    return an.extract_chars(log(spark, sf))


@query(f"select word, count(*) as n from {_WORDS} group by 1")
def extract_words(spark, sf):
    return an.extract_words(log(spark, sf))


@query("select word, cast(sum(n) as bigint) as n from extract_words where word is not null group by 1")
def words_merge(spark, sf):
    return an.merge_words(table(spark, sf, "extract_words"))


@query("select cast(sum(n) as bigint) as total, count(*) as \"unique\" from (select word, sum(n) as n from extract_words where word is not null group by 1)")
def words_sum_and_unique(spark, sf):
    return agg.sum_and_unique(an.merge_words(table(spark, sf, "extract_words")))


@query(f"select entity, entity_label, count(*) as n from {_ENTITIES} group by all")
def named_entities(spark, sf):
    return an.extract_entities(log(spark, sf))


@query(f"select cast(sum({_ENTITY_COUNT}) as bigint) as n from query_log where {_Q} is not null")
def named_entities_count(spark, sf):
    return an.entity_total(log(spark, sf))


@query(f"select operator, count(*) as n from (select {_Q} as q, unnest({_OPS}) as operator from query_log) where contains(q, operator) group by 1")
def search_operators(spark, sf):
    return an.extract_operators(log(spark, sf))


_OPCOUNT = " + ".join(f"(length({_Q}) - length(replace({_Q}, '{o}', ''))) // {len(o)}" for o in text.OPERATORS)


@query(f"select {_OPCOUNT} as operator_count, count(*) as n from query_log where {_Q} is not null group by 1")
def search_operator_counts(spark, sf):
    return an.operator_counts(log(spark, sf))


_HITS = " union all ".join(f"select dataset, unnest(regexp_extract_all({_Q}, '({p})', 1)) as entity, '{n}' as entity_label, {s} as score from query_log where {_Q} is not null" for n, p, s in text.RECOGNISERS)


@query(f"select entity_label, count(*) as n from ({_HITS}) where score >= 0.7 group by 1")
def pii_labels(spark, sf):
    """One count for each hit."""
    return an.group_pii(an.pii(log(spark, sf)))


@query(f"select entity, entity_label, count(*) as n from ({_HITS}) group by all")
def pii_entities(spark, sf):
    return an.pii_entities(log(spark, sf))


@query(f"""select dataset, entity_label, n, size, round(n / size, 6) as share from (select dataset, entity_label, count(*) as n from ({_HITS}) where score >= 0.7 group by all)
  join (select dataset, count(*) as size from query_log group by 1) using (dataset)""")
def pii_shares(spark, sf):
    """Hits of each label by the size of the log."""
    rows = log(spark, sf)
    hits = rows.where(F.col(QUERY).isNotNull()).select("dataset", F.explode(text.pii_labels(F.col(QUERY))).alias("entity_label"))
    sizes = agg.group_count(rows, "dataset").withColumnRenamed("n", "size")
    return agg.share_of_sizes(agg.group_count(hits, "dataset", "entity_label"), sizes, ["dataset"]).withColumn("share", F.round("share", 6))


# lengths


@query(f"select {_Q}, length({_Q}) as character_count, len({_TOKENS}) as word_count, {_ENTITY_COUNT} as entity_count from query_log where {_Q} is not null")
def query_lengths(spark, sf):
    return an.get_lengths(log(spark, sf))


@query(f"select word, count(*) as n, length(word) as character_count from {_WORDS} group by word")
def word_lengths(spark, sf):
    return an.get_lengths(an.extract_words(log(spark, sf)), "words")


@query(f"select entity, entity_label, count(*) as n, length(entity) as character_count, len(regexp_extract_all(entity, '{text.TOKEN.replace(chr(39), chr(39) * 2)}')) as word_count from {_ENTITIES} group by entity, entity_label")
def entity_lengths(spark, sf):
    return an.get_lengths(an.extract_entities(log(spark, sf)), "named-entities")


@query(f"select length({_Q}) as character_count, count(*) as n from query_log where {_Q} is not null group by 1")
def char_count_frequencies(spark, sf):
    return an.REGISTRY["character-count-frequencies"](an.get_lengths(log(spark, sf)))


@query(f"select len({_TOKENS}) as word_count, count(*) as n from query_log where {_Q} is not null group by 1")
def word_count_frequencies(spark, sf):
    return an.REGISTRY["word-count-frequencies"](an.get_lengths(log(spark, sf)))


@query(f"select {_ENTITY_COUNT} as entity_count, count(*) as n from query_log where {_Q} is not null group by 1")
def entity_count_frequencies(spark, sf):
    return an.REGISTRY["entity-count-frequencies"](an.get_lengths(log(spark, sf)))


@query("select length(word) as character_count, count(*) as n from (select distinct word from extract_words where word is not null) group by 1")
def word_length_frequencies(spark, sf):
    """Of distinct words, as the published distributions are."""
    return an.length_frequencies(an.get_lengths(an.merge_words(table(spark, sf, "extract_words")), "words"), "character_count")


@query("select length(word) as character_count, cast(sum(n) as bigint) as n from extract_words where word is not null group by 1")
def word_length_frequencies_weighted(spark, sf):
    return an.length_frequencies(an.get_lengths(an.merge_words(table(spark, sf, "extract_words")), "words"), "character_count", weighted=True)


@query(f"select len(list_filter(regexp_split_to_array({_Q}, '[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x0b]+'), lambda x: x <> '')) as word_count, count(*) as n from query_log where {_Q} is not null group by 1")
def query_length_words(spark, sf):
    return an.query_length_words(log(spark, sf))


@query(f"select dataset, length({_Q}) as character_count, {_Q}, count(*) as n from query_log where length({_Q}) between 4 and 25 group by 1, 2, 3 qualify row_number() over (partition by dataset, length({_Q}) order by count(*) desc, {_Q}) <= 10")
def top_by_length(spark, sf):
    rows = log(spark, sf).withColumn("character_count", text.char_count(F.col(QUERY))).where("character_count between 4 and 25")
    return win.top_k(agg.group_count(rows, "dataset", "character_count", QUERY), 10, ["dataset", "character_count"], [F.desc("n"), QUERY]).drop("rank")


@query(f"select record_id from query_log where length({_Q}) between 1 and 49 and len({_TOKENS}) between 1 and 7 and {_ENTITY_COUNT} between 0 and 2")
def length_ranges(spark, sf):
    t = F.col(QUERY)
    return log(spark, sf).where(F.length(t).between(1, 49) & text.token_count(t).between(1, 7) & F.size(text.entities(t)).between(0, 2)).select("record_id")


# models


@query(f"""select case when regexp_matches(lower({_Q}), '{text.URL}') or regexp_matches(lower({_Q}), '{text.NAVIGATIONAL}') then 'Navigational'
  when regexp_matches(lower({_Q}), '{text.TRANSACTIONAL}') then 'Transactional' else 'Informational' end as query_intent, count(*) as n from query_log where {_Q} is not null group by 1""")
def query_intent(spark, sf):
    return an.query_intent(log(spark, sf))


def _question_sql(closed: bool) -> str:
    words = lambda names: ", ".join(f"'{x}'" for x in names)
    esc = lambda p: p.replace("'", "''")
    rest = f"regexp_replace(lower(s), '{esc(q.PHRASES)}', '')"
    first = lambda x: f"regexp_replace(regexp_replace(regexp_extract({x}, '{esc(q.FIRST)}', 1), 'n''t$', ''), '''(s|re|ll|ve|d|m)?$', '')"
    inter = f"regexp_replace(regexp_replace({first(f'regexp_replace({rest}, {chr(39)}{q.ONE_HELPER}{chr(39)}, {chr(39)}{chr(39)})')}, 'ever$', ''), 'so$', '') in ({words(q.INTERROGATIVES)})"
    aux = f"{first(rest)} in ({words(q.AUXILIARIES)})"
    verb = f"regexp_matches(lower(s), '{esc(q.VERB)}')"
    test = f"s like '%?' and {verb} and not {inter} and {aux}" if closed else f"{verb} and ({inter} or (s like '%?' and {aux}))"
    return f"""select flag as {'is_closed_question' if closed else 'is_question'}, count(*) as n from (
      select record_id, bool_or({test}) as flag from (
        select record_id, unnest(list_concat([{_Q}], string_split(regexp_replace({_Q}, '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1)))) as s from query_log where {_Q} is not null)
      group by record_id) group by 1"""


@query(_question_sql(False))
def question_counts(spark, sf):
    return an.question_counts(log(spark, sf))


def _flags_sql() -> str:
    inner = _question_sql(False)
    inner = inner[inner.index("from (") + 6 : inner.rindex(") group by 1")].replace("select record_id, bool_or", "select dataset, record_id, bool_or").replace("select record_id, unnest", "select dataset, record_id, unnest").replace("group by record_id", "group by dataset, record_id")
    return f"select dataset, count(*) as n, round(count(*) / any_value(t), 6) as share from (select *, count(*) over (partition by dataset) as t from ({inner})) where flag group by 1"


@query(_flags_sql())
def question_ratio(spark, sf):
    """What part of each log's texts are questions."""
    flags = log(spark, sf).where(F.col(QUERY).isNotNull()).select("dataset", q.is_question(F.col(QUERY)).alias("is_question"))
    shares = win.normalised(agg.group_count(flags, "dataset", "is_question"), ["dataset"])
    return flt.flagged(shares, "is_question").select("dataset", "n", F.round("p", 6).alias("share"))


@query(_question_sql(True))
def closed_questions(spark, sf):
    return agg.group_count(log(spark, sf).where(F.col(QUERY).isNotNull()).select(q.is_closed_question(F.col(QUERY)).alias("is_closed_question")), "is_closed_question")


_DRAW = "('0x' || substr(md5('42|' || {0}), 1, 12))::bigint"


@query(f"select {_Q}, 64 as numbers from query_log where {_DRAW.format(_Q)} % 1000000 < 100000")
def embeddings_sample(spark, sf):
    """The texts of the sample and how many numbers the vector of each has."""
    return an.embeddings(log(spark, sf)).select(QUERY, F.size("embeddings").alias("numbers"))


@query(f"select record_id, {_Q} from query_log order by {_DRAW.format('record_id')}, record_id limit 500")
def sample_to_size(spark, sf):
    return sampling.to_size(log(spark, sf).select("record_id", QUERY), 500, "record_id")


@query(f"""select d as draw, record_id from (select unnest(range(2000)) as d) join (select record_id, row_number() over (order by record_id) - 1 as pos, count(*) over () as n from query_log)
  on pos = {_DRAW.format('d')} % n""")
def resampled(spark, sf):
    """2,000 rows with replacement."""
    return sampling.resample(log(spark, sf).select("record_id"), 2000, "record_id")


# time


@query(f"select {_Q}, serp_timestamp, strftime({_TS}, '%Y-%W') as time from query_log where serp_timestamp is not null")
def weekly_buckets(spark, sf):
    return an.transform_timestamps(log(spark, sf))


@query(f"select {_YEAR} as year, {_Q}, count(*) as n from query_log where {_Q} is not null and serp_timestamp is not null group by all")
def query_chart_by_year(spark, sf):
    return an.chart_by_year(log(spark, sf))


_CHART = f"(select {_YEAR} as year, {_Q}, count(*) as n from query_log where {_Q} is not null and serp_timestamp is not null and dataset = 'DS' group by all)"
_TOP25 = f"(select * from {_CHART} qualify row_number() over (partition by year order by n desc, {_Q}) <= 25)"


@query(f"select * from {_TOP25.replace('DS', 'aql')}")
def annual_top_queries(spark, sf):
    return an.annual_top(an.chart_by_year(log(spark, sf, "aql")))


_HEAD = f"(select {_Q} from query_log where {_Q} is not null and serp_timestamp is not null group by 1 order by count(*) desc, 1 limit 100)"
_MONTHLY = f"(select {_MONTH} as time, {_Q}, count(*) as n from query_log where serp_timestamp is not null and {_Q} in (select * from {_HEAD}) group by all)"


@query("select time, strptime(time || '-01', '%Y-%m-%d')::date as first_day, n from " + f"(select {_MONTH} as time, count(*) as n from query_log where serp_timestamp is not null group by 1)")
def month_days(spark, sf):
    """Months parsed back to days."""
    return an.monthly_counts(log(spark, sf)).select("time", time.parse_month(F.col("time")).alias("first_day"), "n")


@query(f"select * from {_MONTHLY}")
def temporal_query_frequency(spark, sf):
    return an.temporal_frequency(log(spark, sf))


@query(f"select {_MONTH} as time, count(*) as n from query_log where serp_timestamp is not null group by 1")
def monthly_totals(spark, sf):
    return an.monthly_counts(log(spark, sf))


@query(f"select {_YEAR} as year, {_RLIKE(text.URL)} as is_url, count(*) as n from query_log where {_Q} is not null and serp_timestamp is not null group by all")
def url_proportion_by_year(spark, sf):
    return an.url_proportion(log(spark, sf))


@query(f"""select year, cast(sum(n) filter (where f) as bigint) as hit, cast(sum(n) filter (where not f) as bigint) as miss, round(coalesce(sum(n) filter (where f), 0) / sum(n), 6) as ratio
  from (select {_YEAR} as year, {_RLIKE(text.URL)} as f, count(*) as n from query_log where {_Q} is not null and serp_timestamp is not null group by all) group by year""".replace("cast(sum(n) filter (where f) as bigint)", "cast(coalesce(sum(n) filter (where f), 0) as bigint)").replace("cast(sum(n) filter (where not f) as bigint)", "cast(coalesce(sum(n) filter (where not f), 0) as bigint)"))
def url_ratio_by_year(spark, sf):
    return agg.annual_flags(an.url_proportion(log(spark, sf)), "is_url")


@query(f"select {_RLIKE(text.EMAIL)} as is_email, count(*) as n from query_log where {_Q} is not null group by 1")
def email_proportion(spark, sf):
    return an.email_proportion(log(spark, sf))


@query(f"select contains({_Q}, '{text.REPLACEMENT}') as is_repl_char, {_YEAR} as year, count(*) as n from query_log where {_Q} is not null and {_YEAR} between 1998 and 2022 group by all")
def repl_char_proportion(spark, sf):
    return an.replacement_proportion(log(spark, sf))


@query(f"select word from {_WORDS} where year({_TS}) between 2000 and 2006 and true and serp_timestamp is not null".replace(_WORDS, f"(select serp_timestamp, unnest({_TOKENS}) as word from query_log where {_Q} is not null and not contains({_Q}, '{text.REPLACEMENT}'))"))
def words_2000_2006(spark, sf):
    return an.words_of_years(log(spark, sf))


# sets, overlaps, series


@query("select dataset, record_id from query_log where dataset in ('aol', 'orcas')")
def union_logs(spark, sf):
    return sets.union_logs(log(spark, sf, "aol"), log(spark, sf, "orcas")).select("dataset", "record_id")


def _overlap_sql(v: str) -> str:
    return f"""select cast(sum(a) as bigint) as a, cast(sum(b) as bigint) as b, count(*) as either, cast(sum(a * b) as bigint) as both, round(sum(a * b) / sum(a), 6) as share_a, round(sum(a * b) / sum(b), 6) as share_b
    from (select v, max(a) as a, max(b) as b from (select {v} as v, case dataset when 'aql' then 1 else 0 end as a, case dataset when 'aol' then 1 else 0 end as b from query_log where dataset in ('aql', 'aol')) where v is not null group by v)"""


@query(_overlap_sql(_Q))
def log_overlap_exact(spark, sf):
    return an.overlap_report(log(spark, sf, "aql"), log(spark, sf, "aol"))


@query(_overlap_sql(f"lower({_Q})"))
def log_overlap_lower(spark, sf):
    return agg.log_overlap(log(spark, sf, "aql"), log(spark, sf, "aol"), F.lower(QUERY))


def _close(estimate: str, exact: str, scale: str):
    """An estimate is within three standard errors of what it estimates (of the union's, for a difference of counts)."""
    return (F.abs(F.col(estimate) - F.col(exact)) <= F.greatest(F.lit(3.0), 0.03 * F.col(scale))).alias(f"{exact}_close")


@query(f"select a, b, either, \"both\", true as a_close, true as b_close, true as both_close from ({_overlap_sql(_Q)})")
def log_overlap_hll(spark, sf):
    """The exact counts, and whether the sketches' are close to them."""
    own, other = log(spark, sf, "aql"), log(spark, sf, "aol")
    exact = an.overlap_report(own, other).select("a", "b", "either", "both")
    sketch = an.overlap_report(own, other, exact=False).select(*[F.col(c).alias(f"e_{c}") for c in ("a", "b", "both")])
    return exact.join(sketch, F.lit(True)).select("a", "b", "either", "both", *[_close(f"e_{c}", c, "either") for c in ("a", "b", "both")])  # one row each


_PAIR_FLAGS = f"(select v, max(case dataset when 'aol' then 1 else 0 end) as aol, max(case dataset when 'aql' then 1 else 0 end) as aql, max(case dataset when 'ms-marco' then 1 else 0 end) as ms, max(case dataset when 'orcas' then 1 else 0 end) as orcas from (select {_Q} as v, dataset from query_log where {_Q} is not null) group by v)"
_PAIR_ROWS = " union all ".join(f"""select '{a}' as ds1, '{b}' as ds2, cast(sum({x}) as bigint) as a, cast(sum({y}) as bigint) as b, cast(sum(greatest({x}, {y})) as bigint) as either, cast(sum({x} * {y}) as bigint) as both,
  count(*) as all_logs from {_PAIR_FLAGS}""" for a, x, b, y in (("aol", "aol", "aql", "aql"), ("aol", "aol", "ms-marco", "ms"), ("aol", "aol", "orcas", "orcas"), ("aql", "aql", "ms-marco", "ms"), ("aql", "aql", "orcas", "orcas"), ("ms-marco", "ms", "orcas", "orcas")))


@query(f"select *, round(\"both\" / a, 6) as share_a, round(\"both\" / b, 6) as share_b, round(\"both\" / all_logs, 6) as share_all from ({_PAIR_ROWS})")
def log_overlap_all(spark, sf):
    return agg.pair_overlaps(log(spark, sf), "dataset", F.col(QUERY), LOGS)


@query(f"select ds1, ds2, a, b, either, \"both\", true as a_close, true as b_close, true as both_close from ({_PAIR_ROWS})")
def log_overlap_all_hll(spark, sf):
    exact = agg.pair_overlaps(log(spark, sf), "dataset", F.col(QUERY), LOGS)
    sketch = agg.pair_overlap_estimates(log(spark, sf), "dataset", F.col(QUERY), LOGS).select("ds1", "ds2", *[F.col(c).alias(f"e_{c}") for c in ("a", "b", "both")])
    return exact.join(sketch, ["ds1", "ds2"]).select("ds1", "ds2", "a", "b", "either", "both", *[_close(f"e_{c}", c, "either") for c in ("a", "b", "both")])


def _annual_sql(v: str) -> str:
    return f"""with b as (select distinct {v} as v from query_log where dataset = 'aol' and {_Q} is not null),
    a as (select distinct {_YEAR} as year, {v} as v from query_log where dataset = 'aql' and {_Q} is not null and {_YEAR} between 1999 and 2022),
    y as (select unnest(range(1999, 2023)) as year)
    select y.year, count(a.v) as a, (select count(*) from b) as b, count(b.v) as both, round(count(b.v) / nullif(count(a.v), 0), 6) as share_a, round(count(b.v) / nullif((select count(*) from b), 0), 6) as share_b
    from y left join a on a.year = y.year left join b on b.v = a.v group by y.year"""


@query(_annual_sql(_Q))
def annual_overlap_exact(spark, sf):
    return an.annual_overlap(log(spark, sf, "aql"), log(spark, sf, "aol"))


@query(_annual_sql(f"lower({_Q})"))
def annual_overlap_lower(spark, sf):
    return an.annual_overlap_lower(log(spark, sf, "aql"), log(spark, sf, "aol"))


@query(f"select year, a, \"both\", true as a_close, true as both_close from ({_annual_sql(_Q)})")
def annual_overlap_hll(spark, sf):
    """The exact counts of each year, and whether the sketches' are close to them (an overlap by the size of the union)."""
    own, other = log(spark, sf, "aql"), log(spark, sf, "aol")
    exact = an.annual_overlap(own, other).select("year", "a", "b", "both")
    sketch = an.annual_overlap(own, other, exact=False).select("year", F.col("a").alias("e_a"), F.col("both").alias("e_both"))
    rows = exact.join(sketch, "year").withColumn("either", F.col("a") + F.col("b") - F.col("both"))
    return rows.select("year", "a", "both", _close("e_a", "a", "either"), _close("e_both", "both", "either"))


@query(f"select a.year, a.{_Q}, a.n from {_TOP25.replace('DS', 'aql')} a where (a.year, a.{_Q}) in (select (year, {_Q}) from {_TOP25.replace('DS', 'aol')})")
def annual_top_shared(spark, sf):
    a, b = (an.annual_top(an.chart_by_year(log(spark, sf, d))) for d in ("aql", "aol"))
    return sets.shared_top(a, b, ["year", QUERY])


_TOP_WORDS = f"(select dataset, word from (select dataset, word, count(*) as n from {_WORDS} group by all) qualify row_number() over (partition by dataset order by n desc, word) <= 20)"


def _top_words(spark, sf) -> DataFrame:
    rows = log(spark, sf).where(F.col(QUERY).isNotNull()).select("dataset", F.explode(text.tokens(F.col(QUERY))).alias("word"))
    return win.top_k(agg.group_count(rows, "dataset", "word"), 20, ["dataset"], [F.desc("n"), "word"])


@query(f"select a.dataset as ds1, b.dataset as ds2, count(*) as shared from {_TOP_WORDS} a join {_TOP_WORDS} b on a.word = b.word and a.dataset < b.dataset group by all")
def top_word_overlap(spark, sf):
    return sets.pairwise_shared(_top_words(spark, sf), "dataset", "word")


_SHARED_SIZES = f"""(select p.ds1, p.ds2, count(b.word) as shared from (select a.d as ds1, b.d as ds2 from (select unnest(['aol', 'aql', 'ms-marco', 'orcas']) as d) a, (select unnest(['aol', 'aql', 'ms-marco', 'orcas']) as d) b where a.d < b.d) p
  left join {_TOP_WORDS} a on a.dataset = p.ds1 left join {_TOP_WORDS} b on b.dataset = p.ds2 and b.word = a.word group by all)"""


@query(f"""select round(avg(shared) filter (where 'aql' in (ds1, ds2)), 6) as target_mean, round(avg(shared) filter (where 'aql' not in (ds1, ds2)), 6) as rest_mean,
  round(var_pop(shared) filter (where 'aql' not in (ds1, ds2)), 6) as rest_var, round(stddev_pop(shared) filter (where 'aql' not in (ds1, ds2)), 6) as rest_std from {_SHARED_SIZES}""")
def top_word_overlap_statistics(spark, sf):
    rows = sets.overlap_statistics(_top_words(spark, sf), "dataset", "word", LOGS, "aql")
    return rows.select(*[F.round(c, 6).alias(c) for c in rows.columns])


@query(f"select dataset, entity_label, count(*) as n from ({_HITS}) group by 1, 2 qualify count(*) over (partition by entity_label) = 4")
def common_labels(spark, sf):
    rows = log(spark, sf).where(F.col(QUERY).isNotNull()).select("dataset", F.explode(text.pii_labels(F.col(QUERY), 0.0)).alias("entity_label"))
    return sets.in_all(agg.group_count(rows, "dataset", "entity_label"), "dataset", "entity_label", 4)


_GRID = f"(select {_Q}, strftime(t, '%Y-%m') as time from (select distinct {_Q} from {_MONTHLY}), (select unnest(generate_series(timestamp '2004-01-01', timestamp '2022-12-01', interval 1 month)) as t))"
_DENSE = f"(select time, {_Q}, coalesce(n, 0) as n from {_GRID} left join {_MONTHLY} using (time, {_Q}))"
_SHARE = f"(select d.time, d.{_Q}, d.n, d.n / coalesce(t.n, 1) as share from {_DENSE} d left join (select {_MONTH} as time, count(*) as n from query_log where serp_timestamp is not null group by 1) t on t.time = d.time)"


def _popularity(spark, sf) -> DataFrame:
    dense = series.dense_months(an.temporal_frequency(log(spark, sf)), QUERY)
    return series.share_of_total(dense, an.monthly_counts(log(spark, sf)), QUERY)


@query(f"select time, {_Q}, n, round(share, 6) as share, coalesce(round_even(100 * share / nullif(max(share) over (partition by {_Q}), 0), 2), null) as score from {_SHARE}")
def month_spine_popularity(spark, sf):
    p = _popularity(spark, sf)
    top = F.max("share").over(W.partitionBy(QUERY))
    return p.select("time", QUERY, "n", F.round("share", 6).alias("share"), F.bround(F.try_divide(100 * F.col("share"), top), 2).alias("score"))


@query(f"""with a as (select {_MONTH} as time, {_Q}, count(*) as n from query_log where serp_timestamp is not null and dataset = 'aql' and {_Q} in (select * from {_HEAD}) group by all),
  b as (select {_MONTH} as time, {_Q}, count(*) as n from query_log where serp_timestamp is not null and dataset = 'aol' and {_Q} in (select * from {_HEAD}) group by all),
  m as (select strftime(t, '%Y-%m') as time from (select unnest(generate_series(timestamp '2004-01-01', timestamp '2022-12-01', interval 1 month)) as t)),
  u as (select m.time, i.{_Q}, coalesce(a.n, 0) as x from m, (select distinct {_Q} from a) i left join a on a.time = m.time and a.{_Q} = i.{_Q}),
  v as (select m.time, i.{_Q}, coalesce(b.n, 0) as y from m, (select distinct {_Q} from b) i left join b on b.time = m.time and b.{_Q} = i.{_Q})
  select {_Q}, case when stddev_pop(x) > 1e-6 and stddev_pop(y) > 1e-6 then round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 6) end as correlation from u join v using (time, {_Q}) group by 1""")
def temporal_correlation(spark, sf):
    return _correlations(spark, sf).withColumn("correlation", F.round("correlation", 6))


def _correlations(spark, sf) -> DataFrame:
    all_rows = log(spark, sf)
    timed = all_rows.where(F.col(TIMESTAMP).isNotNull() & F.col(QUERY).isNotNull())
    head = [r[0] for r in win.top_n(agg.group_count(timed, QUERY), 100, [F.desc("n"), QUERY]).collect()]  # 100 texts
    a, b = (series.dense_months(an.temporal_frequency(log(spark, sf, d), head), QUERY) for d in ("aql", "aol"))
    return series.correlation(a, b, QUERY, "n")


@query(f"select {_Q}, correlation from ({SQL['temporal_correlation']}) where correlation is not null order by correlation desc, {_Q} limit 9 offset 4")
def top_correlations(spark, sf):
    """The fifth to thirteenth highest."""
    rows = _correlations(spark, sf).withColumn("correlation", F.round("correlation", 6)).where("correlation is not null")
    return win.slice_of(rows, 4, 9, [F.desc("correlation"), QUERY])


@query(f"select {_Q}, round(sum(1 / (60 + r)), 6) as rrf from (select {_Q}, row_number() over (partition by year order by n desc, {_Q}) as r from {_TOP25.replace('DS', 'aql')}) group by 1")
def rrf_score(spark, sf):
    ranked = win.top_k(an.chart_by_year(log(spark, sf, "aql")), 25, ["year"], [F.desc("n"), QUERY])
    return win.reciprocal_rank_fusion(ranked, QUERY).withColumn("rrf", F.round("rrf", 6))


@query(f"select year, {_Q}, n, round_even(100 * n / max(n) over (partition by year), 0) as score from {_TOP25.replace('DS', 'aql')}")
def max_scaled_scores(spark, sf):
    return win.max_scaled(an.annual_top(an.chart_by_year(log(spark, sf, "aql"))), ["year"])


_TOTALS = f"(select {_MONTH} as time, count(*) as n from query_log where serp_timestamp is not null group by 1)"


@query(f"select time, n, round((n - min(n) over ()) * 100 / nullif(max(n) over () - min(n) over (), 0), 6) as scaled, round((n - avg(n) over ()) / nullif(stddev_pop(n) over (), 0), 6) as z from {_TOTALS}")
def scaled_months(spark, sf):
    rows = an.monthly_counts(log(spark, sf)).withColumn("all", F.lit(1))  # as many rows as months
    both = win.standardised(win.min_max_scaled(rows, ["all"], "n"), ["all"], "n")
    return both.select("time", "n", F.round("scaled", 6).alias("scaled"), F.round("z", 6).alias("z"))


# distributions

_WORD_N = f"(select dataset, word, count(*) as n from {_WORDS} group by all)"


def _word_counts(spark, sf) -> DataFrame:
    rows = log(spark, sf).where(F.col(QUERY).isNotNull()).select("dataset", F.explode(text.tokens(F.col(QUERY))).alias("word"))
    return agg.group_count(rows, "dataset", "word")


_STEPS = f"(select dataset, n, count(*) as elements from {_WORD_N} group by all)"


@query(f"""select dataset, n, elements, cast(sum(elements) over w as bigint) as last_rank, cast(sum(elements) over w - elements + 1 as bigint) as first_rank,
  round(sum(n * elements) over w / sum(n * elements) over (partition by dataset), 6) as share_to from {_STEPS} window w as (partition by dataset order by n desc rows unbounded preceding)""")
def rank_size(spark, sf):
    return win.count_steps(_word_counts(spark, sf), ["dataset"]).select("dataset", "n", "elements", "last_rank", "first_rank", F.round("share_to", 6).alias("share_to"))


@query(f"""select dataset, count(*) filter (where s < 0.5) as x_max from (select dataset, sum(n) over (partition by dataset order by n desc, word rows unbounded preceding) / sum(n) over (partition by dataset) as s from {_WORD_N}) group by 1""")
def running_share_cut(spark, sf):
    return win.ranks_below(_word_counts(spark, sf), ["dataset"], 0.5)


_LENGTHS = f"(select dataset, length({_Q}) as x, count(*) as n from query_log where {_Q} is not null group by all)"


def _lengths(spark, sf) -> DataFrame:
    return agg.group_count(log(spark, sf).where(F.col(QUERY).isNotNull()).select("dataset", text.char_count(F.col(QUERY)).alias("x")), "dataset", "x")


@query(f"select dataset, x, n, round(sum(n) over (partition by dataset order by x rows unbounded preceding) / sum(n) over (partition by dataset), 6) as share from {_LENGTHS}")
def running_length_share(spark, sf):
    return win.running_share(_lengths(spark, sf), ["dataset"], "x").withColumn("share", F.round("share", 6))


@query(f"select dataset, max(x) as x_max from (select *, max(n) over (partition by dataset) as m from {_LENGTHS}) where n > 0.01 * m group by 1")
def relative_height_cut(spark, sf):
    return win.relative_height_cut(_lengths(spark, sf), ["dataset"], "x", 0.01)


@query(f"select dataset, x, round(n / sum(n) over (partition by dataset), 6) as p, round(100 * n / sum(n) over (partition by dataset), 5) as percent from {_LENGTHS}")
def length_percentages(spark, sf):
    p = win.normalised(_lengths(spark, sf), ["dataset"])
    return p.select("dataset", "x", F.round("p", 6).alias("p"), F.round(100 * F.col("p"), 5).alias("percent"))


def _paired(source: str) -> str:
    """(ds1, ds2, x, n1, n2) over the union of two supports."""
    return f"""src as (select dataset, x, n from {source}),
    ds as (select distinct dataset from src),
    pr as (select a.dataset as ds1, b.dataset as ds2 from ds a join ds b on a.dataset < b.dataset),
    pairs as (select ds1, ds2, x, sum(case when dataset = ds1 then n else 0 end) as n1, sum(case when dataset = ds2 then n else 0 end) as n2 from pr join src on dataset in (ds1, ds2) group by all),
    sh as (select *, n1 / sum(n1) over (partition by ds1, ds2) as p, n2 / sum(n2) over (partition by ds1, ds2) as q from pairs),
    cu as (select *, sum(p) over w as f, sum(q) over w as g, lead(x) over (partition by ds1, ds2 order by x) - x as gap from sh window w as (partition by ds1, ds2 order by x rows unbounded preceding))"""


_W1 = f"with {_paired(_LENGTHS)} select ds1, ds2, round(sum(abs(f - g) * coalesce(gap, 0)), 4) as distance from cu group by all"


@query(_W1)
def w1_lengths(spark, sf):
    return stats.wasserstein(stats.paired(_lengths(spark, sf), LOGS)).withColumn("distance", F.round("distance", 4))


_RANKED = f"(select dataset, n, row_number() over w as x, sum(n) over (partition by dataset order by n desc, word rows unbounded preceding) / sum(n) over (partition by dataset) as s from {_WORD_N} window w as (partition by dataset order by n desc, word))"
_RANKS = f"(select dataset, x, n from {_RANKED} where x <= (select max(k) from (select count(*) filter (where s < 0.957) as k from {_RANKED} group by dataset)))"


@query(f"with {_paired(_RANKS)} select ds1, ds2, round(sum(abs(f - g) * coalesce(gap, 0)), 3) as distance from cu group by all")
def w1_rank_size(spark, sf):
    """Rank-size curves to the most ranks of any log below a cumulative share of 0.957."""
    return stats.rank_wasserstein(_word_counts(spark, sf), LOGS).withColumn("distance", F.round("distance", 3))


_INTENT = SQL["query_intent"].replace("select case", "select dataset, case").replace("as query_intent", "as x").replace("group by 1", "group by all")


def _intents(spark, sf) -> DataFrame:
    return agg.group_count(log(spark, sf).where(F.col(QUERY).isNotNull()).select("dataset", text.intent(F.col(QUERY)).alias("x")), "dataset", "x")


_COMMON_INTENT = f"(select dataset, x, n from (select *, sum(n) over (partition by dataset) as t from ({_INTENT})) where n > 0.004 * t)"


def _tv(spark, sf) -> DataFrame:
    rows = _intents(spark, sf).withColumn("t", F.sum("n").over(W.partitionBy("dataset"))).where("n > 0.004 * t")
    return stats.total_variation(stats.paired(rows, LOGS))


_TV = f"with {_paired(_COMMON_INTENT)} select ds1, ds2, round(sum(abs(p - q)) / 2, 6) as distance from sh group by all"


@query(_TV)
def tv_distance(spark, sf):
    return _tv(spark, sf).withColumn("distance", F.round("distance", 6))


@query(f"""with {_paired(_LENGTHS)} select ds1, ds2, round(max(abs(f - g)), 6) as statistic, round(1.36 * sqrt((sum(n1) + sum(n2)) / (sum(n1) * sum(n2))), 6) as threshold,
  max(abs(f - g)) <= 1.36 * sqrt((sum(n1) + sum(n2)) / (sum(n1) * sum(n2))) as same from cu group by all""")
def ks_test(spark, sf):
    rows = stats.kolmogorov_smirnov(stats.paired(_lengths(spark, sf), LOGS))
    return rows.select("ds1", "ds2", F.round("statistic", 6).alias("statistic"), F.round("threshold", 6).alias("threshold"), "same")


# fixed values in the SQL: the 95 % quantiles of chi-square for one and two degrees of freedom
@query(f"""with {_paired(f'({_INTENT})')}, e as (select *, sum(n1) over (partition by ds1, ds2) * q as e from sh where n2 > 0),
  c as (select ds1, ds2, sum((n1 - e) * (n1 - e) / e) as v, count(*) as k from e group by all), t as (select *, case k when 1 then 0.0 when 2 then 3.841459 when 3 then 5.991465 end as threshold from c)
  select ds1, ds2, round(v, 3) as statistic, round(threshold, 4)::double as threshold, v <= threshold as same from t""")
def chi2_statistic(spark, sf):
    rows = stats.chi_square(stats.paired(_intents(spark, sf), LOGS))
    return rows.select("ds1", "ds2", F.round("statistic", 3).alias("statistic"), F.round("threshold", 4).alias("threshold"), "same")


@query(f"with {_paired(_LENGTHS)} select ds1, ds2, round(2 * sum(p * ln(p / q)), 6) as statistic from sh where n1 > 0 and n2 > 0 group by all")
def g_test(spark, sf):
    return stats.g_statistic(stats.paired(_lengths(spark, sf), LOGS), normal=True).withColumn("statistic", F.round("statistic", 6))


_DIST = _W1.replace("round(sum(abs(f - g) * coalesce(gap, 0)), 4)", "sum(abs(f - g) * coalesce(gap, 0))")


@query(f"""select round(avg(distance) filter (where 'aql' in (ds1, ds2)), 4) as target_mean, round(avg(distance) filter (where 'aql' not in (ds1, ds2)), 4) as rest_mean,
  round(stddev_pop(distance) filter (where 'aql' not in (ds1, ds2)), 4) as rest_std,
  round(avg(distance) filter (where 'aql' not in (ds1, ds2)) - avg(distance) filter (where 'aql' in (ds1, ds2)), 4) as deviation,
  round((avg(distance) filter (where 'aql' not in (ds1, ds2)) - avg(distance) filter (where 'aql' in (ds1, ds2))) / nullif(stddev_pop(distance) filter (where 'aql' not in (ds1, ds2)), 0), 4) as deviations from ({_DIST})""")
def group_similarity(spark, sf):
    rows = stats.group_similarity(stats.wasserstein(stats.paired(_lengths(spark, sf), LOGS)), "aql")
    return rows.select(*[F.round(c, 4).alias(c) for c in ("target_mean", "rest_mean", "rest_std", "deviation", "deviations")])


@query(f"select round(sum(distance) * 2 / 16, 4) as mean from ({_DIST})")
def matrix_mean(spark, sf):
    return stats.matrix_mean(stats.wasserstein(stats.paired(_lengths(spark, sf), LOGS)), 4).withColumn("mean", F.round("mean", 4))


@query(f"""select time, n, case when abs(z) < 0.5 then 0.0 when abs(z) < 1.5 then 0.6827 when abs(z) < 2.5 then 0.9545 when abs(z) < 3.5 then 0.9973 else 0.9999 end::double as coverage
  from (select time, n, (n - avg(n) over ()) / nullif(stddev_pop(n) over (), 0) as z from {_TOTALS})""")
def month_coverage(spark, sf):
    rows = win.standardised(an.monthly_counts(log(spark, sf)).withColumn("all", F.lit(1)), ["all"], "n")
    return rows.select("time", "n", stats.z_coverage(F.abs("z")).alias("coverage"))


@query()
def mds_coordinates(spark, sf):
    return stats.mds(stats.wasserstein(stats.paired(_lengths(spark, sf), LOGS)))


@query(f"select dataset, '{{' || string_agg('\"' || x || '\":' || n, ',' order by x) || '}}' as frequencies, cast(sum(n) as bigint) as total from {_LENGTHS} group by 1")
def length_maps(spark, sf):
    """The lengths of each log with their counts, as a JSON object in the order of the lengths."""
    pairs = F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("x", "n"))), lambda p: F.struct(p["x"].cast("string"), p["n"])))
    return _lengths(spark, sf).groupBy("dataset").agg(F.to_json(pairs).alias("frequencies"), F.sum("n").alias("total"))


# vectors


@query("select label, i - 1 as axis, round(avg(embedding[i]), 5) as mean from embeddings, unnest(range(1, 65)) r(i) group by all")
def embedding_centroids(spark, sf):
    return vectors.centroids(table(spark, sf, "embeddings"), "label", "embedding").select("label", F.col("axis").cast("long").alias("axis"), F.round("mean", 5).alias("mean"))


@query("""with m as (select i, avg(embedding[i]) as m from embeddings, unnest(range(1, 65)) r(i) where embedding is not null group by 1)
  select vec_id, round(sum((embedding[i] - m) * (embedding[i] - m)), 4) as size from embeddings, m where embedding is not null group by 1""")
def centred_embeddings(spark, sf):
    """The squared length of each vector less the mean of all."""
    rows = vectors.centred(table(spark, sf, "embeddings"), "embedding")
    return rows.where("embedding is not null").select("vec_id", F.round(F.aggregate("centred", F.lit(0.0), lambda a, x: a + x * x), 4).alias("size"))


@query()
def sliced_wasserstein(spark, sf):
    df = table(spark, sf, "embeddings").withColumn("cloud", F.col("label") % 2)
    return vectors.sliced_wasserstein(df, "cloud", "embedding", (0, 1), 64, projections=16_000)  # as many as the reference


@query()
def communities(spark, sf):
    return vectors.communities(table(spark, sf, "query_embeddings"), "emb_id", "embeddings", 64, 0.75, 5)


@query()
def principal_projection(spark, sf):
    return vectors.project(table(spark, sf, "query_embeddings"), "emb_id", "embeddings", 64)


# the same operators over the other tables


@query("select strftime(ts, '%Y-%W') as time, event_type, count(*) as n from events group by all")
def event_weeks(spark, sf):
    rows = table(spark, sf, "events").select(time.week(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("time"), "event_type")
    return agg.group_count(rows, "time", "event_type")


@query("select year(o_orderdate) as year, o_orderpriority, count(*) as n from orders group by 1, 2 qualify row_number() over (partition by year(o_orderdate) order by count(*) desc, o_orderpriority) <= 3")
def order_annual_top(spark, sf):
    rows = table(spark, sf, "orders").select(F.year("o_orderdate").cast("long").alias("year"), "o_orderpriority")
    return win.top_k(agg.group_count(rows, "year", "o_orderpriority"), 3, ["year"], [F.desc("n"), "o_orderpriority"]).drop("rank")


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by all")
def lineitem_counts(spark, sf):
    return agg.sorted_count(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query("select ch as char, count(*) as n from (select unnest(string_split(replace(text, ' ', ''), '')) as ch from documents) where ch <> '' group by 1")
def document_chars(spark, sf):
    return an.extract_chars(table(spark, sf, "documents").withColumnRenamed("text", QUERY))
