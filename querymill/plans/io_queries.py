"""Readers and writers as queries: what is written into the shared folder and read back must equal what SQL says of the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.operators import filters as flt
from querymill.operators import stats
from querymill.plans import queries as base
from querymill.schema import STANDARD
from querymill.session import new_path, table
from querymill.sources import catalog, readers, writers

QUERIES: dict = {}
SQL: dict[str, str] = {}
_Q = "serp_query_text_url"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _written(df: DataFrame, kind: str, **options) -> str:
    path = new_path(df.sparkSession, f"io-{kind}")
    writers.write(df, path, kind, **options)
    return path


@query(f"select record_id, {_Q} from query_log where serp_timestamp >= 1100000000")
def parquet_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Files of at most 5,000 rows; columns and a condition are pushed to the scan of what was written."""
    path = _written(base.log(spark, sf).select("record_id", _Q, "serp_timestamp", "dataset"), "parquet", rows_per_file=5000)
    return readers.read_parquet(spark, path, columns=["record_id", _Q], where=F.col("serp_timestamp") >= 1100000000)


@query("select record_id, word, n from extract_words where word is not null")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = _written(table(spark, sf, "extract_words").where("word is not null").select("record_id", "word", "n"), "csv", files=3)
    return readers.read_any(spark, path, "csv", schema="record_id long, word string, n long")


@query(f"select record_id, dataset, {_Q}, serp_timestamp from query_log")
def jsonl_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = _written(base.log(spark, sf).select("record_id", "dataset", _Q, "serp_timestamp"), "jsonl")
    return readers.read_any(spark, path, "jsonl", schema=f"record_id long, dataset string, {_Q} string, serp_timestamp long")


@query("select dataset, count(*) as n from query_log group by 1")
def json_object_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A small result as one JSON object, name by name."""
    path = new_path(spark, "io-object") + ".json"
    rows = base.agg.group_count(base.log(spark, sf), "dataset")
    writers.write_object(rows.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("dataset", "n"))).alias("counts")), path)
    read = spark.read.schema("counts map<string, long>").option("multiLine", True).json(path)
    return read.select(F.explode("counts").alias("dataset", "n"))


@query("select char from (select distinct char from extract_chars where char is not null) where not regexp_matches(char, '[\\n\\r]')")
def text_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    chars = table(spark, sf, "extract_chars").where(F.col("char").isNotNull() & ~F.col("char").rlike("[\n\r]")).select("char").distinct()
    return readers.read_any(spark, _written(chars, "txt"), "txt").withColumnRenamed("value", "char")


def _by_log(spark: SparkSession, sf: str) -> str:
    """The logs as one Parquet folder each, as the stages of a catalogue."""
    root = new_path(spark, "io-stages")
    for name in base.LOGS:
        writers.write(base.log(spark, sf, name).select("record_id", "dataset", _Q), f"{root}/{name}", files=1)
    return root


@query("select dataset, count(*) as n from query_log where dataset in ('aol', 'orcas') group by 1")
def stages_of_two_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Folders resolved by name and read together."""
    root = _by_log(spark, sf)
    return base.agg.group_count(base.sets.union_logs(*[catalog.load(spark, root, d, "sum-rows") for d in ("aol", "orcas")]), "dataset")


@query("select dataset, count(*) as n from query_log where dataset in ('aol', 'aql') group by 1")
def half_of_the_files(spark: SparkSession, sf: str) -> DataFrame:
    root = _by_log(spark, sf)
    paths = [p for d in base.LOGS for p in readers.files(spark, f"{root}/{d}", ".parquet")]
    return base.agg.group_count(spark.read.parquet(*readers.pick(paths, half="first")), "dataset")


@query("select dataset, count(*) as n from query_log where dataset = 'aol' group by 1")
def first_file(spark: SparkSession, sf: str) -> DataFrame:
    root = _by_log(spark, sf)
    paths = [p for d in base.LOGS for p in readers.files(spark, f"{root}/{d}", ".parquet")]
    return base.agg.group_count(spark.read.parquet(*readers.pick(paths, first=1)), "dataset")


@query("select dataset as key, count(*) as n from query_log group by 1")
def keys_from_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The log of each row told by the folder that its file lies in."""
    rows = readers.read_parquet(spark, *[f"{_by_log(spark, sf)}/{d}" for d in base.LOGS]).select(F.col("_metadata.file_path").alias("path"))
    return base.agg.group_count(rows.select(readers.key_from_path(pattern=r"([^/]+)/[^/]+$").alias("key")), "key")


@query("select 'sum-rows' as analysis_name, dataset, 'all' as sample_files, count(*) as n from query_log where dataset = 'aql' group by dataset")
def result_with_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """A finished analysis found by its name: of several folders the whole one counts, not a sample."""
    root = new_path(spark, "io-results")
    out = writers.with_metadata(base.an.sum_rows(base.log(spark, sf, "aql")), "sum-rows", ["aql"])
    writers.write(out, f"{root}/{writers.output_name(['aql'], 'sum-rows')}")
    writers.write(out.withColumn("n", F.lit(-1).cast("long")), f"{root}/{writers.output_name(['aql'], 'sum-rows', sample=5)}")
    return catalog.result(spark, root, "aql", "sum-rows")


_AOL = {"serp_id": "serp_id", "serp_query_text_url": _Q, "serp_timestamp": "serp_timestamp", "serp_offset": "serp_offset"}


@query("select record_id as n, " + ", ".join(_AOL.get(f.name, f"cast(null as {'bigint' if f.dataType.simpleString() == 'bigint' else 'varchar'})") + f" as {f.name}" for f in STANDARD.fields) + " from query_log where dataset = 'aol'")
def standardised_log(spark: SparkSession, sf: str) -> DataFrame:
    """One log under its raw names (with a column too many and the others missing), brought to the 17 standard fields."""
    raw = base.log(spark, sf, "aol").select("record_id", F.col("serp_id").alias("AnonID"), F.col(_Q).alias("Query"), F.from_unixtime("serp_timestamp").alias("QueryTime"), F.col("serp_offset").alias("ItemRank"), F.lit("x").alias("ClickURL"))
    back = spark.read.parquet(_written(raw, "parquet"))
    return readers.standardise(back, "aol", keep=["record_id"]).withColumnRenamed("record_id", "n")


@query(f"select record_id, coalesce(serp_query_text_url_language, '') as serp_query_text_url_language, coalesce(serp_page, 0) as serp_page from query_log")
def filled_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return readers.fill_nulls(base.log(spark, sf).select("record_id", "serp_query_text_url_language", "serp_page"))


@query("select count(*) filter (where feed <> 'x') as good, 2::bigint as rejected from raw_log_files")
def cleaned_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with a tab, with a blank, and two that can't be cut."""
    files = table(spark, sf, "raw_log_files")
    lines = files.select(F.when(F.col("file_id") % 2 == 0, F.concat(F.col("file_id").cast("string"), F.lit("\t"), "feed")).otherwise(F.concat(F.col("file_id").cast("string"), F.lit(" "), "feed")).alias("value"))
    bad = spark.createDataFrame([("alone",), ("a\tb\tc",)], "value string")
    good, rejected = readers.split_lines(spark, _written(lines.unionByName(bad), "txt"))
    return good.agg(F.count("*").alias("good")).join(rejected.agg(F.count("*").alias("rejected")), F.lit(True))


@query(f"select strftime(t, '%Y-%m') as item, case when n < 2 then 0.5 else n::double end as score from (select date_trunc('month', make_timestamp(serp_timestamp * 1000000)) as t, count(*) as n from query_log where serp_timestamp is not null group by 1)")
def trend_files(spark: SparkSession, sf: str) -> DataFrame:
    """A CSV file with two lines before its data, and scores of which the small ones are given as `<1`."""
    months = base.an.monthly_counts(base.log(spark, sf)).select(F.concat_ws(",", "time", F.when(F.col("n") < 2, "<1").otherwise(F.col("n").cast("string"))).alias("line"))
    whole = months.agg(F.concat_ws("\n", F.lit("Category: All"), F.lit("Month,score"), F.array_join(F.sort_array(F.collect_list("line")), "\n")).alias("value"))
    rows = readers.read_skipping(spark, _written(whole, "txt", files=1), 2)
    return rows.select("item", readers.trend_score().alias("score"))


@query(f"select case dataset when 'ms-marco' then 'MS-MARCO' else dataset end as dataset, count(*) as n from query_log group by 1")
def rewritten_labels(spark: SparkSession, sf: str) -> DataFrame:
    return base.agg.group_count(flt.rewritten(base.log(spark, sf), "dataset", {"ms-marco": "MS-MARCO"}), "dataset")


@query(f"select 'w1' as measure, ds1, ds2, distance from ({base.SQL['w1_lengths']}) union all select 'tv', ds1, ds2, distance from ({base.SQL['tv_distance']})")
def distance_table(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of logs in one table, written as CSV and read back."""
    tables = [base.QUERIES[q](spark, sf).select(F.lit(m).alias("measure"), "ds1", "ds2", "distance") for m, q in (("w1", "w1_lengths"), ("tv", "tv_distance"))]
    path = _written(tables[0].unionByName(tables[1]), "csv", files=1)
    return readers.read_any(spark, path, "csv", schema="measure string, ds1 string, ds2 string, distance double")


@query(f"select a.dataset as ds1, b.dataset as ds2, 0.0 as distance from (select distinct dataset from query_log) a, (select distinct dataset from query_log) b where a.dataset = b.dataset union all select ds1, ds2, distance from ({base.SQL['w1_lengths']}) union all select ds2, ds1, distance from ({base.SQL['w1_lengths']})")
def distance_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return stats.matrix(base.QUERIES["w1_lengths"](spark, sf))
