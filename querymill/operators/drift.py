"""Schemas that drift between the files of a feed: a lifespan catalogue of columns, the changes between files, and one
consistent table.

A catalogue has one row for each file and field with the field's type there. For each feed, field and type, lag() over the
files tells where a lifespan (an island of consecutive files) starts and where it ends; starts and endings that meet at the
same file are changes. What ended is matched with what began by the values in the records that both files hold.
The standard table is made by casts generated from an alias table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querymill.session import filesystem, materialise

# fixed values: names under which the feeds deliver each standard column (compared without case and underscores)
ALIASES = {
    "serp_query_text_url": ["serp_query_text_url", "query", "query_text", "q_text", "search_terms"],
    "serp_timestamp": ["serp_timestamp", "event_time", "query_time", "logged_at", "ts"],
    "search_provider_name": ["search_provider_name", "search_provider", "provider", "provider_name", "engine"],
    "search_provider_category": ["search_provider_category", "category", "vertical"],
    "search_provider_alexa_rank": ["search_provider_alexa_rank", "alexa_rank", "site_rank"],
    "serp_query_text_url_language": ["serp_query_text_url_language", "language", "lang", "text_lang"],
    "serp_page": ["serp_page", "page", "page_no", "result_page"],
    "serp_offset": ["serp_offset", "offset", "start_at", "item_rank"],
    "result_total": ["result_total", "hits", "n_results"],
    "from_cache": ["from_cache", "cached", "is_cached"],
    "elapsed": ["elapsed", "latency_s", "took"],
    "device": ["device", "client", "agent_kind"],
}
TYPES = {
    "serp_timestamp": "epoch", "search_provider_alexa_rank": "bigint", "serp_page": "bigint", "serp_offset": "bigint",
    "result_total": "bigint", "from_cache": "boolean", "elapsed": "double",
}


def json_type(value: Column) -> Column:
    """string, integer, double, boolean, object or array of a variant; null for a JSON null."""
    t = F.schema_of_variant(value)
    whole = F.try_to_number(F.regexp_extract(t, r"DECIMAL\((\d+),0\)", 1), F.lit("99"))
    return (
        F.when(t == "STRING", "string").when(t == "BIGINT", "integer").when(t == "BOOLEAN", "boolean")
        .when(t.startswith("DECIMAL") & (whole > 18), "integer")  # too long for a bigint, but without fraction
        .when(t.startswith("DECIMAL") | (t == "DOUBLE") | (t == "FLOAT"), "double").when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array")
    )


def _object(payload: Column) -> Column:
    """The top-level fields of a JSON object as a map of variants; null for what is null, no JSON or no object."""
    return F.try_parse_json(payload).try_cast("map<string, variant>")


def explode_fields(records: DataFrame, file_col: str, record_col: str, payload_col: str) -> DataFrame:
    """(file_id, record, field, type, value): one row for each top-level field of each JSON object. Payloads that are null, no JSON
    or no object have none. Numbers are given in one way, so that 39, 39.0 and the text 39 are equal values."""
    parsed = records.select(F.col(file_col).alias("file_id"), _object(F.col(payload_col)).alias("m")).where("m is not null")
    fields = parsed.select("file_id", F.col("m")[record_col].cast("string").alias("record"), F.explode("m").alias("field", "value"))
    text = F.col("value").cast("string")
    number = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    plain = F.when(text.contains(".") & text.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?$"), number).otherwise(text)
    return fields.select("file_id", "record", "field", json_type(F.col("value")).alias("type"), plain.alias("value"))


def ranked_files(files: DataFrame) -> DataFrame:
    """(file_id, feed, rank, files): the files of each feed in their true order, without gaps, and how many the feed has. Files without id or feed are left out."""
    feed = W.partitionBy("feed")
    return files.where("file_id is not null and feed is not null").select("file_id", "feed", F.row_number().over(feed.orderBy("file_seq", "file_id")).cast("long").alias("rank"), F.count("*").over(feed).alias("files"))


def footer_fields(files: DataFrame, file_col: str = "file_id", path_col: str = "path") -> DataFrame:
    """(file_id, field, type): the columns that the footers of Parquet files declare, by the Arrow names of their types. Only footers are read, by
    the workers, through the file system that each path names (a plain path is a local one). A null path gives no row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet as pq

        for batch in batches:
            found = []
            for k, path in enumerate(batch.column(1).to_pylist()):
                system, name = filesystem(path)
                with system.open_input_file(name) as f:
                    found += [(k, c.name, str(c.type)) for c in pq.read_schema(f)]
            ids = batch.column(0).take(pa.array([x[0] for x in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.string())], ["file_id", "field", "type"])

    listed = files.where(F.col(path_col).isNotNull()).select(F.col(file_col).alias("file_id"), F.col(path_col).cast("string").alias("path"))
    return listed.mapInArrow(read, f"file_id {files.schema[file_col].dataType.simpleString()}, field string, type string")


def catalogue(fields: DataFrame, files: DataFrame) -> DataFrame:
    """(feed, rank, files, file_id, field, type): the type is that of most of the field's non-null values in the file (the first by name of
    equally many), null if it has none. fields may come from records or from footers."""
    counted = fields.groupBy("file_id", "field", "type").agg(F.count("*").alias("n"))
    rank = F.when(F.col("type").isNotNull(), F.struct(-F.col("n"), F.col("type")))
    types = counted.groupBy("file_id", "field").agg(F.min_by("type", rank).alias("type"))
    return types.join(ranked_files(files), "file_id").select("feed", "rank", "files", "file_id", "field", "type")


def lifespans(columns: DataFrame) -> DataFrame:
    """(feed, field, type, first_rank, last_rank, first_file, last_file, ended): one row for each island of consecutive files in which a
    field has one type. ended: a later file of the feed exists. The rows are placed by feed and field once; all steps use that."""
    key = W.partitionBy("feed", "field", "type").orderBy("rank")
    starts = F.when(F.coalesce(F.lag("rank").over(key), F.lit(-1)) != F.col("rank") - 1, 1).otherwise(0)
    islands = columns.repartition("feed", "field").withColumn("starts", starts).withColumn("island", F.sum("starts").over(key))
    spans = islands.groupBy("feed", "field", "type", "island").agg(
        F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"), F.min_by("file_id", "rank").alias("first_file"), F.max_by("file_id", "rank").alias("last_file"), F.max("files").alias("files"))
    return spans.withColumn("ended", F.col("last_rank") < F.col("files")).drop("files", "island")


def _events(columns: DataFrame) -> DataFrame:
    """(feed, rank, field, began, ended, type, old_type): where a lifespan starts or ends (at the file after its last), other than at a feed's ends."""
    spans = lifespans(columns)
    side = lambda rank, own, other, when: F.when(when, F.struct(rank.alias("rank"), own.alias("began"), other.alias("ended"), F.when(own, F.col("type")).alias("type"), F.when(other, F.col("type")).alias("old_type")))
    ends = F.array(side(F.col("first_rank"), F.lit(True), F.lit(False), F.col("first_rank") > 1), side(F.col("last_rank") + 1, F.lit(False), F.lit(True), F.col("ended")))
    marks = spans.select("feed", "field", F.explode(F.filter(ends, lambda x: x.isNotNull())).alias("e")).select("feed", "field", "e.*")
    return marks.groupBy("feed", "field", "rank").agg(F.max("began").alias("began"), F.max("ended").alias("ended"), F.max("type").alias("type"), F.max("old_type").alias("old_type"))


def _settled(pairs: DataFrame) -> DataFrame:
    """(feed, rank, field, former_field, type, old_type): of each file's matches (…, same) the one with most equal values first, then by names, and no name twice.
    The matches of two neighbouring files, bounded by their fields, are folded in that order; there are no rounds."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("same")).alias("s"), "field", "former_field", "type", "old_type")))
    taken = F.col("matches").getItem(0)
    clash = lambda acc, m: F.exists(acc, lambda x: (x["field"] == m["field"]) | (x["former_field"] == m["former_field"]))
    kept = F.aggregate("matches", F.array_except(F.array(taken), F.array(taken)), lambda acc, m: F.when(clash(acc, m), acc).otherwise(F.concat(acc, F.array(m))))
    grouped = pairs.groupBy("feed", "rank").agg(order.alias("matches"))
    return grouped.select("feed", "rank", F.explode(kept).alias("m")).select("feed", "rank", "m.field", "m.former_field", "m.type", "m.old_type")


def _report(events: DataFrame, renamed: DataFrame, order: DataFrame) -> DataFrame:
    """(file_id, change, field, former_field) of events and of the renames among them. A rename takes its name from what was added and its former one from what was removed."""
    none = F.lit("")
    change = lambda name, former=none: F.struct(F.lit(name).alias("change"), former.alias("former_field"))
    named = renamed.select("feed", "rank", F.explode(F.array(
        F.struct(F.col("field"), F.lit(True).alias("began"), F.col("former_field").alias("former"), (F.col("type") != F.col("old_type")).alias("other")),
        F.struct(F.col("former_field").alias("field"), F.lit(False).alias("began"), F.lit(None).cast("string").alias("former"), F.lit(False).alias("other")),
    )).alias("r")).select("feed", "rank", "r.*")
    own = events.join(named.withColumnRenamed("began", "new_name"), ["feed", "rank", "field"], "left")
    kinds = (
        F.when(F.col("began") & F.col("ended"), F.when(F.col("type") != F.col("old_type"), F.array(change("retyped"))))
        .when(F.col("new_name"), F.concat(F.array(change("renamed", F.col("former"))), F.when(F.col("other"), F.array(change("retyped"))).otherwise(F.array().cast("array<struct<change:string,former_field:string>>"))))
        .when(F.col("new_name").isNull(), F.array(F.when(F.col("began"), change("added")).otherwise(change("removed"))))
    )
    rows = own.select("feed", "rank", "field", F.explode(kinds).alias("c")).select("feed", "rank", "field", "c.*")
    return rows.join(order.select("feed", "rank", "file_id"), ["feed", "rank"]).select("file_id", "change", "field", "former_field")


def changes(records: DataFrame, files: DataFrame, file_col: str = "file_id", record_col: str = "serp_id", payload_col: str = "payload") -> DataFrame:
    """(file_id, change, field, former_field): each field renamed, retyped, added or removed between a file and the one before it.

    A file without records has no fields, so all end there. Renames need a value in at least one shared record and no
    shared record with another value; of several matches the one with most values counts, then the first by name, and no name
    is used twice. Fields with only nulls have no type and aren't retyped. Empty tables give no row; other columns are ignored.

    Payloads are parsed once, into a written table of fields; the catalogue, the events and the values that renames are told by come from that. Spark jobs
    run while this is called."""
    order = ranked_files(files)
    fields = materialise(explode_fields(records, file_col, record_col, payload_col), "drift-fields")
    columns = materialise(catalogue(fields, files), "drift-catalogue")
    events = materialise(_events(columns), "drift-events")

    # the values of what began, and of what ended in the file before, one row for each record and field: more than one value of a record is no equal one
    role = F.when(F.col("ended"), F.lit(1)).otherwise(0)
    marks = events.where("not (began and ended)").select("feed", F.col("rank").alias("at"), (F.col("rank") - role).alias("rank"), "field", "began", F.coalesce("type", "old_type").alias("t"))
    placed = marks.join(order.select("feed", "rank", "file_id"), ["feed", "rank"]).select("file_id", "field", "feed", "at", "began", "t")
    values = fields.where("record is not null and value is not null and type is not null").join(placed, ["file_id", "field"])
    values = values.groupBy("feed", "at", "record", "began", "field").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.max("t").alias("t"))
    values = materialise(values, "drift-values")
    before = values.where("not began").select("feed", "at", "record", F.col("field").alias("former_field"), F.col("low").alias("old_low"), F.col("high").alias("old_high"), F.col("t").alias("old_type"))
    both = values.where("began").join(before, ["feed", "at", "record"])
    equal = (F.col("low") == F.col("high")) & (F.col("old_low") == F.col("old_high")) & (F.col("low") == F.col("old_low"))
    pairs = both.groupBy("feed", F.col("at").alias("rank"), "field", "former_field").agg(
        F.count_if(equal).alias("same"), F.count("*").alias("shared"), F.max("t").alias("type"), F.max("old_type").alias("old_type"))
    return _report(events, _settled(pairs.where("same > 0 and same = shared")), order)


def footer_changes(files: DataFrame, file_col: str = "file_id", path_col: str = "path") -> DataFrame:
    """(file_id, change, field, former_field) of Parquet files (file_id, path, feed, file_seq) from their footers alone: as changes(), but footers hold no
    values to tell a rename by, so one comes out as removed and added."""
    columns = materialise(catalogue(footer_fields(files, file_col, path_col), files), "drift-footers")
    events = _events(columns)
    none = events.limit(0).select("feed", "rank", "field", F.col("field").alias("former_field"), "type", "old_type")
    return _report(events, none, ranked_files(files))


def _epoch(text: Column) -> Column:
    """Seconds from epoch seconds or milliseconds, with or without fraction, or from a date and time in ISO or day-first order."""
    n = F.try_to_number(F.regexp_extract(text, r"^(\d{1,16})(\.\d+)?$", 1), F.lit("9" * 16)).cast("long")
    seconds = F.when(n >= 100_000_000_000, F.floor(n / 1000)).otherwise(n)
    iso = F.try_to_timestamp(F.regexp_replace(text, "T", " "), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.coalesce(seconds, F.unix_timestamp(iso), F.unix_timestamp(F.try_to_timestamp(text, F.lit("dd.MM.yyyy HH:mm:ss")))).cast("long")


def _scalar(value: Column) -> Column:
    """Text of a variant: a list's elements joined by blanks, an object's first of name, raw and sec."""
    items = F.array_join(F.try_variant_get(value, "$", "array<string>"), " ")
    inner = F.coalesce(*[F.try_variant_get(value, f"$.{k}", "string") for k in ("name", "raw", "sec")])
    t = F.schema_of_variant(value)
    return F.when(t.startswith("ARRAY"), items).when(t.startswith("OBJECT"), inner).otherwise(value.cast("string"))


def casts(aliases: dict[str, list[str]], types: dict[str, str]) -> dict[str, Column]:
    """The expression of each standard column, generated from the alias table: of the map `f` from folded names to texts."""
    made = {}
    for name, known in aliases.items():
        text = F.coalesce(*[F.col("f").getItem(a.replace("_", "")) for a in known])
        kind = types.get(name, "string")
        if kind == "epoch":
            made[name] = _epoch(text)
        elif kind == "boolean":
            made[name] = F.when(F.lower(text).isin("true", "yes", "1"), True).when(F.lower(text).isin("false", "no", "0"), False)
        elif kind == "bigint":
            made[name] = F.floor(text.try_cast("double")).cast("bigint")
        else:
            made[name] = text.try_cast(kind)
    return made


def standard_records(records: DataFrame, aliases: dict[str, list[str]] = ALIASES, types: dict[str, str] = TYPES, file_col: str = "file_id", id_col: str = "raw_id", payload_col: str = "payload") -> DataFrame:
    """(raw_id, file_id, serp_id, standard columns, unknown_fields): every record under the standard names and types, without a shuffle. A value that can't
    be cast is null; of two names that fold to one the first that has a value counts; names that no alias knows are listed. Records that are no JSON
    object keep their ids and have nulls."""
    known = F.array(*[F.lit(a) for a in sorted({a.replace("_", "") for c in aliases.values() for a in c} | {"serpid"})])
    fold = lambda k: F.lower(F.replace(k, F.lit("_"), F.lit("")))
    rows = records.select(F.col(id_col).alias("raw_id"), F.col(file_col).alias("file_id"), _object(F.col(payload_col)).alias("m"))
    named = F.filter(F.transform(F.array_sort(F.map_keys("m")), lambda k: F.struct(fold(k).alias("k"), _scalar(F.col("m")[k]).alias("text"))), lambda e: e["text"].isNotNull())
    unknown = F.filter(F.array_sort(F.map_keys("m")), lambda k: ~F.array_contains(known, fold(k)))
    rows = rows.select("raw_id", "file_id", named.alias("e"), F.coalesce(F.array_join(unknown, " "), F.lit("")).alias("unknown_fields"))
    first = F.filter("e", lambda e, i: ~F.exists(F.slice("e", 1, i), lambda x: x["k"] == e["k"]))
    maps = rows.select("raw_id", "file_id", F.map_from_entries(first).alias("f"), "unknown_fields")
    return maps.select("raw_id", "file_id", F.col("f").getItem("serpid").alias("serp_id"), *[e.alias(n) for n, e in casts(aliases, types).items()], "unknown_fields")
