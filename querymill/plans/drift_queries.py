"""p3: schemas that drift between files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.operators import drift
from querymill.session import materialise, table
from querymill.sources import readers
from querymill.session import materialise, table


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.changes(table(spark, sf, "raw_log_records"), table(spark, sf, "raw_log_files"))


def p3_lifespans(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "raw_log_files")
    fields = drift.explode_fields(table(spark, sf, "raw_log_records"), "file_id", "serp_id", "payload")
    return drift.lifespans(materialise(drift.catalogue(fields, files), "drift-catalogue"))


def p3_records(spark: SparkSession, sf: str) -> DataFrame:
    return drift.standard_records(table(spark, sf, "raw_log_records"))


#: the test tables, whose files' footers are catalogued
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "query_log", "raw_log_files", "raw_log_records", "extract_words", "extract_chars", "query_embeddings", "mix_targets", "pack_capacities", "name_lexicon"]


def p3_footers(spark: SparkSession, sf: str) -> DataFrame:
    """The columns that the footers of all tables' files declare."""
    listed = [(t, path) for t in TABLES for path in readers.files(spark, f"{sf}/{t}.parquet", ".parquet")]
    fields = drift.footer_fields(spark.createDataFrame(listed, "file_id string, path string"))
    return fields.select(F.col("file_id").alias("table_name"), "field").distinct()


QUERIES = {f.__name__: f for f in (p3_found, p3_lifespans, p3_records, p3_footers)}

_CATALOGUE = """
f as (select file_id, feed, row_number() over (partition by feed order by file_seq) as r from raw_log_files),
e as (
  select f.feed, f.r, f.file_id, json_extract_string(payload, '$.serp_id') as rec, j.key as k,
         case when j.type in ('BIGINT', 'UBIGINT') then 'integer' when j.type = 'DOUBLE' then 'double' when j.type = 'VARCHAR' then 'string'
              when j.type = 'BOOLEAN' then 'boolean' when j.type = 'OBJECT' then 'object' when j.type = 'ARRAY' then 'array' end as t,
         case when j.type in ('DOUBLE', 'BIGINT', 'UBIGINT') then coalesce(cast(try_cast(j.atom as decimal(38, 9)) as varchar), j.atom)
              when j.type = 'VARCHAR' and regexp_matches(j.atom ->> '$', '^-?(0|[1-9][0-9]*)([.][0-9]+)?$') then cast(cast(j.atom ->> '$' as decimal(38, 9)) as varchar)
              when j.type = 'VARCHAR' then j.value else cast(j.value as varchar) end as v
  from raw_log_records r join f using (file_id), lateral (select key, type, value, value as atom from json_each(r.payload)) j),
n as (select feed, r, file_id, k, t, count(*) as n from e group by all),
c as (select feed, r, file_id, k, arg_min(t, row(-n, t)) filter (where t is not null) as t from n group by all)
"""



def _records_sql() -> str:
    """One column for each standard one: the text under the first alias that has one, cast; dates as epoch seconds, numbers down to whole ones."""
    fold = "lower(replace(key, '_', ''))"
    text = """case when type = 'NULL' then null when type = 'ARRAY' then array_to_string(from_json(value, '["VARCHAR"]'), ' ')
      when type = 'OBJECT' then coalesce(json_extract_string(value, '$.name'), json_extract_string(value, '$.raw'), json_extract_string(value, '$.sec'))
      when type = 'VARCHAR' then value ->> '$'
      when type = 'DOUBLE' then regexp_replace(regexp_replace(cast(value as varchar), '([.][0-9]*?)0+$', '\\1'), '[.]$', '') else cast(value as varchar) end"""
    cols, known = [], {"serpid"}
    for name, aliases in drift.ALIASES.items():
        folded = [a.replace("_", "") for a in aliases]
        known |= set(folded)
        picks = [f"min(txt) filter (where k = '{a}')" for a in folded]
        v = f"coalesce({', '.join(picks)})"
        kind = drift.TYPES.get(name, "string")
        if kind == "epoch":
            n = f"cast(regexp_extract({v}, '^([0-9]{{1,16}})([.][0-9]+)?$', 1) as varchar)"
            v = f"coalesce(case when {n} <> '' then case when cast({n} as bigint) >= 100000000000 then cast({n} as bigint) // 1000 else cast({n} as bigint) end end, cast(epoch(try_strptime(replace({v}, 'T', ' '), '%Y-%m-%d %H:%M:%S')) as bigint), cast(epoch(try_strptime({v}, '%d.%m.%Y %H:%M:%S')) as bigint))"
        elif kind == "boolean":
            v = f"case when lower({v}) in ('true', 'yes', '1') then true when lower({v}) in ('false', 'no', '0') then false end"
        elif kind == "bigint":
            v = f"cast(floor(try_cast({v} as double)) as bigint)"
        elif kind == "double":
            v = f"try_cast({v} as double)"
        cols.append(f"{v} as {name}")
    names = ", ".join(f"'{k}'" for k in sorted(known))
    return f"""with x as (
        select r.raw_id, r.file_id, j.key, {fold} as k, {text} as txt
        from raw_log_records r left join lateral (select key, type, value from json_each(case when json_valid(r.payload) and json_type(r.payload) = 'OBJECT' then r.payload end)) j on true)
      select raw_id, file_id, min(txt) filter (where k = 'serpid') as serp_id, {', '.join(cols)},
             coalesce(string_agg(key, ' ' order by key) filter (where k not in ({names})), '') as unknown_fields
      from x group by raw_id, file_id"""


SQL = {
    "p3_found": f"""with recursive {_CATALOGUE},
      last as (select feed, max(r) as m from f group by 1),
      added as (select c.* from c where r > 1 and not exists (select 1 from c o where o.feed = c.feed and o.r = c.r - 1 and o.k = c.k)),
      gone as (select c.feed, c.r + 1 as r, c.k, c.t from c join last using (feed) where c.r < m and not exists (select 1 from c o where o.feed = c.feed and o.r = c.r + 1 and o.k = c.k)),
      pairs as (
        select a.feed, a.r, a.k, g.k as old_k, a.t, g.t as old_t, count(*) filter (where y.v = x.v) as same, count(*) as shared
        from added a join gone g using (feed, r)
        join e y on y.feed = a.feed and y.r = a.r and y.k = a.k and y.t is not null
        join e x on x.feed = a.feed and x.r = a.r - 1 and x.k = g.k and x.rec = y.rec and x.t is not null
        group by all having same > 0 and same = shared),
      numbered as (select *, row_number() over (partition by feed, r order by same desc, k, old_k) as i from pairs),
      walk(feed, r, i, news, olds, taken) as (
        select distinct feed, r, 0::bigint, []::varchar[], []::varchar[], false from numbered
        union all
        select n.feed, n.r, n.i, case when free then list_append(news, k) else news end, case when free then list_append(olds, old_k) else olds end, free
        from (select n.*, w.news, w.olds, not list_contains(w.news, n.k) and not list_contains(w.olds, n.old_k) as free from walk w join numbered n on n.feed = w.feed and n.r = w.r and n.i = w.i + 1) n),
      best as (select n.* from numbered n join walk w on w.feed = n.feed and w.r = n.r and w.i = n.i where w.taken),
      out as (
        select feed, r, 'renamed' as change, k as field, old_k as former_field from best
        union all select feed, r, 'retyped', k, '' from best where t <> old_t
        union all select c.feed, c.r, 'retyped', c.k, '' from c join c o on o.feed = c.feed and o.r = c.r - 1 and o.k = c.k where o.t <> c.t
        union all select feed, r, 'added', k, '' from added where not exists (select 1 from best b where b.feed = added.feed and b.r = added.r and b.k = added.k)
        union all select feed, r, 'removed', k, '' from gone where not exists (select 1 from best b where b.feed = gone.feed and b.r = gone.r and b.old_k = gone.k))
      select f.file_id, change, field, former_field from out join f using (feed, r)""",
    "p3_lifespans": f"""with {_CATALOGUE},
      s as (select *, case when lag(r) over (partition by feed, k, t order by r) = r - 1 then 0 else 1 end as s from c),
      i as (select *, sum(s) over (partition by feed, k, t order by r) as i from s)
      select feed, k as field, t as type, min(r) as first_rank, max(r) as last_rank, arg_min(file_id, r) as first_file, arg_max(file_id, r) as last_file,
             max(r) < any_value(m) as ended
      from i join (select feed, max(r) as m from f group by 1) using (feed) group by feed, k, t, i""",
    "p3_records": _records_sql(),
    "p3_footers": f"select distinct table_name, column_name as field from information_schema.columns where table_name in ({', '.join(repr(t) for t in TABLES)})",
}
