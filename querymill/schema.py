"""Schemas of the logs: the standard one, the raw JSON one, and how raw columns are named in the standard."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L = T.StringType(), T.LongType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# fixed values: the 17 fields of the standard schema
STANDARD = _struct(
    ("serp_id", _S), ("serp_url", _S), ("serp_domain", _S), ("serp_domain_public_suffix", _S), ("serp_timestamp", _L), ("serp_page", _L), ("serp_offset", _L),
    ("serp_query_text_url", _S), ("serp_query_text_url_language", _S), ("serp_query_text_html", _S), ("serp_warc_relative_path", _S), ("serp_warc_byte_offset", _L),
    ("search_provider_name", _S), ("search_provider_alexa_domain", _S), ("search_provider_alexa_domain_public_suffix", _S), ("search_provider_alexa_rank", _L), ("search_provider_category", _S),
)

# fixed values: fields of the raw JSON log besides the standard ones
RESULT = _struct(
    ("result_id", _S), ("result_url", _S), ("result_domain", _S), ("result_domain_public_suffix", _S), ("result_wayback_url", _S), ("result_wayback_raw_url", _S),
    ("result_snippet_rank", _L), ("result_snippet_title", _S), ("result_snippet_text", _S), ("result_warc_relative_path", _S), ("result_warc_byte_offset", _L),
)
RAW_JSON = T.StructType([*STANDARD.fields, T.StructField("serp_wayback_url", _S), T.StructField("serp_wayback_raw_url", _S), T.StructField("serp_results", T.ArrayType(RESULT))])

# fixed values: raw column -> standard column
RENAMES = {
    "aol": {"AnonID": "serp_id", "Query": "serp_query_text_url", "QueryTime": "serp_timestamp", "ItemRank": "serp_offset"},
    "ms-marco": {"query_id": "serp_id", "query": "serp_query_text_url", "language": "serp_query_text_url_language"},
    "orcas": {"id": "serp_id", "query": "serp_query_text_url"},
    "aql": {},
}
DROPPED = {"aol": ["ClickURL"], "aql": ["serp_wayback_url", "serp_wayback_raw_url", "serp_results"], "ms-marco": [], "orcas": []}
