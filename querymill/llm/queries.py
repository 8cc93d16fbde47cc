"""The pN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.llm import clusters, format_dups, heavy_items, language, mixing, packing, pii, residue, term_counts, tokens
from querymill.session import materialise, table

TEXT = "serp_query_text_url"


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return heavy_items.heavy_items(table(spark, sf, "query_log"), TEXT, 0.004).select(TEXT)


def p1_counts(spark: SparkSession, sf: str) -> DataFrame:
    return heavy_items.heavy_items(table(spark, sf, "query_log"), TEXT, 0.004).select(TEXT, "n", (F.abs(F.col("approx_n") - F.col("n")) <= F.col("total") * 0.002).alias("approx_close"))


_P2 = {"id_col": "record_id", "text_col": TEXT, "exact_cols": ["serp_id", "serp_timestamp", "search_provider_name"], "required": ["serp_id"]}


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return format_dups.format_copies(table(spark, sf, "query_log"), **_P2)


def p2_records(spark: SparkSession, sf: str) -> DataFrame:
    return format_dups.collapse(table(spark, sf, "query_log"), **_P2)


def _p4(spark: SparkSession, sf: str) -> DataFrame:
    words = term_counts.term_counts(table(spark, sf, "extract_words"), "record_id", "word", "n", 2, 0.033)
    chars = term_counts.term_counts(table(spark, sf, "extract_chars"), "record_id", "char", "n", 2, 0.5)
    return words.withColumn("field", F.lit("word")).unionByName(chars.withColumn("field", F.lit("char")))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p4(spark, sf).where("mark is not null").select("field", "term", "mark")


def p4_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _p4(spark, sf).select("field", "term", "occurrences", "records", "mark")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find_pii(table(spark, sf, "query_log"), "record_id", TEXT, pii.tagger(table(spark, sf, "name_lexicon")))


def p5_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return pii.redact(table(spark, sf, "query_log"), "record_id", TEXT, pii.tagger(table(spark, sf, "name_lexicon")))


LABEL = "serp_query_text_url_language"


def _p6(spark: SparkSession, sf: str) -> tuple[DataFrame, language.Machines]:
    rows = table(spark, sf, "query_log").where("dataset = 'ms-marco'").select("record_id", TEXT, LABEL)
    return rows, language.train(language.sample_labels(rows, TEXT, LABEL))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    rows, model = _p6(spark, sf)
    return language.wrong_labels(rows, "record_id", TEXT, LABEL, model)


def p6_segments(spark: SparkSession, sf: str) -> DataFrame:
    rows, model = _p6(spark, sf)
    return language.identify(rows, "record_id", TEXT, LABEL, model)


_P10 = ("doc_id", "text", "source")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue_documents(table(spark, sf, "documents"), *_P10)


def p10_messages(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue_report(table(spark, sf, "documents"), *_P10)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.similarity_clusters(table(spark, sf, "query_embeddings"), "emb_id", "embeddings").withColumnRenamed("id", "emb_id")


def p7_leaves(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.leaf_report(table(spark, sf, "query_embeddings"), "emb_id", "embeddings")


def _sizes(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    return materialise(tokens.token_counts(table(spark, sf, "documents"), "doc_id", "text", list(keep)), "token-counts")


def p8_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_sizes(spark, sf), table(spark, sf, "pack_capacities")).withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    containers = table(spark, sf, "pack_capacities")
    return packing.fill_report(packing.pack(_sizes(spark, sf), containers), containers)


def p9_selection(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_sizes(spark, sf, "source"), table(spark, sf, "mix_targets")).withColumnRenamed("id", "doc_id")


def p8_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What holds for any good packing: every document is there, whole unless longer than the container, no container is overfull, and few more are used than must be."""
    containers, sizes = table(spark, sf, "pack_capacities"), _sizes(spark, sf)
    packed = materialise(packing.pack(sizes, containers), "packed").join(containers, "container")
    bins = packed.groupBy("container", "bin_id").agg(F.sum("n_tokens").alias("n"), F.max("capacity_tokens").alias("c")).groupBy("container").agg(F.count_if(F.col("n") > F.col("c")).alias("overfull"), F.count("*").alias("bins"), F.sum("n").alias("tokens"), F.max("c").alias("c"))
    parts = packed.groupBy("container", "id").agg(F.count("*").alias("parts"), F.sum("n_tokens").alias("n"), F.max("capacity_tokens").alias("c")).join(sizes.select("id", "n_tokens"), "id")
    parts = parts.groupBy("container").agg(F.count("*").alias("documents"), F.count_if(F.col("n") != F.col("n_tokens")).alias("changed"), F.count_if(F.col("parts") > F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("c")))).alias("cut_needlessly"))
    close = F.col("bins") <= F.ceil(F.col("tokens") / F.col("c")) * 1.02 + 1
    return parts.join(bins, "container").select("container", "documents", "changed", "cut_needlessly", "overfull", close.alias("few_containers"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    targets = table(spark, sf, "mix_targets")
    return mixing.share_report(mixing.mix(_sizes(spark, sf, "source"), targets), targets)


def p9_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What holds for any good selection: no document is used too often, and each source has its share to within the longest documents of the mixture's sources."""
    targets, sizes = table(spark, sf, "mix_targets"), _sizes(spark, sf, "source")
    chosen = materialise(mixing.mix(sizes, targets), "mixed")
    longest = sizes.join(F.broadcast(targets.select("mixture", "source")), "source").groupBy("mixture", "source").agg(F.max("n_tokens").alias("most")).groupBy("mixture").agg(F.sum("most").alias("most"))
    totals = chosen.groupBy("mixture").agg(F.sum("n_tokens").alias("total")).join(longest, "mixture")
    rows = mixing.share_report(chosen, targets).join(totals, "mixture").join(targets.select("mixture", "source", "max_repeats"), ["mixture", "source"])
    near = F.abs(F.col("actual_share") - F.col("target_share")) * F.col("total") <= F.col("most")
    return rows.select("mixture", "source", "target_share", (F.col("most_repeats") <= F.col("max_repeats")).alias("repeats_kept"), near.alias("share_kept"))


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p2_found, p2_records, p4_found, p4_counts, p5_found, p5_redacted, p6_found, p6_segments, p7_found, p7_leaves, p8_packing, p8_fill, p8_checks, p9_selection, p9_shares, p9_checks, p10_found, p10_messages)}
