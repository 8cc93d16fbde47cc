"""Copies hidden by formatting: Bloom filters first, exact grouping only of what may be repeated.

Each record gets a canonical key, which is written once with its hash and the number of its partition. Every partition notes which filter positions its
keys hit once and which repeatedly, four bytes a position; the positions are merged by chunk of the filter, and one that two partitions hit counts as
repeated. Each partition gets back only its own repeated positions, as a file of its own in the shared folder, and probes its rows against them:
possible repeats are shuffled and grouped exactly, the others are singletons and never move. Nothing is broadcast, and the plan is the same
whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querymill.session import filesystem, materialise, new_path

# fixed values: the search operators that end in a colon
FIELD_OPERATORS = ["site", "filetype", "intitle", "allinurl", "allintitle", "intext", "allintext", "related", "define", "cache"]

CHUNK_BITS, MOST_CHUNK_BITS = 20, 24  # of the positions of one chunk; a larger filter has larger chunks, so that they don't become too many
BITS_A_ROW = 16
ROWS_A_TASK = 8_000_000  # positions that one merging task gets

_FIELD = r"(?U)(?<![\p{L}\p{N}])(?:" + "|".join(FIELD_OPERATORS) + r"):\S+"


def _words(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def canonical_text(text: Column) -> Column:
    """Lower-cased words in their order, then the operator fields in sorted order. Null if no letter or digit is left."""
    low = F.lower(text)
    fields = F.array_sort(F.transform(F.regexp_extract_all(low, F.lit(_FIELD), F.lit(0)), _words))
    rest = _words(F.regexp_replace(low, _FIELD, " "))
    out = F.when(F.contains(low, F.lit(":")), F.concat_ws("\u0001", F.concat(rest, F.lit("\u0002")), fields)).otherwise(F.concat(_words(low), F.lit("\u0002")))
    return F.when(out != "\u0002", out)


def probed(df: DataFrame, key: str) -> DataFrame:
    """df with the column `repeated`: whether the row's key may occur more than once. It is true for all keys that do, false for null keys.
    df is written once (with hashes and partition numbers) and read twice from there; the number of rows sizes the filter."""
    spark = df.sparkSession
    rows = materialise(df.withColumn("__h", F.when(F.col(key).isNotNull(), F.xxhash64(key))).withColumn("__part", F.spark_partition_id()), "bloom-rows")
    count = rows.count()  # from the footers
    bits = max(CHUNK_BITS, int(np.ceil(np.log2(max(1, count * BITS_A_ROW)))))
    chunk = min(MOST_CHUNK_BITS, max(CHUNK_BITS, bits - 16))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // ROWS_A_TASK))
    marked = rows.where("__h is not null").select("__part", "__h").mapInArrow(_marker(bits, chunk), "chunk int, part int, once binary, often binary")
    back = marked.repartition(tasks, "chunk").sortWithinPartitions("chunk").mapInArrow(_merger(chunk), "__part int, chunk int, at binary")
    path = new_path(spark, "bloom-repeats")
    back.repartition("__part").write.partitionBy("__part").parquet(path)
    return rows.mapInArrow(_prober(path, bits, chunk, rows.columns), T.StructType([*df.schema.fields, T.StructField("repeated", T.BooleanType())]))


def possible_repeats(df: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key may occur more than once; a key that does occur twice is never left out. Null keys are."""
    return probed(df, key).where("repeated").drop("repeated")


def _marker(bits: int, chunk_bits: int):
    """Positions of each partition, by chunk of the filter: those hit at all, and those hit repeatedly. Sparse, so that what is
    sent follows the rows and not the size of the filter."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            part, at = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False) & ((1 << bits) - 1)
            for p in np.unique(part).tolist():
                parts.setdefault(p, []).append(at[part == p])
        for p, found in parts.items():
            at, n = np.unique(np.concatenate(found), return_counts=True)
            low = (at & ((1 << chunk_bits) - 1)).astype(np.uint32)
            chunk = at >> chunk_bits
            cuts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
            ends = np.r_[cuts[1:], len(at)]
            for some in range(0, len(cuts), 1000):
                own = list(zip(cuts[some : some + 1000], ends[some : some + 1000]))
                yield pa.RecordBatch.from_arrays([pa.array([int(chunk[a]) for a, _ in own], pa.int32()), pa.array([p] * len(own), pa.int32()), pa.array([low[a:b].tobytes() for a, b in own], pa.binary()), pa.array([low[a:b][n[a:b] > 1].tobytes() for a, b in own], pa.binary())], ["chunk", "part", "once", "often"])

    return mark


def _merger(chunk_bits: int):
    """Merges the partitions' positions, one chunk after the other, and gives each partition those of its own that are repeated."""

    def close(chunk: int, own: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        once, often = np.zeros(1 << chunk_bits, bool), np.zeros(1 << chunk_bits, bool)
        for _, a, b in own:
            often[a[once[a]]] = True
            once[a] = True
            often[b] = True
        hit = [(p, a[often[a]]) for p, a, _ in own]
        hit = [(p, a.tobytes()) for p, a in hit if len(a)]
        if hit:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in hit], pa.int32()), pa.array([chunk] * len(hit), pa.int32()), pa.array([a for _, a in hit], pa.binary())], ["__part", "chunk", "at"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own = None, []
        for batch in batches:
            for chunk, part, a, b in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if chunk != current:
                    if own:
                        yield from close(current, own)
                    current, own = chunk, []
                own.append((part, np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)))
        if own:
            yield from close(current, own)

    return merge


def _prober(path: str, bits: int, chunk_bits: int, names: list[str]):
    """Flags the rows on repeated positions of their partition; the last two columns are the hash and the partition."""
    kept = names[:-2]

    def positions(system, folder: str, part: int) -> np.ndarray:
        from pyarrow import fs
        from pyarrow import parquet as pq

        found = system.get_file_info(fs.FileSelector(f"{folder}/__part={part}", allow_not_found=True))
        tables = [pq.ParquetFile(system.open_input_file(f.path)).read(columns=["chunk", "at"]) for f in found if f.path.endswith(".parquet")]
        at = [np.frombuffer(a, np.uint32).astype(np.int64) | (c << chunk_bits) for t in tables for c, a in zip(t["chunk"].to_pylist(), t["at"].to_pylist())]
        return np.sort(np.concatenate(at)) if at else np.zeros(0, np.int64)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = filesystem(path)
        known, last = {}, None
        for batch in batches:
            hash_, part = batch.column(len(kept)), batch.column(len(kept) + 1).to_numpy(zero_copy_only=False)
            at = hash_.fill_null(0).to_numpy(zero_copy_only=False) & ((1 << bits) - 1)
            flag = np.zeros(batch.num_rows, bool)
            for p in np.unique(part).tolist():
                if p != last:
                    known, last = positions(system, folder, p), p
                if len(known):
                    own = part == p
                    flag[own] = known[np.minimum(np.searchsorted(known, at[own]), len(known) - 1)] == at[own]
            flag &= hash_.is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(flag)], [*kept, "repeated"])

    return probe


def format_copies(df: DataFrame, id_col: str, text_col: str, exact_cols: list[str], required: list[str] = ()) -> DataFrame:
    """(first_id, copy_id): for every record that equals an earlier one (by id) but for case, punctuation, blanks and
    the place of its operator fields, the smallest id of its group and its own.

    Records with a null text or id, a text without letter or digit, or a null in a required column are no case; nulls in the other
    exact columns equal each other. Exact repeats are copies. Further columns of df are ignored, whatever their names."""
    keys = _keys(df, id_col, text_col, exact_cols, required).where("key is not null")
    kept = materialise(possible_repeats(keys, "key"), "format-repeats")
    groups = kept.groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    # as a written table, so that the join has plain scans on both sides and a group of many copies is split
    groups = materialise(groups, "format-groups")
    return kept.join(groups, "key").where("id <> first_id").select("first_id", F.col("id").alias("copy_id"))


def _keys(df: DataFrame, id_col: str, text_col: str, exact_cols: list[str], required: list[str]) -> DataFrame:
    """(id, key) of all rows; the key of what is no case is null."""
    canon = canonical_text(F.col(text_col))
    case = F.col(id_col).isNotNull() & F.col(text_col).isNotNull()
    for c in required:
        case = case & F.col(c).isNotNull()
    own = df.select(F.col(id_col).alias("id"), F.when(case, canon).alias("__canon"), *[F.col(c).cast("string").alias(f"__c{k}") for k, c in enumerate(exact_cols)])
    return own.select("id", F.when(F.col("__canon").isNotNull(), F.concat_ws("\u0003", *[F.coalesce(F.col(f"__c{k}"), F.lit("\u0004")) for k in range(len(exact_cols))], "__canon")).alias("key"))


def collapse(df: DataFrame, id_col: str, text_col: str, exact_cols: list[str], required: list[str] = ()) -> DataFrame:
    """(first_id, copies): one row for each distinct record, with how many records it stands for. Records that are no case
    (see format_copies) stay as they are, with one copy each; a null id stays null. Singletons come straight from the probe."""
    rows = probed(_keys(df, id_col, text_col, exact_cols, required), "key")
    rows = materialise(rows.select("id", F.when(F.col("repeated"), F.col("key")).alias("key")), "format-probed")
    groups = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).select("first_id", "copies")
    return groups.unionByName(rows.where("key is null").select(F.col("id").alias("first_id"), F.lit(1).cast("long").alias("copies")))
