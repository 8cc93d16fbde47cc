"""Occurrences and records of every term, by a global integer dictionary and blockwise count arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.operators.ids import dense_ids

BLOCK = 4096
BROADCAST_TERMS, BROADCAST_CHARS = 200_000, 20_000_000  # a larger dictionary is joined by shuffle (with AQE's skew handling)


def term_counts(df: DataFrame, record_col: str, term_col: str, n_col: str, rare_records: int, common_share: float) -> DataFrame:
    """(term, occurrences, records, mark): for each exact term its total count, its number of distinct records and
    `rare` (at most rare_records records), `common` (more than common_share of the records with a non-null term) or null.

    Null terms are left out. A (record, term) delivered again counts once, with its largest count; a null count is 1.
    Rows without a record count as occurrences, but as no record, and aren't merged. Empty tables give no row. Other columns are ignored."""
    rows = df.where(F.col(term_col).isNotNull()).select(F.col(record_col).alias("record"), F.col(term_col).alias("term"), F.coalesce(F.col(n_col).cast("long"), F.lit(1)).alias("n"))
    dictionary = dense_ids(rows.select("term").distinct(), ["term"], "term_id").select("term", "term_id")
    size = dictionary.agg(F.count("*").alias("terms"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("chars")).first()
    small = size.terms <= BROADCAST_TERMS and size.chars <= BROADCAST_CHARS
    coded = rows.join(F.broadcast(dictionary) if small else dictionary, "term").select("record", "term_id", "n")
    once = coded.where("record is not null").groupBy("record", "term_id").agg(F.max("n").alias("n")).select("term_id", "n", F.lit(1).cast("long").alias("p"))
    loose = coded.where("record is null").select("term_id", "n", F.lit(0).cast("long").alias("p"))
    blocks = once.unionByName(loose).mapInArrow(_block_arrays, "block long, at binary, n binary, p binary")
    sums = blocks.repartition("block").mapInArrow(_sum_blocks, "term_id long, occurrences long, records long")
    # the number of records is one row; it rides along as a broadcast of fixed size
    total = rows.agg(F.count_distinct("record").alias("all_records"))
    share = round(common_share * 1_000_000)
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") * 1_000_000 > F.col("all_records") * share, "common")
    return sums.join(dictionary, "term_id").join(F.broadcast(total), F.lit(True)).select("term", "occurrences", "records", mark.alias("mark"))


def _block_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count arrays of one partition, one row for each block of identifiers that it holds."""
    blocks: dict[int, np.ndarray] = {}
    for batch in batches:
        ids, n, p = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        order = np.argsort(ids, kind="stable")
        ids, n, p = ids[order], n[order], p[order]
        cuts = np.flatnonzero(np.r_[True, ids[1:] // BLOCK != ids[:-1] // BLOCK]) if len(ids) else []
        for a, b in zip(cuts, np.r_[cuts[1:], len(ids)].astype(int)):
            sums = blocks.setdefault(int(ids[a]) // BLOCK, np.zeros((2, BLOCK), np.int64))
            np.add.at(sums[0], ids[a:b] % BLOCK, n[a:b])
            np.add.at(sums[1], ids[a:b] % BLOCK, p[a:b])
            if len(blocks) > 2048:  # at most 128 MB a task
                yield _rows(blocks)
                blocks = {}
    if blocks:
        yield _rows(blocks)


def _rows(blocks: dict[int, np.ndarray]) -> pa.RecordBatch:
    at = [np.flatnonzero((x[0] != 0) | (x[1] != 0)) for x in blocks.values()]
    cols = [[a.astype(np.uint16).tobytes() for a in at], *[[x[k][a].tobytes() for a, x in zip(at, blocks.values())] for k in (0, 1)]]
    return pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), *[pa.array(c, pa.binary()) for c in cols]], ["block", "at", "n", "p"])


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, at, n, p in zip(*(batch.column(i).to_pylist() for i in range(4))):
            own, where = sums.setdefault(block, np.zeros((3, BLOCK), np.int64)), np.frombuffer(at, np.uint16)
            own[0][where] += np.frombuffer(n, np.int64)
            own[1][where] += np.frombuffer(p, np.int64)
            own[2][where] = 1
    for block, own in sums.items():
        where = np.flatnonzero(own[2])
        yield pa.RecordBatch.from_arrays([pa.array(where + block * BLOCK), pa.array(own[0][where]), pa.array(own[1][where])], ["term_id", "occurrences", "records"])
