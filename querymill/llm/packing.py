"""Filling containers of fixed capacity: hierarchical residual packing.

Partitions pack their items best-fit by falling size. Bins that are nearly full are done; the others go on as items to a round with
fewer partitions, where they are merged best-fit, until one partition holds them all or a round gains nothing. A text is cut only if it is longer than the
container, into full bins and one remainder.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.session import materialise

TASK_ITEMS = 60_000
NEARLY_FULL = 0.985
_ITEM = pa.struct([("id", pa.int64()), ("piece", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64())])
_SHAPE = "container string, capacity long, fill long, done boolean, items array<struct<id:long,piece:int,first_token:long,n_tokens:long>>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of indexes: each item, by falling size, goes into the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        at = bisect_left(room, (sizes[k], -1))
        if at < len(room):
            free, b = room.pop(at)
            bins[b].append(k)
        else:
            free, b = capacity, len(bins)
            bins.append([k])
        insort(room, (free - sizes[k], b))  # a full bin still takes items of size 0
    return bins


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs the bins of one partition into fewer, for each container by itself."""
    groups = defaultdict(list)
    for batch in batches:
        for container, capacity, fill, items in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4))):
            groups[container, capacity].append((fill, items))
    for (container, capacity), own in groups.items():
        made = [[x for k in b for x in own[k][1]] for b in best_fit([f for f, _ in own], capacity)]
        fills = [sum(x["n_tokens"] for x in b) for b in made]
        for cut in range(0, len(made), 10_000):
            some, n = made[cut : cut + 10_000], fills[cut : cut + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([container] * len(n), pa.string()), pa.array([capacity] * len(n), pa.int64()), pa.array(n, pa.int64()), pa.array([f >= NEARLY_FULL * capacity for f in n]), pa.array(some, pa.list_(_ITEM))], ["container", "capacity", "fill", "done", "items"])


def pieces(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """Single-item bins: every text once for each container, cut into full pieces and a remainder where it is longer than that."""
    # the table of containers has a few rows by its nature; more than a thousand are refused
    known = containers.where("capacity_tokens > 0").select("container", F.col("capacity_tokens").cast("long").alias("capacity")).limit(1001).collect()
    if len(known) > 1000:
        raise ValueError("more than 1000 containers")
    if not known:
        return sizes.sparkSession.createDataFrame([], _SHAPE)
    listed = F.array(*[F.struct(F.lit(r.container).alias("container"), F.lit(r.capacity).cast("long").alias("capacity")) for r in known])
    rows = sizes.select(F.col("id").cast("long").alias("id"), "n_tokens", F.explode(listed).alias("c")).select("id", "n_tokens", "c.*")
    cut = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n_tokens") - 1) / F.col("capacity")).cast("int")))))
    first = F.col("piece").cast("long") * F.col("capacity")
    n = F.least("capacity", F.col("n_tokens") - first)
    return cut.select("container", "capacity", n.alias("fill"), (n == F.col("capacity")).alias("done"), F.array(F.struct("id", "piece", first.alias("first_token"), n.alias("n_tokens"))).alias("items"))


def pack(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """(container, bin_id, id, piece, first_token, n_tokens) from sizes (id, n_tokens) and containers (container, capacity_tokens).

    Every id occurs in every container, cut only if longer than it. bin_id is a number of no meaning. Items of size 0 (empty or
    null texts) go into any bin; repeated ids are items of their own; containers without a positive capacity are left out. Empty tables give no row."""
    bins = materialise(pieces(sizes, containers), "packing-0")
    done = bins.where("done")
    open_bins, count, rounds = bins.where("not done"), bins.where("not done").count(), 0
    while count:
        parts = max(1, -(-count // TASK_ITEMS))
        rounds += 1
        by = F.xxhash64("container", F.col("items")[0]["id"], F.col("items")[0]["piece"], F.lit(rounds))
        packed = materialise(open_bins.repartition(parts, by).mapInArrow(_pack, _SHAPE), f"packing-{rounds}")
        left = packed.where("not done").count()
        if parts == 1 or left > 0.97 * count and rounds > 1:
            done = done.unionByName(packed)
            break
        done, open_bins, count = done.unionByName(packed.where("done")), packed.where("not done"), left
    # the rounds are written tables, so the numbers of their rows are the same whenever they are read
    named = done.withColumn("bin_id", F.monotonically_increasing_id()).select("container", "bin_id", F.explode("items").alias("i"))
    return named.select("container", "bin_id", "i.*")


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container, capacity_tokens, bins, tokens, least_bins, fill): least_bins is the number that no packing can go below."""
    bins = packed.groupBy("container", "bin_id").agg(F.sum("n_tokens").alias("n")).groupBy("container").agg(F.count("*").alias("bins"), F.sum("n").alias("tokens"))
    c = F.col("capacity_tokens")
    return bins.join(containers.select("container", "capacity_tokens"), "container").select("container", "capacity_tokens", "bins", "tokens", F.ceil(F.col("tokens") / c).alias("least_bins"), (F.col("tokens") / (F.col("bins") * c)).alias("fill"))
