"""Point clouds of vectors: sliced Wasserstein distance, communities, principal axes."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querymill.session import materialise

_DIRECTIONS = 250  # counted at once


def directions(dim: int, count: int, seed: int = 4) -> np.ndarray:
    d = np.random.default_rng(seed).standard_normal((dim, count))
    return (d / np.linalg.norm(d, axis=0)).astype(np.float32)


def sliced_wasserstein(df: DataFrame, group: str, vector: str, names: tuple[str, str], dim: int, projections: int = 200, bins: int = 512, reach: float | None = None, seed: int = 4) -> DataFrame:
    """(distance, projections): mean over random directions of the first Wasserstein distance between two clouds' projections.

    Each partition counts its projections in `bins` equal steps for every direction, _DIRECTIONS of them at once, so what is held and gathered is of fixed
    size and no projection is sorted; the error is at most one step (2 * reach / bins). The counts of a direction are summed as a stream. Vectors that are
    null or of another length are left out. An empty cloud gives null."""
    d = directions(dim, projections, seed)
    rows = df.where(F.col(group).isin(list(names)) & F.col(vector).isNotNull() & (F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull())).select((F.col(group) == names[1]).cast("int").alias("side"), F.col(vector).alias("v"))
    if reach is None:
        reach = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0] or 1.0
    step = 2 * reach / bins

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((projections, 2, bins), np.int64)
        for part in parts:
            for cut in range(0, len(part), 2048):
                some = part.iloc[cut : cut + 2048]
                x, side = np.stack(some["v"].to_numpy()).astype(np.float32), some["side"].to_numpy()
                for first in range(0, projections, _DIRECTIONS):
                    own = d[:, first : first + _DIRECTIONS]
                    at = np.clip(((x @ own + np.float32(reach)) / np.float32(step)).astype(np.int32), 0, bins - 1)
                    at += (np.arange(own.shape[1], dtype=np.int32) * 2 + side[:, None].astype(np.int32)) * bins
                    total[first : first + own.shape[1]] += np.bincount(at.ravel(), minlength=own.shape[1] * 2 * bins).reshape(-1, 2, bins)
        if total.any():
            for first in range(0, projections, _DIRECTIONS):
                own = range(first, min(first + _DIRECTIONS, projections))
                yield pd.DataFrame({"p": own, "counts": [zlib.compress(total[p].tobytes(), 1) for p in own]})

    def distances(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, np.zeros((2, bins), np.int64)

        def whole() -> tuple[int, float]:
            sizes = total.sum(axis=1, keepdims=True)
            f = np.cumsum(total, axis=1) / np.maximum(sizes, 1)
            return at, float(np.abs(f[0] - f[1]).sum() * step) if sizes.all() else math.nan

        for part in parts:
            done = []
            for p, counts in zip(part["p"], part["counts"]):
                if at is not None and p != at:
                    done.append(whole())
                    total = np.zeros((2, bins), np.int64)
                at = p
                total += np.frombuffer(zlib.decompress(counts), np.int64).reshape(2, bins)
            yield pd.DataFrame(done, columns=["p", "w"])
        if at is not None:
            yield pd.DataFrame([whole()], columns=["p", "w"])

    counted = rows.mapInPandas(count, "p int, counts binary").repartition("p").sortWithinPartitions("p")
    each = counted.mapInPandas(distances, "p int, w double").select("p", F.when(~F.isnan("w"), F.col("w")).alias("w"))
    return each.agg(F.avg("w").alias("distance"), F.count("*").alias("projections"))


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, axis, mean)."""
    return df.where(F.col(vector).isNotNull()).select(group, F.posexplode(vector).alias("axis", "x")).groupBy(group, "axis").agg(F.avg("x").alias("mean"))


def centred(df: DataFrame, vector: str, out: str = "centred") -> DataFrame:
    """Adds the vectors less the mean of all, axis by axis. Null vectors stay null and don't count; the mean is one row of as many numbers as axes."""
    axes = df.where(F.col(vector).isNotNull()).select(F.posexplode(vector).alias("axis", "x")).groupBy("axis").agg(F.avg("x").alias("m"))
    mean = axes.agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "m"))), lambda a: a["m"]).alias("__mean"))
    return df.join(F.broadcast(mean), F.lit(True)).withColumn(out, F.zip_with(vector, "__mean", lambda x, m: x - m)).drop("__mean")


def communities(df: DataFrame, id_col: str, vector: str, dim: int, threshold: float = 0.75, smallest: int = 25, block: int = 4096) -> DataFrame:
    """(cluster_id, member_rank, id): around each vector lie those with at least the threshold cosine; the largest such
    neighbourhoods of at least `smallest` vectors are kept, the larger first, each without members already taken.

    Neighbour lists come from products of blocks of rows with blocks of rows: every pair of blocks is one task of fixed size. Vectors without length are left
    out. The greedy choice runs over neighbourhoods, largest first, in one task, and needs only their member lists."""
    good = df.where(F.col(vector).isNotNull() & (F.size(vector) == dim)).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    total = good.count()
    blocks = max(1, -(-total // block))
    placed = materialise(good.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), "community-vectors")
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda j: F.struct(F.least("b", j).alias("p"), F.greatest("b", j).alias("q"))))

    def near(group: pd.DataFrame) -> pd.DataFrame:
        p, q = int(group["p"].iloc[0]), int(group["q"].iloc[0])
        side = lambda k: group[group["b"] == k]
        one, two = side(p), side(q)
        if not len(one) or not len(two):
            return pd.DataFrame({"id": [], "other": [], "cosine": []})
        x, y = (np.stack(s["v"].to_numpy()).astype(np.float32) for s in (one, two))
        x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (x, y))
        found = []
        for cut in range(0, len(x), 1024):
            s = x[cut : cut + 1024] @ y.T
            a, b = np.nonzero(s >= threshold)
            found.append((one["id"].to_numpy()[a + cut], two["id"].to_numpy()[b], s[a, b].astype(float)))
        ids, others, cos = (np.concatenate([f[k] for f in found]) for k in range(3))
        if p != q:
            ids, others, cos = np.concatenate([ids, others]), np.concatenate([others, ids]), np.concatenate([cos, cos])
        return pd.DataFrame({"id": ids, "other": others, "cosine": cos})

    pairs = placed.select("id", "v", "b", grid.alias("g")).select("id", "v", "b", "g.*").groupBy("p", "q").applyInPandas(near, "id long, other long, cosine double")
    lists = pairs.groupBy("id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), F.col("other")))).alias("near")).where(F.col("n") >= smallest)

    def choose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted(((-len(near), int(i), [int(x["other"]) for x in near]) for part in parts for i, near in zip(part["id"], part["near"])), key=lambda r: r[:2])
        taken: set[int] = set()
        out = []
        for _, _, members in rows:
            free = [m for m in members if m not in taken]
            if len(free) >= smallest:
                out.append(free)
                taken.update(free)
        out.sort(key=lambda m: (-len(m), m[0]))
        yield pd.DataFrame([(k, r, m) for k, own in enumerate(out) for r, m in enumerate(own)], columns=["cluster_id", "member_rank", "id"])

    return lists.select("id", "near").repartition(1).mapInPandas(choose, "cluster_id long, member_rank long, id long")


def principal_axes(df: DataFrame, vector: str, dim: int, k: int = 2) -> np.ndarray:
    """The k directions of largest variance, from sums of products gathered once (dim * dim numbers). A linear view; not the same as a
    neighbourhood embedding."""

    def moments(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim + 1, dim + 1))
        for part in parts:
            if len(part):
                x = np.stack(part["v"].to_numpy()).astype(float)
                x = np.c_[np.ones(len(x)), x]
                total += x.T @ x
        yield pd.DataFrame({"m": [total.ravel().tolist()]})

    rows = df.where(F.col(vector).isNotNull() & (F.size(vector) == dim)).select(F.col(vector).alias("v")).mapInPandas(moments, "m array<double>")
    sums = rows.select(F.posexplode("m").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()
    m = np.array([r.x for r in sums]).reshape(dim + 1, dim + 1)
    n = max(m[0, 0], 1)
    mean = m[0, 1:] / n
    values, vectors = np.linalg.eigh(m[1:, 1:] / n - np.outer(mean, mean))
    axes = vectors[:, np.argsort(-values)[:k]]
    return axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(k)] >= 0, 1, -1)


def project(df: DataFrame, id_col: str, vector: str, dim: int) -> DataFrame:
    """(id, x, y): coordinates on the two principal axes."""
    axes = principal_axes(df, vector, dim)
    dot = lambda a: F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), F.array(*[F.lit(float(v)) for v in a]), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return df.where(F.col(vector).isNotNull() & (F.size(vector) == dim)).select(F.col(id_col).alias("id"), dot(axes[:, 0]).alias("x"), dot(axes[:, 1]).alias("y"))
