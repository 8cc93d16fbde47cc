"""Distances and tests between distributions given as (group, x, n) tables.

All pairs of groups come from one pass: each group's share is spread over the other groups with unnested pairs, not with a cross join, as the number of
groups is the number of logs. Supports are aligned by key, never by position.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querymill.operators import windows as win

# fixed values: cumulative shares at which rank-size curves are cut
RANK_SHARES = {"entities": 0.84, "words": 0.957, "chars": 0.999}
# fixed values: constants of the two-sample Kolmogorov-Smirnov threshold by significance level
KS_CONSTANTS = {0.2: 1.07, 0.15: 1.14, 0.1: 1.22, 0.05: 1.36, 0.01: 1.63, 0.001: 1.95}


def paired(df: DataFrame, groups: list[str], group: str = "dataset", x: str = "x", n: str = "n") -> DataFrame:
    """(ds1, ds2, x, n1, n2) for every unordered pair of the groups over the union of their supports."""
    names = sorted(groups)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    sides = F.array(*[F.struct(F.lit(a).alias("ds1"), F.lit(b).alias("ds2")) for a, b in pairs])
    own = df.where(F.col(group).isin(names)).select(F.col(group).alias("g"), F.col(x).alias("x"), F.col(n).cast("double").alias("n"), F.explode(F.filter(sides, lambda p: (p["ds1"] == F.col(group)) | (p["ds2"] == F.col(group)))).alias("p"))
    one = lambda side: F.sum(F.when(F.col("g") == F.col(f"p.{side}"), F.col("n")).otherwise(0.0))
    return own.groupBy(F.col("p.ds1").alias("ds1"), F.col("p.ds2").alias("ds2"), "x").agg(one("ds1").alias("n1"), one("ds2").alias("n2"))


def _shares(pairs: DataFrame) -> DataFrame:
    part = W.partitionBy("ds1", "ds2")
    return pairs.withColumn("t1", F.sum("n1").over(part)).withColumn("t2", F.sum("n2").over(part)).withColumn("p", F.col("n1") / F.col("t1")).withColumn("q", F.col("n2") / F.col("t2"))


def _cumulated(pairs: DataFrame) -> DataFrame:
    to = W.partitionBy("ds1", "ds2").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    return _shares(pairs).withColumn("f", F.sum("p").over(to)).withColumn("g", F.sum("q").over(to))


def total_variation(pairs: DataFrame) -> DataFrame:
    """(ds1, ds2, distance): half the sum of absolute differences of shares."""
    return _shares(pairs).groupBy("ds1", "ds2").agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("distance"))


def wasserstein(pairs: DataFrame) -> DataFrame:
    """(ds1, ds2, distance): first Wasserstein distance on the line, for numeric x with few values (lengths, ranks up to a limit)."""
    gap = F.lead("x").over(W.partitionBy("ds1", "ds2").orderBy("x")) - F.col("x")
    return _cumulated(pairs).withColumn("gap", F.coalesce(gap, F.lit(0))).groupBy("ds1", "ds2").agg(F.sum(F.abs(F.col("f") - F.col("g")) * F.col("gap")).alias("distance"))


def rank_wasserstein(counts: DataFrame, groups: list[str], share: float = RANK_SHARES["words"]) -> DataFrame:
    """(ds1, ds2, distance): first Wasserstein distance of the rank-size curves of (dataset, n), each cut at x_max ranks, the most ranks of any group whose
    cumulative share is below `share`, and normalised again.

    The curves are kept in steps of equal count; between two ends of steps the difference of the running shares is a straight line, whose absolute
    values at all its ranks are summed in closed form. No list of ranks is made. A group without elements has no distance (null)."""
    counts = counts.where(F.col("dataset").isin(list(groups)))
    x_max = win.ranks_below(counts, ["dataset"], share).agg(F.max("x_max").alias("x_max"))
    steps = win.count_steps(counts, ["dataset"]).crossJoin(F.broadcast(x_max)).where(F.col("first_rank") <= F.col("x_max"))
    ends = F.array(F.struct((F.col("first_rank") - 1).alias("x"), F.col("n").alias("n")), F.struct(F.least("last_rank", "x_max").alias("x"), (-F.col("n")).alias("n")))
    # n1 and n2 are by how much the count of a rank changes after x; whole numbers, so their sums are exact
    part = W.partitionBy("ds1", "ds2")
    to = part.orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    rows = paired(steps.select("dataset", F.explode(ends).alias("e")).select("dataset", "e.x", "e.n"), groups)
    rows = rows.withColumn("ranks", F.coalesce(F.lead("x").over(part.orderBy("x")) - F.col("x"), F.lit(0))).withColumn("c1", F.sum("n1").over(to)).withColumn("c2", F.sum("n2").over(to))
    for k in ("1", "2"):
        mass = F.col(f"c{k}") * F.col("ranks")
        rows = rows.withColumn(f"t{k}", F.sum(mass).over(part)).withColumn(f"m{k}", F.sum(mass).over(to) - mass)
    d = F.try_divide("m1", "t1") - F.try_divide("m2", "t2")
    rows = rows.withColumn("d", d).withColumn("s", F.try_divide("c1", "t1") - F.try_divide("c2", "t2"))
    # the line d + s * k over k = 1 to ranks changes its sign after k = turn at most once
    turn = F.least(F.col("ranks"), F.greatest(F.lit(0), F.coalesce(F.floor(F.try_divide(-F.col("d"), "s")), F.lit(0)))).cast("double")
    line = lambda k: F.col("d") * k + F.col("s") * k * (k + 1) / 2
    size = F.abs(line(turn)) + F.abs(line(F.col("ranks").cast("double")) - line(turn))
    return rows.groupBy("ds1", "ds2").agg(F.sum(size).alias("distance"))


def kolmogorov_smirnov(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(ds1, ds2, statistic, threshold, same)."""
    rows = _cumulated(pairs).groupBy("ds1", "ds2").agg(F.max(F.abs(F.col("f") - F.col("g"))).alias("statistic"), F.max("t1").alias("t1"), F.max("t2").alias("t2"))
    limit = F.lit(KS_CONSTANTS[alpha]) * F.sqrt((F.col("t1") + F.col("t2")) / (F.col("t1") * F.col("t2")))
    return rows.select("ds1", "ds2", "statistic", limit.alias("threshold"), (F.col("statistic") <= limit).alias("same"))


def chi_square(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(ds1, ds2, statistic, threshold, same): how well ds1 fits the shares of ds2, over the support of ds2."""
    rows = _shares(pairs).where("n2 > 0")
    part = W.partitionBy("ds1", "ds2")
    rows = rows.withColumn("size", F.sum("n1").over(part)).withColumn("e", F.col("size") * F.col("q"))
    sums = rows.groupBy("ds1", "ds2").agg(F.sum((F.col("n1") - F.col("e")) ** 2 / F.col("e")).alias("statistic"), F.count("*").alias("k"))
    known = [r.k for r in sums.select("k").distinct().collect()]  # one number for each pair of logs
    limit = F.create_map(*[F.lit(v) for k in known for v in (k, chi_square_quantile(alpha, k - 1))])[F.col("k")] if known else F.lit(None).cast("double")
    return sums.select("ds1", "ds2", "statistic", limit.alias("threshold"), (F.col("statistic") <= limit).alias("same"))


def g_statistic(pairs: DataFrame, normal: bool = False) -> DataFrame:
    """(ds1, ds2, statistic): 2 * sum(o * ln(o / e)) over the common support, of counts or of shares."""
    o, e = (F.col("p"), F.col("q")) if normal else (F.col("n1"), F.col("n2"))
    return _shares(pairs).where("n1 > 0 and n2 > 0").groupBy("ds1", "ds2").agg((2 * F.sum(o * F.log(o / e))).alias("statistic"))


def chi_square_quantile(alpha: float, k: int) -> float:
    """The value that a chi-square variable of k degrees exceeds with probability alpha, by bisection of the incomplete gamma function."""
    if k <= 0:
        return 0.0
    low, high = 0.0, k + 40.0 * math.sqrt(2.0 * k) + 40
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - _gamma_p(k / 2, mid / 2) > alpha else (low, mid)
    return (low + high) / 2


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: series for small x, continued fraction else."""
    if x <= 0:
        return 0.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * scale
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - scale * h


def group_similarity(distances: DataFrame, target: str) -> DataFrame:
    """(target_mean, rest_mean, rest_std, deviation, deviations): the target log's mean distance against those among the others; deviation is
    rest minus target."""
    own = (F.col("ds1") == target) | (F.col("ds2") == target)
    sums = distances.agg(F.avg(F.when(own, F.col("distance"))).alias("target_mean"), F.avg(F.when(~own, F.col("distance"))).alias("rest_mean"), F.stddev_pop(F.when(~own, F.col("distance"))).alias("rest_std"))
    gap = F.col("rest_mean") - F.col("target_mean")
    return sums.withColumn("deviation", gap).withColumn("deviations", F.try_divide(gap, F.col("rest_std")))


def matrix_mean(distances: DataFrame, logs: int) -> DataFrame:
    """Mean of the whole square matrix, its zero diagonal included."""
    return distances.agg((F.sum("distance") * 2 / F.lit(logs * logs)).alias("mean"))


def matrix(distances: DataFrame) -> DataFrame:
    """The symmetric matrix as rows (ds1, ds2, distance), with its diagonal."""
    other = distances.select(F.col("ds2").alias("ds1"), F.col("ds1").alias("ds2"), "distance")
    both = distances.select("ds1", "ds2", "distance").unionByName(other)
    return both.unionByName(both.select("ds1").distinct().select("ds1", F.col("ds1").alias("ds2"), F.lit(0.0).alias("distance")))


def z_coverage(z):
    """Share of a normal distribution within z standard deviations, for rounded z-scores."""
    return F.when(z < 0.5, 0.0).when(z < 1.5, 0.6827).when(z < 2.5, 0.9545).when(z < 3.5, 0.9973).otherwise(0.9999)


def classical_mds(names: list[str], d: np.ndarray) -> list[tuple[str, float, float]]:
    """Two coordinates for each log from a full distance matrix; the largest coordinate of each axis is positive."""
    n = len(names)
    centre = np.eye(n) - np.ones((n, n)) / n
    values, vectors = np.linalg.eigh(-0.5 * centre @ (d**2) @ centre)
    axes = []
    for k in np.argsort(-values)[:2]:
        v = vectors[:, k] * np.sqrt(max(values[k], 0))
        axes.append(v * (1 if v[np.abs(v).argmax()] >= 0 else -1))
    return [(name, float(axes[0][k]), float(axes[1][k])) for k, name in enumerate(names)]


def mds(distances: DataFrame) -> DataFrame:
    """(dataset, x, y) from pairwise distances of a few logs."""
    rows = matrix(distances).collect()
    names = sorted({r.ds1 for r in rows})
    d = np.zeros((len(names), len(names)))
    for r in rows:
        d[names.index(r.ds1), names.index(r.ds2)] = r.distance
    return distances.sparkSession.createDataFrame(classical_mds(names, d), "dataset string, x double, y double")
