import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from querymill.operators import aggregates as agg
from querymill.operators import filters, graph, ids, sampling, series, sets, stats, vectors
from querymill.operators import windows as win
from querymill.plans import queries


def logs(spark, rows):
    return spark.createDataFrame(rows, "serp_query_text_url string, serp_timestamp long")


def test_overlap_exact_and_lowered(spark):
    a, b = logs(spark, [("a", 0), ("b", 0), ("B", 0), ("c", 0), ("c", 0), (None, 0)]), logs(spark, [("b", 0), ("c", 0), ("d", 0)])
    exact = agg.log_overlap(a, b, F.col("serp_query_text_url")).first()
    assert (exact.a, exact.b, exact.either, exact.both) == (4, 3, 5, 2)
    lowered = agg.log_overlap(a, b, F.lower("serp_query_text_url")).first()
    assert (lowered.a, lowered.both) == (3, 2)
    near = agg.log_overlap_estimate(a, b, F.col("serp_query_text_url")).first()
    assert (near.a, near.b, near.both) == (4, 3, 2)


def test_overlap_of_empty_logs(spark):
    none = logs(spark, [])
    row = agg.log_overlap(none, none, F.col("serp_query_text_url")).first()
    assert (row.a, row.either, row.both, row.share_a) == (0, 0, 0, None)


def test_annual_overlap_has_every_year(spark):
    a = logs(spark, [("x", 1_100_000_000), ("y", 1_100_000_000), ("x", None)])
    rows = {r.year: r for r in agg.annual_overlap(a, logs(spark, [("x", None)]), F.col("serp_query_text_url")).collect()}
    assert len(rows) == 24 and (rows[2004].a, rows[2004].both, rows[2004].share_a) == (2, 1, 0.5) and rows[2010].a == 0 and rows[2010].share_a is None
    near = {r.year: r for r in agg.annual_overlap_estimate(a, logs(spark, [("x", None)]), F.col("serp_query_text_url")).collect()}
    assert (near[2004].a, near[2004].both, near[2010].a) == (2, 1, 0)


def test_blacklist_keeps_nulls(spark):
    df = logs(spark, [("#FreeMariaButina", 1), (None, 2), ("ok", 3)])
    assert sorted(r.serp_timestamp for r in filters.not_listed(df).collect()) == [2, 3]


def test_language_modes(spark):
    df = spark.createDataFrame([("open", "de"), ("x", "en-GB"), ("y", None)], "serp_query_text_url string, serp_query_text_url_language string")
    assert [r[0] for r in filters.language(df).collect()] == ["x"] and [r[0] for r in filters.language(df, "reference").collect()] == ["open"]


def test_top_k_breaks_ties_by_text(spark):
    df = spark.createDataFrame([(2000, q, 5) for q in "dcba"] + [(2001, "z", 1)], "year int, q string, n long")
    rows = {(r.year, r.q) for r in win.top_k(df, 2, ["year"], [F.desc("n"), "q"]).collect()}
    assert rows == {(2000, "a"), (2000, "b"), (2001, "z")}
    assert "WindowGroupLimit" in win.top_k(df, 2, ["year"], [F.desc("n"), "q"])._jdf.queryExecution().executedPlan().toString()


def test_rank_steps_and_cut(spark):
    counts = [50, 20, 20, 5, 3, 1, 1]
    df = spark.createDataFrame([("g", f"w{i}", n) for i, n in enumerate(counts)], "g string, w string, n long")
    steps = sorted((r.first_rank, r.last_rank, r.n) for r in win.count_steps(df, ["g"]).collect())
    assert steps == [(1, 1, 50), (2, 3, 20), (4, 4, 5), (5, 5, 3), (6, 7, 1)]
    for t in (0.3, 0.5, 0.6, 0.75, 0.9, 0.999):
        want = sum(c < t for c in np.cumsum(counts) / sum(counts))
        got = win.ranks_below(df, ["g"], t).first().x_max
        assert got == want, (t, got, want)


def test_scaling(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "g string, n double")
    rows = {(r.g, r.n): r for r in win.standardised(win.min_max_scaled(win.max_scaled(df, ["g"]), ["g"], "n"), ["g"], "n").collect()}
    assert rows["a", 1.0].score == 33 and rows["a", 3.0].scaled == 100 and rows["a", 3.0].z == 1 and rows["b", 2.0].scaled is None and rows["b", 2.0].z is None


def dist(spark, **groups):
    return spark.createDataFrame([(g, x, n) for g, d in groups.items() for x, n in d.items()], "dataset string, x long, n long")


def test_shifted_equal_and_disjoint_distributions(spark):
    a = {1: 5, 2: 3, 9: 2}
    df = dist(spark, a=a, b={k + 4: v for k, v in a.items()}, c={k: 2 * v for k, v in a.items()})
    pairs = stats.paired(df, ["a", "b", "c"])
    w = {(r.ds1, r.ds2): r.distance for r in stats.wasserstein(pairs).collect()}
    assert w["a", "b"] == pytest.approx(4) and w["a", "c"] == pytest.approx(0)
    ks = {(r.ds1, r.ds2): r for r in stats.kolmogorov_smirnov(pairs).collect()}
    assert ks["a", "c"].statistic == pytest.approx(0) and ks["a", "c"].same
    tv = {(r.ds1, r.ds2): r.distance for r in stats.total_variation(stats.paired(dist(spark, a={1: 1}, b={2: 7}), ["a", "b"])).collect()}
    assert tv["a", "b"] == 1
    g = {(r.ds1, r.ds2): r.statistic for r in stats.g_statistic(pairs, normal=True).collect()}
    assert g["a", "c"] == pytest.approx(0)


@pytest.mark.parametrize("share", [0.5, 0.957, 0.999])
def test_rank_size_curves_reach_to_the_share(spark, share):
    rng = np.random.default_rng(5)
    counts = {g: (rng.pareto(0.9, size) * 2 + 1).astype(int) for g, size in [("a", 900), ("b", 2500), ("c", 40)]}
    rows = spark.createDataFrame([(g, int(n)) for g, ns in counts.items() for n in ns], "dataset string, n long")
    curves = {g: np.sort(ns)[::-1] for g, ns in counts.items()}
    x_max = max(int((np.cumsum(c) < share * c.sum()).sum()) for c in curves.values())
    cut = {g: np.pad(c, (0, max(0, x_max - len(c))))[:x_max] for g, c in curves.items()}
    assert share < 0.9 or x_max > 200
    got = {(r.ds1, r.ds2): r.distance for r in stats.rank_wasserstein(rows, ["a", "b", "c"], share).collect()}
    for a, b in [("a", "b"), ("a", "c"), ("b", "c")]:
        f, g = (np.cumsum(cut[k]) / cut[k].sum() for k in (a, b))
        assert got[a, b] == pytest.approx(np.abs(f - g).sum(), rel=1e-9)


def test_chi_square_quantile_against_known_values():
    for k, want in ((1, 3.841459), (2, 5.991465), (10, 18.307038), (30, 43.772972)):
        assert stats.chi_square_quantile(0.05, k) == pytest.approx(want, abs=1e-4)


def test_chi_square(spark):
    row = stats.chi_square(stats.paired(dist(spark, a={1: 30, 2: 70}, b={1: 50, 2: 50}), ["a", "b"])).first()
    assert row.statistic == pytest.approx(16) and row.threshold == pytest.approx(3.841459, abs=1e-4) and not row.same


def test_group_similarity_and_mds(spark):
    d = spark.createDataFrame([("a", "b", 3.0), ("a", "c", 4.0), ("b", "c", 5.0)], "ds1 string, ds2 string, distance double")
    row = stats.group_similarity(d, "a").first()
    assert (row.target_mean, row.rest_mean, row.deviation) == (3.5, 5.0, 1.5)
    at = {r.dataset: (r.x, r.y) for r in stats.mds(d).collect()}
    assert math.dist(at["a"], at["b"]) == pytest.approx(3) and math.dist(at["b"], at["c"]) == pytest.approx(5)
    assert stats.matrix_mean(d, 3).first()["mean"] == pytest.approx(24 / 9)


def test_series(spark):
    s = spark.createDataFrame([("2004-01", "q", 4), ("2004-03", "q", 2)], "time string, q string, n long")
    dense = series.dense_months(s, "q", "2004-01-01", "2004-04-01")
    assert [(r.time, r.n) for r in dense.orderBy("time").collect()] == [("2004-01", 4), ("2004-02", 0), ("2004-03", 2), ("2004-04", 0)]
    total = spark.createDataFrame([("2004-01", 8)], "time string, n long")
    assert {r.time: r.share for r in series.share_of_total(dense, total, "q").collect()}["2004-01"] == 0.5
    twin = dense.withColumn("n", F.col("n") * 3 + 1)
    assert series.correlation(dense, twin, "q", "n").first().correlation == pytest.approx(1)
    flat = dense.withColumn("n", F.lit(7))
    assert series.correlation(dense, flat, "q", "n").first().correlation is None


def test_sets(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("a", 2), ("b", 2), ("c", 3), ("a", 1)], "g string, w int")
    assert {(r.ds1, r.ds2): r.shared for r in sets.pairwise_shared(df, "g", "w").collect()} == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}
    assert {r.w for r in sets.in_all(df, "g", "w", 3).collect()} == {1}
    joined = sets.union_logs(spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, "y")], "x int, z string"))
    assert {(r.x, r.z) for r in joined.collect()} == {(1, None), (2, "y")}


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(5000).withColumn("k", F.col("id").cast("string"))
    one, many = (sorted(r.id for r in sampling.fraction(df.repartition(n), 0.1, "k").collect()) for n in (1, 7))
    assert one == many and 350 < len(one) < 650
    assert sampling.to_size(df, 10, "k").count() == 10


def test_dense_ids(spark):
    df = spark.createDataFrame([(w,) for w in "qwertyuiopasdfg"], "w string")
    rows = sorted((r.id, r.w) for r in ids.dense_ids(df.repartition(5), ["w"]).collect())
    assert [i for i, _ in rows] == list(range(15)) and [w for _, w in rows] == sorted("qwertyuiopasdfg")


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    df = spark.createDataFrame(links + [(None, 3)], "a long, b long")
    got = {r.id: r.component for r in graph.components(df).collect()}
    parent = {}

    def find(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for a, b in links:
        if a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    assert got == {k: find(k) for a, b in links if a != b for k in (a, b)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sliced_wasserstein_of_shifted_clouds(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 8))
    shift = np.r_[3.0, np.zeros(7)]
    rows = [("a", v.tolist()) for v in x] + [("b", (v + shift).tolist()) for v in x] + [("a", None), ("b", [1.0])]
    df = spark.createDataFrame(rows, "g string, v array<float>")
    got = vectors.sliced_wasserstein(df, "g", "v", ("a", "b"), 8, 64, 512, reach=8.0).first().distance
    want = np.abs(vectors.directions(8, 64)[0] * 3).mean()
    assert got == pytest.approx(want, abs=0.07)
    assert vectors.sliced_wasserstein(df.where("g = 'a'").union(df.where("g = 'a'").select(F.lit("b"), "v")), "g", "v", ("a", "b"), 8, 16).first().distance == pytest.approx(0)


def test_sliced_wasserstein_of_many_directions(spark, tmp_path):
    x = np.random.default_rng(2).standard_normal((300, 64)).astype(np.float32)
    x[::2] += 0.3
    rows = [(k % 2, [float(v) for v in r]) for k, r in enumerate(x)]
    spark.createDataFrame(rows, "label int, embedding array<float>").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.sliced_wasserstein(spark, str(tmp_path)).first()
    d = vectors.directions(64, 16_000)
    exact = np.abs(np.sort(x[::2] @ d, axis=0) - np.sort(x[1::2] @ d, axis=0)).mean()
    assert got.projections == 16_000
    assert got.distance == pytest.approx(exact, abs=2 * float(np.linalg.norm(x, axis=1).max()) / 512)


def test_communities_and_projection(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((3, 16)) * 5
    rows = [(i, (centres[i % 3] + rng.standard_normal(16) * 0.1).tolist()) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = vectors.communities(df, "id", "v", 16, 0.9, 5, block=16).collect()
    sets_ = {}
    for r in got:
        sets_.setdefault(r.cluster_id, set()).add(r.id)
    assert sorted(map(sorted, sets_.values())) == sorted(sorted(range(k, 60, 3)) for k in range(3))
    assert vectors.project(df, "id", "v", 16).count() == 60


def test_intermediate_tables_are_removed(spark):
    from pathlib import Path

    from querymill.session import materialise, new_path, scratch

    folder = Path(new_path(spark, "x").removeprefix("file://")).parent
    with scratch(spark):
        before = set(folder.iterdir()) if folder.exists() else set()
        assert materialise(spark.range(3), "gone").count() == 3
        assert len(set(folder.iterdir()) - before) == 1
    assert set(folder.iterdir()) == before


def test_resampling_with_replacement(spark):
    df = spark.range(50).withColumnRenamed("id", "k").repartition(3)
    rows = sampling.resample(df, 400, "k").collect()
    assert sorted(r.draw for r in rows) == list(range(400)) and 40 < len({r.k for r in rows}) <= 50
    assert sampling.resample(df.limit(0), 10, "k").count() == 0


def test_pair_overlaps_and_statistics(spark):
    rows = [("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("c", "z"), ("c", None), ("d", "q")]
    df = spark.createDataFrame(rows, "d string, v string")
    got = {(r.ds1, r.ds2): (r.a, r.b, r.either, r.both, r.all_logs) for r in agg.pair_overlaps(df, "d", F.col("v"), ["a", "b", "c"]).collect()}
    assert got == {("a", "b"): (2, 1, 2, 1, 3), ("a", "c"): (2, 1, 3, 0, 3), ("b", "c"): (1, 1, 2, 0, 3)}
    close = {(r.ds1, r.ds2): r.both for r in agg.pair_overlap_estimates(df, "d", F.col("v"), ["a", "b", "c"]).collect()}
    assert close == {("a", "b"): 1, ("a", "c"): 0, ("b", "c"): 0}
    row = sets.overlap_statistics(df, "d", "v", ["a", "b", "c"], "c").first()
    assert (row.target_mean, row.rest_mean, row.rest_var) == (0.0, 1.0, 0.0)


def test_shares_slices_and_rewrites(spark):
    counts = spark.createDataFrame([("a", 2), ("b", 3)], "d string, n long")
    sizes = spark.createDataFrame([("a", 8)], "d string, size long")
    assert {r.d: r.share for r in agg.share_of_sizes(counts, sizes, ["d"]).collect()} == {"a": 0.25, "b": None}
    assert [r.id for r in win.slice_of(spark.range(20), 4, 3, ["id"]).collect()] == [4, 5, 6]
    assert [r.d for r in filters.rewritten(counts, "d", {"a": "c"}).orderBy("d").collect()] == ["b", "c"]
    v = vectors.centred(spark.createDataFrame([([1.0, 2.0],), ([3.0, 6.0],), (None,)], "v array<double>"), "v").collect()
    assert sorted(r.centred for r in v if r.centred) == [[-1.0, -2.0], [1.0, 2.0]]
