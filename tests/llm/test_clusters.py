import numpy as np
import pytest

from querymill.llm import clusters as c

DIM = 16


def brute(rows, least, smallest):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == DIM and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent = {i: i for i, _ in good}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k, (i, a) in enumerate(good):
        for j, b in good[k + 1 :]:
            if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    sets = {}
    for i, _ in good:
        sets.setdefault(find(i), []).append(i)
    return {(min(s), i) for s in sets.values() if len(s) >= smallest for i in s}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for k in range(25):
        centre = rng.standard_normal(DIM)
        out += [(centre + rng.standard_normal(DIM) * 0.12) * rng.uniform(0.5, 3) for _ in range(rng.integers(1, 14))]
    out += list(rng.standard_normal((120, DIM)))
    path = [np.r_[np.cos(a), np.sin(a), np.zeros(DIM - 2)] for a in np.arange(0, 3, 0.2)]  # a chain: its ends aren't similar
    hot = [np.ones(DIM)] * 150 + [np.ones(DIM) * 2.0] * 30
    listed = [[float(np.float32(x)) for x in v] for v in out + path + hot]
    listed += [None, [0.0] * DIM, [1.0] * (DIM - 1), [float("nan")] * DIM, [None] * DIM, []]
    order = rng.permutation(len(listed))
    return [(int(i), listed[k]) for i, k in enumerate(order)] + [(None, listed[0])]


@pytest.mark.parametrize("node_rows", [8192, 60, 15])
def test_against_brute_force(spark, rows, node_rows):
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "i long, v array<float>, id long").repartition(3)
    got = {tuple(r) for r in c.similarity_clusters(df, "i", "v", DIM, 0.85, 3, node_rows=node_rows).collect()}
    assert got == brute(rows, 0.85, 3)


def test_leaves_are_compact_and_whole(spark, rows):
    df = spark.createDataFrame(rows, "i long, v array<float>")
    leaves = c.leaf_report(df, "i", "v", DIM, node_rows=100).collect()
    usable = sum(1 for i, v in rows if i is not None and v and len(v) == DIM and None not in v and np.isfinite(v).all() and any(v))
    assert sum(r["size"] for r in leaves) == usable
    assert all(r.least_cosine >= c.COMPACT - 1e-5 and 1 <= len(r.typical.split()) <= 3 for r in leaves)


def test_only_leaves_that_may_hold_a_similar_pair_are_compared(rows):
    good = [v for i, v in rows if i is not None and v and len(v) == DIM and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array(good, np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    leaf = c.bisect(x)
    assert (c.local_sets(x, 0.85, leaf) == c.local_sets(x, 0.85)).all()
    near, far = np.eye(DIM, dtype=np.float32)[0], np.eye(DIM, dtype=np.float32)[1]
    pair = np.stack([near, far, near, far])
    blocks = list(c.leaf_blocks(pair[:1], np.zeros(1, int), pair, np.array([0, 1, 0, 1]), 0.85))
    assert [(a.tolist(), sorted(b.tolist())) for a, b in blocks] == [([0], [0, 2])]
    assert list(c.leaf_blocks(pair[:1], np.zeros(1, int), pair[1::2], np.zeros(2, int), 0.85)) == []


def test_empty_table(spark):
    df = spark.createDataFrame([], "i long, v array<float>")
    assert c.similarity_clusters(df, "i", "v", DIM).count() == 0 and c.leaf_report(df, "i", "v", DIM).count() == 0


def test_local_sets_unite_streams_of_pairs():
    x = np.array([[1, 0], [0.999, 0.04], [0, 1], [0.04, 0.999], [-1, 0]], np.float32)
    assert c.local_sets(x, 0.99).tolist() == [0, 0, 2, 2, 4]
