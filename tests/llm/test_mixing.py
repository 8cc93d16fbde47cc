import random
from collections import defaultdict

import pytest

from querymill.llm import mixing as m

SIZES = "id long, source string, n_tokens long"
TARGETS = "mixture string, source string, target_share double, max_repeats int"


def run(spark, sizes, targets):
    s, t = spark.createDataFrame(sizes, SIZES).repartition(3), spark.createDataFrame(targets, TARGETS)
    selection = m.mix(s, t)
    return selection.collect(), {(r.mixture, r.source): r for r in m.share_report(selection, t).collect()}


def brute_total(sizes, targets, mixture):
    tokens = defaultdict(int)
    for _, s, n in sizes:
        tokens[s] += n
    return min(k * tokens[s] / share for x, s, share, k in targets if x == mixture and tokens[s])


@pytest.mark.parametrize("bucket", [20_000, 7])
def test_shares_repeats_and_order(spark, monkeypatch, bucket):
    monkeypatch.setattr(m, "BUCKET_ROWS", bucket)
    r = random.Random(0)
    sizes = [(i, r.choice(["a", "a", "a", "b", "c"]), r.randint(1, 40)) for i in range(3000)] + [(9001, None, 5), (9002, "zz", 5), (9003, "a", 0)]
    targets = [("x", "a", 0.2, 1), ("x", "b", 0.5, 3), ("x", "c", 0.3, 2), ("y", "a", 1.0, 2)]
    rows, shares = run(spark, sizes, targets)
    for (mixture, _), row in shares.items():
        assert row.actual_share == pytest.approx(row.target_share, abs=0.004)
    assert shares["x", "b"].most_repeats <= 3 and shares["y", "a"].most_repeats == 2
    for mixture in "xy":
        own = sorted((q for q in rows if q.mixture == mixture), key=lambda q: q.position)
        assert [q.position for q in own] == list(range(len(own)))
        assert sum(q.n_tokens for q in own) == pytest.approx(brute_total(sizes, targets, mixture), rel=0.01)
        passes = defaultdict(list)
        for q in own:
            passes[q.id].append(q.repeat_no)
        assert all(p == sorted(set(p)) for p in passes.values())  # each use in another pass, the passes in order
    x = sorted((q for q in rows if q.mixture == "x"), key=lambda q: q.position)
    half = len(x) // 2
    early, late = (sum(q.n_tokens for q in part if q.source == "a") / sum(q.n_tokens for q in part) for part in (x[:half], x[half:]))
    assert early < late  # the smallest share comes later


def test_a_source_without_tokens(spark):
    rows, shares = run(spark, [(1, "a", 10), (2, "a", 10)], [("x", "a", 0.5, 1), ("x", "b", 0.5, 2)])
    assert len(rows) == 2 and shares["x", "b"].actual_share == 0 and shares["x", "a"].actual_share == 1


def test_empty(spark):
    rows, shares = run(spark, [], [("x", "a", 1.0, 1)])
    assert rows == [] and shares["x", "a"].actual_share == 0
    rows, shares = run(spark, [(1, "a", 3)], [])
    assert rows == [] and shares == {}
