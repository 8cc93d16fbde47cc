import random

import numpy as np
import pytest

from querymill.llm import heavy_items as h


def test_code_round_trip_with_errors():
    rng = np.random.default_rng(0)
    for fp in rng.integers(0, 1 << h.FP_BITS, 40):
        word = int(h.encode(np.array([fp]))[0])
        symbols = np.array([(word >> (4 * j)) & 15 for j in range(h.SYMBOLS)])
        trust = np.full(h.SYMBOLS, 10.0)
        for j in rng.choice(h.SYMBOLS, 4, replace=False):
            symbols[j] ^= int(rng.integers(1, 16))
            trust[j] = 1
        assert h.decode(symbols, trust) == fp


def test_packing_of_counters():
    for top in (3, 300, 70_000, 1 << 40):
        x = np.array([0, 1, top], np.int64)
        assert (h._unpack(h._pack(x)) == x).all()


def brute(values, share):
    kept = [v for v in values if v is not None]
    return {(v, kept.count(v)) for v in set(kept) if kept.count(v) * 1_000_000 >= len(kept) * round(share * 1_000_000)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    values = ["hot"] * 3000 + [f"w{int(r.paretovariate(0.9))}" for _ in range(4000)] + [f"u{i}" for i in range(2000)] + [None] * 500 + [""] * 120
    r.shuffle(values)
    df = spark.createDataFrame([(v, 1) for v in values], "v string, n int").repartition(5)
    for share in (0.004, 0.05):
        rows = h.heavy_items(df.select("v"), "v", share).collect()
        assert {(x.v, x.n) for x in rows} == brute(values, share)
        assert all(abs(x.approx_n - x.n) <= 0.01 * len(values) for x in rows)


def test_many_equally_frequent_values(spark):
    values = [f"v{i % 200}" for i in range(10_000)]  # each holds exactly 0.5 %
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(3)
    assert {x.v for x in h.heavy_items(df, "v", 0.004).collect()} == set(values)


def test_empty_null_and_single(spark):
    df = spark.createDataFrame([(None,), (None,)], "v string")
    assert h.heavy_items(df, "v").count() == 0 and h.heavy_items(df.limit(0), "v").count() == 0
    one = spark.createDataFrame([("x" * 100_000,)], "v string")
    assert h.heavy_items(one, "v").first().n == 1
