import random
from collections import defaultdict

from querymill.llm import packing as p


def check(spark, sizes, containers, **bounds):
    df = spark.createDataFrame(sizes, "id long, n_tokens long").repartition(3)
    boxes = spark.createDataFrame(containers, "container string, capacity_tokens int")
    rows = p.pack(df, boxes).collect()
    for name, capacity in containers:
        own = [r for r in rows if r.container == name]
        bins, items = defaultdict(int), defaultdict(list)
        for r in own:
            bins[r.bin_id] += r.n_tokens
            items[r.id].append((r.first_token, r.n_tokens))
        assert max(bins.values(), default=0) <= capacity
        want = defaultdict(int)
        for i, n in sizes:
            want[i] += n
        assert {i: sum(n for _, n in x) for i, x in items.items()} == dict(want)
        if len({i for i, _ in sizes}) == len(sizes):
            for i, n in sizes:
                at = 0
                for first, size in sorted(items[i]):
                    assert first == at
                    at += size
                assert n > capacity or len(items[i]) == 1
        if "share" in bounds and sum(n for _, n in sizes):
            assert len(bins) <= -(-sum(n for _, n in sizes) // capacity) * bounds["share"] + 1
    return rows


def test_packing_is_whole_and_tight(spark):
    r = random.Random(0)
    sizes = [(i, int(min(9000, r.lognormvariate(5, 1)))) for i in range(3000)]
    check(spark, sizes, [("s", 512), ("m", 2048)], share=1.01)


def test_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(p, "TASK_ITEMS", 200)
    r = random.Random(1)
    check(spark, [(i, r.randint(1, 60)) for i in range(3000)], [("s", 100)], share=1.03)


def test_items_that_fit_with_no_other_end(spark, monkeypatch):
    monkeypatch.setattr(p, "TASK_ITEMS", 50)
    rows = check(spark, [(i, 60) for i in range(500)], [("s", 100)])
    assert len({r.bin_id for r in rows}) == 500


def test_edges(spark):
    rows = check(spark, [(1, 0), (2, 100), (3, 250), (4, 0), (5, 50)], [("s", 100)])
    assert len({r.bin_id for r in rows}) == 4
    assert check(spark, [], [("s", 100)]) == [] and check(spark, [(1, 5)], [("bad", 0)][:0]) == []
    check(spark, [(7, 30), (7, 30), (7, 80)], [("s", 100)])  # a repeated id


def test_best_fit():
    assert sorted(map(sorted, p.best_fit([5, 4, 6, 5, 1], 10))) == [[0, 3], [1, 2], [4]]


def test_fill_report(spark):
    df = spark.createDataFrame([(1, 50), (2, 50), (3, 30)], "id long, n_tokens long")
    boxes = spark.createDataFrame([("s", 100)], "container string, capacity_tokens int")
    row = p.fill_report(p.pack(df, boxes), boxes).first()
    assert (row.bins, row.tokens, row.least_bins, row.fill) == (2, 130, 2, 0.65)
