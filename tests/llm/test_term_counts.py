import random
from collections import defaultdict

from querymill.llm import term_counts as t

SCHEMA = "record_id long, word string, n long, term string, record string"


def brute(rows, rare, common):
    best, loose = {}, defaultdict(list)
    for r, w, n, *_ in rows:
        if w is None:
            continue
        n = 1 if n is None else n
        if r is None:
            loose[w].append(n)
        else:
            best[w, r] = max(n, best.get((w, r), n))
    total = len({r for r, w, *_ in rows if w is not None and r is not None})
    out = set()
    for w in {w for w, _ in best} | set(loose):
        records = sum(1 for a, _ in best if a == w)
        mark = "rare" if records <= rare else "common" if records * 1_000_000 > total * round(common * 1_000_000) else None
        out.add((w, sum(n for (a, _), n in best.items() if a == w) + sum(loose[w]), records, mark))
    return out


def found(spark, rows, rare=2, common=0.3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {tuple(r) for r in t.term_counts(df, "record_id", "word", "n", rare, common).collect()}


def test_against_brute_force(spark):
    r = random.Random(2)
    rows = [(r.choice([None, *range(80)]), r.choice([None, "hot", "hot", "hot", *(f"w{int(r.paretovariate(0.7))}" for _ in range(3))]), r.choice([1, 2, 3, None]), "x", "y") for _ in range(3000)]
    rows += rows[:500]
    assert found(spark, rows) == brute(rows, 2, 0.3)


def test_many_blocks_and_a_shuffled_dictionary(spark, monkeypatch):
    monkeypatch.setattr(t, "BROADCAST_TERMS", 10)
    rows = [(i % 50, f"t{i % 9000}", 1, "x", "y") for i in range(10_000)]
    assert found(spark, rows) == brute(rows, 2, 0.3)


def test_bounds(spark):
    rows = [(i, "a", 1, "", "") for i in range(3)] + [(i, "b", 1, "", "") for i in range(2)] + [(i, "c", 1, "", "") for i in range(10)]
    got = {w: m for w, _, _, m in found(spark, rows, 2, 0.3)}
    assert got == {"a": None, "b": "rare", "c": "common"}  # 3 of 10 isn't more than 30 %


def test_empty(spark):
    assert found(spark, []) == set() and found(spark, [(1, None, 1, "", "")]) == set()
