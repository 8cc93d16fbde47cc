import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from querymill.llm import format_dups as d

SCHEMA = "id long, text string, user string, ts long, key string"


def canon(t):
    low, fields = t.lower(), []
    ops = "|".join(d.FIELD_OPERATORS)
    low = re.sub(rf"(?<![^\W_])(?:{ops}):\S+", lambda m: fields.append(" ".join(re.findall(r"[^\W_]+", m[0]))) or " ", low)
    return " ".join(re.findall(r"[^\W_]+", low)), tuple(sorted(fields))


def brute(rows):
    groups = defaultdict(list)
    for i, t, u, ts, _ in rows:
        if i is not None and t is not None and u is not None and canon(t) != ("", ()):
            groups[canon(t), u, ts].append(i)
    return {(min(g), i) for g in groups.values() for i in g if i != min(g)}


def found(spark, rows, parts=4):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return {tuple(r) for r in d.format_copies(df, "id", "text", ["user", "ts"], ["user"]).collect()}


def test_forms(spark):
    texts = ["red Car site:a.example x", "site:A.EXAMPLE red—car, x", "RED car x site:a.example", "red x car site:a.example", "red car x", "red_car　x", "...", "", None, "intitle:b red", "red intitle:b", "red intitle b"]
    rows = [(i, t, "u", None if i % 2 else 5, "k") for i, t in enumerate(texts)]
    rows += [(i + 100, t, "u", 5, "k") for i, t in enumerate(texts)] + [(i + 200, t, None, 5, "k") for i, t in enumerate(texts)]
    assert found(spark, rows) == brute(rows)


def test_random_rows_and_a_hot_group(spark):
    r = random.Random(4)
    rows = []
    for i in range(3000):
        words = [r.choice("red blue car dog".split()) for _ in range(r.randint(1, 5))]
        if r.random() < 0.2:
            words.insert(r.randint(0, len(words)), "site:" + r.choice("ab") + ".x")
        t = r.choice([" ", "  ", "-", "/"]).join(words) if not any(":" in w for w in words) else " ".join(words)
        rows.append((i, t.upper() if r.random() < 0.3 else t, r.choice("uv"), r.choice([None, 1, 2]), "k"))
    rows += [(10_000 + i, "same Text", "hot", 1, "k") for i in range(1500)]
    assert found(spark, rows, 7) == brute(rows)


def test_filter_never_misses_a_repeat_and_leaves_most_singletons(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(4000)] + [(f"k{i}",) for i in range(0, 4000, 10)] + [(None,)], "key string").repartition(6)
    kept = [r.key for r in d.possible_repeats(df, "key").collect()]
    assert all(kept.count(f"k{i}") == 2 for i in range(0, 4000, 10)) and len(kept) < 1600


def test_many_chunks_of_a_filter_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(d, "CHUNK_BITS", 8)
    monkeypatch.setattr(d, "MOST_CHUNK_BITS", 10)
    monkeypatch.setattr(d, "ROWS_A_TASK", 500)
    df = spark.createDataFrame([(i, f"k{i % 2900}", None) for i in range(3000)], "i int, key string, __other int").repartition(5)
    kept = [r.key for r in d.possible_repeats(df, "key").collect()]
    assert all(kept.count(f"k{i}") == 2 for i in range(100)) and len(kept) < 700


def test_collapse_counts_every_row(spark):
    rows = [(1, "a b", "u", 1, "k"), (2, "A-B", "u", 1, "k"), (3, "c", "u", 1, "k"), (4, None, "u", 1, "k"), (5, "...", "u", 1, "k"), (6, "a b", None, 1, "k")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.first_id: r.copies for r in d.collapse(df, "id", "text", ["user", "ts"], ["user"]).collect()}
    assert got == {1: 2, 3: 1, 4: 1, 5: 1, 6: 1}


def test_empty_and_very_long(spark):
    assert found(spark, []) == set()
    long = "word " * 40_000
    rows = [(1, long, "u", 1, "k"), (2, long.upper(), "u", 1, "k")]
    assert found(spark, rows) == {(1, 2)}


def test_null_key_is_dropped(spark):
    df = spark.createDataFrame([(1, None)], "id long, key string")
    assert d.possible_repeats(df, "key").where(F.lit(True)).count() == 0
