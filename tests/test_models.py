from pyspark.sql import types as T

from querymill.operators import models


def test_predict(spark):
    load = lambda: lambda texts: [len(t) for t in texts]
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, ""), (4, "abc")], "i int, t string")
    got = {r.i: r.n for r in models.predict(df, "t", "n", T.LongType(), load).collect()}
    assert got == {1: 3, 2: None, 3: 0, 4: 3}
    assert models.predict(df.limit(0), "t", "n", T.LongType(), load).count() == 0


def test_extract(spark):
    words = lambda: lambda texts: [[{"word": w, "at": k} for k, w in enumerate(t.split())] for t in texts]
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "a b")], "i int, t string")
    item = T.StructType([T.StructField("word", T.StringType()), T.StructField("at", T.LongType())])
    rows = models.extract(df, "t", item, words, ["i"]).collect()
    assert sorted(map(tuple, rows)) == [(1, "a", 0), (1, "b", 1), (4, "a", 0), (4, "b", 1)]
