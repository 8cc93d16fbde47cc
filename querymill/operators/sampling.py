"""Samples that don't depend on how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.operators.ids import dense_ids


def draw(seed: int, *parts: Column | str) -> Column:
    """A number below 16 ** 12, evenly spread and the same on every engine: from the md5 of the seed and the parts as texts. Null if a part is."""
    text = F.concat(F.lit(f"{seed}|"), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def fraction(df: DataFrame, share: float, key: str, seed: int = 42) -> DataFrame:
    """Rows whose hashed key falls below the share; rows with equal keys are in or out together. A null key is out."""
    return df.where(F.pmod(draw(seed, key), F.lit(1_000_000)) < round(share * 1_000_000))


def to_size(df: DataFrame, rows: int, key: str, seed: int = 42) -> DataFrame:
    """As many rows as asked for, those with the smallest hash; all if there are fewer. Null keys come first."""
    return df.orderBy(draw(seed, key), key).limit(rows)


def resample(df: DataFrame, draws: int, key: str, seed: int = 42) -> DataFrame:
    """(draw, columns of df): draws rows, each uniformly out of all, with replacement. Draws pick positions in the order of the key, so that they are joined to
    rows by an equi-join."""
    placed = dense_ids(df, [key], "__place")
    size = placed.agg(F.count("*").alias("__rows"))  # one row
    picks = df.sparkSession.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(size), F.col("__rows") > 0)
    picks = picks.select("draw", F.pmod(draw(seed, "draw"), F.col("__rows")).alias("__place"))
    return picks.join(placed, "__place").drop("__place")
