"""Mixing sources to target shares along a time-varying curriculum.

Within a source, documents follow each other in the order of a hash. A running sum of their tokens places each use of a document on the source's
demand; the source's weight schedule, integrated over training time, is inverted in closed form to turn that place into a training
position, and the uses of all sources are sorted by position. Running sums are taken in two levels (buckets of bounded size, then their sums), so no source
is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querymill.operators.ids import dense_ids
from querymill.session import materialise

BUCKET_ROWS = 20_000
TILT = 0.5
MIXTURE_ROWS = 100_000


def plan(sizes: DataFrame, targets: DataFrame, schedules: DataFrame | None = None) -> DataFrame:
    """(mixture, source, target_share, max_repeats, tokens, demand, slope): for each mixture the largest total at which every source can
    give its share within its repeats. slope tilts the source's weight over time: share * (1 + slope * (2t - 1)); slopes weighted
    by share add up to 0, so the weights add up to 1 at all times. schedules (mixture, source, tilt) says which sources come late (tilt 1) or early (-1), at most so
    much; a source without a row has tilt 0. Without schedules small sources come later.

    Sources of a mixture without any token get no demand, and the others' shares are scaled up to fill in."""
    known = targets.where("mixture is not null and source is not null and target_share > 0 and max_repeats > 0")
    # only sources that a target names, so as many rows as targets at most
    named = sizes.join(F.broadcast(known.select("source").distinct()), "source", "left_semi")
    own = named.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    rows = known.join(F.broadcast(own), "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    mix = W.partitionBy("mixture")  # a mixture has as many rows as sources
    share = F.when(F.col("tokens") > 0, F.col("target_share") / F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).over(mix)).otherwise(0.0)
    rows = rows.withColumn("share", share)
    rows = rows.withColumn("total", F.min(F.when(F.col("share") > 0, F.col("max_repeats") * F.col("tokens") / F.col("share"))).over(mix))
    if schedules is None:
        rows = rows.withColumn("late", 1 - 2 * F.percent_rank().over(mix.orderBy("share", "source")))
    else:
        given = _checked(schedules).where("mixture is not null and source is not null").groupBy("mixture", "source").agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.avg("tilt"))).alias("late"))
        rows = rows.join(F.broadcast(given), ["mixture", "source"], "left").withColumn("late", F.coalesce("late", F.lit(0.0)))
    rows = rows.withColumn("slope", F.lit(TILT) * (F.col("late") - F.sum(F.col("late") * F.col("share")).over(mix)))
    return rows.select("mixture", "source", "target_share", "max_repeats", "tokens", F.coalesce(F.col("share") * F.col("total"), F.lit(0.0)).alias("demand"), "slope")


def offsets(sizes: DataFrame) -> DataFrame:
    """(id, source, n_tokens, start): start is the number of tokens of the source's documents before this one in hash order."""
    rows = sizes.where("source is not null and n_tokens > 0")
    buckets = max(1, -(-rows.count() // BUCKET_ROWS)) * 4
    keyed = materialise(rows.withColumn("h", F.xxhash64("id")).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.lit(buckets))), "mixing-sizes")
    zero = F.lit(0).cast("long")
    bases = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), zero))
    inside = F.coalesce(F.sum("n_tokens").over(W.partitionBy("source", "bucket").orderBy("h", "id").rowsBetween(W.unboundedPreceding, -1)), zero)
    return keyed.withColumn("inside", inside).join(bases.drop("n"), ["source", "bucket"]).select("id", "source", "n_tokens", (F.col("base") + F.col("inside")).alias("start"))


def _checked(targets: DataFrame) -> DataFrame:
    """The targets, of which there may be MIXTURE_ROWS at most; they are broadcast."""
    if targets.limit(MIXTURE_ROWS + 1).count() > MIXTURE_ROWS:
        raise ValueError("more rows of targets than MIXTURE_ROWS")
    return targets


def mix(sizes: DataFrame, targets: DataFrame, schedules: DataFrame | None = None) -> DataFrame:
    """(mixture, position, source, id, repeat_no, n_tokens): the selection of each mixture in training order, from sizes (id, source, n_tokens),
    targets (mixture, source, target_share, max_repeats) and schedules (see plan).

    A document is used at most max_repeats times, each time in another pass over its source; the last pass stops where the demand is met (to the
    nearest document). Documents without tokens or source, and sources that no target names, aren't used. Repeated ids are documents of their own."""
    planned = materialise(plan(sizes, _checked(targets), schedules), "mixing-plan")
    # as many passes over a source as its demand needs, which are max_repeats at most
    passes = F.least(F.col("max_repeats"), F.ceil(F.col("demand") / F.col("tokens") - 1e-9).cast("int"))
    uses = offsets(sizes).join(F.broadcast(planned.where("demand > 0")), "source").withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), passes) - 1)))
    middle = F.col("repeat_no") * F.col("tokens") + F.col("start") + F.col("n_tokens") / 2
    x, a = F.col("x"), F.col("slope")
    root = (F.sqrt((1 - a) * (1 - a) + 4 * a * x) - (1 - a)) / (2 * a)
    placed = uses.withColumn("x", middle / F.col("demand")).where("x <= 1").withColumn("at", F.when(F.abs(a) < 1e-9, x).otherwise(root))
    order = ["mixture", "at", "source", "id", "repeat_no"]
    ranked = materialise(dense_ids(placed.select(*order, "n_tokens"), order, "n"), "mixing-ranked")
    first = ranked.groupBy("mixture").agg(F.min("n").alias("first"))
    return ranked.join(F.broadcast(first), "mixture").select("mixture", (F.col("n") - F.col("first")).alias("position"), "source", "id", "repeat_no", "n_tokens")


def share_report(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """(mixture, source, target_share, actual_share, tokens, uses, most_repeats): one row for each target."""
    uses = selection.groupBy("mixture", "source", "id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"))
    own = uses.groupBy("mixture", "source").agg(F.sum("n").alias("tokens"), F.sum("k").alias("uses"), F.max("k").alias("most_repeats"))
    zero = F.lit(0).cast("long")
    rows = targets.select("mixture", "source", "target_share").join(own, ["mixture", "source"], "left").select("mixture", "source", "target_share", *[F.coalesce(c, zero).alias(c) for c in ("tokens", "uses", "most_repeats")])
    total = F.sum("tokens").over(W.partitionBy("mixture"))
    return rows.withColumn("actual_share", F.coalesce(F.try_divide("tokens", total), F.lit(0.0)))
