"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule over training time t from 0 to 1, a straight line around its target. Its integral
``D(t) = target * ((1 - a) * t + a * t * t)`` is the source's cumulative token demand, with ``a`` in [-1, 1] the ramp:
above 0 the source comes late, below 0 early. The documents of a source stand in one fixed shuffled order, repeated as
passes; the occurrence whose middle lies at token m of that stream is trained at ``D^-1(m)``, and taken if m is below
the target. Sorting by that position mixes all sources by their schedules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logicspark.llm.shared import cut, digest_bucket, id_digest, root_buckets

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
RAMPS = (0.0, 0.5, -0.5)
MOST_REPEATS = 3
#: Sources up to this many are sent to all executors; a row of that table is under 200 bytes plus the name.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: Sequence[float], ramps: Sequence[float], most: int) -> DataFrame:
    """One row per source of ``sources`` (source, source_size), with place, weight, ramp and target.

    Weights repeat over the sources by code point, null last. Water filling: sorted by the level at which each source
    is full, the first level that its own source does not reach is the common one."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1

    def cycle(values: Sequence[float]) -> Column:
        return F.array(*[F.lit(float(v)) for v in values])[F.col("place") % len(values)]

    rows = sources.select("source", "source_size", place.alias("place")).select(
        "*", cycle(weights).alias("weight"), cycle(ramps).alias("ramp"), (F.col("source_size") * most).alias("cap")
    )
    everything = Window.partitionBy(F.lit(0))
    filled = everything.orderBy(F.col("cap") / F.col("weight"), "place")
    before, rest = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    ) / F.sum("weight").over(rest)
    rows = rows.withColumn("level", level)
    common = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything)
    return rows.withColumn("target", F.least(F.col("cap").cast("double"), common * F.col("weight"))).drop("level", "cap")


def position(middle: Column, target: Column, ramp: Column) -> Column:
    """Time at which the integrated schedule reaches ``middle`` tokens: the root of the quadratic, without cancelling."""
    share = middle / target
    return 2 * share / ((1 - ramp) + F.sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * share))


def curriculum(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    ramps: Sequence[float] = RAMPS,
    most: int = MOST_REPEATS,
) -> DataFrame:
    """Plan of the mix: one row per row of ``docs`` (doc_id, text, source; further columns are ignored).

    Returns doc_id, source, size, source_size, target, taken, positions (training positions, ascending) and text_key
    (tells apart rows of one id). A null text has size 0, a null source is a source of its own, the last. A null id
    counts as the empty one, equal rows are placed one after the other. No rows give no rows.

    The running sums come from buckets of the shuffled order, so no source sits in one task."""
    sized = cut(
        docs.select(
            "doc_id",
            "source",
            word_count(F.col("text")).alias("size"),
            F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_key"),
        )
    )
    buckets = root_buckets(sized.count())
    sources = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, ramps, most))
    named = sources.withColumnRenamed("source", "named")
    if sources.count() <= BROADCAST_SOURCES:
        named = F.broadcast(named)
    digest = id_digest(F.col("doc_id"))
    rows = (
        sized.join(named, F.col("source").eqNullSafe(F.col("named")))
        .drop("named")
        .withColumn("digest", digest)
        .withColumn("bucket", digest_bucket(F.col("digest"), buckets))
    )
    earlier = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("place", "bucket")
        .agg(F.sum("size").alias("bucket_size"))
        .select("place", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("offset"))
    )
    inside = (
        Window.partitionBy("place", "bucket")
        .orderBy("digest", "size", "text_key")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    middle = F.col("offset") + F.coalesce(F.col("inner"), F.lit(0)) + F.col("size") / 2
    passes = F.expr(f"transform(sequence(0, {most - 1}), p -> middle + p * source_size)")
    return (
        rows.withColumn("inner", F.sum("size").over(inside))
        .join(offsets, ["place", "bucket"])
        .withColumn("middle", middle)
        .withColumn("middles", F.filter(passes, lambda m: m < F.col("target")))
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            (F.size("middles") * F.col("size")).cast("bigint").alias("taken"),
            F.transform("middles", lambda m: position(m, F.col("target"), F.col("ramp"))).alias("positions"),
            "text_key",
        )
    )


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, repeated as planned and range-sorted by position.

    Documents of size 0 are kept once, at the end. Repeated rows count once each."""
    keys = ["_id", "_source", "_key"]
    plan = cut(
        curriculum(docs, **options).select(
            F.col("doc_id").alias("_mix_id"),
            F.col("source").alias("_mix_source"),
            F.col("text_key").alias("_mix_key"),
            F.when(F.col("size") == 0, F.array(F.lit(1.0))).otherwise(F.col("positions")).alias("_mix_at"),
        )
    )
    rows = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.col("doc_id").alias("_own_id"),
        F.col("source").alias("_own_source"),
        F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_own_key"),
    )
    same = (
        F.col("_own_id").eqNullSafe(F.col("_mix_id"))
        & F.col("_own_source").eqNullSafe(F.col("_mix_source"))
        & (F.col("_own_key") == F.col("_mix_key"))
    )
    if plan.count() != plan.select("_mix_id", "_mix_source", "_mix_key").distinct().count():
        # Equal rows have a plan each: number both sides, so that the join pairs them one to one.
        def nth(side: str):
            return F.row_number().over(Window.partitionBy(*[f"_{side}{k}" for k in keys]).orderBy(F.lit(0)))

        rows, plan = rows.withColumn("_own_nth", nth("own")), plan.withColumn("_mix_nth", nth("mix"))
        same &= F.col("_own_nth") == F.col("_mix_nth")
    return (
        rows.join(plan, same)
        .withColumn("_mix_position", F.explode("_mix_at"))
        .orderBy("_mix_position", "_mix_id", "_mix_key")
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
