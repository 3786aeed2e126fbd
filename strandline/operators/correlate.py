"""Interval joins of anchors with candidates, and the three-valued bindings that come of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_pairs(anchors: DataFrame, candidates: DataFrame, name: str, keys: list[str], back: int, forward: int, bucket: int | None = None) -> DataFrame:
    """anchors with a column `name`, the candidate as a struct, for each candidate of equal keys in [t - back, t + forward].

    An anchor never meets itself (equal event_id and event_type).  bucket: width in ms of time buckets that join the
    keys, for keys with very many rows; a candidate has one bucket, an anchor those that its window touches.
    """
    right = candidates.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*candidates.columns).alias(name))
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    left = anchors
    if bucket:
        first, last = F.floor((F.col("time_ms") - back) / bucket), F.floor((F.col("time_ms") + forward) / bucket)
        left = left.withColumn("_bucket", F.explode(F.sequence(first, last)))
        right = right.withColumn("_at", F.floor(F.col(f"{name}.time_ms") / bucket))
        on.append(F.col("_bucket") == F.col("_at"))
    t = F.col(f"{name}.time_ms")
    on += [t >= F.col("time_ms") - back, t <= F.col("time_ms") + forward, F.col(f"{name}.event_id") != F.col("event_id")]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return left.join(right, condition).drop(*[f"_{k}" for k in keys], *(["_bucket", "_at"] if bucket else []))


def bind(
    anchors: DataFrame,
    candidates: DataFrame,
    name: str,
    keys: list[str],
    back: int,
    forward: int,
    count: int = 1,
    relate: Callable[[DataFrame], DataFrame] | None = None,
    bucket: int | None = None,
) -> DataFrame:
    """anchors with name_state (Bound, Absent, Unknown), name_count and name (the earliest match, by time and id).

    relate adds a boolean _true to the pairs, null where it is not known; without it every pair counts.  A binding is
    Bound with count matches, else Unknown where any pair is unknown, else Absent.
    """
    pairs = interval_pairs(anchors, candidates, name, keys, back, forward, bucket)
    pairs = relate(pairs) if relate else pairs.withColumn("_true", F.lit(True))
    place = F.when(F.col("_true"), F.struct(F.col(f"{name}.time_ms"), F.col(f"{name}.event_id")))
    found = pairs.groupBy(F.col("event_id").alias("_anchor")).agg(
        F.count_if("_true").alias(f"{name}_count"), F.min_by(name, place).alias(name), F.bool_or(F.col("_true").isNull()).alias("_open")
    )
    out = anchors.join(found, F.col("event_id") == F.col("_anchor"), "left")
    n = F.coalesce(F.col(f"{name}_count"), F.lit(0))
    state = F.when(n >= count, "Bound").when(F.coalesce("_open", F.lit(False)), "Unknown").otherwise("Absent")
    return out.withColumn(f"{name}_count", n).withColumn(f"{name}_state", state).drop("_anchor", "_open")


def count_around(events: DataFrame, is_anchor: Column, is_candidate: Column, keys: list[str], back: int, forward: int) -> DataFrame:
    """Anchors with n, the candidates around them, in one pass over one stream: a range frame instead of a join."""
    frame = Window.partitionBy(*keys).orderBy("time_ms").rangeBetween(-back, forward)
    own = F.when(is_candidate, 1).otherwise(0)
    return events.withColumn("n", F.sum(own).over(frame) - own).where(is_anchor)
