"""Interval joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_text(
    samples: DataFrame, segments: DataFrame, *, keys: Sequence[str], time: str, start: str, end: str, text: str, order: str, out: str, window: float = 0.0, bucket: float | None = None
) -> DataFrame:
    """Each sample's texts of the segments active at its time, widened by ``window``, joined by spaces in start order; none: empty.

    A segment is active if ``start <= t + window`` and ``end >= t - window``. With ``bucket`` seconds, both
    sides are also joined on time buckets (a segment is repeated for each bucket that it touches), so a
    long recording is split over tasks instead of comparing all its samples with all its segments.
    """
    spoken = segments.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(text).alias("_x"), F.col(order).alias("_n"))
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    timed = samples
    if bucket:
        spoken = spoken.withColumn("_b", F.explode(F.sequence(F.floor((F.col("_s") - window) / bucket), F.floor((F.greatest("_e", "_s") + window) / bucket))))
        timed = timed.withColumn("_tb", F.floor(F.col(time) / bucket))
        on.append(F.col("_tb") == F.col("_b"))
    on += [F.col("_s") <= F.col(time) + window, F.col("_e") >= F.col(time) - window]
    hit = timed.join(spoken, on).groupBy(*keys, time).agg(F.sort_array(F.collect_list(F.struct("_s", "_n", "_x"))).alias("_l"))
    texts = hit.select(*keys, time, F.array_join(F.transform("_l", lambda x: x["_x"]), " ").alias(out))
    return samples.join(texts, [*keys, time], "left").withColumn(out, F.coalesce(out, F.lit("")))
