"""Activity sessions and the quiet gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.ordered import scan

_SHARD_BUCKETS = 4096


def _shard() -> Column:
    return F.floor(F.col("bucket") / _SHARD_BUCKETS)


def _steps(timeline: DataFrame, keys: list[str], threshold_s: float) -> tuple[DataFrame, list[str]]:
    """One row per (key, bucket as wide as the threshold) with the previous bucket's last time.

    Two rows in one bucket are never further apart than the threshold, so a session can
    only break between buckets. The rows are reduced to (first, last, count) per bucket
    before anything is ordered, however many rows a host or an hour holds.
    """
    cutoff = int((threshold_s if threshold_s > 0 else 3600) * 1_000_000)
    base = timeline if keys else timeline.withColumn("_all", F.lit(0))
    ks = keys or ["_all"]
    us = F.unix_micros("date")
    buckets = base.groupBy(*ks, F.call_function("div", us, F.lit(cutoff)).alias("bucket")).agg(
        F.min(us).alias("lo"), F.max(us).alias("hi"), F.count(F.lit(1)).alias("n")
    )
    steps = scan(buckets, ks, _shard(), ["bucket"], before={"prev": F.col("hi")})
    fresh = F.col("prev").isNull() | (F.col("lo") - F.col("prev") > cutoff)
    return steps.withColumn("fresh", fresh), ks


def sessions(timeline: DataFrame, threshold_s: float = 3600, keys: list[str] | None = None) -> DataFrame:
    """Runs of rows no further apart than the threshold: start, end, count, duration."""
    keys = ["host_id"] if keys is None else keys
    steps, ks = _steps(timeline, keys, threshold_s)
    numbered = scan(steps, ks, _shard(), ["bucket"], sums={"session": F.col("fresh").cast("int")})
    out = numbered.groupBy(*ks, "session").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("count"))
    return out.select(
        *keys,
        F.timestamp_micros("lo").alias("start"),
        F.timestamp_micros("hi").alias("end"),
        "count",
        ((F.col("hi") - F.col("lo")) / 1e6).alias("duration_s"),
    )


def gaps(timeline: DataFrame, threshold_s: float = 3600, keys: list[str] | None = None) -> DataFrame:
    """Quiet stretches longer than the threshold, from the row before to the row after."""
    keys = ["host_id"] if keys is None else keys
    steps, _ = _steps(timeline, keys, threshold_s)
    return steps.filter("fresh AND prev IS NOT NULL").select(
        *keys,
        F.timestamp_micros("prev").alias("start"),
        F.timestamp_micros("lo").alias("end"),
        ((F.col("lo") - F.col("prev")) / 1e6).alias("duration_s"),
    )


def longest(spans: DataFrame, n: int) -> DataFrame:
    """The n longest of the given sessions or gaps."""
    return spans.orderBy(F.col("duration_s").desc(), "start").limit(n)
