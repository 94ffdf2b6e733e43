"""Tiered look-up of indicators in feed tables, and the verdict cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFINITIVE = ["knownGood", "malicious", "suspicious"]
# Tiers in order.
TIERS = {0: "NSRL", 1: "Threat Intel", 2: "VirusTotal"}


def key(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.lower(F.regexp_replace(value, r"^\s+|\s+$", "")))


def unique_indicators(indicators: DataFrame) -> DataFrame:
    """(kind, value) pairs once per key, the first spelling by position kept."""
    pos = F.col("pos") if "pos" in indicators.columns else F.col("value")
    return indicators.groupBy(key(F.col("kind"), F.col("value")).alias("key"), "kind").agg(F.min_by("value", F.struct(pos, "value")).alias("indicator"))


def set_feed(values: DataFrame, tier: int, order: int, source: str, verdict: str) -> DataFrame:
    """A known-good or known-bad hash list as a feed."""
    return values.select(
        F.lit(tier).alias("tier"), F.lit(order).alias("provider_order"), F.lit(source).alias("source"), F.lit("hash").alias("kind"),
        F.col("value"), F.lit(verdict).alias("verdict"), F.lit(None).cast("string").alias("detail"),
    )


def enrich(indicators: DataFrame, feeds: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """One verdict per indicator: the first definitive one by tier; else the first that found
    nothing; else the first error; else unknown. A cached verdict is taken as it is.
    """
    wanted = unique_indicators(indicators)
    rank = F.when(F.col("verdict").isin(DEFINITIVE), 0).when(F.col("verdict") == "unknown", 1).otherwise(2)
    order = F.struct(rank.alias("c"), "tier", "provider_order")
    # Per key the feeds are reduced to their best row before the join.
    best = feeds.groupBy(key(F.col("kind"), F.col("value")).alias("key")).agg(F.min_by(F.struct("verdict", "source", "tier", "detail"), order).alias("v"))
    if cache is not None:
        seen = cache.select("key", F.struct("verdict", "source", "tier", "detail").alias("c"))
        best = best.join(seen, "key", "full").select("key", F.coalesce("c", "v").alias("v"))
    out = wanted.join(best, "key", "left")
    none = F.lit("No source knows it.")
    return out.select(
        "key", "kind", "indicator",
        F.coalesce("v.verdict", F.lit("unknown")).alias("verdict"),
        F.coalesce("v.source", F.lit("—")).alias("source"),
        F.coalesce("v.tier", F.lit(0)).alias("tier"),
        F.when(F.col("v").isNull(), none).otherwise(F.coalesce("v.detail", F.lit(""))).alias("detail"),
    )


def merge_cache(cache: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The latest verdict per key (by retrieved_at)."""
    both = cache.unionByName(verdicts, allowMissingColumns=True)
    fields = [c for c in both.columns if c != "key"]
    latest = both.groupBy("key").agg(F.max_by(F.struct(*fields), F.struct("retrieved_at", "verdict", "source")).alias("v"))
    return latest.select("key", "v.*")
