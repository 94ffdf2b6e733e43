"""Queries over the given tables and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.checks import case_queries, oracle_case, oracle_detections, oracle_timeline, table_queries, timeline_queries
from triagelake.checks.adapters import GivenCase
from triagelake.plans.detections import DETECTIONS, run_all

SIX_HOURS = 6 * 3600.0
# Windows and thresholds that suit the rate of the given events.
PARAMS = {
    "failed_logon_burst": dict(threshold=3, window_s=SIX_HOURS),
    "password_spray": dict(min_accounts=4, window_s=SIX_HOURS),
    "kerberoasting": dict(services=3, window_s=2 * SIX_HOURS),
    "discovery_burst": dict(window_s=SIX_HOURS),
    "recycle_bin_burst": dict(threshold=5, window_s=3 * 3600.0),
    "mass_package_removal": dict(threshold=2),
}


def flat(df: DataFrame) -> DataFrame:
    """Findings as plain columns."""
    return df.select(
        "host_id", "title", "severity", "phase", F.col("technique.attack_id").alias("attack_id"), F.unix_micros("timestamp").alias("ts_us"),
        "detail", F.array_join("evidence", "|").alias("evidence"),
    )


def _detection(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat(DETECTIONS[name][0](GivenCase(spark, sf_dir), **PARAMS.get(name, {})))

    return run


def run_all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every detection in one plan."""
    return flat(run_all(GivenCase(spark, sf_dir), params=PARAMS))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{f"detect_{n}": _detection(n) for n in DETECTIONS}, "run_all_findings": run_all_findings, **timeline_queries.QUERIES, **case_queries.QUERIES, **table_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**{f"detect_{n}": s for n, s in oracle_detections.ORACLES.items()}, "run_all_findings": oracle_detections.run_all(), **oracle_timeline.ORACLES, **oracle_case.ORACLES, **table_queries.ORACLES}
