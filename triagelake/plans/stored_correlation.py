"""Correlation over stored partial results, so that a new host costs its own events only.

What correlation needs of a host is a few small aggregates: its accounts, logon sources and indicators, its counts by
(source, target, account) of remote logons, and the computers its events name. They are stored by host, and all of them
merge: distinct values by union, counts by sums, times by minimum and maximum. The cross-host results are computed
from these tables and equal those of a rebuild over all events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake import commits
from triagelake.operators import correlation, lateral
from triagelake.operators.findings import union
from triagelake.tables import CaseTables

VALUES = T.StructType([T.StructField(n, T.StringType()) for n in ("host_id", "kind", "value", "shown")] + [T.StructField("first", T.TimestampType())])
LOGONS = T.StructType([
    T.StructField("host_id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("target", T.StringType()), T.StructField("user", T.StringType()),
    T.StructField("count", T.LongType()), T.StructField("failures", T.LongType()), T.StructField("types", T.ArrayType(T.IntegerType())),
    T.StructField("first_seen", T.TimestampType()), T.StructField("last_seen", T.TimestampType()),
])
USER, SOURCE, INDICATOR, LABEL, COMPUTER = "user", "source_ip", "indicator", "label", "computer"


def _values(t, matches: DataFrame | None) -> DataFrame:
    def part(rows: DataFrame, kind: str, value: str, shown: str | None = None, at: str | None = None) -> DataFrame:
        first = F.col(at) if at else F.lit(None).cast("timestamp")
        return rows.select("host_id", F.lit(kind).alias("kind"), F.col(value).alias("value"), F.col(shown or value).alias("shown"), first.alias("first"))

    parts = [
        part(correlation.host_users(t), USER, "user"), part(correlation.host_source_ips(t), SOURCE, "ip"),
        part(t["hosts"], LABEL, "display_name"), part(t["events"].filter("computer <> ''"), COMPUTER, "computer"),
    ]
    if matches is not None:
        parts.append(part(correlation.indicator_rows(matches), INDICATOR, "key", "shown", "timestamp"))
    return union(parts).groupBy("host_id", "kind", "value").agg(F.min("shown").alias("shown"), F.min("first").alias("first"))


def add_hosts(t, root: str, matches: DataFrame | None = None) -> None:
    """Stores the partial results of the hosts of a case, or replaces what is stored of them; `t` holds those hosts only."""
    commits.replace_parts(_values(t, matches), f"{root}/host_values", True)
    commits.replace_parts(lateral.per_user(t["events"], "host_id"), f"{root}/logon_counts", True)


def _of(spark: SparkSession, root: str, kind: str, name: str) -> DataFrame:
    rows = commits.read(spark, f"{root}/host_values", VALUES, True).filter(F.col("kind") == kind)
    return rows.select("host_id", F.col("value").alias(name), "shown", "first")


def correlate(spark: SparkSession, root: str) -> DataFrame:
    """Shared indicators, source pivots and credential reuse over all stored hosts."""
    t = CaseTables(spark, {"hosts": _of(spark, root, LABEL, "display_name").select("host_id", "display_name")})
    shared = _of(spark, root, INDICATOR, "key").withColumnRenamed("first", "timestamp")
    return union([
        correlation.shared_indicators(t, rows=shared),
        correlation.source_pivots(t, _of(spark, root, SOURCE, "ip").select("host_id", "ip")),
        correlation.credential_reuse(t, _of(spark, root, USER, "user").select("host_id", "user")),
    ])


def edges(spark: SparkSession, root: str) -> DataFrame:
    """The logon graph over all stored hosts."""
    return lateral.edges_of(lateral.merged(commits.read(spark, f"{root}/logon_counts", LOGONS, True)))


def edge_users(spark: SparkSession, root: str) -> DataFrame:
    return lateral.merged(commits.read(spark, f"{root}/logon_counts", LOGONS, True)).filter("user IS NOT NULL").drop("types")


def nodes(spark: SparkSession, root: str) -> DataFrame:
    """Degree and kind of each endpoint."""
    return lateral.nodes(_of(spark, root, COMPUTER, "computer"), edges(spark, root))
