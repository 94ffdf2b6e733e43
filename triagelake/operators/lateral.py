"""Logon graph: who logged on from where to where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.payload import with_fields
from triagelake.operators.windows import trimmed

REMOTE_TYPES = ["3", "7", "8", "10"]


def remote_logons(events: DataFrame) -> DataFrame:
    rows = with_fields(events.filter("event_id IN (4624, 4625)"), _station="WorkstationName", _ip="IpAddress", user="TargetUserName", type="LogonType")
    station, ip = trimmed(F.col("_station")), trimmed(F.col("_ip"))
    source = F.when(~station.isin("", "-"), station).when(~ip.isin("", "-", "::1", "0.0.0.0", "127.0.0.1"), ip)
    rows = rows.select(
        "host_id",
        "written_at",
        source.alias("source"),
        F.col("computer").alias("target"),
        (F.col("event_id") == 4625).alias("failed"),
        "user",
        "type",
    )
    return rows.filter(F.col("type").isin(REMOTE_TYPES) & (F.col("target") != "") & F.col("source").isNotNull() & (F.col("source") != F.col("target")))


def per_user(events: DataFrame, *keys: str) -> DataFrame:
    """Counts per (source, target, user), and `keys`: the first, wide level of the edge aggregate."""
    return remote_logons(events).groupBy(*keys, "source", "target", "user").agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if("failed").alias("failures"),
        F.sort_array(F.collect_set(F.col("type").cast("int"))).alias("types"),
        F.min("written_at").alias("first_seen"),
        F.max("written_at").alias("last_seen"),
    )


def merged(partials: DataFrame) -> DataFrame:
    """Counts per (source, target, user) from those of several hosts."""
    return partials.groupBy("source", "target", "user").agg(
        F.sum("count").alias("count"), F.sum("failures").alias("failures"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("types")))).alias("types"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )


def edges(events: DataFrame) -> DataFrame:
    """One row per (source, target). Accounts are counted here and listed by `edge_users`."""
    return edges_of(per_user(events))


def edges_of(counts: DataFrame) -> DataFrame:
    return counts.groupBy("source", "target").agg(
        F.sum("count").alias("count"),
        F.sum("failures").alias("failure_count"),
        F.count("user").alias("user_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("logon_types"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def edge_users(events: DataFrame) -> DataFrame:
    """The accounts of each edge, one row each, with their own counts and times."""
    return per_user(events).filter("user IS NOT NULL").drop("types")


def nodes(events: DataFrame, graph_edges: DataFrame | None = None) -> DataFrame:
    """Degree per endpoint; a node is known when it is the computer of any event at all (only `computer` is read)."""
    pairs = graph_edges if graph_edges is not None else edges(events)
    ends = pairs.select(F.explode(F.array("source", "target")).alias("id"))
    degree = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    known = events.filter("computer <> ''").select(F.col("computer").alias("id")).distinct().withColumn("known", F.lit(True))
    kind = F.when(F.col("known"), "knownHost").otherwise("externalSource")
    return degree.join(known, "id", "left").select("id", kind.alias("kind"), "degree")


def node_edges(graph_edges: DataFrame, node: str | Column) -> tuple[DataFrame, DataFrame]:
    """Inbound and outbound edges of one node, busiest first."""
    order = [F.col("count").desc(), "source", "target"]
    return graph_edges.filter(F.col("target") == node).orderBy(*order), graph_edges.filter(F.col("source") == node).orderBy(*order)
