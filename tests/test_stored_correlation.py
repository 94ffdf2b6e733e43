"""Correlation from stored partial results equals a rebuild, and a new host reads its own rows only."""

from pyspark.sql import functions as F

from triagelake.checks.adapters import GivenCase
from triagelake.operators import correlation, lateral
from triagelake.plans import stored_correlation as sc
from triagelake.tables import CaseTables

DATA = "/root/testdata/sf0.001"
TABLES = ["events", "auth_log", "logins", "linux_users", "hosts"]


def rows(df):
    return sorted(str(r) for r in df.select(*sorted(df.columns)).collect())


def test_hosts_one_after_another_equal_a_rebuild(spark, tmp_path):
    root, case = str(tmp_path), GivenCase(spark, DATA)
    whole = CaseTables(spark, {n: case[n] for n in TABLES})
    matches = case["events"].select("host_id", F.col("provider").alias("ioc_value"), F.lit("domain").alias("ioc_kind"), F.col("written_at").alias("timestamp"))
    of = lambda hosts: CaseTables(spark, {n: case[n].filter(F.col("host_id").isin(hosts)) for n in TABLES})
    for hosts in (["host-0", "host-3"], ["host-1"], ["host-2", "host-4", "host-5"], ["host-3"]):
        sc.add_hosts(of(hosts), root, matches.filter(F.col("host_id").isin(hosts)))
    assert rows(sc.correlate(spark, root)) == rows(correlation.correlate(whole, matches))
    assert rows(sc.edges(spark, root)) == rows(lateral.edges(whole["events"]))
    assert rows(sc.edge_users(spark, root)) == rows(lateral.edge_users(whole["events"]))
    assert rows(sc.nodes(spark, root)) == rows(lateral.nodes(whole["events"]))
    read = sc.edges(spark, root)._jdf.queryExecution().optimizedPlan().toString()
    assert "props" not in read and "event_type" not in read  # nothing of the given events


def test_a_replaced_host_takes_its_values_along(spark, tmp_path):
    root, case = str(tmp_path), GivenCase(spark, DATA)
    of = lambda hosts, when: CaseTables(spark, {n: case[n].filter(F.col("host_id").isin(hosts)).filter(when) for n in TABLES})
    sc.add_hosts(of(["host-0", "host-1"], F.lit(True)), root)
    before = sc.edges(spark, root).agg(F.sum("count")).first()[0]
    some = CaseTables(spark, {**{n: case[n].filter("host_id = 'host-1'") for n in TABLES}, "events": case["events"].filter("host_id = 'host-1' AND record_number % 2 = 0")})
    sc.add_hosts(some, root)
    assert 0 < sc.edges(spark, root).agg(F.sum("count")).first()[0] < before
