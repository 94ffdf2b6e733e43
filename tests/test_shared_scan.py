"""Row rules on one scan give what they give alone."""

import pytest
from pyspark.sql import functions as F

from triagelake.checks.adapters import GivenCase
from triagelake.functions.payload import with_payload
from triagelake.operators import shared_scan
from triagelake.plans.detections import DETECTIONS, run_all

DATA = "/root/testdata/sf0.001"
RULES = [
    "external_rdp_logon", "suspicious_powershell", "service_install", "scheduled_task", "log_cleared", "asrep_roastable", "winrm_activity",
    "run_keys", "recent_use", "prefetch_execution", "wmi_persistence", "access_privilege", "kerberoasting", "lateral_tokens",
]


@pytest.fixture(scope="module")
def case(spark):
    t = GivenCase(spark, DATA)
    return t.with_tables(events=with_payload(t["events"]))


def rows(df):
    return sorted(str(r) for r in df.collect())


def test_same_findings_from_one_scan(case):
    parts, others = shared_scan.row_findings(case, {n: DETECTIONS[n][0] for n in RULES})
    assert others == ["kerberoasting", "lateral_tokens"]
    # events, registry, prefetch, wmi and the six tables of access_privilege, each read once
    assert len(parts) == 10
    for p in parts:
        assert p._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    together = shared_scan.union_all(parts)
    alone = shared_scan.union_all([DETECTIONS[n][0](case) for n in RULES if n not in others])
    got = rows(together)
    assert got == rows(alone) and len(got) > 500


def test_first_filters_reach_the_files(case):
    (part,), _ = shared_scan.row_findings(case, {n: DETECTIONS[n][0] for n in ("run_keys", "recent_use")})
    plan = part._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter") >= 1


def test_filters_flags_and_order(spark):
    """A later filter holds only for later columns, a rule's own columns hide nothing from the next rule, nulls are false."""
    from triagelake.operators.findings import findings

    table = spark.createDataFrame([("h", 1, "a"), ("h", 2, None), ("h", 3, "c")], "host_id string, n int, s string")

    def one(t):
        r = t["x"].filter("n > 1").withColumn("s", F.coalesce("s", F.lit("none"))).filter(F.col("s") != "c")
        return findings(r, "one", title=F.col("s"), severity=1, phase="delivery", attack=None)

    def two(t):
        r = t["x"].filter(F.col("s") != "a").select("host_id", F.upper("s").alias("n"))
        return findings(r, "two", title=F.col("n"), severity=F.when(F.col("n") == "C", 2), phase="delivery", attack=None)

    def grouped(t):
        r = t["x"].groupBy("host_id").agg(F.count(F.lit(1)).alias("n"))
        return findings(r, "grouped", title="many", severity=0, phase="delivery", attack=None)

    class Case(dict):
        def supplied(self, name):
            return name in self

    parts, others = shared_scan.row_findings(Case(x=table), {"one": one, "two": two, "grouped": grouped})
    assert others == ["grouped"] and len(parts) == 1
    assert sorted((r["rule"], r["title"], r["severity"]) for r in parts[0].collect()) == [("one", "none", 1), ("two", "C", 2)]


def test_run_all_names_and_parameters(case):
    df = run_all(case, ["log_cleared", "root_ssh", "failed_logon_burst"], {"failed_logon_burst": dict(threshold=2, window_s=86400.0)})
    assert {r["rule"] for r in df.select("rule").distinct().collect()} == {"log_cleared", "root_ssh", "failed_logon_burst"}
    assert df.select("finding_id").distinct().count() <= df.count()
