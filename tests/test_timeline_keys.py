"""Distinct keys of the timeline: the same number as over the whole timeline, and no shuffle files stay."""

import time

from pyspark.sql import functions as F

from triagelake.plans import timeline as tl
from triagelake.session import removed_shuffles
from triagelake.tables import CaseTables, conform


def case(spark):
    login = "host_id string, type string, line string, user string, host string, timestamp timestamp, is_failed_login boolean, source_file string, pid long"
    logins = [(h, k, "pts/0", u, x, ts, False, "w", 1) for h in ("a", "b", None) for k in ("userProcess", None) for u in ("u", "u|0", None) for x in ("", "1|2") for ts in (None, "2024-01-02", "1960-01-02")] * 3
    syslog = "host_id string, timestamp timestamp, process string, category string, message string, source_file string"
    lines = [(h, ts, p, "cronExec", m, "s") for h in ("a", "b") for ts in (None, "2024-01-02") for p in ("cron", "a|b", None) for m in ("x", "b|x", None)] * 2
    made = lambda rows, ddl, name: conform(spark.createDataFrame(rows, ddl.replace("timestamp timestamp", "timestamp string")).withColumn("timestamp", F.col("timestamp").cast("timestamp")), name)
    return CaseTables(spark, {"logins": made(logins, login, "logins"), "syslog": made(lines, syslog, "syslog")})


def shuffle_files(spark):
    return {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}


def test_keys_are_counted_as_over_the_whole_timeline(spark):
    t = case(spark)
    for names in (["logins", "syslog"], ["syslog"], ["logins", "syslog", "logins"], []):
        whole = tl.build(t, names).select(tl.stable_key().alias("k")).distinct().count()
        got = tl.count_keys(t, names)
        assert got.collect() == [(whole,)] and got.dtypes == [("n", "bigint")]
        assert bool(names) == (whole > 1)


def test_counting_keys_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    assert tl.count_keys(case(spark), ["logins", "syslog"]).collect()[0]["n"] > 1
    for _ in range(50):
        # One shuffle is the caller's own: the sum of the counts, a row for each source.
        left = {f.split("shuffle_")[1].split("_")[0] for f in shuffle_files(spark) - before if f.endswith(".data")}
        if len(left) <= 1:
            break
        time.sleep(0.1)
    assert len(left) <= 1


def test_the_setting_is_given_back(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    try:
        with removed_shuffles(spark):
            assert spark.conf.get(key) == "true"
            raise ValueError
    except ValueError:
        assert spark.conf.get(key, None) == before
