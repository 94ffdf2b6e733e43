"""Exports read back, folder listings, JSON import."""

import csv
import glob
import json
import os

from pyspark.sql import functions as F

from triagelake.sinks import exports as out
from triagelake.sources import exports as src
from triagelake.tables import CaseTables, import_json, light_events, write_table

ROWS = [("plain", "a,b", 1), ("=cmd", 'say "x"', 2), ("@x\r\ny", None, 3), ("  pad ", "", -4), ("ünï — 汉", "-1", None)]


def test_csv_reads_back(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "a string, b string, n int").coalesce(1)
    out.write_csv(df, f"{tmp_path}/csv")
    (path,) = glob.glob(f"{tmp_path}/csv/part-*")
    raw = open(path, newline="", encoding="utf-8").read()
    assert raw.startswith("a,b,n\r\n") and raw.endswith("\r\n")
    got = list(csv.reader(open(path, newline="", encoding="utf-8")))[1:]
    guard = lambda x: "" if x is None else ("'" + str(x) if str(x)[:1] in "=+-@\t\r" and str(x) else str(x))
    assert got == [[guard(v) for v in r] for r in ROWS]


def test_json_reads_back(spark, tmp_path):
    out.write_json(spark.createDataFrame(ROWS, "a string, b string, n int"), f"{tmp_path}/json")
    lines = [json.loads(x) for p in glob.glob(f"{tmp_path}/json/*.json") for x in open(p, encoding="utf-8")]
    assert sorted(map(str, lines)) == sorted(str({"a": a, "b": b, "n": n}) for a, b, n in ROWS)


def test_timeline_files_are_in_order(spark, tmp_path):
    df = spark.range(5000).select(F.timestamp_seconds(F.pmod(F.col("id") * 7919, F.lit(5000))).alias("date"), F.lit("h").alias("host_id"), F.col("id").cast("string").alias("path")).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out.write_timeline(df, f"{tmp_path}/t")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spans = []
    for p in sorted(glob.glob(f"{tmp_path}/t/*.parquet")):
        dates = [r["date"] for r in spark.read.parquet(p).collect()]
        assert dates == sorted(dates)
        spans.append((dates[0], dates[-1]))
    assert len(spans) > 1 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_folder_listing(spark, tmp_path):
    os.makedirs(f"{tmp_path}/root/a b/c")
    for name, n in (("x.txt", 3), ("a b/y", 0), ("a b/c/.DS_Store", 5), ("a b/c/z.tar.gz", 7)):
        open(f"{tmp_path}/root/{name}", "wb").write(b"1" * n)
    got = sorted((r["parent_path"], r["name"], r["size"], r["is_directory"]) for r in src.folder_listing(spark, f"{tmp_path}/root", "h").collect())
    assert [(p.replace("%20", " "), *rest) for p, *rest in got] == [("/", "x.txt", 3, False), ("/a b/", "y", 0, False), ("/a b/c/", "z.tar.gz", 7, False)]


def test_json_import_and_light_events(spark, tmp_path):
    rows = [{"user": "bob", "command": "ls", "when": "2024-01-02T03:04:05.250Z", "lineNumber": 7, "other": 1}, {"user": "amy", "when": "2024-01-02T03:04:05Z"}, {}]
    open(f"{tmp_path}/h.json", "w").write(json.dumps(rows, indent=1))
    df = import_json(spark, f"{tmp_path}/h.json", "shell_history", "h1", {"when": "timestamp", "lineNumber": "line_number"})
    write_table(df, str(tmp_path), "shell_history")
    got = {r["user"]: r for r in CaseTables.open(spark, str(tmp_path))["shell_history"].withColumn("us", F.unix_micros("timestamp")).collect()}
    assert len(got) == 3 and got["bob"]["us"] == 1704164645250000 and got["bob"]["line_number"] == 7 and got["amy"]["us"] == 1704164645000000 and got[None]["command"] is None
    events = CaseTables(spark)["events"]
    assert set(events.columns) - set(light_events(events).columns) == {"payload_xml"}
