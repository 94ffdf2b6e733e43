"""Options and sources that no registered query uses."""

import datetime as dt

from pyspark.sql import functions as F

from triagelake.operators import casebook, enrichment, entropy, reporting, windows
from triagelake.plans import timeline as tl
from triagelake.sinks import exports as out
from triagelake.sources import exports as src
from triagelake.sources import linux_config, macos_text
from triagelake.tables import CaseTables, conform

LINES = "host_id string, source_file string, block long, line_no long, line string, anchor timestamp"


def lines(spark, *texts, host="h", file="/etc/f"):
    return spark.createDataFrame([(host, file, 0, i, x, None) for i, x in enumerate(texts)], LINES)


def test_addresses_and_first_lines(spark):
    plan = lines(spark, "  addresses: [10.1.2.3/24, '192.168.001.9/16']", "gateway4: 10.1.2.1", "- 300.1.1.1/8", "x 127.0.0.1/8", file="/etc/netplan/a")
    faces = lines(spark, "iface eth0", "\taddress 172.16.0.4/12", "Address  10.1.2.3", "address nothing", file="/etc/network/interfaces")
    found = {r["host_id"]: r["ip_addresses"] for r in linux_config.host_addresses(linux_config.netplan_addresses(plan), linux_config.interface_addresses(faces)).collect()}
    assert found["h"][0] == "10.1.2.3" and found["h"].count("10.1.2.3") == 1 and "172.16.0.4" in found["h"] and not {"300.1.1.1", "10.1.2.1"} & set(found["h"])
    name = linux_config.first_line(lines(spark, "", "# comment", "  web-1  ", "other"), "hostname").collect()
    assert [(r["host_id"], r["hostname"].strip()) for r in name] == [("h", "web-1")]


def test_periodic_scripts(spark):
    rows = [("h", "/etc/periodic/daily/110.clean"), ("h", "/usr/local/etc/periodic/Weekly/x.sh"), ("h", "/private/etc/periodic/other/y")]
    got = {r["name"]: (r["kind"], r["schedule"], r["command"]) for r in macos_text.periodic_scripts(spark.createDataFrame(rows, "host_id string, path string")).collect()}
    assert got["110.clean"] == ("periodic", "daily", rows[0][1]) and got["x.sh"][1] == "weekly" and got["y"][1] is None


def test_cached_verdicts_win(spark):
    wanted = spark.createDataFrame([("ip", "1.2.3.4", 0), ("ip", "5.6.7.8", 1), ("domain", "a.test", 2)], "kind string, value string, pos int")
    feeds = spark.createDataFrame([(1, 0, "ti", "ip", "1.2.3.4", "malicious", "d"), (1, 0, "ti", "ip", "5.6.7.8", "unknown", "")], "tier int, provider_order int, source string, kind string, value string, verdict string, detail string")
    key = enrichment.key(F.lit("ip"), F.lit("1.2.3.4"))
    cache = spark.range(1).select(key.alias("key"), F.lit("suspicious").alias("verdict"), F.lit("old").alias("source"), F.lit(2).alias("tier"), F.lit("c").alias("detail"))
    got = {r["indicator"]: (r["verdict"], r["source"]) for r in enrichment.enrich(wanted, feeds, cache).collect()}
    assert got == {"1.2.3.4": ("suspicious", "old"), "5.6.7.8": ("unknown", "ti"), "a.test": ("unknown", "—")}


def test_unknown_paths_of_claims(spark):
    claims = spark.createDataFrame([(1, "dropped /tmp/evil.sh and C:\\Users\\x\\a.exe"), (2, "ran /usr/bin/ls")], "claim_id long, statement string")
    known = spark.createDataFrame([("/var/tmp/evil.sh",), ("/usr/bin/ls --color",)], "path string")
    got = {(r["claim_id"], r["token"].lower()) for r in reporting.flagged_paths(claims, known).collect()}
    assert any(i == 1 and "a.exe" in token for i, token in got) and not any("evil.sh" in token or "/usr/bin/ls" in token for _, token in got)


def test_report_excerpt_and_note(spark):
    rows = [("h", "t1", 3, "2024-01-02 00:00:00"), ("h", "t2", 1, "2024-01-01 00:00:00"), ("h", "t3", 4, None)]
    found = spark.createDataFrame(rows, "host_id string, title string, severity int, at string").withColumn("timestamp", F.to_timestamp("at"))
    assert [r["title"] for r in reporting.dated_excerpt(found).collect()] == ["t2", "t1"]
    assert [r["title"] for r in reporting.dated_excerpt(found, [3, 4]).collect()] == ["t1"]
    assert reporting.severity_filter_note([3, 4, 3]) == "Critical, High" and reporting.severity_filter_note(None) is None and reporting.severity_filter_note([0, 1, 2, 3, 4]) is None


def test_custody_and_annotation_rows(spark):
    hosts = spark.createDataFrame([("h", "Host H")], "host_id string, display_name string")
    log = spark.createDataFrame([(dt.datetime(2024, 1, 2), "zz", "bob", "d", "h"), (dt.datetime(2024, 1, 1), "yy", "amy", "e", None)], "timestamp timestamp, action string, actor string, detail string, host_id string")
    got = [(r["timestamp_iso"], r["actor"], r["evidence"]) for r in out.custody_rows(log, hosts).collect()]
    assert got == [("2024-01-01T00:00:00Z", "amy", ""), ("2024-01-02T00:00:00Z", "bob", "Host H")]
    notes = conform(spark.createDataFrame([("finding", "k2", "h", None, "n2"), ("finding", "k1", None, "benign", "n1")], "target_kind string, target_key string, host_id string, tag string, note string"), "annotations")
    notes = notes.withColumn("timestamp", F.when(F.col("target_key") == "k2", F.to_timestamp(F.lit("2024-01-01 00:00:00"))))
    rows = out.annotation_rows(notes, hosts).collect()
    assert [r["note"] for r in rows] == ["n2", "n1"] and rows[0]["tag"] == "" and rows[1]["tag"] != "" and rows[0]["evidence"] == "Host H"


def test_distinct_discovery_commands(spark):
    """A repeated command suppresses a computer in the strict reading and not in the other."""
    line = lambda c: f'<Data Name="NewProcessName">C:\\x.exe</Data><Data Name="CommandLine">{c}</Data>'
    data = [("h", 4688, i, dt.datetime(2024, 1, 1, 0, i), "Security", "PC", line(c), "f") for i, c in enumerate(["whoami /all", "whoami /all", "systeminfo", "arp -a"])]
    events = spark.createDataFrame(data, "host_id string, event_id int, record_number long, written_at timestamp, channel string, computer string, payload_xml string, source_file string")
    t = CaseTables(spark, {"events": conform(events, "events")})
    assert windows.discovery_burst(t).count() == 0
    (found,) = windows.discovery_burst(t, strict_first=False).collect()
    assert "3 discovery commands" in found["title"] and found["detail"].count(",") == 2


def test_bookmarked_rows(spark):
    rows = [("h", "u", "bash", f"cmd {i}", dt.datetime(2024, 1, 1, 0, i), i, "f") for i in range(6)]
    t = CaseTables(spark, {"shell_history": conform(spark.createDataFrame(rows, "host_id string, user string, shell string, command string, timestamp timestamp, line_number int, source_file string"), "shell_history")})
    timeline = tl.build(t, ["shell_history"])
    marks = timeline.filter(F.col("path").contains("3") | F.col("path").contains("5")).select(F.lit("timelineEvent").alias("target_kind"), tl.stable_key().alias("target_key"))
    other = timeline.filter(F.col("path").contains("1")).select(F.lit("finding").alias("target_kind"), tl.stable_key().alias("target_key"))
    got = tl.filter_rows(timeline, bookmarks=marks.union(other)).collect()
    assert sorted(r["path"][-1] for r in got) == ["3", "5"]
    assert tl.build(t, sources=["EVTX"]).count() == 0 and tl.filtered(t, sources=["SHELL"], query="CMD 4").count() == 1


def test_scan_limits(spark):
    rows = [(f"h{i % 2}", i, f"f{i}.bin", "/x/", 100 * i, False, False) for i in range(10)]
    t = CaseTables(spark, {"files": conform(spark.createDataFrame(rows, "host_id string, id long, name string, parent_path string, size long, is_directory boolean, is_deleted boolean"), "files")})
    got = entropy.scan_candidates(t, max_bytes=800, limit=2).collect()
    assert sorted((r["host_id"], r["id"]) for r in got) == [("h0", 2), ("h0", 4), ("h1", 1), ("h1", 3)]


def test_powerlog_union(spark):
    own = "host_id string, source_file string, timestamp double"
    process = spark.createDataFrame([("h", "p", 1.7e9, "com.a", "proc", "7")], own + ", BundleID string, ProcessName string, PID string")
    cycle = spark.createDataFrame([("h", "p", 1.7e9 + 5, "com.b", "8", "launch")], own + ", BundleID string, PID string, EVENT string")
    front = spark.createDataFrame([("h", "p", None, "com.a")], own + ", BundleID string")
    net = spark.createDataFrame([("h", "p", 1.7e9 + 9, "com.b", "net", 1.7e9 + 19, 3, 4, None, 6)], own + ", BundleName string, ProcessName string, timestampEnd double, WiFiIn long, CellIn long, WiFiOut long, CellOut long")
    offsets = spark.createDataFrame([("h", 1.6e9, 100.0)], "host_id string, timestamp double, system double")
    apps = spark.createDataFrame([("h", "com.b", "Bee", None, None, None)], "host_id string, BundleID string, Name string, Executable string, CFDisplayName string, LSDisplayName string")
    got = {r["kind"]: r for r in src.powerlog(process, cycle, front, net, offsets, apps).withColumn("s", F.unix_seconds("date")).withColumn("e", F.unix_seconds("end_date")).collect()}
    assert set(got) == {"process", "appLifecycle", "network"}  # a row without a time is none
    assert got["process"]["s"] == 1_700_000_100 and got["process"]["pid"] == 7 and got["appLifecycle"]["process_name"] == "Bee"
    assert (got["network"]["bytes_in"], got["network"]["bytes_out"], got["network"]["e"]) == (7, 6, 1_700_000_119)
