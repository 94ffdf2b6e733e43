"""Boundaries of the operators on small hand-made rows, and bursts against a plain loop."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from triagelake.functions import net, text
from triagelake.functions.payload import decode_entities
from triagelake.operators import bursts, enrichment, entropy, gaps, ioc, linux, windows
from triagelake.sources import exports
from triagelake.tables import CaseTables, conform, read_table, write_table

T0 = datetime(2023, 11, 14, 22, 13, 20)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


def table(spark, name, rows, ddl):
    return conform(spark.createDataFrame(rows, ddl), name)


def burst_rows(spark, seed, keys=12, n=400):
    rnd = random.Random(seed)
    rows = [(f"k{rnd.randrange(keys)}", at(rnd.randrange(0, 3000, 25)), i, rnd.choice(["a", "b", "c", "d", "e", None])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, ts timestamp, rn long, v string")


def loop(rows, width, passes):
    """First window per key, by two pointers over (time, row number)."""
    found = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        start = 0
        for end in range(len(mine)):
            while (mine[end][1] - mine[start][1]).total_seconds() > width:
                start += 1
            if passes(mine[start : end + 1]):
                found[key] = mine[start : end + 1]
                break
    return found


def test_count_burst_equals_loop(spark):
    for seed in (1, 2):
        rows, df = burst_rows(spark, seed)
        want = {k: w[-4:][0][2] for k, w in loop(rows, 60, lambda w: len(w) >= 4).items()}
        got = bursts.first_count_burst(df, ["k"], "ts", ["rn"], 4, 60).filter("burst_pos = 1").collect()
        assert {r["k"]: r["rn"] for r in got} == want


def test_distinct_burst_equals_loop(spark):
    rows, df = burst_rows(spark, 3)
    rows = [r for r in rows if r[3] is not None]
    want = {k: w[0][1] for k, w in loop(rows, 100, lambda w: len({r[3] for r in w}) >= 4).items()}
    got = bursts.first_distinct_burst(df.filter("v IS NOT NULL"), ["k"], "ts", ["rn"], "v", 4, 100)
    assert {r["k"]: r["f"] for r in got.select("k", F.timestamp_micros("first_us").alias("f")).collect()} == want


def test_spread_burst_equals_loop(spark):
    for seed in (4, 5):
        rows, df = burst_rows(spark, seed)

        def passes(w):
            values = {r[3] for r in w if r[3] is not None}
            return len(values) >= 3 and len(w) <= 1.5 * len(values)

        want = {k: (len({r[3] for r in w if r[3] is not None}), len(w), w[0][1]) for k, w in loop(rows, 90, passes).items()}
        got = bursts.first_spread_burst(df, ["k"], "ts", ["rn"], "v", 3, 1.5, 90, shard_s=40)
        assert {r["k"]: (r["n_values"], r["n_rows"], r["f"]) for r in got.withColumn("f", F.timestamp_micros("first_us")).collect()} == want


def test_largest_window_equals_loop(spark):
    for seed, width, shift in ((6, 90, 0), (7, 0, 0), (8, 40, -1_700_000_000 - 1500)):
        rows = [(k, t + timedelta(seconds=shift), i) for k, t, i, _ in burst_rows(spark, seed)[0]] + [(None, at(5), 7)] * 3 + [("late", None, 1)] * 4
        want = {}
        for key in {r[0] for r in rows}:
            mine = sorted((r for r in rows if r[0] == key and r[1] is not None), key=lambda r: r[1])
            windows_ = [[x for x in mine if 0 <= (r[1] - x[1]).total_seconds() <= width] for r in mine]
            if best := max((w for w in windows_ if len(w) >= 3), key=len, default=None):
                want[key] = (len(best), best[0][1], best[-1][1], min(r[2] for r in best if r[1] == best[0][1]))
        got = bursts.largest_window(spark.createDataFrame(rows, "k string, ts timestamp, rn long"), ["k"], "ts", 3, width, F.min("rn"))
        got = got.withColumn("f", F.timestamp_micros("first_us")).withColumn("l", F.timestamp_micros("last_us"))
        assert {r["k"]: (r["n_rows"], r["f"], r["l"], r["extra"]) for r in got.collect()} == want and len(want) > 3


def test_largest_window_does_not_walk_its_frames(spark):
    # Spark adds up a range frame anew for each row, which is quadratic in the rows of a window.
    plan = bursts.largest_window(burst_rows(spark, 9)[1], ["k"], "ts", 3, 90)._jdf.queryExecution().executedPlan().toString()
    assert "RangeFrame" not in plan and "RowFrame" in plan


def test_recycle_burst_reads_its_table_once(spark):
    ddl = "host_id string, original_path string, deleted_at timestamp, size_bytes long, recycled_name string, sid string, source_file string"
    rows = [(h, "a", at(i), 1, "$R", "s", f) for h, f in (("h", "$I2"), ("h", "$I1"), ("e", ""), (None, "$I1")) for i in range(20)]
    df = windows.recycle_bin_burst({"recycle_bin": table(spark, "recycle_bin", rows, ddl)}, threshold=20)
    assert {r["host_id"]: (r["title"].split(": ")[1], r["evidence"]) for r in df.collect()} == {
        "h": ("40 deletes", ["$I1"]), "e": ("20 deletes", ["$Recycle.Bin"]), None: ("20 deletes", ["$Recycle.Bin"]),
    }
    assert df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_sessions_and_gaps(spark):
    df = spark.createDataFrame([("h", at(60 * m)) for m in (0, 5, 10, 250, 255)], "host_id string, date timestamp")
    assert sorted(r["count"] for r in gaps.sessions(df).collect()) == [2, 3]
    assert [r["duration_s"] for r in gaps.gaps(df).collect()] == [240 * 60.0]
    edge = spark.createDataFrame([("h", at(0)), ("h", at(3600))], "host_id string, date timestamp")
    assert gaps.gaps(edge).count() == 0 and gaps.sessions(edge, 0).count() == 1


def test_indicator_boundaries(spark):
    good = ["10.0.0.1:445", "see 10.0.0.1.", "::ffff:10.0.0.1"]
    bad = ["10.0.0.15", "10.0.0.123", "110.0.0.1", "1.10.0.0.1", "10.0.0.1.7"]
    files = [("h", i, v, "/p", 1, False, False) for i, v in enumerate(good + bad)]
    t = CaseTables(spark, {
        "files": table(spark, "files", files, "host_id string, id long, name string, parent_path string, size long, is_directory boolean, is_deleted boolean"),
        "iocs": table(spark, "iocs", [("ip", "10.0.0.1", "", 0)], "kind string, value string, note string, pos long"),
    })
    assert sorted(r["location"]["path"] for r in ioc.match(t).collect()) == sorted("/p/" + g for g in good)


def test_substring_pairs(spark):
    from triagelake.functions import substring
    from triagelake.functions.substring import substring_pairs

    rows = spark.createDataFrame([(i, f"abc needle{i}x end") for i in range(50)], "i long, t string")
    needles = spark.createDataFrame([(f"needle{i}x",) for i in range(0, 60, 2)], "needle string")
    want = {(i, f"needle{i}x") for i in range(0, 50, 2)}
    assert {(r["i"], r["needle"]) for r in substring_pairs(rows, "t", needles).collect()} == want
    # A table in which every bit is set only lets more pieces through.
    picked, wanted = substring.prepare(needles)
    assert {(r["i"], r["needle"]) for r in substring_pairs(rows, "t", needles, (picked, wanted | True)).collect()} == want
    odd = spark.createDataFrame([(1, "é"), (2, ""), (3, None), (4, "xé汉字y")], "i long, t string")
    short = spark.createDataFrame([("é",), ("汉字",), ("",), ("y",)], "needle string")
    assert {(r["i"], r["needle"]) for r in substring_pairs(odd, "t", short).collect()} == {(1, "é"), (4, "é"), (4, "汉字"), (4, "y")}


def test_classify_and_text_helpers(spark):
    kinds = {"http://a/b": "url", "a" * 32: "hash", "1.2.3.4": "ip", "fe80::1": "ip", "evil.com": "domain", "1.2.3.999": "domain"}
    assert {k: one(spark, ioc.classify, k) for k in kinds} == kinds
    assert one(spark, decode_entities, "a&amp;lt;&#65;&#x42;&bad;&lt;") == "a&lt;AB&bad;<"
    assert one(spark, text.rot13, "Uryyb") == "Hello"
    assert one(spark, lambda c: F.lower(net.url_host(c)), "http://u@Host.com:80/x") == "host.com"
    assert one(spark, net.authority_host, "https://u@t.me/p") == "t.me"


def test_failed_logon_threshold(spark):
    def case(n):
        rows = [("h", i, at(i * 10), 4625, '<Data Name="TargetUserName">Bob</Data><Data Name="IpAddress">9.9.9.9</Data>', "f") for i in range(n)]
        return CaseTables(spark, {"events": table(spark, "events", rows, "host_id string, record_number long, written_at timestamp, event_id long, payload_xml string, source_file string")})

    assert windows.failed_logon_burst(case(4)).count() == 0
    row = windows.failed_logon_burst(case(9)).first()
    assert row["title"] == "Failed-logon burst against bob (5 in 10m)" and row["severity"] == 2


def test_usn_rules(spark):
    ddl = "host_id string, usn long, file_name string, mft_entry long, reason_raw long, source_file string, is_directory boolean"
    rows = [
        ("h", 1, "payload.exe", 42, 0x100, "f", False), ("h", 2, "payload.exe", 42, 0x200 | 0x80000000, "f", False), ("h", 3, "a.txt", 43, 0x300, "f", False),
        ("h", 4, "notes.txt", 44, 0x1000, "f", False), ("h", 1 << 40, "notes.exe", 44, 0x2000, "f", False), ("h", 9, "late.exe", 45, 0x200, "f", False), ("h", 10, "late.exe", 45, 0x100, "f", False),
    ]
    t = CaseTables(spark, {"usn": table(spark, "usn", rows, ddl)})
    assert [r["title"] for r in windows.usn_create_delete(t).collect()] == ["Created-then-deleted executable (USN): payload.exe"]
    assert [r["title"] for r in windows.usn_renamed_to_exec(t).collect()] == ["Renamed to executable (USN): notes.txt → notes.exe"]
    assert windows.usn_mass_delete(t, threshold=4).count() == 0 and windows.usn_mass_delete(t, threshold=3).count() == 1


def test_web_rules(spark):
    rows = [("h", "9.9.9.9", "/x", None, 404)] * 100 + [("h", "8.8.8.8", "/shell.php", "cmd=1", 200), ("h", "7.7.7.7", "/ok", None, 200)]
    t = CaseTables(spark, {"web_access": table(spark, "web_access", rows, "host_id string, client_ip string, path string, query string, status int")})
    assert [r["title"] for r in linux.directory_brute_force(t).collect()] == ["Directory brute-force from 9.9.9.9"]
    assert [r["severity"] for r in linux.webshells(t).collect()] == [4]
    assert linux.web_attacks(t).count() == 0


def test_enrichment_order(spark):
    feeds = spark.createDataFrame(
        [(1, 0, "a", "hash", "X", "error", ""), (2, 1, "b", "hash", "x", "unknown", ""), (0, 2, "c", "hash", "y", "knownGood", ""), (1, 3, "d", "hash", "y", "malicious", "")],
        "tier int, provider_order int, source string, kind string, value string, verdict string, detail string",
    )
    wanted = spark.createDataFrame([("hash", "x"), ("hash", " Y "), ("hash", "z")], "kind string, value string")
    got = {r["key"]: (r["verdict"], r["source"]) for r in enrichment.enrich(wanted, feeds).collect()}
    assert got == {"hash:x": ("unknown", "b"), "hash:y": ("knownGood", "c"), "hash:z": ("unknown", "—")}


def test_entropy(spark):
    rows = [(1, bytearray()), (2, bytearray(range(256)) * 4), (3, bytearray(b"a" * 600))]
    got = {r["i"]: r["h"] for r in spark.createDataFrame(rows, "i int, content binary").select("i", entropy.shannon("content").alias("h")).collect()}
    assert got == {1: 0.0, 2: 8.0, 3: 0.0}


def test_srum_ids(spark):
    sid = "010500000000000515000000" + "01000000" + "02000000" + "03000000" + "f4010000"
    rows = [("h", "3", "7", sid), ("h", "0", "8", "c.exe".encode("utf-16-le").hex() + "0000")]
    got = {r["id"]: r["text"] for r in exports.srum_ids(spark.createDataFrame(rows, "host_id string, idtype string, idindex string, idblob string")).collect()}
    assert got == {7: "S-1-5-21-1-2-3-500", 8: "c.exe"}


def test_table_round_trip_replaces_only_its_hosts(spark, tmp_path):
    root = str(tmp_path)
    ddl = "host_id string, user string, command string, line_number long"
    write_table(spark.createDataFrame([("a", "u", "x", 1), ("b", "u", "y", 2)], ddl), root, "shell_history")
    write_table(spark.createDataFrame([("b", "u", "z", 3)], ddl), root, "shell_history")
    assert sorted((r["host_id"], r["command"]) for r in read_table(spark, root, "shell_history").collect()) == [("a", "x"), ("b", "z")]


def test_hostile_numbers_do_not_stop_a_job(spark):
    from triagelake.functions import net
    from triagelake.sources.linux_logs import audit_log

    rows = [("99999999999999999999.1.1.1", False), ("1.2.3.4", True), ("", False), ("1.2.3.", False)]
    got = spark.createDataFrame(rows, "t string, want boolean").select(net.is_ipv4(F.col("t")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)
    assert one(spark, decode_entities, "&#99999999999999999999;&#xFFFFFFFFFFFFFFFFFFFFFF;%&amp;") is not None
    line = 'type=EXECVE msg=audit(1700000000.123:7): argc=3 a0="ls" a99999999999="x" a1="-l" a7[99999999999]="y"'
    frame = spark.createDataFrame([("h", "f", 0, 1, line)], "host_id string, source_file string, block long, line_no long, line string").withColumn("anchor", F.current_timestamp())
    assert audit_log(frame).count() == 1


def test_nothing_is_cut_off(spark):
    from triagelake.sources import linux_config, macos_text
    from triagelake.sources.linux_logs import audit_log

    lines = [("h", "/etc/rc.local", 0, i, f"/bin/cmd{i} --go") for i in range(250)]
    frame = spark.createDataFrame(lines, "host_id string, source_file string, block long, line_no long, line string").withColumn("anchor", F.current_timestamp())
    assert linux_config.script(frame, "rcLocal").count() == 250
    assert macos_text.rc_scripts(frame).count() == 250
    args = " ".join(f'a{i}="x{i}"' for i in range(5000))
    line = f"type=EXECVE msg=audit(1700000000.123:7): argc=5000 {args}"
    frame = spark.createDataFrame([("h", "f", 0, 1, line)], "host_id string, source_file string, block long, line_no long, line string").withColumn("anchor", F.current_timestamp())
    assert "x4999" in str(audit_log(frame).first())


def test_lsass_reads(spark):
    from triagelake.operators.credentials import credential_dumping

    data = lambda target, mask: f'<Data Name="SourceImage">C:\\t\\x.exe</Data><Data Name="TargetImage">{target}</Data><Data Name="GrantedAccess">{mask}</Data>'
    lsass = "C:\\Windows\\system32\\lsass.exe"
    rows = [("h", 10, "Sysmon", data(lsass, "0x1410")), ("h", 10, "Sysmon", data(lsass, "0x1000")), ("h", 10, "Sysmon", data("C:\\a.exe", "0x1410")), ("h", 10, "System", data(lsass, "0x1410"))]
    events = spark.createDataFrame(rows, "host_id string, event_id int, channel string, payload_xml string")
    found = credential_dumping(CaseTables(spark, {"events": conform(events, "events")})).collect()
    assert [(r["title"], r["technique"]["attack_id"]) for r in found] == [("Credential dumping: LSASS opened by x.exe", "T1003.001")]
