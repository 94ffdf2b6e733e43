"""Ordered state by transitions of shards equals a sequential run, and reads its input once."""

import random

import pytest
from pyspark.sql import functions as F

from triagelake.checks import registry
from triagelake.checks.adapters import GivenCase
from triagelake.functions.ordered import runs, scan
from triagelake.operators import gaps
from triagelake.plans import timeline as tl
from triagelake.sources import linux_logs

DATA = "/root/testdata/sf0.001"
ROWS = 3000


def table(spark):
    """Two keys; 'a' lies over 200 shards, some of them empty, with stretches without a value over several shards."""
    draw = random.Random(4)
    rows = []
    for at in range(ROWS):
        quiet = 700 < at < 900
        rows.append(("a" if at % 10 else "b", at + (500 if at > 2000 else 0), draw.choice([None, None, 1, 2, 3]) if not quiet else None, draw.randint(-3, 5), {"k": str(at)}))
    return rows, spark.createDataFrame(rows, "key string, at long, v int, d int, m map<string,string>").repartition(5)


def test_scan_equals_a_sequential_run(spark):
    rows, df = table(spark)
    got = scan(df, ["key"], F.expr("at div 15"), ["at"], sums={"s": F.col("d")}, last={"l": F.col("v")}, before={"b": F.col("v")}, following={"f": F.col("v")})
    assert got.columns == ["key", "at", "v", "d", "m", "s", "l", "b", "f"]
    out = {(r["key"], r["at"]): r for r in got.collect()}
    assert len(out) == ROWS
    for key in ("a", "b"):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        total, last = 0, None
        following, nxt = {}, None
        for r in reversed(mine):
            following[r[1]] = nxt
            nxt = r[2] if r[2] is not None else nxt
        for r in mine:
            o = out[key, r[1]]
            total += r[3]
            assert o["b"] == last
            last = r[2] if r[2] is not None else last
            assert (o["s"], o["l"], o["f"], o["m"]) == (total, last, following[r[1]], r[4])


@pytest.mark.parametrize("shard", [7, 100000])
def test_runs_equal_a_sequential_run(spark, shard):
    draw = random.Random(9)
    values = [draw.choice([1, 2]) if i % 200 < 120 else 5 for i in range(2500)]  # runs over several shards too
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(values)], "f string, i long, v int").repartition(4)
    got = {r["i"]: r["n"] for r in runs(df, ["f"], F.expr(f"i div {shard}"), ["i"], "v", "n").collect()}
    n = 0
    for i, v in enumerate(values):
        n += i == 0 or v != values[i - 1]
        assert got[i] == n


def test_audit_events_over_many_shards(spark, monkeypatch):
    """One file over 100 shards, events that cross their edges and serials that come back, as in one pass over the lines."""
    monkeypatch.setattr("triagelake.sources.lines.SHARD_LINES", 5)
    serials, lines = [], []
    for i in range(400):
        serial = 100 + (i // 7) * 2 + (i % 2 if i % 31 == 0 else 0)
        serials.append(serial)
        lines.append(f'type={"SYSCALL" if i % 2 else "CWD"} msg=audit({1700000000 + i}.0:{serial}): exe="/bin/e{i}" cwd="/c{i}"')
    rows = [("h", "f", (i // 50) * 1000, i, line, None) for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "host_id string, source_file string, block long, line_no long, line string, anchor timestamp").repartition(3)
    got = sorted((r["serial"], int(r["timestamp"].timestamp())) for r in linux_logs.audit_log(df).select("serial", "timestamp").collect())
    want, open_ = [], None
    for i, serial in enumerate(serials):
        if serial != open_:
            want.append((serial, 1700000000 + i))
            open_ = serial
    assert got == sorted(want) and len(want) > 60
    joined = linux_logs.audit_log(df, by_serial=True)
    assert joined.count() == len(set(serials)) < len(want)


def executed_scans(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan parquet")


def test_sessions_read_each_table_once(spark):
    t = GivenCase(spark, DATA)
    names = ["files", "web_access", "registry"]
    once = executed_scans(tl.build(t, names))
    assert executed_scans(gaps.sessions(tl.build(t, names))) == once
    assert executed_scans(gaps.gaps(tl.build(t, names))) == once


def test_audit_lines_are_read_once(spark):
    df = registry.queries()["scan_audit_log"](spark, DATA)
    assert executed_scans(df) == 1
