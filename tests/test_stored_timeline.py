"""The stored timeline: pages equal a sort of everything, ranges open few files, hosts come and go alone."""

import random

import pytest
from pyspark.sql import functions as F

from triagelake.plans import stored_timeline as st

ROWS = 4000
DDL = "host_id string, s long, kind string, source string, file_id long, path string, size long, is_deleted boolean, event_id long"


def rows(seed, hosts, n=ROWS):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        s = 1_700_000_000 + (draw.randrange(600 * 86400) if draw.random() < 0.6 else 86400 * 7 + draw.randrange(1800))  # one full hour
        out.append((draw.choice(hosts), s, draw.choice("MACB"), draw.choice(["FS", "EVTX"]), i, f"/p{draw.randrange(40)}", i, False, draw.choice([None, 1, 2])))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, DDL).withColumn("date", F.timestamp_seconds("s")).drop("s").select(*[c for c in st.SCHEMA.names if c != "month"])


def order(data):
    return sorted(data, key=lambda r: (r[1], r[0], r[3], r[2], r[5], r[8] is not None, r[8] or 0))


def flat(df):
    return [(r["host_id"], int(r["date"].timestamp()), r["kind"], r["source"], r["path"], r["event_id"]) for r in df.collect()]


def short(r):
    return (r[0], r[1], r[2], r[3], r[5], r[8])


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = f"{tmp_path_factory.mktemp('timeline')}/timeline"
    data = rows(1, ["h1", "h2", "h/3"])
    st.add_hosts(frame(spark, [r for r in data if r[0] != "h2"]), root)
    st.add_hosts(frame(spark, [r for r in data if r[0] == "h2"]), root)
    return root, data


@pytest.mark.parametrize("offset", [0, 17, 1500, 2400, ROWS - 5, ROWS, ROWS + 10])
def test_pages_by_offset(spark, stored, offset):
    root, data = stored
    want = [short(r) for r in order(data)][offset : offset + 60]
    assert flat(st.page(spark, root, offset, 60)) == want
    mine = [short(r) for r in order(data) if r[0] == "h2"][offset : offset + 60]
    assert flat(st.page(spark, root, offset, 60, ["h2"])) == mine


def test_pages_by_key(spark, stored):
    root, data = stored
    ordered = order(data)
    for at in (0, 900, 2200, 3100, ROWS - 1):
        r = ordered[at]
        key = dict(date=frame(spark, [r]).first()["date"], host_id=r[0], source=r[3], kind=r[2], path=r[5], event_id=r[8])
        want = [short(x) for x in ordered if (x[1], x[0], x[3], x[2], x[5], x[8] is not None, x[8] or 0) > (r[1], r[0], r[3], r[2], r[5], r[8] is not None, r[8] or 0)]
        assert flat(st.page_after(spark, root, key, 50)) == want[:50]


def files_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found = []

    def walk(p):
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            walk(p.executedPlan())
        elif "QueryStage" in p.getClass().getSimpleName():
            walk(p.plan())
        elif p.getClass().getSimpleName() == "FileSourceScanExec":
            found.append(p.metrics().apply("numFiles").value())
        else:
            kids = p.children()
            for i in range(kids.size()):
                walk(kids.apply(i))

    walk(plan)
    return sum(found)


def test_a_range_opens_its_months_only(spark, stored):
    root, data = stored
    everything = files_read(st.between(spark, root, "2020-01-01", "2030-01-01"))
    day = st.pivot(spark, root, "2024-03-11 12:00:00", 1200)
    assert everything > 50 and files_read(day) <= 6
    low, high = 1710158400 - 72000, 1710158400 + 72000
    assert sorted(flat(day), key=str) == sorted([short(r) for r in data if low <= r[1] <= high], key=str)
    assert files_read(st.page(spark, root, 100, 20)) <= everything / 5


def test_a_host_is_added_and_replaced_alone(spark, tmp_path):
    root = f"{tmp_path}/timeline"
    st.add_hosts(frame(spark, rows(2, ["a", "b"], 300)), root)
    names = lambda: {r["f"] for r in st.between(spark, root, "2020-01-01", "2030-01-01").select(F.input_file_name().alias("f")).distinct().collect()}
    first = names()
    st.add_hosts(frame(spark, rows(3, ["c"], 200)), root)
    assert first < names()
    st.add_hosts(frame(spark, rows(4, ["a"], 100)), root)
    assert {f for f in first if "host_id=b" in f} < names() and not {f for f in first if "host_id=a" in f} & names()
    total = st.hours(spark, root).groupBy("host_id").agg(F.sum("n").alias("n"))
    stored_rows = st.between(spark, root, "2020-01-01", "2030-01-01").groupBy("host_id").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, total.collect())) == sorted(map(tuple, stored_rows.collect()))
    assert st.page(spark, f"{tmp_path}/none", 0, 10).count() == 0
