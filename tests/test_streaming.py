"""A file replayed in micro-batches gives what the batch operators give; late rows are counted."""

import random

from pyspark.sql import functions as F

from triagelake.operators import bursts, gaps
from triagelake.streaming import live

T0 = 1_700_000_000
FLUSH = "zz"  # a row of this host, far in the future, moves the watermark past all others


def replay(spark, tmp_path, steps, make, name, schema):
    """Runs a stream over one file a step and gives its query and rows."""
    for i, rows in enumerate(steps):
        df = spark.createDataFrame(rows, schema).coalesce(1).withColumn("date", F.timestamp_seconds(F.col("s") / 1000)).drop("s")
        df.write.mode("append").parquet(f"{tmp_path}/in/step={i:03d}")
    stored = spark.read.parquet(f"{tmp_path}/in").drop("step").schema
    stream = spark.readStream.schema(stored).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return query, spark.table(name).filter(F.col("host_id") != FLUSH)


def test_sessions_equal_the_batch(spark, tmp_path):
    draw = random.Random(3)
    times = sorted(T0 * 1000 + draw.randrange(5 * 86400) * 1000 + draw.choice([0, 500]) for _ in range(150))
    times += [times[-1] + 3_600_000, times[-1] + 7_200_000, times[-1] + 10_800_001]  # exactly the threshold, and a millisecond more
    rows = [(draw.choice(["a", "b"]), t) for t in times[:-3]] + [("a", t) for t in [times[-4], *times[-3:]]]
    rows.sort(key=lambda r: r[1] + draw.randrange(300_000))  # out of order by less than the lateness
    steps = [rows[i : i + 40] for i in range(0, len(rows), 40)] + [[(FLUSH, times[-1] + 10 * 86_400_000)], [(FLUSH, times[-1] + 20 * 86_400_000)]]
    query, got = replay(spark, tmp_path, steps, lambda s: live.sessions(s, 3600, "10 minutes"), "live_sessions", "host_id string, s long")
    batch = spark.createDataFrame(rows, "host_id string, s long").withColumn("date", F.timestamp_seconds(F.col("s") / 1000))
    want = gaps.sessions(batch, 3600).select("host_id", "start", "end", "count")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert live.late_rows(query) == 0


def test_first_bursts_equal_the_batch(spark, tmp_path):
    draw = random.Random(5)
    rows = []
    for user in ("u0", "u1", "u2", "u3"):
        rows += [("h", user, T0 * 1000 + draw.randrange(86_400) * 1000) for _ in range(40 if user != "u3" else 3)]
    rows += [("h", "hot", T0 * 1000 + i * 1000) for i in range(300)]
    rows.sort(key=lambda r: r[2] + draw.randrange(200_000))
    steps = [rows[i : i + 110] for i in range(0, len(rows), 110)] + [[(FLUSH, "x", (T0 + 9 * 86400) * 1000)], [(FLUSH, "x", (T0 + 19 * 86400) * 1000)]]
    schema = "host_id string, user string, s long"
    query, got = replay(spark, tmp_path, steps, lambda s: live.first_bursts(s, ["host_id", "user"], "date", 4, 1800), "live_bursts", schema)
    batch = spark.createDataFrame(rows, schema).withColumn("date", F.timestamp_seconds(F.col("s") / 1000)).withColumn("n", F.monotonically_increasing_id())
    want = bursts.first_count_burst(batch, ["host_id", "user"], "date", ["n"], 4, 1800).groupBy("host_id", "user").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() >= 3
    assert live.late_rows(query) == 0


def test_late_rows_are_counted(spark, tmp_path):
    hour = 3_600_000
    steps = [[("a", T0 * 1000)], [("a", T0 * 1000 + 5 * hour)], [("a", T0 * 1000 + 5 * hour + 1000)], [("a", T0 * 1000 + 1000), ("a", T0 * 1000 + 2000)], [(FLUSH, T0 * 1000 + 99 * hour)], [(FLUSH, T0 * 1000 + 199 * hour)]]
    query, got = replay(spark, tmp_path, steps, lambda s: live.sessions(s, 600, "10 minutes"), "live_late", "host_id string, s long")
    assert live.late_rows(query) == 2
    assert sorted(r["count"] for r in got.collect()) == [1, 2]
