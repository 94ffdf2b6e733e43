"""The timeline as a stored table: months in folders, rows in time order, and counts by hour.

A host's rows are added or replaced as one batch, without touching other hosts' files. A range of time opens the folders
of its months only, and inside a file the smallest and largest times of its row groups leave the rest out. The counts by
host and hour (the order statistics) say which stretch of time holds a page, so any page is read without sorting more
than that stretch: the page's rows and at most those of the hours at its ends.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake import commits

#: The total order of the rows.
ORDER = ["date", "host_id", "source", "kind", "path", "event_id"]
HOUR_US = 3_600_000_000
SCHEMA = T.StructType([
    T.StructField("host_id", T.StringType()), T.StructField("date", T.TimestampType()), T.StructField("kind", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("file_id", T.LongType()), T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("is_deleted", T.BooleanType()),
    T.StructField("event_id", T.LongType()), T.StructField("month", T.DateType()),
])


def hour_of(date: Column) -> Column:
    return F.call_function("div", F.unix_micros(date), F.lit(HOUR_US))


def month_of(date: Column) -> Column:
    return F.trunc(date, "month")


def add_hosts(timeline: DataFrame, table: str) -> int:
    """Adds the rows' hosts, or replaces what is stored of them; returns the commit's number."""
    spark = timeline.sparkSession
    base, batches = commits.last_commit(spark, table)
    batch = commits.stage(timeline.withColumn("month", month_of(F.col("date"))), table, True, within=["month"], order=["date"])
    staged = spark.read.schema(SCHEMA).parquet(f"{table}/data/batch={batch}")
    counts = staged.groupBy("host_id", hour_of(F.col("date")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    counts.repartitionByRange("hour").write.parquet(f"{table}/hours/batch={batch}")
    return commits.commit(spark, table, base, {**batches, **{h: [batch] for h in commits.hosts_of(spark, table, batch)}})


def hours(spark: SparkSession, table: str, hosts: list[str] | None = None) -> DataFrame:
    """Rows by host and hour, as of the last commit."""
    _, batches = commits.last_commit(spark, table)
    pairs = [(h, b) for h, some in batches.items() if hosts is None or h in hosts for b in some]
    if not pairs:
        return spark.createDataFrame([], "host_id string, hour long, n long")
    named = F.broadcast(spark.createDataFrame(pairs, "host_id string, batch string"))  # a row per host
    stored = spark.read.schema("host_id string, hour long, n long, batch string").option("basePath", f"{table}/hours")
    return stored.parquet(*sorted({f"{table}/hours/batch={b}" for _, b in pairs})).join(named, ["host_id", "batch"]).select("host_id", "hour", "n")


def between(spark: SparkSession, table: str, start: Column | str, end: Column | str, hosts: list[str] | None = None) -> DataFrame:
    """The rows of a closed range of time; other months' folders are not opened."""
    start, end = (F.lit(x).cast("timestamp") if isinstance(x, str) else x for x in (start, end))
    rows = commits.read(spark, table, SCHEMA, True, hosts)
    return rows.filter(F.col("month").between(month_of(start), month_of(end)) & F.col("date").between(start, end)).drop("month")


def pivot(spark: SparkSession, table: str, moment: str, pad_minutes: int = 30, hosts: list[str] | None = None) -> DataFrame:
    """The rows around a moment, ends included."""
    at, pad = F.lit(moment).cast("timestamp"), F.make_dt_interval(mins=F.lit(pad_minutes))
    return between(spark, table, at - pad, at + pad, hosts)


def _stretch(spark: SparkSession, table: str, first: int, last: int, hosts: list[str] | None) -> DataFrame:
    """The rows of whole hours."""
    return between(spark, table, F.timestamp_micros(F.lit(first * HOUR_US)), F.timestamp_micros(F.lit((last + 1) * HOUR_US - 1)), hosts)


def page(spark: SparkSession, table: str, offset: int, size: int, hosts: list[str] | None = None) -> DataFrame:
    """`size` rows from the place `offset` (from 0) of the total order; fewer at the end, none behind it."""
    per_hour = hours(spark, table, hosts).groupBy("hour").agg(F.sum("n").alias("n"))
    # A row per hour that holds any.
    upto = per_hour.withColumn("upto", F.sum("n").over(Window.orderBy("hour")))
    found = upto.filter((F.col("upto") > offset) & (F.col("upto") - F.col("n") < offset + size)).agg(F.min("hour"), F.max("hour"), F.min(F.col("upto") - F.col("n"))).first()
    if found[0] is None:
        return commits.read(spark, table, SCHEMA, True, []).drop("month")
    return _stretch(spark, table, found[0], found[1], hosts).orderBy(*ORDER).offset(offset - found[2]).limit(size)


def page_after(spark: SparkSession, table: str, key: dict, size: int, hosts: list[str] | None = None) -> DataFrame:
    """The first `size` rows behind a row, which its values of ORDER name (event_id may be null)."""
    known = [F.lit(key[c]).cast(SCHEMA[c].dataType) for c in ORDER]
    equal = [F.col(c).eqNullSafe(v) for c, v in zip(ORDER, known, strict=True)]
    # Nulls come first.
    above = [F.coalesce(F.col(c) > v, F.col(c).isNotNull() & v.isNull()) for c, v in zip(ORDER, known, strict=True)]
    behind = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [*equal[:i], above[i]]) for i in range(len(ORDER))])
    at = spark.range(1).select(hour_of(known[0])).first()[0]
    per_hour = hours(spark, table, hosts).filter(F.col("hour") >= at).groupBy("hour").agg(F.sum("n").alias("n"))
    # The key's own hour may be used up by rows before it, so it doesn't count.
    upto = per_hour.withColumn("upto", F.sum(F.when(F.col("hour") > at, F.col("n")).otherwise(0)).over(Window.orderBy("hour")))
    last = upto.agg(F.coalesce(F.min(F.when(F.col("upto") >= size, F.col("hour"))), F.max("hour"))).first()[0]
    if last is None:
        return commits.read(spark, table, SCHEMA, True, []).drop("month")
    return _stretch(spark, table, at, last, hosts).filter(behind).orderBy(*ORDER).limit(size)
