"""First-window bursts over (host, key), exact on ties and safe on hot keys.

Why a few rows per bucket are enough: cut time into buckets as wide as the
window. A bucket that holds k rows holds a complete burst, so nothing after its
k-th row can be the end of the *first* burst, and the bucket before the first
burst holds fewer than k rows. The first k rows of each (key, bucket) therefore
decide the answer, whatever share of the table one key or one bucket holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.functions.ordered import FIRST, first_n, running_sum, sample_lists


def _bucketed(df: DataFrame, ts: str, window_s: float) -> DataFrame:
    return df.withColumn("_us", F.unix_micros(ts)).withColumn("_bucket", F.call_function("div", F.col("_us"), F.lit(int(window_s * 1_000_000))))


def first_count_burst(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], k: int, window_s: float) -> DataFrame:
    """The k rows that form the first run of k rows within the window, per key.

    Adds `burst_pos` (1..k). Keys with no burst give no rows.
    """
    order = ["_us", *tie]
    few = first_n(_bucketed(df, ts, window_s), [*keys, "_bucket"], order, k).drop("_rank")
    w = Window.partitionBy(*keys).orderBy(*order)
    span = F.col("_us") - F.lag("_us", k - 1).over(w)
    ranked = few.withColumn("_span", span).withColumn("_seq", F.row_number().over(w))
    width = int(window_s * 1_000_000)
    # The end is looked up in the same sorted rows, at most k for each bucket of a key.
    end = F.min(F.when(F.col("_span") <= width, F.col("_seq"))).over(Window.partitionBy(*keys))
    out = ranked.withColumn("_end", end).filter(F.col("_seq").between(F.col("_end") - (k - 1), F.col("_end")))
    return out.withColumn("burst_pos", F.col("_seq") - F.col("_end") + k).drop("_us", "_bucket", "_span", "_seq", "_end")


def first_distinct_burst(
    df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], value: str, k: int, window_s: float
) -> DataFrame:
    """Where each key first shows k distinct values within the window.

    Output per key: first_us, last_us (bounds of the window), values (the k distinct
    values by their first row in the window).

    Per (key, bucket, value) only the first and last row matter, and of those only the
    first k values of a bucket, by the argument in the module text.
    """
    width = int(window_s * 1_000_000)
    pos = F.struct("_us", *tie)
    base = _bucketed(df, ts, window_s).select(*keys, value, *tie, "_us", "_bucket")
    per_value = (
        base.groupBy(*keys, "_bucket", value)
        .agg(F.min(pos).alias("_first"), F.max(pos).alias("_last"))
    )
    few = first_n(per_value, [*keys, "_bucket"], ["_first"], k).drop("_rank")
    # A candidate end is a value's first row in its bucket; the window behind it reaches
    # at most one bucket back, so each row is also offered to the next bucket.
    here = few.select(*keys, F.col("_bucket").alias("_b"), value, "_first", "_last", F.lit(0).alias("_back"))
    back = few.select(*keys, (F.col("_bucket") + 1).alias("_b"), value, "_first", "_last", F.lit(1).alias("_back"))
    ends = few.select(*keys, F.col("_bucket").alias("_b"), F.col("_first").alias("_end"))
    seen = here.unionByName(back)
    covered = ends.join(seen, [*keys, "_b"]).filter(
        (F.col("_last._us") >= F.col("_end._us") - width) & (F.col("_first") <= F.col("_end"))
    )
    full = covered.groupBy(*keys, "_b", "_end").agg(F.count_distinct(value).alias("_n")).filter(F.col("_n") >= k)
    chosen = full.groupBy(*keys).agg(F.min(F.struct("_end", "_b")).alias("_hit")).select(*keys, "_hit._end", "_hit._b")
    # Exact start of the window: the earliest row of the key not older than the width.
    rows = base.join(chosen, list(keys))
    inside = rows.filter((F.col("_us") >= F.col("_end._us") - width) & (F.struct("_us", *tie) <= F.col("_end")))
    firsts = inside.groupBy(*keys, value).agg(
        F.min(pos).alias("_p"), F.min("_us").alias("_lo"), F.max("_end._us").alias("_hi")
    )
    return firsts.groupBy(*keys).agg(
        F.min("_lo").alias("first_us"),
        F.max("_hi").alias("last_us"),
        F.transform(F.sort_array(F.collect_list(F.struct("_p", value))), lambda s: s[value]).alias("values"),
    )


def first_spread_burst(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: Sequence[str],
    value: str,
    k: int,
    max_per_value: float,
    window_s: float,
    shard_s: float = 60.0,
) -> DataFrame:
    """First window with at least k distinct values and at most max_per_value rows per value.

    A row with a null value counts as a row but not as a value. The number of rows and of
    distinct values in the trailing window is a sweep line: +1 where a row (or a value not
    seen within the window) enters, -1 where it expires. Two running sums, no self-join.
    Output per key: first_us, last_us, n_values, n_rows, sample (first eight values by name).
    """
    width = int(window_s * 1_000_000)
    shard = int(shard_s * 1_000_000)
    base = df.select(*keys, F.col(value).alias("_val"), F.unix_micros(ts).alias("_us"), *[F.col(t) for t in tie])
    base = base.withColumn("_bucket", F.call_function("div", F.col("_us"), F.lit(max(width, 1))))
    # Only a row of the same value within the window matters, so at most one bucket back: the last row of each bucket
    # is lent to the next one. Rows without a value are told apart by time, so that they don't meet in one task.
    apart = F.when(F.col("_val").isNull(), F.col("_us"))
    lent = base.filter(F.col("_val").isNotNull()).groupBy(*keys, "_val", (F.col("_bucket") + 1).alias("_bucket")).agg(F.max(F.struct("_us", *tie)).alias("_l"))
    lent = lent.select(*keys, "_val", "_bucket", "_l.*", F.lit(False).alias("_own"))
    inside = Window.partitionBy(*keys, "_val", "_bucket", apart).orderBy("_us", *tie)
    rows = base.withColumn("_own", F.lit(True)).unionByName(lent).withColumn("_prev", F.when(F.col("_val").isNotNull(), F.lag("_us").over(inside))).filter("_own")
    known = F.coalesce(F.col("_us") - F.col("_prev") <= width, F.lit(False))
    is_value = F.col("_val").isNotNull().cast("int")

    def step(at: Column, kind: int, n_rows: Column, n_values: Column) -> Column:
        return F.struct(at.alias("_us"), F.lit(kind).alias("_kind"), n_rows.cast("int").alias("_rows"), n_values.cast("int").alias("_vals"))

    enter = step(F.col("_us"), 0, F.lit(1), is_value * (~known).cast("int"))
    leave = step(F.col("_us") + width, 1, F.lit(-1), -is_value)
    # A value seen again within the window does not expire with its earlier row.
    renew = F.when(known, step(F.col("_prev") + width, 1, F.lit(0), F.lit(1)))
    steps = rows.select(*keys, *tie, F.explode(F.array(enter, leave, renew)).alias("_s")).filter("_s IS NOT NULL")
    sweep = steps.select(*keys, *tie, "_s.*").withColumn("_shard", F.call_function("div", F.col("_us"), F.lit(shard)))
    summed = running_sum(
        sweep, keys, "_shard", ["_us", "_kind", *tie], {"n_rows": F.col("_rows"), "n_values": F.col("_vals")}
    )
    passing = summed.filter(
        (F.col("_kind") == 0) & (F.col("n_values") >= k) & (F.col("n_rows") <= F.col("n_values") * max_per_value)
    )
    best = passing.groupBy(*keys).agg(F.min(F.struct("_us", *tie, "n_values", "n_rows")).alias("_hit"))
    hit = best.select(*keys, F.col("_hit._us").alias("last_us"), F.col("_hit.n_values"), F.col("_hit.n_rows"))
    starts = base.join(hit, list(keys)).filter(F.col("_us").between(F.col("last_us") - width, F.col("last_us")))
    found = starts.groupBy(*keys).agg(
        F.min("_us").alias("first_us"), F.max("last_us").alias("last_us"), F.max("n_values").alias("n_values"), F.max("n_rows").alias("n_rows"),
    )
    names = starts.filter(F.col("_val").isNotNull()).select(*keys, "_val").distinct()
    return found.join(sample_lists(names, keys, ["_val"], "_val", 8, "sample"), list(keys), "left")


def largest_window(df: DataFrame, keys: Sequence[str], ts: str, k: int, window_s: float, extra: Column | None = None) -> DataFrame:
    """The fullest trailing window per key with at least k rows, the earliest on ties.

    Rows are first counted per exact time, and time is cut into buckets as wide as the window, so no task holds a whole
    key. The window behind a row is the rows of its bucket up to it and those of the bucket before that have not left
    yet. Each count is lent to the next bucket at the time it leaves; read from the latest time back, the lent counts
    met so far are those still inside. Running sums, so the work doesn't grow with the rows in a window.
    Output per key: n_rows, first_us, last_us, and `extra` (an aggregate) over the rows at first_us.
    """
    width = int(window_s * 1_000_000)
    span = max(width, 1)
    extra = F.lit(None).cast("string") if extra is None else extra
    counts = (
        df.filter(F.col(ts).isNotNull())
        .withColumn("_us", F.unix_micros(ts))
        .groupBy(*keys, "_us")
        .agg(F.count(F.lit(1)).alias("_n"), extra.alias("_extra"))
    )
    # Rounded down, also before 1970: a count must leave in the bucket after its own.
    bucket = F.call_function("div", F.col("_us") - F.pmod("_us", F.lit(span)), F.lit(span))
    own = F.struct(bucket.alias("_bucket"), F.lit(True).alias("_own"), F.col("_us").alias("_at"))
    lent = F.struct((bucket + 1).alias("_bucket"), F.lit(False).alias("_own"), (F.col("_us") + width).alias("_at"))
    steps = counts.select("*", F.inline(F.array(own, lent)))
    # A count that leaves at a row's time is still inside.
    back = Window.partitionBy(*keys, "_bucket").orderBy(F.col("_at").desc(), "_own")
    met = back.rowsBetween(FIRST, 0)
    every = back.rowsBetween(FIRST, Window.unboundedFollowing)
    later = F.sum(F.when(F.col("_own"), F.col("_n")).otherwise(-F.col("_n"))).over(met) - F.col("_n")
    first = F.struct(F.col("_us").alias("first_us"), F.col("_extra").alias("extra"))
    sums = steps.select(
        *keys,
        "_us",
        "_own",
        (F.sum(F.when(F.col("_own"), F.col("_n"))).over(every) - later).alias("n_rows"),
        F.coalesce(F.last(F.when(~F.col("_own"), first), ignorenulls=True).over(met), F.min_by(first, F.when(F.col("_own"), F.col("_us"))).over(every)).alias("_first"),
    )
    cand = sums.filter(F.col("_own") & (F.col("n_rows") >= k)).select(*keys, "n_rows", "_first.*", F.col("_us").alias("last_us"))
    best = cand.groupBy(*keys).agg(
        F.max_by(F.struct("n_rows", "first_us", "last_us", "extra"), F.struct("n_rows", -F.col("last_us"))).alias("_w")
    )
    return best.select(*keys, "_w.*")
