"""Ordered computations that never need a whole key in one task.

A plain window over a key puts every row of that key into one task, which fails
when one key holds a large share of the table. Each helper here takes a *shard*,
a monotone function of the sort order (a time bucket, a block of line numbers):
rows are windowed inside (keys, shard), and what a shard does to the state is one
small row, its transition: sums are added, the last or first value is replaced or
kept. Transitions compose in any grouping, so a prefix scan over those rows gives
the state before and after every shard.

`scan` and `runs` move and compute their rows once. Rows are packed by shard, and
both the transitions and the result read the packed rows, which is one exchange
that Spark reuses. A shard must fit in a row: thousands of rows, not millions.
`running_sum` takes shards of any size and reads its input twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST = Window.unboundedPreceding


def running_sum(df: DataFrame, keys: Sequence[str], shard: str, order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Adds inclusive running sums over (keys, order)."""
    staged = df.select("*", *[c.cast("long").alias(f"_d_{n}") for n, c in sums.items()])
    totals = staged.groupBy(*keys, shard).agg(*[F.sum(f"_d_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy(shard).rowsBetween(FIRST, -1)
    offsets = totals.select(*keys, shard, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy(*keys, shard).orderBy(*order).rowsBetween(FIRST, 0)
    joined = staged.join(offsets, [*keys, shard])
    out = [(F.sum(f"_d_{n}").over(inside) + F.col(f"_o_{n}")).alias(n) for n in sums]
    return joined.select(*df.columns, *out)


def _pack(df: DataFrame, keys: Sequence[str], shard: Column) -> DataFrame:
    """A row per (keys, _shard) with its rows."""
    others = [c for c in df.columns if c not in keys]
    # The join with the state would filter nulls out of one of the two branches, which then could not share an exchange.
    there = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, "_shard")])
    return df.withColumn("_shard", shard).filter(there).groupBy(*keys, "_shard").agg(F.collect_list(F.struct(*others)).alias("_rows"))


def _rows(packed: DataFrame, keys: Sequence[str], *more: str) -> DataFrame:
    """The packed rows again; they stay where they lie."""
    return packed.select(*keys, "_shard", *more, F.inline("_rows"))


def scan(
    df: DataFrame,
    keys: Sequence[str],
    shard: Column,
    order: Sequence[str],
    *,
    sums: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None,
    before: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
) -> DataFrame:
    """Adds, in the order of each key: inclusive running sums, the last non-null value up to the row or strictly
    before it, and the first non-null value strictly after it. Rows without a key or shard are left out."""
    sums, last, before, following = sums or {}, last or {}, before or {}, following or {}
    values = {**last, **before, **following}
    staged = df.select("*", *[c.cast("long").alias(f"_d_{n}") for n, c in sums.items()], *[c.alias(f"_v_{n}") for n, c in values.items()])
    packed = _pack(staged, keys, shard)
    rank = F.struct(*order)
    seen = lambda n: F.when(F.col(f"_v_{n}").isNotNull(), rank)
    transitions = _rows(packed, keys).groupBy(*keys, "_shard").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(f"_d_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max_by(f"_v_{n}", seen(n)).alias(f"_t_{n}") for n in (*last, *before)],
        *[F.min_by(f"_v_{n}", seen(n)).alias(f"_t_{n}") for n in following],
    )
    earlier = Window.partitionBy(*keys).orderBy("_shard").rowsBetween(FIRST, -1)
    later = Window.partitionBy(*keys).orderBy("_shard").rowsBetween(1, Window.unboundedFollowing)
    state = transitions.select(
        *keys, "_shard",
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.last(f"_t_{n}", ignorenulls=True).over(earlier).alias(f"_o_{n}") for n in (*last, *before)],
        *[F.first(f"_t_{n}", ignorenulls=True).over(later).alias(f"_o_{n}") for n in following],
    )
    joined = _rows(packed.join(state, [*keys, "_shard"]), keys, *[f"_o_{n}" for n in (*sums, *values)])
    inside = Window.partitionBy(*keys, "_shard").orderBy(*order)
    up_to, strictly, after = inside.rowsBetween(FIRST, 0), inside.rowsBetween(FIRST, -1), inside.rowsBetween(1, Window.unboundedFollowing)
    out = [(F.sum(f"_d_{n}").over(up_to) + F.col(f"_o_{n}")).alias(n) for n in sums]
    out += [F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(up_to), F.col(f"_o_{n}")).alias(n) for n in last]
    out += [F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(strictly), F.col(f"_o_{n}")).alias(n) for n in before]
    out += [F.coalesce(F.first(f"_v_{n}", ignorenulls=True).over(after), F.col(f"_o_{n}")).alias(n) for n in following]
    return joined.select(*df.columns, *out)


def runs(df: DataFrame, keys: Sequence[str], shard: Column, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds the number (from 1) of the run of equal neighbouring values that a row stands in. Values are not null.

    A shard's transition is (first value, last value, changes inside): one starts a new run where its first value is
    not the last one before it.
    """
    packed = _pack(df, keys, shard)
    inside = Window.partitionBy(*keys, "_shard").orderBy(*order)
    changed = F.coalesce(F.col(value) != F.lag(value).over(inside), F.lit(False)).cast("long")
    rank = F.struct(*order)
    transitions = _rows(packed, keys).withColumn("_c", changed).groupBy(*keys, "_shard").agg(
        F.min_by(value, rank).alias("_first"), F.max_by(value, rank).alias("_last"), F.sum("_c").alias("_changes")
    )
    along = Window.partitionBy(*keys).orderBy("_shard")
    fresh = F.coalesce(F.col("_first") != F.lag("_last").over(along), F.lit(True)).cast("long")
    state = transitions.select(*keys, "_shard", "_changes", fresh.alias("_fresh"))
    # Runs begun before the shard's first row, that one included.
    begun = F.coalesce(F.sum(F.col("_changes") + F.col("_fresh")).over(along.rowsBetween(FIRST, -1)), F.lit(0)) + F.col("_fresh")
    state = state.select(*keys, "_shard", begun.alias("_begun"))
    joined = _rows(packed.join(state, [*keys, "_shard"]), keys, "_begun").withColumn("_c", changed)
    return joined.select(*df.columns, (F.sum("_c").over(inside.rowsBetween(FIRST, 0)) + F.col("_begun")).alias(name))


def time_shard(ts: Column, seconds: float) -> Column:
    return F.floor(F.unix_micros(ts) / int(seconds * 1_000_000))


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence, n: int, rank: str = "_rank") -> DataFrame:
    """The first n rows of each key. Up to Spark's group-limit threshold (n = 1,000) the rank filter is applied before
    the shuffle too, so a task receives at most n rows per key and map task however large the key is."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def sample_lists(df: DataFrame, keys: Sequence[str], order: Sequence, value: str, n: int, name: str) -> DataFrame:
    """One row per key with the first n values as an ordered array."""
    top = first_n(df.select(*keys, *dict.fromkeys([*[o for o in order if isinstance(o, str)], value])), keys, order, n)
    packed = F.sort_array(F.collect_list(F.struct("_rank", value)))
    return top.groupBy(*keys).agg(F.transform(packed, lambda s: s[value]).alias(name))
