"""Operator 6. Sharding by a two-pass external shuffle.

Pass one scatters every record uniformly over buckets of bounded size by a seeded hash; pass two gives each
bucket a Fisher-Yates permutation and writes it. Buckets follow one another in one global order, and the
shards are equal stretches of that order, so counts differ by at most one (law `rows`) and almost every
bucket is written to one shard.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.llm.shared import quoted, stored, table, text_key

SHARDS = 16
#: Mean bytes of text in a bucket. A bucket is permuted in one task's memory.
BUCKET_BYTES = 4 << 20
#: Rows weigh at least so many bytes, so tables of empty texts get enough buckets too.
ROW_BYTES = 64


def scatter(docs: DataFrame, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """Pass one: the records with their bucket, as a table in the shared folder, and the number of buckets.

    The hash takes the row's place in its input partition besides doc_id, so neither repeated rows nor null ids
    meet in one bucket. The table fixes the buckets: later readers see the same ones even if an executor is lost.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES
    total = docs.agg(F.sum(size.cast("long"))).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "doc_id", text_key(), F.monotonically_increasing_id()), F.lit(buckets))
    # The row travels as one column, so that no column of it can clash with the working ones.
    return stored(docs.select(bucket.alias("_bucket"), F.struct(*quoted(docs)).alias("_row")), "scatter"), buckets


def bucket_starts(scattered: DataFrame, groups: int = 1024) -> DataFrame:
    """Global position of each bucket's first record, by running sums inside and over groups of buckets."""
    sizes = scattered.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_g", F.floor(F.col("_bucket") / groups))
    sums = sizes.groupBy("_g").agg(F.sum("_n").alias("_gn"))
    over = "sum({}) over ({} order by {} rows between unbounded preceding and 1 preceding)"
    outer = sums.select("_g", F.coalesce(F.expr(over.format("_gn", "", "_g")), F.lit(0)).alias("_outer"), F.expr("sum(_gn) over ()").alias("_total"))
    inner = sizes.select("_bucket", "_g", F.coalesce(F.expr(over.format("_n", "partition by _g", "_bucket")), F.lit(0)).alias("_inner"))
    return inner.join(outer, "_g").select("_bucket", (F.col("_inner") + F.col("_outer")).alias("_start"), "_total")


def shuffle_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All records in a uniformly random order, with shard and slot (gapless from 0 in each shard).

    Every row stays, repeated ones too; null texts and ids are rows like others; an empty table gives no rows.
    The order is a function of the seed and of the input's rows and partitions. Other columns are carried along;
    those named shard or slot are replaced.
    """
    docs = docs.drop("shard", "slot")
    scattered, _ = scatter(docs, seed, bucket_bytes)
    keyed = scattered.withColumn("_key", F.xxhash64(F.lit(seed + 1), "_row.doc_id", text_key("_row.text"))).join(bucket_starts(scattered), "_bucket")
    schema = T.StructType([*keyed.schema.fields, T.StructField("_place", T.LongType())])

    def permute(bucket: pa.Table) -> pa.Table:
        n = bucket.num_rows
        order = np.argsort(np.asarray(bucket["_key"]), kind="stable")
        draw = np.random.default_rng([seed, int(bucket["_bucket"][0].as_py())])
        for i, j in enumerate((np.arange(n) + draw.integers(0, np.arange(n, 0, -1))).tolist()):
            order[i], order[j] = order[j], order[i]  # Fisher-Yates: place i takes one of the records from i on
        return bucket.take(order).append_column("_place", pa.array(np.arange(n), pa.int64()))

    # The bucket's global start is joined before the permutation: both need the same exchange.
    permuted = keyed.groupBy("_bucket").applyInArrow(permute, schema)
    # In integers: the last shard whose first position is not behind the record's.
    shard = F.expr(f"int(({shards} * (_start + _place + 1) - 1) div _total)")
    slot = F.expr(f"_start + _place - (shard * _total) div {shards}")
    return permuted.withColumn("shard", shard).withColumn("slot", slot).select("_row.*", "shard", "slot")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """The shuffled records as Parquet, one folder per shard; slot holds the order inside a shard."""
    shuffle_shards(docs, **options).write.partitionBy("shard").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shuffled = shuffle_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return shuffled.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
