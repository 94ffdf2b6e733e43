"""Content sampling of the files behind an encryption burst."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from triagelake.functions.ordered import first_n
from triagelake.functions.text import extension
from triagelake.operators.cross_platform import encryption_bursts, extension_names
from triagelake.sources.contents import sampled_entropy

# Fixed values.
WINDOW = 64 * 1024
MIN_BYTES = 512
HIGH = 7.5


@F.pandas_udf(DoubleType())
def shannon(blocks: pd.Series) -> pd.Series:
    """Bits per byte of each block; an empty block is 0."""

    def one(block) -> float | None:
        if block is None:
            return None
        if len(block) == 0:
            return 0.0
        p = np.bincount(np.frombuffer(block, dtype=np.uint8), minlength=256) / len(block)
        p = p[p > 0]
        return float(-(p * np.log2(p)).sum()) + 0.0

    return blocks.map(one)


def windows(content: Column) -> Column:
    """The head, and for large contents also the middle and the tail; too short blocks left out."""
    n = F.octet_length(content)
    block = lambda at: F.substring(content, at + 1, F.lit(WINDOW))
    middle = F.floor(n / 2).cast("int") - WINDOW // 2
    parts = F.when(n > 2 * WINDOW, F.array(block(F.lit(0)), block(middle), block(n - WINDOW))).otherwise(F.array(block(F.lit(0))))
    return F.filter(parts, lambda b: F.octet_length(b) >= MIN_BYTES)


def max_entropy(contents: DataFrame, keys: list[str]) -> DataFrame:
    """Highest window entropy per content."""
    blocks = contents.select(*keys, F.explode(windows(F.col("content"))).alias("block"))
    return blocks.select(*keys, shannon("block").alias("h")).groupBy(*keys).agg(F.max("h").alias("h"))


def candidates(t, threshold: int = 25, per_extension: int | None = None) -> DataFrame:
    """The live files of each burst extension that are worth reading; the first few of each if a number is given."""
    names = extension_names(t)
    bursts = encryption_bursts(t, threshold, names).select("host_id", "ext")
    wanted = names.join(bursts, ["host_id", "ext"], "left_semi").select("host_id", "ext", F.col("name").alias("low"))
    live = t["files"].filter(~F.col("is_directory") & ~F.col("is_deleted") & (F.col("size") >= MIN_BYTES))
    live = live.withColumn("ext", extension(F.col("name"))).withColumn("low", F.lower("name")).join(wanted, ["host_id", "ext", "low"], "left_semi")
    some = live if per_extension is None else first_n(live, ["host_id", "ext"], ["id"], per_extension)
    return some.select("host_id", "ext", "id", "name", "parent_path", "size")


def statistics(measured: DataFrame) -> DataFrame:
    """Per extension the number of samples, of high ones, the mean and the maximum."""
    return measured.groupBy("host_id", "ext").agg(
        F.count("h").alias("sampled"), F.count_if(F.col("h") >= HIGH).alias("high"), F.avg("h").alias("mean_entropy"), F.max("h").alias("max_entropy")
    ).filter("sampled > 0")


def sample_bursts(t, contents: DataFrame, threshold: int = 25, per_extension: int | None = None) -> DataFrame:
    """Entropy table for the mass-encryption verdict; contents has (host_id, id, content)."""
    picked = candidates(t, threshold, per_extension)
    read = picked.join(contents, ["host_id", "id"])
    measured = max_entropy(read, ["host_id", "ext", "id"])
    return statistics(measured)


def sample_burst_files(t, places: DataFrame, threshold: int = 25, per_extension: int | None = None) -> DataFrame:
    """The same from files that are only named: places has (host_id, id, uri), and tasks read the sampled ranges."""
    picked = candidates(t, threshold, per_extension).select("host_id", "ext", "id").join(places, ["host_id", "id"])
    return statistics(sampled_entropy(picked, ["host_id", "ext", "id"], window=WINDOW, least=MIN_BYTES))


def scan_candidates(t, max_bytes: int | None = None, limit: int | None = None) -> DataFrame:
    """Live, real files for a rule scan, optionally up to a size and the first n per host."""
    live = t["files"].filter(
        ~F.col("is_directory") & ~F.col("is_deleted") & ~F.col("name").endswith("-slack") & (F.col("size") > 0)
    )
    if max_bytes is not None:
        live = live.filter(F.col("size") <= max_bytes)
    return live if limit is None else first_n(live, ["host_id"], ["id"], limit).drop("_rank")
