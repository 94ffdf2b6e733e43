"""Roll-ups along path prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.operators.cross_platform import full_path


def _prefixes(parts: Column, sep: str) -> Column:
    """Every leading run of the parts, joined by the separator."""
    return F.transform(parts, lambda p, i: F.concat(F.lit(sep), F.array_join(F.slice(parts, F.lit(1), i + 1), sep)))


def rollup(df: DataFrame, path: Column, sep: str, *, extra_keys: list[str], is_leaf: Column, size: Column, changed: Column) -> DataFrame:
    """One row per path prefix: files below it, their bytes, folders, and the last change.

    Rows are counted per full path before the prefixes are made, and again per prefix in
    the map stage, so the busy top folders arrive as one row per task.
    """
    pieces = F.filter(F.split(path, "[" + ("\\\\\\\\" if sep == "\\" else sep) + "]"), lambda p: p != "")
    keys = ["host_id", *extra_keys]
    flat = df.select(*keys, pieces.alias("parts"), is_leaf.alias("leaf"), size.cast("long").alias("bytes"), changed.alias("at"))
    whole = flat.groupBy(*keys, "parts").agg(
        F.count_if("leaf").alias("files"), F.count_if(~F.col("leaf")).alias("folders"), F.sum("bytes").alias("bytes"), F.max("at").alias("last")
    )
    steps = whole.select(*keys, "files", "folders", "bytes", "last", F.posexplode(_prefixes(F.col("parts"), sep)).alias("level", "path"))
    return steps.groupBy(*keys, "path", (F.col("level") + 1).alias("depth")).agg(
        F.sum("files").alias("files"), F.sum("folders").alias("folders"), F.sum("bytes").alias("bytes"), F.max("last").alias("last")
    )


def file_tree(t) -> DataFrame:
    """Files per prefix. With several file systems the volume is the top layer of the key."""
    df = t["files"].withColumn("volume", F.coalesce(F.col("fs_id").cast("string"), F.lit("none")))
    return rollup(df, full_path(), "/", extra_keys=["volume"], is_leaf=~F.col("is_directory"), size=F.col("size"), changed=F.col("modified"))


def volume_layer(t) -> DataFrame:
    """Volumes of each host by offset, with the number of records; only hosts with more than one."""
    counts = t["files"].groupBy("host_id", "fs_id").agg(F.count(F.lit(1)).alias("n"))
    per_host = counts.groupBy("host_id").agg(F.count("fs_id").alias("volumes")).filter("volumes > 1")
    vol = t["volumes"].select("host_id", F.col("id").alias("fs_id"), "fs_type", "offset_bytes")
    label = F.coalesce("fs_type", F.concat(F.lit("Volume "), F.col("fs_id").cast("string")), F.lit("Unassigned"))
    return counts.join(per_host.select("host_id"), "host_id", "left_semi").join(vol, ["host_id", "fs_id"], "left").select("host_id", "fs_id", label.alias("label"), "offset_bytes", "n")


def mft_tree(t) -> DataFrame:
    df = t["mft"].filter("file_name IS NOT NULL")
    return rollup(df, F.coalesce("full_path", "file_name"), "\\", extra_keys=["volume"], is_leaf=~F.col("is_directory"), size=F.coalesce("size", F.lit(0)), changed=F.lit(None).cast("timestamp"))


def registry_tree(t) -> DataFrame:
    """Values per key prefix and hive, with the last write below it."""
    return rollup(t["registry"], F.col("path"), "\\", extra_keys=["hive"], is_leaf=F.lit(True), size=F.lit(0), changed=F.col("last_written"))


def leaves(t) -> DataFrame:
    """Files as tree leaves: two files of one path stay apart by their id."""
    path = full_path()
    return t["files"].filter("NOT is_directory").select("host_id", F.concat(path, F.lit("#"), F.col("id").cast("string")).alias("node"), "name", "size", "is_deleted")
