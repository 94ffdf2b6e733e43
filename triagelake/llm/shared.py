"""Work tables in the folder that driver and executors share, and small reading helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; a temporary one where none is set and all runs in one process, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="triagelake-llm-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Writes the rows as a table in the shared folder, in folders by the columns `by`, and reads it back.

    Cuts the lineage and fixes what depends on row order; the files outlive a lost executor.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_written_order(docs: DataFrame, *columns: str) -> DataFrame:
    """The given columns of a table read from files, in the order in which the rows were written: by range over
    partitions and sorted inside each.

    A plain read deals out files and splits by size, not by place. The writer numbers its files by partition; a task
    that wrote several numbers those behind the same partition number.
    """
    number = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("long")
    placed = docs.select(*columns, F.struct(number.alias("part"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("_place"))
    return placed.repartitionByRange("_place").sortWithinPartitions("_place").select(*columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: str | Column = "text") -> Column:
    """64 bits of a text (null counts as empty); with doc_id it names a row, so repeated rows share their result."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def quoted(df: DataFrame, *without: str) -> list[Column]:
    """All columns of df but the named ones, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in without]


def packed(docs: DataFrame, *own: str) -> DataFrame:
    """The named columns, and all others as one, `_row`, so that none of them can clash with the working ones, and a
    name may hold any characters: functions over Arrow batches resolve the names of their input's columns."""
    return docs.select(*own, F.struct(F.lit(0).alias("_"), *quoted(docs, *own)).alias("_row"))


def unpacked(df: DataFrame, columns: list[str], *own: str) -> list[Column]:
    """The columns of a packed table again, in the given order."""
    return [F.col(c) if c in own else F.col("_row")[c].alias(c) for c in columns]


#: A key is hot if it holds more than one row in so many; there can't be more hot keys than that.
HOT_SHARE = 1024


def join_hot_apart(big: DataFrame, small: DataFrame, hot: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of `big` with `small`, which is unique by `on`; nulls are keys like others.

    Rows of the keys in `hot`, whose number the caller has bounded, are joined by broadcast and never meet in one task;
    no key among the others holds more than the share of rows that made the caller call a key hot.
    """
    both = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in on]
    values = [F.col(f"s.{c}") for c in small.columns if c not in on]
    keys = F.broadcast(hot.select(*on))
    few = F.broadcast(small.alias("s").join(keys.alias("h"), both("s", "h"), "left_semi"))
    apart = big.alias("b").join(few.alias("s"), both("b", "s")).select("b.*", *values)
    rest = big.alias("b").join(keys.alias("h"), both("b", "h"), "left_anti")
    return apart.unionAll(rest.alias("b").join(small.alias("s"), both("b", "s")).select("b.*", *values))


def with_sum(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The rows with the sum of `value` over all rows of an equal `key` (nulls together), null if it leaves 64 bits."""
    sums = rows.groupBy(key).agg(F.try_sum(value).alias(name), F.count(F.lit(1)).alias("_n"))
    hot = sums.filter(F.col("_n") * HOT_SHARE > rows.count())
    return join_hot_apart(rows, sums.drop("_n"), hot, [key])
