"""Plain-text files as ordered lines.

Columns: host_id, source_file, block, line_no, line, anchor. (block, line_no) orders the
lines of a file; block is the start of the file split a line came from, so it also cuts a
very large file into shards for the ordered helpers. anchor is the file's own time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.functions.ordered import scan

FILE = ["host_id", "source_file"]
ORDER = ["block", "line_no"]
COLUMNS = ["host_id", "source_file", "block", "line_no", "line", "anchor"]
#: Lines of a shard in ordered computations.
SHARD_LINES = 1 << 14


def read_lines(spark: SparkSession, paths: str | list[str], host_id: str | Column) -> DataFrame:
    """Lines of text files (`.gz` included) in file order."""
    host = host_id if isinstance(host_id, Column) else F.lit(host_id)
    raw = spark.read.text(paths).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_modification_time").alias("anchor"),
        F.monotonically_increasing_id().alias("line_no"),
    )
    return raw.withColumn("host_id", host).select(COLUMNS)


def read_texts(spark: SparkSession, paths: str | list[str], host_id: str | Column) -> DataFrame:
    """Whole small files: host_id, source_file, text."""
    host = host_id if isinstance(host_id, Column) else F.lit(host_id)
    raw = spark.read.text(paths, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("source_file"))
    return raw.select(host.alias("host_id"), "source_file", "text")


def text_lines(texts: DataFrame) -> DataFrame:
    """Whole texts cut into lines, numbered from 1."""
    cut = texts.select("host_id", "source_file", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return cut.select("host_id", "source_file", F.lit(0).cast("bigint").alias("block"), (F.col("pos") + 1).cast("bigint").alias("line_no"), "line", F.lit(None).cast("timestamp").alias("anchor"))


def numbered(lines: DataFrame) -> DataFrame:
    """Adds `n`, the 1-based number of the line in its file."""
    return scan(lines, FILE, line_shard(), ORDER, sums={"n": F.lit(1)})


def line_shard() -> Column:
    """The stretch of a file that a line stands in, in file order."""
    return F.struct("block", F.expr(f"line_no div {SHARD_LINES}").alias("stretch"))


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """A regex group, null when empty or not found."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def strip(text: Column) -> Column:
    """Blanks and tabs removed at both ends."""
    return F.regexp_replace(text, r"^[ \t]+|[ \t]+$", "")
