"""Case tables that change in one step.

A write first puts its Parquet files into a folder of its own, `data/batch=<id>` (and `host_id=<host>` below it for
tables of hosts). It takes effect with a commit: a small file with the next number that lists the batches of each part,
renamed into place where no file of that number may be. A part is a host, or a whole table without hosts. Readers
open the batches that the last commit names, so a write that is stopped leaves the table as it was, and of two writers
that started from the same commit the later one is told so. Replaced batches stay until `drop_unnamed`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The part of a table without hosts.
WHOLE = ""
Batches = dict[str, list[str]]


class CommitConflict(RuntimeError):
    """Another writer has changed the table since it was read."""


def _paths(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def last_commit(spark: SparkSession, table: str) -> tuple[int, Batches]:
    """Number and content of the last commit; 0 and nothing for a table that has none."""
    where, fs = _paths(spark, f"{table}/commits")
    if not fs.exists(where):
        return 0, {}
    numbers = [int(s.getPath().getName()) for s in fs.listStatus(where) if s.getPath().getName().isdigit()]
    if not numbers:
        return 0, {}
    stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/commits/{max(numbers):012d}"))
    try:
        return max(numbers), json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, table: str, base: int, batches: Batches) -> int:
    """Makes the batches the content of the table, if `base` is still its last commit."""
    jvm, number = spark._jvm, base + 1
    staged, fs = _paths(spark, f"{table}/commits/.{uuid.uuid4().hex}")
    out = fs.create(staged, False)
    try:
        out.write(bytearray(json.dumps(batches, ensure_ascii=True).encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), spark._jsc.hadoopConfiguration())
    final = jvm.org.apache.hadoop.fs.Path(f"{table}/commits/{number:012d}")
    # A rename that doesn't overwrite fails where another writer's commit has this number.
    plain = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(staged), fs.makeQualified(final), plain)
    except Exception as e:
        fs.delete(staged, False)
        if fs.exists(final):
            raise CommitConflict(f"{table} has a commit {number} already") from e
        raise
    return number


def stage(rows: DataFrame, table: str, by_host: bool, within: Sequence[str] = (), order: Sequence[str] = ()) -> str:
    """Writes rows as a batch that no commit names yet. A host with a large share of the rows is many tasks' work.

    `within` are columns with folders of their own below a host; files are sorted by `order`, if that is given.
    """
    batch = uuid.uuid4().hex
    if order:
        placed = ["host_id", *within, *order]
        rows.repartitionByRange(*placed).sortWithinPartitions(*placed).write.partitionBy("host_id", *within).parquet(f"{table}/data/batch={batch}")
        return batch
    if not by_host:
        rows.write.parquet(f"{table}/data/batch={batch}")
        return batch
    plain = [c for c in rows.columns if not isinstance(rows.schema[c].dataType, T.MapType)]
    spread = rows.withColumn("_h", F.xxhash64(*plain)).repartitionByRange("host_id", "_h").drop("_h")
    spread.write.partitionBy("host_id").parquet(f"{table}/data/batch={batch}")
    return batch


def hosts_of(spark: SparkSession, table: str, batch: str) -> list[str]:
    """The hosts that a staged batch holds, from its folders; a null host is in none."""
    where, fs = _paths(spark, f"{table}/data/batch={batch}")
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(unescape(n.removeprefix("host_id=")) for n in names if n.startswith("host_id="))


def read(spark: SparkSession, table: str, schema: T.StructType, by_host: bool, parts: Iterable[str] | None = None, at: int | None = None) -> DataFrame:
    """The rows of the last commit, or of commit `at`, of all parts or the named ones. Only their folders are opened."""
    if at is None:
        _, batches = last_commit(spark, table)
    else:
        stream_path, fs = _paths(spark, f"{table}/commits/{at:012d}")
        stream = fs.open(stream_path)
        batches = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
    wanted = batches if parts is None else {p: batches[p] for p in parts if p in batches}
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    folders = [f"{table}/data/batch={b}" + (f"/host_id={escape(p)}" if by_host else "") for p, some in wanted.items() for b in some]
    if not folders:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.StringType())])).option("basePath", f"{table}/data").parquet(*folders)
    return found.select(*[F.col(f.name) for f in schema.fields])


def replace_parts(rows: DataFrame, table: str, by_host: bool) -> int:
    """Replaces the hosts that the rows hold (or the whole table); other hosts keep their files."""
    spark = rows.sparkSession
    base, batches = last_commit(spark, table)
    batch = stage(rows, table, by_host)
    touched = hosts_of(spark, table, batch) if by_host else [WHOLE]
    return commit(spark, table, base, {**batches, **{p: [batch] for p in touched}})


def append(rows: DataFrame, table: str, by_host: bool, tries: int = 5) -> int:
    """Adds rows; no file that is there is rewritten. Appends of several writers follow one another."""
    spark = rows.sparkSession
    batch = stage(rows, table, by_host)
    touched = hosts_of(spark, table, batch) if by_host else [WHOLE]
    for left in range(tries, 0, -1):
        base, batches = last_commit(spark, table)
        try:
            return commit(spark, table, base, {**batches, **{p: [*batches.get(p, []), batch] for p in touched}})
        except CommitConflict:
            if left == 1:
                raise
    raise AssertionError


def merge(updates: DataFrame, table: str, schema: T.StructType, by_host: bool, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
    """Rewrites the parts that the updates touch as combine(their present rows, updates); other parts keep their files.

    The number of touched hosts, not of rows, comes to the driver.
    """
    spark = updates.sparkSession
    base, batches = last_commit(spark, table)
    touched = [r[0] for r in updates.select("host_id").filter("host_id IS NOT NULL").distinct().collect()] if by_host else [WHOLE]
    present = read(spark, table, schema, by_host, touched)
    batch = stage(combine(present, updates), table, by_host)
    written = hosts_of(spark, table, batch) if by_host else [WHOLE]
    # A touched host of which nothing is left has no part any more.
    kept = {p: b for p, b in batches.items() if p not in touched}
    return commit(spark, table, base, {**kept, **{p: [batch] for p in written}})


def drop_unnamed(spark: SparkSession, table: str) -> int:
    """Deletes the batches that the last commit doesn't name. Not while others read or write the table."""
    _, batches = last_commit(spark, table)
    named = {b for some in batches.values() for b in some}
    where, fs = _paths(spark, f"{table}/data")
    gone = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName().removeprefix("batch=") not in named] if fs.exists(where) else []
    for path in gone:
        fs.delete(path, True)
    return len(gone)
