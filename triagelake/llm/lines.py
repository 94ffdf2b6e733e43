"""Operator 11. Line dedup over levelled sorted runs of line hashes.

Documents arrive in batches, the largest ids first. A batch's lines become one entry per key: its 128-bit hash, in how
many documents it stands and the largest of them. The batch is merged against the runs written so far and anti-joined
with the keys that are settled there, that is, known from enough documents: since ids fall from batch to batch, nothing
can change for those. What is left becomes a run of its own. A level holds one run at most: a second one is merged with
it into a run of the next level, before it is written. All runs merged say which keys repeat and which document keeps them.

A run is a table bucketed and sorted by the hash. A file costs its writer several processes where Hadoop has no native
library, so only runs are written, and their buckets follow the number of rows, not the session's shuffles: entries move
into the buckets when they are written, one task and one file a bucket. Runs merge with each other where they lie; beside
a batch that lies in more partitions than there are buckets, a run's entries move once more.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.shared import HOT_SHARE, join_hot_apart, packed, shared_folder, stored, table, text_key, unpacked
from triagelake.llm.textcore import released, slices, utf8

#: Shorter keys (in code points) always stay.
LEAST_POINTS = 20
#: A key in so many documents loses its lines but for those of the last document.
LEAST_DOCUMENTS = 3
BATCHES = 6
#: Rows of lines for each bucket of a run, which has at most an entry for each.
BUCKET_ROWS = 1 << 19
WHITE = b" \t\n\x0b\x0c\r"
KEY = ["hi", "lo"]


def key_of(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z in lower case."""
    return line.strip(WHITE).lower()


def line_keys(batches: Iterator[pa.RecordBatch], least_points: int) -> Iterator[pa.RecordBatch]:
    """For each row of doc_id, text_key, text its distinct long keys' hashes and the numbers of their lines."""
    for batch in released(batches):
        data, offsets, _ = utf8(batch.column("text"))
        for i, j in slices(offsets):
            digests, rows, lines = [], [], []
            for row in range(i, j):
                found: dict[bytes, list[int]] = {}
                for at, line in enumerate(data[offsets[row] : offsets[row + 1]].tobytes().split(b"\n")):
                    key = key_of(line)
                    if len(key) >= 4 * least_points or (len(key) >= least_points and len(key.decode(errors="replace")) >= least_points):
                        found.setdefault(xxhash.xxh3_128_digest(key), []).append(at)
                digests += found
                lines += found.values()
                rows += [row] * len(found)
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column("doc_id").take(taken), batch.column("text_key").take(taken), pa.array(lines, pa.list_(pa.int32()))],
                [*KEY, "doc_id", "text_key", "lines"],
            )


class Runs:
    """Levelled sorted runs of (hi, lo, n, last, hot): in how many documents a key stands, the largest doc_id of them,
    and whether it is hot in some batch."""

    def __init__(self, spark: SparkSession, settled: int = LEAST_DOCUMENTS, rows: int = 0):
        """rows: of all batches."""
        self.spark, self.settled = spark, settled
        self.buckets = -(-rows // BUCKET_ROWS) or 1
        self.levels: list[DataFrame | None] = []
        self.tables: list[str] = []

    def write(self, entries: DataFrame) -> DataFrame:
        """Entries as a bucketed and sorted table in the shared folder, one file a bucket."""
        name = f"line_run_{uuid.uuid4().hex}"
        # The hash by which Spark names a bucket.
        placed = entries.repartitionById(self.buckets, F.pmod(F.hash(*KEY), F.lit(self.buckets)))
        placed.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{shared_folder(self.spark)}/{name}").option("compression", "zstd").format("parquet").saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [run for run in self.levels if run is not None]

    def fresh(self, entries: DataFrame) -> DataFrame:
        """The entries whose key isn't settled by the runs; hot ones stay in any case, to be known as such."""
        if "hot" not in entries.columns:
            entries = entries.withColumn("hot", F.lit(False))
        known = F.lit(0)
        for i, run in enumerate(self.runs()):
            entries = entries.join(run.select(*KEY, F.col("n").alias(f"n{i}")), KEY, "left")
            known = known + F.coalesce(f"n{i}", F.lit(0))
        return entries.filter((known < self.settled) | F.col("hot")).select(*KEY, "n", "last", "hot")

    def merged(self, one: DataFrame, two: DataFrame) -> DataFrame:
        """Two runs as one. A full outer join of equal buckets, as a union would not keep them together."""
        n = F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))
        hot = F.coalesce("a.hot", F.lit(False)) | F.coalesce("b.hot", F.lit(False))
        return one.alias("a").join(two.alias("b"), KEY, "full").select(*KEY, n.alias("n"), F.greatest("a.last", "b.last").alias("last"), hot.alias("hot"))

    def add(self, entries: DataFrame) -> None:
        """Adds the unsettled entries of a batch as a run, compacted with the levels that hold one already."""
        run = self.fresh(entries)
        for at, other in enumerate(self.levels):
            if other is None:
                self.levels[at] = run if at else self.write(run)
                return
            run, self.levels[at] = self.write(self.merged(other, run)), None
        self.levels.append(run if self.levels else self.write(run))

    def whole(self) -> DataFrame:
        """All runs as one, the smallest levels first; the last merge is left to the reader."""
        first, *rest = self.runs()
        for i, run in enumerate(rest):
            first = self.merged(run, self.write(first) if i else first)
        return first

    def forget(self) -> None:
        """Takes the runs' names out of the catalog; their files stay."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        self.tables = []


def batch_of(docs: DataFrame, batches: int) -> F.Column:
    """Number of a row's batch: about equal stretches of doc_id, the largest ids in batch 0, null ids in the last."""
    shares = [(i + 1) / batches for i in range(batches - 1)]
    bounds = (docs.agg(F.percentile_approx("doc_id", shares).alias("b")).first()["b"] if shares else None) or []
    below = sum((F.when(F.col("doc_id") <= b, 1).otherwise(0) for b in sorted(set(bounds))), F.lit(0))
    return F.when(F.col("doc_id").isNull(), batches - 1).otherwise(below).cast("int")


def repeated_lines(docs: DataFrame, least_points: int = LEAST_POINTS, least_documents: int = LEAST_DOCUMENTS, batches: int = BATCHES) -> DataFrame:
    """doc_id, text_key and the numbers (from 0) of the lines to drop, for the documents that have any."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", text_key().alias("text_key"), "text").filter(F.length("text") >= least_points)
    found = keyed.mapInArrow(lambda b: line_keys(b, least_points), "hi long, lo long, doc_id long, text_key long, lines array<int>")
    # In order of the batch, so that a batch's read skips the other pages, and a task writes one file.
    lines = stored(found.withColumn("batch", batch_of(docs, batches)).sortWithinPartitions("batch"), "lines")
    sizes = {r["batch"]: r["count"] for r in lines.groupBy("batch").count().collect()}
    if not sizes:
        return lines.select("doc_id", "text_key", F.array("lines").alias("drops"))
    runs = Runs(spark, least_documents, sum(sizes.values()))
    for number in sorted(sizes):
        # Distinct documents first, so that a key of a third of all documents is counted before its entries meet.
        own = lines.filter(F.col("batch") == number).groupBy(*KEY, "doc_id").agg(F.count(F.lit(1)).alias("rows"))
        # A key with more than its share of all rows has more than that share in some batch: under HOT_SHARE keys a batch.
        hot = F.sum("rows") * HOT_SHARE > sizes[number]
        runs.add(own.groupBy(*KEY).agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("last"), hot.alias("hot")))
    known = stored(runs.whole().filter((F.col("n") >= least_documents) | F.col("hot")), "repeated")
    runs.forget()
    verdict = known.filter(F.col("n") >= least_documents).select(*KEY, "last")
    gone = join_hot_apart(lines.drop("batch"), verdict, known.filter("hot").select(*KEY), KEY).filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    return gone.groupBy("doc_id", "text_key").agg(F.collect_set("lines").alias("drops"))


def cut_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in released(batches):
        data, offsets, valid = utf8(batch.column("text"))
        others = [c for c in batch.schema.names if c not in ("text", "drops")]
        for i, j in slices(offsets):
            kept, lines, dropped = [], [], []
            for row, drops in zip(range(i, j), batch.column("drops").slice(i, j - i).to_pylist(), strict=True):
                text = data[offsets[row] : offsets[row + 1]].tobytes()
                gone = {at for some in drops or () for at in some}
                kept.append((b"\n".join([x for at, x in enumerate(text.split(b"\n")) if at not in gone]) if gone else text).decode(errors="replace") if valid[row] else None)
                lines.append(text.count(b"\n") + 1)
                dropped.append(len(gone))
            columns = [batch.column(c).slice(i, j - i) for c in others]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*others, "text", "n_lines", "n_dropped"])


def drop_repeated_lines(docs: DataFrame, least_points: int = LEAST_POINTS, least_documents: int = LEAST_DOCUMENTS, batches: int = BATCHES) -> DataFrame:
    """All rows with their columns, the text without its repeated lines, n_lines (before) and n_dropped.

    A line's key is the line without white space at its ends, A-Z in lower case. Keys of `least_points` code points
    found in `least_documents` documents lose all their lines but those of the largest doc_id that holds them; lines
    repeated inside that document stay. A null or empty text is one empty line; null stays null. Rows that repeat a
    doc_id are one document; rows without a doc_id count for none, and their repeated lines go. Text without a
    kept line becomes empty. An empty table gives no rows. Columns named n_lines or n_dropped are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    drops = repeated_lines(docs, least_points, least_documents, batches)
    rows = packed(docs, "doc_id", "text").withColumn("text_key", text_key())
    both = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.text_key") == F.col("g.text_key"))
    marked = rows.alias("d").join(drops.alias("g"), both, "left").select("d.doc_id", "d._row", "d.text", "g.drops")
    schema = marked.drop("text", "drops").schema.add("text", "string").add("n_lines", "long").add("n_dropped", "long")
    cut = marked.mapInArrow(cut_lines, schema)
    return cut.select(*unpacked(cut, docs.columns, "doc_id", "text"), "n_lines", "n_dropped")


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, g.key IS NOT NULL AND k.doc_id IS DISTINCT FROM g.last AS gone FROM k LEFT JOIN g ON g.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
