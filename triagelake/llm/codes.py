"""Operator 12. Vector codes by active-entry Lloyd.

A vector of integers is cut into equal parts, and each part is coded by the nearest entry of its position's codebook.
Rounds of assignment and averaging move the entries. A part remembers its entry and the exact squared distance to it.
While that entry stays where it is, the distance stays true and no other unmoved entry can have come nearer, so only the
entries that moved are compared, and an equal distance goes to the lower index. A part whose entry moved is compared
with all.

A round is one pass over the stored vectors: it writes them with their new entries and distances, and behind them the
sums of each task. The driver holds the codebooks alone, whose size is set by the parameters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.llm.shared import stored, table, with_sum
from triagelake.llm.vectors import floor_mean, integers, list_rows, matrix, usable

PARTS = 4
ENTRIES = 256
ROUNDS = 4


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row (the lowest of equal ones) and the exact squared distance."""
    # Products of doubles are quick and exact as long as no sum can reach 2^53.
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * largest * largest < 1 << 53 else np.int64
    x, entries = x.astype(kind), entries.astype(kind)
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)[None, :]
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at].astype(np.int64)


def reassign(x: np.ndarray, code: np.ndarray, distance: np.ndarray, book: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New entries and distances of one position's parts, from the former ones (code -1: none) and the moved entries."""
    code, distance = code.copy(), distance.copy()
    scan = (code < 0) | moved[code]
    if scan.any():
        code[scan], distance[scan] = nearest(x[scan], book)
    stay, among = np.flatnonzero(~scan), np.flatnonzero(moved)
    if len(stay) and len(among):
        at, d = nearest(x[stay], book[among])
        at = among[at]
        better = (d < distance[stay]) | ((d == distance[stay]) & (at < code[stay]))
        code[stay[better]], distance[stay[better]] = at[better], d[better]
    return code, distance


class Assigner:
    """One round over the rows of a task."""

    def __init__(self, books: np.ndarray, moved: np.ndarray, schema: pa.Schema):
        self.books, self.moved, self.schema = books, moved, schema
        self.parts, self.entries, self.width = books.shape

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(self.books.shape, np.int64), np.zeros(self.books.shape[:2], np.int64)
        for batch in batches:
            n = len(batch)
            x = matrix(batch.column("x"), self.parts * self.width).reshape(n, self.parts, self.width)
            codes, distances = matrix(batch.column("codes"), self.parts).copy(), matrix(batch.column("distances"), self.parts).copy()
            for p in range(self.parts):
                codes[:, p], distances[:, p] = reassign(x[:, p], codes[:, p], distances[:, p], self.books[p], self.moved[p])
                np.add.at(sums[p], codes[:, p], x[:, p])
                counts[p] += np.bincount(codes[:, p], minlength=self.entries)
            own = {"codes": list_rows(codes), "distances": list_rows(distances)}
            nothing = lambda f: pa.nulls(n, f.type)
            yield pa.RecordBatch.from_arrays([own.get(f.name, batch.column(f.name) if f.name in batch.schema.names else nothing(f)) for f in self.schema], schema=self.schema)
        part, entry = np.nonzero(counts)
        m = len(part)
        own = {"part": pa.array(part.astype(np.int32)), "entry": pa.array(entry.astype(np.int32)), "n": pa.array(counts[part, entry]), "sums": list_rows(sums[part, entry])}
        yield pa.RecordBatch.from_arrays([own.get(f.name, pa.nulls(m, f.type)) for f in self.schema], schema=self.schema)


def _assign(state: DataFrame, books: np.ndarray, moved: np.ndarray) -> DataFrame:
    """The state after one more assignment; rows with a part are sums over the parts of an entry."""
    from pyspark.sql.pandas.types import to_arrow_schema

    sums = [T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in state.schema], *sums])
    return stored(state.mapInArrow(Assigner(books, moved, to_arrow_schema(schema)), schema), "codes")


def _average(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks whose entries are the floored means of their parts; the sums come as parts x entries x width numbers."""
    tasks = state.filter("part IS NOT NULL").select("part", "entry", "n", "sums")
    counted = tasks.groupBy("part", "entry").agg(F.sum("n").alias("n")).collect()
    added = tasks.select("part", "entry", F.posexplode("sums")).groupBy("part", "entry", "pos").agg(F.sum("col").alias("s")).collect()
    sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
    for r in counted:
        counts[r["part"], r["entry"]] = r["n"]
    for r in added:
        sums[r["part"], r["entry"], r["pos"]] = r["s"]
    return np.stack([floor_mean(sums[p], counts[p], books[p]) for p in range(len(books))])


def hex_code(codes: Column, parts: int) -> Column:
    return F.concat(*[F.lower(F.lpad(F.hex(codes[p]), 2, "0")) for p in range(parts)])


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """vec_id, label, codes (an index per part), distances (squared, per part) and the codebooks.

    Vectors that are null, hold a null or non-finite component, or one of 2^17 or more in size (its distances leave
    64 bits) are dropped. The first entries are the parts of the smallest vec_ids, equal ids by their vectors, null ids
    last; fewer vectors give fewer entries. The first vector sets the length; it is filled up with zeros to a multiple
    of `parts`; vectors of another length come back with null codes and move no entry. Repeated rows are vectors of
    their own. Labels are of any type, null ones too. An empty table gives no rows and no codebooks.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits")
    rows = vectors.filter(usable()).select("vec_id", "label", integers().alias("x"))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").first()
    if first is None:
        return rows.select("vec_id", "label", F.lit(None).cast("array<long>").alias("codes"), F.lit(None).cast("array<long>").alias("distances")), None
    length = len(first["x"])
    width = max(1, -(-length // parts))
    fill = F.array_repeat(F.lit(0).cast("long"), parts * width - length)
    alike = rows.filter(F.size("x") == length).withColumn("x", F.concat("x", fill))
    start = np.array([r["x"] for r in alike.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()], np.int64)
    books = start.reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    none = F.array_repeat(F.lit(-1).cast("long"), parts)
    state, moved = alike.withColumn("codes", none).withColumn("distances", none), np.ones(books.shape[:2], bool)
    for _ in range(rounds):
        after = _assign(state, books, moved)
        new = _average(after, books)
        moved, books = (new != books).any(axis=2), new
        state = after.filter("part IS NULL").select(*state.columns)
    last = _assign(state, books, moved).filter("part IS NULL").select("vec_id", "label", "codes", "distances")
    other = rows.filter(F.size("x") != length).select("vec_id", "label", F.lit(None).cast("array<long>"), F.lit(None).cast("array<long>"))
    return last.unionAll(other), books


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest() if books is not None else None
    error = F.aggregate("distances", F.lit(0).cast("long"), lambda a, d: a + d)
    rows = coded.select("vec_id", "label", hex_code(F.col("codes"), PARTS).alias("code"), error.alias("error"))
    return with_sum(rows, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    steps = [f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor({1024} * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, q, v[q * len(v) // {parts} + 1 : (q + 1) * len(v) // {parts}] AS v FROM k, (SELECT unnest(range({parts})) AS q)),
b0 AS MATERIALIZED (SELECT q, r AS e, v FROM p WHERE r < {entries})"""]
    # Squared distance and index in one number, so that its minimum takes the lower index of equal distances.
    assign = f"SELECT p.r, p.q, min((list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, b.v) + list_inner_product(b.v, b.v))::BIGINT * {entries} + b.e) AS m FROM p JOIN {{}} b ON b.q = p.q GROUP BY p.r, p.q"
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({assign.format(f'b{i}')})")
        steps.append(f"""b{i + 1} AS MATERIALIZED (SELECT b.q, b.e, coalesce(n.v, b.v) AS v FROM b{i} b LEFT JOIN (
  SELECT q, e, list(s ORDER BY i) AS v FROM (SELECT q, e, i, floor(sum(x) / count(*)) AS s FROM (
    SELECT p.q, a.m % {entries} AS e, unnest(p.v) AS x, generate_subscripts(p.v, 1) AS i FROM p JOIN a{i} a ON a.r = p.r AND a.q = p.q) GROUP BY q, e, i) GROUP BY q, e) n ON n.q = b.q AND n.e = b.e)""")
    steps.append(f"z AS MATERIALIZED ({assign.format(f'b{rounds}')})")
    steps.append(f"""h AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY q, e, i)) AS d FROM (SELECT q, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM b{rounds})),
c AS (SELECT r, string_agg(lower(printf('%02x', m % {entries})), '' ORDER BY q) AS code, sum(m // {entries})::BIGINT AS error FROM z GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, d AS codebooks_sha256 FROM k JOIN c ON c.r = k.r, h""")
    return ",\n".join(steps)


ORACLE = _oracle()
