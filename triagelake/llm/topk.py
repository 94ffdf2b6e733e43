"""Operator 7. Exact top-k by inner product as a Voronoi kNN join.

Inner products become distances: with M the largest norm, a data vector x gets one more component
sqrt(M^2 - |x|^2) and a query a zero, and then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the largest products are the nearest
neighbours. Data and queries go to their nearest pivot. From a summary of each cell (count, least and largest
distance to the pivot) comes a bound on every query cell's k-th distance, and a data vector is sent to a group of
query cells only if its distance to them can stay within that bound. A group's queries are solved where they are
against slices of what was sent, and the slices' best are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagelake.llm.shared import stored, table

K, SCALE, EVERY = 20, 64, 20
PIVOTS = 48
#: Queries solved together, and data vectors that one task compares with them.
GROUP, SLICE_ROWS = 4096, 8192
#: Vectors multiplied at a time.
BLOCK = 2048


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix, shorter ones filled with zeros."""
    n = np.asarray(col.value_lengths())
    flat = np.asarray(col.flatten(), np.float64)
    out = np.zeros((len(n), dim))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """uid, vec_id and `v`, the vector in whole numbers; rows with a null vector or component, or one not finite, go."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(SCALE) * x.cast("double")))
    return vectors.filter(F.col("embedding").isNotNull()).filter(~bad).select(F.monotonically_increasing_id().alias("uid"), "vec_id", whole.alias("v"))


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T, 0))
    cell = d.argmin(1)
    return cell, d[np.arange(len(x)), cell]


def _assign(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, dim: int, top: float, query: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column("v"), dim)
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(top - (x * x).sum(1), 0))
        cell, dist = _nearest(np.column_stack([x, extra]), pivots)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(dist)], [*batch.schema.names, "cell", "dist"])


def _reach(pivots: np.ndarray, data: list, queries: list, k: int) -> np.ndarray:
    """For each query cell i and data cell j the range of pivot distances in j that may hold a neighbour: (i, j, 2)."""
    between = np.sqrt(np.maximum(((pivots[:, None] - pivots[None]) ** 2).sum(2), 0))
    n, far = np.zeros(len(pivots)), np.zeros(len(pivots))
    for cell, count, _, largest in data:
        n[cell], far[cell] = count, largest
    out = np.full((len(pivots), len(pivots), 2), np.nan)
    for i, _, _, radius in queries:
        upper = radius + between[i] + far
        order = np.argsort(np.where(n > 0, upper, np.inf), kind="stable")
        enough = np.searchsorted(np.cumsum(n[order]), k + 1)  # one more: a query's own row doesn't count
        bound = upper[order[enough]] if enough < len(order) else np.inf
        slack = 1e-6 * (1 + bound if np.isfinite(bound) else 1)
        # |q x| >= | |p_i p_j| - |x p_j| | - radius must not pass the bound
        out[i, :, 0], out[i, :, 1] = between[i] - radius - bound - slack, between[i] + radius + bound + slack
    return out


def _groups(queries: list, pivots: np.ndarray, size: int) -> tuple[dict[int, list[int]], int]:
    """Groups of query cells, near ones together, of about `size` queries; a larger cell is dealt over several."""
    left = {cell: n for cell, n, _, _ in queries}
    of: dict[int, list[int]] = {}
    group, room, at = 0, size, None
    while left:
        at = min(left, key=lambda c: 0.0 if at is None else float(((pivots[c] - pivots[at]) ** 2).sum()))
        n = left.pop(at)
        if n > room and room < size:
            group, room = group + 1, size
        parts = max(1, math.ceil(n / size))
        of[at] = list(range(group, group + parts))
        group, room = (group, room - n) if parts == 1 else (group + parts, size)
    return of, group + 1


def _send(batches: Iterator[pa.RecordBatch], reach: np.ndarray, of: dict[int, list[int]], slices: int) -> Iterator[pa.RecordBatch]:
    """Data vectors by the groups that need them."""
    for batch in batches:
        cell, dist = np.asarray(batch.column("cell")), np.asarray(batch.column("dist"))
        slice_ = np.asarray(batch.column("slice"))
        need: dict[int, np.ndarray] = {}
        for i, groups in of.items():
            within = (dist >= reach[i, cell, 0]) & (dist <= reach[i, cell, 1])
            for g in groups:
                need[g] = need.get(g, False) | within
        for g, some in need.items():
            rows = batch.filter(pa.array(some))
            if rows.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(g * slices + slice_[some].astype(np.int64)), pa.array(np.ones(rows.num_rows, np.int8)), *(rows.column(c) for c in ("uid", "vec_id", "v"))], ["unit", "data", "uid", "vec_id", "v"])


class _Best:
    """The k best of every query so far, ties to the smaller vec_id."""

    def __init__(self, q: np.ndarray, uid: np.ndarray, ids: np.ndarray, k: int):
        self.q, self.uid, self.ids, self.k = q, uid, ids, k
        self.at, self.score, self.found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(len(q), -np.inf)
        self.limit = np.abs(q).sum(1).max(initial=0)

    def add(self, x: np.ndarray, uid: np.ndarray, ids: np.ndarray) -> None:
        exact = self.limit * np.abs(x).max(initial=0) < 2**53
        s = self.q @ x.T if exact else (self.q.astype(np.int64) @ x.astype(np.int64).T)
        own = np.searchsorted(self.uid, uid)
        own_at = np.flatnonzero(self.uid[np.minimum(own, len(self.uid) - 1)] == uid)
        open_ = np.ones(s.shape, bool)
        open_[own[own_at], own_at] = False
        if s.shape[1] > self.k + 1:
            kth = np.partition(s, s.shape[1] - self.k - 1, axis=1)[:, s.shape[1] - self.k - 1]
            self_least = np.maximum(self.least, kth)
        else:
            self_least = self.least
        at, j = np.nonzero((s >= self_least[:, None]) & open_)
        at, score, found = np.append(self.at, at), np.append(self.score, s[at, j].astype(np.int64)), np.append(self.found, ids[j])
        order = np.lexsort((found, -score, at))
        at, score, found = at[order], score[order], found[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = place < self.k
        self.at, self.score, self.found = at[keep], score[keep], found[keep]
        full = place == self.k - 1
        self.least[at[full]] = score[full]

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.uid[self.at]), pa.array(self.ids[self.at]), pa.array(self.found), pa.array(self.score)], ["uid", "query_id", "vec_id", "score"])


def _solve(batches: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """Units one after another, each with its queries first (sorted by uid)."""
    unit, queries, best = None, [], None

    def begin() -> _Best:
        t = pa.Table.from_batches(queries).combine_chunks()
        return _Best(_matrix(t["v"].combine_chunks(), dim), np.asarray(t["uid"]), np.asarray(t["vec_id"]), k)

    for batch in batches:
        keys = np.asarray(batch.column("unit")) * 2 + np.asarray(batch.column("data"))
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if part.column("unit")[0].as_py() != unit:
                if best is not None:
                    yield best.rows()
                unit, queries, best = part.column("unit")[0].as_py(), [], None
            if not part.column("data")[0].as_py():
                queries.append(part)
                continue
            if best is None and queries:
                best = begin()
            if best is not None:
                for i in range(0, part.num_rows, BLOCK):
                    x = part.slice(i, BLOCK)
                    best.add(_matrix(x.column("v"), dim), np.asarray(x.column("uid")), np.asarray(x.column("vec_id")))
    if best is not None:
        yield best.rows()


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, pivots: int = PIVOTS) -> DataFrame:
    """The k best of all other rows for each row whose vec_id is divisible by `every`.

    query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id, and fewer rows where there are fewer
    candidates. Rows with a null vec_id, or a vector that is null or holds a null or non-finite component, take no
    part. Vectors of different lengths are compared as if filled with zeros. Rows that repeat a vec_id are queries
    and candidates of their own. Scores are exact up to 63 bits.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    data = stored(whole_vectors(vectors.filter(F.col("vec_id").isNotNull()).select("vec_id", "embedding")), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    rows, dim, top = data.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm)).first()
    if not rows:
        return spark.createDataFrame([], schema)
    slices = math.ceil(rows / SLICE_ROWS)
    some = data.orderBy(F.xxhash64("uid", F.lit(5))).limit(pivots).select("v").toArrow()
    p = _matrix(some["v"].combine_chunks(), dim)
    p = np.column_stack([p, np.sqrt(np.maximum(top - (p * p).sum(1), 0))])
    fields = "uid long, vec_id long, v array<long>, cell int, dist double"
    data_cells = data.mapInArrow(lambda b: _assign(b, p, dim, top, False), fields)
    asked = data.filter(F.col("vec_id") % every == 0).mapInArrow(lambda b: _assign(b, p, dim, top, True), fields)
    summary = lambda df: [tuple(r) for r in df.groupBy("cell").agg(F.count(F.lit(1)), F.min("dist"), F.max("dist")).collect()]  # noqa: E731 - a row per pivot
    queries = sorted(summary(asked))
    if not queries:
        return spark.createDataFrame([], schema)
    reach = _reach(p, summary(data_cells), queries, k)
    of, n_groups = _groups(queries, p, GROUP)
    place = F.create_map(*[x for c, groups in of.items() for x in (F.lit(c), F.array(*[F.lit(g) for g in groups]))])[F.col("cell")]
    group = F.element_at(place, (F.pmod(F.xxhash64("uid"), F.size(place)) + 1).cast("int"))
    ask = asked.select((group.cast("long") * slices).alias("first"), F.lit(0).cast("byte").alias("data"), "uid", "vec_id", "v")
    ask = ask.select(F.explode(F.sequence(F.col("first"), F.col("first") + slices - 1)).alias("unit"), "data", "uid", "vec_id", "v")
    fields = "unit long, data byte, uid long, vec_id long, v array<long>"
    sent = data_cells.withColumn("slice", F.pmod(F.xxhash64("uid", F.lit(9)), F.lit(slices))).mapInArrow(lambda b: _send(b, reach, of, slices), fields)
    units = ask.union(sent).repartition(n_groups * slices, "unit").sortWithinPartitions("unit", "data", "uid")
    best = units.mapInArrow(lambda b: _solve(b, dim, k), "uid long, query_id long, vec_id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
