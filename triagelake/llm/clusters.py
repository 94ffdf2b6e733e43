"""Operator 13. Centroid clustering on bit planes.

Vectors of 64 integers are stored as bit planes: plane i packs bit i of every component into one word of 64 bits. In
two's complement bit i weighs 2^i, and the last plane -2^i. The product of two vectors is then the sum over their planes
of the weights' product times the number of bits that both planes have set, which is exact. Distances follow from
products; a vector's own is stored. A round reads the planes once and returns the sums of each task and cluster, which
are counts of bits per plane and component times the planes' weights.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.shared import stored, table
from triagelake.llm.vectors import floor_mean, integers, list_rows, matrix, usable

WORD = 64
CENTROIDS = 8
ROUNDS = 10
SALT = 3


def weights(planes: int) -> np.ndarray:
    """Weight of each plane in two's complement."""
    w = np.int64(1) << np.arange(planes, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def pack(x: np.ndarray, planes: int) -> np.ndarray:
    """Rows of 64 integers as rows of `planes` words."""
    bits = (x[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8").reshape(len(x), planes)


def unpack(words: np.ndarray) -> np.ndarray:
    """The bits of rows of words: rows x planes x 64."""
    n, planes = words.shape
    return np.unpackbits(np.ascontiguousarray(words, "<u8").view(np.uint8).reshape(n, planes, 8), axis=2, bitorder="little")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of row i of a with row j of b, both as planes."""
    w = weights(a.shape[1])
    total = np.zeros((len(a), len(b)), np.int64)
    for i in range(a.shape[1]):
        inner = np.zeros_like(total)
        for j in range(b.shape[1]):
            inner += np.bitwise_count(a[:, i, None] & b[None, :, j]) * w[j]
        total += inner * w[i]
    return total


def own_products(a: np.ndarray) -> np.ndarray:
    """Exact product of each row with itself."""
    w = weights(a.shape[1])
    total = np.zeros(len(a), np.int64)
    for i in range(a.shape[1]):
        for j in range(a.shape[1]):
            total += np.bitwise_count(a[:, i] & a[:, j]) * (w[i] * w[j])
    return total


def assign(words: np.ndarray, own: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row (the smaller number of equal ones) and the squared distance."""
    planes = pack(centroids, words.shape[1])
    d = own[:, None] - 2 * products(words, planes) + own_products(planes)[None, :]
    at = d.argmin(axis=1)
    return at, d[np.arange(len(words)), at]


def _planes(batches: Iterator[pa.RecordBatch], planes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = pack(matrix(batch.column("x"), WORD), planes)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), list_rows(words.view(np.int64)), pa.array(own_products(words))], ["vec_id", "planes", "own"])


def _read(batch: pa.RecordBatch, planes: int) -> tuple[np.ndarray, np.ndarray]:
    return matrix(batch.column("planes"), planes).view(np.uint64), np.asarray(batch.column("own"))


def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, planes: int) -> Iterator[pa.RecordBatch]:
    sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
    for batch in batches:
        words, own = _read(batch, planes)
        at, _ = assign(words, own, centroids)
        for c in range(len(centroids)):
            sums[c] += weights(planes) @ unpack(words[at == c]).sum(axis=0, dtype=np.int64)
        counts += np.bincount(at, minlength=len(centroids))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centroids), dtype=np.int32)), pa.array(counts), list_rows(sums)], ["cluster", "n", "sums"])


def _nearest(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, planes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, d = assign(*_read(batch, planes), centroids)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(at.astype(np.int32)), pa.array(d)], ["vec_id", "cluster", "distance"])


def _move(rows: DataFrame, centroids: np.ndarray, planes: int) -> np.ndarray:
    """The centroids after one round; clusters x 64 sums come to the driver."""
    tasks = rows.select("planes", "own").mapInArrow(lambda b: _sums(b, centroids, planes), "cluster int, n long, sums array<long>").filter("n > 0")
    added = tasks.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(WORD)]).collect()
    sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
    for r in added:
        counts[r["cluster"]], sums[r["cluster"]] = r["n"], [r[f"s{i}"] for i in range(WORD)]
    return floor_mean(sums, counts, centroids)


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, salt: int = SALT) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance (squared) of every kept vector, and the last centroids.

    Kept are vectors of exactly 64 components, none null, non-finite, or of 2^17 or more in size (whose distances leave
    64 bits). The first centroids are those with the smallest sha256 of `salt:vec_id`, equal ids by their vectors; rows
    without a vec_id are clustered but don't start a cluster; fewer ids give fewer centroids. Repeated rows are vectors
    of their own. Without a vector that has an id, clusters and distances are null.
    """
    rows = vectors.filter(usable() & (F.size("embedding") == WORD)).select("vec_id", integers().alias("x"))
    sha = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = rows.filter("vec_id IS NOT NULL").select(sha.alias("h"), "x").orderBy("h", "x").limit(centroids).collect()
    at = np.array([r["x"] for r in first], np.int64).reshape(-1, WORD)
    if not len(at):
        return rows.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), at
    least, most = rows.agg(F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    planes = 1 + max(int(most), -int(least) - 1).bit_length()
    packed = stored(rows.mapInArrow(lambda b: _planes(b, planes), "vec_id long, planes array<long>, own long"), "planes")
    for _ in range(rounds):
        at = _move(packed, at, planes)
    return packed.mapInArrow(lambda b: _nearest(b, at, planes), "vec_id long, cluster int, distance long"), at


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    rows = stored(found, "clusters")
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    # A row per centroid, whose number is a parameter.
    per = rows.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia")).join(F.broadcast(named), "cluster")
    inertia = per.agg(F.try_sum("cluster_inertia").alias("inertia"))
    return rows.join(F.broadcast(per), "cluster").crossJoin(F.broadcast(inertia)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(centroids: int = CENTROIDS, rounds: int = ROUNDS, salt: int = SALT) -> str:
    steps = [f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id)) - 1 AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT r AS c, v FROM k WHERE r < {centroids})"""]
    assign = f"SELECT k.r, min((list_inner_product(k.v, k.v) - 2 * list_inner_product(k.v, b.v) + list_inner_product(b.v, b.v))::BIGINT * {centroids} + b.c) AS m FROM k, {{}} b GROUP BY k.r"
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({assign.format(f'c{i}')})")
        steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT b.c, coalesce(n.v, b.v) AS v FROM c{i} b LEFT JOIN (
  SELECT c, list(s ORDER BY i) AS v FROM (SELECT c, i, floor(sum(x) / count(*)) AS s FROM (
    SELECT a.m % {centroids} AS c, unnest(k.v) AS x, generate_subscripts(k.v, 1) AS i FROM k JOIN a{i} a ON a.r = k.r) GROUP BY c, i) GROUP BY c) n ON n.c = b.c)""")
    steps.append(f"z AS MATERIALIZED ({assign.format(f'c{rounds}')})")
    steps.append(f"""h AS (SELECT c, sha256(list_aggregate(list_transform(v, lambda x: x::BIGINT), 'string_agg', ',')) AS d FROM c{rounds})
SELECT vec_id, (m % {centroids})::INTEGER AS cluster, m // {centroids} AS distance, (sum(m // {centroids}) OVER (PARTITION BY m % {centroids}))::BIGINT AS cluster_inertia,
  (sum(m // {centroids}) OVER ())::BIGINT AS inertia, d AS centroid_sha256 FROM k JOIN z ON z.r = k.r JOIN h ON h.c = m % {centroids}""")
    return ",\n".join(steps)


ORACLE = _oracle()
