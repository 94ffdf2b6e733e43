import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from triagelake.llm import clusters, codes
from triagelake.llm.vectors import floor_mean

SCHEMA = "vec_id long, embedding array<float>, label string"


def lloyd(x, start, rounds):
    """Full scans only, in Python's own integers."""
    books = [list(map(int, r)) for r in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(books))
    for _ in range(rounds):
        own = [near(v)[1] for v in x]
        for i in range(len(books)):
            mine = [v for v, o in zip(x, own) if o == i]
            if mine:
                books[i] = [sum(col) // len(mine) for col in zip(*mine)]
    return [near(v) for v in x], books


def vectors(n, dim, seed=3, spread=0.5):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, spread, (n, dim)), 1).astype(np.float32)  # coarse, so that distances tie
    x[n // 2 :] = x[rng.integers(0, 4, n - n // 2)] + np.round(rng.normal(0, 0.05, (n - n // 2, dim)), 2).astype(np.float32)  # a hot third
    return x


def ints(x):
    return [[math.floor(1024 * float(v)) for v in row] for row in x]


def test_codes_match_full_scans(spark):
    x = vectors(260, 8)
    rows = [(i * 3, x[i].tolist(), ["a", "b", None][min(i % 5, 2)]) for i in range(len(x))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    coded, books = codes.compress(df, parts=4, entries=12, rounds=4)
    got = {r["vec_id"]: r for r in coded.collect()}
    v = ints(x)
    for p in range(4):
        part = [r[2 * p : 2 * p + 2] for r in v]
        near, last = lloyd(part, part[:12], 4)
        assert books[p].tolist() == last
        assert [(got[3 * i]["distances"][p], got[3 * i]["codes"][p]) for i in range(len(x))] == near


def test_only_moved_entries_are_compared():
    rng = np.random.default_rng(5)
    x, book = rng.integers(-6, 6, (400, 3)), rng.integers(-6, 6, (20, 3))
    code, d = codes.nearest(x, book)
    for _ in range(30):
        moved = rng.random(20) < 0.2
        book = np.where(moved[:, None], rng.integers(-6, 6, (20, 3)), book)
        code, d = codes.reassign(x, code, d, book, moved)
        want = codes.nearest(x, book)
        assert (code == want[0]).all() and (d == want[1]).all()


def test_large_components_stay_exact():
    x = np.array([[(1 << 27) - 1, -(1 << 27)], [(1 << 27) - 2, -(1 << 27)]])
    at, d = codes.nearest(x, x[::-1].copy())
    assert at.tolist() == [1, 0] and d.tolist() == [0, 0]
    assert codes.nearest(x[:1], -x[:1])[1].tolist() == [(2 * (1 << 27) - 2) ** 2 + (1 << 28) ** 2]


ODD = [
    (1, [0.5] * 64, "a"), (1, [0.5] * 64, "a"), (2, None, "a"), (3, [0.1, None] * 32, "b"), (4, [float("nan")] * 64, "b"), (5, [float("inf")] + [0.0] * 63, None),
    (6, [-0.25] * 64, None), (None, [0.25] * 64, None), (7, [0.0] * 64, "c"), (8, [], "c"), (9, [1.0] * 63, "c"), (10, [3e38] * 64, "c"), (11, [-0.0005] * 64, "a.b"),
]


def odd_vectors(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("codes", F.lit(1)).withColumn("a.b", F.lit(1)).withColumn("part", F.lit(1)).withColumn("x", F.lit("y"))


def test_codes_of_odd_vectors(spark):
    coded, books = codes.compress(odd_vectors(spark))
    got = sorted(coded.collect(), key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0))
    assert [r["vec_id"] for r in got] == [1, 1, 6, 7, 8, 9, 11, None]
    assert [r["codes"] is None for r in got] == [False, False, False, False, True, True, False, False]
    assert books.shape == (4, 6, 16) and all(set(r["distances"]) == {0} for r in got if r["codes"])
    assert [r["codes"] for r in got[:2]] == [[0] * 4] * 2  # equal entries: the lower index
    none, books = codes.compress(odd_vectors(spark).limit(0))
    assert none.count() == 0 and books is None
    short, books = codes.compress(spark.createDataFrame([(1, [0.5, 1.0, 0.0, 0.25, -1.0], 4)], "vec_id long, embedding array<double>, label int"))
    assert books.shape == (4, 1, 2) and short.first()["distances"] == [0] * 4


def test_planes_give_exact_products():
    rng = np.random.default_rng(2)
    for bits in (1, 5, 11, 27):
        x, y = (rng.integers(-(1 << bits), 1 << bits, (n, 64)) for n in (50, 7))
        planes = bits + 1
        a, b = clusters.pack(x, planes), clusters.pack(y, planes)
        assert (clusters.products(a, b) == x @ y.T).all() and (clusters.own_products(a) == (x * x).sum(axis=1)).all()
        assert (np.einsum("p,npw->nw", clusters.weights(planes), clusters.unpack(a).astype(np.int64)) == x).all()
    assert floor_mean(np.array([[-7, 7]]), np.array([2]), np.zeros((1, 2), int)).tolist() == [[-4, 3]]
    assert floor_mean(np.array([[0, 0]]), np.array([0]), np.array([[5, 6]])).tolist() == [[5, 6]]


def test_clusters_match_plain_distances(spark):
    x = vectors(300, 64)
    order = sorted(range(300), key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())
    df = spark.createDataFrame([(i, x[i].tolist(), None) for i in range(300)], SCHEMA).repartition(4)
    found, at = clusters.cluster(df, rounds=5)
    v = ints(x)
    near, last = lloyd(v, [v[i] for i in order[:8]], 5)
    assert at.tolist() == last
    assert [(r["distance"], r["cluster"]) for r in sorted(found.collect())] == near


def test_clusters_of_odd_vectors(spark):
    found, at = clusters.cluster(odd_vectors(spark))
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in found.collect()) == [(False, 1), (False, 1), (False, 6), (False, 7), (False, 11), (True, 0)]
    assert len(at) == 5
    none, at = clusters.cluster(odd_vectors(spark).filter("vec_id = 9"))
    assert none.count() == 0 and len(at) == 0
    nameless, at = clusters.cluster(odd_vectors(spark).filter("vec_id IS NULL"))
    assert [tuple(r) for r in nameless.collect()] == [(None, None, None)]


def test_queries_add_up(spark):
    data = "/root/testdata/sf0.001"
    rows = clusters.op13_clusters(spark, data).collect()
    assert sum(r["distance"] for r in rows) == rows[0]["inertia"] and len({r["cluster"] for r in rows}) == len({r["centroid_sha256"] for r in rows})
    coded = codes.op12_codes(spark, data).collect()
    assert all(len(r["code"]) == 8 for r in coded) and len({r["codebooks_sha256"] for r in coded}) == 1
