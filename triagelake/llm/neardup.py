"""Operator 10. Near-duplicate embeddings by hierarchical navigable small-world graphs, one per shard.

Vectors are split by label and, within a label, by hash into shards of bounded size; each shard gets a graph of its
own. Every vector of a label is then looked up in every shard of that label. A look-up returns all vectors of at
least the wanted cosine as long as the worst in its beam lies below it; else its beam widens. For each pair of shards
an audit compares a sample of look-ups with brute force and widens all beams until the wanted recall is met. Links
are verified in double precision, counted where they are found, and only a forest of them is handed on.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.graph import Forest, components
from triagelake.llm.shared import stored, table

COSINE = 0.98
#: Vectors of a shard at most, about: a task holds two shards.
SHARD = 16384
NEIGHBOURS, BUILD_BEAM, BEAM = 12, 48, 32
#: Look-ups compared with brute force for each pair of shards, and the recall they must reach.
AUDIT, RECALL = 512, 0.97
#: Look-ups of each audit whose answer is known to exist.
PROBES = 128


class Graph:
    """A navigable small-world graph over unit vectors."""

    def __init__(self, x: np.ndarray, levels: np.ndarray, links: list[dict[int, list[int]]], entry: int):
        self.x, self.levels, self.links, self.entry = x, levels, links, entry
        self.seen, self.turn = np.zeros(len(x), np.int64), 0

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 3) -> Graph:
        rng = np.random.default_rng(seed)
        levels = np.minimum((-np.log(1 - rng.random(len(x))) / np.log(NEIGHBOURS)).astype(int), 12)
        g = cls(x, levels, [{} for _ in range(int(levels.max(initial=0)) + 1)], 0)
        for i in range(len(x)):
            g._insert(i)
        return g

    def _insert(self, i: int) -> None:
        level = int(self.levels[i])
        for k in range(level + 1):
            self.links[k][i] = []
        if i == 0:
            return
        top, at = int(self.levels[self.entry]), [self.entry]
        for k in range(top, level, -1):
            at = [self.search(self.x[i], at, 1, k)[0][1]]
        for k in range(min(top, level), -1, -1):
            found = self.search(self.x[i], at, BUILD_BEAM, k)
            at = [j for _, j in found]
            room = NEIGHBOURS * 2 if k == 0 else NEIGHBOURS
            mine = self._diverse(found, NEIGHBOURS)
            self.links[k][i] = mine
            for j in mine:
                theirs = self.links[k][j]
                theirs.append(i)
                if len(theirs) > room:
                    s = self.x[theirs] @ self.x[j]
                    order = np.argsort(-s)
                    self.links[k][j] = self._diverse([(float(s[o]), theirs[o]) for o in order], room)
        if level > top:
            self.entry = i

    def _diverse(self, found: list[tuple[float, int]], room: int) -> list[int]:
        """Nearest first, leaving out those closer to a chosen one than to the centre; the rest fill up."""
        if len(found) <= room:
            return [j for _, j in found]
        ids = [j for _, j in found]
        among = self.x[ids] @ self.x[ids].T
        chosen: list[int] = []
        for p, (s, _) in enumerate(found):
            if len(chosen) == room:
                break
            if not chosen or among[p, chosen].max() < s:
                chosen.append(p)
        if len(chosen) < room:
            taken = set(chosen)
            chosen += [p for p in range(len(found)) if p not in taken][: room - len(chosen)]
        return [ids[p] for p in chosen]

    def search(self, q: np.ndarray, start: list[int], beam: int, level: int) -> list[tuple[float, int]]:
        """The beam's (similarity, position), best first."""
        self.turn += 1
        seen, turn, links = self.seen, self.turn, self.links[level]
        start = list(dict.fromkeys(start))
        seen[start] = turn
        s = self.x[start] @ q
        best = [(float(v), j) for v, j in zip(s, start, strict=True)]
        open_ = [(-v, j) for v, j in best]
        heapq.heapify(best)
        heapq.heapify(open_)
        while len(best) > beam:
            heapq.heappop(best)
        while open_:
            v, j = heapq.heappop(open_)
            if len(best) >= beam and -v < best[0][0]:
                break
            near = np.array(links[j], np.int64)
            near = near[seen[near] != turn] if len(near) else near
            if not len(near):
                continue
            seen[near] = turn
            s = self.x[near] @ q
            for value, n in zip(s.tolist(), near.tolist(), strict=True):
                if len(best) < beam:
                    heapq.heappush(best, (value, n))
                    heapq.heappush(open_, (-value, n))
                elif value > best[0][0]:
                    heapq.heapreplace(best, (value, n))
                    heapq.heappush(open_, (-value, n))
        return sorted(best, reverse=True)

    def within(self, q: np.ndarray, least: float, beam: int, own: int | None = None) -> list[int]:
        """Positions of similarity `least` or more; the beam widens while its worst still qualifies."""
        at = [self.entry]
        for k in range(int(self.levels[self.entry]), 0, -1):
            at = [self.search(q, at, 1, k)[0][1]]
        if own is not None:
            at.append(own)
        while True:
            found = self.search(q, at, beam, 0)
            if len(found) < beam or found[-1][0] < least or beam >= len(self.x):
                return [j for s, j in found if s >= least]
            beam *= 2

    def pack(self) -> bytes:
        """Levels, entry and link lists as numbers."""
        parts = [np.array([self.entry, len(self.links)], np.int32), self.levels.astype(np.int32)]
        for level in self.links:
            nodes = np.fromiter(level, np.int32, len(level))
            sizes = np.fromiter((len(v) for v in level.values()), np.int32, len(level))
            flat = np.fromiter((j for v in level.values() for j in v), np.int32, int(sizes.sum()))
            parts += [np.array([len(nodes), len(flat)], np.int32), nodes, sizes, flat]
        return np.concatenate(parts).tobytes()

    @classmethod
    def unpack(cls, x: np.ndarray, raw: bytes) -> Graph:
        a = np.frombuffer(raw, np.int32)
        entry, n_levels, levels, at = int(a[0]), int(a[1]), a[2 : 2 + len(x)], 2 + len(x)
        links = []
        for _ in range(n_levels):
            n, m = int(a[at]), int(a[at + 1])
            nodes, sizes, flat = np.split(a[at + 2 : at + 2 + 2 * n + m], [n, 2 * n])
            links.append({int(k): v.tolist() for k, v in zip(nodes, np.split(flat, np.cumsum(sizes)[:-1]), strict=True)} if n else {})
            at += 2 + 2 * n + m
        return cls(x, levels, links, entry)


def _lookups(graph: Graph, queries: np.ndarray, least: float, beam: int, same: bool) -> list[np.ndarray]:
    return [np.array(graph.within(q, least, beam, i if same else None), np.int64) for i, q in enumerate(queries)]


def _true_links(q: np.ndarray, x: np.ndarray, least: float) -> np.ndarray:
    """Pairs of positions whose cosine in double precision is `least` or more, by blocks."""
    cos = (q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None, :]
    return np.argwhere(cos >= least)


def link_shards(a: np.ndarray, b: np.ndarray, graph: Graph, same: bool, least: float = COSINE, beam: int = BEAM) -> tuple[np.ndarray, float]:
    """Verified links (i in a, j in b; once each, i < j in one shard), and the audited recall of the look-ups."""
    unit = (a / np.linalg.norm(a, axis=1, keepdims=True)).astype(np.float32)
    probes = _probes(b, least)
    known = {(int(i), int(j)) for i, j in _true_links(probes, b, least)}
    sample = np.sort(np.random.default_rng(1).permutation(len(a))[:AUDIT])
    truth = {(int(sample[i]), int(j)) for i, j in _true_links(a[sample], b, least) if not (same and sample[i] == j)}
    norm_a, norm_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    while True:
        found = _lookups(graph, unit, least - 1e-4, beam, same)
        i = np.repeat(np.arange(len(a)), [len(f) for f in found])
        j = np.concatenate(found) if found else np.zeros(0, np.int64)
        good = np.zeros(len(i), bool)
        for at in range(0, len(i), 1 << 16):
            p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            good[at : at + (1 << 16)] = np.einsum("ij,ij->i", a[p], b[q]) / norm_a[p] / norm_b[q] >= least
        i, j = i[good], j[good]
        if same:
            i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
        pairs = np.unique(i * len(b) + j)
        i, j = pairs // len(b), pairs % len(b)
        hit = set(zip(i.tolist(), j.tolist(), strict=True))
        seen = {(p, int(q)) for p, f in enumerate(_lookups(graph, probes.astype(np.float32), least - 1e-4, beam, False)) for q in f}
        hits = sum((p in hit) or (same and p[::-1] in hit) for p in truth) + len(known & seen)
        recall = hits / (len(truth) + len(known)) if truth or known else 1.0
        if recall >= RECALL:
            return np.column_stack([i, j]), recall
        if beam >= len(b):
            return _all_links(a, b, same, least), 1.0
        beam *= 2


def _probes(b: np.ndarray, least: float) -> np.ndarray:
    """Unit vectors close enough to some of b to be linked with them: look-ups whose answer is known to exist, however
    few true links a pair of shards has."""
    draw = np.random.default_rng(2)
    near = b[np.sort(draw.permutation(len(b))[:PROBES])]
    near = near / np.linalg.norm(near, axis=1, keepdims=True)
    aside = draw.normal(size=near.shape)
    aside -= (aside * near).sum(axis=1, keepdims=True) * near
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
    cos = (1 + least) / 2
    return cos * near + np.sqrt(1 - cos * cos) * aside


def _all_links(a: np.ndarray, b: np.ndarray, same: bool, least: float) -> np.ndarray:
    """The links of two shards by comparing all their vectors in blocks, where the graph can't find enough of them."""
    parts = []
    for at in range(0, len(a), 1024):
        found = _true_links(a[at : at + 1024], b, least) + [at, 0]
        parts.append(found[found[:, 0] < found[:, 1]] if same else found)
    return np.concatenate(parts)


def _build(t: pa.Table) -> pa.Table:
    t = t.combine_chunks()
    x = np.asarray(t["embedding"].combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)
    graph = Graph.build((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32))
    return pa.table({
        "label": t["label"][:1], "dim": t["dim"][:1], "shard": t["shard"][:1], "uid": [np.asarray(t["uid"]).tobytes()],
        "vec_id": [np.asarray(t["vec_id"]).tobytes()], "x": [x.tobytes()], "graph": [graph.pack()],
    })


def _pair(t: pa.Table) -> pa.Table:
    r = t.to_pylist()[0]
    same = r["shard"] == r["shard_b"]
    uid_a, id_a, uid_b, id_b = (np.frombuffer(r[c], np.int64) for c in ("uid", "vec_id", "uid_b", "vec_id_b"))
    a, b = np.frombuffer(r["x"]).reshape(len(uid_a), -1), np.frombuffer(r["x_b"]).reshape(len(uid_b), -1)
    graph = Graph.unpack((b / np.linalg.norm(b, axis=1, keepdims=True)).astype(np.float32), r["graph_b"])
    links, recall = link_shards(a, b, graph, same)
    i, j = links[:, 0], links[:, 1] + (0 if same else len(a))
    uid, ids = (uid_a, id_a) if same else (np.append(uid_a, uid_b), np.append(id_a, id_b))
    forest = Forest(len(uid))
    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        forest.join(p, q)
    n = np.bincount(np.append(i, j), minlength=len(uid))
    some = np.flatnonzero(n)
    root = np.array([forest.root(p) for p in some.tolist()], np.int64)
    return pa.table({"uid": uid[some], "n": n[some], "a": ids[some], "b": ids[root], "recall": np.full(len(some), recall)})


def link_vectors(vectors: DataFrame, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """All rows as a table with `uid`, and uid, n (links), a, b (an edge of a forest), recall for rows with links."""
    kept = stored(vectors.select("vec_id", "embedding", "label").withColumn("uid", F.monotonically_increasing_id()), "embeddings")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = kept.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    valid = valid.filter(~bad & F.exists("embedding", lambda x: x != 0)).withColumn("dim", F.size("embedding"))
    parts = valid.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / shard).alias("parts"))
    dealt = valid.join(parts, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))
    fields = f"label {vectors.schema['label'].dataType.simpleString()}, dim int, shard int, uid binary, vec_id binary, x binary, graph binary"
    shards = stored(dealt.select("label", "dim", "shard", "uid", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")).groupBy("label", "dim", "shard").applyInArrow(_build, fields), "graphs")
    other = shards.select("label", "dim", *[F.col(c).alias(f"{c}_b") for c in ("shard", "uid", "vec_id", "x", "graph")])
    # Pairs of shards are listed by number first; the shards follow to where their pair was dealt, so that the pairs of
    # one label are many tasks' work.
    numbers = shards.select("label", "dim", "shard")
    pairs = numbers.join(numbers.withColumnRenamed("shard", "shard_b"), ["label", "dim"]).filter("shard <= shard_b")
    pairs = pairs.join(shards.drop("graph"), ["label", "dim", "shard"]).join(other, ["label", "dim", "shard_b"])
    pairs = pairs.repartition("label", "dim", "shard", "shard_b")
    found = pairs.groupBy("label", "dim", "shard", "shard_b").applyInArrow(_pair, "uid long, n long, a long, b long, recall double")
    return kept, stored(found, "links")


def near_duplicates(vectors: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable by
    links) and kept (whether it is that one).

    Only vectors of equal, non-null label and equal length are compared. Vectors that are null, zero, or hold a null
    or non-finite component, and rows without vec_id, link with nothing. Rows that repeat a vec_id are vectors of
    their own that share a component.
    """
    kept, links = link_vectors(vectors, shard)
    counts = links.groupBy("uid").agg(F.sum("n").alias("n"))
    comp = components(links.select("a", "b"))
    # An id whose only links are to rows of the same id has no edge, and so itself as component.
    out = kept.select("uid", "vec_id").join(counts, "uid", "left").join(comp.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT *, sqrt(list_inner_product(e, e)) AS n FROM e WHERE list_inner_product(e, e) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / a.n / b.n >= 0.98),
r AS (SELECT DISTINCT x AS v, x AS m FROM l UNION SELECT l.y, r.m FROM r JOIN l ON l.x = r.v),
c AS (SELECT v, min(m) AS m FROM r GROUP BY v), k AS (SELECT x, count(*) AS k FROM l GROUP BY x)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, coalesce(m, vec_id) AS component_id, coalesce(m, vec_id) IS NOT DISTINCT FROM vec_id AS kept
FROM embeddings LEFT JOIN c ON c.v = vec_id LEFT JOIN k ON k.x = vec_id
"""
