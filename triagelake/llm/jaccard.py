"""Operator 1. N-gram Jaccard join by MinHash banding.

Each text is the set of its five-word shingles. A MinHash signature is cut into bands; texts that agree in a whole
band meet in a shuffle on band hashes. Rows per band and number of bands follow from the wanted recall at the
threshold. Texts of equal words are one class from the start, so copies are neither hashed against each other nor
listed as pairs. Meeting texts form candidate groups; the members of a group are verified against each other on
their full shingle sets, large groups in pairs of blocks, and every text's links are counted where they are found. Only
the counts and a forest of links leave a task, never the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.graph import Forest, components
from triagelake.llm.shared import quoted, stored, table, text_key
from triagelake.llm.textcore import byte_hash, list_of, mix, ngrams, released, slices, span_hash, utf8, words

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9995
#: Hash functions at most; the longest bands that reach the recall within them are taken.
HASHES = 192
#: Texts of a candidate group that are compared in one task; larger groups are compared block by block.
BLOCK = 2048


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """Bands and rows per band: the most selective that find a pair at the threshold with the wanted probability."""
    best = None
    for rows in range(1, hashes + 1):
        miss = math.log1p(-(threshold**rows))
        bands = math.ceil(math.log(1 - recall) / miss) if miss < 0 else hashes + 1
        if bands * rows <= hashes:
            best = bands, rows
    if best is None:
        raise ValueError("the recall can't be reached with so few hashes")
    return best


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a slice and their rows, sorted by row; a text shorter than n words is one shingle."""
    starts, ends, rows = words(data, offsets)
    h = byte_hash(data, starts, ends)
    grams, at = ngrams(h, rows, n)
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    short = np.flatnonzero((counts > 0) & (counts < n))
    own = rows[at]
    if len(short):
        first = np.searchsorted(rows, short)
        grams = np.append(grams, span_hash(h, first, first + counts[short]))
        own = np.append(own, short)
        order = np.argsort(own, kind="stable")
        grams, own = grams[order], own[order]
    return grams, own


def signatures(grams: np.ndarray, own: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have shingles, and their band hashes (rows x bands)."""
    if not len(grams):
        return own, np.zeros((0, bands), np.uint64)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    odd = np.random.default_rng(23).integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(first), bands), np.uint64)
    for b in range(bands):
        acc = np.full(len(first), np.uint64(b + 1))
        for r in range(rows):
            acc = mix(acc ^ np.minimum.reduceat(mix_light(grams * odd[b, r]), first))
        out[:, b] = acc
    return own[first], out


def mix_light(h: np.ndarray) -> np.ndarray:
    """Brings high bits down, so that a product with an odd number orders values anew."""
    return h ^ (h >> np.uint64(29))


def _signed(batches: Iterator[pa.RecordBatch], bands: int, rows: int, n: int) -> Iterator[pa.RecordBatch]:
    """Rows with words: doc_id, text_key, digest of the words, band hashes."""
    for batch in released(batches):
        data, offsets, _ = utf8(batch.column("text"))
        raw = data.tobytes()
        for i, j in slices(offsets):
            part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            at, found = signatures(*shingles(part, own, n), bands, rows)
            rows_ = (at + i).tolist()
            digests = [hashlib.blake2b(b" ".join(raw[offsets[k] : offsets[k + 1]].split()), digest_size=16).digest() for k in rows_]
            take = pa.array(rows_, pa.int64())
            listed = list_of(found.ravel().view(np.int64), np.arange(len(at) + 1) * bands, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("text_key").take(take), pa.array(digests, pa.binary()), listed], ["doc_id", "text_key", "digest", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Shingle sets of nodes, each node once per task."""
    seen: set[int] = set()
    for batch in released(batches):
        nodes = batch.column("node").to_pylist()
        fresh = [k for k, node in enumerate(nodes) if node not in seen and not seen.add(node)]
        batch = batch.take(pa.array(fresh, pa.int64()))
        data, offsets, _ = utf8(batch.column("text"))
        for i, j in slices(offsets):
            grams, own = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
            order = np.lexsort((grams, own))
            grams, own = grams[order], own[order]
            keep = np.concatenate([[True], (grams[1:] != grams[:-1]) | (own[1:] != own[:-1])]) if len(own) else np.zeros(0, bool)
            grams, own = grams[keep], own[keep]
            part = batch.slice(i, j - i)
            listed = list_of(grams.view(np.int64), np.searchsorted(own, np.arange(j - i + 1)), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("group"), part.column("node"), part.column("size"), part.column("blocks"), listed], ["group", "node", "size", "blocks", "shingles"])


def verify(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each position in `left` the positions in `right` behind it (or all, if the two differ) with J >= threshold.

    Intersections are counted over lists of the sets that hold a shingle, one set of `left` at a time.
    """
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate([sets[k] for k in right])
    owner = np.repeat(np.arange(len(right)), sizes[right])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    same = left is right
    for p, k in enumerate(left.tolist()):
        lo, hi = np.searchsorted(flat, sets[k], "left"), np.searchsorted(flat, sets[k], "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(right))
        union = sizes[k] + sizes[right] - common
        good = (common > 0) & (common / np.maximum(union, 1) >= threshold)
        if same:
            good[: p + 1] = False
        if good.any():
            yield k, right[np.flatnonzero(good)]


def _compare(t: pa.Table, threshold: float) -> pa.Table:
    """The links of one unit: two blocks of a group, or one block with itself."""
    t = t.combine_chunks()
    _, first = np.unique(np.asarray(t["node"]), return_index=True)
    t = t.take(pa.array(first))
    nodes, size, block = np.asarray(t["node"]), np.asarray(t["size"]), np.asarray(t["block"])
    col = t["shingles"].combine_chunks()
    ends = np.concatenate([[0], np.cumsum(np.asarray(col.value_lengths()))])
    flat = np.asarray(col.flatten())
    sets = [flat[ends[k] : ends[k + 1]] for k in range(len(nodes))]
    a, b = t["i"][0].as_py(), t["j"][0].as_py()
    left = np.flatnonzero(block == a)
    right = left if a == b else np.flatnonzero(block == b)
    n, links = np.zeros(len(nodes), np.int64), Forest(len(nodes))
    if len(left) and len(right):
        for k, found in verify(sets, left, right, threshold):
            n[k] += size[found].sum()
            n[found] += size[k]
            for other in found.tolist():
                links.join(k, other)
    some = np.flatnonzero(n)
    return pa.table({"node": nodes[some], "n": n[some], "root": nodes[[links.root(k) for k in some.tolist()]] if len(some) else nodes[:0]})


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = WORDS, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, text_key, class_id (smallest id with the same words), n_links (other documents with a
    Jaccard similarity of at least `threshold`, those of its class included), component_id (smallest id reachable by
    links) and kept (whether it is that one).

    Words are parted by ASCII white space and taken as they are; a text of fewer than n words is a single shingle.
    Texts that are null or have no word, and rows without doc_id, link with nothing and are kept. Rows that repeat an
    id are documents of their own with one id. A pair at the threshold is found with probability `recall` at least, a
    more similar one with a higher one; what is found is verified on full sets. Other columns are not looked at.
    """
    bands, rows = choose_bands(threshold, recall)
    texts = docs.select("doc_id", text_key().alias("text_key"), "text")
    named = texts.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    signed = named.mapInArrow(lambda b: _signed(b, bands, rows, n), "doc_id long, text_key long, digest binary, bands array<long>")
    signed = stored(signed.withColumn("uid", F.monotonically_increasing_id()), "signatures")
    classes = signed.groupBy("digest").agg(F.min(F.struct("doc_id", "uid", "text_key")).alias("first"), F.count(F.lit(1)).alias("size"))
    classes = stored(classes.select("digest", F.col("first.uid").alias("node"), F.col("first.doc_id").alias("class_id"), F.col("first.text_key").alias("text_key"), "size"), "classes")

    # Buckets: every member points to the smallest of its bucket. A hot bucket is summed before it is exchanged.
    member = signed.select("uid", "bands").join(classes.select(F.col("node").alias("uid")), "uid", "left_semi")
    in_band = member.select("uid", F.explode("bands").alias("band"))
    leaders = in_band.groupBy("band").agg(F.min("uid").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    meet = in_band.join(leaders, "band").filter("uid <> leader").select(F.col("uid").alias("a"), F.col("leader").alias("b"))
    groups = components(meet).withColumnRenamed("component", "group")
    blocks = groups.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))

    # Verification on full sets. Block i of a group meets every block j >= i in a unit of its own.
    wanted = groups.join(blocks, "group").join(classes, "node").select("group", "node", "size", "blocks", F.col("class_id").alias("doc_id"), "text_key")
    sets = wanted.join(texts, ["doc_id", "text_key"]).select("group", "node", "size", "blocks", "text").mapInArrow(lambda b: _sets(b, n), "group long, node long, size long, blocks int, shingles array<long>")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    unit = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j"))))
    units = sets.withColumn("block", own).select("group", "node", "size", "block", "shingles", unit.alias("u")).select("group", "u.i", "u.j", "node", "size", "block", "shingles")
    found = stored(units.groupBy("group", "i", "j").applyInArrow(lambda t: _compare(t, threshold), "node long, n long, root long"), "links")

    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    comp = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    ids = comp.join(classes.select("node", "class_id"), "node").groupBy("component").agg(F.min("class_id").alias("component_id"))
    per_class = classes.join(counts, "node", "left").join(comp, "node", "left").join(ids, "component", "left")
    per_class = per_class.select("digest", "class_id", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component_id", "class_id").alias("component_id"))
    linked = signed.select("doc_id", "text_key", "digest").join(per_class, "digest").select("doc_id", "text_key", "class_id", "n_links", "component_id")
    wordless = F.col("doc_id").isNull() | F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    alone = docs.select("doc_id", "text").filter(wordless).select("doc_id", text_key().alias("text_key"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """The rows without near duplicates: of each component the document with the smallest id stays, with all columns,
    and of rows that repeat an id and text one. Rows without words or without an id stay."""
    linked = stored(jaccard_join(docs, **settings).select("doc_id", "text_key", "kept"), "kept")
    keys = linked.filter(F.col("doc_id").isNotNull()).groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"), F.bool_and("kept").alias("kept"))
    again = stored(keys.filter("n > 1 and kept").select("doc_id", "text_key"), "repeated")
    go = keys.filter("n > 1 or not kept").select("doc_id", "text_key")
    rows = docs.select("doc_id", text_key().alias("text_key"), F.struct(*quoted(docs)).alias("_row"))
    left = rows.join(go, ["doc_id", "text_key"], "left_anti").select("_row.*")
    if again.isEmpty():
        return left
    once = rows.join(again, ["doc_id", "text_key"], "left_semi").groupBy("doc_id", "text_key").agg(F.first("_row").alias("_row")).select("_row.*")
    return left.union(once)


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("text_key")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w WHERE len(ws) > 0),
d AS (SELECT DISTINCT doc_id, s FROM g), n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM d a JOIN d b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE k / (nx.n + ny.n - k)::DOUBLE >= 0.8),
r AS (SELECT DISTINCT x AS v, x AS m FROM l UNION SELECT l.y, r.m FROM r JOIN l ON l.x = r.v),
comp AS (SELECT v, min(m) AS m FROM r GROUP BY v),
cls AS (SELECT array_to_string(ws, ' ') AS t, min(doc_id) AS class_id FROM w WHERE len(ws) > 0 GROUP BY t)
SELECT w.doc_id, coalesce(class_id, w.doc_id) AS class_id, (SELECT count(*) FROM l WHERE l.x = w.doc_id) AS n_links,
       coalesce(comp.m, w.doc_id) AS component_id, coalesce(comp.m, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN cls ON array_to_string(ws, ' ') = t LEFT JOIN comp ON comp.v = w.doc_id
"""
