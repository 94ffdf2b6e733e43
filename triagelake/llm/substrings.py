"""Operator 5. Removal of repeated passages behind a count-min prefilter.

A window is `size` consecutive words of one document. Every window belongs to an anchor: the smallest hash among the
`anchor`-word n-grams inside it, so equal windows have equal anchors and neighbouring windows mostly share theirs.

Pass one counts, for each anchor, the documents that hold it: each task fills a sketch of its partition, the sketches
are merged cell by cell, and a bit per cell says whether a count of two was reached. A sketch only overestimates.
Pass two scans the documents again and lets through only windows whose anchor may stand in two documents; those are
grouped exactly by anchor and window hash (128 bits together), and windows that also start in a document with a
smaller id are marked. A window that does repeat has a repeated anchor, so none is lost; a sketch too small for the
corpus only lets more through. Only equal windows need to meet: where an anchor has more windows than a bound, as round
a passage that many documents share, its windows are dealt out one by one, by anchor and hash. The sketch has a fixed bound of memory; it and the list of those anchors, at most one for each HOT_WINDOWS windows, are all that is
sent to every task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.shared import table, text_key
from triagelake.llm.textcore import byte_hash, list_of, ngrams, slices, utf8, words

SIZE, ANCHOR = 50, 25
#: Cells per row of the sketch (a power of two) and rows. Merged, it is CELLS / 8 bytes a row: 16 MB in all.
CELLS, ROWS = 1 << 26, 2
#: A partition's sketch is sent in pieces of so many cells.
PIECE = 1 << 16
#: Rows that a grouping task works on at once; the rows of one anchor stay together.
GROUP_WINDOWS = 1 << 19
#: Windows of one anchor that may meet in one task; those of an anchor with more are dealt out by their hashes.
HOT_WINDOWS = 1 << 16


def _cells(anchors: np.ndarray, cells: int) -> np.ndarray:
    """Cell of each anchor in every row of the sketch, one row behind the other."""
    return np.concatenate([(anchors >> np.uint64(32 * r)).astype(np.int64) % cells + r * cells for r in range(ROWS)])


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every `width` consecutive values, by doubling."""
    out, done = h, 1
    while done < width:
        step = min(done, width - done)
        out, done = np.minimum(out[:-step], out[step:]), done + step
    return out


def windows(data: np.ndarray, offsets: np.ndarray, size: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Row, word position in its row, hash and anchor of every window of a slice."""
    starts, ends, rows = words(data, offsets)
    h = byte_hash(data, starts, ends)
    hashes, at = ngrams(h, rows, size)
    if not len(at):
        return rows[:0], at, hashes, hashes
    grams, gram_at = ngrams(h, rows, anchor)
    full = np.full(len(h), np.uint64(0xFFFFFFFFFFFFFFFF))
    full[gram_at] = grams
    least = _least(full, size - anchor + 1)[at]
    first = np.searchsorted(rows, np.arange(len(offsets) - 1))
    return rows[at], at - first[rows[at]], hashes, least


def _partial(batches: Iterator[pa.RecordBatch], size: int, anchor: int, width: int) -> Iterator[pa.RecordBatch]:
    """The sketch of a partition: for each touched piece its cells with counts up to two, compressed."""
    sketch = np.zeros(ROWS * width, np.uint8)
    for batch in batches:
        data, offsets, _ = utf8(batch.column("text"))
        for i, j in slices(offsets):
            rows, _, _, anchors = windows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size, anchor)
            if len(rows):
                # Runs of one anchor in a document count once; a second run of it only raises the estimate.
                new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (anchors[1:] != anchors[:-1])])
                cells, n = np.unique(_cells(anchors[new], width), return_counts=True)
                sketch[cells] = np.minimum(2, sketch[cells] + np.minimum(n, 2))
    for p in np.flatnonzero(sketch.reshape(-1, PIECE).any(axis=1)).tolist():
        cells = np.flatnonzero(sketch[p * PIECE : (p + 1) * PIECE]).astype(np.uint16)
        body = cells.tobytes() + np.packbits(sketch[p * PIECE + cells.astype(np.int64)] > 1).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([len(cells)], pa.int32()), pa.array([body], pa.binary())], ["piece", "n", "body"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the sketches of all partitions piece by piece; the rows come sorted by piece."""
    now, cells = None, np.zeros(PIECE, np.uint8)

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(np.packbits(cells > 1).tobytes(), 1)], pa.binary())], ["piece", "bits"])

    for batch in batches:
        for p, n, body in zip(batch.column("piece").to_pylist(), batch.column("n").to_pylist(), batch.column("body").to_pylist(), strict=True):
            if p != now:
                if now is not None:
                    yield done()
                now, cells[:] = p, 0
            at = np.frombuffer(body, np.uint16, n)
            two = np.unpackbits(np.frombuffer(body, np.uint8, offset=2 * n), count=n)
            cells[at] = np.minimum(2, cells[at] + 1 + two)
    if now is not None:
        yield done()


def repeated_cells(docs: DataFrame, size: int, anchor: int, cells: int) -> np.ndarray:
    """Bits of the merged sketch: whether a cell reached a count of two. ROWS * cells / 8 bytes on the driver."""
    partial = docs.select("text").mapInArrow(lambda b: _partial(b, size, anchor, cells), "piece int, n int, body binary")
    merged = partial.repartition("piece").sortWithinPartitions("piece").mapInArrow(_merge, "piece int, bits binary")
    bits = np.zeros(ROWS * cells // 8, np.uint8)
    for row in merged.toLocalIterator():
        bits[row["piece"] * (PIECE // 8) : (row["piece"] + 1) * (PIECE // 8)] = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return bits


def _maybe(anchors: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether every row of the sketch says two or more."""
    cells = _cells(anchors, len(bits) * 8 // ROWS).reshape(ROWS, -1)
    return np.logical_and.reduce([(bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 for c in cells]).astype(bool)


def _stretches(rows: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and past-the-end word of the union of windows; (row, at) sorted."""
    if not len(rows):
        return rows, at, at
    new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (at[1:] > at[:-1] + size)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows)) - 1
    return rows[first], at[first], at[last] + size


_ODD = np.uint64(0x9E3779B97F4A7C15)
_OPEN = "anchor long, doc_id long, text_key long, at array<int>, hashes array<long>"


def _batch(anchor, doc, key, at, hashes, ends) -> pa.RecordBatch:
    columns = [pa.array(anchor, pa.int64()), pa.array(doc, pa.int64()), pa.array(key, pa.int64()), list_of(at, ends, pa.int32()), list_of(hashes, ends, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["anchor", "doc_id", "text_key", "at", "hashes"])


def _candidates(batches: Iterator[pa.RecordBatch], bits: np.ndarray, hot: np.ndarray, size: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Windows to group, one row for each run of an anchor in a document.

    A window that has stood in a smaller document of the same slice is known to repeat and needs no grouping: it
    comes out with the hashes left empty and `at` a pair of first and past-the-end word. Only the first of equal
    windows in a slice is grouped, so a passage that a third of all documents share sends a few rows per slice. A
    window of a hot anchor is a row of its own, under a key of anchor and hash.
    """
    for batch in batches:
        data, offsets, _ = utf8(batch.column("text"))
        ids, keys = np.asarray(batch.column("doc_id")), np.asarray(batch.column("text_key"))
        for i, j in slices(offsets, 1 << 23):
            parts = []
            for a, b in slices(offsets[i : j + 1]):
                rows, at, hashes, anchors = windows(data[offsets[i + a] : offsets[i + b]], offsets[i + a : i + b + 1] - offsets[i + a], size, anchor)
                keep = _maybe(anchors, bits)
                parts.append((rows[keep] + i + a, at[keep], hashes[keep], anchors[keep]))
            rows, at, hashes, anchors = (np.concatenate(x) for x in zip(*parts, strict=True))
            if not len(rows):
                continue
            docs_, keys_ = ids[rows], keys[rows]
            order = np.lexsort((docs_, hashes, anchors))
            a, h, d = anchors[order], hashes[order], docs_[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (h[1:] != h[:-1])])
            least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
            known = np.zeros(len(rows), bool)
            known[order] = d > least
            if known.any():
                r, first, past = _stretches(rows[known], at[known], size)
                ends = np.arange(0, 2 * len(r) + 1, 2)
                pairs = list_of(np.column_stack([first, past]).ravel(), ends, pa.int32())
                none = list_of(np.zeros(0, np.int64), np.zeros(len(r) + 1), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(ids[r]), pa.array(keys[r]), pairs, none], ["anchor", "doc_id", "text_key", "at", "hashes"])
            # Of equal windows in one document the others are marked with the first, so it stands for the document.
            open_ = ~known
            rows, at, hashes, anchors = rows[open_], at[open_], hashes[open_], anchors[open_]
            if len(rows):
                # Keys and hashes still tell anchors and hashes apart, since a hash turns each anchor into another key.
                anchors = np.where(np.isin(anchors, hot), anchors ^ (hashes * _ODD), anchors)
                new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (anchors[1:] != anchors[:-1])])
                ends = np.append(np.flatnonzero(new), len(rows))
                yield _batch(anchors[new].view(np.int64), ids[rows[new]], keys[rows[new]], at, hashes.view(np.int64), ends)


def _marked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Stretches of words to remove; the rows come sorted by anchor, and those of one anchor are looked at together."""
    names = ["doc_id", "text_key", "first", "past"]

    def group(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        at_list, hash_list = t["at"].combine_chunks(), t["hashes"].combine_chunks()
        n = np.asarray(hash_list.value_lengths())
        docs, keys, anchors = (np.asarray(t[c]) for c in ("doc_id", "text_key", "anchor"))
        done = n == 0
        pairs = np.asarray(at_list.filter(pa.array(done)).flatten()).reshape(-1, 2)
        at = np.asarray(at_list.filter(pa.array(~done)).flatten()).astype(np.int64)
        hashes = np.asarray(hash_list.flatten())
        row = np.repeat(np.arange(len(n)), n)
        d, a = docs[row], anchors[row]
        order = np.lexsort((d, hashes, a))
        new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])]) if len(order) else np.zeros(0, bool)
        least = d[order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else d
        again = np.zeros(len(row), bool)
        again[order] = d[order] > least
        r, first, past = _stretches(row[again], at[again], size)
        columns = [np.concatenate(x) for x in ((docs[done], docs[r]), (keys[done], keys[r]), (pairs[:, 0], first), (pairs[:, 1], past))]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names)

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += len(batch) + len(batch.column("hashes").flatten())
        if n >= GROUP_WINDOWS:
            t = pa.Table.from_batches(held)
            a = np.asarray(t["anchor"])
            whole = int(np.searchsorted(a, a[-1]))  # the last anchor may go on in the next batch
            if whole:
                yield group(t.slice(0, whole))
                held = t.slice(whole).combine_chunks().to_batches()
                n = sum(len(b) + len(b.column("hashes").flatten()) for b in held)
    if held:
        yield group(pa.Table.from_batches(held))


def candidates(docs: DataFrame, size: int, anchor: int, cells: int, hot_windows: int) -> DataFrame:
    """The windows to group, by the key under which equal ones meet; docs have doc_id, text and text_key."""
    sc = docs.sparkSession.sparkContext
    bits = sc.broadcast(repeated_cells(docs, size, anchor, cells))

    def rows(hot) -> DataFrame:
        return docs.mapInArrow(lambda b: _candidates(b, bits.value, hot.value, size, anchor), _OPEN)

    counted = rows(sc.broadcast(np.zeros(0, np.uint64))).select("anchor", F.size("hashes").alias("n")).filter("n > 0").groupBy("anchor").agg(F.sum("n").alias("n"))
    hot = counted.filter(F.col("n") > hot_windows).select("anchor").toArrow()
    return rows(sc.broadcast(np.sort(np.asarray(hot["anchor"]).astype(np.int64).view(np.uint64))))


def repeated_stretches(docs: DataFrame, size: int = SIZE, anchor: int = ANCHOR, cells: int = CELLS, hot_windows: int = HOT_WINDOWS) -> DataFrame:
    """doc_id, text_key and `stretches`: sorted (first, past) word positions covered by windows that also start in a
    document with a smaller id. Only documents with such windows; those with a null id or text take no part."""
    docs = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", text_key().alias("text_key"))
    open_ = candidates(docs, size, anchor, cells, hot_windows)
    marked = open_.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda b: _marked(b, size), "doc_id long, text_key long, first long, past long")
    return marked.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("first", "past"))).alias("stretches"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        stretches = batch.column("stretches").to_pylist()
        for text, drop in zip(batch.column("text").cast(pa.binary()).to_pylist(), stretches, strict=True):
            all_ = text.split() if text else []  # bytes.split parts at \x20 and \x09-\x0D
            left, at = [], 0
            for s in drop or ():
                left += all_[at : s["first"]]
                at = max(at, s["past"])
            left += all_[at:]
            n_words.append(len(all_))
            n_removed.append(len(all_) - len(left))
            kept.append(b" ".join(left).decode())
        keep = [c for c in batch.schema.names if c != "stretches"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], [*keep, "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, size: int = SIZE, anchor: int = ANCHOR, cells: int = CELLS, hot_windows: int = HOT_WINDOWS) -> DataFrame:
    """Every row's doc_id and text with n_words, n_removed and `kept`, the words left, joined by one space.

    The document with the smallest id keeps a passage. Texts that are null, empty or shorter than a window lose
    nothing, and a row without doc_id neither loses words nor makes others lose them. Rows that repeat with the same
    id and text have one result. Windows are judged on the input. Other columns are not looked at.
    """
    rows = docs.select("doc_id", "text", text_key().alias("text_key"))
    joined = rows.join(repeated_stretches(docs, size, anchor, cells, hot_windows), ["doc_id", "text_key"], "left").select("doc_id", "text", "stretches")
    return joined.mapInArrow(_cut, "doc_id long, text string, n_words long, n_removed long, kept string")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM w, unnest(range(1, len(words) - 48)) AS t(i) WHERE len(words) >= 50),
firsts AS (SELECT h, min(doc_id) AS least FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN firsts USING (h), unnest(range(50)) AS u(k) WHERE doc_id > least),
drops AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(words, lambda x, i: ps IS NULL OR NOT list_contains(ps, i)), ' ')) AS kept_sha256
FROM w LEFT JOIN drops USING (doc_id)
"""
