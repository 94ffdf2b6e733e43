"""Contents of files by byte ranges, so that no file has to fit into a row.

A table of files names each content by an address (`uri`: a path, or an address that Arrow's file systems open, such as
hdfs:// or s3://). Tasks open the files themselves: samples read only the head, the middle and the tail, and digests
read a file once, a piece at a time. Files are dealt out by a hash of their address, so that the large ones of one
folder don't meet in a task. A file that can't be opened gives a row with the error and no values.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that a task holds of a file it digests.
PIECE = 1 << 20


def open_file(uri: str):
    """A seekable Arrow file."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))
    return system.open_input_file(path)


def ranges(size: int, window: int) -> list[tuple[int, int]]:
    """Offset and length of the head, and of contents over two windows also of the middle and the tail."""
    if size <= 2 * window:
        return [(0, min(size, window))]
    return [(0, window), (size // 2 - window // 2, window), (size - window, window)]


def entropy(block: bytes) -> float:
    """Bits per byte; an empty block is 0."""
    if not block:
        return 0.0
    p = np.bincount(np.frombuffer(block, np.uint8), minlength=256) / len(block)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum()) + 0.0


def sampled(uri: str, window: int, least: int) -> dict:
    """Size and the highest entropy of the sampled windows of at least `least` bytes (null if there is none)."""
    with open_file(uri) as f:
        size = f.size()
        blocks = [f.read_at(n, at) for at, n in ranges(size, window)]
    found = [entropy(b) for b in blocks if len(b) >= least]
    return {"size": size, "h": max(found, default=None)}


def digested(uri: str, algorithms: tuple[str, ...]) -> dict:
    """Size and digests (lower-case hex) of a file, read once."""
    sums, size = [hashlib.new(a) for a in algorithms], 0
    with open_file(uri) as f:
        while piece := f.read_buffer(PIECE):
            size += len(piece)
            for s in sums:
                s.update(piece)
    return {"size": size, **{a: s.hexdigest() for a, s in zip(algorithms, sums, strict=True)}}


def _each_file(files: DataFrame, keys: list[str], uri: str, measure, fields: list[T.StructField]) -> DataFrame:
    rows = files.select(*keys, F.col(uri).alias("_uri")).repartition(F.xxhash64("_uri"))
    out = T.StructType([*[T.StructField(k, rows.schema[k].dataType) for k in keys], *fields, T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, address in enumerate(batch.column("_uri").to_pylist()):
                try:
                    found = {**measure(address), "error": None} if address is not None else {"error": "no address"}
                except (OSError, ValueError) as e:
                    found = {"error": f"{type(e).__name__}: {e}"[:300]}
                own = [batch.column(k).slice(i, 1) for k in keys]
                new = [pa.array([found.get(f.name)], pa.string() if f.dataType == T.StringType() else pa.int64() if f.dataType == T.LongType() else pa.float64()) for f in (*fields, out["error"])]
                yield pa.RecordBatch.from_arrays([*own, *new], out.names)

    return rows.mapInArrow(run, out)


def sampled_entropy(files: DataFrame, keys: list[str], uri: str = "uri", window: int = 64 * 1024, least: int = 512) -> DataFrame:
    """Keys, size, h (highest entropy of head, middle and tail) and error of each file."""
    return _each_file(files, keys, uri, lambda u: sampled(u, window, least), [T.StructField("size", T.LongType()), T.StructField("h", T.DoubleType())])


def digests(files: DataFrame, keys: list[str], uri: str = "uri", algorithms: tuple[str, ...] = ("md5", "sha1", "sha256")) -> DataFrame:
    """Keys, size, a column for each algorithm, and error of each file."""
    return _each_file(files, keys, uri, lambda u: digested(u, algorithms), [T.StructField("size", T.LongType()), *[T.StructField(a, T.StringType()) for a in algorithms]])
