"""Which of many strings occur in which of many texts, as an equi-join.

Every needle is represented by one of its pieces of at most eight bytes, the one rarest among the needles. A text can
only hold the needle when it holds that piece, so pieces are joined by equality and only the candidates are checked in
full. There is no rows x needles comparison. So that a text does not send all of its pieces to the join, those whose
hash no needle has are left out where the text is read, by a table of bits of fixed size; more needles only let more
pieces through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

GRAM = 8
#: Bits for each width of piece: at most GRAM * BITS distinct places come to the driver, a byte each goes to the tasks.
BITS = 1 << 18
#: Bytes of text looked at together.
SLICE = 1 << 21


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    col = col.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every piece of so many bytes that lies in one row, and its row."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    packed = np.full(n, np.uint64(width))
    for i in range(width):
        packed = (packed << np.uint64(8) | packed >> np.uint64(56)) ^ data[i : i + n]
    h = (packed ^ np.uint64(width << 40)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = row[:n] == row[width - 1 :]
    return h[whole], row[:n][whole]


def _lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.concatenate([[True], (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])]) if len(rows) else np.zeros(0, bool)
    values, rows = values[new], rows[new]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), pa.array(values.view(np.int64), pa.int64()))


def seeds(needles: DataFrame) -> DataFrame:
    """One piece per needle: (needle, width, gram)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes(batch.column("needle"))
            width = np.minimum(np.diff(offsets), GRAM)
            found = [_hashes(data, offsets, w) for w in range(1, GRAM + 1)]
            own = [width[rows] == w for w, (_, rows) in enumerate(found, 1)]
            values = np.concatenate([h[keep] for (h, _), keep in zip(found, own, strict=True)])
            rows = np.concatenate([r[keep] for (_, r), keep in zip(found, own, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("needle"), pa.array(width, pa.int32()), _lists(values, rows, len(width))], ["needle", "width", "grams"])

    cut = needles.select("needle").distinct().mapInArrow(pieces, "needle string, width int, grams array<long>")
    grams = cut.select("needle", "width", F.explode("grams").alias("gram"))
    spread = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return grams.join(spread, "gram").groupBy("needle", "width").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))


def prepare(needles: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The pieces of the needles and the table of bits; for use with several tables of texts."""
    picked = seeds(needles.filter("needle <> ''"))
    places = picked.select("width", F.expr(f"cast(gram & {BITS - 1} as int)").alias("at")).distinct().toArrow()
    wanted = np.zeros((GRAM + 1, BITS), bool)
    wanted[np.asarray(places["width"]), np.asarray(places["at"])] = True
    return picked, wanted


def substring_pairs(rows: DataFrame, text: str, needles: DataFrame, prepared: tuple[DataFrame, np.ndarray] | None = None) -> DataFrame:
    """Every (row, needle) pair where the needle occurs in the text.

    `needles` has a column `needle`; its other columns are carried along.
    """
    picked, wanted = prepared or prepare(needles)
    widths = [w for w in range(1, GRAM + 1) if wanted[w].any()]

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes(batch.column(text))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                values, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for w in widths:
                    h, row = _hashes(part, own, w)
                    hit = wanted[w][h & np.uint64(BITS - 1)]
                    values.append(h[hit])
                    at.append(row[hit])
                grams = _lists(np.concatenate(values), np.concatenate(at), j - i)
                some = pa.array(np.asarray(grams.value_lengths()) > 0)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, grams], [*batch.schema.names, "_grams"]).filter(some)
                i = j

    schema = StructType([*rows.schema.fields, StructField("_grams", ArrayType(LongType()))])
    offered = rows.mapInArrow(marked, schema).withColumn("gram", F.explode("_grams")).drop("_grams")
    pairs = offered.join(picked.select("needle", "gram"), "gram").drop("gram").filter(F.contains(F.col(text), F.col("needle")))
    return pairs.join(needles, "needle")
