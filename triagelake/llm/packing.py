"""Operator 8. Order-preserving packing by dynamic programming.

Documents keep their input order and become one stream of tokens per input partition. Windows of at most `width`
tokens are cut at places that minimise padding plus penalties: a cut at a document's end is free, one at a
sentence's end costs a little, one inside a long sentence more. With v(j) the cost of the best cuts up to place j
plus j, the transition is v(j) = width + penalty(j) + min v(i) over the places i at most `width` tokens before j,
and a monotone queue yields that minimum in constant time.

The stream is worked off in stretches; all but the last two windows of a stretch are final, the rest opens the next
one. So a task holds one stretch, and a partition leaves at most one short window.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from triagelake.llm.shared import table
from triagelake.llm.textcore import byte_hash, released, slices, utf8
from triagelake.llm.transducer import character_classes, pretokens

WIDTH = 2048
END_ID = 1
SENTENCE_PENALTY = 8
INSIDE_PENALTY = 48
#: Longest stretch without a place to cut; longer sentences get places at this distance.
STRIDE = 64
#: Distinct pre-tokens whose ids a worker remembers before it starts anew.
MEMORY = 1_000_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Token ids of texts by the tokenizers library, which is asked once for each distinct pre-token (by a 64-bit hash)."""

    def __init__(self, path: str, classes: bytes):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.classes = np.frombuffer(zlib.decompress(classes), np.uint8)
        self.forget()

    def forget(self) -> None:
        """Known pre-tokens: their hashes in order, where each one's ids begin, how many they are, and all ids."""
        self.hashes, self.begins, self.sizes, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.hashes, hashes)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == hashes[known]
        return at, known

    def learn(self, raw: bytes, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places of pre-tokens (ascending hashes) among the known ones, after asking the library for the others."""
        at, known = self._places(hashes)
        if len(self.hashes) + np.count_nonzero(~known) > MEMORY:
            self.forget()
            at, known = self._places(hashes)
        if not known.all():
            new = np.flatnonzero(~known)
            words = [raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            found = self.library.encode(words, is_pretokenized=True, add_special_tokens=False)
            sizes = np.bincount(np.array(found.word_ids, np.int64), minlength=len(new))
            begins = len(self.ids) + np.cumsum(sizes) - sizes
            self.ids = np.append(self.ids, np.array(found.ids, np.uint32))
            where = at[new]
            self.hashes, self.begins, self.sizes = np.insert(self.hashes, where, hashes[new]), np.insert(self.begins, where, begins), np.insert(self.sizes, where, sizes)
            at, _ = self._places(hashes)
        return at

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a slice, their row offsets, and the places right behind a sentence's end."""
        raw = data.tobytes()
        if any(s.encode() in raw for s in self.special):
            texts = [raw[offsets[i] : offsets[i + 1]].decode() for i in range(len(offsets) - 1)]
            ids = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])]), np.zeros(0, np.int64)
        starts, ends, rows = pretokens(data, offsets, self.classes)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
        hashes, first, which = np.unique(byte_hash(data, starts, ends), return_index=True, return_inverse=True)
        at = self.learn(raw, hashes, starts[first], ends[first])
        n = self.sizes[at][which]
        behind = np.cumsum(n)
        ids = self.ids[np.repeat(self.begins[at][which] - (behind - n), n) + np.arange(behind[-1])]
        last = data[ends - 1]
        stops = (last == 0x2E) | (last == 0x21) | (last == 0x3F) | (last == 0x0A)
        by_row = np.concatenate([[0], np.cumsum(np.bincount(rows, n, len(offsets) - 1).astype(np.int64))])
        return ids, by_row, behind[stops]


_ENCODERS: dict[tuple[str, bytes], Encoder] = {}


def encoder(path: str, classes: bytes) -> Encoder:
    """One encoder per Python worker."""
    if (path, classes) not in _ENCODERS:
        _ENCODERS[path, classes] = Encoder(path, classes)
    return _ENCODERS[path, classes]


def best_cuts(places: list[int], penalties: list[int], begin: int, width: int) -> list[int]:
    """Cheapest cuts of the stream from `begin` to the last place; neighbouring places are at most `width` apart."""
    parent, queue = [0] * len(places), deque([(begin, 0, -1)])
    for j, (at, penalty) in enumerate(zip(places, penalties, strict=True)):
        while queue[0][0] < at - width:
            queue.popleft()
        _, least, parent[j] = queue[0]
        value = least + width + penalty
        while queue and queue[-1][1] > value:
            queue.pop()
        queue.append((at, value, j))
    cuts, j = [], len(places) - 1
    while j >= 0:
        cuts.append(places[j])
        j = parent[j]
    return cuts[::-1]


def places_of(doc_ends: np.ndarray, sentence_ends: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Places to cut in ascending order and their penalties."""
    free = np.unique(doc_ends)
    soft = np.setdiff1d(sentence_ends, free)
    at = np.concatenate([free, soft])
    penalty = np.repeat([0, SENTENCE_PENALTY], [len(free), len(soft)])
    order = np.argsort(at)
    at, penalty = at[order], penalty[order]
    gaps = np.diff(at, prepend=begin)
    more = np.maximum(0, (gaps - 1) // STRIDE)
    if more.any():
        base = np.repeat(at - gaps, more)
        step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        at = np.concatenate([at, base + step * STRIDE])
        penalty = np.concatenate([penalty, np.full(len(base), INSIDE_PENALTY)])
        order = np.argsort(at, kind="stable")
        at, penalty = at[order], penalty[order]
    return at, penalty


class Packer:
    """The stream of one partition: documents go in, pieces of finished windows come out."""

    def __init__(self, width: int, first_sequence: int):
        self.width, self.sequence = width, first_sequence
        self.begin = 0  # of what isn't packed yet; positions count from the partition's first token
        self.ids = np.zeros(0, np.uint32)
        self.doc_ids: list = []
        self.doc_ends, self.doc_tokens = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.places, self.penalties = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, doc_ids: list, ids: np.ndarray, offsets: np.ndarray, sentences: np.ndarray) -> None:
        """Documents whose ids include their end id; sentence places are relative to ids."""
        base = self.begin + len(self.ids)
        places, penalties = places_of(base + offsets[1:], base + sentences, base)
        self.places, self.penalties = np.append(self.places, places), np.append(self.penalties, penalties)
        self.ids = np.append(self.ids, ids)
        self.doc_ids += doc_ids
        self.doc_ends, self.doc_tokens = np.append(self.doc_ends, base + offsets[1:]), np.append(self.doc_tokens, np.diff(offsets))

    def take(self, last: bool = False) -> pa.RecordBatch | None:
        """The pieces of the windows that are final."""
        if not len(self.places):
            return None
        cuts = best_cuts(self.places.tolist(), self.penalties.tolist(), self.begin, self.width)
        cuts = np.array(cuts if last else cuts[:-2], np.int64)
        if not len(cuts):
            return None
        end = cuts[-1]
        edges = np.union1d(cuts, self.doc_ends[self.doc_ends < end])
        starts = np.concatenate([[self.begin], edges[:-1]])
        doc = np.searchsorted(self.doc_ends, starts, "right")
        window = np.searchsorted(cuts, starts, "right")
        window_start = np.concatenate([[self.begin], cuts])[window]
        in_doc = starts - (self.doc_ends - self.doc_tokens)[doc]
        raw = self.ids.astype("<u4").tobytes()
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((starts - self.begin).tolist(), (edges - self.begin).tolist(), strict=True)]
        columns = [
            pa.array([self.doc_ids[i] for i in doc.tolist()], pa.int64()), pa.array(in_doc), pa.array(edges - starts), pa.array(crc, pa.int64()),
            pa.array(self.doc_tokens[doc]), pa.array(self.sequence + window), pa.array(starts - window_start),
        ]
        self.ids = self.ids[end - self.begin :]
        gone = int(np.searchsorted(self.doc_ends, end, "right"))
        self.doc_ids, self.doc_ends, self.doc_tokens = self.doc_ids[gone:], self.doc_ends[gone:], self.doc_tokens[gone:]
        later = self.places > end
        self.places, self.penalties = self.places[later], self.penalties[later]
        self.begin, self.sequence = int(end), self.sequence + len(cuts)
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])


def classes_of(spark: SparkSession, path: str) -> bytes:
    """The tokenizer's character classes, found by a task, so that the driver never loads the library."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([character_classes(Tokenizer.from_file(path))])], ["classes"])

    return bytes(spark.range(0, 1, 1, 1).mapInArrow(run, "classes binary").first()["classes"])


def pack(docs: DataFrame, width: int = WIDTH, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces of documents in windows of at most `width` tokens; each token lies in exactly one piece.

    A null or empty text is its end id alone. Rows with a null or repeated doc_id are packed like others, one after
    another. An empty table gives no pieces. A window's id is the partition's number and a count, so ids and cuts
    follow the input's partitions. Other columns are not looked at.
    """
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    classes = classes_of(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(width, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32)
        for batch in released(batches):
            data, offsets, _ = utf8(batch.column("text"))
            names = batch.column("doc_id").to_pylist()
            for i, j in slices(offsets):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                ids, by_row, sentences = encoder(path, classes).rows(part, own)
                n = j - i
                # Each document's end id goes behind its ids; later places move by the end ids before them.
                sentences = sentences + np.searchsorted(by_row[1:], sentences, "left")
                ids = np.insert(ids, by_row[1:], np.uint32(end_id))
                packer.add(names[i:j], ids, by_row + np.arange(n + 1), sentences)
                out = packer.take()
                if out is not None:
                    yield out
        out = packer.take(last=True)
        if out is not None:
            yield out

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
