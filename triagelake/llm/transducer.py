"""Operator 4. Token counts by finite-state transducers compiled from a byte-level BPE vocabulary.

Two deterministic transducers. The first one reads character classes and marks where a pre-token begins; it has
nine states, so a stretch of text is a map from entry state to exit state. Texts are cut into chunks, the chunks'
maps are composed by a prefix scan, and then every chunk is read once from its known entry state. The second one
reads the bytes of a pre-token and each of its transitions carries the number of tokens by which the count changes.
It is compiled from the vocabulary on demand: a state holds what still matters of the bytes read (open token
prefixes, each with the token before it), and at most `MAX_STATES` states are kept before compiling starts anew.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from triagelake.llm.shared import table
from triagelake.llm.textcore import byte_hash, slices, utf8

MAX_STATES = 1_000_000
LIMIT = 1024

# Symbols of the first transducer. An apostrophe that could begin a contraction is its own symbol (two or three
# characters long), and white space is told apart by what follows it.
LETTER, NUMBER, OTHER, SHORT, LONG, BLANK, WHITE, MORE_WHITE, RESET = range(9)
# States: fresh, in letters, in numbers, in others, after a prefix blank, in white space, in a contraction (3).
FRESH, IN_L, IN_N, IN_O, PREFIX, IN_W, C_SHORT, C_LONG, C_LAST = range(9)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a pre-token begins before the symbol, by state * 16 + symbol."""
    fresh = {LETTER: IN_L, NUMBER: IN_N, OTHER: IN_O, SHORT: C_SHORT, LONG: C_LONG, BLANK: PREFIX, WHITE: FRESH, MORE_WHITE: IN_W}
    go, begins = np.zeros(9 * 16, np.uint8), np.zeros(9 * 16, bool)
    inside = {
        IN_L: {LETTER: IN_L}, IN_N: {NUMBER: IN_N}, IN_O: {OTHER: IN_O, SHORT: IN_O, LONG: IN_O}, IN_W: {MORE_WHITE: IN_W},
        PREFIX: {LETTER: IN_L, NUMBER: IN_N, OTHER: IN_O, SHORT: IN_O, LONG: IN_O},
        C_SHORT: dict.fromkeys(range(8), FRESH), C_LONG: dict.fromkeys(range(8), C_LAST), C_LAST: dict.fromkeys(range(8), FRESH),
    }
    for state in range(9):
        for symbol in range(8):
            stays = inside.get(state, {}).get(symbol)
            go[state * 16 + symbol] = fresh[symbol] if stays is None else stays
            begins[state * 16 + symbol] = stays is None
        go[state * 16 + RESET] = FRESH
    return go, begins


_GO, _BEGINS = _machine()


def character_classes(tokenizer) -> bytes:
    """The class of every code point as the library's own splitter sees it, compressed.

    Each code point is put after a letter, a digit and a sign; where the splitter does not cut, it is of that class.
    """
    # Planes 4 to 13 and 15 to 16 hold no assigned characters but private ones, which are of no class.
    points = np.r_[0:0xD800, 0xE000:0x40000, 0xE0000:0xF0000]
    classes = np.full(0x110000, OTHER, np.uint8)
    classes[points] = WHITE
    for i in range(0, len(points), 4096):  # in blocks, so that the library's lists of pieces stay small
        block = points[i : i + 4096]
        for mark, kind in (("!", OTHER), ("1", NUMBER), ("a", LETTER)):
            text = "".join(mark + chr(p) for p in block.tolist())
            cut = np.zeros(len(text) + 1, bool)
            cut[[at[0] for _, at in tokenizer.pre_tokenizer.pre_tokenize_str(text)]] = True
            classes[block[~cut[1:-1:2]]] = kind
    classes[0x20] = BLANK
    return zlib.compress(classes.tobytes())


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte position and code point of every character of valid UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    points = lead.astype(np.int32)
    if len(at) < len(data):
        for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
            some = np.flatnonzero((lead >= low) & (lead <= high - 1))
            if len(some):
                value = points[some] & mask
                for i in range(1, more + 1):
                    value = value << 6 | (data[at[some] + i] & 0x3F)
                points[some] = value
    return at, points


def _symbols(points: np.ndarray, classes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of the characters; `ends` are the positions of separators (code point -1)."""
    kind = classes[np.maximum(points, 0)]
    kind[ends] = RESET
    n = len(kind)
    space = (kind == BLANK) | (kind == WHITE)
    follows = np.zeros(n, bool)  # white space whose next character is not white space
    follows[:-1] = ~space[1:] & (kind[1:] != RESET)
    kind[space & ~follows] = MORE_WHITE
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        padded = np.concatenate([points, [-1, -1]])
        one, two = padded[quote + 1], padded[quote + 2]
        kind[quote[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pair = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        kind[quote[pair]] = LONG
    return kind


def _scan(symbols: np.ndarray, chunk: int = 512) -> np.ndarray:
    """State before every symbol: maps of all chunks side by side, their prefix scan, then one pass from known states."""
    n = len(symbols)
    rows = -(-n // chunk)
    grid = np.full(rows * chunk, RESET, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)
    maps = np.tile(np.arange(9, dtype=np.uint8), (rows, 1))
    for column in grid:
        maps = _GO[(maps * np.uint8(16)) + column[:, None]]
    # Inclusive scan of the maps under composition: after round k a map covers 2^k chunks.
    step = 1
    while step < rows:
        later = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        maps = np.concatenate([maps[:step], later])
        step *= 2
    state = np.concatenate([[FRESH], maps[:-1, FRESH]]).astype(np.uint8)
    before = np.empty_like(grid)
    for i, column in enumerate(grid):
        before[i] = state
        state = _GO[(state * np.uint8(16)) + column]
    return before.T.reshape(-1)[:n]


def pretokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every pre-token of a slice (bytes)."""
    at, points = characters(data)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    # A separator goes before each row's first character, so rows don't see each other.
    first = np.searchsorted(at, offsets[:-1])
    points = np.insert(points, first, -1)
    ends = first + np.arange(len(first))
    symbols = _symbols(points, classes, ends)
    begins = _BEGINS[_scan(symbols) * np.uint8(16) + symbols]
    begins = np.delete(begins, ends)
    starts = at[begins]
    stops = np.append(starts[1:], len(data))
    return starts, stops, np.searchsorted(offsets, starts, "right") - 1


class WordTransducer:
    """Deterministic transducer over the bytes of a pre-token; transitions carry changes of the token count."""

    def __init__(self, vocab: dict[str, int], merges: list):
        keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = (b for b in range(256) if b not in keep)
        back = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}
        spell = lambda s: bytes(back[c] for c in s)
        self.rank = {(spell(a), spell(b)): i for i, (a, b) in enumerate(x if isinstance(x, (list, tuple)) else x.split(" ") for x in merges)}
        self.fits: dict[tuple[bytes, bytes], bool] = {}  # of the states kept, so bounded with them
        tokens = [t for t in (spell(x) for x in vocab if all(c in back for c in x)) if self.encode(t) == [t]]
        self.inner = {t[:i] for t in tokens for i in range(1, len(t))}  # proper prefixes of tokens
        self.tokens = set(tokens)
        self.reset()

    def reset(self) -> None:
        self.fits.clear()
        self.ids: dict[tuple, int] = {((b"", None, 0),): 0}
        self.states: list[tuple] = [((b"", None, 0),)]
        self.keys, self.to, self.emit = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int8)

    def encode(self, word: bytes) -> list[bytes]:
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min((self.rank.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == 1 << 30:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def follows(self, before: bytes | None, token: bytes) -> bool:
        """Whether two tokens stand side by side in an encoding: merging their bytes anew gives the same two."""
        if before is None:
            return True
        known = self.fits.get((before, token))
        if known is None:
            known = self.fits[before, token] = self.encode(before + token) == [before, token]
        return known

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state by a byte.

        A state lists (open bytes, token before them, its count relative to the whole): every way in which the
        rest of the input may still complete a token. The encoding of a prefix ends in exactly one token, the one
        that stands next to the token before it.
        """
        open_, last, change = [], None, 0
        for prefix, before, behind in self.states[state]:
            grown = prefix + bytes([byte])
            if last is None and grown in self.tokens and self.follows(before, grown):
                last, change = grown, behind + 1
            if grown in self.inner:
                open_.append((grown, before, behind))
        new = (*((p, b, r - change) for p, b, r in open_), (b"", last, 0))
        target = self.ids.get(new)
        if target is None:
            target = self.ids[new] = len(self.states)
            self.states.append(new)
        return target, change

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Token counts of words, all read side by side; unknown transitions are compiled on the way."""
        if len(self.states) > MAX_STATES:
            self.reset()
        total, state, length = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), ends - starts
        order = np.argsort(-length, kind="stable")
        left = np.searchsorted(-length[order], -np.arange(1, int(length.max(initial=0)) + 1), "right")
        for i, alive in enumerate(left.tolist()):
            words = order[:alive]
            key = state[words] << 8 | data[starts[words] + i]
            if not len(self.keys):
                self._fill(key)
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            missing = self.keys[place] != key
            if missing.any():
                self._fill(key[missing])
                place = np.searchsorted(self.keys, key)
            state[words] = self.to[place]
            total[words] += self.emit[place]
        return total

    def _fill(self, keys: np.ndarray) -> None:
        """Compiles the transitions of these keys, none of which is known, into the sorted table."""
        keys = np.unique(keys)
        pairs = [self.compile(k >> 8, k & 255) for k in keys.tolist()]
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.to = np.insert(self.to, at, [p[0] for p in pairs])
        self.emit = np.insert(self.emit, at, [p[1] for p in pairs])


class Counter:
    """Counts tokens of whole texts as the library does with its defaults and no special tokens of its own."""

    def __init__(self, path: str, classes: bytes):
        with open(path) as f:
            model = json.load(f)
        self.special = [t["content"].encode() for t in model["added_tokens"]]
        self.words = WordTransducer(model["model"]["vocab"], model["model"]["merges"])
        self.classes = np.frombuffer(zlib.decompress(classes), np.uint8)

    def plain(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        starts, ends, rows = pretokens(data, offsets, self.classes)
        if not len(starts):
            return np.zeros(len(offsets) - 1, np.int64)
        _, first, which = np.unique(byte_hash(data, starts, ends), return_index=True, return_inverse=True)
        counts = self.words.counts(data, starts[first], ends[first])
        return np.bincount(rows, counts[which], len(offsets) - 1).astype(np.int64)

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Counts by row; the string of an added token inside a text is one token and splits the text."""
        total = np.zeros(len(offsets) - 1, np.int64)
        for i, j in slices(offsets):
            part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            raw = part.tobytes()
            if any(s in raw for s in self.special):
                pieces, owner = [], []
                for r in range(j - i):
                    parts = [raw[own[r] : own[r + 1]]]
                    for s in self.special:
                        parts = [y for x in parts for y in x.split(s)]
                    pieces += parts
                    owner += [r] * len(parts)
                    total[i + r] = len(parts) - 1
                edges = np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
                counts = self.plain(np.frombuffer(b"".join(pieces), np.uint8), edges)
                total[i:j] += np.bincount(owner, counts, j - i).astype(np.int64)
            else:
                total[i:j] = self.plain(part, own)
        return total


_COUNTERS: dict[tuple[str, bytes], Counter] = {}


def counter(path: str, classes: bytes) -> Counter:
    """One counter per Python worker, so what it has compiled serves its later tasks too."""
    if (path, classes) not in _COUNTERS:
        _COUNTERS[path, classes] = Counter(path, classes)
    return _COUNTERS[path, classes]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, bytes and tokens of every row's text and whether the tokens exceed `limit`.

    Null and empty texts count 0. Repeated rows stay; other columns are not looked at.
    """
    import public_tokenizers
    from tokenizers import Tokenizer

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    classes = character_classes(Tokenizer.from_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = utf8(batch.column("text"))
            n = counter(path, classes).texts(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
