import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from triagelake.llm import packing, transducer
from triagelake.llm.textcore import utf8

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    letters = "abcdefstmdrevlz''''    \n\t 　éèß1279०Ⅷ.,!-_@<>|😀汉字́​\x00\x1c\x85"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    return ["", "'s", "x" * 9000, "1" * 9000, " " * 3000 + "a", "a<|endoftext|>b <|endoftext|>", " \n a\n\n", "it's''s 're've'll'd", *made]


def test_counts_equal_the_library(library, texts):
    counter = transducer.Counter(PATH, transducer.character_classes(library))
    data, offsets, _ = utf8(pa.array(texts))
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.texts(data, offsets).tolist() == want


def test_counts_after_forgetting(library, texts, monkeypatch):
    monkeypatch.setattr(transducer, "MAX_STATES", 50)
    counter = transducer.Counter(PATH, transducer.character_classes(library))
    for part in (texts[:300], texts[300:600], texts[:300]):
        data, offsets, _ = utf8(pa.array(part))
        assert counter.texts(data, offsets).tolist() == [len(e.ids) for e in library.encode_batch(part, add_special_tokens=False)]


def test_chunks_do_not_matter():
    symbols = np.random.default_rng(2).integers(0, 9, 5000).astype(np.uint8)
    one = transducer._scan(symbols, chunk=8192)
    assert all((transducer._scan(symbols, chunk=c) == one).all() for c in (1, 7, 64))


def test_count_rows(spark, odd, empty):
    got = transducer.token_counts(odd).collect()
    assert len(got) == odd.count() and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2)} == {0}
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    assert transducer.token_counts(empty).count() == 0


def _check(pieces, docs, library, width):
    by_doc, by_window = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"], p["doc_tokens"]].append(p)
        by_window[p["sequence_id"]].append(p)
    for window in by_window.values():
        at = 0
        for p in sorted(window, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= width
    for doc_id, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        mine = by_doc[doc_id, len(ids)]
        for p in mine:
            part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4")
            assert zlib.crc32(part.tobytes()) == p["ids_crc32"]
        copies = sum(d == (doc_id, text) for d in docs)
        assert sorted(x for p in mine for x in range(p["start"], p["start"] + p["length"])) == sorted([*range(len(ids))] * copies)
    return by_window


@pytest.mark.parametrize("width", [64, 2048])
def test_every_token_in_one_piece(spark, odd, empty, library, width):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    _check(packing.pack(odd, width=width).collect(), docs, library, width)
    assert packing.pack(empty).count() == 0


def test_padding_and_stretches(library):
    docs = [(i, " ".join(f"word{j}." for j in range(i % 37 + 3))) for i in range(4000)]
    packer, pieces = packing.Packer(256, 0), []
    encoder = packing.Encoder(PATH, transducer.character_classes(library))
    for at in range(0, len(docs), 500):
        data, offsets, _ = utf8(pa.array([t for _, t in docs[at : at + 500]]))
        ids, rows, ends = encoder.rows(data, offsets)
        n = len(rows) - 1
        ends = ends + np.searchsorted(rows[1:], ends, "left")
        packer.add([d for d, _ in docs[at : at + 500]], np.insert(ids, rows[1:], 1), rows + np.arange(n + 1), ends)
        out = packer.take(last=at + 500 >= len(docs))
        pieces += out.to_pylist() if out else []
    windows = _check(pieces, docs, library, 256)
    used = sum(p["length"] for p in pieces)
    assert used / (256 * len(windows)) > 0.95


def test_cuts_are_cheapest():
    rng = random.Random(4)
    for _ in range(200):
        places = sorted(rng.sample(range(1, 40), 15)) + [40]
        places = [p for k, p in enumerate(places) if True]
        penalties = [rng.choice([0, 3, 9]) for _ in places]
        width = max(np.diff([0, *places])) + rng.randint(0, 8)
        cost = {0: 0}
        for p, q in zip(places, penalties, strict=True):
            cost[p] = min(cost[b] + width - (p - b) + q for b in cost if p - b <= width)
        cuts = packing.best_cuts(places, penalties, 0, int(width))
        worth = dict(zip(places, penalties, strict=True))
        assert sum(width - (b - a) + worth[b] for a, b in zip([0, *cuts], cuts, strict=False)) == cost[40]
