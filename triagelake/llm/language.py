"""Operator 9. Language identification by averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams; the classifier is linear on that mean. Both are
trained by stochastic gradient descent in numpy on a bounded sample of labelled rows. Because everything after the
embedding is linear, the trained model folds into one table of a score per n-gram bucket and language, so scoring
a corpus is a look-up and a mean over every n-gram of the whole text.

The sample is drawn for each language on its own, so that a rare one is not missed, and a task trains on it; only the
folded table reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.shared import packed, table, unpacked
from triagelake.llm.textcore import list_of, released, slices, utf8

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 15
    dim: int = 16
    orders: tuple[int, ...] = (2, 3, 4)
    #: Labelled rows that training uses, in equal parts for each language that has them (at most so many languages, the
    #: most frequent). The training task holds 8 bytes for each distinct bucket of each of these texts.
    sample_rows: int = 2000
    steps: int = 600
    batch: int = 16
    rate: float = 1.0
    seed: int = 11
    #: A prediction is rejected if its calibrated probability of being right is below this.
    reject_below: float = 0.5


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    scores: np.ndarray  # buckets x langs
    bias: np.ndarray
    temperature: float
    settings: Settings


def may_learn(doc_id: str = "doc_id") -> Column:
    """Rows a model may learn from: crc32 of the id as text is not 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2, F.lit(False))


_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, *range(0x21, 0x41)]] = 0x20  # white space, ASCII digits and punctuation


def _buckets(data: np.ndarray, order: int, s: Settings) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte but the last order - 1."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for i in range(order):
        h = (h ^ _LOWER[data[i : i + n]]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    return (h & np.uint32(s.buckets - 1)).astype(np.int64)


def _crossing(offsets: np.ndarray, order: int, n: int) -> np.ndarray:
    """Positions whose n-gram would reach into the next row."""
    at = (offsets[1:, None] - np.arange(1, order)[None, :]).ravel()
    return at[(at >= 0) & (at < n)]


def features(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Counts of each text's buckets, for training."""
    for batch in released(batches):
        data, offsets, _ = utf8(batch.column("text"))
        keys, counts, ends = [], [], [0]
        for i in range(len(offsets) - 1):
            row = data[offsets[i] : offsets[i + 1]]
            k, c = np.unique(np.concatenate([_buckets(row, o, s) for o in s.orders]), return_counts=True)
            keys.append(k)
            counts.append(c)
            ends.append(ends[-1] + len(k))
        ends = np.array(ends)
        cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("pick"), list_of(cat(keys), ends, pa.int32()), list_of(cat(counts), ends, pa.int32())], ["lang", "pick", "keys", "counts"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sample(docs: DataFrame, s: Settings) -> DataFrame | None:
    """lang, pick (a seeded hash of the id) and text of the labelled rows to train on; None without labels."""
    labelled = docs.filter(may_learn() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = labelled.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(s.sample_rows).collect()
    if not counts:
        return None
    quota = -(-s.sample_rows // len(counts))
    limits = [(r["lang"], int(min(1.0, quota / r["count"]) * (1 << 32))) for r in counts]
    # A row per language of the sample, so of bounded size.
    shares = F.broadcast(docs.sparkSession.createDataFrame(limits, "lang string, _limit long"))
    pick = F.pmod(F.xxhash64(F.lit(s.seed), "doc_id"), F.lit(1 << 32))
    return labelled.select("lang", pick.alias("pick"), "text").join(shares, "lang").filter("pick < _limit").drop("_limit")


def train(docs: DataFrame, s: Settings = Settings()) -> Model | None:
    """A model from about `sample_rows` labelled rows; None without labels. A single task does the training.

    A quarter of the sample only calibrates: the temperature that minimises its log loss makes the confidence an
    estimate of the probability of being right, by which predictions are rejected.
    """
    rows = sample(docs, s)
    if rows is None:
        return None

    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(released(batches))
        if parts:
            rows_ = pa.Table.from_batches(parts).sort_by("pick")
            parts.clear()  # only the sorted copy stays while it trains
            pa.default_memory_pool().release_unused()
            m = fit(rows_, s)
            yield pa.RecordBatch.from_arrays([pa.array([list(m.langs)]), pa.array([m.scores.tobytes()]), pa.array([m.bias.tolist()]), pa.array([m.temperature])], ["langs", "scores", "bias", "temperature"])

    features_ = rows.mapInArrow(lambda b: features(b, s), "lang string, pick long, keys array<int>, counts array<int>")
    got = features_.repartition(1).mapInArrow(fit_all, "langs array<string>, scores binary, bias array<double>, temperature double").first()
    if got is None:
        return None
    scores = np.frombuffer(bytes(got["scores"]), np.float32).reshape(s.buckets, -1)
    return Model(tuple(got["langs"]), scores, np.array(got["bias"]), got["temperature"], s)


def fit(sample: pa.Table, s: Settings) -> Model:
    """Stochastic gradient descent over the rows of lang, pick, keys and counts."""
    langs = sorted(set(sample["lang"].to_pylist()))
    target = np.array([langs.index(x) for x in sample["lang"].to_pylist()])
    fold = np.asarray(sample["pick"]) % 4
    # Views of the Arrow buffers, not copies.
    lists = sample.select(["keys", "counts"]).combine_chunks()
    ends = np.append(0, np.cumsum(np.asarray(lists["keys"].combine_chunks().value_lengths())))
    keys, counts = (np.split(np.asarray(lists[c].combine_chunks().flatten()), ends[1:-1]) for c in ("keys", "counts"))
    rng = np.random.default_rng(s.seed)
    emb = rng.normal(0, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    out, bias = np.zeros((s.dim, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    fit = np.flatnonzero((fold != 0) & np.array([len(k) > 0 for k in keys], bool))
    if not len(fit):
        fit = np.arange(len(keys))
    order = np.concatenate([rng.permutation(fit) for _ in range(1 + s.steps * s.batch // len(fit))])
    for step in range(s.steps):
        rows_ = order[step * s.batch : (step + 1) * s.batch]
        rate = s.rate * (1 - step / s.steps)
        k = np.concatenate([keys[r] for r in rows_]).astype(np.intp)  # the type that add.at is fast for
        c = np.concatenate([counts[r] / max(1.0, counts[r].sum()) for r in rows_]).astype(np.float32)
        own = np.repeat(np.arange(len(rows_)), [len(keys[r]) for r in rows_])
        mean = np.zeros((len(rows_), s.dim), np.float32)
        np.add.at(mean, own, emb[k] * c[:, None])
        grad = _softmax(mean @ out + bias)
        grad[np.arange(len(rows_)), target[rows_]] -= 1
        back = grad @ out.T
        out = np.clip(out - rate * mean.T @ grad, -30, 30)
        bias -= rate * grad.mean(axis=0) * 0.1
        # A step on the mean moves every bucket in proportion to its share; scaled so that rare ones learn too.
        np.add.at(emb, k, -rate * np.clip(back, -1, 1)[own] * np.minimum(s.dim * c, 1.0)[:, None])
    scores = emb @ out
    z = np.array([(scores[k] * (c / max(1.0, c.sum()))[:, None]).sum(axis=0) + bias for k, c in zip(keys, counts, strict=True)])
    held = np.flatnonzero(fold == 0) if (fold == 0).any() else np.arange(len(target))
    grid = np.geomspace(0.02, 10, 60)
    # A little smoothing, so that a sample without an error doesn't ask for endless confidence.
    loss = [-(0.98 * np.log(q[np.arange(len(held)), target[held]]).mean() + 0.02 * np.log(q).mean()) for q in (_softmax(z[held] / t) + 1e-12 for t in grid)]
    temperature = float(grid[int(np.argmin(loss))])
    return Model(tuple(langs), scores.astype(np.float32), bias, temperature, s)


def score_batches(batches: Iterator[pa.RecordBatch], m: Model) -> Iterator[pa.RecordBatch]:
    langs = np.array(m.langs, dtype=object)
    for batch in released(batches):
        data, offsets, _ = utf8(batch.column("text"))
        best, conf = np.zeros(len(batch), np.int64), np.zeros(len(batch))
        for i, j in slices(offsets):
            part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            total, n = np.zeros((j - i, len(m.langs))), np.zeros(j - i)
            for order in m.settings.orders:
                b = _buckets(part, order, m.settings)
                if not len(b):
                    continue
                keep = np.ones(len(b), bool)
                keep[_crossing(own, order, len(b))] = False
                edges = np.minimum(own, len(b))
                n += np.diff(np.concatenate([[0], np.cumsum(keep)])[edges])
                for lang in range(len(m.langs)):
                    v = m.scores[:, lang][b]
                    v[~keep] = 0
                    total[:, lang] += np.diff(np.concatenate([[0.0], np.cumsum(v, dtype=np.float64)])[edges])
            p = _softmax((total / np.maximum(n, 1)[:, None] + m.bias) / m.temperature)
            best[i:j], conf[i:j] = p.argmax(axis=1), p.max(axis=1)
        keep = [k for k in batch.schema.names if k != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(langs[best], pa.string()), pa.array(conf)], [*keep, "_lang", "_score"])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Every row's doc_id with lang_pred, score (0 to 1) and accepted.

    `und` with score 0 and not accepted: a null text, a text without a letter, or no model. Else the most probable
    learned language; it is accepted if the calibrated confidence reaches `reject_below`. Equal texts get
    equal results; repeated rows stay; only the whole text is an input.
    """
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", letter.alias("_letter"), "text")
    if model is None:
        scored = rows.select("doc_id", "_letter", F.lit(UNKNOWN).alias("_lang"), F.lit(0.0).alias("_score")).withColumn("_letter", F.lit(False))
    else:
        scored = rows.mapInArrow(lambda b: score_batches(b, model), "doc_id long, _letter boolean, _lang string, _score double")
    limit = F.lit(model.settings.reject_below if model else 1.0)
    return scored.select(
        "doc_id", F.when(F.col("_letter"), F.col("_lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("_letter"), F.col("_score")).otherwise(0.0).alias("score"),
        (F.col("_letter") & (F.col("_score") >= limit)).alias("accepted"),
    )


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows whose language is accepted, with all their columns."""
    if model is None:
        return docs.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in score_batches(iter([batch.select(["text"])]), model):
                yield batch.filter(pa.array(np.asarray(out.column("_score")) >= model.settings.reject_below))

    rows = packed(docs.filter(F.col("text").rlike(r"\p{L}")), "text")
    kept = rows.mapInArrow(run, rows.schema)
    return kept.select(*unpacked(kept, docs.columns, "text"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return identify(docs, train(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
