import numpy as np
from pyspark.sql import functions as F

from triagelake.llm import language

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = {r["doc_id"]: r for r in language.op9_language(spark, DATA).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [d for d, r in out.items() if r["held_out"]]
    assert len(out) == len(truth) and 0.15 < len(held) / len(out) < 0.35
    assert np.mean([out[d]["lang_pred"] == truth[d] for d in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_odd_rows(spark, odd, empty):
    model = language.train(odd.withColumn("lang", F.coalesce("lang", F.lit("en"))), language.Settings(steps=60))
    got = language.identify(odd, model).collect()
    assert len(got) == odd.count()
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert und == {1, 2, 4, 9, 13} and all(r["score"] == 0 and not r["accepted"] for r in got if r["doc_id"] in und)
    kept = language.keep_identified(odd, model)
    assert kept.columns == odd.columns and not {r["doc_id"] for r in kept.collect()} & und
    assert language.train(empty) is None
    assert {r["lang_pred"] for r in language.identify(odd, None).collect()} == {"und"}
    assert language.keep_identified(empty, None).count() == 0


def test_rejection_needs_confidence(spark, odd):
    model = language.train(spark.read.parquet(f"{DATA}/documents.parquet"), language.Settings(sample_rows=300, steps=60))
    rows = language.identify(spark.createDataFrame([(1, "zq"), (2, "the thing and of the with that is")], "doc_id long, text string"), model).collect()
    assert all(r["accepted"] == (r["score"] >= model.settings.reject_below) for r in rows)


def test_rare_languages_are_learned(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    rare = spark.range(8).select((10_000 + F.col("id")).alias("doc_id"), F.lit("blorp zint quaxu mopti varnik").alias("text"), F.lit("xx").alias("lang"))
    model = language.train(docs.union(rare), language.Settings(sample_rows=200, steps=200))
    assert "xx" in model.langs and len(model.langs) == 5
    got = language.identify(rare, model).select("lang_pred").distinct().collect()
    assert [r["lang_pred"] for r in got] == ["xx"]


def test_folded_table_is_the_plain_forward_pass(spark):
    """The corpus pass over folded scores equals embedding every n-gram, averaging and multiplying."""
    rows = language.sample(spark.read.parquet(f"{DATA}/documents.parquet"), language.Settings(sample_rows=60)).collect()
    s = language.Settings(sample_rows=60, steps=30)
    model = language.train(spark.createDataFrame([(i, r["text"], r["lang"]) for i, r in enumerate(rows)], "doc_id long, text string, lang string"), s)
    texts = ["Short text.", "un texte assez court, avec des accents é à", rows[0]["text"]]
    got = language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for text, r in zip(texts, got):
        data = np.frombuffer(text.encode(), np.uint8)
        buckets = np.concatenate([language._buckets(data, o, s) for o in s.orders])
        z = (model.scores[buckets].astype(np.float64).mean(axis=0) + model.bias) / model.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        assert r["lang_pred"] == model.langs[int(p.argmax())] and abs(r["score"] - p.max()) < 1e-4
