import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from triagelake.llm import jaccard, mixing, packing
from triagelake.llm.shared import stored

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    raw = {r["doc_id"]: r["text"] for r in docs.collect()}
    now = docs
    rows = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stored(stage(spark, now, DATA), name)
        assert now.columns == docs.columns
        rows[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    assert len(rows["language"]) >= 0.98 * len(raw)
    kept = {r["doc_id"] for r in jaccard.jaccard_join(docs.filter(docs.doc_id.isin(*rows["language"]))).filter("kept").collect()}
    assert set(rows["near_duplicates"]) == kept
    assert set(rows["privacy"]) == kept and any("<email>" in t for t in rows["privacy"].values())
    assert rows["mixing"] == rows["privacy"]
    pieces = packing.pack(now).collect()
    assert {p["doc_id"] for p in pieces} == kept


def test_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        now = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stored(stage(spark, now, DATA), name)
            assert now.columns == docs.columns
        assert {p["doc_id"] for p in corpus_pipeline.STAGES[-1][1](spark, now, DATA).collect()} == {r["doc_id"] for r in now.collect()}


@pytest.fixture
def many_files(spark):
    """Settings under which the mix is written as several files and read in several splits."""
    put = {
        "spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "32k", "spark.sql.files.openCostInBytes": "1k",
    }
    old = {k: spark.conf.get(k) for k in put}
    for k, v in put.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_sequences_follow_the_mix(spark, many_files):
    words = F.expr("array_join(transform(sequence(1, 2 + cast(id * id % 97 as int)), x -> hex(xxhash64(id, x))), ' ')")
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), words.alias("text"), F.lit("en").alias("lang"), F.expr("element_at(array('a', 'b', 'b', 'c'), 1 + cast(id % 4 as int))").alias("source"))
    want = [r["doc_id"] for r in mixing.mix(docs).orderBy("mix_block", "mix_offset").select("doc_id").collect()]
    written = stored(corpus_pipeline.mixing_stage(spark, docs, DATA), "mixing")
    assert len(written.inputFiles()) > 3
    pieces = corpus_pipeline.packing_stage(spark, written, DATA).orderBy("sequence_id", "offset").collect()
    assert list(dict.fromkeys(p["doc_id"] for p in pieces)) == want
