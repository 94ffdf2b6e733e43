import collections
import zlib

from pyspark.sql import functions as F

from triagelake.llm import mixing, sharding

DATA = "/root/testdata/sf0.01"


def test_sharding_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = sharding.op6_sharding(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_order_is_mixed_and_repeats(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text")).repartition(3, "doc_id")
    one = [r["doc_id"] for r in sharding.shuffle_shards(docs, shards=1, bucket_bytes=1 << 14).orderBy("slot").collect()]
    two = [r["doc_id"] for r in sharding.shuffle_shards(docs, shards=1, bucket_bytes=1 << 14).orderBy("slot").collect()]
    assert one == two and sorted(one) == list(range(4000))
    apart = sum(abs(a - b) for a, b in zip(one, one[1:])) / len(one)
    assert 1200 < apart < 1470  # a third of the range on average


def test_sharding_odd_rows(spark, odd, empty, tmp_path):
    out = sharding.shuffle_shards(odd.union(odd), shards=4)
    assert out.count() == 2 * odd.count() and sorted(out.columns) == sorted(odd.columns)
    sizes = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    assert sharding.shuffle_shards(empty).count() == 0
    sharding.write_shards(odd, f"{tmp_path}/shards", shards=2)
    assert spark.read.parquet(f"{tmp_path}/shards").count() == odd.count()


def _mix(rows):
    blocks = {}
    for r in rows:
        blocks.setdefault(r["mix_block"], []).append(r)
    assert sorted(blocks) == list(range(len(blocks)))
    for b, members in blocks.items():
        assert len({(m["source"], m["source_block"]) for m in members}) == 1
        assert sorted(m["mix_offset"] for m in members) == list(range(len(members)))
        assert all(m["released"] <= b < m["due"] for m in members)
    return [blocks[b][0]["source"] for b in range(len(blocks))]


def test_mix_stays_within_a_block(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.expr("case when id % 10 < 6 then 'big' when id % 10 < 9 then 'mid' else 'low' end").alias("source"))
    weights = {"big": 0.5, "mid": 0.3, "low": 0.2}
    order = _mix(mixing.mix(docs, weights, block_rows=5, resolution=10).collect())
    seen, left = collections.Counter(), collections.Counter(order)
    for t, source in enumerate(order, 1):
        seen[source] += 1
        if all(seen[s] < left[s] for s in left):
            assert all(abs(seen[s] - t * w) < 1 for s, w in weights.items())
    # when the smallest has run out, the others keep their weights among themselves
    last = max(t for t, s in enumerate(order) if s == "low")
    rest = collections.Counter(order[last + 1 : last + 81])
    assert abs(rest["big"] - 50) <= 2


def test_mixing_query_and_odd_rows(spark, odd, empty):
    rows = mixing.op2_mixing(spark, DATA).collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) == 1000
    _mix(rows)
    out = mixing.mix(odd.union(odd), block_rows=2)
    assert out.count() == 2 * odd.count()
    _mix(out.collect())
    assert mixing.in_mix_order(odd).columns == odd.columns and mixing.in_mix_order(odd).count() == odd.count()
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(odd, {"a": 1.0}).count() == odd.count() and mixing.mix(odd, {}).count() == odd.count()
