"""Operator 2. Mixing sources to target weights by Pfair scheduling. Built-in functions only.

Each source is cut into blocks of equally many rows, and the mix is a sequence of slots of one block. Weights are whole
numbers w; a cycle of the mix holds w blocks of each source that has that many left, else what it has. In a cycle of Q
slots with b blocks of a source, its block j is released at slot floor(j Q / b) and due before slot ceil((j + 1) Q / b);
each slot takes the released block that is due first. Every block then stands within its window, so at any slot a source
is less than one block away from its share, and at the end of a cycle it is exact. When a source runs out, the weights
of the others hold among themselves, and no row is dropped or repeated.

Cycles with the same numbers b share one pattern. There are at most two more patterns for each source, whatever the size
of the corpus, and a pattern has as many slots as the weights sum up to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagelake.llm.shared import quoted, table

BLOCK_ROWS = 64
#: About the sum of the whole-number weights; each source has at least 1.
RESOLUTION = 1000
#: Default weights go with this power of a source's number of rows.
TEMPER = 0.5
#: Rows numbered in one sorted stretch; sources have as many stretches as the largest needs.
STRETCH = 4096

_MISSING = "\u0000"


def target_weights(docs: DataFrame, weights: dict[str, float] | None, temper: float, resolution: int) -> DataFrame:
    """src, n rows and whole-number weight w of each source; sources without a given weight get the least, 1."""
    sizes = docs.groupBy("_src").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        raw: Column = F.pow(F.col("n").cast("double"), F.lit(temper))
    else:
        total = sum(weights.values())
        raw = F.coalesce(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v / total))])[F.col("_src")], F.lit(0.0)) if weights else F.lit(0.0)
    raw_sum = F.sum("raw").over(Window.partitionBy())  # a row per source
    share = F.when(raw_sum > 0, F.col("raw") / raw_sum).otherwise(F.lit(0.0)) if weights is None else F.col("raw")
    return sizes.withColumn("raw", raw).select("_src", "n", F.greatest(F.lit(1), F.round(share * resolution)).cast("long").alias("w"))


# The blocks b of each source in the cycles from e on, and the fold over a cycle's slots. `made` holds the slots' blocks,
# `k` how many blocks of each source have been placed.
_LEFT = "transform(sources, s -> least(s.w, greatest(s.blocks - e * s.w, 0L)))"
_FOLD = """
aggregate(
  sequence(0L, q - 1),
  named_struct('k', transform(b, x -> 0L), 'made', cast(array() as array<struct<i:int,j:bigint>>)),
  (a, t) -> aggregate(
    array(array_min(transform(a.k, (k, i) -> if(k < b[i] and k * q div b[i] <= t, named_struct('due', ((k + 1) * q + b[i] - 1) div b[i], 'i', i), null))).i),
    a,
    (c, p) -> named_struct('k', transform(c.k, (k, i) -> if(i = p, k + 1, k)), 'made', concat(c.made, array(named_struct('i', p, 'j', c.k[p]))))
  ),
  a -> a.made
)
"""


def patterns(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cycle patterns (e, i, j, slot, q, due, released, begin), and each source's number i, w and the starts e.

    e is the first cycle of a stretch of equal cycles and `begin` the mix's slot at which that stretch begins.
    """
    listed = sources.agg(F.sort_array(F.collect_list(F.struct("_src", "w", "blocks"))).alias("sources"))  # a row per source
    ends = "flatten(transform(sources, s -> array(s.blocks div s.w, (s.blocks + s.w - 1) div s.w)))"
    starts = listed.withColumn("all_starts", F.expr(f"array_sort(array_distinct(concat(array(0L), {ends})))"))
    starts = starts.withColumn("starts", F.expr("slice(all_starts, 1, size(all_starts) - 1)"))
    each = starts.select("sources", F.explode(F.expr("transform(starts, (e, n) -> named_struct('e', e, 'next', all_starts[n + 1]))")).alias("x")).select("sources", "x.e", "x.next")
    each = each.withColumn("b", F.expr(_LEFT)).withColumn("q", F.expr("aggregate(b, 0L, (a, x) -> a + x)"))
    before = Window.orderBy("e").rowsBetween(Window.unboundedPreceding, -1)  # a row per pattern
    each = each.withColumn("begin", F.coalesce(F.sum(F.expr("(next - e) * q")).over(before), F.lit(0)))
    slots = each.select("e", "q", "b", "begin", F.posexplode(F.expr(_FOLD)).alias("slot", "x"))
    pattern = slots.select("e", "x.i", "x.j", "slot", "q", "begin", F.expr("x.j * q div b[x.i]").alias("released"), F.expr("((x.j + 1) * q + b[x.i] - 1) div b[x.i]").alias("due"))
    numbered = starts.select("starts", F.posexplode("sources").alias("i", "s")).select(F.col("s._src").alias("_src"), "i", "s.w", "starts")
    return pattern, numbered


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, seed: int = 29, temper: float = TEMPER, resolution: int = RESOLUTION) -> DataFrame:
    """All rows and columns with mix_block (slot in the mix), mix_offset (place in the block), source_block, and the
    slots released and due between which the block may stand.

    Inside a source the order is a seeded hash of id and text. A null source is a source of its own; null ids and texts
    and repeated rows are rows like others; an empty table gives no rows. Other columns are carried along; those of the
    names above are replaced.
    """
    added = ["mix_block", "mix_offset", "source_block", "released", "due"]
    names = quoted(docs, *[c for c in docs.columns if c.lower() in added])
    # The row travels as one column, so that no column of it can clash with the working ones.
    order = F.xxhash64(F.lit(seed), "doc_id", "text")
    rows = docs.select(F.coalesce(F.col("source").cast("string"), F.lit(_MISSING)).alias("_src"), order.alias("_order"), F.struct(*names).alias("_row"))
    sources = target_weights(rows, weights, temper, resolution)
    sources = sources.withColumn("blocks", F.ceil(F.col("n") / block_rows))
    pattern, numbered = patterns(sources)
    # Rows are numbered inside stretches of a source, so that a large source is many tasks' work. What is known of the
    # source comes with the stretch: a join by source alone would bring all rows of a large one together.
    largest = rows.groupBy("_src").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    part = F.pmod(F.xxhash64("_order"), F.lit(-(-largest // STRETCH))).alias("_part")
    dealt = rows.select("*", part)
    counts = rows.select("_src", part).groupBy("_src", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_src").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per stretch
    stretches = counts.select("_src", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")).join(numbered, "_src")
    inside = F.row_number().over(Window.partitionBy("_src", "_part").orderBy("_order", "_row.doc_id"))
    at = dealt.withColumn("_at", inside).join(stretches, ["_src", "_part"]).withColumn("_at", F.col("_before") + F.col("_at") - 1)
    at = at.withColumn("source_block", F.expr(f"_at div {block_rows}")).withColumn("mix_offset", F.expr(f"_at % {block_rows}"))
    at = at.withColumn("_cycle", F.expr("source_block div w")).withColumn("j", F.expr("source_block % w"))
    at = at.withColumn("e", F.expr("array_max(filter(starts, x -> x <= _cycle))"))
    placed = at.join(pattern, ["e", "i", "j"]).withColumn("_base", F.expr("begin + (_cycle - e) * q"))
    return placed.select(
        "_row.*", (F.col("_base") + F.col("slot")).alias("mix_block"), "mix_offset", "source_block",
        (F.col("_base") + F.col("released")).alias("released"), (F.col("_base") + F.col("due")).alias("due"),
    )


def in_mix_order(docs: DataFrame, **settings) -> DataFrame:
    """All rows and columns, ordered as the mix: by range over partitions and sorted inside each."""
    mixed = mix(docs, **settings)
    return mixed.repartitionByRange("mix_block").sortWithinPartitions("mix_block", "mix_offset").select(*quoted(docs))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Only a hash of the text is needed for the order.
    return mix(table(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("text"), "source")).drop("text")
