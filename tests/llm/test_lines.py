import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from triagelake.llm import lines

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=20):
    """Kept text, lines before and lines dropped of each (doc_id, text), straight from the definition."""
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(WHITE).translate(LOWER)
            if len(key) >= least and doc is not None:
                holders[key].add(doc)
    out = []
    for doc, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if len(holders[x.strip(WHITE).translate(LOWER)]) < 3 or doc == max(holders[x.strip(WHITE).translate(LOWER)])]
        out.append((doc, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    out = df.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept"))
    return sorted(map(tuple, out.collect()), key=str)


def corpus():
    shared = [f"  Shared LINE number {i} of many documents\t" for i in range(5)]
    rows = []
    for doc in range(300):
        own = [f"line {j} of document {doc} alone" for j in range(3)]
        some = [shared[0].upper() if doc % 2 else shared[0]] if doc % 3 == 0 else []  # a third of all rows
        some += [shared[1]] * 2 if doc in (5, 150, 299) else []  # twice in each, the last keeps both
        some += [shared[2]] if doc in (7, 290) else []  # two documents are not enough
        some += ["short one"] if doc % 2 else []
        some += [shared[3] + "\r"] if doc in (1, 2, 3) else []  # all in one batch
        rows.append((doc, "\n".join(own[:1] + some + own[1:])))
    odd = "ÄÖÜ äöü ñandú über 汉字汉字"  # 24 code points, ASCII letters alone are lower-cased
    rows += [(400 + i, x) for i, x in enumerate([odd, odd + "\n", "\n" + odd, odd.replace("Ä", "ä"), "", "\n\n", None, "汉" * 19, "汉" * 19, "汉" * 19])]
    rows += [(None, shared[0].strip()), (None, "\n".join(shared[2:4])), (500, shared[2]), (500, shared[2]), (500, "another text\n" + shared[2]), (None, None)]
    rows += [(501, "\n".join(f"line {i % 50} of a long text {i % 50}" for i in range(60000)))] + [(502 + i, f"x\nline 7 of a long text 7\n{'y' * 40000}") for i in range(3)]
    return rows


def test_lines_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert result(lines.drop_repeated_lines(docs)) == want
    assert result(lines.drop_repeated_lines(docs, batches=1)) == want
    assert sum(r[2] for r in want) > 100


def test_lines_odd_rows(spark, odd, empty):
    both = odd.union(odd).withColumn("a.b", F.lit(1)).withColumn("back`tick", F.lit(2)).withColumn("n_lines", F.lit("x")).withColumn("drops", F.lit(3))
    out = lines.drop_repeated_lines(both, batches=2)
    assert out.count() == 2 * odd.count() and set(out.columns) == {*both.columns, "n_dropped"}
    assert out.filter("text IS NULL").count() == 2 and out.agg(F.min("drops")).first()[0] == 3
    assert result(out) == brute([(r["doc_id"], r["text"]) for r in both.collect()])
    assert lines.drop_repeated_lines(empty).count() == 0
    assert lines.drop_repeated_lines(odd.withColumn("doc_id", F.lit(None).cast("long"))).filter("n_dropped > 0").count() == 0


def test_runs_merge_where_they_lie(spark):
    """Neither the anti-join with the runs nor a compaction shuffles a run."""
    entries = lambda a, b, n: spark.range(a, b).select(F.col("id").alias("hi"), (F.col("id") * 7).alias("lo"), F.lit(n).cast("long").alias("n"), (1000 - F.col("id")).alias("last"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        runs = lines.Runs(spark)
        for a, b, n in ((0, 100, 1), (50, 150, 2), (100, 300, 1)):
            batch = runs.write(entries(a, b, n))
            plan = runs.fresh(batch)._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan, plan
            runs.add(batch)
        assert [run is not None for run in runs.levels] == [True, True]
        found = {r["hi"]: (r["n"], r["last"]) for r in runs.whole().collect()}
        # 50 to 99 are settled by the second batch; 100 to 149 stand in the second and third
        assert len(found) == 300 and found[60] == (3, 940) and found[120] == (3, 880) and found[10] == (1, 990) and found[200] == (1, 800)
        assert runs.fresh(entries(0, 300, 1)).count() == 200
        runs.forget()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_writes_are_few(spark, monkeypatch):
    """A run is written once, merged already; lines make one file a task. Before, six batches wrote 17 tables."""
    tables, files = [], []
    write, stored = lines.Runs.write, lines.stored
    monkeypatch.setattr(lines.Runs, "write", lambda self, df: tables.append(1) or write(self, df))

    def noted(df, name, *by):
        out = stored(df, name, *by)
        files.append((name, len(out.inputFiles())))
        return out

    monkeypatch.setattr(lines, "stored", noted)
    rows = corpus()
    assert result(lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == brute(rows)
    assert len(tables) == 7
    assert [n for n, _ in files] == ["lines", "repeated"] and files[0][1] <= 5


def test_settled_keys_are_still_found_hot(spark):
    runs = lines.Runs(spark)
    for hot in (False, True, False, False):
        runs.add(spark.sql(f"SELECT 1L hi, 2L lo, 3L n, 9L last, {hot} hot UNION ALL SELECT 5L, 6L, 1L, 9L, false"))
    assert sorted((r["hi"], r["n"], r["hot"]) for r in runs.whole().collect()) == [(1, 6, True), (5, 3, False)]
    runs.forget()


def test_a_run_is_a_file_a_bucket(spark, monkeypatch):
    """Buckets follow the rows. Before, a run was as many files as the session's shuffles have partitions."""
    files, write = [], lines.Runs.write

    def noted(self, df):
        out = write(self, df)
        files.append((self.buckets, [name.rsplit("_", 1)[1][:5] for name in out.inputFiles()]))
        return out

    monkeypatch.setattr(lines.Runs, "write", noted)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    try:
        for shuffles, limit in (("11", 1 << 19), ("3", 40)):
            spark.conf.set("spark.sql.shuffle.partitions", shuffles)
            monkeypatch.setattr(lines, "BUCKET_ROWS", limit)
            files.clear()
            assert result(lines.drop_repeated_lines(docs)) == want
            assert len(files) == 7 and all(len(names) == len(set(names)) <= buckets for buckets, names in files), files
            assert (files[0][0] == 1) == (limit > 40)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
