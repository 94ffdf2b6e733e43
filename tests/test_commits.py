"""Stored tables: one-step changes, host pruning, merges that touch few parts, conflicts."""

import pytest
from pyspark.sql import functions as F

from triagelake import commits
from triagelake.operators import casebook
from triagelake.tables import CaseTables, append_table, merge_table, read_table, write_table

HISTORY = "host_id string, user string, command string, line_number int"


def files(spark, root, name):
    return {r["file"] for r in read_table(spark, root, name).select(F.input_file_name().alias("file")).distinct().collect()}


def commands(df):
    return sorted((r["host_id"], r["command"]) for r in df.collect())


@pytest.fixture
def root(spark, tmp_path):
    rows = [(f"h {i}/x", "u", f"c{j}", j) for i in range(4) for j in range(3)]
    write_table(spark.createDataFrame(rows, HISTORY), str(tmp_path), "shell_history")
    return str(tmp_path)


def test_a_host_is_replaced_and_the_others_keep_their_files(spark, root):
    before = files(spark, root, "shell_history")
    write_table(spark.createDataFrame([("h 1/x", "u", "new", 9), ("h 9/x", "u", "first", 1)], HISTORY), root, "shell_history")
    got = commands(read_table(spark, root, "shell_history"))
    assert ("h 1/x", "new") in got and ("h 1/x", "c0") not in got and ("h 9/x", "first") in got and len(got) == 11
    kept = files(spark, root, "shell_history") & before
    assert len(kept) == len({f for f in before if "h%201" not in f and "h%25201" not in f and "h 1" not in f})
    assert commands(read_table(spark, root, "shell_history", ["h 1/x", "none"])) == [("h 1/x", "new")]
    assert len(commands(read_table(spark, root, "shell_history", at=1))) == 12
    assert commands(CaseTables.open(spark, root)["shell_history"]) == got


def test_a_stopped_write_changes_nothing(spark, root):
    before = commands(read_table(spark, root, "shell_history"))
    bad = spark.range(200).select(F.lit("h 0/x").alias("host_id"), F.when(F.col("id") == 199, F.raise_error(F.lit("stop"))).otherwise("x").alias("command"))
    with pytest.raises(Exception, match="stop"):
        write_table(bad, root, "shell_history")
    # Files without a commit, as a killed writer leaves them, and a half-written commit.
    commits.stage(read_table(spark, root, "shell_history"), f"{root}/shell_history", True)
    (lambda p: open(p, "w").write("{"))(f"{root}/shell_history/commits/.0123")
    assert commands(read_table(spark, root, "shell_history")) == before
    assert commits.drop_unnamed(spark, f"{root}/shell_history") >= 1
    assert commands(read_table(spark, root, "shell_history")) == before


def test_a_table_reads_itself_while_it_is_replaced(spark, root):
    rows = read_table(spark, root, "shell_history")
    write_table(rows.withColumn("command", F.upper("command")), root, "shell_history")
    assert {c for _, c in commands(read_table(spark, root, "shell_history"))} == {"C0", "C1", "C2"}


def test_two_writers(spark, root):
    path = f"{root}/shell_history"
    base, batches = commits.last_commit(spark, path)
    append_table(spark.createDataFrame([("h 0/x", "u", "one", 1)], HISTORY), root, "shell_history")
    with pytest.raises(commits.CommitConflict):
        commits.commit(spark, path, base, batches)
    append_table(spark.createDataFrame([("h 0/x", "u", "two", 1)], HISTORY), root, "shell_history")
    got = [c for h, c in commands(read_table(spark, root, "shell_history")) if h == "h 0/x"]
    assert got == ["c0", "c1", "c2", "one", "two"]


def test_merge_rewrites_touched_hosts_only(spark, root):
    before = files(spark, root, "shell_history")
    newest = lambda now, new: now.unionByName(new).groupBy("host_id", "line_number").agg(F.max("command").alias("command"), F.max("user").alias("user"))
    merge_table(spark.createDataFrame([("h 2/x", "u", "z", 1), ("h 7/x", "u", "y", 0)], HISTORY), root, "shell_history", newest)
    after = files(spark, root, "shell_history")
    assert len(before - after) == len([f for f in before if "h%202" in f or "h%25202" in f or "h 2" in f]) > 0
    got = commands(read_table(spark, root, "shell_history"))
    assert [c for h, c in got if h == "h 2/x"] == ["c0", "c2", "z"] and ("h 7/x", "y") in got and len(got) == 13
    merge_table(spark.createDataFrame([("h 2/x", "u", "z", 1)], HISTORY), root, "shell_history", lambda now, new: now.limit(0))
    assert "h 2/x" not in {h for h, _ in commands(read_table(spark, root, "shell_history"))}


def test_annotations_and_custody(spark, tmp_path):
    root = str(tmp_path)
    ddl = "target_kind string, target_key string, tag string, note string, author string, created_at timestamp, modified_at timestamp"
    stamp = lambda df: df.withColumn("created_at", F.timestamp_seconds("c")).withColumn("modified_at", F.timestamp_seconds("m")).drop("c", "m")
    plain = ddl.replace("created_at timestamp, modified_at timestamp", "c int, m int")
    casebook.store_annotations(stamp(spark.createDataFrame([("finding", "k1", "benign", "n1", "ann", 1, 1), ("finding", "k2", None, "n2", "ann", 1, 1)], plain)), root)
    casebook.store_annotations(stamp(spark.createDataFrame([("finding", "k1", "malicious", "n3", "", 5, 5)], plain)), root)
    got = {r["target_key"]: (r["tag"], r["note"], r["author"]) for r in read_table(spark, root, "annotations").collect()}
    assert got == {"k1": ("malicious", "n3", "ann"), "k2": (None, "n2", "ann")}
    entry = lambda n: spark.createDataFrame([(f"a{n}", "bob", "d", "h")], "action string, actor string, detail string, host_id string")
    casebook.append_custody(entry(1), root)
    first = files(spark, root, "custody")
    casebook.append_custody(entry(2), root)
    assert first < files(spark, root, "custody")
    assert sorted(r["action"] for r in read_table(spark, root, "custody").collect()) == ["a1", "a2"]
