"""The session settings, on a session of this library and on one that others built."""

import subprocess
import sys
from pathlib import Path

from triagelake.session import RUNTIME_CONF, STATIC_CONF

ROOT = Path(__file__).resolve().parents[1]

GIVEN_SESSION = """
from pyspark.sql import SparkSession
from triagelake.checks import registry
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("annotation_bookmarks", "detect_account_created"):
    print(name, registry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_settings_by_when_they_can_be_made(spark):
    assert all(spark.conf.isModifiable(k) for k in RUNTIME_CONF)
    assert not any(spark.conf.isModifiable(k) for k in STATIC_CONF)
    assert all(spark.conf.get(k) == v for k, v in {**STATIC_CONF, **RUNTIME_CONF}.items())


def test_queries_run_in_a_session_built_by_others():
    done = subprocess.run([sys.executable, "-c", GIVEN_SESSION], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "annotation_bookmarks" in done.stdout and "detect_account_created" in done.stdout
