"""The registry of checks, and a few of them run against DuckDB."""

import duckdb
import pytest

from triagelake.checks import registry
from triagelake.checks.adapters import GIVEN

DATA = "/root/testdata/sf0.001"
NO_SQL = {"search_top"}


def test_every_query_has_sql():
    assert set(registry.queries()) - set(registry.oracle_sql()) == NO_SQL
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", ["lateral_nodes", "detect_web_attacks", "timeline_prefetch", "scan_sudo_log", "detect_powerlog_tools", "entropy_of_documents", "fn_entities"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in GIVEN:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.queries()[name](spark, DATA)
    cur = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = sorted(str([dict(zip(names, r))[c] for c in sorted(names)]) for r in cur.fetchall())
    got = sorted(str([r[c] for c in sorted(df.columns)]) for r in df.collect())
    assert got == want and got
