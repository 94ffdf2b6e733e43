"""Timeline queries over the derived case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.checks.adapters import GivenCase, work_folder
from triagelake.checks.oracle_timeline import MIXED, ROWS
from triagelake.operators import gaps
from triagelake.plans import stored_timeline as st
from triagelake.plans import timeline as tl


def flat(df: DataFrame) -> DataFrame:
    return df.select("host_id", F.unix_micros("date").alias("date_us"), "kind", "source", "path", "size", "is_deleted", "event_id")


def _case(fn):
    return lambda spark, sf: fn(GivenCase(spark, sf))


def _us(df: DataFrame, *names: str) -> DataFrame:
    out = df
    for n in names:
        out = out.withColumn(f"{n}_us", F.unix_micros(n)).drop(n)
    return out


def _branch(name: str):
    return _case(lambda t: flat(tl.BRANCHES[name][1](t)))


PAGED, PLACE, PAGE = ["files", "web_access", "registry"], 7000, 300


def _stored(t) -> str:
    """The timeline of a few tables as a stored one."""
    folder = f"{work_folder(t.spark)}/timeline"
    st.add_hosts(tl.build(t, PAGED), folder)
    return folder


def _keys(df: DataFrame) -> DataFrame:
    return df.select(F.unix_micros("date").alias("date_us"), "host_id", "source", "kind", "path", "event_id")


def page(t) -> DataFrame:
    return _keys(st.page(t.spark, _stored(t), PLACE, PAGE))


def page_after(t) -> DataFrame:
    folder = _stored(t)
    row = st.page(t.spark, folder, PLACE, 1).first()
    return _keys(st.page_after(t.spark, folder, row.asDict(), PAGE))


def stored_pivot(t) -> DataFrame:
    return flat(st.pivot(t.spark, _stored(t), "2024-01-10 12:00:00"))


mixed = lambda t: tl.build(t, MIXED)

QUERIES = {f"timeline_{n}": _branch(n) for n in ROWS}
QUERIES |= {
    "timeline_filtered": _case(lambda t: flat(tl.filtered(t, MIXED, kinds=["C", "M"], sources=["FS", "EVTX", "WEB"], hide_slack=True, query="46", start="1996-01-01", end="2024-01-20"))),
    "timeline_all": _case(lambda t: flat(tl.build(t, MIXED, start="2024-01-05", end="2024-01-20"))),
    "timeline_pivot": _case(lambda t: flat(tl.pivot(mixed(t), "2024-01-10 12:00:00"))),
    "timeline_extent": _case(lambda t: _us(tl.extent(mixed(t), ["host_id"]), "first", "last")),
    "timeline_default_sources": _case(lambda t: tl.default_sources(mixed(t))),
    "timeline_histogram": _case(lambda t: _us(tl.histogram(tl.events(t)), "bucket")),
    "timeline_histogram_months": _case(lambda t: _us(tl.histogram(tl.files(t), ["host_id"]), "bucket")),
    "timeline_sessions": _case(lambda t: _us(gaps.sessions(mixed(t)), "start", "end").drop("duration_s")),
    "timeline_gaps": _case(lambda t: _us(gaps.gaps(mixed(t)), "start", "end").drop("duration_s")),
    "timeline_sessions_all_hosts": _case(lambda t: _us(gaps.sessions(tl.events(t), 600, keys=[]), "start", "end").drop("duration_s")),
    "timeline_longest_gaps": _case(lambda t: _us(gaps.longest(gaps.gaps(mixed(t)), 20), "start", "end").drop("duration_s")),
    "timeline_table_total": _case(lambda t: tl.table_view(mixed(t))[1]),
    "timeline_first_rows": _case(lambda t: tl.table_view(mixed(t))[0].select(F.unix_micros("date").alias("date_us"))),
    "timeline_page": _case(page),
    "timeline_page_after": _case(page_after),
    "timeline_stored_pivot": _case(stored_pivot),
    "timeline_unique_keys": _case(lambda t: tl.count_keys(t, MIXED)),
    "timeline_zoom": _case(lambda t: _us(tl.zoom(tl.extent(tl.events(t), ["host_id"]).withColumn("low", F.lit(None).cast("timestamp")).withColumn("high", F.lit(None).cast("timestamp")), 0.5).select("host_id", "new_low", "new_high"), "new_low", "new_high")),
}
