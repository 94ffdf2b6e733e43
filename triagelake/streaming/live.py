"""Sessions and first bursts while rows arrive.

Rows may come out of order by a bounded lateness. The engine keeps a watermark, the newest time seen less that
lateness; rows older than it are dropped and counted in the query's progress (`late_rows`). What is emitted is final and
equals the batch operators on the rows that were not dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(rows: DataFrame, threshold_s: float = 3600, lateness: str = "10 minutes", keys: list[str] | None = None) -> DataFrame:
    """Runs of rows no further apart than the threshold: start, end, count; a run is emitted once none can extend it.

    A session window ends its gap behind its last row and shares a row that falls into it, so the gap is a microsecond
    more than the threshold. The state is one row per open session.
    """
    keys = ["host_id"] if keys is None else keys
    gap = F.session_window("date", f"{int(threshold_s * 1_000_000) + 1} microseconds")
    runs = rows.withWatermark("date", lateness).groupBy(*keys, gap).agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("count"))
    return runs.select(*keys, "start", "end", "count")


def first_bursts(rows: DataFrame, keys: list[str], ts: str, k: int, window_s: float, lateness: str = "10 minutes") -> DataFrame:
    """Per key the first k rows within the window: first, last. Emitted once the watermark has passed the last of them.

    Rows wait in the state until the watermark has passed them, so they are looked at in time order; of those passed
    only the last k - 1 times are kept, and nothing once the burst is found.
    """
    width = int(window_s * 1_000_000)
    kinds = {f.name: f.dataType for f in rows.schema}
    out = T.StructType([*[T.StructField(c, kinds[c]) for c in keys], T.StructField("first", T.TimestampType()), T.StructField("last", T.TimestampType())])
    state_type = T.StructType([T.StructField("waiting", T.ArrayType(T.LongType())), T.StructField("passed", T.ArrayType(T.LongType())), T.StructField("done", T.BooleanType())])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, passed, done = map(lambda x: x if isinstance(x, bool) else list(x), state.get) if state.exists else ([], [], False)
        for batch in batches:
            if not done:
                waiting += batch["_us"].tolist()
        mark = state.getCurrentWatermarkMs() * 1000
        ready = sorted(u for u in waiting if u <= mark)
        waiting = [u for u in waiting if u > mark]
        for u in [] if done else ready:
            passed = [*passed, u][-k:]
            if len(passed) == k and u - passed[0] <= width:
                yield pd.DataFrame([[*key, pd.Timestamp(passed[0], unit="us"), pd.Timestamp(u, unit="us")]], columns=out.names)
                waiting, passed, done = [], [], True
                break
        state.update((waiting, passed, done))
        if waiting:
            state.setTimeoutTimestamp(max(min(waiting) // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    timed = rows.withWatermark(ts, lateness).select(*keys, F.col(ts), F.unix_micros(ts).alias("_us"))
    return timed.groupBy(*keys).applyInPandasWithState(step, out, state_type, "append", GroupStateTimeout.EventTimeTimeout)


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped so far because they came behind the watermark."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])
