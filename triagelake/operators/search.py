"""Ranked search over files, events, registry, timeline and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.text import lookup
from triagelake.functions.once import computed
from triagelake.functions.payload import decode_entities
from triagelake.operators.cross_platform import full_path
from triagelake.operators.findings import PHASES, text, union
from triagelake.operators.windows import full_key

# Scores of a match, and what a kind of row adds.
EXACT, PREFIX, NAME, BODY = 100, 70, 50, 20
KIND_BIAS = {"finding": 5, "registry": 4, "event": 3, "timeline": 2, "file": 1}
MIN_QUERY = 2


def squeeze(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"[ \n\r\t]+", " "))


def identifier_score(value: Column, needle: str) -> Column:
    low = F.lower(value)
    return F.when(low == needle, EXACT).when((low != "") & low.startswith(needle), PREFIX).when(low.contains(needle), NAME)


def excerpt(value: Column, needle: str, window: int = 80) -> Column:
    """One line around the first match, with an ellipsis at each cut end; without a match the start."""
    flat = squeeze(value)
    at = F.position(F.lit(needle), F.lower(flat))
    start = F.greatest(F.lit(1), at - max(0, (window - len(needle)) // 2))
    body = F.substring(flat, start, F.lit(window))
    cut = text(F.when(start > 1, "…"), body, F.when(start + window - 1 < F.length(flat), "…"))
    return F.when(flat == "", "").when(at > 0, cut).otherwise(F.substring(flat, 1, window))


def _hits(df: DataFrame, kind: str, title: Column, subtitle: Column, snippet: Column, score: Column, ref: Column) -> DataFrame:
    scored = computed(df, score=(score + KIND_BIAS[kind]).cast("int")).filter(F.col("score").isNotNull())
    return scored.select(
        "host_id", F.lit(kind).alias("kind"), title.alias("title"), subtitle.alias("subtitle"), snippet.alias("snippet"), "score",
        ref.cast("string").alias("reference"),
    )


def search(t, query: str, timeline: DataFrame | None = None, findings: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """All hits of a query, unordered, or the best `limit` of them. Each table is filtered
    and scored where it is read, and the top rows are taken per task before they are merged."""
    needle = query.strip().lower()
    empty = len(needle) < MIN_QUERY or (limit is not None and limit <= 0)
    body = F.lit(BODY)

    f = t["files"]
    name = identifier_score(F.col("name"), needle)
    path = full_path()
    files = _hits(
        f, "file", F.col("name"), F.col("parent_path"), F.when(name.isNotNull(), path).otherwise(excerpt(path, needle)),
        F.coalesce(name, F.when(F.lower(path).contains(needle), body)), text(F.col("id"), "|", path),
    )
    e = computed(t["events"], _text=decode_entities(F.col("payload_xml")))
    e = computed(e, _flat=squeeze(F.col("_text")))
    payload = F.col("_text")
    best = F.greatest(identifier_score(F.col("channel"), needle), identifier_score(F.col("provider"), needle), identifier_score(F.col("event_id").cast("string"), needle))
    flat = F.col("_flat")
    events = _hits(
        e, "event", text(F.col("channel"), " — Event ", F.col("event_id")), F.when(F.col("provider") == "", F.col("computer")).otherwise(F.col("provider")),
        F.when(F.lower(flat).contains(needle), excerpt(flat, needle)).otherwise(F.substring(flat, 1, 120)),
        F.coalesce(best, F.when(F.lower(payload).contains(needle) | F.lower("computer").contains(needle), body)),
        text(F.col("source_file"), "|", F.col("record_number")),
    )
    r = t["registry"]
    full, raw = full_key(r), F.col("data")
    in_data = F.lower(raw).contains(needle)
    name = identifier_score(F.col("name"), needle)
    registry = _hits(
        r, "registry", F.when(F.col("name") == "", "(Default)").otherwise(F.col("name")), full,
        F.when(name.isNotNull(), F.when(raw == "", full).otherwise(excerpt(raw, needle))).when(in_data, excerpt(raw, needle)).otherwise(full),
        F.coalesce(name, F.when(F.lower(full).contains(needle) | F.lower("hive").contains(needle) | in_data, body)),
        text(full, "|", F.col("name")),
    )
    parts = [files, events, registry]
    if timeline is not None:
        from triagelake.plans.timeline import KIND_LABELS, SOURCE_LABELS, stable_key

        rows = timeline.filter(F.lower("path").contains(needle))
        last = F.regexp_extract("path", r"([^/]+)/*$", 1)
        parts.append(_hits(
            rows, "timeline", F.when(last == "", F.col("path")).otherwise(last),
            text(lookup(F.col("source"), SOURCE_LABELS), " · ", lookup(F.col("kind"), KIND_LABELS)), excerpt(F.col("path"), needle),
            F.coalesce(identifier_score(last, needle), body), stable_key(),
        ))
    if findings is not None:
        phase = lookup(F.col("phase"), PHASES)
        attack = F.col("technique.attack_id")
        named = identifier_score(F.col("title"), needle)
        cited = F.exists("evidence", lambda p: F.lower(p).contains(needle))
        elsewhere = F.lower("detail").contains(needle) | F.coalesce(F.lower(attack).contains(needle) | F.lower("technique.name").contains(needle), F.lit(False)) | cited
        parts.append(_hits(
            findings, "finding", F.col("title"), F.when(attack.isNotNull(), text(attack, " · ", phase)).otherwise(phase), excerpt(F.col("detail"), needle),
            F.coalesce(named, F.when(elsewhere, body)), F.sha2(F.concat_ws("|", "rule", "title", "detail"), 256),
        ))
    out = union(parts)
    if empty:
        return out.limit(0)
    if limit is None:
        return out
    return out.orderBy(F.col("score").desc(), "kind", "title", "snippet", "host_id", "reference").limit(limit)
