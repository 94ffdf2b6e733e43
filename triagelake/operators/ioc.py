"""Indicators: classification, ingest and matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.once import computed
from triagelake.functions.payload import decode_entities, with_fields
from triagelake.functions.substring import prepare, substring_pairs
from triagelake.operators.cross_platform import full_path
from triagelake.operators.findings import text, union
from triagelake.operators.windows import full_key

# Display names of indicator kinds.
KIND_LABELS = {"ip": "IP", "domain": "Domain", "url": "URL", "hash": "Hash"}
LOCATION = "struct<type:string,event_id:bigint,record_number:bigint,channel:string,source_file:string,hive:string,path:string,name:string>"


def classify(token: Column) -> Column:
    """url by scheme, hash by length and hex digits, ip by form, else domain."""
    s = F.lower(F.regexp_replace(token, r"^\s+|\s+$", ""))
    parts = F.filter(F.split(s, r"\."), lambda p: p != "")
    v4 = (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike(r"^[+-]?[0-9]+$") & F.coalesce(p.try_cast("int").between(0, 255), F.lit(False)))
    v6 = s.contains(":") & s.rlike("^[0-9a-f:]*$")
    hashed = s.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$")
    return F.when(s.startswith("http://") | s.startswith("https://"), "url").when(hashed, "hash").when(v4 | v6, "ip").otherwise("domain")


def ingest(pasted: DataFrame, existing: DataFrame) -> DataFrame:
    """New indicators of pasted lines (line_no, line): comments dropped, tokens split and trimmed,
    values already known (in any case) left out, the first spelling kept."""
    lines = pasted.filter(~F.trim("line").startswith("#"))
    tokens = lines.select("line_no", F.posexplode(F.split("line", "[,;\\n\\r\\t ]")).alias("pos", "token"))
    tokens = tokens.withColumn("value", F.regexp_replace("token", "^[\"'<>]+|[\"'<>]+$", "")).filter("value <> ''")
    firsts = tokens.groupBy(F.lower("value").alias("key")).agg(
        F.min_by("value", F.struct("line_no", "pos")).alias("value"), F.min(F.struct("line_no", "pos")).alias("at")
    )
    known = existing.select(F.lower("value").alias("key")).distinct()
    return firsts.join(known, "key", "left_anti").select(classify(F.col("value")).alias("kind"), "value", F.col("at.line_no"), F.col("at.pos"))


def standalone_pattern(needle: Column) -> Column:
    """Pattern for an address that is not part of a longer one."""
    quoted = F.concat(F.lit(r"\Q"), needle, F.lit(r"\E"))
    v6 = F.concat(F.lit("(?<![0-9a-f:])"), quoted, F.lit("(?![0-9a-f:])"))
    v4 = F.concat(F.lit(r"(?<![0-9])(?<![0-9]\.)"), quoted, F.lit(r"(?![0-9])(?!\.[0-9])"))
    return F.when(needle.contains(":"), v6).otherwise(v4)


def _matched(rows: DataFrame, needles: DataFrame, prepared: tuple) -> DataFrame:
    """Rows joined to the needles in their `hay`, with the 1-based position of the match."""
    pairs = substring_pairs(rows, "hay", needles, prepared)
    at = F.when(F.col("ioc_kind") == "ip", F.regexp_instr(F.col("hay"), standalone_pattern(F.col("needle")))).otherwise(F.position(F.col("needle"), F.col("hay")))
    return pairs.withColumn("at", at).filter(F.col("at") > 0)


def _location(kind: str, **fields: Column) -> Column:
    none = F.lit(None)
    names = ["event_id", "record_number", "channel", "source_file", "hive", "path", "name"]
    return F.struct(F.lit(kind).alias("type"), *[fields.get(n, none).alias(n) for n in names]).cast(LOCATION)


def match(t, iocs: DataFrame | None = None, span: int = 80) -> DataFrame:
    """Hits of the indicators in event payloads, registry values and file paths.

    An address indicator needs a standalone address. A logon event whose source address
    equals one gives a structured hit next to the payload hit.
    """
    iocs = (iocs if iocs is not None else t["iocs"]).filter("value <> ''")
    needles = iocs.groupBy(F.lower("value").alias("needle"), "kind").agg(F.min("value").alias("ioc_value")).withColumnRenamed("kind", "ioc_kind")
    prepared = prepare(needles)
    keep = ["host_id", "ioc_value", "ioc_kind", "location", "context", "timestamp"]

    ev = t["events"]
    logon = ev.filter("event_id IN (4624, 4625)")
    logon = with_fields(logon, _ip="IpAddress").withColumn("ip", F.lower("_ip")).filter("ip IS NOT NULL")
    addresses = needles.filter("ioc_kind = 'ip'").select(F.col("needle").alias("ip")).distinct()
    structured = logon.join(addresses, "ip").select(
        "host_id",
        F.col("ip").alias("ioc_value"),
        F.lit("ip").alias("ioc_kind"),
        _location("event", event_id=F.col("event_id"), record_number=F.col("record_number"), channel=F.col("channel"), source_file=F.col("source_file")).alias("location"),
        text("Structured logon source ", F.col("ip")).alias("context"),
        F.col("written_at").alias("timestamp"),
    )
    keep_ev = ["host_id", "event_id", "record_number", "channel", "source_file", "written_at"]
    payload = computed(ev.select(*keep_ev, "payload_xml"), hay=F.lower(decode_entities(F.col("payload_xml")))).drop("payload_xml").filter("hay <> ''")
    hit = _matched(payload, needles, prepared)
    start = F.greatest(F.lit(1), F.col("at") - span)
    stop = F.col("at") + F.length("needle") + span
    in_events = hit.select(
        "host_id", "ioc_value", "ioc_kind",
        _location("event", event_id=F.col("event_id"), record_number=F.col("record_number"), channel=F.col("channel"), source_file=F.col("source_file")).alias("location"),
        F.substring("hay", start, stop - start).alias("context"),
        F.col("written_at").alias("timestamp"),
    )
    reg = t["registry"]
    reg = reg.select("host_id", "hive", "path", "name", "data", "last_written", F.lower(F.concat_ws(" ", "data", full_key(reg))).alias("hay"))
    in_registry = _matched(reg, needles, prepared).select(
        "host_id", "ioc_value", "ioc_kind",
        _location("registry", hive=F.col("hive"), path=F.col("path"), name=F.col("name")).alias("location"),
        F.col("data").alias("context"),
        F.col("last_written").alias("timestamp"),
    )
    files = t["files"].select("host_id", full_path().alias("p"), F.coalesce("modified", "created").alias("timestamp"), F.lower(full_path()).alias("hay"))
    in_files = _matched(files, needles, prepared).select(
        "host_id", "ioc_value", "ioc_kind", _location("file", path=F.col("p")).alias("location"), F.col("p").alias("context"), "timestamp"
    )
    return union([d.select(keep) for d in (structured, in_events, in_registry, in_files)])


def location_summary() -> Column:
    """Where a hit was found, in one line."""
    at = lambda f: F.col(f"location.{f}")
    return (
        F.when(at("type") == "event", text(at("channel"), " EID ", at("event_id")))
        .when(at("type") == "registry", F.when(at("name") == "", at("path")).otherwise(text(at("path"), "\\", at("name"))))
        .otherwise(at("path"))
    )


def load_set(lines: DataFrame) -> DataFrame:
    """A hash list of lines: trimmed, lower case, blank and comment lines left out."""
    clean = F.lower(F.regexp_replace("line", r"^\s+|\s+$", ""))
    return lines.select(clean.alias("value")).filter((F.col("value") != "") & ~F.col("value").startswith("#")).distinct()
