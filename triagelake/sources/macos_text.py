"""macOS text files: security logs, crontabs, periodic and rc scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.text import contains_any, first_match
from triagelake.sources.lines import FILE, ORDER, extract, strip
from triagelake.sources.linux_logs import MONTHS
from triagelake.tables import conform

# ---- Fixed values: words that decide kind and severity, in order ------------------------------
RELEVANT = ["xprotect", "xprotectremediator", "mrt", "gatekeeper", "syspolicyd", "spctl", "malware", "notarization"]
SOURCE_KINDS = [
    ("xprotectremediator", "xprotectRemediator"), ("xprotect", "xprotect"), ("mrt", "mrt"), ("gatekeeper", "gatekeeper"),
    ("syspolicyd", "syspolicyd"),
]
LINE_KINDS = [
    ("xprotectremediator", "xprotectRemediator"), ("xprotect", "xprotect"), ("mrt", "mrt"), ("gatekeeper", "gatekeeper"),
    ("spctl", "gatekeeper"), ("syspolicyd", "syspolicyd"),
]
SEVERITIES = [
    (["detected", "malware", "threat"], "detected"),
    (["blocked", "denied", "rejected", "quarantine"], "blocked"),
    (["remediated", "removed", "cleaned", "deleted"], "remediated"),
    (["warning", "failed", "error", "invalid"], "warning"),
    (["allowed", "accepted", "notarized", "passed"], "allowed"),
]
SIGNATURE_MARKERS = ["signature:", "malware:", "threat:", "name:"]


def _signature(body: Column) -> Column:
    values = []
    for marker in SIGNATURE_MARKERS:
        rest = F.trim(F.regexp_extract(body, rf"(?is)^.*?{marker}(.*)$", 1))
        value = F.regexp_replace(F.regexp_extract(rest, r"(?s)^,*([^,]*)", 1), r"^[ \t\"'\[\](){}]+|[ \t\"'\[\](){}]+$", "")
        values.append(F.when(F.lower(body).contains(marker) & (F.length(value) >= 2), value))
    return F.coalesce(*values)


def _first_path(body: Column) -> Column:
    words = F.split(body, r"[\s\"'()\[\]{}<>,;]")
    clean = F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, r"^(?:(?![/~])\p{P}|/(?=$))+", ""), r"\p{P}+$", ""))
    # A leading slash is what makes a path; other punctuation at the ends goes.
    hits = F.filter(clean, lambda w: w.startswith("/") | w.startswith("~/") | F.lower(w).contains(".app/") | F.lower(w).endswith(".app"))
    return F.get(hits, F.lit(0))


def security_log(lines: DataFrame, scope: str, year: int) -> DataFrame:
    """Gatekeeper, XProtect and MRT lines. Stamps without a year get the year passed in."""
    line = F.regexp_replace("line", r"^\s+|\s+$", "")
    source = first_match([(F.lower("source_file").contains(t), k) for t, k in SOURCE_KINDS])
    df = lines.withColumn("t", line).withColumn("src", source)
    df = df.filter((F.length("t") >= 4) & (F.col("src").isNotNull() | contains_any(F.lower("t"), RELEVANT)))
    t = F.col("t")
    iso = F.when(t.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ"), F.try_to_timestamp(F.substring(t, 1, 20)))
    plain = F.coalesce(
        F.try_to_timestamp(F.substring(t, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(F.substring(t, 1, 19), F.lit("yyyy/MM/dd HH:mm:ss"))
    )
    short = r"^([A-Z][a-z]{2}) +([0-9]{1,2}) ([0-9]{2}):([0-9]{2}):([0-9]{2})$"
    cut = F.substring(t, 1, 15)
    month = F.element_at(F.create_map(*[x for i, m in enumerate(MONTHS) for x in (F.lit(m), F.lit(i + 1))]), F.regexp_extract(cut, short, 1))
    part = lambda i: F.regexp_extract(cut, short, i).try_cast("int")
    bsd = F.when(cut.rlike(short), F.try_make_timestamp(F.lit(year), month, part(2), part(3), part(4), part(5)))
    used = F.when(iso.isNotNull(), 20).when(plain.isNotNull(), 19).when(bsd.isNotNull(), 15).otherwise(0)
    body = F.regexp_replace(F.substring(t, used + 1, F.length(t)), r"^\s+|\s+$", "")
    df = df.select(*FILE, "src", F.coalesce(iso, plain, bsd).alias("timestamp"), body.alias("message")).filter("message <> ''")
    low = F.lower("message")
    kind = F.coalesce(first_match([(low.contains(w), k) for w, k in LINE_KINDS]), "src", F.lit("other"))
    severity = F.coalesce(first_match([(contains_any(low, words), s) for words, s in SEVERITIES]), F.lit("info"))
    out = df.select(
        *FILE, kind.alias("kind"), severity.alias("severity"), "timestamp",
        extract(F.trim(F.regexp_extract("message", r"^([^\[]*)\[", 1)), r"([^ ]+)$").alias("process"), "message",
        _first_path(F.col("message")).alias("path"), _signature(F.col("message")).alias("signature"), F.lit(scope).alias("scope"),
    )
    return conform(out.dropDuplicates(["host_id", "source_file", "timestamp", "kind", "message"]), "security_events")


def crontab(lines: DataFrame, system: bool, default_user: Column | None = None) -> DataFrame:
    """Jobs of a crontab, with a user column in the system one."""
    df = lines.withColumn("t", strip(F.col("line")))
    t = F.col("t")
    df = df.filter((t != "") & ~t.startswith("#") & (t.startswith("@") | ~t.rlike("^[^= ]*=")))
    w = F.filter(F.split(t, " "), lambda x: x != "")
    df = df.withColumn("w", w).withColumn("at", t.startswith("@"))
    n = F.when(F.col("at"), 1).otherwise(5)
    size = F.size("w")
    user_col = F.when(F.col("at"), size >= 3).otherwise(F.lit(True)) if system else F.lit(False)
    need = F.when(F.col("at"), 2).otherwise(F.lit(7 if system else 6))
    skip = n + F.when(user_col, 1).otherwise(0)
    default = default_user if default_user is not None else F.lit(None).cast("string")
    df = df.filter(size >= need)
    out = df.select(
        *FILE, F.lit("cron").alias("kind"), F.array_join(F.slice("w", F.lit(1), n), " ").alias("schedule"),
        F.when(user_col, F.get("w", n)).otherwise(default).alias("user"), F.array_join(F.slice("w", skip + 1, size - skip), " ").alias("command"),
    )
    return conform(out.filter("command <> ''"), "mac_persistence")


def periodic_scripts(files: DataFrame) -> DataFrame:
    """Scripts in the periodic folders, from (host_id, path) rows."""
    low = F.lower("path")
    cadence = first_match([(low.contains(f"/periodic/{c}"), c) for c in ("daily", "weekly", "monthly")])
    out = files.select("host_id", F.lit("periodic").alias("kind"), cadence.alias("schedule"), F.col("path").alias("command"), F.regexp_extract("path", r"([^/]+)/*$", 1).alias("name"), F.col("path").alias("source_file"))
    return conform(out, "mac_persistence")


def rc_scripts(lines: DataFrame) -> DataFrame:
    """One row per command of an rc script."""
    df = lines.withColumn("t", strip(F.col("line")))
    live = df.filter((F.col("t") != "") & ~F.col("t").startswith("#"))
    out = live.select(*FILE, F.lit("rcScript").alias("kind"), F.col("t").alias("command"), F.regexp_extract("source_file", r"([^/]+)/*$", 1).alias("name"))
    return conform(out, "mac_persistence")
