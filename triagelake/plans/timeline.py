"""The unified timeline: one projection per artifact table, concatenated.

No branch is sorted; order is made by the sink or by the query that needs it, and a
filter on time or source is pushed below the union by the optimizer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions import times
from triagelake.functions.text import basename, code_label, has_bit, human_bytes, human_duration, mask_labels
from triagelake.operators.cross_platform import full_path
from triagelake.operators.findings import text, union
from triagelake.operators.linux import audit_summary
from triagelake.operators.macos import (
    RECENT_LABELS, SECURITY_KINDS, SERVICE_LABELS, install_title, is_sent_mail, knowledge_category, leaf, lookup,
    message_counterpart, message_preview,
)
from triagelake.operators.windows import USN_CREATE, USN_DELETE, USN_REASONS, full_key, lnk_name
from triagelake.session import removed_shuffles

# ---- Fixed values: labels ---------------------------------------------------------------------
SOURCE_LABELS = {
    "FS": "Filesystem", "EVTX": "Event Log", "REG": "Registry", "PF": "Prefetch", "SHIM": "Shimcache",
    "AMC": "Amcache", "LNK": "LNK", "JUMP": "JumpLists", "USN": "USN Journal", "SRUM": "SRUM",
    "BROWSER": "Browser History", "MFT": "MFT", "AUTH": "Auth Log", "LOGIN": "Logins", "SHELL": "Shell History",
    "WEB": "Web Logs", "PKG": "Packages", "JRNL": "Journal", "AUDIT": "Audit", "SYS": "System Log",
    "LAST": "Last Login", "ULOG": "Unified Log", "TCC": "TCC (Privacy)", "KNOW": "KnowledgeC",
    "MREC": "macOS Recent Items", "MSEC": "macOS Security", "MSG": "Messages", "MAIL": "Mail",
    "NET": "Network & Devices", "ACT": "QuickLook & Trash", "DOCV": "Document Versions", "NOTE": "Notifications",
    "PWR": "Powerlog", "INST": "Installs",
}
KIND_LABELS = {"M": "Modified", "A": "Accessed", "C": "MFT changed", "B": "Created"}
# Sources shown by default when they hold rows; the others can be very large.
BOUNDED_SOURCES = [
    "EVTX", "AUTH", "LOGIN", "JRNL", "SYS", "AUDIT", "PKG", "LAST", "WEB", "SHELL", "ULOG", "TCC", "KNOW", "MREC",
    "MSEC", "PF", "BROWSER", "MSG", "MAIL", "NET", "ACT", "DOCV", "NOTE", "PWR", "INST", "SRUM",
]
BROWSER_LABELS = {
    "chrome": "Chrome", "edge": "Edge", "brave": "Brave", "opera": "Opera", "vivaldi": "Vivaldi",
    "firefox": "Firefox", "safari": "Safari", "unknown": "Browser",
}
SRUM_LABELS = {"networkData": "Network usage", "appResourceUsage": "App execution", "networkConnectivity": "Network connection"}
LOGIN_LABELS = {
    "bootTime": "Boot", "userProcess": "Login", "deadProcess": "Logout", "loginProcess": "Login prompt",
    "initProcess": "Init", "newTime": "Clock change", "oldTime": "Clock change", "other": "Other",
}
SYSLOG_LABELS = {
    "usbDevice": "USB device", "massStorage": "Mass storage", "outOfMemory": "Out of memory", "segfault": "Segfault",
    "processKilled": "Process killed", "diskError": "Disk error", "networkError": "Network error",
    "serviceStarted": "Service started", "serviceStopped": "Service stopped", "serviceFailed": "Service failed",
    "crashLoop": "Crash loop", "cronExec": "Cron exec", "suSession": "su", "other": "Other",
}
SYSLOG_NOISE = ["serviceStarted", "serviceStopped", "other"]
NETWORK_LABELS = {
    "wifiNetwork": "Wi-Fi Network", "dhcpLease": "DHCP Lease", "bluetoothDevice": "Bluetooth Device",
    "timeMachine": "Time Machine", "devicePairing": "Device Pairing",
}
ACTIVITY_LABELS = {"quickLook": "QuickLook", "trash": "Trash"}
AUTH_VALUES = {0: "Denied", 1: "Unknown", 2: "Allowed", 3: "Limited"}
SECURITY_SEVERITIES = {
    "info": "Info", "allowed": "Allowed", "warning": "Warning", "blocked": "Blocked", "detected": "Detected",
    "remediated": "Remediated",
}
KNOWLEDGE_LABELS = {
    "appFocus": "App Focus", "appUsage": "App Usage", "appActivity": "App Activity", "display": "Display",
    "deviceLock": "Lock State", "devicePower": "Power", "media": "Media", "safari": "Safari",
    "notification": "Notification", "other": "Other",
}


def rows(
    df: DataFrame, source: str, when: Column, kind, path: Column, *, size=0, deleted=False, event_id=None, file_id=0
) -> DataFrame:
    """Timeline rows of one table; rows without a time are left out."""
    val = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(
        "host_id",
        when.cast("timestamp").alias("date"),
        val(kind).alias("kind"),
        F.lit(source).alias("source"),
        val(file_id).cast("bigint").alias("file_id"),
        path.alias("path"),
        val(size).cast("bigint").alias("size"),
        val(deleted).cast("boolean").alias("is_deleted"),
        val(event_id).cast("bigint").alias("event_id"),
    ).filter(F.col("date").isNotNull())


def unpivot_times(df: DataFrame, pairs: list[tuple[Column, str]]) -> DataFrame:
    """One row per (time, kind) pair of a record, in one pass over the table."""
    pairs = [F.struct(t.alias("t"), F.lit(k).alias("k")) for t, k in pairs]
    return df.withColumn("_m", F.explode(F.filter(F.array(*pairs), lambda p: p["t"].isNotNull())))


def files(t, exclude_slack: bool = False, include_born: bool = True) -> DataFrame:
    df = t["files"]
    if exclude_slack:
        df = df.filter(~F.col("name").endswith("-slack"))
    pairs = [(F.col("modified"), "M"), (F.col("accessed"), "A"), (F.col("changed"), "C")]
    if include_born:
        pairs.append((F.col("created"), "B"))
    df = unpivot_times(df, pairs)
    return rows(df, "FS", F.col("_m.t"), F.col("_m.k"), full_path(), size=F.col("size"), deleted=F.col("is_deleted"), file_id=F.col("id"))


def events(t) -> DataFrame:
    return rows(t["events"], "EVTX", F.col("written_at"), "C", F.col("channel"), event_id=F.col("event_id"))


def usn(t) -> DataFrame:
    mask = F.col("reason_raw")
    path = text(F.col("file_name"), "  [", F.array_join(mask_labels(mask, USN_REASONS), ", "), "]")
    return rows(t["usn"], "USN", F.col("timestamp"), F.when(has_bit(mask, USN_CREATE), "B").otherwise("C"), path, deleted=has_bit(mask, USN_DELETE))


def srum(t) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    size = lambda c: human_bytes(F.coalesce(F.col(c), zero))
    app = F.when(F.col("application") != "", basename(F.col("application"))).otherwise("—")
    summary = (
        F.when(F.col("kind") == "networkData", text("↑ ", size("bytes_sent"), "   ↓ ", size("bytes_received")))
        .when(F.col("kind") == "appResourceUsage", text("read ", size("bytes_read"), "   written ", size("bytes_written")))
        .otherwise(text("connected ", human_duration(F.coalesce("connected_seconds", zero))))
    )
    return rows(t["srum"], "SRUM", F.col("timestamp"), "C", text(app, "  [", lookup(F.col("kind"), SRUM_LABELS), ": ", summary, "]"))


def browser(t) -> DataFrame:
    leafed = F.when((F.col("kind") == "download") & (F.col("target_path") != ""), basename(F.col("target_path")))
    shown = F.coalesce(F.when(F.col("title") != "", F.col("title")), leafed, "url")
    path = text("[", lookup(F.col("browser"), BROWSER_LABELS), " ", F.initcap("kind"), "] ", shown, " — ", F.col("url"))
    return rows(t["browser_history"], "BROWSER", F.col("timestamp"), "C", path)


def messages(t) -> DataFrame:
    path = text("[Messages", F.when(F.col("service").isNotNull(), text(" ", F.col("service"))), "] ", F.when(F.col("is_from_me"), "Sent").otherwise("Received"), " ", message_counterpart(), ": ", message_preview())
    return rows(t["messages"], "MSG", F.col("timestamp"), "C", path)


def mail(t) -> DataFrame:
    sent = is_sent_mail()
    other = F.when(sent, F.col("recipients")).otherwise(F.col("sender"))
    other = F.when(other != "", other).otherwise("unknown")
    subject = F.when(F.col("subject") != "", F.col("subject")).otherwise("(no subject)")
    path = text("[Mail] ", F.when(sent, "Sent to ").otherwise("Received from "), other, ": ", subject)
    return rows(t["mail"], "MAIL", F.coalesce("date_received", "date_sent"), "C", path)


def network(t) -> DataFrame:
    label = lookup(F.col("kind"), NETWORK_LABELS)
    title = F.coalesce(F.when(F.col("name") != "", F.col("name")), "identifier", label)
    path = text("[", label, "] ", title, F.when(F.col("identifier").isNotNull(), text(" (", F.col("identifier"), ")")))
    return rows(t["network"], "NET", F.col("timestamp"), "C", path)


def user_activity(t) -> DataFrame:
    path = text("[", lookup(F.col("kind"), ACTIVITY_LABELS), "] ", F.col("path"), F.when(F.col("detail").isNotNull(), text(" — ", F.col("detail"))))
    return rows(t["user_activity"], "ACT", F.col("timestamp"), "C", path, deleted=F.col("kind") == "trash")


def doc_versions(t) -> DataFrame:
    return rows(t["doc_versions"], "DOCV", F.col("version_time"), "M", text("[Doc Version] ", F.col("file_path")), size=F.coalesce("size", F.lit(0)))


def notifications(t) -> DataFrame:
    what = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.when(F.col("body") != "", F.col("body")), F.lit(""))
    return rows(t["notifications"], "NOTE", F.col("delivered_date"), "C", text("[Notification] ", F.coalesce("app_id", F.lit("app")), ": ", what))


def powerlog(t) -> DataFrame:
    who = F.coalesce(F.when(F.col("process_name") != "", F.col("process_name")), F.when(F.col("bundle_id") != "", F.col("bundle_id")), F.lit("(unknown)"))
    kind = F.col("kind")
    what = (
        F.when(kind == "process", text("process: ", who, F.when(F.col("pid").isNotNull(), text(" (pid ", F.col("pid"), ")"))))
        .when(kind == "appLifecycle", text("app ", F.coalesce("event", F.lit("lifecycle")), ": ", who))
        .when(kind == "frontmost", text("frontmost app: ", who))
        .otherwise(text("network: ", who, " (in ", F.coalesce("bytes_in", F.lit(0)), " / out ", F.coalesce("bytes_out", F.lit(0)), " bytes)"))
    )
    return rows(t["powerlog"], "PWR", F.col("date"), "C", text("[Powerlog] ", what))


def installs(t) -> DataFrame:
    path = text("[Install] ", install_title(), F.when(F.col("version").isNotNull(), text(" ", F.col("version"))), F.when(F.col("process_name").isNotNull(), text(" by ", F.col("process_name"))))
    return rows(t["installs"], "INST", F.col("date"), "B", path)


def registry(t) -> DataFrame:
    keys = t["registry"].filter("last_written IS NOT NULL").select("host_id", "source_file", "hive", "path", "last_written").distinct()
    return rows(keys, "REG", F.col("last_written"), "M", text(full_key(keys), "  [key written]"))


def prefetch(t) -> DataFrame:
    df = t["prefetch"].withColumn("run", F.explode("run_times"))
    return rows(df, "PF", F.col("run"), "C", text(F.col("executable_name"), "  [executed; ", F.col("run_count"), " runs total]"))


def shimcache(t) -> DataFrame:
    return rows(t["shimcache"], "SHIM", F.col("last_modified"), "M", text(F.col("path"), "  [shimcache presence]"))


def amcache(t) -> DataFrame:
    return rows(t["amcache"], "AMC", F.col("registered_at"), "C", text(F.coalesce("full_path", "name"), "  [amcache registered]"))


def lnk(t) -> DataFrame:
    target = F.coalesce("local_path", "network_path")
    df = unpivot_times(t["lnk"], [(F.col("target_modified"), "M"), (F.col("target_accessed"), "A"), (F.col("target_created"), "B")])
    name = lnk_name(F.col("source_file"), target)
    return rows(df, "LNK", F.col("_m.t"), F.col("_m.k"), text(F.coalesce(target, name), "  [lnk: ", name, "]"), size=F.coalesce("target_size", F.lit(0)))


def jumplist(t) -> DataFrame:
    app = F.coalesce("application", "app_id")
    return rows(t["jumplist"], "JUMP", F.col("last_accessed"), "A", text(F.coalesce("target_path", app), "  [jumplist: ", app, "]"))


def auth_log(t) -> DataFrame:
    return rows(t["auth_log"], "AUTH", F.col("timestamp"), "C", text(F.col("process"), ": ", F.col("message")))


def _from_host() -> Column:
    return F.when(F.col("host") != "", text(" from ", F.col("host")))


def logins(t) -> DataFrame:
    what = F.when(F.col("is_failed_login"), "Failed login").otherwise(F.coalesce(lookup(F.col("type"), LOGIN_LABELS), F.lit("Other")))
    return rows(t["logins"], "LOGIN", F.col("timestamp"), "C", text(what, ": ", F.col("user"), " on ", F.col("line"), _from_host()))


def shell_history(t) -> DataFrame:
    return rows(t["shell_history"], "SHELL", F.col("timestamp"), "C", text(F.col("user"), "$ ", F.col("command")))


def web_access(t) -> DataFrame:
    target = F.when(F.col("query").isNotNull(), F.concat("path", F.lit("?"), "query")).otherwise(F.col("path"))
    path = text(F.col("method"), " ", F.col("status"), " ", target, "  [", F.col("client_ip"), "]")
    return rows(t["web_access"], "WEB", F.col("timestamp"), "C", path, size=F.col("bytes"))


def packages(t) -> DataFrame:
    path = text(F.col("manager"), " ", F.initcap("action"), ": ", F.col("package"), F.when(F.col("version").isNotNull(), text(" ", F.col("version"))))
    return rows(t["packages"], "PKG", F.col("timestamp"), F.when(F.col("action") == "install", "B").otherwise("C"), path, deleted=F.col("action").isin("remove", "purge"))


def journald(t) -> DataFrame:
    prog = F.coalesce("identifier", "comm")
    return rows(t["journald"], "JRNL", F.col("timestamp"), "C", text(F.when(prog.isNotNull(), text(prog, ": ")), F.col("message")))


def unified_log(t) -> DataFrame:
    path = text(F.when(F.col("process").isNotNull(), text(F.col("process"), ": ")), F.when(F.col("subsystem").isNotNull(), text("[", F.col("subsystem"), "] ")), F.col("message"))
    return rows(t["unified_log"], "ULOG", F.col("timestamp"), "C", path)


def tcc(t) -> DataFrame:
    label = F.coalesce(lookup(F.col("service"), SERVICE_LABELS), F.regexp_replace("service", "kTCCService", ""))
    client = F.when(F.col("client_type") == 1, leaf(F.col("client"))).otherwise(F.col("client"))
    return rows(t["tcc"], "TCC", F.col("last_modified"), "C", text(label, " → ", client, " (", code_label(F.col("auth_value"), AUTH_VALUES), ")"))


def knowledge(t) -> DataFrame:
    cat = knowledge_category()
    span = F.floor((F.unix_micros("end_date") - F.unix_micros("start_date")) / 1e6)
    on = F.coalesce("value_int", F.lit(0)) == 1
    summary = (
        F.when(cat.isin("appFocus", "appUsage", "appActivity"), text(F.coalesce("value", F.lit("app")), F.when(F.col("end_date") > F.col("start_date"), text(" (", span, "s)"))))
        .when(cat == "display", F.when(on, "Screen on").otherwise("Screen off"))
        .when(cat == "deviceLock", F.when(on, "Locked").otherwise("Unlocked"))
        .when(cat == "devicePower", F.when(on, "Plugged in").otherwise("On battery"))
        .when(cat == "media", text("Now playing: ", F.coalesce("value", F.lit("?"))))
        .when(cat == "safari", F.coalesce("value", F.lit("Safari visit")))
        .when(cat == "notification", text("Notification: ", F.coalesce("value", F.lit("?"))))
        .otherwise(F.coalesce("value", "stream"))
    )
    return rows(t["knowledge"], "KNOW", F.col("start_date"), "C", text(lookup(cat, KNOWLEDGE_LABELS), ": ", summary))


def recent_items(t) -> DataFrame:
    return rows(t["recent_items"], "MREC", F.col("timestamp"), "A", text(lookup(F.col("kind"), RECENT_LABELS), ": ", F.col("title")))


def security_events(t) -> DataFrame:
    path = text("[", lookup(F.col("kind"), SECURITY_KINDS), " ", lookup(F.col("severity"), SECURITY_SEVERITIES), "] ", F.coalesce("path", "signature", "message"))
    return rows(t["security_events"], "MSEC", F.col("timestamp"), "C", path)


def audit(t) -> DataFrame:
    return rows(t["audit"], "AUDIT", F.col("timestamp"), "C", text(F.col("record_type"), ": ", audit_summary()))


def syslog(t) -> DataFrame:
    df = t["syslog"].filter(~F.col("category").isin(SYSLOG_NOISE))
    return rows(df, "SYS", F.col("timestamp"), "C", text("[", lookup(F.col("category"), SYSLOG_LABELS), "] ", F.col("process"), ": ", F.col("message")))


def lastlog(t) -> DataFrame:
    account = F.coalesce("user", text("uid ", F.col("uid")))
    return rows(t["lastlog"], "LAST", F.col("timestamp"), "A", text("Last login: ", account, " on ", F.col("line"), _from_host()))


def mft(t) -> DataFrame:
    pairs = [(times.from_filetime(F.col(c)), k) for c, k in (("si_modified_raw", "M"), ("si_accessed_raw", "A"), ("si_changed_raw", "C"), ("si_created_raw", "B"))]
    df = unpivot_times(t["mft"].filter("file_name IS NOT NULL"), pairs)
    return rows(df, "MFT", F.col("_m.t"), F.col("_m.k"), F.coalesce("full_path", "file_name"), size=F.coalesce("size", F.lit(0)), deleted=~F.col("in_use"))


BRANCHES: dict[str, tuple[str, Callable]] = {
    "files": ("FS", files), "events": ("EVTX", events), "usn": ("USN", usn), "srum": ("SRUM", srum),
    "browser_history": ("BROWSER", browser), "messages": ("MSG", messages), "mail": ("MAIL", mail),
    "network": ("NET", network), "user_activity": ("ACT", user_activity), "doc_versions": ("DOCV", doc_versions),
    "notifications": ("NOTE", notifications), "powerlog": ("PWR", powerlog), "installs": ("INST", installs),
    "registry": ("REG", registry), "prefetch": ("PF", prefetch), "shimcache": ("SHIM", shimcache),
    "amcache": ("AMC", amcache), "lnk": ("LNK", lnk), "jumplist": ("JUMP", jumplist), "auth_log": ("AUTH", auth_log),
    "logins": ("LOGIN", logins), "shell_history": ("SHELL", shell_history), "web_access": ("WEB", web_access),
    "packages": ("PKG", packages), "journald": ("JRNL", journald), "unified_log": ("ULOG", unified_log),
    "tcc": ("TCC", tcc), "knowledge": ("KNOW", knowledge), "recent_items": ("MREC", recent_items),
    "security_events": ("MSEC", security_events), "audit": ("AUDIT", audit), "syslog": ("SYS", syslog),
    "lastlog": ("LAST", lastlog), "mft": ("MFT", mft),
}


def build(t, tables: Iterable[str] | None = None, *, sources: Iterable[str] | None = None, exclude_slack: bool = False, include_born: bool = True, start=None, end=None) -> DataFrame:
    """The timeline of all supplied tables (or the named ones, or those behind some sources), optionally within a closed
    range. Branches that are not asked for are not built."""
    names = list(tables) if tables is not None else [n for n in BRANCHES if t.supplied(n)]
    if sources is not None:
        sources = set(sources)
        names = [n for n in names if BRANCHES[n][0] in sources]
    none = not names
    names = names or ["files"]
    parts = [
        files(t, exclude_slack, include_born) if n == "files" else BRANCHES[n][1](t)
        for n in names
    ]
    out = union(parts)
    if none:
        out = out.limit(0)
    if start is not None:
        out = out.filter(F.col("date") >= F.lit(start))
    if end is not None:
        out = out.filter(F.col("date") <= F.lit(end))
    return out


# ---- Queries over the timeline ----------------------------------------------------------------
def stable_key() -> Column:
    """Key of a row that is the same on every run: source, kind, time, event id and path."""
    parts = F.concat_ws("|", "source", "kind", F.unix_micros("date").cast("string"), F.coalesce("event_id", F.lit(0)).cast("string"), "path")
    return F.sha2(parts, 256)


def count_keys(t, tables: Iterable[str]) -> DataFrame:
    """The number of distinct stable keys in the timeline of some tables. Runs a job for each source.

    A key begins with its source, so no two sources share one, and each is counted alone. What a job has shuffled is
    removed when it ends: the disk holds the keys of one source, not of all, and those as 32 bytes instead of 64 digits.
    """
    by_source: dict[str, list[str]] = {}
    for name in tables:
        by_source.setdefault(BRANCHES[name][0], []).append(name)
    counts = []
    with removed_shuffles(t.spark):
        for names in by_source.values():
            keys = build(t, names).select(F.unhex(stable_key()).alias("k")).distinct()
            counts.append((keys.count(),))
    return t.spark.createDataFrame(counts, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def filtered(t, tables: Iterable[str] | None = None, *, sources: Iterable[str] | None = None, **filters) -> DataFrame:
    """The filtered timeline, built from the tables that can hold rows of the wanted sources."""
    return filter_rows(build(t, tables, sources=sources), sources=sources, **filters)


def filter_rows(
    timeline: DataFrame, *, kinds=None, sources=None, hide_slack: bool = False, bookmarks: DataFrame | None = None,
    query: str = "", start=None, end=None,
) -> DataFrame:
    """Kind and source sets, slack names, bookmarked rows, text and closed time range."""
    out = timeline
    if kinds is not None:
        out = out.filter(F.col("kind").isin(list(kinds)))
    if sources is not None:
        out = out.filter(F.col("source").isin(list(sources)))
    if hide_slack:
        out = out.filter(~F.col("path").endswith("-slack"))
    if query:
        by_id = F.coalesce(F.col("event_id").cast("string").contains(query), F.lit(False))
        out = out.filter(F.lower("path").contains(query.lower()) | by_id)
    if start is not None:
        out = out.filter(F.col("date") >= F.lit(start))
    if end is not None:
        out = out.filter(F.col("date") <= F.lit(end))
    if bookmarks is not None:
        keys = bookmarks.filter("target_kind = 'timelineEvent'").select(F.col("target_key").alias("_key"))
        out = out.withColumn("_key", stable_key()).join(keys, "_key", "left_semi").drop("_key")
    return out


def pivot(timeline: DataFrame, moment, pad_minutes: int = 30) -> DataFrame:
    """Rows within the padding around a moment, ends included."""
    at = F.lit(moment).cast("timestamp")
    pad = F.make_dt_interval(mins=F.lit(pad_minutes))
    return timeline.filter(F.col("date").between(at - pad, at + pad))


def extent(timeline: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return timeline.groupBy(*(keys or [])).agg(F.min("date").alias("first"), F.max("date").alias("last"))


def zoom(span: DataFrame, factor: float, min_half_s: float = 60.0) -> DataFrame:
    """New range for rows with first/last (the full extent) and low/high (the visible range).

    The visible range is scaled about its middle, kept at two minutes or more, and cut to
    the extent. A zoom out that reaches the whole extent clears the range (both null);
    an empty result keeps the old one.
    """
    us = lambda c: F.unix_micros(c)
    low, high = F.coalesce("low", "first"), F.coalesce("high", "last")
    mid = us(low) + (us(high) - us(low)) / 2
    half = F.greatest((us(high) - us(low)) / 2 * factor, F.lit(min_half_s * 1e6))
    start = F.greatest(mid - half, us("first").cast("double"))
    end = F.least(mid + half, us("last").cast("double"))
    whole = F.lit(factor > 1) & (start == us("first")) & (end == us("last"))
    stamp = lambda c: F.timestamp_micros(F.round(c).cast("bigint"))
    return span.select(
        "*",
        F.when(start >= end, F.col("low")).when(~whole, stamp(start)).alias("new_low"),
        F.when(start >= end, F.col("high")).when(~whole, stamp(end)).alias("new_high"),
    )


def default_sources(timeline: DataFrame) -> DataFrame:
    """Non-empty bounded sources per host; a host with none of them shows the file system."""
    counts = timeline.groupBy("host_id", "source").agg(F.count(F.lit(1)).alias("n"))
    bounded = F.col("source").isin(BOUNDED_SOURCES)
    per_host = counts.groupBy("host_id").agg(F.sort_array(F.collect_list(F.when(bounded, F.col("source")))).alias("s"))
    fallback = F.when(F.size("s") == 0, F.array(F.lit("FS"))).otherwise(F.col("s"))
    return per_host.select("host_id", F.explode(fallback).alias("source"))


def histogram(timeline: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts per day, week, month or year, the unit chosen by the span of each key."""
    keys = keys or []
    per_day = timeline.groupBy(*keys, F.date_trunc("day", "date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi")
    )
    spans = per_day.groupBy(*keys).agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
    days = F.greatest(F.lit(1), F.floor((F.unix_micros("last") - F.unix_micros("first")) / 86_400_000_000))
    unit = F.when(days < 120, "day").when(days < 800, "week").when(days < 8000, "month").otherwise("year")
    spans = spans.select(*keys, unit.alias("unit"))
    joined = per_day.join(spans, keys) if keys else per_day.join(F.broadcast(spans))
    bucket = F.date_trunc("day", "day")
    for name in ("week", "month", "year"):
        bucket = F.when(F.col("unit") == name, F.date_trunc(name, "day")).otherwise(bucket)
    return joined.groupBy(*keys, "unit", bucket.alias("bucket")).agg(F.sum("n").alias("n"))


def table_view(timeline: DataFrame, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows in time order (the first `cap` if that is given) and the total they are taken from."""
    rows = timeline.orderBy("date", "host_id", "source", "kind", "path", "event_id")
    return rows if cap is None else rows.limit(cap), timeline.agg(F.count(F.lit(1)).alias("total"))
