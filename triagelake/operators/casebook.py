"""Notes, custody, look-ups, host facts and integrity of a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions import times
from triagelake.functions.text import any_of, contains_any
from triagelake.operators.correlation import has_login_shell
from triagelake.operators.cross_platform import full_path
from triagelake.sources.contents import digests
from triagelake.tables import append_table, merge_table


# ---- Annotations and custody ------------------------------------------------------------------
def upsert_annotations(current: DataFrame, edits: DataFrame) -> DataFrame:
    """Tag and note of the newest edit per target; what the target is stays as first recorded.

    An empty author in an edit keeps the author already on record.
    """
    rows = current.unionByName(edits, allowMissingColumns=True)
    at = F.struct("modified_at", "created_at", F.coalesce("note", F.lit("")).alias("n"))
    fixed = [c for c in rows.columns if c not in ("target_key", "tag", "note", "author", "modified_at")]
    out = rows.groupBy("target_key").agg(
        F.max_by(F.struct("tag", "note", "modified_at"), at).alias("new"),
        F.max_by("author", F.when(F.coalesce("author", F.lit("")) != "", at)).alias("author"),
        F.min_by(F.struct(*fixed), at).alias("old"),
    )
    return out.select("target_key", F.coalesce("author", F.lit("")).alias("author"), "new.*", *[F.col(f"old.{c}").alias(c) for c in fixed])


def bookmarks(annotations: DataFrame, tag: str | None = None) -> DataFrame:
    """Annotations by the time of their target, undated last, then by creation."""
    rows = annotations if tag is None else annotations.filter(F.col("tag") == tag)
    return rows.orderBy(F.col("timestamp").asc_nulls_last(), "created_at", "target_key")


def store_annotations(edits: DataFrame, root: str) -> int:
    """Upserts edits into the stored annotations in one step; returns the commit's number."""
    return merge_table(edits, root, "annotations", upsert_annotations)


def append_custody(entries: DataFrame, root: str) -> int:
    """Adds to the ledger; nothing already there is rewritten. Returns the commit's number."""
    return append_table(entries, root, "custody")


# ---- Look-ups ---------------------------------------------------------------------------------
def path_key(path: Column) -> Column:
    return F.lower(F.regexp_replace(path, r"^\s+|\s+$", ""))


def _first_fact(rows: DataFrame, order: list[str], facts: list[str]) -> DataFrame:
    """The first row per key and whether another row of the key states something else."""
    packed = rows.select("host_id", "key", F.struct(*order).alias("at"), F.struct(*facts).alias("fact"))
    once = packed.groupBy("host_id", "key", "fact").agg(F.min("at").alias("at"))
    return once.groupBy("host_id", "key").agg(F.min_by("fact", "at").alias("fact"), (F.count(F.lit(1)) > 1).alias("ambiguous")).select("host_id", "key", "fact.*", "ambiguous")


def file_facts(t, findings: DataFrame) -> DataFrame:
    """Size, state and times of the files that findings cite."""
    cited = findings.select("host_id", F.explode("evidence").alias("p"))
    wanted = cited.select("host_id", path_key(F.col("p")).alias("key")).distinct()
    rows = t["files"].filter("NOT is_directory").withColumn("path", full_path()).withColumn("key", path_key(F.col("path")))
    return _first_fact(rows.join(wanted, ["host_id", "key"], "left_semi"), ["id", "size", "is_deleted", "modified", "created"], ["path", "size", "is_deleted", "created", "modified"])


def download_origin_facts(t) -> DataFrame:
    """Where each file came from, by its own record of download URLs."""
    rows = t["where_froms"].select("host_id", "path", path_key(F.col("path")).alias("key"), F.get("urls", F.lit(0)).alias("download_url"), F.get("urls", F.lit(1)).alias("referrer"))
    return _first_fact(rows, ["path", "download_url", "referrer"], ["path", "download_url", "referrer"])


# ---- Host facts -------------------------------------------------------------------------------
MAC_MARKERS = ["/system/library/", "/library/preferences/", ".app/contents/", "/private/var/db/"]
LINUX_MARKERS = ["/etc/", "/var/log/", "/home/"]


def os_family(t) -> DataFrame:
    """(host, family) rows. Known file systems decide; without any, path markers do."""
    fs = F.upper("fs_type")
    family = F.when(fs == "NTFS", "windows").when(fs.startswith("EXT"), "linux").when((fs == "APFS") | fs.startswith("HFS"), "macos")
    by_volume = t["volumes"].select("host_id", family.alias("family")).filter("family IS NOT NULL").distinct()
    low = F.lower(full_path())
    seen = t["files"].groupBy("host_id").agg(
        F.bool_or(contains_any(low, MAC_MARKERS)).alias("mac"), F.bool_or(low.contains("/windows/")).alias("win"),
        F.bool_or(low.contains("/users/")).alias("users"), F.bool_or(contains_any(low, LINUX_MARKERS)).alias("lin"),
    )
    seen = seen.join(by_volume.select("host_id").distinct(), "host_id", "left_anti")
    names = F.array_compact(F.array(
        F.when(F.col("mac"), F.lit("macos")),
        F.when(F.col("win") | (F.col("users") & ~F.col("mac")), F.lit("windows")),
        F.when(F.col("lin") & ~F.col("mac"), F.lit("linux")),
    ))
    return by_volume.unionByName(seen.select("host_id", F.explode(names).alias("family")))


def _clean(value: Column) -> Column:
    out = F.regexp_replace(value, r"^\s+|\s+$", "")
    return F.when(out != "", out)


def windows_profile(t) -> DataFrame:
    """Host name, domain, system version, users, time zone and addresses from the registry.

    Values are taken in the order (source file, key, name): the last one for most fields,
    the first one where a later value must not replace an earlier one.
    """
    hive, path, name, raw = F.upper("hive"), F.lower("path"), F.lower("name"), F.col("data")
    order = F.struct("source_file", "path", "name", "data")
    system = hive.contains("SYSTEM")
    software = ~system & hive.contains("SOFTWARE")

    def at(key: str) -> Column:
        k = key.lower()
        return (path == k) | path.endswith("\\" + k) | path.endswith("/" + k)

    version = software & at("Microsoft\\Windows NT\\CurrentVersion")
    logon = software & at("Microsoft\\Windows NT\\CurrentVersion\\Authentication\\LogonUI")
    tcpip = system & at("Services\\Tcpip\\Parameters")

    def last(cond: Column, value: Column = _clean(raw)) -> Column:
        return F.max_by(value, F.when(cond & value.isNotNull(), order))

    def first(cond: Column, value: Column = _clean(raw)) -> Column:
        return F.min_by(value, F.when(cond & value.isNotNull(), order))

    ticks = F.regexp_replace(raw, "[^0-9a-fA-F]", "")
    swapped = F.array_join(F.reverse(F.regexp_extract_all(F.substring(ticks, 1, 16), F.lit("(..)"), 1)), "")
    us = F.conv(swapped, 16, 10).cast("decimal(20,0)") / 10 - times.FILETIME_OFFSET_US
    shutdown = F.when((F.length(ticks) >= 16) & us.between(946_684_800_000_001, 7_258_118_399_999_999), F.timestamp_micros(us.try_cast("bigint")))
    installed = F.timestamp_seconds(_clean(raw).try_cast("bigint"))
    iface = system & path.contains("services\\tcpip\\parameters\\interfaces\\") & name.isin("ipaddress", "dhcpipaddress")
    ip = F.filter(F.split(raw, "[ ,\\n\\t]+"), lambda p: (p != "") & (p != "0.0.0.0"))
    exact = F.col("name")
    ips = t["registry"].filter(iface).select("host_id", F.struct(order.alias("o"), ip.alias("ip")).alias("x"))
    ips = ips.groupBy("host_id").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["ip"]))).alias("ip_addresses"))
    agg = t["registry"].groupBy("host_id").agg(
        last(system & at("Control\\ComputerName\\ComputerName") & (name == "computername")).alias("computer"),
        first(system & at("Control\\ComputerName\\ActiveComputerName") & (name == "computername")).alias("active"),
        last(tcpip & (name == "domain")).alias("dom"),
        first(tcpip & (name == "nv domain")).alias("nv_dom"),
        last(system & at("Control\\TimeZoneInformation") & (name == "timezonekeyname")).alias("time_zone"),
        last(system & at("Control\\Windows") & (name == "shutdowntime"), shutdown).alias("last_shutdown"),
        last(version & (exact == "ProductName")).alias("os_product"),
        last(version & (exact == "DisplayVersion")).alias("display"),
        first(version & (exact == "ReleaseId")).alias("release"),
        first(version & exact.isin("CurrentBuild", "CurrentBuildNumber")).alias("build"),
        first(version & (exact == "UBR")).alias("ubr"),
        last(version & (exact == "InstallDate"), installed).alias("install_date"),
        last(logon & (name == "lastloggedonuser")).alias("user"),
        first(logon & (name == "lastloggedonsamuser")).alias("sam"),
    )
    build = F.when(F.col("ubr").isNotNull() & ~F.col("build").contains("."), F.concat_ws(".", "build", "ubr")).otherwise(F.col("build"))
    return agg.join(ips, "host_id", "left").select(
        "host_id", F.coalesce("computer", "active").alias("hostname"), F.coalesce("dom", "nv_dom").alias("domain"), "os_product",
        F.coalesce("display", "release").alias("os_version"), build.alias("os_build"), "install_date", "last_shutdown",
        F.coalesce("user", "sam").alias("primary_user"), "time_zone",
        F.coalesce("ip_addresses", F.array().cast("array<string>")).alias("ip_addresses"),
    )


def _first_human(users: DataFrame, low: int) -> DataFrame:
    human = users.filter(F.col("uid").between(low, 64_999) & has_login_shell(F.col("shell")))
    return human.groupBy("host_id").agg(F.min_by("name", F.struct("uid", "name")).alias("primary_user"))


def linux_profile(t) -> DataFrame:
    return t["linux_host"].join(_first_human(t["linux_users"], 1000), "host_id", "left").select(
        "host_id", "hostname", F.coalesce("pretty_name", "os_id").alias("os_product"), "time_zone", "ip_addresses", "primary_user"
    )


def mac_profile(t) -> DataFrame:
    return t["mac_host"].join(_first_human(t["mac_users"], 501), "host_id", "left").select(
        "host_id", F.coalesce("computer_name", "local_host_name").alias("hostname"), F.col("product_name").alias("os_product"),
        F.col("product_version").alias("os_version"), F.col("build_version").alias("os_build"), "time_zone", "ip_addresses", "primary_user",
    )


def host_profiles(t) -> DataFrame:
    """One profile per host: the registry where it says anything, else Linux, else macOS."""
    parts = [windows_profile(t).withColumn("_rank", F.lit(0)), linux_profile(t).withColumn("_rank", F.lit(1)), mac_profile(t).withColumn("_rank", F.lit(2))]
    rows = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    said = any_of(F.col(c).isNotNull() for c in ("hostname", "domain", "os_product", "os_build", "install_date", "last_shutdown", "primary_user", "time_zone")) | (F.size("ip_addresses") > 0)
    fields = [c for c in rows.columns if c not in ("host_id", "_rank")]
    return rows.filter(said).groupBy("host_id").agg(F.min_by(F.struct(*fields), "_rank").alias("p")).select("host_id", "p.*")


def os_summary() -> Column:
    """Product, version and build in one line; null when none is known."""
    line = F.concat_ws(" ", "os_product", "os_version", F.concat(F.lit("Build "), F.col("os_build")))
    return F.when(line != "", line)


# ---- Several hosts at once --------------------------------------------------------------------
# Default order of a table when several hosts are shown together: newest first.
DEFAULT_ORDER = {
    "events": "written_at", "registry": "last_written", "amcache": "registered_at", "shimcache": "last_modified",
    "jumplist": "last_accessed", "usn": "timestamp", "recycle_bin": "deleted_at", "srum": "timestamp",
    "browser_history": "timestamp", "auth_log": "timestamp", "logins": "timestamp", "shell_history": "timestamp",
    "web_access": "timestamp", "packages": "timestamp", "journald": "timestamp", "audit": "timestamp", "syslog": "timestamp",
    "lastlog": "timestamp", "quarantine": "timestamp", "unified_log": "timestamp", "tcc": "last_modified",
    "knowledge": "start_date", "recent_items": "timestamp", "security_events": "timestamp", "messages": "timestamp",
    "mail": "date_received", "network": "timestamp", "user_activity": "timestamp", "doc_versions": "version_time",
    "notifications": "delivered_date", "powerlog": "date", "installs": "date",
}


def multi_host(t, name: str, hosts: list[str] | None = None) -> DataFrame:
    """A table over all or some hosts in its default order, rows without a time last."""
    df = t[name] if hosts is None else t[name].filter(F.col("host_id").isin(hosts))
    return df.orderBy(F.col(DEFAULT_ORDER[name]).desc_nulls_last()) if name in DEFAULT_ORDER else df


# ---- Integrity --------------------------------------------------------------------------------
def content_hashes(contents: DataFrame) -> DataFrame:
    """MD5, SHA-1 and SHA-256 of each content, as rows. Contents must fit one row."""
    pairs = F.create_map(F.lit("md5"), F.md5("content"), F.lit("sha1"), F.sha1("content"), F.lit("sha256"), F.sha2("content", 256))
    return contents.select("path", F.explode(pairs).alias("algorithm", "computed"))


def file_hashes(files: DataFrame) -> DataFrame:
    """The same of files named by `path` and the address `uri`, read a piece at a time; unreadable ones have no rows."""
    sums = digests(files, ["path"])
    pairs = F.create_map(*[c for a in ("md5", "sha1", "sha256") for c in (F.lit(a), F.col(a))])
    return sums.filter("error IS NULL").select("path", F.explode(pairs).alias("algorithm", "computed"))


def verify_sources(expected: DataFrame, computed: DataFrame) -> DataFrame:
    """Recorded against recomputed hashes: verified, mismatch, or unavailable."""
    out = expected.join(computed, ["path", "algorithm"], "left")
    status = F.when(F.col("computed").isNull(), "unavailable").when(F.lower("value") == F.lower("computed"), "verified").otherwise("mismatch")
    return out.select("path", "algorithm", F.lower("value").alias("value"), "computed", status.alias("status"))
