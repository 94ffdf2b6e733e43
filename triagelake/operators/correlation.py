"""What several hosts of a case have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.payload import with_fields
from triagelake.operators.findings import C2, CRITICAL, EXPLOIT, HIGH, MEDIUM, findings, text, union
from triagelake.operators.ioc import KIND_LABELS

# Accounts every system has.
BUILTIN_USERS = [
    "system", "local system", "localsystem", "local service", "network service", "administrator", "guest",
    "defaultaccount", "wdagutilityaccount", "anonymous logon", "iusr", "krbtgt", "root", "daemon", "bin", "sys", "sync",
    "games", "man", "lp", "mail", "news", "uucp", "proxy", "www-data", "backup", "list", "irc", "gnats", "nobody",
    "systemd-network", "systemd-resolve", "systemd-timesync", "messagebus", "syslog", "_apt", "tss", "uuidd",
    "tcpdump", "landscape", "pollinate", "sshd", "ftp", "dnsmasq", "usbmux",
]
LOCAL_SOURCES = ["", "-", "::", "::1", "0.0.0.0", "127.0.0.1"]


def user_key(raw: Column) -> Column:
    """Account name without its domain, lower case."""
    return F.regexp_replace(F.lower(F.trim(raw)), r"^.*\\", "")


def is_builtin(raw: Column) -> Column:
    name = user_key(raw)
    return F.lower(F.trim(raw)).isin("", "-") | name.endswith("$") | name.startswith("dwm-") | name.startswith("umfd-") | name.isin(BUILTIN_USERS)


def has_login_shell(shell: Column) -> Column:
    return ~(shell.endswith("nologin") | shell.endswith("/false") | (shell == ""))


def host_users(t) -> DataFrame:
    """Accounts that are human or were really used, once per host."""
    human = t["linux_users"].filter(F.col("uid").between(1000, 64_999) & has_login_shell(F.col("shell"))).select("host_id", F.col("name").alias("user"))
    real = t["logins"].filter("type = 'userProcess' AND NOT is_failed_login").select("host_id", "user")
    auth = t["auth_log"].filter("kind IN ('sshAccepted', 'sudo', 'sessionOpened')").select("host_id", "user")
    return union([human, real, auth]).filter("user <> ''").distinct()


def host_source_ips(t) -> DataFrame:
    """Remote logon sources, once per host."""
    ssh = t["auth_log"].filter("kind = 'sshAccepted'").select("host_id", F.col("source_ip").alias("ip"))
    logons = t["events"].filter("event_id IN (4624, 4625)")
    win = with_fields(logons, ip="IpAddress").select("host_id", "ip")
    return ssh.unionByName(win).filter(~F.col("ip").isin("", "-", "::1", "127.0.0.1")).distinct()


def host_summary(t) -> DataFrame:
    """Per host the accounts and source addresses that correlation uses, one row each."""
    users = host_users(t).select("host_id", F.lit("user").alias("kind"), F.col("user").alias("value"))
    ips = host_source_ips(t).select("host_id", F.lit("source_ip").alias("kind"), F.col("ip").alias("value"))
    return users.unionByName(ips)


def severity_for(n: Column) -> Column:
    return F.when(n <= 2, MEDIUM).when(n == 3, HIGH).otherwise(CRITICAL)


def labels(t) -> DataFrame:
    """Display name per host; the id stands in when none is known."""
    return t["hosts"].groupBy("host_id").agg(F.min("display_name").alias("label"))


def _spread(t, rows: DataFrame, value: str, shown: str, at: Column | None = None) -> DataFrame:
    """Values seen on two hosts or more, with the hosts. One row per (value, host) is made
    first, so the second level only ever holds as many rows per value as there are hosts."""
    per_host = rows.groupBy(value, "host_id").agg(F.min(shown).alias("shown"), F.min(at if at is not None else F.lit(None).cast("timestamp")).alias("first"))
    named = per_host.join(labels(t), "host_id", "left").withColumn("label", F.coalesce(F.when(F.trim("label") != "", F.col("label")), F.col("host_id")))
    return named.groupBy(value).agg(
        F.count(F.lit(1)).alias("n"), F.min("shown").alias("shown"), F.min("first").alias("first"),
        F.array_sort(F.collect_set("label")).alias("hosts"),
    ).filter(F.col("n") >= 2)


def _case(df: DataFrame) -> DataFrame:
    return df.withColumn("host_id", F.lit(None).cast("string"))


def indicator_rows(matches: DataFrame) -> DataFrame:
    """Matches by their indicator: host_id, key, shown (value and kind), timestamp."""
    rows = matches.withColumn("key", F.lower("ioc_value")).filter("key <> ''")
    return rows.select("host_id", "key", F.concat_ws("\u0001", "ioc_value", "ioc_kind").alias("shown"), "timestamp")


def shared_indicators(t, matches: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    rows = rows if rows is not None else indicator_rows(matches)
    agg = _case(_spread(t, rows, "key", "shown", F.col("timestamp")))
    value, kind = F.split("shown", "\u0001")[0], F.split("shown", "\u0001")[1]
    label = F.element_at(F.create_map(*[F.lit(x) for p in KIND_LABELS.items() for x in p]), kind)
    return findings(
        agg,
        "shared_indicators",
        title=text("Shared indicator across ", F.col("n"), " hosts: ", label, " ", value),
        detail=text("The indicator `", value, "` matched on ", F.col("n"), " hosts: ", F.array_join("hosts", ", "), "."),
        severity=severity_for(F.col("n")),
        phase=C2,
        attack="T1105",
        when=F.col("first"),
        evidence=F.col("hosts"),
    )


def source_pivots(t, ips: DataFrame | None = None) -> DataFrame:
    rows = (ips if ips is not None else host_source_ips(t)).withColumn("ip", F.trim("ip"))
    rows = rows.filter(~F.col("ip").isin(LOCAL_SOURCES) & ~F.col("ip").startswith("127."))
    agg = _case(_spread(t, rows, "ip", "ip"))
    return findings(
        agg,
        "source_pivots",
        title=text("Source ", F.col("ip"), " authenticated to ", F.col("n"), " hosts (lateral pivot)"),
        detail=text(F.col("ip"), " logged on to ", F.col("n"), " hosts: ", F.array_join("hosts", ", "), "."),
        severity=severity_for(F.col("n")),
        phase=EXPLOIT,
        attack="T1021",
        evidence=F.col("hosts"),
    )


def credential_reuse(t, users: DataFrame | None = None) -> DataFrame:
    rows = (users if users is not None else host_users(t)).filter(~is_builtin(F.col("user")))
    rows = rows.withColumn("key", user_key(F.col("user"))).withColumn("shown", F.trim("user")).filter("key <> ''")
    agg = _case(_spread(t, rows, "key", "shown"))
    return findings(
        agg,
        "credential_reuse",
        title=text("Account `", F.col("shown"), "` active on ", F.col("n"), " hosts (credential reuse)"),
        detail=text("The account `", F.col("shown"), "` is present/active on ", F.col("n"), " hosts: ", F.array_join("hosts", ", "), "."),
        severity=severity_for(F.col("n")),
        phase=EXPLOIT,
        attack="T1078",
        evidence=F.col("hosts"),
    )


def correlate(t, matches: DataFrame) -> DataFrame:
    return union([shared_indicators(t, matches), source_pivots(t), credential_reuse(t)])
