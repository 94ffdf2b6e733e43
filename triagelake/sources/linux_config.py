"""Linux configuration files: persistence, access, accounts, addresses, and file routing.

These files are small; they are read whole and cut into lines, so "first" and "last" mean
line order within one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.text import any_of, basename, contains_any, extension
from triagelake.operators.cross_platform import full_path
from triagelake.sources.lines import FILE, ORDER, extract, strip
from triagelake.tables import conform

# ---- Fixed values -----------------------------------------------------------------------------
SCRIPT_TELLS = [
    "curl ", "wget ", "/dev/tcp/", "nc ", "ncat ", "base64", "eval ", "python -c", "python3 -c", "perl -e", "| sh",
    "|sh", "| bash", "|bash", "/tmp/", "/dev/shm/", "/var/tmp/", "bash -i", "exec ",
]
SCAFFOLDING = ["fi", "done", "esac", "else", "then", "do", "}", "{", "if [", "case ", "for ", "while "]
LEASE_TRIGGERS = [
    "new lease", "dhcpv4 address", "dhcp4", "dhcp6", "bound to", "leased", "ip_address", "address record for",
]
TIMER_KEYS = ["oncalendar", "onbootsec", "onunitactivesec", "onstartupsec"]


def _content(lines: DataFrame) -> DataFrame:
    """Stripped lines that are neither blank nor comments."""
    df = lines.withColumn("t", strip(F.col("line")))
    return df.filter((F.col("t") != "") & ~F.col("t").startswith("#"))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _tail(words: Column, skip) -> Column:
    return F.array_join(F.slice(words, F.lit(1) + skip, F.greatest(F.size(words) - skip, F.lit(0))), " ")


# ---- Persistence ------------------------------------------------------------------------------
def crontab(lines: DataFrame, has_user_field: bool, default_user: Column | None = None) -> DataFrame:
    """One row per job. Fields are separated by blanks only."""
    df = _content(lines).filter(~F.col("t").rlike(r"^[\p{L}\p{N}_]+=")).withColumn("w", _words(F.col("t")))
    at = F.col("t").startswith("@")
    n = F.when(at, 1).otherwise(5)
    df = df.filter(at | (F.size("w") >= 5)).withColumn("n", n)
    schedule = F.array_join(F.slice("w", F.lit(1), F.col("n")), " ")
    default = default_user if default_user is not None else F.lit(None).cast("string")
    if has_user_field:
        named = F.size("w") > F.col("n")
        user = F.when(named, F.get("w", F.col("n"))).otherwise(default)
        skip = F.when(named, F.col("n") + 1).otherwise(F.col("n"))
        df = df.filter(~named | (F.size("w") > F.col("n") + 1))
    else:
        user, skip = default, F.col("n")
    out = df.select(*FILE, F.lit("cron").alias("kind"), schedule.alias("schedule"), user.alias("user"), _tail(F.col("w"), skip).alias("command"))
    return conform(out, "linux_persistence")


def _ini(lines: DataFrame) -> DataFrame:
    """(section, key, value) rows of an ini-like file, keys and sections in lower case."""
    df = _content(lines).filter(~F.col("t").startswith(";"))
    section = F.when(F.col("t").rlike(r"^\[.*\]$"), F.lower(F.regexp_extract("t", r"^\[(.*)\]$", 1)))
    items = df.groupBy(*FILE).agg(F.array_sort(F.collect_list(F.struct(*ORDER, "t", section.alias("s")))).alias("x"))
    # One small file per row: the section of a line is the last header at or above it.
    walked = items.withColumn("x", F.aggregate(
        "x",
        F.struct(F.lit("").alias("cur"), F.array().cast("array<struct<block:bigint,line_no:bigint,s:string,t:string>>").alias("out")),
        lambda acc, r: F.struct(
            F.coalesce(r["s"], acc["cur"]).alias("cur"),
            F.when(r["s"].isNotNull(), acc["out"]).otherwise(F.array_append(acc["out"], F.struct(r["block"].alias("block"), r["line_no"].alias("line_no"), acc["cur"].alias("s"), r["t"].alias("t")))).alias("out"),
        ),
        lambda acc: acc["out"],
    ))
    rows = walked.select(*FILE, F.explode("x").alias("r")).filter(F.col("r.t").contains("="))
    return rows.select(
        *FILE, F.col("r.block").alias("block"), F.col("r.line_no").alias("line_no"), F.col("r.s").alias("section"),
        F.lower(strip(F.regexp_extract("r.t", r"^([^=]*)=", 1))).alias("key"), strip(F.regexp_extract("r.t", r"^[^=]*=(.*)$", 1)).alias("value"),
    )


def systemd_service(lines: DataFrame) -> DataFrame:
    """One row per unit with an ExecStart; the first value of a key wins."""
    kv = _ini(lines)
    at = F.struct(*ORDER)
    is_ = lambda s, k: (F.col("section") == s) & (F.col("key") == k)
    agg = kv.groupBy(*FILE).agg(
        F.min_by("value", F.when(is_("service", "execstart") & (F.col("value") != ""), at)).alias("exec"),
        F.min_by("value", F.when(is_("unit", "description"), at)).alias("detail"),
        F.min_by("value", F.when(is_("service", "user"), at)).alias("user"),
    ).filter("exec IS NOT NULL")
    out = agg.select(*FILE, F.lit("systemdService").alias("kind"), "user", F.regexp_replace("exec", r"^[-@:+!]+", "").alias("command"), basename(F.col("source_file")).alias("unit_name"), "detail")
    return conform(out, "linux_persistence")


def systemd_timer(lines: DataFrame) -> DataFrame:
    """One row per timer; without a Unit the service of the same name is what it starts."""
    kv = _ini(lines)
    at = F.struct(*ORDER)
    timer = F.col("section") == "timer"
    when = timer & F.col("key").isin(TIMER_KEYS)
    agg = kv.groupBy(*FILE).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct(*ORDER, "value")))), lambda s: s["value"]), ", ").alias("schedule"),
        F.max_by("value", F.when(timer & (F.col("key") == "unit"), at)).alias("unit"),
        F.min_by("value", F.when((F.col("section") == "unit") & (F.col("key") == "description"), at)).alias("detail"),
    )
    every = lines.select(*FILE).distinct().join(agg, FILE, "left")
    name = F.regexp_extract("source_file", r"([^/]+)/*$", 1)
    out = every.select(
        *FILE, F.lit("systemdTimer").alias("kind"), F.when(F.col("schedule") != "", F.col("schedule")).alias("schedule"),
        F.coalesce("unit", F.replace(name, F.lit(".timer"), F.lit(".service"))).alias("command"), name.alias("unit_name"), "detail",
    )
    return conform(out, "linux_persistence")


def ld_preload(lines: DataFrame) -> DataFrame:
    words = _words(F.col("t"))
    stop = F.array_position(F.transform(words, lambda w: w.startswith("#")), True).cast("int")
    kept = F.when(stop > 0, F.slice(words, F.lit(1), stop - 1)).otherwise(words)
    out = _content(lines).select(*FILE, F.lit("ldPreload").alias("kind"), F.explode(kept).alias("command"))
    return conform(out, "linux_persistence")


def autostart(lines: DataFrame) -> DataFrame:
    df = lines.withColumn("t", strip(F.col("line")))
    at = F.struct(*ORDER)
    agg = df.groupBy(*FILE).agg(
        F.min_by(F.substring("t", 6, 1 << 20), F.when(F.col("t").startswith("Exec="), at)).alias("command"),
        F.min_by(F.substring("t", 6, 1 << 20), F.when(F.col("t").startswith("Name="), at)).alias("detail"),
    ).filter("command <> ''")
    out = agg.select(*FILE, F.lit("xdgAutostart").alias("kind"), "command", F.regexp_extract("source_file", r"([^/]+)/*$", 1).alias("unit_name"), "detail")
    return conform(out, "linux_persistence")


def script(lines: DataFrame, kind: str, user: Column | None = None, suspicious_only: bool = False) -> DataFrame:
    """Command lines of a start script without scaffolding and plain assignments; optionally only those that look
    like execution."""
    t, low = F.col("t"), F.lower("t")
    scaffold = any_of(low.startswith(k) for k in SCAFFOLDING)
    plain = t.rlike(r"^[\p{L}\p{N}_]+=")
    df = _content(lines).filter((t != "exit 0") & ~scaffold & ~plain)
    if suspicious_only:
        df = df.filter(contains_any(low, SCRIPT_TELLS))
    who = user if user is not None else F.lit(None).cast("string")
    return conform(df.select(*FILE, F.lit(kind).alias("kind"), who.alias("user"), t.alias("command")), "linux_persistence")


# ---- Access -----------------------------------------------------------------------------------
def _is_algorithm(word: Column) -> Column:
    return word.startswith("ssh-") | word.startswith("ecdsa-") | word.startswith("sk-")


def authorized_keys(lines: DataFrame, user: Column) -> DataFrame:
    """Keys with their options; quotes protect commas and blanks inside an option."""
    t = F.col("t")
    first = F.regexp_extract(t, r"^ *([^ ]+)", 1)
    opts = F.regexp_extract(t, r'^((?:"[^"]*(?:"|$)|[^" ])*)', 1)
    with_options = ~_is_algorithm(first)
    rest = F.when(with_options, F.substring(t, F.length(opts) + 2, F.length(t))).otherwise(t)
    df = _content(lines).select(
        *FILE, F.when(with_options, F.regexp_extract_all(opts, F.lit(r'((?:"[^"]*(?:"|$)|[^",])+)'), 1)).otherwise(F.array().cast("array<string>")).alias("options"),
        F.regexp_extract(rest, r"^ *([^ ]+)", 1).alias("algorithm"), extract(rest, r"^ *[^ ]+ +([^ ]+)").alias("key"), F.regexp_extract(rest, r"^ *[^ ]+ +[^ ]+ (.*)$", 1).alias("comment"),
    ).filter(_is_algorithm(F.col("algorithm")) & F.col("key").isNotNull())
    return conform(df.withColumn("kind", F.lit("authorized")).withColumn("user", user), "ssh_keys")


def known_hosts(lines: DataFrame, user: Column) -> DataFrame:
    df = _content(lines).withColumn("w", _words(F.col("t")))
    w = F.when(F.get("w", F.lit(0)).startswith("@"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0)))).otherwise(F.col("w"))
    df = df.withColumn("w", w).filter((F.size("w") >= 2) & _is_algorithm(F.get("w", F.lit(1))))
    out = df.select(*FILE, F.lit("knownHost").alias("kind"), F.get("w", F.lit(1)).alias("algorithm"), F.coalesce(F.get("w", F.lit(2)), F.lit("")).alias("comment"), F.array().cast("array<string>").alias("options"), F.get("w", F.lit(0)).alias("host"))
    return conform(out.withColumn("user", user), "ssh_keys")


def sshd_config(lines: DataFrame) -> DataFrame:
    """(key, value) rows per host; the last value of a key wins."""
    parts = F.filter(F.split("t", "[ \t=]"), lambda w: w != "")
    df = _content(lines).withColumn("p", parts).filter(F.size("p") >= 2)
    df = df.select(*FILE, *ORDER, F.lower(F.get("p", F.lit(0))).alias("key"), _tail(F.col("p"), F.lit(1)).alias("value"))
    agg = df.groupBy("host_id", "key").agg(F.max_by(F.struct("value", "source_file"), F.struct("source_file", *ORDER)).alias("v"))
    return conform(agg.select("host_id", "key", "v.*"), "sshd_settings")


def sshd_map(settings: DataFrame) -> DataFrame:
    """Settings of each host as one map."""
    return settings.groupBy("host_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("settings"))


def sudoers(lines: DataFrame) -> DataFrame:
    t = F.col("t")
    up = F.upper(t)
    skip = any_of(up.startswith(k) for k in ("DEFAULTS", "USER_ALIAS", "CMND_ALIAS", "HOST_ALIAS", "RUNAS_ALIAS")) | t.startswith("@")
    df = _content(lines).filter(~skip & t.rlike(r"^[^ ]+ [^=]*="))
    spec = strip(F.regexp_extract(t, r"^[^ ]+ [^=]*=(.*)$", 1))
    run_as = F.when(spec.rlike(r"^\([^)]*\)"), F.regexp_extract(spec, r"^\(([^)]*)\)", 1))
    bare = strip(F.regexp_replace(spec, r"^\([^)]*\)", ""))
    tags = F.upper(F.regexp_extract(bare, r"^(.*):", 1))
    tagged = bare.contains(":") & contains_any(tags, ["PASSWD", "EXEC", "SETENV"])
    command = F.when(tagged, strip(F.regexp_extract(bare, r"^.*:(.*)$", 1))).otherwise(bare)
    out = df.select(
        *FILE, F.regexp_extract(t, r"^([^ ]+)", 1).alias("principal"), run_as.alias("run_as"), F.upper(bare).contains("NOPASSWD").alias("no_passwd"),
        F.when(command == "", "ALL").otherwise(command).alias("command"),
    )
    return conform(out, "sudo_rules")


# ---- Accounts and host facts ------------------------------------------------------------------
def _colon_fields(lines: DataFrame, n: int) -> DataFrame:
    return _content(lines).withColumn("f", F.split("t", ":", -1)).filter(F.size("f") >= n)


def passwd(lines: DataFrame) -> DataFrame:
    df = _colon_fields(lines, 7)
    f = F.col("f")
    out = df.select("host_id", f[0].alias("name"), f[2].try_cast("bigint").alias("uid"), f[3].try_cast("bigint").alias("gid"), f[5].alias("home"), f[6].alias("shell"))
    return conform(out.filter("uid IS NOT NULL AND gid IS NOT NULL"), "linux_users")


def group(lines: DataFrame) -> DataFrame:
    df = _colon_fields(lines, 4)
    f = F.col("f")
    out = df.select("host_id", f[0].alias("name"), f[2].try_cast("bigint").alias("gid"), F.filter(F.split(f[3], ","), lambda m: m != "").alias("members"))
    return conform(out.filter("gid IS NOT NULL"), "linux_groups")


def shadow_status(secret: Column) -> Column:
    return F.when(secret == "", "empty").when(secret.isin("*", "!!"), "noLogin").when(secret.startswith("!") | secret.startswith("*"), "locked").otherwise("usable")


def shadow(lines: DataFrame) -> DataFrame:
    """Password state per account; the last line of an account wins."""
    df = _colon_fields(lines, 2).select("host_id", *ORDER, F.col("f")[0].alias("account"), shadow_status(F.col("f")[1]).alias("s"))
    return conform(df.groupBy("host_id", "account").agg(F.max_by("s", F.struct(*ORDER)).alias("status")), "shadow")


def os_release(lines: DataFrame) -> DataFrame:
    df = lines.withColumn("t", strip(F.col("line"))).filter(~F.col("t").startswith("#") & F.col("t").contains("="))
    key, value = F.regexp_extract("t", r"^([^=]*)=", 1), F.regexp_replace(F.regexp_extract("t", r"^[^=]*=(.*)$", 1), "^[\"']+|[\"']+$", "")
    at = F.struct("source_file", *ORDER)
    pick = lambda k: F.max_by(value, F.when(key == k, at))
    return df.groupBy("host_id").agg(pick("PRETTY_NAME").alias("pretty_name"), pick("ID").alias("os_id"), pick("VERSION_ID").alias("version_id"))


def first_line(lines: DataFrame, name: str) -> DataFrame:
    """The first line that is neither blank nor a comment (hostname, time zone)."""
    df = _content(lines)
    return df.groupBy("host_id").agg(F.min_by("t", F.struct("source_file", *ORDER)).alias(name))


def normal_ipv4(token: Column) -> Column:
    """Canonical form of a dotted quad, null when it is none."""
    nums = F.transform(F.split(token, r"\."), lambda p: p.try_cast("int"))
    ok = token.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$") & F.forall(nums, lambda n: n <= 255)
    return F.when(ok, F.array_join(F.transform(nums, lambda n: n.cast("string")), "."))


def is_host_ipv4(ip: Column) -> Column:
    o = F.split(ip, r"\.")
    a, b = o[0].try_cast("int"), o[1].try_cast("int")
    return F.coalesce(~(a.isin(0, 127) | ((a == 169) & (b == 254)) | (a >= 224)), F.lit(False))


def _addresses(rows: DataFrame, found: Column) -> DataFrame:
    good = F.filter(F.transform(found, normal_ipv4), lambda ip: ip.isNotNull() & is_host_ipv4(ip))
    return rows.select(*FILE, *ORDER, F.posexplode(good).alias("pos", "ip"))


def lease_addresses(lines: DataFrame) -> DataFrame:
    """Host addresses in lease messages: every valid quad of a line with a trigger word."""
    hit = lines.filter(contains_any(F.lower("line"), LEASE_TRIGGERS))
    return _addresses(hit, F.regexp_extract_all("line", F.lit(r"(?<![0-9.])([0-9][0-9.]*)"), 1))


def netplan_addresses(lines: DataFrame) -> DataFrame:
    return _addresses(lines, F.regexp_extract_all("line", F.lit(r"(?:^|[ \t\r,\[\]'\"])([0-9.]+)/[0-9]+(?=$|[ \t\r,\[\]'\"])"), 1))


def interface_addresses(lines: DataFrame) -> DataFrame:
    t = strip(F.col("line"))
    hit = lines.filter(F.lower(t).rlike("^address[ \t]"))
    value = F.regexp_extract(t, r"(?i)^address[ \t]+([^/ ]*)", 1)
    return _addresses(hit, F.array(value))


def host_addresses(*found: DataFrame) -> DataFrame:
    """Distinct addresses of each host, in the order found."""
    rows = None
    for rank, df in enumerate(found):
        part = df.select("host_id", "ip", F.struct(F.lit(rank).alias("r"), F.col("source_file"), *ORDER, F.col("pos")).alias("at"))
        rows = part if rows is None else rows.unionByName(part)
    firsts = rows.groupBy("host_id", "ip").agg(F.min("at").alias("at"))
    return firsts.groupBy("host_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ip"))), lambda s: s["ip"]).alias("ip_addresses"))


# ---- Routing ----------------------------------------------------------------------------------
def artifact_kind(path: Column, name: Column) -> Column:
    """Which scan a Linux file belongs to, by path and name (both lower case); rules in order."""
    ext = extension(name)
    gz = name.endswith(".gz")
    has, ends, starts = path.contains, path.endswith, name.startswith
    var_log = has("/var/log/")
    system_logs = (
        ends("/var/log/syslog") | ends("/var/log/messages") | ends("/var/log/kern.log")
        | (var_log & (starts("syslog.") | starts("messages.") | starts("messages-") | starts("kern.log")))
    )
    web = name.contains("access") & name.contains(".log") & (has("/nginx/") | has("/apache2/") | has("/httpd/"))
    accounts = any_of(ends(p) for p in ("/etc/os-release", "/usr/lib/os-release", "/etc/hostname", "/etc/passwd", "/etc/timezone"))
    rules = [
        (has("/var/log/journal/") & (name.endswith(".journal") | name.endswith(".journal~")), "journald"),
        (has("/var/log/audit/") & starts("audit.log"), "audit"),
        (ends("/var/log/lastlog"), "lastlog"),
        (name == "lastlog2.db", "lastlog2"),
        (~gz & (ends("/var/log/sudo") | (name == "sudo.log") | starts("sudo.log.")), "sudoLog"),
        (~gz & (name.isin("production.log", "development.log", "staging.log") | (has("/log/") & starts("puma"))), "appServerLog"),
        (system_logs & ~gz, "syslog"),
        (var_log & (starts("auth.log") | starts("secure")), "auth"),
        (var_log & ~gz & (name.isin("wtmp", "btmp") | starts("wtmp.") | starts("btmp.")), "utmp"),
        (var_log & web, "webAccess"),
        (var_log & starts("dpkg.log"), "packageDpkg"),
        (var_log & has("/apt/") & starts("history.log"), "packageApt"),
        (var_log & starts("yum.log"), "packageYum"),
        (var_log & starts("dnf.rpm.log"), "packageDnf"),
        (gz, None),
        ((ext == "timer") & (has("/systemd/system") | has("/.config/systemd/")), "systemdTimer"),
        ((ext == "service") & has("/.config/systemd/"), "systemd"),
        (ends("/etc/ld.so.preload"), "ldPreload"),
        (name.endswith(".desktop") & has("/autostart/"), "xdgAutostart"),
        (ends("/etc/rc.local") | any_of(has(p) for p in ("/etc/init.d/", "/etc/cron.hourly/", "/etc/cron.daily/", "/etc/cron.weekly/", "/etc/cron.monthly/")), "initScript"),
        (name.isin(".bashrc", ".bash_profile", ".profile", ".bash_login") | has("/etc/profile.d/") | ends("/etc/bash.bashrc") | ends("/etc/profile"), "shellInit"),
        (name.isin(".bash_history", ".zsh_history"), "shellHistory"),
        (name.isin("authorized_keys", "authorized_keys2"), "sshAuthorized"),
        ((name == "known_hosts") | ends("/etc/ssh/ssh_known_hosts"), "sshKnown"),
        (ends("/etc/ssh/sshd_config"), "sshdConfig"),
        (ends("/etc/sudoers") | has("/etc/sudoers.d/"), "sudoers"),
        (ends("/etc/group"), "group"),
        (ends("/etc/shadow"), "shadow"),
        (ends("/etc/crontab") | has("/etc/cron.d/") | has("/var/spool/cron"), "cron"),
        ((ext == "service") & has("/etc/systemd/system"), "systemd"),
        (accounts, "sysinfo"),
        (has("/etc/netplan/") & (name.endswith(".yaml") | name.endswith(".yml")), "sysinfo"),
        (ends("/etc/network/interfaces") | has("/etc/network/interfaces.d/"), "sysinfo"),
    ]
    out = F.lit(None).cast("string")
    for cond, kind in reversed(rules):
        out = F.when(cond, F.lit(kind)).otherwise(out)
    return out


def route_files(files: DataFrame) -> DataFrame:
    """Live files a scan exists for, with the scan's name."""
    live = files.filter(~F.col("is_directory") & ~F.col("is_deleted") & (F.col("size") > 0) & ~F.col("name").endswith("-slack"))
    kind = artifact_kind(F.lower(full_path()), F.lower("name"))
    return live.select("host_id", "id", full_path().alias("path"), kind.alias("artifact")).filter("artifact IS NOT NULL")
