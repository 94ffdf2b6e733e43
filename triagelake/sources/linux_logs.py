"""Linux text logs to table rows. Every function maps lines to rows of one case table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.once import computed
from triagelake.functions.ordered import runs, scan
from triagelake.functions.text import contains_any
from triagelake.operators.linux import word_after
from triagelake.sources.lines import FILE, ORDER, extract, line_shard, strip
from triagelake.tables import conform

# ---- Fixed values -----------------------------------------------------------------------------
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
AUTH_PROGRAMS = ["sshd", "sudo", "login", "systemd-logind", "polkitd", "gdm-password", "CRON"]
SYSCALLS_X86_64 = {
    0: "read", 1: "write", 2: "open", 41: "socket", 42: "connect", 49: "bind", 57: "fork", 58: "vfork", 59: "execve",
    62: "kill", 82: "rename", 87: "unlink", 90: "chmod", 91: "fchmod", 92: "chown", 101: "ptrace", 105: "setuid",
    106: "setgid", 165: "mount", 175: "init_module", 257: "openat", 260: "fchownat", 263: "unlinkat", 268: "fchmodat",
    280: "utimensat", 322: "execveat",
}
SYSCALLS_AARCH64 = {
    35: "unlinkat", 53: "fchmodat", 56: "openat", 57: "close", 63: "read", 64: "write", 105: "setuid", 117: "ptrace",
    129: "kill", 144: "setgid", 198: "socket", 203: "connect", 220: "clone", 221: "execve", 281: "execveat",
}
ARCH_AARCH64 = "c00000b7"
UNSET_ID = 4_294_967_295
APT_ACTIONS = ["Install", "Remove", "Purge", "Upgrade", "Reinstall", "Downgrade"]
YUM_ACTIONS = {
    "Installed": "install", "Erased": "remove", "Removed": "remove", "Updated": "upgrade", "Upgraded": "upgrade",
    "Reinstalled": "reinstall", "Downgraded": "downgrade",
}
EPOCH_RANGE = (946_684_800, 4_102_444_800)
_CLASSIC = r"^ *([A-Z][a-z]{2}) +([0-9]{1,2}) +([0-9]+):([0-9]+):([0-9]+) +(.*)$"


def _map(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), key)


# ---- Syslog lines -----------------------------------------------------------------------------
def zoned_instant(stamp: Column) -> Column:
    """An ISO instant with a zone; null otherwise."""
    form = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:?\d\d)$"
    fixed = F.regexp_replace(stamp, r"([+-]\d\d)(\d\d)$", "$1:$2")
    return F.when(stamp.rlike(form), F.try_to_timestamp(fixed))


def yearless(month: Column, day: Column, clock: list[Column], anchor: Column) -> Column:
    """A stamp without a year: the anchor's year, or the one before when that would lie more
    than two days past the anchor. Without an anchor the year is 2001."""
    num = _map({m: i + 1 for i, m in enumerate(MONTHS)}, month)
    year = F.coalesce(F.year(anchor), F.lit(2001))

    def at(y: Column) -> Column:
        return F.try_make_timestamp(y, num, day.try_cast("int"), clock[0].try_cast("int"), clock[1].try_cast("int"), clock[2].try_cast("decimal(16,6)"))

    stamp = at(year)
    late = stamp > anchor + F.expr("INTERVAL 2 DAYS")
    return F.when(F.coalesce(late, F.lit(False)), at(year - 1)).otherwise(stamp)


def split_stamp(df: DataFrame) -> DataFrame:
    """Adds `timestamp` and `rest` of a line with an ISO or a classic stamp; other lines go."""
    line = F.col("line")
    head, iso_rest = F.regexp_extract(line, r"^([^ ]*) (.*)$", 1), F.regexp_extract(line, r"^([^ ]*) (.*)$", 2)
    iso = zoned_instant(head)
    part = [F.regexp_extract(line, _CLASSIC, i) for i in range(1, 7)]
    classic = part[0].isin(MONTHS) & part[1].try_cast("int").between(1, 31)
    stamp = yearless(part[0], part[1], part[2:5], F.col("anchor"))
    when = F.when(iso.isNotNull(), iso).when(classic, stamp)
    return computed(df, timestamp=when, rest=F.when(iso.isNotNull(), iso_rest).when(classic, part[5])).filter("rest IS NOT NULL")


def syslog_lines(lines: DataFrame) -> DataFrame:
    """Host, process, pid and message of syslog lines; lines of another form are left out."""
    df = split_stamp(lines)
    tail = r"^ *([^ ]+) ([^:]*):(.*)$"
    tag = F.regexp_extract("rest", tail, 2)
    df = computed(
        df,
        host=F.regexp_extract("rest", tail, 1),
        process=F.regexp_extract(tag, r"^([^\[]*)", 1),
        pid=F.regexp_extract(tag, r"\[([^\]]*)\]?$", 1).try_cast("bigint"),
        message=strip(F.regexp_extract("rest", tail, 3)),
    )
    return df.filter("process <> '' AND message <> ''")


def session_user(message: Column) -> Column:
    return extract(message, r"for user +([^ (]+)")


def auth_log(lines: DataFrame) -> DataFrame:
    """sshd, sudo, account and session lines in nine kinds."""
    df = syslog_lines(lines)
    p, m = F.col("process"), F.col("message")
    opened, closed = m.contains("session opened for user"), m.contains("session closed for user")
    ssh, sudo = p == "sshd", p == "sudo"
    added, changed = p.isin("useradd", "adduser", "groupadd"), p.isin("usermod", "passwd", "chpasswd", "chage", "chfn", "chsh")
    kind = (
        F.when(ssh & m.startswith("Accepted "), "sshAccepted")
        .when(ssh & m.startswith("Failed "), "sshFailed")
        .when(ssh & m.startswith("Invalid user "), "sshInvalidUser")
        .when(sudo & m.contains("COMMAND="), "sudo")
        .when(added & (m.startswith("new user:") | m.startswith("new group:")), "userAdded")
        .when(changed, "userModified")
        .when(~added & opened, "sessionOpened")
        .when(~added & ~sudo & closed, "sessionClosed")
        .otherwise("other")
    )
    df = computed(df, kind=kind)
    k = F.col("kind")
    failed_user = F.when(m.contains(" for invalid user "), word_after(" for invalid user ", m)).otherwise(word_after(" for ", m))
    user = (
        F.when(k == "sshAccepted", word_after(" for ", m))
        .when(k == "sshFailed", failed_user)
        .when(k == "sshInvalidUser", word_after("Invalid user ", m))
        .when(k == "sudo", strip(F.regexp_extract(m, r"^:*([^:]+)", 1)))
        .when(k == "userAdded", F.regexp_replace(word_after("name=", m), "^,+|,+$", ""))
        .when(k == "userModified", F.coalesce(session_user(m), word_after(" for ", m)))
        .when(k.isin("sessionOpened", "sessionClosed"), session_user(m))
    )
    from_net = k.isin("sshAccepted", "sshFailed", "sshInvalidUser")
    out = df.select(
        *FILE, "timestamp", "host", "process", "pid", "kind", user.alias("user"),
        F.when(from_net, word_after(" from ", m)).alias("source_ip"),
        F.when(k.isin("sshAccepted", "sshFailed"), word_after(" port ", m).try_cast("bigint")).alias("port"),
        F.when(k == "sshAccepted", word_after("Accepted ", m)).alias("method"),
        F.when(k == "sudo", strip(F.regexp_extract(m, r"(?s)COMMAND=(.*)$", 1))).alias("command"),
        "message",
    )
    return conform(out, "auth_log")


def sudo_log(lines: DataFrame) -> DataFrame:
    """sudo's own log: ' : '-separated records with KEY=value; fields, the first of a key wins."""
    df = split_stamp(lines)
    body = F.when(F.col("rest").startswith(":"), F.concat(F.lit(" "), F.col("rest"))).otherwise(F.col("rest"))
    df = df.withColumn("seg", F.split(body, " : ")).filter(F.size("seg") >= 3)
    df = df.select(*FILE, "timestamp", strip(F.col("seg")[0]).alias("host"), strip(F.col("seg")[1]).alias("user"), F.array_join(F.expr("slice(seg, 3, size(seg))"), " : ").alias("block_text")).filter("user <> ''")
    pieces = F.transform(F.filter(F.split("block_text", ";"), lambda s: s != ""), strip)

    def field(key: str) -> Column:
        hit = F.filter(pieces, lambda s: s.rlike(rf"^{key}[ \t]*="))
        return F.when(F.size(hit) > 0, strip(F.regexp_extract(F.get(hit, F.lit(0)), r"(?s)^[^=]*=(.*)$", 1)))

    lead = F.get(pieces, F.lit(0))
    reason = F.when((lead != "") & ~lead.contains("="), lead)
    df = df.select("*", field("COMMAND").alias("command"), field("USER").alias("target"), field("PWD").alias("pwd"), field("TTY").alias("tty"), reason.alias("reason"))
    tagged = lambda k, c: F.concat(F.lit(f"{k}="), F.col(c))
    built = F.concat_ws(" ; ", "reason", tagged("USER", "target"), tagged("PWD", "pwd"), tagged("TTY", "tty"), tagged("COMMAND", "command"))
    out = df.withColumn("message", F.when(built != "", built).otherwise(strip(F.col("block_text")))).withColumn("process", F.lit("sudo")).withColumn("kind", F.lit("sudo"))
    return conform(out, "auth_log")


def system_log(lines: DataFrame) -> DataFrame:
    """cron, su, kernel and systemd lines by category; everything else is dropped."""
    df = syslog_lines(lines)
    p, m = F.col("process"), F.col("message")
    low = F.lower(m)
    cron = p.isin("CRON", "CROND", "cron") & m.contains("CMD (")
    kernel, systemd = p == "kernel", p.isin("systemd", "init")
    has = lambda *tokens: contains_any(low, tokens)
    category = (
        F.when(cron, "cronExec")
        .when(p.isin(AUTH_PROGRAMS), None)
        .when(p == "su", "suSession")
        .when(kernel & has("usb-storage", "usb mass storage", "attached scsi removable disk"), "massStorage")
        .when(kernel & low.contains("new ") & low.contains("usb device"), "usbDevice")
        .when(kernel & has("out of memory", "oom-killer"), "outOfMemory")
        .when(kernel & (has("segfault", "general protection", "trap invalid opcode") | low.startswith("traps:")), "segfault")
        .when(kernel & has("killed process"), "processKilled")
        .when(kernel & has("i/o error", "ext4-fs error", "medium error", "ata error"), "diskError")
        .when(kernel & has("link is down", "link down"), "networkError")
        .when(systemd & has("scheduled restart job", "start request repeated too quickly", "restart counter is"), "crashLoop")
        .when(systemd & has("failed with result", "main process exited", "dumped core"), "serviceFailed")
        .when(systemd & low.startswith("started "), "serviceStarted")
        .when(systemd & low.startswith("stopped "), "serviceStopped")
    )
    df = computed(df, category=category).filter("category IS NOT NULL")
    cat = F.col("category")
    command = F.regexp_replace(F.regexp_extract(m, r"(?s)CMD \((.*)$", 1), r"\)$", "")
    unit = extract(m, r"(?:^|[ :])([^ :]*\.(?:service|timer|mount|socket))(?=[ :]|$)")
    user = F.when(cat == "cronExec", extract(m, r"^[^(]*\(([^)]*)\)")).when(cat == "suSession", extract(m, r"\(to ([^) ]+)"))
    out = df.select(
        *FILE, "timestamp", "host", "process", "pid", "category", "message", user.alias("user"),
        F.when(cat == "cronExec", command).alias("command"),
        F.when(cat.isin("crashLoop", "serviceFailed", "serviceStarted", "serviceStopped"), unit).alias("unit"),
    )
    return conform(out, "syslog")


# ---- Web logs ---------------------------------------------------------------------------------
def _clf_fields(line: Column) -> Column:
    """Blank-separated fields; quotes and brackets protect blanks and are removed."""
    raw = F.regexp_extract_all(line, F.lit(r'((?:"[^"]*(?:"|$)|\[[^\]]*(?:\]|$)|[^ "\[])+)'), 1)
    bare = F.transform(raw, lambda f: F.regexp_replace(F.regexp_replace(f, r'"([^"]*)(?:"|$)', "$1"), r"\[([^\]]*)(?:\]|$)", "$1"))
    return bare


def _request(target: Column) -> tuple[Column, Column]:
    path = F.regexp_extract(target, r"(?s)^([^?]*)", 1)
    query = F.when(target.contains("?"), F.regexp_extract(target, r"(?s)^[^?]*\?(.*)$", 1))
    return path, query


def _combined(df: DataFrame, line: Column) -> DataFrame:
    """Adds the parsed fields of a combined/common line as struct `web`, null when it is none."""
    df = computed(df, _f=_clf_fields(line))
    f = lambda i: F.get("_f", F.lit(i))
    words = F.filter(F.split(f(4), " "), lambda w: w != "")
    target = F.coalesce(F.get(words, F.lit(1)), F.lit(""))
    path, query = _request(target)
    ok = (F.size("_f") >= 7) & (f(0) != "-") & (f(0) != "") & (F.size(words) >= 1)
    absent = lambda i: F.when((F.size("_f") > i) & (f(i) != "-"), f(i))
    web = F.struct(
        F.try_to_timestamp(f(3), F.lit("dd/MMM/yyyy:HH:mm:ss Z")).alias("timestamp"),
        f(0).alias("client_ip"),
        F.get(words, F.lit(0)).alias("method"),
        path.alias("path"),
        query.alias("query"),
        F.get(words, F.lit(2)).alias("http_version"),
        F.coalesce(f(5).try_cast("int"), F.lit(0)).alias("status"),
        F.coalesce(f(6).try_cast("bigint"), F.lit(0)).alias("bytes"),
        absent(7).alias("referer"),
        absent(8).alias("user_agent"),
    )
    return computed(df, web=F.when(ok, web)).drop("_f")


def web_log(lines: DataFrame, server: str = "unknown") -> DataFrame:
    """Access logs in combined or common format."""
    df = _combined(lines.filter("line <> ''"), F.col("line")).filter("web IS NOT NULL")
    return conform(df.select(*FILE, "web.*", F.lit(server).alias("server")), "web_access")


def app_server_log(lines: DataFrame) -> DataFrame:
    """Combined lines with an optional [pid], and Started/Completed pairs.

    A Started with no Completed before the next Started gets status 0.
    """
    line = F.regexp_replace("line", r"^\[[0-9]+\] *", "")
    bare = strip(line)
    df = lines.filter("line <> ''").withColumn("bare", bare)
    rails = F.col("bare").startswith("Started ") | F.col("bare").startswith("Completed ")
    combined = _combined(df.filter(~rails), F.col("bare")).filter("web IS NOT NULL").select(*FILE, "web.*")
    own = strip(F.col("line"))
    started = r'^Started ([^ ]+) [^"]*"([^"]*)"(.*)$'
    tail = F.regexp_extract(own, started, 3)
    path, query = _request(F.regexp_extract(own, started, 2))
    ip = word_after(" for ", tail)
    begin = own.rlike(started) & F.coalesce(ip != "-", F.lit(False))
    code = F.regexp_extract(own, r"^Completed +([^ ]+)", 1).try_cast("int")
    marks = df.select(
        *FILE, *ORDER,
        F.when(begin, F.struct(F.try_to_timestamp(strip(F.regexp_extract(tail, r" at (.*)$", 1)), F.lit("yyyy-MM-dd HH:mm:ss Z")).alias("timestamp"), ip.alias("client_ip"), F.regexp_extract(own, started, 1).alias("method"), path.alias("path"), query.alias("query"))).alias("req"),
        F.when(own.startswith("Completed "), code).alias("code"),
    ).filter("req IS NOT NULL OR code IS NOT NULL")
    # The next mark decides: a code completes the request, another request leaves it open.
    mark = F.when(F.col("req").isNotNull(), F.lit(-1)).otherwise(F.col("code"))
    paired = scan(marks, FILE, line_shard(), ORDER, following={"then": mark}).filter("req IS NOT NULL")
    pairs = paired.select(*FILE, "req.*", F.when(F.col("then") >= 0, F.col("then")).otherwise(0).alias("status"), F.lit(0).alias("bytes"))
    out = combined.unionByName(pairs, allowMissingColumns=True).withColumn("server", F.lit("unknown"))
    return conform(out, "web_access")


# ---- Shell history ----------------------------------------------------------------------------
def history_user(path: Column) -> Column:
    """The folder behind home or Users, else root when it is in the path, else '?'."""
    home = extract(path, r"(?i)(?:^|[/\\])(?:home|users)[/\\]+([^/\\]+)")
    return F.coalesce(home, F.when(path.rlike(r"(?i)(?:^|[/\\])root(?:[/\\]|$)"), F.lit("root")), F.lit("?"))


def shell_history(lines: DataFrame, shell: Column | None = None) -> DataFrame:
    """bash (with '#epoch' stamp lines) and zsh (': epoch:n;command') histories."""
    shell = shell if shell is not None else F.when(F.col("source_file").contains(".zsh_history"), "zsh").otherwise("bash")
    df = lines.withColumn("shell", shell)
    line = F.col("line")
    low, high = EPOCH_RANGE
    header = (F.col("shell") == "zsh") & line.startswith(": ") & line.contains(";")
    zsh_epoch = F.regexp_extract(line, r"^: :*([^:;]*)", 1).try_cast("double")
    epoch = F.when((F.col("shell") == "bash") & line.startswith("#"), F.regexp_extract(line, r"^#([0-9.]+)$", 1).try_cast("double"))
    df = df.withColumn("stamp", F.when(epoch.between(low, high), epoch)).withColumn("own", F.when(header & zsh_epoch.between(low, high), zsh_epoch))
    # Only the directly preceding kept line can stamp a command; a command ends the stamp.
    mark = F.when(line != "", F.coalesce("stamp", F.lit(-1.0)))
    df = scan(df, FILE, line_shard(), ORDER, sums={"n": F.lit(1)}, before={"before": mark}).filter("line <> ''")
    command = F.when(header, F.regexp_extract(line, r"(?s)^[^;]*;(.*)$", 1)).otherwise(line)
    when = F.when(header, F.col("own")).when(F.col("before") >= 0, F.col("before"))
    out = df.withColumn("command", command).filter("stamp IS NULL AND command <> ''").select(
        *FILE, history_user(F.col("source_file")).alias("user"), "shell", "command",
        F.timestamp_micros(F.round(when * 1_000_000).try_cast("bigint")).alias("timestamp"), F.col("n").alias("line_number"),
    )
    return conform(out, "shell_history")


# ---- Audit ------------------------------------------------------------------------------------
def _audit_value(raw: Column) -> Column:
    """A field value: quotes removed, hex text decoded."""
    hexed = raw.rlike("^(?:[0-9A-Fa-f]{2})+$") & ~raw.rlike("^[0-9]{1,3}$")
    pairs = F.transform(F.regexp_extract_all(raw, F.lit("(..)"), 1), lambda b: F.when(b == "00", "20").otherwise(b))
    text = F.trim(F.make_valid_utf8(F.unhex(F.array_join(pairs, "")).cast("string")))
    quoted = F.regexp_replace(F.regexp_replace(raw, '^"', ""), '"$', "")
    single = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, "^'", ""), "'$", ""), '^"', ""), '"$', "")
    return F.when(raw == "", None).when(raw.startswith('"'), quoted).when(raw.startswith("'"), single).when(hexed, text).otherwise(raw)


def _sub_field(blob: Column, key: str) -> Column:
    quoted, word = extract(blob, rf'{key}="([^"]*)"?'), extract(blob, rf"{key}=([^ ),']+)")
    return F.when(blob.rlike(rf'^.*?{key}="'), quoted).otherwise(word)


AUDIT_HEAD = r"^(?:node=[^ ]* )?type=([^ ]*) msg=audit\(([^:)]*):([^:)]*)\):? ?(.*)$"
AUDIT_FIELD = r"""[^ =]+=(?:"[^"]*(?:"|$)|'[^']*(?:'|$)|[^ ]*)"""


def audit_records(lines: DataFrame) -> DataFrame:
    """Type, epoch, serial and the raw fields of each audit line; the head and the fields are matched once each."""
    mark = "\u0001"
    line = F.col("line")
    some = lines.filter(line.contains("type=") & line.contains(" msg=audit(")).select(*FILE, *ORDER, "line")
    head = computed(some, _h=F.split(F.regexp_replace(line, AUDIT_HEAD, mark.join(["$1", "$2", "$3", "$4"])), mark, 4)).drop("line")
    h = F.col("_h")
    df = computed(
        head.filter(F.size("_h") == 4), type=h[0], epoch=h[1].try_cast("double"), serial=h[2].try_cast("bigint"), _f=F.regexp_extract_all(h[3], F.lit(AUDIT_FIELD), 0)
    ).drop("_h").filter("serial IS NOT NULL")
    df = computed(df, _k=F.transform("_f", lambda f: F.substring_index(f, "=", 1)), _v=F.transform("_f", lambda f: F.substring(f, F.instr(f, F.lit("=")) + 1, F.length(f))))
    # The last value of a key wins.
    last = lambda k: F.element_at(F.col("_v"), (F.size("_k") - F.array_position(F.reverse("_k"), k) + 1).cast("int"))
    keys = F.array_distinct("_k")
    return computed(df, fields=F.map_from_arrays(keys, F.transform(keys, last))).drop("_f", "_k", "_v")


def _argv(fields: Column) -> Column:
    """argv rebuilt from the decoded values a0, a1, … and the pieces a0[0], a0[1], … of long arguments."""
    names = F.map_keys(fields)
    numbered_args = F.filter(names, lambda k: k.rlike(r"^a[0-9]+(?:_len|\[[0-9]+\])?$"))
    index = F.array_sort(F.array_distinct(F.transform(numbered_args, lambda k: F.regexp_extract(k, "^a([0-9]+)", 1).try_cast("int"))))
    index = F.filter(index, lambda i: i.isNotNull())

    def one(i: Column) -> Column:
        base = F.concat(F.lit("a"), i.cast("string"))
        parts = F.filter(names, lambda k: k.startswith(F.concat(base, F.lit("["))))
        ordered = F.array_sort(F.transform(parts, lambda k: F.struct(F.regexp_extract(k, r"\[([0-9]+)\]", 1).try_cast("int").alias("n"), k.alias("k"))))
        joined = F.array_join(F.transform(ordered, lambda s: F.coalesce(F.element_at(fields, s["k"]), F.lit(""))), "")
        return F.when(F.map_contains_key(fields, base), F.coalesce(F.element_at(fields, base), F.lit(""))).otherwise(joined)

    text = F.trim(F.array_join(F.transform(index, one), " "))
    return F.when(text != "", text)


def audit_log(lines: DataFrame, by_serial: bool = False) -> DataFrame:
    """Lines of one serial folded into one event.

    As specified, a group ends where the serial changes from one line to the next;
    by_serial=True joins all lines of a serial in a file instead.
    """
    rec = audit_records(lines)
    if by_serial:
        rec = rec.withColumn("island", F.col("serial"))
    else:
        rec = runs(rec, FILE, line_shard(), ORDER, "serial", "island")
    kind = F.col("type")
    at = F.struct("block", "line_no")
    is_user = kind.rlike("^(?:USER_|CRED_|ADD_|DEL_)") | kind.isin("GRP_MGMT", "LOGIN", "ANOM_ABEND")

    def first(cond: Column) -> Column:
        return F.min_by("fields", F.when(cond, at))

    ev = rec.groupBy(*FILE, "island", "serial").agg(
        F.min_by("epoch", F.when(F.col("epoch").isNotNull(), at)).alias("epoch"),
        F.min_by("type", at).alias("first_type"),
        first(kind == "SYSCALL").alias("sc"), first(kind == "EXECVE").alias("ex"), first(kind == "PROCTITLE").alias("pt"),
        first(kind == "CWD").alias("cwd"), first(kind == "PATH").alias("pth"), first(is_user).alias("us"),
        first(kind.isin("AVC", "USER_AVC")).alias("avc"),
    )
    f = lambda m, k: F.element_at(F.col(m), F.lit(k))
    num = f("sc", "syscall").try_cast("int")
    table = F.when(f("sc", "arch") == ARCH_AARCH64, _map(SYSCALLS_AARCH64, num)).otherwise(_map(SYSCALLS_X86_64, num))
    syscall = F.when(num.isNotNull(), F.coalesce(table, F.concat(F.lit("syscall="), num.cast("string"))))

    def ident(k: str) -> Column:
        v = F.coalesce(f("sc", k), f("us", k)).try_cast("bigint")
        return F.when(v != UNSET_ID, v)

    # All values that need it are decoded once, by one expression for the single ones and one for the arguments.
    wanted = [("pth", "name"), ("cwd", "cwd"), ("sc", "key"), ("pt", "proctitle"), ("sc", "exe"), ("avc", "exe"), ("sc", "comm"), ("sc", "tty"), ("us", "acct"), ("us", "id")]
    ev = computed(ev, _values=F.transform(F.array(*[f(m, k) for m, k in wanted]), _audit_value), _args=F.transform_values("ex", lambda k, v: _audit_value(v)))
    value = lambda m, k: F.col("_values")[wanted.index((m, k))]
    name, cwd = value("pth", "name"), value("cwd", "cwd")
    path = F.when(name.isNull(), cwd).when(name.startswith("/") | cwd.isNull(), name).otherwise(F.concat(cwd, F.lit("/"), name))
    nested = F.coalesce(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(f("us", "msg"), "^'", ""), "'$", ""), '^"', ""), '"$', ""), F.lit(""))
    outcome = F.coalesce(f("us", "res"), _sub_field(nested, "res"))
    result = F.when(F.lower(outcome).isin("1", "success"), "success").when(F.lower(outcome).isin("0", "failed"), "failed").otherwise(outcome)
    addr = F.coalesce(f("us", "addr"), _sub_field(nested, "addr"))
    key = value("sc", "key")
    command = F.coalesce(F.when(F.col("ex").isNotNull(), _argv(F.col("_args"))), value("pt", "proctitle"))
    out = ev.select(
        *FILE, F.timestamp_micros(F.round(F.col("epoch") * 1_000_000).try_cast("bigint")).alias("timestamp"), "serial",
        F.when(F.col("ex").isNotNull(), "EXECVE").when(F.col("sc").isNotNull(), "SYSCALL").otherwise(F.col("first_type")).alias("record_type"),
        syscall.alias("syscall"), F.when(f("sc", "success").isNotNull(), f("sc", "success") == "yes").alias("success"),
        f("sc", "exit").try_cast("bigint").alias("exit"), F.coalesce(value("sc", "exe"), value("avc", "exe")).alias("exe"),
        value("sc", "comm").alias("comm"), command.alias("command_line"), path.alias("path"),
        ident("auid").alias("auid"), ident("uid").alias("uid"), ident("ses").alias("ses"), value("sc", "tty").alias("tty"),
        F.when(key != "(null)", key).alias("key"),
        F.coalesce(value("us", "acct"), _sub_field(nested, "acct"), value("us", "id")).alias("account"),
        result.alias("result"), F.when(~addr.isin("?", ""), addr).alias("source_ip"),
    )
    return conform(out, "audit")


# ---- Packages ---------------------------------------------------------------------------------
def dpkg_log(lines: DataFrame) -> DataFrame:
    df = computed(lines, w=F.filter(F.split("line", " "), lambda x: x != "")).filter(F.size("w") >= 4)
    w = lambda i: F.get("w", F.lit(i))
    version = F.when(F.size("w") >= 6, w(5)).when(F.size("w") >= 5, w(4))
    df = df.filter(w(2).isin("install", "upgrade", "remove", "purge"))
    out = df.select(
        *FILE, F.try_to_timestamp(F.concat_ws(" ", w(0), w(1)), F.lit("yyyy-MM-dd HH:mm:ss")).alias("timestamp"), w(2).alias("action"),
        F.regexp_extract(w(3), r"^:*([^:]+)", 1).alias("package"), F.when(version != "<none>", version).alias("version"), F.lit("dpkg").alias("manager"),
    )
    return conform(out, "packages")


def apt_history(lines: DataFrame) -> DataFrame:
    """Blank-line blocks; the block's start date holds for the lines below it."""
    df = lines.withColumn("t", F.trim("line"))
    t = F.col("t")
    start = t.startswith("Start-Date:")
    text = F.regexp_replace(F.trim(F.regexp_extract(t, r"^Start-Date:(.*)$", 1)), "  ", " ")
    # A date line sets the date (even to none), a blank line clears it.
    mark = F.when(start, F.struct(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).alias("at"))).when(t == "", F.struct(F.lit(None).cast("timestamp").alias("at")))
    df = scan(df, FILE, line_shard(), ORDER, last={"stamp": mark})
    action = F.lower(extract(t, "^(" + "|".join(APT_ACTIONS) + "):"))
    df = df.withColumn("action", action).filter("action IS NOT NULL")
    items = F.transform(F.split(F.regexp_extract("t", r"^[^:]*:(.*)$", 1), r",(?![^(]*\))"), lambda i: F.trim(i))
    df = df.withColumn("item", F.explode(F.filter(items, lambda i: i != "")))
    name = F.regexp_extract("item", r"^([^ ]+)", 1)
    version = extract(F.col("item"), r"\(([^),]*)[,)]")
    out = df.select(
        *FILE, F.col("stamp.at").alias("timestamp"), "action", F.regexp_extract(name, r"^:*([^:]+)", 1).alias("package"),
        F.trim(version).alias("version"), F.lit("apt").alias("manager"),
    )
    return conform(out, "packages")


def yum_log(lines: DataFrame, manager: str = "yum") -> DataFrame:
    verb = "(" + "|".join(YUM_ACTIONS) + "): "
    line = F.col("line")
    df = lines.withColumn("verb", extract(line, verb)).filter("verb IS NOT NULL")
    nevra = F.trim(F.regexp_extract(line, rf"^.*?{verb}(.*)$", 2))
    cleaned = F.regexp_replace(nevra, "^1:", "")
    split_at = r"^-*((?:[^0-9-][^-]*-+)*?)([0-9].*)$"
    name = F.regexp_replace(F.regexp_extract(cleaned, split_at, 1), "-+$", "")
    version = F.regexp_replace(F.regexp_extract(cleaned, split_at, 2), r"\.(?:x86_64|noarch|i686|aarch64|amd64)$", "")
    known = cleaned.contains("-") & cleaned.rlike(split_at)
    prefix = F.trim(F.regexp_extract(line, rf"^(.*?){verb}", 1))
    iso = F.when((F.length(prefix) >= 19) & (F.substring(prefix, 5, 1) == "-"), zoned_instant(F.regexp_replace(prefix, " ", "")))
    cls = r"^([A-Z][a-z]{2}) +([0-9]{1,2}) +([0-9]+):([0-9]+):([0-9]+)"
    parts = [F.regexp_extract(prefix, cls, i) for i in range(1, 6)]
    classic = F.when(prefix.rlike(cls), yearless(parts[0], parts[1], parts[2:5], F.col("anchor")))
    out = df.select(
        *FILE, F.coalesce(iso, classic).alias("timestamp"), _map(YUM_ACTIONS, F.col("verb")).alias("action"),
        F.when(known & (name != ""), name).otherwise(cleaned).alias("package"), F.when(known & (version != ""), version).alias("version"), F.lit(manager).alias("manager"),
    )
    return conform(out, "packages")
