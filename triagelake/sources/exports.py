"""Tables exported by other tools, mapped to case tables.

Inputs are DataFrames of the exported tables (from Parquet, CSV or a JDBC read of the
original database); nothing here opens a database.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.functions import times
from triagelake.functions.ordered import scan
from triagelake.functions.text import contains_any, first_match, has_bit
from triagelake.operators.findings import union
from triagelake.sources.lines import FILE
from triagelake.tables import conform

# ---- Fixed values -----------------------------------------------------------------------------
UNALLOCATED, DIRECTORY = 2, 2
FS_TYPES = {
    1: "NTFS", 2: "FAT12", 4: "FAT16", 8: "FAT32", 0x0A: "exFAT", 0x0E: "FAT", 0x80: "Ext2", 0x100: "Ext3",
    0x2000: "Ext4", 0x2180: "ExtX", 0x1000: "HFS+", 0x8000: "APFS", 0x800: "ISO9660",
}
SID_TYPE = 3
OLE_EPOCH_S = -2_209_161_600


def blank(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col != "", col)


# ---- File systems -----------------------------------------------------------------------------
def file_listing(rows: DataFrame) -> DataFrame:
    """Listed files without the dot entries."""
    deleted = has_bit(F.coalesce("meta_flags", F.lit(0)), UNALLOCATED) | has_bit(F.coalesce("dir_flags", F.lit(0)), UNALLOCATED)
    kept = rows.filter(~F.col("name").isin(".", ".."))
    out = kept.select(
        "host_id", F.col("obj_id").alias("id"), "meta_addr", F.col("fs_obj_id").alias("fs_id"), F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("parent_path", F.lit("/")).alias("parent_path"), F.coalesce("size", F.lit(0)).alias("size"),
        F.coalesce(F.col("meta_type") == DIRECTORY, F.lit(False)).alias("is_directory"), deleted.alias("is_deleted"),
        *[times.from_unix_seconds(F.col(c)).alias(n) for c, n in (("mtime", "modified"), ("atime", "accessed"), ("ctime", "changed"), ("crtime", "created"))],
    )
    return conform(out, "files")


def fs_type_name(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for p in FS_TYPES.items() for x in p])
    return F.coalesce(F.element_at(table, code.cast("int")), F.concat(F.lit("FS(0x"), F.lower(F.hex(code)), F.lit(")")))


def volumes(rows: DataFrame) -> DataFrame:
    zero = F.lit(0)
    out = rows.select(
        "host_id", F.col("obj_id").alias("id"), fs_type_name(F.coalesce("fs_type", zero)).alias("fs_type"),
        F.coalesce("img_offset", zero).alias("offset_bytes"), (F.coalesce("block_size", zero) * F.coalesce("block_count", zero)).alias("size_bytes"),
    )
    return conform(out, "volumes")


def extract_info(files: DataFrame, file_systems: DataFrame) -> DataFrame:
    """Start sector and record number a file's bytes are read from."""
    fs = file_systems.select("host_id", F.col("obj_id").alias("fs_obj_id"), F.coalesce("img_offset", F.lit(0)).alias("img_offset"))
    joined = files.join(fs, ["host_id", "fs_obj_id"])
    return joined.select("host_id", F.col("obj_id").alias("id"), F.call_function("div", F.col("img_offset"), F.lit(512)).alias("offset_sectors"), F.coalesce("meta_addr", F.lit(0)).alias("meta_addr"))


def folder_listing(spark: SparkSession, root: str, host_id: str) -> DataFrame:
    """Files below a folder. Only names, sizes and times are read, never the bytes; empty files come without a time."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    # Spark's file sources leave empty files out; they are taken from the list of files that the reader holds anyway.
    named = spark.createDataFrame([(p,) for p in raw.inputFiles()], "path string").withColumn("path", F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))))
    plain = F.regexp_replace("path", "^([a-z0-9]+:)/*", "$1/")
    empty = named.withColumn("path", plain).join(raw.select(plain.alias("path")), "path", "left_anti")
    raw = raw.unionByName(empty.withColumn("length", F.lit(0).cast("bigint")), allowMissingColumns=True)
    base = root.rstrip("/").split(":", 1)[-1]
    rel = F.concat(F.lit("/"), F.regexp_replace("path", rf"^[a-z0-9]*:?/*{base.lstrip('/')}/*", ""))
    name = F.regexp_extract(rel, r"([^/]+)$", 1)
    df = raw.select(rel.alias("rel"), name.alias("name"), "length", "modificationTime").filter("name <> '.DS_Store'")
    ident = F.xxhash64("rel").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF).cast("bigint"))
    out = df.select(
        F.lit(host_id).alias("host_id"), ident.alias("id"), "name", F.regexp_replace("rel", r"[^/]+$", "").alias("parent_path"),
        F.col("length").alias("size"), F.lit(False).alias("is_directory"), F.lit(False).alias("is_deleted"), F.col("modificationTime").alias("modified"),
    )
    return conform(out, "files")


def _body_time(field: Column) -> Column:
    secs = F.regexp_extract(field, r"^([^.]*)", 1).try_cast("bigint")
    frac = F.rpad(F.substring(F.regexp_extract(field, r"\.([0-9]{1,9})", 1), 1, 6), 6, "0")
    return F.when(secs > 0, F.timestamp_micros(secs * 1_000_000 + F.when(field.contains("."), F.coalesce(frac.try_cast("bigint"), F.lit(0))).otherwise(0)))


def bodyfile(lines: DataFrame) -> DataFrame:
    """mactime body lines. The name may hold '|', so fields are counted from the end."""
    line = F.regexp_replace("line", r"^\s+|\s+$", "")
    df = lines.withColumn("t", line).filter((F.col("t") != "") & ~F.col("t").startswith("#")).withColumn("p", F.split("t", r"\|", -1)).filter(F.size("p") >= 11)
    tail = lambda i: F.element_at("p", F.lit(i - 9))
    named = F.array_join(F.slice("p", F.lit(2), F.size("p") - 10), "|")
    mode = tail(1)
    link = mode.startswith("l") & named.contains(" -> ")
    df = df.withColumn("named", named).withColumn("inode", tail(0).try_cast("decimal(20,0)")).filter("inode IS NOT NULL")
    return df.select(
        *FILE, F.get("p", F.lit(0)).alias("md5"),
        F.when(link, F.regexp_extract("named", r"(?s)^(.*?) -> ", 1)).otherwise(F.col("named")).alias("path"),
        F.when(link, F.regexp_extract("named", r"(?s)^.*? -> (.*)$", 1)).alias("symlink_target"),
        F.col("inode").try_cast("bigint").alias("inode"), mode.alias("mode"),
        *[F.coalesce(tail(i).try_cast("bigint"), F.lit(0)).alias(n) for i, n in ((2, "uid"), (3, "gid"), (4, "size"))],
        *[_body_time(tail(i)).alias(n) for i, n in ((5, "accessed"), (6, "modified"), (7, "changed"), (8, "created"))],
        mode.startswith("d").alias("is_directory"),
    )


def bodyfile_files(rows: DataFrame, fs_id: int) -> DataFrame:
    """Body rows as files of one volume; the id is a hash of volume, inode and path."""
    stripped = F.regexp_replace("path", r"^/\{.*?\}/", "/")
    clean = F.regexp_replace(stripped, "^//", "/")
    path = F.when(clean.startswith("/"), clean).otherwise(F.concat(F.lit("/"), clean))
    df = rows.filter("path <> ''").withColumn("full", path).withColumn("name", F.regexp_extract("full", r"([^/]+)/*$", 1)).filter("name <> ''")
    parent = F.regexp_replace(F.regexp_replace("full", "/+$", ""), r"[^/]+$", "")
    ident = F.xxhash64(F.lit(fs_id), "inode", "full").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF).cast("bigint"))
    out = df.select(
        "host_id", ident.alias("id"), F.col("inode").alias("meta_addr"), F.lit(fs_id).alias("fs_id"), "name", parent.alias("parent_path"), "size",
        "is_directory", F.lit(False).alias("is_deleted"), "modified", "accessed", "changed", "created",
    )
    return conform(out, "files")


# ---- Browsers ---------------------------------------------------------------------------------
def browser_of(path: Column) -> Column:
    p = F.lower(path)
    return F.coalesce(first_match([
        (contains_any(p, ["bravesoftware", "\\brave", "/brave"]), "brave"),
        (contains_any(p, ["microsoft\\edge", "microsoft/edge", "\\edge\\"]), "edge"),
        (contains_any(p, ["google\\chrome", "google/chrome"]), "chrome"),
        (contains_any(p, ["opera software", "opera stable", "\\opera"]), "opera"),
        (p.contains("vivaldi"), "vivaldi"),
        (contains_any(p, ["mozilla\\firefox", "mozilla/firefox"]) | p.endswith("places.sqlite"), "firefox"),
        (p.contains("/safari/") & p.endswith("history.db"), "safari"),
    ]), F.lit("unknown"))


def profile_of(path: Column) -> Column:
    """The folder the file lies in."""
    parts = F.filter(F.split(path, r"[\\/]"), lambda p: p != "")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2))


def _history(df: DataFrame) -> DataFrame:
    return conform(df.filter("url <> ''").withColumn("user_profile", profile_of(F.col("source_file"))), "browser_history")


def chromium_history(urls: DataFrame, downloads: DataFrame) -> DataFrame:
    visits = urls.filter("last_visit_time > 0").select(
        *FILE, browser_of(F.col("source_file")).alias("browser"), F.lit("visit").alias("kind"), "url", blank("title").alias("title"),
        times.from_webkit(F.col("last_visit_time")).alias("timestamp"), "visit_count", "typed_count",
    )
    have = set(downloads.columns)
    first = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have], F.lit(None).cast("string"))
    target = first("target_path", "current_path", "full_path")
    saved = downloads.select(
        *FILE, browser_of(F.col("source_file")).alias("browser"), F.lit("download").alias("kind"),
        F.coalesce(first("tab_url", "url", "referrer"), target, F.lit("")).alias("url"), times.from_webkit(F.col("start_time")).alias("timestamp"),
        target.alias("target_path"), F.col("received_bytes"), F.col("total_bytes"), (blank("tab_url") if "tab_url" in have else F.lit(None)).alias("referrer"),
    )
    return _history(visits.unionByName(saved, allowMissingColumns=True))


def firefox_history(places: DataFrame) -> DataFrame:
    return _history(places.filter("last_visit_date > 0").select(
        *FILE, F.lit("firefox").alias("browser"), F.lit("visit").alias("kind"), "url", blank("title").alias("title"),
        times.from_unix_micros(F.col("last_visit_date")).alias("timestamp"), "visit_count", F.col("typed").alias("typed_count"),
    ))


def safari_history(items: DataFrame, visits: DataFrame) -> DataFrame:
    """Last visit per item; the title is the one of that visit."""
    last = visits.filter("visit_time > 0").groupBy(*FILE, F.col("history_item").alias("id")).agg(
        F.max("visit_time").alias("visit_time"), F.max_by("title", F.struct("visit_time", "title")).alias("title")
    )
    return _history(items.join(last, [*FILE, "id"]).select(
        *FILE, F.lit("safari").alias("browser"), F.lit("visit").alias("kind"), "url", blank("title").alias("title"),
        times.from_apple_seconds(F.col("visit_time")).alias("timestamp"), "visit_count",
    ))


# ---- Messages, mail, activity, notifications --------------------------------------------------
def messages(message: DataFrame, handle: DataFrame, chat: DataFrame, chat_join: DataFrame, scope: str = "") -> DataFrame:
    """Messages with sender handle and the first named chat of each."""
    who = handle.filter("id <> ''").select("host_id", F.col("rowid").alias("handle_id"), F.col("id").alias("handle"))
    named = chat.filter("display_name <> ''").select("host_id", F.col("rowid").alias("chat_id"), "display_name")
    rooms = chat_join.join(named, ["host_id", "chat_id"]).groupBy("host_id", F.col("message_id").alias("rowid")).agg(F.min_by("display_name", "chat_id").alias("chat_name"))
    df = message.join(who, ["host_id", "handle_id"], "left").join(rooms, ["host_id", "rowid"], "left")
    out = df.select(
        *FILE, "guid", blank("service").alias("service"), "handle", F.coalesce(F.col("is_from_me") != 0, F.lit(False)).alias("is_from_me"), blank("text").alias("text"),
        times.from_apple_mixed(F.col("date")).alias("timestamp"), F.coalesce(F.col("cache_has_attachments") != 0, F.lit(False)).alias("has_attachment"), "chat_name", F.lit(scope).alias("scope"),
    )
    return conform(out, "messages")


def mail(message: DataFrame, subjects: DataFrame, addresses: DataFrame, mailboxes: DataFrame, recipients: DataFrame, scope: str = "") -> DataFrame:
    """Mail with subject, sender, mailbox and the recipients of each message joined by ', '."""
    def look(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
        return df.filter(F.col(value) != "").select("host_id", F.col("rowid").alias(key), F.col(value).alias(name))

    to = recipients.join(addresses.select("host_id", F.col("rowid").alias("address_id"), "address"), ["host_id", "address_id"], "left")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("address").isNotNull(), F.struct("address_id", "address")))), lambda s: s["address"]), ", ")
    to = to.groupBy("host_id", F.col("message_key").alias("rowid")).agg(joined.alias("recipients"))
    df = (
        message.withColumnsRenamed({"subject": "subject_id", "sender": "sender_id", "mailbox": "mailbox_id"})
        .join(look(subjects, "subject_id", "subject", "subject"), ["host_id", "subject_id"], "left")
        .join(look(addresses, "sender_id", "address", "sender"), ["host_id", "sender_id"], "left")
        .join(look(addresses, "sender_id", "comment", "sender_display"), ["host_id", "sender_id"], "left")
        .join(look(mailboxes, "mailbox_id", "url", "mailbox"), ["host_id", "mailbox_id"], "left")
        .join(to, ["host_id", "rowid"], "left")
    )
    out = df.select(
        *FILE, "subject", "sender", "sender_display", blank("recipients").alias("recipients"), times.from_unix_seconds(F.col("date_sent")).alias("date_sent"),
        times.from_unix_seconds(F.col("date_received")).alias("date_received"), "mailbox", F.lit(scope).alias("scope"),
    )
    return conform(out, "mail")


def apple_or_unix(v: Column) -> Column:
    """Seconds since 2001, or since 1970 when the number is too large for that."""
    return F.when(v > 1_000_000_000, times.from_unix_seconds(v)).otherwise(times.from_apple_seconds(v))


def quick_look(files: DataFrame, thumbnails: DataFrame, scope: str = "") -> DataFrame:
    """Previewed files with the last time and the number of views."""
    hits = thumbnails.groupBy(*FILE, F.col("file_id").alias("rowid")).agg(F.max("last_hit_date").alias("seen"), F.sum("hit_count").alias("views"))
    df = files.filter("file_name <> '' AND folder IS NOT NULL").join(hits, [*FILE, "rowid"], "left")
    path = F.concat(F.regexp_replace("folder", "/+$", ""), F.lit("/"), F.col("file_name"))
    path = F.when(F.col("folder") == "", F.col("file_name")).otherwise(path)
    out = df.select(
        *FILE, F.lit("quickLook").alias("kind"), path.alias("path"), apple_or_unix(F.col("seen")).alias("timestamp"),
        F.when(F.col("views") > 0, F.concat(F.lit("viewed "), F.col("views").cast("string"), F.lit("×"))).otherwise("viewed").alias("detail"), F.lit(scope).alias("scope"),
    )
    return conform(out, "user_activity")


def document_versions(generations: DataFrame, files: DataFrame, scope: str = "") -> DataFrame:
    paths = files.select("host_id", F.col("file_storage_id").alias("generation_storage_id"), F.coalesce(blank("file_path"), blank("file_name")).alias("p"))
    paths = paths.filter("p IS NOT NULL").groupBy("host_id", "generation_storage_id").agg(F.max("p").alias("p"))
    df = generations.join(paths, ["host_id", "generation_storage_id"], "left").withColumn("file_path", F.coalesce("p", blank("generation_name"))).filter("file_path IS NOT NULL")
    out = df.select(*FILE, "file_path", apple_or_unix(F.col("generation_add_time")).alias("version_time"), F.col("generation_size").alias("size"), blank("generation_path").alias("generation_path"), F.lit(scope).alias("scope"))
    return conform(out, "doc_versions")


def notifications(record: DataFrame, app: DataFrame, scope: str = "") -> DataFrame:
    """Delivered notifications with the app's identifier; title and body come decoded."""
    names = app.filter("identifier <> ''").groupBy("host_id", "app_id").agg(F.max("identifier").alias("ident"))
    df = record.withColumnRenamed("app_id", "app_key").join(names.withColumnRenamed("app_id", "app_key"), ["host_id", "app_key"], "left")
    out = df.select(*FILE, F.col("ident").alias("app_id"), "title", "body", F.coalesce(apple_or_unix(F.col("delivered_date")), apple_or_unix(F.col("request_date"))).alias("delivered_date"), F.lit(scope).alias("scope"))
    return conform(out, "notifications")


# ---- Powerlog ---------------------------------------------------------------------------------
def correct_clock(rows: DataFrame, offsets: DataFrame, column: str = "raw", out: str = "date", shard_s: float = 600) -> DataFrame:
    """As-of join: each raw time plus the latest offset at or before it; before the first
    offset the earliest one; no offset for the host, none. Times up to 1e9 are dropped to null.

    Offsets and rows are ordered together (offsets first on ties) in shards of ten minutes, so a
    host with most of the rows is still spread over many tasks. Rows without a time are not ordered at all.
    """
    cols = rows.columns
    undated = rows.filter(F.col(column).isNull()).select(*cols, F.lit(None).cast("timestamp").alias(out))
    rows = rows.filter(F.col(column).isNotNull())
    marked = rows.withColumn("_ord", F.lit(1)).withColumn("_off", F.lit(None).cast("double")).withColumn("_at", F.col(column).cast("double"))
    marks = offsets.filter("timestamp IS NOT NULL").select("host_id", F.lit(0).alias("_ord"), F.coalesce(F.col("system").cast("double"), F.lit(0.0)).alias("_off"), F.col("timestamp").cast("double").alias("_at"))
    both = marked.unionByName(marks, allowMissingColumns=True)
    carried = scan(both, ["host_id"], F.floor(F.col("_at") / shard_s), ["_at", "_ord"], last={"_seen": F.col("_off")}).filter("_ord = 1")
    earliest = marks.groupBy("host_id").agg(F.min_by("_off", "_at").alias("_first"))
    joined = carried.join(earliest, "host_id", "left")
    fixed = F.col("_at") + F.coalesce("_seen", "_first", F.lit(0.0))
    dated = joined.select(*cols, F.when(F.col("_at") > 1_000_000_000, F.timestamp_micros(F.round(fixed * 1_000_000).try_cast("bigint"))).alias(out))
    return dated.unionAll(undated)


def powerlog(process: DataFrame, lifecycle: DataFrame, frontmost: DataFrame, network: DataFrame, offsets: DataFrame, apps: DataFrame, scope: str = "") -> DataFrame:
    """Four event tables in one shape, clock corrected, names looked up by bundle."""
    def part(df: DataFrame, kind: str, bundle: str, **cols: Column) -> DataFrame:
        base = {"process_name": F.lit(None).cast("string"), "pid": F.lit(None).cast("bigint"), "event": F.lit(None).cast("string"), "raw_end": F.lit(None).cast("double"), "bytes_in": F.lit(None).cast("bigint"), "bytes_out": F.lit(None).cast("bigint")}
        base.update(cols)
        return df.select(*FILE, F.lit(kind).alias("kind"), blank(bundle).alias("bundle_id"), F.col("timestamp").cast("double").alias("raw"), *[c.alias(n) for n, c in base.items()])

    zero = F.lit(0)
    total = lambda *names: sum((F.coalesce(F.col(n), zero) for n in names), F.lit(0)).cast("bigint")
    rows = union([
        part(process, "process", "BundleID", process_name=blank("ProcessName"), pid=F.col("PID").try_cast("bigint")),
        part(lifecycle, "appLifecycle", "BundleID", pid=F.col("PID").try_cast("bigint"), event=blank("EVENT")),
        part(frontmost, "frontmost", "BundleID"),
        part(network, "network", "BundleName", process_name=blank("ProcessName"), raw_end=F.col("timestampEnd").try_cast("double"), bytes_in=total("WiFiIn", "CellIn"), bytes_out=total("WiFiOut", "CellOut")),
    ])
    rows = correct_clock(rows, offsets, "raw", "date")
    rows = correct_clock(rows, offsets, "raw_end", "end_date").filter("date IS NOT NULL")
    label = F.coalesce(blank("Name"), blank("Executable"), blank("CFDisplayName"), blank("LSDisplayName"))
    names = apps.select("host_id", F.col("BundleID").alias("bundle_id"), label.alias("app")).filter("bundle_id <> '' AND app IS NOT NULL").groupBy("host_id", "bundle_id").agg(F.min("app").alias("app"))
    out = rows.join(names, ["host_id", "bundle_id"], "left").withColumn("process_name", F.coalesce("process_name", "app")).withColumn("scope", F.lit(scope))
    return conform(out, "powerlog")


# ---- Amcache and SRUM -------------------------------------------------------------------------
def amcache(registry: DataFrame) -> DataFrame:
    """Program entries rebuilt from the values of each key, in the current and the older layout."""
    df = registry.filter(F.lower("hive") == "amcache")
    name, raw = F.lower("name"), F.regexp_replace("data", r"^\s+|\s+$", "")

    def value(*names: str) -> Column:
        # The first of the names that is present decides, even when it is blank.
        return F.coalesce(*[F.min(F.when(name == n.lower(), raw)) for n in names])

    wanted = ["LowerCaseLongPath", "FileId", "Size", "LinkDate", "ProductName", "BinaryType", "15", "101", "6", "1"]
    low = F.lower("path")
    agg = df.groupBy("host_id", "path").agg(
        *[value(n).alias(f"v_{n.lower()}") for n in wanted],
        value("Publisher", "ProductVersion").alias("v_pub"), value("17", "12").alias("v_link"), value("0", "100").alias("v_prod"),
        F.max("last_written").alias("registered_at"), F.min("source_file").alias("source_file"),
    )
    modern = low.contains("\\inventoryapplicationfile\\")
    legacy = ~modern & low.contains("\\file\\")
    pick = lambda a, b: blank(F.when(modern, F.col(a)).otherwise(F.col(b)))
    file_id = pick("v_fileid", "v_101")
    hexed = F.when((F.length(file_id) == 44) & file_id.startswith("0000"), F.substring(file_id, 5, 40)).otherwise(file_id)
    sha1 = F.when(hexed.rlike("^[0-9A-Fa-f]{40}$"), F.lower(hexed))
    full = pick("v_lowercaselongpath", "v_15")
    size = pick("v_size", "v_6")
    number = F.when(F.lower(size).startswith("0x"), F.conv(F.substring(size, 3, 32), 16, 10).try_cast("bigint")).otherwise(size.try_cast("bigint"))
    link = pick("v_linkdate", "v_link")
    stamp = F.coalesce(*[F.try_to_timestamp(link, F.lit(p)) for p in ("MM/dd/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "MMM dd, yyyy HH:mm:ss.SSS z")])
    last = F.regexp_extract("path", r"([^\\]+)\\*$", 1)
    leaf = F.regexp_extract(full, r"([^\\/]+)[\\/]*$", 1)
    out = agg.filter(modern | legacy).select(
        "host_id", F.when(full.isNotNull(), leaf).when(last != "", last).otherwise("(unknown)").alias("name"), full.alias("full_path"), sha1.alias("sha1"),
        number.alias("size"), stamp.alias("link_date"), pick("v_productname", "v_prod").alias("product_name"), pick("v_pub", "v_1").alias("publisher"),
        F.when(modern, blank("v_binarytype")).alias("binary_type"), "registered_at", F.when(modern, "inventoryApplicationFile").otherwise("legacyFile").alias("source"), "source_file",
    )
    return conform(out.filter("full_path IS NOT NULL OR sha1 IS NOT NULL"), "amcache")


def read_tsv(spark: SparkSession, path: str, host_id: str) -> DataFrame:
    """A headered tab-separated export with lower-case column names, all text."""
    df = spark.read.option("sep", "\t").option("header", True).option("inferSchema", False).csv(path)
    return df.toDF(*[c.lower() for c in df.columns]).withColumn("host_id", F.lit(host_id)).withColumn("source_file", F.col("_metadata.file_path"))


def sid_text(raw: Column) -> Column:
    """S-revision-authority-sub… of a binary SID, null when it is too short."""
    h = F.hex(raw)
    num = lambda s: F.conv(s, 16, 10)
    count = num(F.substring(h, 3, 2)).try_cast("int")

    def sub(i: Column) -> Column:
        at = i * 8 + 17
        little = F.concat(*[F.substring(h, at + o, F.lit(2)) for o in (6, 4, 2, 0)])
        return num(little)

    subs = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), sub)).otherwise(F.array().cast("array<string>"))
    text = F.concat_ws("-", F.lit("S"), num(F.substring(h, 1, 2)), num(F.substring(h, 5, 12)), subs)
    return F.when((F.octet_length(raw) >= 8) & (F.octet_length(raw) >= 8 + count * 4), text)


def utf16_text(raw: Column) -> Column:
    """UTF-16LE text up to the first NUL; an odd last byte is ignored."""
    units = F.regexp_extract_all(F.hex(raw), F.lit("(....)"), 1)
    stop = F.array_position(units, F.lit("0000")).cast("int")
    kept = F.when(stop > 0, F.slice(units, F.lit(1), stop - 1)).otherwise(units)
    return F.when(F.size(kept) > 0, F.decode(F.unhex(F.array_join(kept, "")), "UTF-16LE"))


def srum_ids(rows: DataFrame) -> DataFrame:
    """(host, id, text) of the id map."""
    raw = F.unhex(F.when(F.col("idblob").rlike("^(?:[0-9A-Fa-f]{2})+$"), F.col("idblob")))
    text = F.when(F.trim("idtype").try_cast("int") == SID_TYPE, sid_text(raw)).otherwise(utf16_text(raw))
    ids = rows.select("host_id", F.trim("idindex").try_cast("bigint").alias("id"), text.alias("text")).filter("id IS NOT NULL AND text <> ''")
    return ids.groupBy("host_id", "id").agg(F.max("text").alias("text"))


def srum_time(text: Column) -> Column:
    t = F.trim(text)
    plain = F.regexp_replace(F.regexp_replace(t, r"\.[^.]*$", ""), " +", " ")
    days = t.try_cast("double")
    return F.coalesce(
        F.try_to_timestamp(plain, F.lit("MMM d, yyyy HH:mm:ss")), F.try_to_timestamp(plain, F.lit("MMM d, yyyy")),
        F.timestamp_micros(F.round((days * 86_400 + OLE_EPOCH_S) * 1_000_000).try_cast("bigint")),
    )


def srum(id_map: DataFrame, network: DataFrame | None = None, apps: DataFrame | None = None, connectivity: DataFrame | None = None) -> DataFrame:
    """The three usage tables with their ids resolved; an unknown id stays null."""
    ids = srum_ids(id_map)
    num = lambda c: F.trim(c).try_cast("bigint")

    def part(df: DataFrame, kind: str, **cols: Column) -> DataFrame:
        base = df.select(*FILE, F.lit(kind).alias("kind"), srum_time(F.col("timestamp")).alias("timestamp"), num("appid").alias("a"), num("userid").alias("u"), *[c.alias(n) for n, c in cols.items()])
        app = ids.select("host_id", F.col("id").alias("a"), F.col("text").alias("application"))
        sid = ids.select("host_id", F.col("id").alias("u"), F.col("text").alias("user_sid"))
        return conform(base.join(app, ["host_id", "a"], "left").join(sid, ["host_id", "u"], "left"), "srum")

    both = lambda a, b: F.coalesce(num(a), F.lit(0)) + F.coalesce(num(b), F.lit(0))
    parts = []
    if network is not None:
        parts.append(part(network, "networkData", bytes_sent=num("bytessent"), bytes_received=num("bytesrecvd"), interface_luid=num("interfaceluid")))
    if apps is not None:
        parts.append(part(apps, "appResourceUsage", bytes_read=both("foregroundbytesread", "backgroundbytesread"), bytes_written=both("foregroundbyteswritten", "backgroundbyteswritten")))
    if connectivity is not None:
        parts.append(part(connectivity, "networkConnectivity", interface_luid=num("interfaceluid"), connect_start=srum_time(F.col("connectstarttime")), connected_seconds=num("connectedtime")))
    return union(parts)
