"""Checks of the sources that read exported tables; the tables are taken from the given ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.checks.adapters import given
from triagelake.operators import ioc
from triagelake.sources import exports as src

# Each statement runs in Spark and, inside a larger one, in DuckDB.
FILES = """SELECT 'h' || CAST(o_custkey % 6 AS STRING) AS host_id, o_orderkey AS obj_id, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS meta_addr, o_orderkey % 3 AS fs_obj_id,
 CASE o_orderkey % 11 WHEN 0 THEN '.' WHEN 1 THEN '..' ELSE o_orderstatus || CAST(o_orderkey AS STRING) || '.doc' END AS name, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE '/' || o_orderpriority || '/' END AS parent_path,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS size, CAST(o_orderkey % 4 AS INT) AS meta_type, CAST(o_orderkey % 8 AS INT) AS meta_flags, CAST(o_custkey % 4 AS INT) AS dir_flags,
 1700000000 + o_orderkey AS mtime, o_orderkey % 2 AS atime, CAST(NULL AS BIGINT) AS ctime, -1 * o_orderkey AS crtime FROM orders"""
VOLUMES = """SELECT 'h' || CAST(c_custkey % 6 AS STRING) AS host_id, c_custkey AS obj_id, CASE c_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 8192 WHEN 2 THEN 32768 WHEN 3 THEN 48879 END AS fs_type,
 CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey * 512 END AS img_offset, 4096 AS block_size, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey END AS block_count FROM customer"""
URLS = """SELECT 'h' AS host_id, CASE page_id % 4 WHEN 0 THEN '/u/Google/Chrome/Default/History' WHEN 1 THEN '/u/Microsoft/Edge/P1/History' WHEN 2 THEN '/u/Vivaldi/x/History' ELSE '/u/other/History' END AS source_file, url,
 CASE WHEN page_id % 3 = 0 THEN '' ELSE 't' || CAST(page_id AS STRING) END AS title, CASE WHEN page_id % 5 = 0 THEN 0 ELSE 13300000000000000 + page_id END AS last_visit_time, page_id AS visit_count, page_id % 2 AS typed_count FROM pages"""
SAVED = """SELECT 'h' AS host_id, '/u/Google/Chrome/Default/History' AS source_file, CASE WHEN page_id % 3 = 0 THEN NULL ELSE '/d/f' || CAST(page_id AS STRING) END AS target_path, CASE WHEN page_id % 2 = 0 THEN url END AS tab_url,
 13300000000000000 + page_id AS start_time, page_id * 10 AS received_bytes, page_id * 11 AS total_bytes FROM pages"""
PLACES = "SELECT 'h' AS host_id, '/u/Mozilla/Firefox/p.default/places.sqlite' AS source_file, url, CASE WHEN page_id % 3 = 0 THEN '' ELSE 't' || CAST(page_id AS STRING) END AS title, CASE WHEN page_id % 5 = 0 THEN NULL ELSE 1700000000000000 + page_id END AS last_visit_date, page_id AS visit_count, page_id % 2 AS typed FROM pages"
MESSAGES = """SELECT 'h' AS host_id, 'chat.db' AS source_file, conv_id * 100 + turn AS rowid, 'g' || CAST(conv_id * 100 + turn AS STRING) AS guid, CASE WHEN turn % 3 = 0 THEN '' ELSE 'SMS' END AS service, conv_id % 10 AS handle_id,
 CASE WHEN role = 'user' THEN 1 ELSE 0 END AS is_from_me, text, CASE WHEN turn % 2 = 0 THEN 700000000 + conv_id ELSE (700000000 + conv_id) * 1000000000 END AS date, turn % 2 AS cache_has_attachments FROM conversations"""
HANDLES = "SELECT DISTINCT 'h' AS host_id, conv_id % 10 AS rowid, CASE WHEN conv_id % 10 = 0 THEN '' ELSE '+1555' || CAST(conv_id % 10 AS STRING) END AS id FROM conversations"
CHATS = "SELECT DISTINCT 'h' AS host_id, conv_id AS rowid, CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'room' || CAST(conv_id AS STRING) END AS display_name FROM conversations"
JOINS = "SELECT 'h' AS host_id, conv_id * 100 + turn AS message_id, conv_id + k AS chat_id FROM conversations CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) x"
SUBJECTS = "SELECT DISTINCT 'h' AS host_id, conv_id AS rowid, CASE WHEN conv_id % 4 = 0 THEN '' ELSE 'about ' || CAST(conv_id AS STRING) END AS subject FROM conversations"
ADDRESSES = "SELECT 'h' AS host_id, c_custkey AS rowid, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'c' || CAST(c_custkey AS STRING) || '@example.com' END AS address, c_name AS comment FROM customer"
BOXES = "SELECT 'h' AS host_id, n_nationkey AS rowid, 'imap://' || n_name AS url FROM nation"
MAIL = "SELECT 'h' AS host_id, 'Envelope' AS source_file, conv_id * 100 + turn AS rowid, conv_id AS subject, 1 + conv_id AS sender, conv_id % 30 AS mailbox, 1700000000 + turn AS date_sent, CASE WHEN turn = 0 THEN 0 ELSE 1700000100 + turn END AS date_received FROM conversations"
SENT_TO = "SELECT 'h' AS host_id, conv_id * 100 + turn AS message_key, 1 + (conv_id + k * 7) % 120 AS address_id FROM conversations CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) x WHERE turn % 2 = 1"
VIEWED = "SELECT 'h' AS host_id, 'ql.db' AS source_file, doc_id AS rowid, CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'f' || CAST(doc_id AS STRING) END AS file_name, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN '' ELSE '/s/' || source || '/' END AS folder FROM documents"
THUMBS = "SELECT 'h' AS host_id, 'ql.db' AS source_file, event_id % 300 AS file_id, CASE WHEN event_id % 2 = 0 THEN 700000000 + event_id ELSE 1700000000 + event_id END AS last_hit_date, event_id % 4 AS hit_count FROM events"
NOTES = "SELECT 'h' AS host_id, 'n.db' AS source_file, conv_id % 12 AS app_id, role AS title, text AS body, CASE WHEN turn % 2 = 0 THEN 0 ELSE 700000000 + conv_id END AS delivered_date, 1700000000 + turn AS request_date FROM conversations"
APPS = "SELECT DISTINCT 'h' AS host_id, conv_id % 12 AS app_id, CASE WHEN conv_id % 12 = 3 THEN '' ELSE 'com.app' || CAST(conv_id % 12 AS STRING) END AS identifier FROM conversations"
HASHES = "SELECT CASE event_id % 4 WHEN 0 THEN '  ABC' || CAST(event_id % 50 AS STRING) || ' ' WHEN 1 THEN 'abc' || CAST(event_id % 60 AS STRING) WHEN 2 THEN '# abc' ELSE '   ' END AS line FROM events"


def _case(fn: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        def table(statement: str) -> DataFrame:
            for name in ("orders", "customer", "pages", "conversations", "nation", "documents", "events"):
                if f"FROM {name}" in statement:
                    given(spark, sf_dir, name).createOrReplaceTempView(f"given_{name}")
                    statement = statement.replace(f"FROM {name}", f"FROM given_{name}")
            return spark.sql(statement)

        return fn(table)

    return run


def us(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(f"{n}_us", F.unix_micros(n)).drop(n)
    return df


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_file_listing": _case(lambda t: us(src.file_listing(t(FILES)).select("host_id", "id", "meta_addr", "fs_id", "name", "parent_path", "size", "is_directory", "is_deleted", "modified", "accessed", "created"), "modified", "accessed", "created")),
    "scan_volumes": _case(lambda t: src.volumes(t(VOLUMES)).select("host_id", "id", "fs_type", "offset_bytes", "size_bytes")),
    "scan_file_places": _case(lambda t: src.extract_info(t(FILES), t(VOLUMES))),
    "scan_chromium_history": _case(lambda t: us(src.chromium_history(t(URLS), t(SAVED)).select("browser", "kind", "url", "title", "timestamp", "visit_count", "typed_count", "target_path", "received_bytes", "total_bytes", "user_profile"), "timestamp")),
    "scan_firefox_history": _case(lambda t: us(src.firefox_history(t(PLACES)).select("browser", "url", "title", "timestamp", "visit_count", "typed_count", "user_profile"), "timestamp")),
    "scan_messages": _case(lambda t: us(src.messages(t(MESSAGES), t(HANDLES), t(CHATS), t(JOINS)).select("guid", "service", "handle", "is_from_me", "text", "timestamp", "has_attachment", "chat_name"), "timestamp")),
    "scan_mail": _case(lambda t: us(src.mail(t(MAIL), t(SUBJECTS), t(ADDRESSES), t(BOXES), t(SENT_TO)).select("subject", "sender", "sender_display", "recipients", "date_sent", "date_received", "mailbox"), "date_sent", "date_received")),
    "scan_quick_look": _case(lambda t: us(src.quick_look(t(VIEWED), t(THUMBS)).select("path", "timestamp", "detail"), "timestamp")),
    "scan_notifications": _case(lambda t: us(src.notifications(t(NOTES), t(APPS)).select("app_id", "title", "body", "delivered_date"), "delivered_date")),
    "hash_set_load": _case(lambda t: ioc.load_set(t(HASHES))),
}

APPLE = 978307200
ORACLES: dict[str, str] = {
    "scan_file_listing": f"""SELECT host_id, obj_id AS id, meta_addr, fs_obj_id AS fs_id, name, coalesce(parent_path, '/') AS parent_path, coalesce(size, 0) AS size, meta_type = 2 AS is_directory,
 (meta_flags & 2) <> 0 OR (dir_flags & 2) <> 0 AS is_deleted, mtime * 1000000 AS modified_us, CASE WHEN atime > 0 THEN atime * 1000000 END AS accessed_us, CAST(NULL AS BIGINT) AS created_us FROM ({FILES}) f WHERE name NOT IN ('.', '..')""",
    "scan_volumes": f"""SELECT host_id, obj_id AS id, CASE fs_type WHEN 1 THEN 'NTFS' WHEN 8192 THEN 'Ext4' WHEN 32768 THEN 'APFS' WHEN 48879 THEN 'FS(0xbeef)' ELSE 'FS(0x0)' END AS fs_type, CAST(coalesce(img_offset, 0) AS BIGINT) AS offset_bytes,
 CAST(block_size * coalesce(block_count, 0) AS BIGINT) AS size_bytes FROM ({VOLUMES}) v""",
    "scan_file_places": f"SELECT f.host_id, f.obj_id AS id, CAST(coalesce(v.img_offset, 0) // 512 AS BIGINT) AS offset_sectors, coalesce(f.meta_addr, 0) AS meta_addr FROM ({FILES}) f JOIN ({VOLUMES}) v ON f.host_id = v.host_id AND f.fs_obj_id = v.obj_id",
    "scan_chromium_history": f"""SELECT CASE WHEN contains(source_file, 'Chrome') THEN 'chrome' WHEN contains(source_file, 'Edge') THEN 'edge' WHEN contains(source_file, 'Vivaldi') THEN 'vivaldi' ELSE 'unknown' END AS browser, 'visit' AS kind, url, nullif(title, '') AS title,
 last_visit_time - 11644473600000000 AS timestamp_us, visit_count, typed_count, CAST(NULL AS VARCHAR) AS target_path, CAST(NULL AS BIGINT) AS received_bytes, CAST(NULL AS BIGINT) AS total_bytes, split_part(source_file, '/', -2) AS user_profile FROM ({URLS}) u WHERE last_visit_time > 0 AND url <> ''
 UNION ALL SELECT 'chrome', 'download', coalesce(tab_url, target_path), NULL, start_time - 11644473600000000, NULL, NULL, target_path, received_bytes, total_bytes, 'Default' FROM ({SAVED}) s WHERE coalesce(tab_url, target_path, '') <> ''""",
    "scan_firefox_history": f"SELECT 'firefox' AS browser, url, nullif(title, '') AS title, last_visit_date AS timestamp_us, visit_count, typed AS typed_count, 'p.default' AS user_profile FROM ({PLACES}) p WHERE last_visit_date > 0 AND url <> ''",
    "scan_messages": f"""SELECT guid, nullif(service, '') AS service, nullif(h.id, '') AS handle, is_from_me <> 0 AS is_from_me, nullif(text, '') AS text, (700000000 + m.rowid // 100 + {APPLE}) * 1000000 AS timestamp_us, cache_has_attachments <> 0 AS has_attachment,
 (SELECT arg_min(c.display_name, c.rowid) FROM ({JOINS}) j JOIN ({CHATS}) c ON c.rowid = j.chat_id WHERE j.message_id = m.rowid AND c.display_name <> '') AS chat_name FROM ({MESSAGES}) m LEFT JOIN ({HANDLES}) h ON h.rowid = m.handle_id""",
    "scan_mail": f"""SELECT nullif(s.subject, '') AS subject, nullif(a.address, '') AS sender, a.comment AS sender_display, r.list AS recipients, date_sent * 1000000 AS date_sent_us, CASE WHEN date_received > 0 THEN date_received * 1000000 END AS date_received_us, b.url AS mailbox
 FROM ({MAIL}) m LEFT JOIN ({SUBJECTS}) s ON s.rowid = m.subject LEFT JOIN ({ADDRESSES}) a ON a.rowid = m.sender LEFT JOIN ({BOXES}) b ON b.rowid = m.mailbox
 LEFT JOIN (SELECT message_key, nullif(string_agg(address, ', ' ORDER BY address_id, address), '') AS list FROM ({SENT_TO}) t JOIN ({ADDRESSES}) x ON x.rowid = t.address_id GROUP BY 1) r ON r.message_key = m.rowid""",
    "scan_quick_look": f"""SELECT CASE WHEN folder = '' THEN file_name ELSE rtrim(folder, '/') || '/' || file_name END AS path, (seen + CASE WHEN seen > 1000000000 THEN 0 ELSE {APPLE} END) * 1000000 AS timestamp_us,
 CASE WHEN views > 0 THEN 'viewed ' || views || '×' ELSE 'viewed' END AS detail FROM ({VIEWED}) v LEFT JOIN (SELECT file_id, max(last_hit_date) AS seen, sum(hit_count) AS views FROM ({THUMBS}) t GROUP BY 1) t ON t.file_id = v.rowid WHERE file_name <> '' AND folder IS NOT NULL""",
    "scan_notifications": f"SELECT nullif(a.identifier, '') AS app_id, title, body, (CASE WHEN delivered_date > 0 THEN delivered_date + {APPLE} ELSE request_date END) * 1000000 AS delivered_date_us FROM ({NOTES}) n LEFT JOIN ({APPS}) a ON a.app_id = n.app_id",
    "hash_set_load": f"SELECT DISTINCT lower(trim(line)) AS value FROM ({HASHES}) h WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')",
}
