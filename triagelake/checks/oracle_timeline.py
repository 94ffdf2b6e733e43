"""DuckDB SQL for the timeline branches and for the queries over the joined timeline."""

from __future__ import annotations

from triagelake.checks.adapters import ADAPTERS, q
from triagelake.checks.oracle_detections import BASE, LEAF, base, case_, cte
from triagelake.operators import macos as m
from triagelake.operators.windows import USN_REASONS
from triagelake.plans import timeline as tl


def lab(col: str, table: dict) -> str:
    return case_([(f"{col} = {q(k) if isinstance(k, str) else k}", q(v)) for k, v in table.items()])


def masks(col: str, table) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN ({col} & {b}) <> 0 THEN {q(n)} END" for b, n in table) + "], lambda x: x IS NOT NULL), ', ')"


def hbytes(c: str) -> str:
    return f"CASE WHEN {c} >= 1073741824 THEN printf('%.1f GB', {c} / 1073741824.0) WHEN {c} >= 1048576 THEN printf('%.1f MB', {c} / 1048576.0) WHEN {c} >= 1024 THEN printf('%.1f KB', {c} / 1024.0) ELSE {c} || ' B' END"


FP = "(CASE WHEN ends_with(parent_path, '/') THEN parent_path ELSE parent_path || '/' END || name)"
KEYS = r"(hive || '\' || regexp_replace(path, '^[\\/]+|[\\/]+$', '', 'g'))"
LN = r"regexp_replace(regexp_extract(source_file, '([^\\/]+)[\\/]*$', 1), '\.(?i:lnk)$', '')"
SUMM = "coalesce(command_line, exe, record_type || ': ' || account || coalesce(' (' || result || ')', ''), record_type)"
KCAT = f"coalesce({lab('stream', m.KNOWLEDGE_STREAMS)}, 'other')"
KSUM = f"""CASE WHEN {KCAT} IN ('appFocus', 'appUsage', 'appActivity') THEN coalesce(value, 'app') || CASE WHEN end_date > start_date THEN ' (' || ((epoch_us(end_date) - epoch_us(start_date)) // 1000000) || 's)' ELSE '' END
 WHEN {KCAT} = 'display' THEN CASE WHEN value_int = 1 THEN 'Screen on' ELSE 'Screen off' END WHEN {KCAT} = 'deviceLock' THEN CASE WHEN value_int = 1 THEN 'Locked' ELSE 'Unlocked' END WHEN {KCAT} = 'media' THEN 'Now playing: ' || coalesce(value, '?') ELSE coalesce(value, stream) END"""
SENT = "coalesce(contains(lower(mailbox), '/sent') OR ends_with(lower(mailbox), 'sent'), false)"
FT = "CASE WHEN {0} > 0 THEN make_timestamp({0} // 10 - 11644473600000000) END"
FLAT = "replace(text, chr(10), ' ')"
WHO = "coalesce(nullif(process_name, ''), nullif(bundle_id, ''), '(unknown)')"
TITLE = "coalesce(nullif(display_name, ''), nullif(split(package_identifiers, ',')[1], ''), 'install')"
DUR = "CASE WHEN connected_seconds < 60 THEN connected_seconds || 's' WHEN connected_seconds < 3600 THEN (connected_seconds // 60) || 'm ' || (connected_seconds % 60) || 's' ELSE (connected_seconds // 3600) || 'h ' || ((connected_seconds % 3600) // 60) || 'm' END"

# table -> (times with kinds, path, size, deleted, event id, source rows)
ROWS: dict[str, tuple] = {
    "files": ([("modified", "'M'"), ("accessed", "'A'"), ("changed", "'C'"), ("created", "'B'")], FP, "size", "is_deleted", "NULL", None),
    "events": ([("written_at", "'C'")], "channel", "0", "false", "event_id", None),
    "usn": ([("timestamp", "CASE WHEN (reason_raw & 256) <> 0 THEN 'B' ELSE 'C' END")], f"file_name || '  [' || {masks('reason_raw', USN_REASONS)} || ']'", "0", "(reason_raw & 512) <> 0", "NULL", None),
    "srum": ([("timestamp", "'C'")], f"coalesce({base('application')}, '—') || '  [' || {lab('kind', tl.SRUM_LABELS)} || ': ' || CASE kind WHEN 'networkData' THEN '↑ ' || {hbytes('bytes_sent')} || '   ↓ ' || {hbytes('coalesce(bytes_received, 0)')} WHEN 'appResourceUsage' THEN 'read ' || {hbytes('bytes_read')} || '   written ' || {hbytes('bytes_written')} ELSE 'connected ' || {DUR} END || ']'", "0", "false", "NULL", None),
    "browser_history": ([("timestamp", "'C'")], f"'[' || {lab('browser', tl.BROWSER_LABELS)} || ' ' || upper(kind[1]) || kind[2:] || '] ' || coalesce(nullif(title, ''), CASE WHEN kind = 'download' AND target_path <> '' THEN {base('target_path')} END, url) || ' — ' || url", "0", "false", "NULL", None),
    "messages": ([("timestamp", "'C'")], f"'[Messages ' || service || '] ' || CASE WHEN is_from_me THEN 'Sent' ELSE 'Received' END || ' ' || coalesce(nullif(handle, ''), nullif(chat_name, ''), 'unknown') || ': ' || CASE WHEN text <> '' THEN CASE WHEN length({FLAT}) > 140 THEN {FLAT}[1:140] || '…' ELSE {FLAT} END WHEN has_attachment THEN '(attachment)' ELSE '(no text)' END", "0", "false", "NULL", None),
    "mail": ([("coalesce(date_received, date_sent)", "'C'")], f"'[Mail] ' || CASE WHEN {SENT} THEN 'Sent to ' || coalesce(nullif(recipients, ''), 'unknown') ELSE 'Received from ' || coalesce(nullif(sender, ''), 'unknown') END || ': ' || coalesce(nullif(subject, ''), '(no subject)')", "0", "false", "NULL", None),
    "network": ([("timestamp", "'C'")], f"'[' || {lab('kind', tl.NETWORK_LABELS)} || '] ' || coalesce(nullif(name, ''), identifier, {lab('kind', tl.NETWORK_LABELS)}) || coalesce(' (' || identifier || ')', '')", "0", "false", "NULL", None),
    "user_activity": ([("timestamp", "'C'")], f"'[' || {lab('kind', tl.ACTIVITY_LABELS)} || '] ' || path || coalesce(' — ' || detail, '')", "0", "kind = 'trash'", "NULL", None),
    "doc_versions": ([("version_time", "'M'")], "'[Doc Version] ' || file_path", "coalesce(size, 0)", "false", "NULL", None),
    "notifications": ([("delivered_date", "'C'")], "'[Notification] ' || coalesce(app_id, 'app') || ': ' || coalesce(nullif(title, ''), nullif(body, ''), '')", "0", "false", "NULL", None),
    "powerlog": ([("date", "'C'")], f"'[Powerlog] ' || CASE kind WHEN 'process' THEN 'process: ' || {WHO} || coalesce(' (pid ' || pid || ')', '') WHEN 'appLifecycle' THEN 'app ' || coalesce(event, 'lifecycle') || ': ' || {WHO} WHEN 'frontmost' THEN 'frontmost app: ' || {WHO} ELSE 'network: ' || {WHO} || ' (in ' || bytes_in || ' / out ' || bytes_out || ' bytes)' END", "0", "false", "NULL", None),
    "installs": ([("date", "'B'")], f"'[Install] ' || {TITLE} || coalesce(' ' || version, '') || coalesce(' by ' || process_name, '')", "0", "false", "NULL", None),
    "registry": ([("last_written", "'M'")], f"{KEYS} || '  [key written]'", "0", "false", "NULL", "(SELECT DISTINCT host_id, source_file, hive, path, last_written FROM a_registry)"),
    "prefetch": ([("run1", "'C'"), ("run2", "'C'")], "executable_name || '  [executed; ' || run_count || ' runs total]'", "0", "false", "NULL", None),
    "shimcache": ([("last_modified", "'M'")], "path || '  [shimcache presence]'", "0", "false", "NULL", None),
    "amcache": ([("registered_at", "'C'")], "coalesce(full_path, name) || '  [amcache registered]'", "0", "false", "NULL", None),
    "lnk": ([("target_modified", "'M'"), ("target_accessed", "'A'"), ("target_created", "'B'")], f"coalesce(local_path, network_path, {LN}) || '  [lnk: ' || {LN} || ']'", "target_size", "false", "NULL", None),
    "jumplist": ([("last_accessed", "'A'")], "coalesce(target_path, application, app_id) || '  [jumplist: ' || coalesce(application, app_id) || ']'", "0", "false", "NULL", None),
    "auth_log": ([("timestamp", "'C'")], "process || ': ' || message", "0", "false", "NULL", None),
    "logins": ([("timestamp", "'C'")], f"CASE WHEN is_failed_login THEN 'Failed login' ELSE {lab('type', tl.LOGIN_LABELS)} END || ': ' || \"user\" || ' on ' || line || CASE WHEN host = '' THEN '' ELSE ' from ' || host END", "0", "false", "NULL", None),
    "shell_history": ([("timestamp", "'C'")], "\"user\" || '$ ' || command", "0", "false", "NULL", None),
    "web_access": ([("timestamp", "'C'")], "method || ' ' || status || ' ' || path || coalesce('?' || query, '') || '  [' || client_ip || ']'", "bytes", "false", "NULL", None),
    "packages": ([("timestamp", "CASE WHEN action = 'install' THEN 'B' ELSE 'C' END")], "manager || ' ' || upper(action[1]) || action[2:] || ': ' || package || coalesce(' ' || version, '')", "0", "action IN ('remove', 'purge')", "NULL", None),
    "journald": ([("timestamp", "'C'")], "coalesce(identifier, comm) || ': ' || message", "0", "false", "NULL", None),
    "unified_log": ([("timestamp", "'C'")], "coalesce(process || ': ', '') || coalesce('[' || subsystem || '] ', '') || message", "0", "false", "NULL", None),
    "tcc": ([("last_modified", "'C'")], f"coalesce({lab('service', m.SERVICE_LABELS)}, replace(service, 'kTCCService', '')) || ' → ' || CASE WHEN client_type = 1 THEN {LEAF.format('client')} ELSE client END || ' (' || {lab('auth_value', tl.AUTH_VALUES)} || ')'", "0", "false", "NULL", None),
    "knowledge": ([("start_date", "'C'")], f"{lab(KCAT, tl.KNOWLEDGE_LABELS)} || ': ' || {KSUM}", "0", "false", "NULL", None),
    "recent_items": ([("timestamp", "'A'")], f"{lab('kind', m.RECENT_LABELS)} || ': ' || title", "0", "false", "NULL", None),
    "security_events": ([("timestamp", "'C'")], f"'[' || {lab('kind', m.SECURITY_KINDS)} || ' ' || {lab('severity', tl.SECURITY_SEVERITIES)} || '] ' || coalesce(path, signature, message)", "0", "false", "NULL", None),
    "audit": ([("timestamp", "'C'")], f"record_type || ': ' || {SUMM}", "0", "false", "NULL", None),
    "syslog": ([("timestamp", "'C'")], f"'[' || {lab('category', tl.SYSLOG_LABELS)} || '] ' || process || ': ' || message", "0", "false", "NULL", "(SELECT * FROM a_syslog WHERE category NOT IN ('serviceStarted', 'serviceStopped', 'other'))"),
    "lastlog": ([("timestamp", "'A'")], "'Last login: ' || coalesce(\"user\", 'uid ' || uid) || ' on ' || line || CASE WHEN host = '' THEN '' ELSE ' from ' || host END", "0", "false", "NULL", None),
    "mft": ([(FT.format("si_modified_raw"), "'M'"), (FT.format("si_accessed_raw"), "'A'"), (FT.format("si_changed_raw"), "'C'"), (FT.format("si_created_raw"), "'B'")], "coalesce(full_path, file_name)", "size", "NOT in_use", "NULL", "(SELECT * FROM a_mft WHERE file_name IS NOT NULL)"),
}


def branch(table: str) -> str:
    times, path, size, deleted, event, rows = ROWS[table]
    src = rows or f"a_{table}"
    return " UNION ALL ".join(
        f"SELECT host_id, {t} AS date, {k} AS kind, '{tl.BRANCHES[table][0]}' AS source, {path} AS path, CAST({size} AS BIGINT) AS size, {deleted} AS is_deleted, CAST({event} AS BIGINT) AS event_id FROM {src} s WHERE {t} IS NOT NULL"
        for t, k in times
    )


FLAT_ROW = "host_id, epoch_us(date) AS date_us, kind, source, path, size, is_deleted, event_id"
MIXED = list(ROWS)
TL = f"{cte(*MIXED)}, tl AS ({' UNION ALL '.join(branch(n) for n in MIXED)})"
GAP_S = 3600
SESS = f"""{TL}, f AS (SELECT host_id, date, lag(date) OVER (PARTITION BY host_id ORDER BY date) p FROM tl), g AS (SELECT *, CASE WHEN p IS NULL OR epoch_us(date) - epoch_us(p) > {GAP_S * 1000000} THEN 1 ELSE 0 END n FROM f),
 s AS (SELECT *, sum(n) OVER (PARTITION BY host_id ORDER BY date) k FROM g)"""

PAGED = ["files", "web_access", "registry"]
PAGES = f"{cte(*PAGED)}, tl AS ({' UNION ALL '.join(branch(n) for n in PAGED)})"
PLACED = "date, host_id, source, kind, path, coalesce(event_id, -1)"
KEY_ROW = "epoch_us(date) AS date_us, host_id, source, kind, path, event_id"

ORACLES = {f"timeline_{n}": f"{cte(n)} SELECT {FLAT_ROW} FROM ({branch(n)}) z" for n in ROWS}
ORACLES |= {
    "timeline_filtered": f"{TL} SELECT {FLAT_ROW} FROM tl WHERE kind IN ('C', 'M') AND source IN ('FS', 'EVTX', 'WEB') AND NOT ends_with(path, '-slack') AND (contains(lower(path), '46') OR contains(CAST(event_id AS VARCHAR), '46')) AND date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2024-01-20'",
    "timeline_all": f"{TL} SELECT {FLAT_ROW} FROM tl WHERE date BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'",
    "timeline_pivot": f"{TL} SELECT {FLAT_ROW} FROM tl WHERE date BETWEEN TIMESTAMP '2024-01-10 11:30:00' AND TIMESTAMP '2024-01-10 12:30:00'",
    "timeline_extent": f"{TL} SELECT host_id, epoch_us(min(date)) AS first_us, epoch_us(max(date)) AS last_us FROM tl GROUP BY host_id",
    "timeline_default_sources": f"{TL} SELECT DISTINCT host_id, source FROM tl WHERE source IN ({', '.join(q(s) for s in tl.BOUNDED_SOURCES)})",
    "timeline_histogram": f"{cte('events')} SELECT 'day' AS unit, epoch_us(date_trunc('day', written_at)) AS bucket_us, count(*) AS n FROM a_events GROUP BY 2",
    "timeline_histogram_months": f"{cte('files')}, t AS ({branch('files')}) SELECT host_id, 'month' AS unit, epoch_us(CAST(date_trunc('month', date) AS TIMESTAMP)) AS bucket_us, count(*) AS n FROM t GROUP BY host_id, 3",
    "timeline_sessions": f"{SESS} SELECT host_id, epoch_us(min(date)) AS start_us, epoch_us(max(date)) AS end_us, count(*) AS count FROM s GROUP BY host_id, k",
    "timeline_gaps": f"{SESS} SELECT host_id, epoch_us(p) AS start_us, epoch_us(date) AS end_us FROM s WHERE n = 1 AND p IS NOT NULL",
    "timeline_sessions_all_hosts": f"""{cte('events')}, f AS (SELECT written_at d, lag(written_at) OVER (ORDER BY written_at) p FROM a_events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(d) - epoch_us(p) > 600000000 THEN 1 ELSE 0 END) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) k FROM f)
 SELECT epoch_us(min(d)) AS start_us, epoch_us(max(d)) AS end_us, count(*) AS count FROM s GROUP BY k""",
    "timeline_longest_gaps": f"{SESS} SELECT host_id, epoch_us(p) AS start_us, epoch_us(date) AS end_us FROM s WHERE n = 1 AND p IS NOT NULL ORDER BY epoch_us(date) - epoch_us(p) DESC, p, host_id LIMIT 20",
    "timeline_table_total": f"{TL} SELECT count(*) AS total FROM tl",
    "timeline_first_rows": f"{TL} SELECT epoch_us(date) AS date_us FROM tl ORDER BY date",
    "timeline_page": f"{PAGES} SELECT {KEY_ROW} FROM tl ORDER BY {PLACED} LIMIT 300 OFFSET 7000",
    "timeline_page_after": f"{PAGES} SELECT {KEY_ROW} FROM tl WHERE ({PLACED}) > (SELECT ({PLACED}) FROM tl ORDER BY {PLACED} LIMIT 1 OFFSET 7000) ORDER BY {PLACED} LIMIT 300",
    "timeline_stored_pivot": f"{PAGES} SELECT {FLAT_ROW} FROM tl WHERE date BETWEEN TIMESTAMP '2024-01-10 11:30:00' AND TIMESTAMP '2024-01-10 12:30:00'",
    "timeline_unique_keys": f"{TL} SELECT count(DISTINCT (source, kind, epoch_us(date), coalesce(event_id, 0), path)) AS n FROM tl",
    "timeline_zoom": f"""{cte('events')}, e AS (SELECT host_id, epoch_us(min(written_at)) f, epoch_us(max(written_at)) l FROM a_events GROUP BY host_id)
 SELECT host_id, CAST(greatest(f, round(f + (l - f) / 2.0 - (l - f) / 2.0 * 0.5)) AS BIGINT) AS new_low_us, CAST(least(l, round(f + (l - f) / 2.0 + (l - f) / 2.0 * 0.5)) AS BIGINT) AS new_high_us FROM e""",
}
assert set(ROWS) <= set(ADAPTERS) and BASE
