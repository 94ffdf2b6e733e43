"""Filters of single tables: text, level and flag conditions, and registry value rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.text import any_of, has_bit, mask_labels
from triagelake.operators.linux import audit_summary
from triagelake.operators.macos import FS_CREATED, FS_FLAGS, FS_MODIFIED, FS_REMOVED, FS_RENAMED
from triagelake.operators.windows import USN_CREATE, USN_DELETE, USN_NEW_NAME, USN_OLD_NAME, USN_REASONS

# Level numbers per choice; level 0 counts as information.
LEVELS = {"all": None, "critical": [1], "error": [2], "warning": [3], "info": [4, 0]}
# Columns that the filter of a table looks at; tables with conditions of their own have a function below.
TEXT_COLUMNS = {
    "shimcache": ["path"],
    "wmi": ["filter_name", "consumer_name", "command", "query", "script_text"],
    "prefetch": ["executable_name", "executable_path"],
    "amcache": ["name", "full_path", "sha1"],
    "srum": ["application", "user_sid"],
    "jumplist": ["target_path", "application", "app_id"],
    "recycle_bin": ["original_path", "sid"],
    "lnk": ["source_file", "local_path", "network_path", "arguments"],
    "packages": ["package", "version"],
    "linux_persistence": ["command", "unit_name", "user"],
    "auth_log": ["message", "user", "source_ip", "process"],
    "logins": ["user", "host", "line"],
    "lastlog": ["user", "host"],
    "shell_history": ["command", "user"],
    "syslog": ["message", "user", "process", "unit"],
    "ssh_keys": ["user", "host", "algorithm", "comment"],
    "mac_persistence": ["name", "command", "kind", "source_file"],
    "installs": ["display_name", "process_name"],
    "kexts": ["bundle_id", "name", "team_id", "path"],
    "knowledge": ["value", "stream"],
    "quarantine": ["agent_name", "data_url", "origin_url"],
    "mail": ["subject", "sender", "recipients", "mailbox"],
    "messages": ["text", "handle", "chat_name"],
    "notifications": ["app_id", "title", "body"],
    "network": ["name", "identifier", "detail"],
    "powerlog": ["process_name", "bundle_id"],
    "recent_items": ["title", "value", "source_file", "scope"],
    "security_events": ["message", "process", "path"],
    "tcc": ["service", "client"],
    "browser_history": ["url", "title"],
    "doc_versions": ["file_path"],
    "user_activity": ["path"],
}


def quick_filter(df: DataFrame, query: str = "", columns: Sequence[str | Column] = (), flag: Column | None = None) -> DataFrame:
    """Rows that meet the flag and hold the query in any of the columns, in any case."""
    out = df if flag is None else df.filter(F.coalesce(flag, F.lit(False)))
    if not query:
        return out
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return out.filter(any_of(F.coalesce(F.lower(c.cast("string")).contains(query.lower()), F.lit(False)) for c in cols))


def table_filter(t, name: str, query: str = "") -> DataFrame:
    """The rows of a table that hold the query in one of its text columns."""
    return quick_filter(t[name], query, TEXT_COLUMNS[name])


def event_filter(events: DataFrame, level: str = "all", query: str = "") -> DataFrame:
    wanted = LEVELS[level]
    flag = None if wanted is None else F.col("level").isin(wanted)
    return quick_filter(events, query, ["channel", "provider", "event_id", "computer"], flag)


def usn_filter(usn: DataFrame, query: str = "", key_changes: bool = False) -> DataFrame:
    flag = has_bit(F.col("reason_raw"), USN_CREATE | USN_DELETE | USN_OLD_NAME | USN_NEW_NAME) if key_changes else None
    return quick_filter(usn, query, ["file_name", F.array_join(mask_labels(F.col("reason_raw"), USN_REASONS), ", ")], flag)


def mft_filter(mft: DataFrame, query: str = "", anomalies: bool = False) -> DataFrame:
    """Anomalies: both creation times known and the settable one more than a second earlier."""
    si, fn = F.col("si_created_raw"), F.col("fn_created_raw")
    return quick_filter(mft, query, ["full_path", "file_name"], (si != 0) & (fn != 0) & (fn - si > 10_000_000) if anomalies else None)


def audit_filter(audit: DataFrame, query: str = "", exec_only: bool = False) -> DataFrame:
    flag = (F.col("record_type") == "EXECVE") | F.coalesce(F.col("syscall") == "execve", F.lit(False))
    return quick_filter(audit, query, [audit_summary(), "exe", "account", "record_type"], flag if exec_only else None)


def journal_filter(journald: DataFrame, query: str = "", errors: bool = False) -> DataFrame:
    flag = F.coalesce("priority", F.lit(6)) <= 3
    return quick_filter(journald, query, ["message", F.coalesce("identifier", "comm"), "unit"], flag if errors else None)


def web_filter(web: DataFrame, query: str = "", errors: bool = False) -> DataFrame:
    target = F.when(F.col("query").isNotNull(), F.concat("path", F.lit("?"), "query")).otherwise(F.col("path"))
    return quick_filter(web, query, [target, "client_ip", "user_agent", "method"], F.col("status") >= 400 if errors else None)


def fsevents_filter(fsevents: DataFrame, query: str = "", changes: bool = False) -> DataFrame:
    labels = F.array_join(mask_labels(F.col("flags"), FS_FLAGS), "; ")
    flag = has_bit(F.col("flags"), FS_CREATED | FS_REMOVED | FS_RENAMED | FS_MODIFIED)
    return quick_filter(fsevents, query, ["path", F.when(labels == "", "—").otherwise(labels)], flag if changes else None)


def unified_log_filter(log: DataFrame, query: str = "", errors: bool = False) -> DataFrame:
    return quick_filter(log, query, ["message", "process", "subsystem"], F.col("level").isin("error", "fault") if errors else None)


def registry_filter(registry: DataFrame, query: str = "") -> DataFrame:
    return quick_filter(registry, query.strip(), ["name", "path", "data"])


def registry_text(kind: Column, data: Column) -> Column:
    """Whole numbers as 'n (0xN)', binary data as spaced upper-case bytes, other data as it is."""
    s = F.trim(data)
    number = (
        F.when(F.lower(s).rlike("^0x[0-9a-f]{1,16}$"), F.conv(F.substring(s, 3, 16), 16, 10))
        .when(s.rlike("^[0-9]{1,19}$"), s)
        .when(F.lower(s).rlike("^[0-9a-f]{1,16}$"), F.conv(s, 16, 10))
    )
    whole = number.cast("decimal(20,0)").cast("string")
    shown = F.when(number.isNotNull(), F.concat(whole, F.lit(" (0x"), F.conv(whole, 10, 16), F.lit(")"))).otherwise(data)
    digits = F.regexp_replace(data, "[^0-9A-Fa-f]", "")
    spaced = F.array_join(F.regexp_extract_all(F.upper(digits), F.lit("(..?)"), 1), " ")
    up = F.upper(kind)
    texts = up.isin("REG_SZ", "REG_EXPAND_SZ", "REG_MULTI_SZ")
    return F.when(up.isin("REG_DWORD", "REG_DWORD_BIG_ENDIAN", "REG_QWORD"), shown).when(texts | (digits == ""), data).otherwise(spaced)
