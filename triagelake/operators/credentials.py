"""Credential dumping, in whatever table it leaves a trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.once import computed
from triagelake.functions.payload import with_fields
from triagelake.functions.text import basename, contains_all, first_hit, first_match, icontains, lookup
from triagelake.operators.findings import CRITICAL, EXPLOIT, HIGH, findings, labelled, register_techniques, text, union
from triagelake.operators.windows import haystack, process_events, times_iso

# ---- Fixed values -----------------------------------------------------------------------------
register_techniques({
    "T1003.001": "OS Credential Dumping: LSASS Memory",
    "T1003.002": "OS Credential Dumping: Security Account Manager",
    "T1003.003": "OS Credential Dumping: NTDS",
    "T1003.004": "OS Credential Dumping: LSA Secrets",
    "T1558": "Steal or Forge Kerberos Tickets",
})
# (what, tokens that all stand in the command, technique)
COMMANDS = [
    ("LSASS memory dumped through comsvcs", ["comsvcs", "minidump"], "T1003.001"),
    ("LSASS memory dumped with procdump", ["procdump", "lsass"], "T1003.001"),
    ("SAM hive saved", ["reg", "save", "hklm\\sam"], "T1003.002"),
    ("SYSTEM hive saved", ["reg", "save", "hklm\\system"], "T1003.002"),
    ("SECURITY hive saved", ["reg", "save", "hklm\\security"], "T1003.004"),
    ("NTDS database taken with ntdsutil", ["ntdsutil", "ifm"], "T1003.003"),
    ("NTDS database copied from a shadow volume", ["harddiskvolumeshadowcopy", "ntds.dit"], "T1003.003"),
    ("Hive copied from a shadow volume", ["harddiskvolumeshadowcopy", "\\config\\"], "T1003.002"),
]
# Tool names and their techniques.
TOOLS = {"mimikatz": "T1003.001", "nanodump": "T1003.001", "gsecdump": "T1003", "rubeus": "T1558"}
# Access rights with which LSASS memory is read.
LSASS_MASKS = ["0x1010", "0x1410", "0x1438", "0x143a", "0x1f0fff", "0x1f1fff", "0x1f2fff", "0x1f3fff", "0x1fffff"]


def _command(low: Column) -> Column:
    known = [(contains_all(low, tokens), F.struct(F.lit(what).alias("what"), F.lit(attack).alias("attack"))) for what, tokens, attack in COMMANDS]
    tool = first_hit(low, list(TOOLS))
    named = F.when(tool.isNotNull(), F.struct(F.concat(F.lit("tool "), tool).alias("what"), lookup(tool, TOOLS).alias("attack")))
    return F.coalesce(first_match(known), named)


def _commands(rows: DataFrame, rule: str, line: str, when: str, origin: Column) -> DataFrame:
    rows = computed(rows, low=F.lower(line))
    rows = computed(rows, hit=_command(F.col("low"))).filter(F.col("hit").isNotNull())
    return findings(
        rows,
        rule,
        title=text("Credential dumping: ", F.col("hit.what")),
        detail=text(origin, " shows: ", F.col(line)),
        severity=CRITICAL,
        phase=EXPLOIT,
        attack=F.col("hit.attack"),
        when=F.col(when),
        evidence=[F.col("source_file")],
    )


def _tools(rows: DataFrame, rule: str, where: str, hay: Column, shown: Column, when: Column, evidence: list[Column]) -> DataFrame:
    rows = computed(rows, tool=first_hit(F.lower(hay), list(TOOLS))).filter(F.col("tool").isNotNull())
    return findings(
        rows,
        rule,
        title=text("Credential-dumping tool in ", where, ": ", F.col("tool")),
        detail=text(shown, labelled("Time: ", F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'"))),
        severity=HIGH,
        phase=EXPLOIT,
        attack=lookup(F.col("tool"), TOOLS),
        when=when,
        evidence=evidence,
    )


def lsass_access(t) -> DataFrame:
    """Processes that open LSASS with rights to read its memory (Sysmon 10)."""
    rows = t["events"].filter((F.col("event_id") == 10) & icontains(F.col("channel"), "sysmon"))
    rows = with_fields(rows, source="SourceImage", target="TargetImage", mask="GrantedAccess")
    rows = rows.filter((F.lower(basename(F.col("target"))) == "lsass.exe") & F.lower("mask").isin(LSASS_MASKS))
    return findings(
        rows,
        "lsass_access",
        title=text("Credential dumping: LSASS opened by ", F.coalesce(basename(F.col("source")), F.lit("?"))),
        detail=text(F.col("source"), " asked for ", F.col("mask"), " on ", F.col("target"), ", ", times_iso("written_at")),
        severity=HIGH,
        phase=EXPLOIT,
        attack="T1003.001",
        when=F.col("written_at"),
        evidence=[F.col("source_file")],
    )


def credential_dumping(t) -> DataFrame:
    """Commands that dump credentials, reads of LSASS memory, and names of dumping tools in execution and browsing traces."""
    procs = process_events(t["events"]).withColumn("line", haystack("image", "command"))
    return union([
        _commands(procs, "credential_command", "line", "written_at", text("Process on ", F.col("computer"))),
        lsass_access(t),
        _commands(t["shell_history"], "credential_shell", "command", "timestamp", text("Shell history of ", F.col("user"))),
        _tools(t["prefetch"], "credential_prefetch", "Prefetch", F.col("executable_name"), F.coalesce("executable_path", "executable_name"), F.get("run_times", F.lit(0)), [F.col("source_file")]),
        _tools(t["amcache"], "credential_amcache", "Amcache", F.concat_ws(" ", "name", "full_path"), F.col("full_path"), F.col("registered_at"), [F.col("full_path")]),
        _tools(t["shimcache"], "credential_shimcache", "Shimcache", F.col("path"), F.col("path"), F.col("last_modified"), [F.col("path")]),
        _tools(t["lnk"], "credential_lnk", "a shortcut", F.concat_ws(" ", "local_path", "network_path", "arguments"), F.coalesce("local_path", "network_path"), F.col("target_modified"), [F.col("source_file")]),
        _tools(t["browser_history"], "credential_browser", "browser history", F.concat_ws(" ", "url", "target_path"), F.col("url"), F.col("timestamp"), [F.col("url"), F.col("source_file")]),
    ])
