"""All detections under one name each, and one plan that runs them together."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.functions.payload import with_payload
from triagelake.operators import credentials as c
from triagelake.operators import cross_platform as x
from triagelake.operators import linux as l
from triagelake.operators import macos as m
from triagelake.operators import windows as w
from triagelake.operators.findings import with_finding_id
from triagelake.operators.shared_scan import row_findings, union_all

# name -> (function, tables it reads)
DETECTIONS: dict[str, tuple[Callable, tuple[str, ...]]] = {
    "failed_logon_burst": (w.failed_logon_burst, ("events",)),
    "external_rdp_logon": (w.external_rdp_logon, ("events",)),
    "suspicious_powershell": (w.suspicious_powershell, ("events",)),
    "anomalous_process": (w.anomalous_process, ("events",)),
    "service_install": (w.service_install, ("events",)),
    "scheduled_task": (w.scheduled_task, ("events",)),
    "log_cleared": (w.log_cleared, ("events",)),
    "run_keys": (w.run_keys, ("registry",)),
    "service_image_paths": (w.service_image_paths, ("registry",)),
    "usb_history": (w.usb_history, ("registry",)),
    "remote_exec_tool": (w.remote_exec_tool, ("events",)),
    "password_spray": (w.password_spray, ("events",)),
    "kerberoasting": (w.kerberoasting, ("events",)),
    "asrep_roastable": (w.asrep_roastable, ("events",)),
    "discovery_burst": (w.discovery_burst, ("events",)),
    "prefetch_execution": (w.prefetch_execution, ("prefetch",)),
    "amcache_presence": (w.amcache_presence, ("amcache",)),
    "shimcache_presence": (w.shimcache_presence, ("shimcache",)),
    "lnk_shortcuts": (w.lnk_shortcuts, ("lnk",)),
    "jump_lists": (w.jump_lists, ("jumplist",)),
    "usn_create_delete": (w.usn_create_delete, ("usn",)),
    "usn_renamed_to_exec": (w.usn_renamed_to_exec, ("usn",)),
    "usn_mass_delete": (w.usn_mass_delete, ("usn",)),
    "srum_execution": (w.srum_execution, ("srum",)),
    "srum_egress": (w.srum_egress, ("srum",)),
    "mft_timestomp": (w.mft_timestomp, ("mft",)),
    "wmi_persistence": (w.wmi_persistence, ("wmi",)),
    "recycled_executable": (w.recycled_executable, ("recycle_bin",)),
    "recycle_bin_burst": (w.recycle_bin_burst, ("recycle_bin",)),
    "recent_use": (w.recent_use, ("registry",)),
    "persistence_files": (x.persistence_files, ("files",)),
    "remote_tools_run": (x.remote_tools_run, ("events",)),
    "remote_tools_on_disk": (x.remote_tools_on_disk, ("files",)),
    "browser_downloads": (x.browser_downloads, ("browser_history",)),
    "suspicious_hosts": (x.suspicious_hosts, ("browser_history",)),
    "offensive_tools_browsed": (x.offensive_tools_browsed, ("browser_history",)),
    "recovery_inhibition": (x.recovery_inhibition, ("events", "shell_history")),
    "disk_wipe": (x.disk_wipe, ("events", "shell_history")),
    "mass_encryption": (x.mass_encryption, ("files", "usn", "mft")),
    "ransom_notes": (x.ransom_notes, ("files",)),
    "remote_provider_shell": (x.remote_provider_shell, ("events",)),
    "lateral_tokens": (x.lateral_tokens, ("events",)),
    "winrm_activity": (x.winrm_activity, ("events",)),
    "yara_rollup": (x.yara_rollup, ("yara_matches",)),
    "known_bad_hashes": (x.known_bad_hashes, ("bad_hashes",)),
    "root_ssh": (l.root_ssh, ("auth_log",)),
    "ssh_brute_force": (l.ssh_brute_force, ("auth_log", "logins")),
    "account_created": (l.account_created, ("auth_log",)),
    "shell_rules": (l.shell_rules, ("shell_history",)),
    "linux_persistence": (l.linux_persistence, ("linux_persistence",)),
    "access_privilege": (l.access_privilege, ("ssh_keys", "sshd_settings", "linux_users", "shadow", "sudo_rules", "linux_groups")),
    "web_attacks": (l.web_attacks, ("web_access",)),
    "webshells": (l.webshells, ("web_access",)),
    "web_scanners": (l.web_scanners, ("web_access",)),
    "directory_brute_force": (l.directory_brute_force, ("web_access",)),
    "offensive_packages": (l.offensive_packages, ("packages",)),
    "mass_package_removal": (l.mass_package_removal, ("packages",)),
    "journal_ssh": (l.journal_ssh, ("journald",)),
    "sudo_failures": (l.sudo_failures, ("journald",)),
    "audit_exec": (l.audit_exec, ("audit",)),
    "audit_account_change": (l.audit_account_change, ("audit",)),
    "audit_auth_burst": (l.audit_auth_burst, ("audit",)),
    "audit_sensitive": (l.audit_sensitive, ("audit",)),
    "usb_storage": (l.usb_storage, ("syslog",)),
    "segfaults": (l.segfaults, ("syslog",)),
    "crash_loops": (l.crash_loops, ("syslog",)),
    "suspicious_cron": (l.suspicious_cron, ("syslog",)),
    "last_login": (l.last_login, ("lastlog",)),
    "anti_forensics": (l.anti_forensics, ("shell_history", "audit", "syslog", "journald")),
    "launch_items": (m.launch_items, ("launch_items",)),
    "persistence_sweep": (m.persistence_sweep, ("mac_persistence",)),
    "quarantine_origin": (m.quarantine_origin, ("quarantine",)),
    "quarantine_agent": (m.quarantine_agent, ("quarantine",)),
    "fs_create_remove": (m.fs_create_remove, ("fsevents",)),
    "fs_launchd_write": (m.fs_launchd_write, ("fsevents",)),
    "unified_log": (m.unified_log, ("unified_log",)),
    "privacy_grants": (m.privacy_grants, ("tcc",)),
    "remote_app_use": (m.remote_app_use, ("knowledge",)),
    "security_malware": (m.security_malware, ("security_events",)),
    "security_override": (m.security_override, ("security_events",)),
    "security_disabled": (m.security_disabled, ("security_events",)),
    "security_blocks": (m.security_blocks, ("security_events",)),
    "recent_servers": (m.recent_servers, ("recent_items",)),
    "recent_paths": (m.recent_paths, ("recent_items",)),
    "third_party_extensions": (m.third_party_extensions, ("kexts",)),
    "background_items": (m.background_items, ("background_items",)),
    "message_links": (m.message_links, ("messages",)),
    "inbound_mail": (m.inbound_mail, ("mail",)),
    "backup_targets": (m.backup_targets, ("network",)),
    "trashed_payloads": (m.trashed_payloads, ("user_activity",)),
    "powerlog_tools": (m.powerlog_tools, ("powerlog",)),
    "configuration_posture": (m.configuration_posture, ("config",)),
    "installs": (m.installs, ("installs",)),
    "download_origins": (m.download_origins, ("where_froms",)),
    "credential_dumping": (c.credential_dumping, ("events", "shell_history", "prefetch", "amcache", "shimcache", "lnk", "browser_history")),
}


def run_all(t, names: Iterable[str] | None = None, params: dict[str, dict] | None = None) -> DataFrame:
    """The findings of all detections that have a supplied table, as one plan.

    Rules that look at one row at a time share one scan of their table; the others are plans of their own. Payload
    fields are parsed once for all event detections. `params` are keyword arguments by detection. Sort the result by
    severity where it is shown; the union itself is not ordered.
    """
    chosen = list(names) if names is not None else [n for n, (_, needs) in DETECTIONS.items() if any(t.supplied(x) for x in needs)]
    if t.supplied("events") and "payload" not in t["events"].columns:
        t = t.with_tables(events=with_payload(t["events"]))
    parts, others = row_findings(t, {n: DETECTIONS[n][0] for n in chosen}, params)
    parts += [DETECTIONS[n][0](t, **(params or {}).get(n, {})) for n in others]
    if not parts:
        parts = [w.log_cleared(t)]
    return with_finding_id(union_all(parts))


def worst_first(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.col("severity").desc(), "host_id", "rule", "title")
