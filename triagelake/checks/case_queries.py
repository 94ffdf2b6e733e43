"""Case-level, function and scan queries over the derived case and the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.checks.adapters import GivenCase, spark_text, work_folder
from triagelake.checks.oracle_case import CLAIMS, CONVERSATION_NOTES, FEEDS, FINDINGS, LINES, TOKENS
from triagelake.functions import net, text, times
from triagelake.functions.payload import decode_entities
from triagelake.operators import (
    casebook, correlation, cross_platform, enrichment, entropy, filters, hierarchy, ioc, lateral, reporting, search, windows,
)
from triagelake.operators.findings import union
from triagelake.plans import stored_correlation
from triagelake.plans import timeline as tl
from triagelake.plans.detections import DETECTIONS
from triagelake.sinks import exports as out
from triagelake.sources import exports as src
from triagelake.sources import linux_config, linux_logs, macos_text
from triagelake.tables import CaseTables


def _case(fn):
    return lambda spark, sf: fn(GivenCase(spark, sf))


def us(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(f"{n}_us", F.unix_micros(n)).drop(n)
    return df


def found(t) -> DataFrame:
    """The findings of a few detections."""
    return union([DETECTIONS[n][0](t) for n in FINDINGS])


def sql(t, statement: str) -> DataFrame:
    for name in ("documents", "conversations", "pages", "part", "customer", "orders"):
        if f"FROM {name}" in statement:
            t.given(name).createOrReplaceTempView(f"given_{name}")
            statement = statement.replace(f"FROM {name}", f"FROM given_{name}")
    for name in ("events", "lineitem"):
        statement = statement.replace(f"FROM {name}", f"FROM given_{name}")
    return t.spark.sql(spark_text(statement))


def lines(t, name: str) -> DataFrame:
    """Log lines composed from the event rows, in the shape of a file scan."""
    df = sql(t, LINES[name])
    return df.select("host_id", "source_file", F.call_function("div", F.col("line_no"), F.lit(500)).alias("block"), "line_no", "line", F.lit("2024-02-01 00:00:00").cast("timestamp").alias("anchor"))


def flat_findings(df: DataFrame) -> DataFrame:
    return df.select("title", "severity", "phase", F.col("technique.attack_id").alias("attack_id"), F.unix_micros("timestamp").alias("ts_us"), F.array_join("evidence", "|").alias("hosts"))


def matches(t) -> DataFrame:
    return ioc.match(t)


def claims(t) -> DataFrame:
    return sql(t, CLAIMS).withColumn("refs", F.split("refs", ","))


def annotation_sets(t) -> tuple[DataFrame, DataFrame]:
    rows = sql(t, CONVERSATION_NOTES)
    return rows.filter("turn = 0").drop("turn"), rows.filter("turn > 0").drop("turn")


def _enriched(t) -> DataFrame:
    feeds = sql(t, FEEDS)
    wanted = sql(t, TOKENS).select(ioc.classify(F.col("value")).alias("kind"), "value", "pos")
    return enrichment.enrich(wanted, feeds)


def _csv_lines(t) -> DataFrame:
    rows = t.given("part").select("p_partkey", F.concat(F.lit("=,"), F.col("p_name")).alias("a"), "p_brand")
    return rows.select("p_partkey", out.csv_record(rows.drop("p_partkey")).alias("line"))


def contents(t) -> DataFrame:
    """File contents out of the documents: texts, and for odd ids bytes that look encrypted."""
    docs = t.given("documents").select("doc_id", "text")
    noise = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.sha2(F.concat("text", i.cast("string")), 256)), ""))
    rows = t["files"].select("host_id", "id").join(docs, F.expr("id div 8 = doc_id"))
    return rows.select("host_id", "id", F.when(F.col("id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(noise).alias("content"))


def correlated(t) -> str:
    """Partial results of all hosts, stored in two steps."""
    names = ["events", "auth_log", "logins", "linux_users", "hosts"]
    root = work_folder(t.spark)
    for some in (["host-0", "host-2", "host-4"], ["host-1", "host-3", "host-5"]):
        stored_correlation.add_hosts(CaseTables(t.spark, {n: t[n].filter(F.col("host_id").isin(some)) for n in names}), root)
    return root


def flat_edges(df: DataFrame) -> DataFrame:
    return us(df, "first_seen", "last_seen").withColumn("logon_types", F.array_join(F.col("logon_types").cast("array<string>"), ","))


QUERIES = {
    # graph and correlation
    "lateral_edges": _case(lambda t: us(lateral.edges(t["events"]), "first_seen", "last_seen").withColumn("logon_types", F.array_join(F.col("logon_types").cast("array<string>"), ","))),
    "lateral_edge_users": _case(lambda t: us(lateral.edge_users(t["events"]), "first_seen", "last_seen")),
    "lateral_nodes": _case(lambda t: lateral.nodes(t["events"])),
    "lateral_node_inbound": _case(lambda t: us(lateral.node_edges(lateral.edges(t["events"]), "WS-3")[0].drop("logon_types"), "first_seen", "last_seen")),
    "lateral_node_outbound": _case(lambda t: us(lateral.node_edges(lateral.edges(t["events"]), "WS-3")[1].drop("logon_types"), "first_seen", "last_seen")),
    "lateral_edges_stored": _case(lambda t: flat_edges(stored_correlation.edges(t.spark, correlated(t)))),
    "lateral_nodes_stored": _case(lambda t: stored_correlation.nodes(t.spark, correlated(t))),
    "correlation_stored": _case(lambda t: flat_findings(stored_correlation.correlate(t.spark, correlated(t)))),
    "host_summary": _case(correlation.host_summary),
    "source_pivots": _case(lambda t: flat_findings(correlation.source_pivots(t))),
    "credential_reuse": _case(lambda t: flat_findings(correlation.credential_reuse(t))),
    "shared_indicators": _case(lambda t: flat_findings(correlation.shared_indicators(t, matches(t)))),
    "ioc_matches": _case(lambda t: us(matches(t).select("host_id", "ioc_value", "ioc_kind", F.col("location.type").alias("place"), ioc.location_summary().alias("summary"), "timestamp"), "timestamp")),
    "ioc_export_rows": _case(lambda t: out.ioc_rows(matches(t).filter("location.type = 'file'"), t["hosts"])),
    "ioc_ingest": _case(lambda t: ioc.ingest(sql(t, LINES["ioc"]), t["iocs"]).select("kind", "value")),
    "ioc_classify": _case(lambda t: sql(t, TOKENS).select("value", ioc.classify(F.col("value")).alias("kind")).distinct()),
    "enrichment": _case(lambda t: _enriched(t).select("key", "kind", "verdict", "source", "tier")),
    "enrichment_cache_merge": _case(lambda t: enrichment.merge_cache(*[sql(t, FEEDS).filter(c).select(enrichment.key(F.col("kind"), F.col("value")).alias("key"), "verdict", "source", F.col("provider_order").alias("retrieved_at")) for c in ("tier = 0", "tier > 0")]).select("key", "verdict", "source")),
    # host facts
    "os_family": _case(casebook.os_family),
    "windows_profile": _case(lambda t: casebook.windows_profile(t).select("host_id", "hostname", F.array_join(F.array_sort("ip_addresses"), ",").alias("ips"), "domain")),
    "host_profiles": _case(lambda t: casebook.host_profiles(t).select("host_id", "hostname")),
    "file_facts": _case(lambda t: us(casebook.file_facts(t, cross_platform.ransom_notes(t)).select("host_id", "key", "size", "is_deleted", "modified", "ambiguous"), "modified")),
    "download_origin_facts": _case(lambda t: casebook.download_origin_facts(t).select("host_id", "key", "download_url", "ambiguous")),
    "multi_host_packages": _case(lambda t: casebook.multi_host(t, "packages", ["host-1", "host-2"]).select("host_id", "package", "action", F.unix_micros("timestamp").alias("ts_us"))),
    "source_integrity": _case(lambda t: casebook.verify_sources(
        t.given("documents").select(F.col("doc_id").cast("string").alias("path"), F.lit("sha256").alias("algorithm"), F.when(F.col("doc_id") % 7 == 0, F.upper(F.sha2("text", 256))).otherwise(F.sha2("lang", 256)).alias("value")),
        casebook.content_hashes(t.given("documents").filter("doc_id % 5 > 0").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content")))).select("path", "algorithm", "status")),
    # findings
    "kill_chain_groups": _case(lambda t: us(reporting.kill_chain_groups(found(t)).select("phase", "phase_order", "group_key", "n", "max_severity", "newest"), "newest")),
    "finding_digest": _case(lambda t: reporting.digest(found(t), 6).select("id", "key", "n", "max_severity")),
    "finding_digest_omitted": _case(lambda t: reporting.digest_omitted(found(t), 3)),
    "claim_validation": _case(lambda t: reporting.validate_claims(claims(t), reporting.digest(found(t), 6)).select("claim_id", "kept", "severity", F.array_join("technique_keys", ",").alias("keys"), "phantom_refs")),
    "claim_report": _case(lambda t: reporting.claim_report(reporting.validate_claims(claims(t), reporting.digest(found(t), 6)))),
    "claim_metrics": _case(lambda t: reporting.claim_metrics(reporting.validate_claims(claims(t), reporting.digest(found(t), 6)), found(t), cap=6).select(F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"), F.round("drop_rate", 6).alias("drop_rate"), F.round("digest_ceiling", 6).alias("digest_ceiling"), "causal")),
    "severity_counts": _case(lambda t: reporting.severity_counts(found(t)).select("host_id", "severity", "n")),
    "phase_counts": _case(lambda t: reporting.phase_counts(found(t), [2, 3, 4]).select("host_id", "phase", "n", "max_severity")),
    "phase_matrix": _case(lambda t: reporting.phase_matrix(found(t)).select("host_id", "installation", "actionsOnObjectives", "delivery")),
    "host_sections": _case(lambda t: reporting.host_sections(t, found(t), matches(t)).select("host_id", "display_name", "files", "events", "registry_values", "findings", "ioc_matches")),
    "overview_counts": _case(lambda t: reporting.overview(t, tl.events(t), found(t))),
    "finding_export_rows": _case(lambda t: out.finding_rows(DETECTIONS["log_cleared"][0](t), t["hosts"]).select("timestamp_iso", "severity", "phase", "attack_id", "attack_name", "title", "host")),
    "timeline_export_rows": _case(lambda t: out.timeline_rows(tl.shell_history(t), t["hosts"])),
    "search": _case(lambda t: search.search(t, "  Svc1 ", tl.events(t), None, limit=None).groupBy("kind", "score").agg(F.count(F.lit(1)).alias("n"))),
    "search_top": _case(lambda t: search.search(t, "mimikatz", tl.files(t), None, limit=300).select("score", "kind", "title", "snippet")),
    "annotation_upsert": _case(lambda t: casebook.upsert_annotations(*annotation_sets(t)).select("target_key", "tag", "author", F.length("note").alias("note_len"), "title")),
    "annotation_bookmarks": _case(lambda t: casebook.bookmarks(annotation_sets(t)[0], "benign").select("target_key", "tag")),
    # hierarchy and content
    "file_tree": _case(lambda t: us(hierarchy.file_tree(t), "last")),
    "registry_tree": _case(lambda t: us(hierarchy.registry_tree(t).select("host_id", "hive", "path", "depth", "files", "last"), "last")),
    "mft_tree": _case(lambda t: hierarchy.mft_tree(t).select("host_id", "volume", "path", "files", "folders", "bytes")),
    "volume_layer": _case(lambda t: hierarchy.volume_layer(t).select("host_id", "fs_id", "label", "n")),
    "file_leaves": _case(hierarchy.leaves),
    "encryption_bursts": _case(lambda t: cross_platform.encryption_bursts(t).select("host_id", "ext", "n")),
    "entropy_candidates": _case(lambda t: entropy.candidates(t).groupBy("host_id", "ext").agg(F.count(F.lit(1)).alias("n"))),
    "entropy_of_documents": _case(lambda t: entropy.max_entropy(t.given("documents").select("doc_id", F.encode("text", "UTF-8").alias("content")), ["doc_id"]).select("doc_id", F.round("h", 6).alias("h"))),
    "entropy_statistics": _case(lambda t: entropy.statistics(t.given("documents").select(F.col("source").alias("host_id"), F.col("lang").alias("ext"), (F.col("n_chars") % 80 / 10).alias("h"))).select("host_id", "ext", "sampled", "high", F.round("mean_entropy", 6).alias("mean_entropy"), "max_entropy")),
    "entropy_of_bursts": _case(lambda t: entropy.sample_bursts(t, contents(t)).select("host_id", "ext", "sampled", "high", F.round("mean_entropy", 6).alias("mean_entropy"), F.round("max_entropy", 6).alias("max_entropy"))),
    "mass_encryption_verdict": _case(lambda t: cross_platform.mass_encryption(t, entropy=entropy.sample_bursts(t, contents(t))).select("host_id", "title", "detail")),
    "scan_candidates": _case(lambda t: entropy.scan_candidates(t, 3000).select("host_id", "id", "name", "size")),
    # functions
    "fn_rot13": _case(lambda t: t.given("part").select("p_partkey", text.rot13(F.col("p_name")).alias("turned"))),
    "fn_mask_labels": _case(lambda t: t["usn"].select("usn", F.array_join(text.mask_labels(F.col("reason_raw"), windows.USN_REASONS), ", ").alias("labels"))),
    "fn_human": _case(lambda t: t["srum"].select("bytes_written", text.human_bytes(F.col("bytes_written")).alias("size"), "connected_seconds", text.human_duration(F.col("connected_seconds")).alias("duration")).distinct()),
    "fn_filetime": _case(lambda t: t["mft"].select("record_number", F.unix_micros(times.from_filetime(F.col("si_created_raw"))).alias("us"), F.coalesce(times.is_whole_second(F.col("si_created_raw")), F.lit(False)).alias("whole"))),
    "fn_extension": _case(lambda t: t["files"].select("id", text.extension(F.col("name")).alias("ext"), text.basename(F.col("parent_path")).alias("base"))),
    "fn_url_host": _case(lambda t: t.given("pages").select("page_id", F.lower(net.url_host(F.col("url"))).alias("host"))),
    "fn_payload_field": _case(lambda t: windows.with_fields(t["events"], command="CommandLine").select("record_number", "command")),
    "fn_entities": _case(lambda t: t.given("pages").select("page_id", F.length(decode_entities(F.col("html"))).alias("n"))),
    "fn_csv_record": _case(_csv_lines),
    "event_filter": _case(lambda t: filters.event_filter(t["events"], "info", "40").select("record_number")),
    "quick_filter_web": _case(lambda t: filters.web_filter(t["web_access"], "SQLMAP", errors=True).select("host_id", "client_ip", "path", "status")),
    "quick_filter_tables": _case(lambda t: union([filters.table_filter(t, n, "A1").groupBy("host_id").agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n in filters.TEXT_COLUMNS])),
    "quick_filter_usn": _case(lambda t: filters.usn_filter(t["usn"], "rename", key_changes=True).select("usn")),
    "quick_filter_mft": _case(lambda t: filters.mft_filter(t["mft"], "drop", anomalies=True).select("record_number")),
    "quick_filter_journal": _case(lambda t: filters.journal_filter(t["journald"], "ssh", errors=True).select("host_id", "message")),
    "registry_search": _case(lambda t: filters.registry_filter(t["registry"], " Evil ").select("host_id", "name", "data")),
    "registry_decode": _case(lambda t: t["files"].select("size", filters.registry_text(F.lit("REG_DWORD"), F.col("size").cast("string")).alias("number"), filters.registry_text(F.lit("REG_BINARY"), F.col("size").cast("string")).alias("bytes")).distinct()),
    "user_key": _case(lambda t: t["auth_log"].select("user", correlation.user_key(F.col("user")).alias("key"), correlation.is_builtin(F.col("user")).alias("builtin")).distinct()),
    # scans of text composed from the event rows
    "scan_auth_log": _case(lambda t: us(linux_logs.auth_log(lines(t, "auth")).select("host_id", "timestamp", "host", "process", "pid", "kind", "user", "source_ip", "port", "method", "message"), "timestamp")),
    "scan_system_log": _case(lambda t: us(linux_logs.system_log(lines(t, "syslog")).select("host_id", "timestamp", "process", "category", "message", "user", "command", "unit"), "timestamp")),
    "scan_sudo_log": _case(lambda t: us(linux_logs.sudo_log(lines(t, "sudo")).select("host_id", "timestamp", "user", "command", "message"), "timestamp")),
    "scan_web_log": _case(lambda t: us(linux_logs.web_log(lines(t, "web"), "nginx").select("host_id", "timestamp", "client_ip", "method", "path", "query", "http_version", "status", "bytes", "referer", "user_agent"), "timestamp")),
    "scan_app_server_log": _case(lambda t: us(linux_logs.app_server_log(lines(t, "rails")).select("host_id", "timestamp", "client_ip", "method", "path", "query", "status"), "timestamp")),
    "scan_shell_history": _case(lambda t: us(linux_logs.shell_history(lines(t, "bash")).select("host_id", "user", "shell", "command", "timestamp", "line_number"), "timestamp")),
    "scan_audit_log": _case(lambda t: us(linux_logs.audit_log(lines(t, "audit")).select("host_id", "serial", "timestamp", "record_type", "syscall", "success", "exe", "command_line", "path", "auid", "uid", "key"), "timestamp")),
    "scan_audit_by_serial": _case(lambda t: us(linux_logs.audit_log(lines(t, "audit"), by_serial=True).select("host_id", "serial", "timestamp", "record_type", "syscall", "success", "exe", "command_line", "path", "auid", "uid", "key"), "timestamp")),
    "scan_dpkg_log": _case(lambda t: us(linux_logs.dpkg_log(lines(t, "dpkg")).select("host_id", "timestamp", "action", "package", "version", "manager"), "timestamp")),
    "scan_apt_history": _case(lambda t: us(linux_logs.apt_history(lines(t, "apt")).select("host_id", "timestamp", "action", "package", "version"), "timestamp")),
    "scan_yum_log": _case(lambda t: us(linux_logs.yum_log(lines(t, "yum")).select("host_id", "timestamp", "action", "package", "version"), "timestamp")),
    "scan_crontab": _case(lambda t: linux_config.crontab(lines(t, "cron"), True).select("host_id", "schedule", "user", "command")),
    "scan_script": _case(lambda t: linux_config.script(lines(t, "script"), "rcLocal").select("host_id", "command")),
    "scan_rc_scripts": _case(lambda t: macos_text.rc_scripts(lines(t, "script")).select("host_id", "command", "name")),
    "scan_known_hosts": _case(lambda t: linux_config.known_hosts(lines(t, "hosts"), linux_logs.history_user(F.col("source_file"))).select("host_id", "user", "host", "algorithm")),
    "scan_sshd_config": _case(lambda t: linux_config.sshd_config(lines(t, "sshd")).select("host_id", "key", "value")),
    "scan_os_release": _case(lambda t: linux_config.os_release(lines(t, "release"))),
    "scan_ld_preload": _case(lambda t: linux_config.ld_preload(lines(t, "preload")).select("host_id", "command")),
    "scan_systemd_service": _case(lambda t: linux_config.systemd_service(lines(t, "unit")).select("host_id", "user", "command", "unit_name", "detail")),
    "scan_systemd_timer": _case(lambda t: linux_config.systemd_timer(lines(t, "timer")).select("host_id", "schedule", "command", "unit_name", "detail")),
    "scan_autostart": _case(lambda t: linux_config.autostart(lines(t, "desktop")).select("host_id", "command", "unit_name", "detail")),
    "scan_mac_crontab": _case(lambda t: macos_text.crontab(lines(t, "cron"), True).select("host_id", "schedule", "user", "command")),
    "scan_passwd": _case(lambda t: linux_config.passwd(lines(t, "passwd"))),
    "scan_group": _case(lambda t: linux_config.group(lines(t, "group")).select("host_id", "name", "gid", F.array_join("members", ",").alias("members"))),
    "scan_shadow": _case(lambda t: linux_config.shadow(lines(t, "shadow"))),
    "scan_sudoers": _case(lambda t: linux_config.sudoers(lines(t, "sudoers")).select("host_id", "principal", "run_as", "no_passwd", "command")),
    "scan_authorized_keys": _case(lambda t: linux_config.authorized_keys(lines(t, "keys"), linux_logs.history_user(F.col("source_file"))).select("host_id", "user", "algorithm", "comment", F.array_join("options", ";").alias("options"))),
    "scan_lease_addresses": _case(lambda t: linux_config.lease_addresses(lines(t, "lease")).select("host_id", "line_no", "ip")),
    "scan_security_log": _case(lambda t: us(macos_text.security_log(lines(t, "security"), "s", 2024).select("host_id", "kind", "severity", "timestamp", "message", "path"), "timestamp")),
    "scan_bodyfile": _case(lambda t: us(src.bodyfile(lines(t, "body")).select("host_id", "path", "symlink_target", "inode", "size", "is_directory", "modified", "created"), "modified", "created")),
    "scan_bodyfile_files": _case(lambda t: us(src.bodyfile_files(src.bodyfile(lines(t, "body")), 3).select("host_id", "name", "parent_path", "meta_addr", "fs_id", "size", "is_directory", "modified"), "modified")),
    "scan_routing": _case(lambda t: linux_config.route_files(t["files"]).select("host_id", "id", "artifact")),
    "scan_amcache": _case(lambda t: us(src.amcache(t["registry"]).select("host_id", "name", "full_path", "sha1", "size", "registered_at", "source"), "registered_at")),
    "scan_powerlog_clock": _case(lambda t: us(src.correct_clock(
        t.given("events").select(F.concat(F.lit("host-"), (F.col("user_id") % 6).cast("string")).alias("host_id"), "event_id", (F.unix_seconds("ts") + F.col("event_id") % 2).cast("double").alias("raw")),
        t.given("events").filter("event_type = 'error'").select(F.concat(F.lit("host-"), (F.col("user_id") % 6).cast("string")).alias("host_id"), F.unix_seconds("ts").cast("double").alias("timestamp"), (F.col("event_id") % 100).cast("double").alias("system"))), "date")),
    "scan_safari_history": _case(lambda t: us(src.safari_history(
        t.given("pages").select(F.lit("h").alias("host_id"), F.lit("/Users/a/Library/Safari/History.db").alias("source_file"), F.col("page_id").alias("id"), "url", F.lit(3).alias("visit_count")),
        t.given("events").select(F.lit("h").alias("host_id"), F.lit("/Users/a/Library/Safari/History.db").alias("source_file"), (F.col("event_id") % 300).alias("history_item"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("title"), (F.col("event_id") * 10).alias("visit_time"))).select("url", "title", "timestamp", "user_profile"), "timestamp")),
}
