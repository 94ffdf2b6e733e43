"""Headline queries on the bench data; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from triagelake.checks import registry
from triagelake.session import build_session

HEADLINE = [
    "lateral_edges", "lateral_nodes", "detect_failed_logon_burst", "detect_password_spray", "detect_kerberoasting",
    "detect_suspicious_powershell", "detect_usn_renamed_to_exec", "detect_mass_encryption", "detect_ssh_brute_force",
    "detect_web_attacks", "detect_anti_forensics", "detect_security_blocks", "detect_recycle_bin_burst", "timeline_files",
    "timeline_filtered", "timeline_histogram_months", "timeline_sessions", "enrichment", "search_top",
    "ioc_matches", "timeline_all", "file_tree", "kill_chain_groups", "scan_auth_log", "scan_audit_log", "scan_powerlog_clock",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "triagelake-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    queries["timeline_extent"](spark, sf_dir).collect()  # JVM warm-up
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
