"""The finding row every detection returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.text import lookup
from triagelake.operators.shared_scan import NotARowRule, RowFinding, RowTable, named, union_all

INFO, LOW, MEDIUM, HIGH, CRITICAL = range(5)

# Severity names by number, kill-chain phases in order with display names.
SEVERITY_LABELS = {INFO: "Info", LOW: "Low", MEDIUM: "Medium", HIGH: "High", CRITICAL: "Critical"}
PHASES = {
    "reconnaissance": "Reconnaissance",
    "weaponization": "Weaponization",
    "delivery": "Delivery",
    "exploitation": "Exploitation",
    "installation": "Installation",
    "commandAndControl": "Command & Control",
    "actionsOnObjectives": "Actions on Objectives",
}
RECON, WEAPON, DELIVERY, EXPLOIT, INSTALL, C2, ACTIONS = PHASES

# ATT&CK technique names by id.
TECHNIQUES = {
    "T1003": "OS Credential Dumping",
    "T1005": "Data from Local System",
    "T1018": "Remote System Discovery",
    "T1021": "Remote Services",
    "T1021.001": "Remote Services: Remote Desktop Protocol",
    "T1021.002": "Remote Services: SMB/Windows Admin Shares",
    "T1021.003": "Remote Services: Distributed Component Object Model",
    "T1021.004": "Remote Services: SSH",
    "T1021.005": "Remote Services: VNC",
    "T1021.006": "Remote Services: Windows Remote Management",
    "T1036.003": "Masquerading: Rename System Utilities",
    "T1037.004": "Boot or Logon Initialization Scripts: RC Scripts",
    "T1046": "Network Service Discovery",
    "T1047": "Windows Management Instrumentation",
    "T1048": "Exfiltration Over Alternative Protocol",
    "T1053.005": "Scheduled Task/Job: Scheduled Task",
    "T1059": "Command and Scripting Interpreter",
    "T1059.001": "Command and Scripting Interpreter: PowerShell",
    "T1059.003": "Command and Scripting Interpreter: Windows Command Shell",
    "T1059.005": "Command and Scripting Interpreter: Visual Basic",
    "T1070.001": "Indicator Removal: Clear Windows Event Logs",
    "T1070.004": "Indicator Removal: File Deletion",
    "T1070.006": "Indicator Removal: Timestomp",
    "T1078": "Valid Accounts",
    "T1083": "File and Directory Discovery",
    "T1087": "Account Discovery",
    "T1091": "Replication Through Removable Media",
    "T1105": "Ingress Tool Transfer",
    "T1110": "Brute Force",
    "T1110.003": "Brute Force: Password Spraying",
    "T1127.001": "Trusted Developer Utilities Proxy Execution: MSBuild",
    "T1133": "External Remote Services",
    "T1197": "BITS Jobs",
    "T1204.002": "User Execution: Malicious File",
    "T1218.003": "System Binary Proxy Execution: CMSTP",
    "T1218.004": "System Binary Proxy Execution: InstallUtil",
    "T1218.005": "System Binary Proxy Execution: Mshta",
    "T1218.010": "System Binary Proxy Execution: Regsvr32",
    "T1218.011": "System Binary Proxy Execution: Rundll32",
    "T1482": "Domain Trust Discovery",
    "T1543.003": "Create or Modify System Process: Windows Service",
    "T1546.003": "Event Triggered Execution: WMI Event Subscription",
    "T1547.001": "Boot or Logon Autostart Execution: Registry Run Keys / Startup Folder",
    "T1558.003": "Steal or Forge Kerberos Tickets: Kerberoasting",
    "T1558.004": "Steal or Forge Kerberos Tickets: AS-REP Roasting",
    "T1569.002": "System Services: Service Execution",
}


def register_techniques(names: dict[str, str]) -> None:
    """Other modules add the names of the techniques they use."""
    TECHNIQUES.update(names)


def technique(attack: str | Column | None, name: str | Column | None = None) -> Column:
    kind = "struct<attack_id:string,name:string>"
    if attack is None:
        return F.lit(None).cast(kind)
    if isinstance(attack, str):
        label = F.lit(name or TECHNIQUES[attack]) if not isinstance(name, Column) else name
        return F.struct(F.lit(attack).alias("attack_id"), label.alias("name")).cast(kind)
    if name is None:
        name = lookup(attack, TECHNIQUES)
    elif isinstance(name, str):
        name = F.lit(name)
    return F.when(attack.isNotNull(), F.struct(attack.alias("attack_id"), name.alias("name"))).cast(kind)


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def text(*parts) -> Column:
    """Joins strings and columns; a null part becomes empty."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])


def labelled(label: str, value: Column) -> Column:
    """'label value' on its own line, or nothing when the value is null."""
    return F.when(value.isNotNull(), F.concat(F.lit("\n" + label), value.cast("string"))).otherwise(F.lit(""))


def findings(
    rows: DataFrame,
    rule: str,
    *,
    title,
    severity,
    phase,
    attack,
    attack_name=None,
    when: Column | None = None,
    detail="",
    evidence: Sequence[Column] | Column = (),
) -> DataFrame:
    """Projects rows to finding rows; rows with a null severity are not findings."""
    paths = evidence if isinstance(evidence, Column) else F.array(*evidence) if len(evidence) else F.array().cast("array<string>")
    paths = F.filter(paths, lambda p: p.isNotNull() & (p != ""))
    fields = [
        F.col("host_id"),
        F.lit(rule).alias("rule"),
        _col(title).alias("title"),
        _col(detail).alias("detail"),
        _col(severity).cast("int").alias("severity"),
        _col(phase).alias("phase"),
        technique(attack, attack_name).alias("technique"),
        (when if when is not None else F.lit(None)).cast("timestamp").alias("timestamp"),
        paths.alias("evidence"),
    ]
    if isinstance(rows, RowTable):
        return named(rows.finding(fields))
    return rows.select(*fields).filter(F.col("severity").isNotNull())


def union(parts: Sequence[DataFrame]) -> DataFrame:
    if any(isinstance(p, RowTable) for p in parts):
        raise NotARowRule("union")
    return parts[0] if isinstance(parts[0], RowFinding) else union_all(parts)


def with_finding_id(df: DataFrame) -> DataFrame:
    """Content hash, so that reruns give the same id."""
    basis = F.concat_ws(
        "\u0001",
        "host_id",
        "rule",
        "title",
        F.col("severity").cast("string"),
        F.unix_micros("timestamp").cast("string"),
        F.array_join("evidence", "\u0002"),
        "detail",
    )
    return df.withColumn("finding_id", F.sha2(basis, 256))


def cited(name: Column) -> Column:
    """Only the non-null values of an array expression."""
    return F.array_compact(name)
