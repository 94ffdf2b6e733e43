"""DuckDB SQL for every detection, over the shared adapters.

The statements are written from the rule descriptions, not from the Spark code; only the
fixed token lists are shared.
"""

from __future__ import annotations

import re

from triagelake.checks.adapters import cte, q
from triagelake.operators import credentials as c
from triagelake.operators import cross_platform as x
from triagelake.operators import linux as l
from triagelake.operators import macos as m
from triagelake.operators import windows as w

ORACLES: dict[str, str] = {}


def any_(col: str, tokens) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(t)})" for t in tokens) + ")"


def all_(col: str, tokens) -> str:
    return "(" + (" AND ".join(f"contains({col}, {q(t)})" for t in tokens) or "true") + ")"


def first_(col: str, tokens) -> str:
    return "CASE " + " ".join(f"WHEN contains({col}, {q(t)}) THEN {q(t)}" for t in tokens) + " END"


def count_(col: str, tokens) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({col}, {q(t)}) THEN 1 ELSE 0 END" for t in tokens) + ")"


def in_(items) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


def case_(pairs, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def fld(name: str) -> str:
    raw = f"regexp_extract(payload_xml, '<Data Name=\"{name}\">([^<]*)</Data>', 1)"
    return f"nullif(replace(replace({raw}, '&apos;', ''''), '&amp;', '&'), '')"


BASE = r"regexp_extract({0}, '([^\\/]+)[\\/]*$', 1)"
LEAF = r"regexp_extract({0}, '([^/]+)/*$', 1)"
EXT = r"lower(regexp_extract({0}, '[^/]\.([^./\s]+)/*$', 1))"
IP4 = r"regexp_matches({0}, '^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){{3}}$')"
HOST = r"nullif(lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '')"


def base(c):
    return f"CASE WHEN {BASE.format(c)} <> '' THEN {BASE.format(c)} ELSE {c} END"


def iso(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"


def say(template: str) -> str:
    """A text with {expression}, {@time} and {?label|expression or @time} (a line of its own, or nothing); null is empty."""
    out = []
    for i, piece in enumerate(re.split(r"\{([^{}]*)\}", template)):
        if i % 2 == 0:
            out += [q(piece)] if piece else []
        elif piece.startswith("?"):
            label, value = piece[1:].split("|", 1)
            out.append(f"coalesce({q(chr(10) + label)} || CAST({iso(value[1:]) if value.startswith('@') else value} AS VARCHAR), '')")
        else:
            out.append(iso(piece[1:]) if piece.startswith("@") else piece)
    return f"concat({', '.join(out)})" if out else "''"


def found(col: str, tokens) -> str:
    """The tokens that a text holds, as a list."""
    return f"list_filter([{', '.join(q(t) for t in tokens)}], lambda x: contains({col}, x))"


def joined(items: str) -> str:
    return f"array_to_string({items}, ', ')"


def some(items: str) -> str:
    """Sorted distinct values that are there."""
    return f"list_sort(list_distinct(list_filter({items}, lambda x: x IS NOT NULL)))"


def add(name: str, tables, body: str, extra: str = "") -> None:
    """body: SELECT host_id, title, severity, phase, attack_id, ts (a timestamp or null), detail, ev (a list of texts)."""
    ORACLES[name] = f"""{cte(*tables)}{extra} SELECT host_id, title, CAST(severity AS INT) AS severity, phase, attack_id, epoch_us(CAST(ts AS TIMESTAMP)) AS ts_us, detail,
 array_to_string(list_filter(CAST(ev AS VARCHAR[]), lambda x: x <> ''), '|') AS evidence FROM ({body}) z WHERE severity IS NOT NULL"""


def simple(name, table, *, title, severity, phase, attack, detail, ev="[source_file]", ts="NULL", where="true", src=None) -> None:
    add(name, [table], f"SELECT host_id, {title} AS title, {severity} AS severity, {phase} AS phase, {attack} AS attack_id, {ts} AS ts, {detail} AS detail, {ev} AS ev FROM {src or 'a_' + table} WHERE {where}")


# ---- Windows ----------------------------------------------------------------------------------
def ev(**fields: str) -> str:
    cols = ", ".join(f"{fld(n)} AS {c}" for c, n in fields.items())
    return f"(SELECT *, {cols} FROM a_events) e"


K3 = 6 * 3600 * 1_000_000
add("failed_logon_burst", ["events"], """
SELECT host_id, 'Failed-logon burst against ' || usr || ' (3 in 360m)' AS title, 2 AS severity, 'reconnaissance' AS phase, 'T1110' AS attack_id, t0 AS ts, %s AS detail, %s AS ev FROM (
 SELECT *, row_number() OVER (PARTITION BY host_id, usr ORDER BY written_at, record_number) rn FROM (
  SELECT *, lag(written_at, 2) OVER o t0, [lag(source_file, 2) OVER o, lag(source_file, 1) OVER o, source_file] files, [lag(ip, 2) OVER o, lag(ip, 1) OVER o, ip] ips FROM (
   SELECT host_id, written_at, record_number, source_file, nullif(%s, '-') ip, lower(coalesce(%s, '<unknown>')) usr FROM a_events WHERE event_id = 4625) a WINDOW o AS (PARTITION BY host_id, usr ORDER BY written_at, record_number)) b
 WHERE epoch_us(written_at) - epoch_us(t0) <= %d) c WHERE rn = 1""" % (
    say(f"Logons as '{{usr}}' failed 3 times in one window ({{@t0}} to {{@written_at}}); origin: {{coalesce(nullif({joined(some('ips') + '[1:3]')}, ''), 'unknown source(s)')}}."), some("files"), fld("IpAddress"), fld("TargetUserName"), K3))
PRIV = r"(starts_with(ip, '10.') OR starts_with(ip, '192.168.') OR starts_with(ip, '127.') OR starts_with(ip, '169.254.') OR starts_with(ip, 'fe80:') OR regexp_matches(ip, '^172\.(1[6-9]|2[0-9]|3[01])\.'))"
simple("external_rdp_logon", "events", detail=say("Remote desktop session opened by {ip}, {@written_at} (logon type 10)."), src=ev(lt="LogonType", ip="IpAddress", usr="TargetUserName", dom="TargetDomainName"),
       where=f"event_id = 4624 AND lt = '10' AND ip IS NOT NULL AND ip NOT IN ('-', '::1', '0.0.0.0') AND NOT {PRIV}",
       title=r"'RDP logon from external IP ' || ip || ' as ' || coalesce(dom || '\', '') || coalesce(usr, '(unknown)')", severity="3", phase="'delivery'", attack="'T1133'", ts="written_at")
add("suspicious_powershell", ["events"], f"""SELECT host_id, 'Suspicious PowerShell scriptblock (' || array_to_string(why[1:6], ', ') || ')' AS title, CASE WHEN hi > 0 AND hi + ev >= 3 THEN 4 WHEN hi > 0 THEN 3 ELSE 2 END AS severity, 'exploitation' AS phase, 'T1059.001' AS attack_id, written_at AS ts,
  {say("Record {record_number} of {computer} logs a script block with {array_to_string(why[1:6], ', ')}." + chr(10) * 2 + "Start of the script: {replace(substr(sc, 1, 220), chr(10), ' ')}")} AS detail, [source_file] AS ev FROM n WHERE hi > 0 OR ev >= 2""", f""", s AS (SELECT *, lower({fld('ScriptBlockText')}) sc FROM a_events WHERE event_id = 4104 AND contains(lower(channel), 'powershell')),
 n AS (SELECT *, {count_('sc', w.POWERSHELL_HIGH)} hi, {count_('sc', w.POWERSHELL_EVASION)} ev, {found('sc', w.POWERSHELL_HIGH + w.POWERSHELL_EVASION)} why FROM s WHERE sc IS NOT NULL)""")
PROC = f"""(SELECT host_id, event_id, written_at, record_number, computer, source_file, CASE WHEN event_id = 4688 THEN {fld('NewProcessName')} ELSE {fld('Image')} END image,
 CASE WHEN event_id = 4688 THEN {fld('ParentProcessName')} ELSE {fld('ParentImage')} END parent, {fld('CommandLine')} command FROM a_events WHERE event_id = 4688 OR (event_id = 1 AND contains(lower(channel), 'sysmon'))) p"""
HAY = "CASE WHEN image IS NULL AND command IS NULL THEN NULL ELSE coalesce(image, '') || ' ' || coalesce(command, '') END"
simple("anomalous_process", "events", detail=say("{parent} started {image}.{?Command line: |command}\n\nHost and time: {computer}, {@written_at}"), src=f"(SELECT *, lower({base('parent')}) pb, lower({base('image')}) ib FROM {PROC}) r", where=f"ib IN {in_(w.SHELL_CHILDREN)}",
       title="CASE WHEN pb IN %s THEN 'Office app' ELSE 'Browser' END || ' spawned ' || ib || ': ' || pb || ' -> ' || ib" % in_(w.OFFICE_PARENTS),
       severity=case_([(f"pb IN {in_(w.OFFICE_PARENTS)}", 4), (f"pb IN {in_(w.BROWSER_PARENTS)}", 3)]), phase="'exploitation'", attack="'T1059'", ts="written_at")


def path_sev(c, tokens):
    return case_([(f"{any_(c, tokens)} OR {any_(c, w.USER_WRITABLE)}", 3), (any_(c, ["\\system32\\", "\\syswow64\\"]), 0)], "2")


simple("service_install", "events", detail=say("Service: {coalesce(svc, '(unknown)')}{?Image: |img}{?Start: |start}{?Account: |account}{CASE WHEN " + any_("lower(coalesce(img, ''))", w.SERVICE_TOKENS) + " THEN chr(10) || 'Reason: image path uses lolbin / encoded command pattern' END}{CASE WHEN " + any_("lower(coalesce(img, ''))", w.USER_WRITABLE) + " THEN chr(10) || 'Reason: image path is under a user-writable directory' END}"), ev="[coalesce(img, source_file)]", src=ev(svc="ServiceName", img="ImagePath", start="StartType", account="AccountName"), where="event_id = 7045", title="'Service installed: ' || coalesce(svc, '(unknown)')",
       severity=path_sev("lower(coalesce(img, ''))", w.SERVICE_TOKENS), phase="'installation'", attack="'T1543.003'", ts="written_at")
simple("scheduled_task", "events", detail=say("Task: {task}\nCreated by: {coalesce(actor, 'unknown')}{?Suspicious tokens: |nullif(array_to_string(why, ', '), '')}\n\nHost and time: {computer}, {@written_at}"), src=f"(SELECT *, {count_('blob', w.TASK_TOKENS)} n, {found('blob', w.TASK_TOKENS)} why FROM (SELECT *, {fld('SubjectUserName')} actor, coalesce({fld('TaskName')}, '(unknown)') task, lower(coalesce({fld('TaskName')}, '(unknown)') || ' ' || coalesce({fld('TaskContent')}, '')) blob FROM a_events) a) b", where="event_id = 4698",
       title="'Scheduled task created: ' || task", severity="CASE n WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END", phase="'installation'", attack="'T1053.005'", ts="written_at")
simple("log_cleared", "events", detail=say("Event log '{channel}' emptied on {computer}, {@written_at}."), src=ev(who="SubjectUserName"), where="(event_id = 1102 AND contains(lower(channel), 'security')) OR (event_id = 104 AND contains(lower(channel), 'system'))",
       title="CASE WHEN event_id = 1102 THEN 'Security' ELSE 'System' END || ' event log cleared by ' || coalesce(who, 'unknown user')", severity="4", phase="'actionsOnObjectives'", attack="'T1070.001'", ts="written_at")
REMOTE_SIGN = case_([(f"contains(low, {q(tok)})" + (" AND contains(low, '2>&1')" if need else ""), q(lab)) for lab, tok, need in w.REMOTE_EXEC_SIGNS])
simple("remote_exec_tool", "events", detail=say("EID {event_id} at {@written_at} matched: {" + REMOTE_SIGN + "}.\nToken: {" + case_([(f"contains(low, {q(tok)})" + (" AND contains(low, '2>&1')" if need else ""), q(tok)) for lab, tok, need in w.REMOTE_EXEC_SIGNS]) + "}\nPayload excerpt: {substr(hay, 1, 300)}"), src=f"""(SELECT *, lower(hay) low FROM (SELECT host_id, event_id, source_file, written_at, computer, {HAY} hay FROM {PROC} UNION ALL
 SELECT host_id, event_id, source_file, written_at, computer, CASE WHEN sn IS NULL AND sp IS NULL THEN NULL ELSE coalesce(sn, '') || ' ' || coalesce(sp, '') END FROM
 (SELECT *, {fld('ServiceName')} sn, CASE WHEN event_id = 7045 THEN {fld('ImagePath')} ELSE {fld('ServiceFileName')} END sp FROM a_events WHERE event_id IN (7045, 4697)) s) u) h""",
       where="(%s) IS NOT NULL" % case_([(f"contains(low, {q(tok)})" + (" AND contains(low, '2>&1')" if need else ""), q(lab)) for lab, tok, need in w.REMOTE_EXEC_SIGNS]),
       title="'Impacket remote-execution signature on ' || computer || ': ' || " + case_([(f"contains(low, {q(tok)})" + (" AND contains(low, '2>&1')" if need else ""), q(lab)) for lab, tok, need in w.REMOTE_EXEC_SIGNS]),
       severity="4", phase="'exploitation'", attack="'T1569.002'", ts="written_at")
add("password_spray", ["events"], f"""SELECT host_id, 'Password spray from ' || src || ': ' || d || ' accounts, ' || n || ' attempts' AS title, CASE WHEN d >= 25 THEN 3 ELSE 2 END AS severity, 'reconnaissance' AS phase, 'T1110.003' AS attack_id, make_timestamp(lo) AS ts,
 {say("{d} accounts were tried from {src}, {printf('%.1f', n / d)} failures for each on average." + chr(10) + "Time span: {@make_timestamp(lo)} -> {@make_timestamp(us)}" + chr(10) + "Some of the accounts: {array_to_string(names[1:8], ', ')}{CASE WHEN d > 8 THEN ', ...' END}")} AS detail, [] AS ev FROM h WHERE k = 1""",
    f""", f AS (SELECT host_id, epoch_us(written_at) us, record_number rn, {fld('IpAddress')} ip, {fld('WorkstationName')} ws, lower({fld('TargetUserName')}) usr FROM a_events WHERE event_id = 4625),
 s AS (SELECT *, CASE WHEN trim(coalesce(ip, '')) NOT IN ('', '-', '::1', '127.0.0.1') THEN trim(ip) WHEN trim(coalesce(ws, '')) NOT IN ('', '-') THEN trim(ws) END src FROM f),
 g AS (SELECT a.host_id, a.src, a.us, a.rn, count(*) n, count(DISTINCT b.usr) d, min(b.us) lo, list_sort(list(DISTINCT b.usr)) names FROM s a JOIN s b ON a.host_id = b.host_id AND a.src = b.src AND b.us >= a.us - {K3} AND (b.us < a.us OR (b.us = a.us AND b.rn <= a.rn)) GROUP BY a.host_id, a.src, a.us, a.rn),
 h AS (SELECT *, row_number() OVER (PARTITION BY host_id, src ORDER BY us, rn) k FROM g WHERE d >= 4 AND n <= d * 3)""")
add("kerberoasting", ["events"], f"""SELECT host_id, 'Kerberoasting burst by ' || acct || ': ' || d || ' service tickets (RC4)' AS title, 3 AS severity, 'reconnaissance' AS phase, 'T1558.003' AS attack_id, make_timestamp(lo) AS ts,
 {say("{acct} asked for RC4-encrypted tickets to {d} services." + chr(10) + "Time span: {@make_timestamp(lo)} -> {@make_timestamp(us)}" + chr(10) + "Services: {array_to_string(names[1:10], ', ')}{CASE WHEN d > 10 THEN ', ...' END}")} AS detail, [] AS ev FROM h WHERE k = 1""",
    f""", f AS (SELECT host_id, epoch_us(written_at) us, record_number rn, lower(trim({fld('TargetUserName')})) acct, trim({fld('ServiceName')}) svc FROM a_events
  WHERE event_id = 4769 AND contains(lower(channel), 'security') AND lower(trim({fld('TicketEncryptionType')})) IN ('0x17', '0x18')),
 s AS (SELECT * FROM f WHERE acct IS NOT NULL AND acct NOT IN ('', '-') AND NOT ends_with(acct, '$') AND svc IS NOT NULL AND lower(svc) NOT IN ('', '-', 'krbtgt')),
 v AS (SELECT a.host_id, a.acct, a.us, a.rn, lower(b.svc) svc, min((b.us, b.rn)) p, min(b.us) lo FROM s a JOIN s b ON a.host_id = b.host_id AND a.acct = b.acct AND b.us >= a.us - {2 * K3} AND (b.us < a.us OR (b.us = a.us AND b.rn <= a.rn)) GROUP BY a.host_id, a.acct, a.us, a.rn, lower(b.svc)),
 g AS (SELECT host_id, acct, us, rn, count(*) d, min(lo) lo, list(svc ORDER BY p) names FROM v GROUP BY host_id, acct, us, rn),
 h AS (SELECT *, row_number() OVER (PARTITION BY host_id, acct ORDER BY us, rn) k FROM g WHERE d >= 3)""")
simple("asrep_roastable", "events", detail=say("{lower(trim(acct))} got an RC4 ticket with pre-authentication turned off.\nSeen by {computer}, {@written_at}."), src=ev(acct="TargetUserName", pre="PreAuthType", enc="TicketEncryptionType"),
       where="event_id = 4768 AND contains(lower(channel), 'security') AND trim(pre) = '0' AND lower(trim(enc)) IN ('0x17', '0x18') AND acct IS NOT NULL AND trim(acct) NOT IN ('', '-') AND NOT ends_with(acct, '$')",
       title="'AS-REP roastable account: ' || lower(trim(acct))", severity="3", phase="'reconnaissance'", attack="'T1558.004'", ts="written_at")
SIGNS = case_([(f"contains(low, {q(img)}) AND {all_('low', args)}", q(lab)) for lab, img, args, _ in w.DISCOVERY_SIGNS])
add("discovery_burst", ["events"], f"""SELECT host_id, 'Domain reconnaissance burst on ' || computer || ': 3 discovery commands' AS title, 2 AS severity, 'reconnaissance' AS phase, 'T1087' AS attack_id, t2 AS ts,
 {say("Time span: {@t2} to {@written_at}." + chr(10) + "What was run: {l2}, {l1}, {lab}")} AS detail, {some('[f2, f1, source_file]')} AS ev FROM h WHERE k = 1 AND lab <> l1 AND lab <> l2 AND l1 <> l2""",
    f""", f AS (SELECT host_id, computer, written_at, record_number, source_file, {SIGNS} lab FROM (SELECT *, lower({HAY}) low FROM {PROC}) a),
 g AS (SELECT *, lag(written_at, 2) OVER o t2, lag(lab, 1) OVER o l1, lag(lab, 2) OVER o l2, lag(source_file, 1) OVER o f1, lag(source_file, 2) OVER o f2 FROM f WHERE lab IS NOT NULL WINDOW o AS (PARTITION BY host_id, computer ORDER BY written_at, record_number)),
 h AS (SELECT *, row_number() OVER (PARTITION BY host_id, computer ORDER BY written_at, record_number) k FROM g WHERE epoch_us(written_at) - epoch_us(t2) <= {K3})""")

FULL_KEY = r"hive || '\' || regexp_replace(path, '^[\\/]+|[\\/]+$', '', 'g')"
simple("run_keys", "registry", detail=say("Entry: {name}\nCommand: {data}\nHive: {hive}\nKey: {path}{?Suspicious tokens: |nullif(array_to_string(why, ', '), '')}{?Key last-written: |@last_written}"), ev=f"[{FULL_KEY}, source_file]", src=f"(SELECT *, {count_('lower(data)', w.RUN_TOKENS)} n, {found('lower(data)', w.RUN_TOKENS)} why FROM a_registry) r", where=f"name <> '' AND {any_('lower(path)', w.RUN_KEYS)}", title="'Run-key persistence: ' || name",
       severity="CASE WHEN n = 0 THEN 2 WHEN n <= 2 THEN 3 ELSE 4 END", phase="'installation'", attack="'T1547.001'", ts="last_written")
simple("service_image_paths", "registry", detail=say(r"Service: {regexp_extract(path, 'Services\\([^\\]+)', 1)}" + "\nImage: {data}{CASE WHEN " + any_("lower(data)", w.SERVICE_REGISTRY_TOKENS) + " THEN chr(10) || 'Runs a system tool or an encoded command' END}{CASE WHEN " + any_("lower(data)", w.USER_WRITABLE) + " THEN chr(10) || 'Starts from a folder that users can write' END}{?Last written: |@last_written}"), ev=f"[{FULL_KEY}, source_file]", where=f"contains(upper(hive), 'SYSTEM') AND {any_('path', w.SERVICE_KEYS)} AND name IN ('ImagePath', 'ServiceDll')",
       title=r"'Service ''' || regexp_extract(path, 'Services\\([^\\]+)', 1) || ''' image path: ' || data", severity=path_sev("lower(data)", w.SERVICE_REGISTRY_TOKENS), phase="'installation'", attack="'T1543.003'", ts="last_written")
add("usb_history", ["registry"], f"""SELECT host_id, 'USB device connected: ' || label AS title, 0 AS severity, 'delivery' AS phase, 'T1091' AS attack_id, seen AS ts,
 {say("Device: {label}" + chr(10) + "Serial: {serial}{?Desc: |CASE WHEN d <> label THEN d END}{?Last seen: |@seen}" + chr(10) + "Key: {path}")} AS detail, [path] AS ev FROM (SELECT *, coalesce(f, d, serial) label FROM (
 SELECT host_id, path, {BASE.format('path')} serial, min(CASE WHEN name = 'FriendlyName' THEN data END) f, min(CASE WHEN name = 'DeviceDesc' THEN data END) d, max(last_written) seen
 FROM a_registry WHERE contains(upper(hive), 'SYSTEM') AND {any_('path', w.USB_KEYS)} AND length(path) - length(replace(path, '\\', '')) >= 5 GROUP BY host_id, path) a) b""")
ROT = "translate({0}, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM')"
MRU = f"""(SELECT *, lower(subj) low FROM (SELECT *, CASE b WHEN 'run' THEN regexp_replace(data, '\\\\1$', '') WHEN 'launch' THEN {ROT.format('name')} ELSE data END subj FROM (SELECT *, CASE WHEN contains(lower(path), 'explorer\\runmru') THEN 'run' WHEN contains(lower(path), 'explorer\\typedpaths') THEN 'typed'
 WHEN contains(lower(path), 'explorer\\recentdocs') THEN 'recent' WHEN contains(lower(path), 'comdlg32\\opensavepidlmru') OR contains(lower(path), 'comdlg32\\lastvisitedpidlmru') THEN 'dialog' WHEN contains(lower(path), 'explorer\\userassist') THEN 'launch' END b FROM a_registry WHERE name <> '') a) b2) r"""
IT = case_([(f"contains(low, {q(t)})", q(a)) for t, a in w.MRU_INTERPRETERS])
MRU_WHY = f"""concat_ws('; ', CASE WHEN b = 'run' THEN 'interpreter/proxy binary (' || {first_('low', [t for t, _ in w.MRU_INTERPRETERS])} || ')' END, CASE WHEN b = 'run' AND {any_('low', w.MRU_CRADLES)} THEN 'encoded/download-cradle token' END,
 CASE WHEN b = 'typed' AND starts_with(data, '\\\\') THEN 'UNC path to a remote share' END, CASE WHEN b IN ('recent', 'dialog') THEN 'risky extension (' || {first_('low', w.MRU_EXTENSIONS)} || ')' END,
 CASE WHEN NOT (b = 'typed' AND starts_with(data, '\\\\')) THEN 'suspicious path (' || CASE WHEN b = 'launch' THEN {first_('low', w.USERASSIST_PATHS)} ELSE {first_('low', w.MRU_PATHS)} END || ')' END)"""
simple("recent_use", "registry", detail=say("Entry: {subj}\nWhy flagged: {" + MRU_WHY + "}\nHive: {hive}\nKey: {path}"), ev=f"[{FULL_KEY}, source_file]", src=MRU, where=f"""(b = 'run' AND lower(name) NOT IN ('mrulist', 'mrulistex') AND ({any_('low', [t for t, _ in w.MRU_INTERPRETERS])} OR {any_('low', w.MRU_CRADLES)} OR {any_('low', w.MRU_PATHS)}))
 OR (b = 'typed' AND (starts_with(data, '\\\\') OR {any_('low', w.MRU_PATHS)})) OR (b IN ('recent', 'dialog') AND lower(name) <> 'mrulistex' AND ({any_('low', w.MRU_EXTENSIONS)} OR {any_('low', w.MRU_PATHS)})) OR (b = 'launch' AND lower(name) <> 'version' AND {any_('low', w.USERASSIST_PATHS)})""",
       title="CASE b WHEN 'run' THEN 'Suspicious Run-box command typed: ' || name WHEN 'typed' THEN 'Suspicious path typed in Explorer: ' || name WHEN 'recent' THEN 'Risky file in RecentDocs: ' || name WHEN 'dialog' THEN 'Risky file in ComDlg32 dialog MRU: ' || name ELSE 'GUI launch from suspicious path (UserAssist): ' || subj END",
       severity="2", phase="CASE WHEN b = 'typed' AND NOT starts_with(data, '\\\\') THEN 'reconnaissance' ELSE 'exploitation' END",
       attack=f"CASE WHEN b = 'run' THEN coalesce({IT}, 'T1059') WHEN b = 'typed' AND starts_with(data, '\\\\') THEN 'T1021.002' WHEN b = 'typed' THEN 'T1083' ELSE 'T1204.002' END", ts="last_written")


def place(c, hi, med):
    return case_([(any_(c, hi), 3), (any_(c, med), 2)])


LOL = case_([(f"lower(executable_name) = {q(n)}", s) for n, (a, s) in w.LOLBINS.items()])
LOLA = case_([(f"lower(executable_name) = {q(n)}", q(a)) for n, (a, s) in w.LOLBINS.items()])
PREFETCH = "{coalesce(executable_path, executable_name)}\nRan {run_count} time{CASE WHEN run_count <> 1 THEN 's' END}{CASE WHEN coalesce(run1, run2) IS NULL THEN '.' ELSE '; last run ' || " + iso("coalesce(run1, run2)") + " || '.' END}"
add("prefetch_execution", ["prefetch"], f"""SELECT host_id, 'Execution from suspicious path: ' || executable_name AS title, {place('lower(executable_path)', w.STAGING, [w.DOWNLOADS])} AS severity, 'exploitation' AS phase, 'T1204.002' AS attack_id, coalesce(run1, run2) AS ts,
 {say(PREFETCH + chr(10) + "Ran from {replace(" + first_('lower(executable_path)', [*w.STAGING, w.DOWNLOADS]) + ", chr(92), '')}")} AS detail, [coalesce(executable_path, executable_name), source_file] AS ev FROM a_prefetch
 UNION ALL SELECT host_id, 'LOLBin execution: ' || executable_name, {LOL}, 'exploitation', {LOLA}, coalesce(run1, run2), {say(PREFETCH)}, [coalesce(executable_path, executable_name), source_file] FROM a_prefetch""")
simple("amcache_presence", "amcache", detail=say("{full_path}{?SHA-1: |sha1}{?Size (bytes): |size}{?Registered in Amcache: |@registered_at}"), ev="[full_path, sha1]", title="'Suspicious binary present (Amcache): ' || name", severity=place("lower(full_path)", w.PRESENCE_HIGH, w.PRESENCE_MEDIUM), phase="'installation'", attack="'T1204.002'", ts="registered_at")
simple("shimcache_presence", "shimcache", detail=say("{path}\nPlace in the cache, newest first: {insertion_order}{?File modified: |@last_modified}"), ev="[path]", title=f"'Suspicious path present (Shimcache): ' || {base('path')}", severity=place("lower(path)", w.PRESENCE_HIGH, w.PRESENCE_MEDIUM), phase="'installation'", attack="'T1204.002'", ts="last_modified")
LN = r"regexp_replace(regexp_extract(source_file, '([^\\/]+)[\\/]*$', 1), '\.(?i:lnk)$', '')"
simple("lnk_shortcuts", "lnk", detail=say("Target: {coalesce(tgt, '(none)')}{?Arguments: |nullif(arguments, '')}{?Created on host: |machine_identifier}\nShortcut: {source_file}"), ev="[source_file, tgt]", src="(SELECT *, coalesce(local_path, network_path) tgt FROM a_lnk) r", title=f"CASE WHEN arguments <> '' THEN 'Shortcut with command-line arguments: ' ELSE 'Shortcut to suspicious path: ' END || {LN}",
       severity=f"CASE WHEN arguments <> '' THEN CASE WHEN {any_('lower(arguments)', w.LNK_TOKENS)} THEN 3 ELSE 2 END ELSE {place('lower(tgt)', w.STAGING, w.TARGET_MEDIUM)} END", phase="'exploitation'", attack="'T1204.002'", ts="coalesce(target_modified, target_accessed)")
RDP = f"(lower(app_id) = {q(w.RDP_APP_ID)} AND target_path <> '')"
simple("jump_lists", "jumplist", detail=say("Target: {target_path}{?Application: |application}{?Recorded on host: |CASE WHEN " + RDP + " THEN hostname END}{?Last opened: |@last_accessed}\nList: {list_type}"), ev="[source_file, target_path]", title=f"CASE WHEN {RDP} THEN 'RDP destination (JumpList): ' || target_path ELSE 'JumpList target in suspicious path: ' || {base('target_path')} END",
       severity=f"CASE WHEN {RDP} THEN 2 ELSE {place('lower(target_path)', w.STAGING, w.TARGET_MEDIUM)} END", phase=f"CASE WHEN {RDP} THEN 'actionsOnObjectives' ELSE 'exploitation' END", attack=f"CASE WHEN {RDP} THEN 'T1021.001' ELSE 'T1204.002' END", ts="last_accessed")
UEX = f"{EXT.format('file_name')} IN {in_(w.USN_EXEC)}"
REASONS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN ({{0}} & {bit}) <> 0 THEN {q(n)} END" for bit, n in w.USN_REASONS) + "], lambda x: x IS NOT NULL), ', ')"
add("usn_create_delete", ["usn"], f"""SELECT d.host_id, 'Created-then-deleted executable (USN): ' || d.file_name AS title, 3 AS severity, 'actionsOnObjectives' AS phase, 'T1070.004' AS attack_id, d.timestamp AS ts, {say("The file came and went while the journal was kept." + chr(10) + "Reasons: {" + REASONS.format("d.reason_raw") + "}{?When: |@d.timestamp}")} AS detail, [d.file_name, d.source_file] AS ev FROM a_usn d WHERE (d.reason_raw & 512) <> 0 AND {UEX}
 AND EXISTS (SELECT 1 FROM a_usn c WHERE c.host_id = d.host_id AND c.mft_entry = d.mft_entry AND (c.reason_raw & 256) <> 0 AND c.usn <= d.usn)""")
add("usn_renamed_to_exec", ["usn"], f"""SELECT host_id, 'Renamed to executable (USN): ' || old || ' → ' || file_name AS title, 2 AS severity, 'installation' AS phase, 'T1036.003' AS attack_id, timestamp AS ts, {say("The new name ends like a program, the old one did not." + chr(10) + "Reasons: {" + REASONS.format("reason_raw") + "}{?When: |@timestamp}")} AS detail, [file_name, source_file] AS ev FROM
 (SELECT *, last_value(CASE WHEN (reason_raw & 4096) <> 0 THEN file_name END IGNORE NULLS) OVER (PARTITION BY host_id, mft_entry ORDER BY usn ROWS UNBOUNDED PRECEDING) old FROM a_usn) r WHERE (reason_raw & 8192) <> 0 AND {UEX} AND old IS NOT NULL AND {EXT.format('old')} NOT IN {in_(w.USN_EXEC)}""")
add("usn_mass_delete", ["usn"], f"""SELECT host_id, 'Mass file deletion (USN): ' || n || ' deletes' AS title, 2 AS severity, 'actionsOnObjectives' AS phase, 'T1070.004' AS attack_id, last AS ts,
 {say("The change journal lists {n} deleted files.{CASE WHEN first IS NOT NULL THEN chr(10) || 'Span: ' || " + iso("first") + " || ' → ' || " + iso("last") + " END}")} AS detail, [file] AS ev FROM (
 SELECT host_id, count(*) FILTER ((reason_raw & 512) <> 0) n, arg_min(timestamp, CASE WHEN (reason_raw & 512) <> 0 AND timestamp IS NOT NULL THEN usn END) AS first, arg_max(timestamp, CASE WHEN (reason_raw & 512) <> 0 AND timestamp IS NOT NULL THEN usn END) AS last, arg_min(source_file, usn) file FROM a_usn GROUP BY host_id) g WHERE n >= 200""")
def human(c: str) -> str:
    steps = [(1024**4, "TB"), (1024**3, "GB"), (1024**2, "MB"), (1024, "KB")]
    return case_([(f"{c} >= {n}", f"printf('%.1f', round_even({c} / {n}.0, 1)) || ' {u}'") for n, u in steps], f"{c} || ' B'")


SR = """(SELECT host_id, lower(application) app, count(*) n, sum(coalesce(bytes_sent, 0))::BIGINT sent, sum(coalesce(bytes_received, 0))::BIGINT received, max(timestamp) last, arg_max(application, struct_pack(a := timestamp IS NOT NULL, b := coalesce(timestamp, TIMESTAMP '1970-01-01'), c := application)) p,
 arg_max(source_file, struct_pack(a := timestamp IS NOT NULL, b := coalesce(timestamp, TIMESTAMP '1970-01-01'), c := application)) file FROM a_srum WHERE kind = '%s' AND application <> '' GROUP BY host_id, lower(application)) r"""
simple("srum_execution", "srum", detail=say("{p}\nSRUM rows: {n}{'; last ' || " + iso("last") + "}."), ev="[p, file]", src=SR % "appResourceUsage", title=f"'SRUM execution from suspicious path: ' || {base('p')}", severity=place("app", w.STAGING, [w.DOWNLOADS]), phase="'exploitation'", attack="'T1204.002'", ts="last")
simple("srum_egress", "srum", detail=say("{p}\nSRUM totals: {" + human("sent") + "} out, {" + human("received") + "} in{'; last ' || " + iso("last") + "}."), ev="[p, file]", src=SR % "networkData", title=f"'SRUM network egress from suspicious path: ' || {base('p')}", where=f"sent > 0 AND {any_('app', w.STAGING + [w.DOWNLOADS])}", severity="CASE WHEN sent >= 10485760 THEN 3 ELSE 2 END", phase="'actionsOnObjectives'", attack="'T1048'", ts="last")
FT = "make_timestamp({0} // 10 - 11644473600000000)"
simple("mft_timestomp", "mft", detail=say("{coalesce(full_path, file_name)}\nThe standard record claims {@" + FT.format("si_created_raw") + "}, the name record {@" + FT.format("fn_created_raw") + "}: {CASE WHEN (fn_created_raw // 10 - si_created_raw // 10) // 1000000 >= 86400 THEN (fn_created_raw // 10 - si_created_raw // 10) // 1000000 // 86400 || 'd' WHEN (fn_created_raw // 10 - si_created_raw // 10) // 1000000 >= 3600 THEN (fn_created_raw // 10 - si_created_raw // 10) // 1000000 // 3600 || 'h' ELSE (fn_created_raw // 10 - si_created_raw // 10) // 1000000 // 60 || 'm' END} earlier."), ev="[coalesce(full_path, file_name), source_file]", where=f"NOT is_directory AND file_name IS NOT NULL AND {EXT.format('file_name')} IN {in_(w.MFT_EXEC)} AND si_created_raw > 0 AND fn_created_raw // 10 - si_created_raw // 10 > 86400000000 AND si_created_raw % 10000000 = 0 AND si_modified_raw % 10000000 = 0",
       title="'Possible timestomping (MFT): ' || file_name", severity=f"CASE WHEN {any_('lower(coalesce(full_path, file_name))', w.STAGING + [w.DOWNLOADS])} THEN 3 ELSE 2 END", phase="'actionsOnObjectives'", attack="'T1070.006'", ts=FT.format("fn_created_raw"))
WH = "lower(coalesce(command, '') || ' ' || coalesce(query, '') || ' ' || coalesce(consumer_name, ''))"
add("wmi_persistence", ["wmi"], f"""SELECT host_id, CASE WHEN kind = 'binding' THEN 'WMI persistence: ' || coalesce(consumer_name, '?') || ' ← ' || coalesce(filter_name, '?') ELSE 'WMI script consumer payload (' || coalesce(script_engine, 'script') || ')' END AS title,
 CASE WHEN kind = 'scriptConsumer' OR consumer_type = 'ActiveScriptEventConsumer' OR {any_(WH, w.WMI_TOKENS)} THEN 3 ELSE 1 END AS severity, 'installation' AS phase, 'T1546.003' AS attack_id, NULL AS ts,
 CASE WHEN kind = 'binding' THEN {say("Filter " + chr(34) + "{coalesce(filter_name, '?')}" + chr(34) + " → consumer " + chr(34) + "{coalesce(consumer_name, '?')}" + chr(34) + " ({coalesce(consumer_type, '?')}).{?Trigger (WQL): |nullif(query, '')}{?Runs: |nullif(command, '')}{?Suspicious indicator: |" + first_(WH, w.WMI_TOKENS) + "}")} ELSE {say("A WMI subscription carries this script:" + chr(10) + "{substr(script_text, 1, 300)}")} END AS detail, CASE WHEN kind = 'binding' THEN [command, source_file] ELSE [source_file] END AS ev FROM a_wmi WHERE kind = 'scriptConsumer' OR NOT is_common_benign""")
simple("recycled_executable", "recycle_bin", detail=say("Original path: {original_path}{?User SID: |sid}{?Deleted: |@deleted_at}"), ev="[original_path, source_file]", src=f"(SELECT *, {base('original_path')} nm FROM a_recycle_bin) r", where=f"{EXT.format('nm')} IN {in_(w.BIN_EXEC)}", title="'Deleted executable in Recycle Bin: ' || nm",
       severity=f"CASE WHEN {any_(chr(108) + 'ower(replace(original_path, ' + q('/') + ', ' + q(chr(92)) + '))', w.BIN_PATHS)} THEN 3 ELSE 2 END", phase="'actionsOnObjectives'", attack="'T1070.004'", ts="deleted_at")
add("recycle_bin_burst", ["recycle_bin"], f"""SELECT host_id, 'Mass file deletion (Recycle Bin): ' || n || ' deletes' AS title, 2 AS severity, 'actionsOnObjectives' AS phase, 'T1070.004' AS attack_id, deleted_at AS ts,
 {say("{n} files went to the recycle bin in at most 180 minutes." + chr(10) + "Time span: {@lo} → {@deleted_at}")} AS detail, [coalesce(nullif((SELECT min(source_file) FROM a_recycle_bin r WHERE r.host_id = b.host_id AND r.deleted_at = lo), ''), '$Recycle.Bin')] AS ev FROM (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY n DESC, deleted_at) k FROM
 (SELECT host_id, deleted_at, count(*) OVER o n, min(deleted_at) OVER o lo FROM a_recycle_bin WHERE deleted_at IS NOT NULL WINDOW o AS (PARTITION BY host_id ORDER BY deleted_at RANGE BETWEEN INTERVAL 3 HOUR PRECEDING AND CURRENT ROW)) a WHERE n >= 5) b WHERE k = 1""")

# ---- Cross-platform ---------------------------------------------------------------------------
FP = "(CASE WHEN ends_with(parent_path, '/') THEN parent_path ELSE parent_path || '/' END || name)"
ST = f"({any_(f'lower({FP})', x.STARTUP_FOLDERS)} AND {EXT.format('name')} IN {in_(x.STARTUP_EXTENSIONS)})"
simple("persistence_files", "files", detail=say("{" + FP + "}\nSize: {size} bytes."), ev=f"[{FP}]", where="NOT is_directory AND NOT is_deleted AND size > 0", title=f"CASE WHEN {ST} THEN 'Startup-folder item: ' ELSE 'Scheduled task definition: ' END || name", severity=case_([(ST, 2), (any_(f"lower({FP})", x.TASK_FOLDERS), 0)]),
       phase="'installation'", attack=f"CASE WHEN {ST} THEN 'T1547.001' ELSE 'T1053.005' END", ts="coalesce(modified, created)")
VEN = lambda c: case_([(f"{c} = {q(e)}", q(v)) for e, v in x.REMOTE_TOOLS.items()])
DR = lambda c: any_(f"lower({c})", x.DROPPED_ROOTS)
simple("remote_tools_run", "events", detail=say("Started: {image}\nHost and time: {computer}, {@written_at}"), ev="[image]", src=f"(SELECT *, lower({base('image')}) ib FROM {PROC}) r", where=f"ib IN {in_(x.REMOTE_TOOLS)}", title=f"{VEN('ib')} || ' executed on ' || computer || CASE WHEN {DR('image')} THEN ' (dropped location)' ELSE '' END",
       severity=f"CASE WHEN {DR('image')} THEN 3 ELSE 2 END", phase="'commandAndControl'", attack="'T1219'", ts="written_at")
simple("remote_tools_on_disk", "files", detail=say("File: {" + FP + "}\nSize: {size} bytes{?Created: |@created}{?Modified: |@modified}"), ev=f"[{FP}]", where=f"lower(name) IN {in_(x.REMOTE_TOOLS)}", title=f"{VEN('lower(name)')} || ' binary on disk: ' || {FP} || CASE WHEN {DR('parent_path')} THEN ' (dropped location)' ELSE '' END",
       severity=f"CASE WHEN {DR('parent_path')} THEN 3 ELSE 1 END", phase="'commandAndControl'", attack="'T1219'", ts="coalesce(created, modified)")
BH = f"(SELECT *, {HOST.format('url')} host, CASE WHEN target_path <> '' THEN {base('target_path')} END leaf FROM a_browser_history) b"
SH = lambda c: f"coalesce({any_(c, x.SUSPICIOUS_HOSTS)}, false)"
DX = r"lower(regexp_extract({0}, '^.+\.([^.]+)$', 1))"
NEW = "struct_pack(a := timestamp IS NOT NULL, b := coalesce(timestamp, TIMESTAMP '1970-01-01'), c := {0})"
OLD = "struct_pack(a := timestamp IS NULL, b := coalesce(timestamp, TIMESTAMP '1970-01-01'), c := {0})"
DL = base("CASE WHEN r.t = '' THEN r.u ELSE r.t END")
add("browser_downloads", ["browser_history"], f"""SELECT host_id, 'Suspicious browser download: ' || {DL} AS title, CASE WHEN r.x IN {in_(x.DOWNLOAD_EXEC)} OR bad THEN 3 ELSE 2 END AS severity, 'delivery' AS phase, 'T1105' AS attack_id, last AS ts,
 {say("Downloaded {" + DL + "} from {r.u}.{CASE WHEN n > 1 THEN chr(10) || 'Seen ' || n || ' times.' END}")} AS detail, [r.u, r.t, r.f] AS ev FROM
 (SELECT host_id, lower(coalesce(target_path, url)) k, count(*) n, bool_or({SH('host')}) bad, max(timestamp) last, arg_max(struct_pack(u := url, t := coalesce(target_path, ''), x := ext, f := source_file), {NEW.format('url')}) r FROM (SELECT *, {DX.format('coalesce(leaf, url)')} ext FROM {BH}) a WHERE kind = 'download' AND (ext IN {in_(x.DOWNLOAD_EXEC + x.DOWNLOAD_ARCHIVE)} OR {SH('host')}) GROUP BY 1, 2) g""")
MANY = lambda c, word: f"CASE WHEN {c} > 0 THEN {c} || ' {word}' || CASE WHEN {c} <> 1 THEN 's' ELSE '' END END"
add("suspicious_hosts", ["browser_history"], f"""SELECT host_id, 'Browser activity to suspicious host: ' || host AS title, CASE WHEN d > 0 THEN 3 ELSE 2 END AS severity, 'commandAndControl' AS phase, 'T1102' AS attack_id, last AS ts,
 {say("{concat_ws(', ', " + MANY("v", "visit") + ", " + MANY("d", "download") + ")} to {host}{CASE WHEN raw THEN ' (raw IP address)' END}." + chr(10) + "Example: {sample}{?Last |@last}")} AS detail, [sample, file] AS ev FROM
 (SELECT host_id, host, count(*) FILTER (kind <> 'download') v, count(*) FILTER (kind = 'download') d, bool_or({IP4.format('host')}) raw, max(timestamp) last, arg_min(url, {OLD.format('url')}) sample, arg_max(source_file, {NEW.format('source_file')}) file FROM {BH} WHERE host IS NOT NULL AND ({IP4.format('host')} OR {SH('host')}) GROUP BY 1, 2) g""")
add("offensive_tools_browsed", ["browser_history"], f"""SELECT host_id, 'Offensive tool referenced in browser history: ' || tool AS title, 3 AS severity, 'weaponization' AS phase, 'T1588.002' AS attack_id, last AS ts,
 {say("Example: {sample}{CASE WHEN n > 1 THEN chr(10) || 'Seen ' || n || ' times.' END}{?Last |@last}")} AS detail, [sample, file] AS ev FROM
 (SELECT host_id, tool, count(*) n, max(timestamp) last, arg_min(coalesce(target_path, url), {OLD.format('url')}) sample, arg_max(source_file, {NEW.format('source_file')}) file FROM (SELECT *, {first_("lower(url || ' ' || coalesce(leaf, ''))", x.OFFENSIVE_TOOLS)} tool FROM {BH}) a WHERE tool IS NOT NULL GROUP BY 1, 2) g""")
LINES = f"""(SELECT *, lower(line) low FROM (SELECT host_id, written_at seen, trim({HAY}) line, source_file, concat('Host ', computer, ' (EID ', event_id, ')') origin FROM {PROC} WHERE {HAY} IS NOT NULL AND trim({HAY}) <> ''
 UNION ALL SELECT host_id, timestamp, command, source_file, concat('Shell history (', "user", ', ', shell, ')') FROM a_shell_history) u) r"""
SHOWN = "substr(trim(regexp_replace(line, '[ \\n\\t]+', ' ', 'g')), 1, 400)"
REC = case_([(all_("low", t), q(lab)) for lab, t in x.RECOVERY_RULES])
add("recovery_inhibition", ["events", "shell_history"], f"SELECT host_id, 'Inhibit System Recovery: ' || {REC} AS title, CASE WHEN {REC} IS NOT NULL THEN 4 END AS severity, 'actionsOnObjectives' AS phase, 'T1490' AS attack_id, seen AS ts, {say('{origin} executed a recovery-inhibition command.' + chr(10) + 'Command: {' + SHOWN + '}')} AS detail, [source_file] AS ev FROM {LINES}")
WT = case_([(all_("low", t), q("Data destruction / disk wipe: " + lab)) for lab, t, a in x.WIPE_RULES] + [(all_("low", x.BOOT_SECTOR_TOKENS), q("Disk-structure overwrite (dd to boot sector)"))])
WA = case_([(all_("low", t), q(a)) for lab, t, a in x.WIPE_RULES] + [(all_("low", x.BOOT_SECTOR_TOKENS), q("T1561.002"))])
add("disk_wipe", ["events", "shell_history"], f"SELECT host_id, {WT} AS title, CASE WHEN {REC} IS NULL AND {WT} IS NOT NULL THEN 3 END AS severity, 'actionsOnObjectives' AS phase, {WA} AS attack_id, seen AS ts, {say('{origin} ran a destructive command.' + chr(10) + 'Command: {' + SHOWN + '}')} AS detail, [source_file] AS ev FROM {LINES}")
add("mass_encryption", ["files", "usn", "mft"], f"""SELECT host_id, 'Possible mass file encryption: ' || n || ' files with extension ' || chr(39) || '.' || ext || chr(39) AS title, CASE WHEN n >= 25 THEN 4 END AS severity, 'actionsOnObjectives' AS phase, 'T1486' AS attack_id, NULL AS ts,
 {say("{CASE WHEN ext IN " + in_(x.RANSOM_EXTENSIONS) + " THEN 'Known ransomware extension.' ELSE 'Uncommon uniform extension.' END}" + chr(10) + "The contents were not at hand, so nothing is said about encryption." + chr(10) + "Sample: {array_to_string(names[1:5], ', ')}.")} AS detail, [seen.p] AS ev FROM (
 SELECT host_id, ext, count(DISTINCT nm) n, list_sort(list(DISTINCT nm)) names, min(struct_pack(r := r, p := shown)) seen FROM (
 SELECT host_id, {EXT.format('name')} ext, lower(name) nm, 0 r, {FP} shown FROM a_files WHERE NOT is_directory AND NOT ends_with(name, '-slack') UNION ALL SELECT host_id, {EXT.format('file_name')}, lower(file_name), 1, source_file FROM a_usn WHERE NOT is_directory AND (reason_raw & 8448) <> 0
 UNION ALL SELECT host_id, {EXT.format('file_name')}, lower(file_name), 2, coalesce(full_path, file_name) FROM a_mft WHERE NOT is_directory AND file_name IS NOT NULL) u WHERE ext <> '' AND (ext IN {in_(x.RANSOM_EXTENSIONS)} OR ext NOT IN {in_(x.BULK_EXTENSIONS)}) GROUP BY host_id, ext) g""")
NOTE = f"({any_('lower(name)', x.RANSOM_NOTES)} OR ((starts_with(lower(name), 'readme') OR contains(lower(name), 'read_me') OR contains(lower(name), 'read-me')) AND {any_('lower(name)', x.NOTE_INTENT)}))"
add("ransom_notes", ["files"], f"SELECT host_id, 'Ransom note dropped: ' || r.n AS title, 3 AS severity, 'actionsOnObjectives' AS phase, 'T1486' AS attack_id, r.t AS ts, {say('The name reads like a ransom demand: {r.p}')} AS detail, [r.p] AS ev FROM (SELECT host_id, lower(name) k, arg_min(struct_pack(n := name, p := {FP}, t := coalesce(created, modified)), struct_pack(a := id, b := parent_path, c := name, d := coalesce(created, modified))) r FROM a_files WHERE NOT is_directory AND {NOTE} GROUP BY 1, 2) g")
simple("remote_provider_shell", "events", detail=say("Process creation: {parent} -> {image}.{?Command line: |command}"), src=f"(SELECT *, lower({base('parent')}) pb, lower({base('image')}) ib FROM {PROC}) r", where=f"ib IN {in_(x.REMOTE_SHELL_CHILDREN)} AND pb IN ('wsmprovhost.exe', 'wmiprvse.exe')",
       title="CASE WHEN pb = 'wsmprovhost.exe' THEN 'WinRM / PowerShell Remoting' ELSE 'WMI remote execution' END || ': ' || pb || ' spawned ' || ib || ' on ' || computer", severity="3", phase="'exploitation'", attack="CASE WHEN pb = 'wsmprovhost.exe' THEN 'T1021.006' ELSE 'T1047' END", ts="written_at")
add("lateral_tokens", ["events"], rf"""SELECT host_id, f || ' on ' || computer AS title, 2 AS severity, 'exploitation' AS phase, a AS attack_id, written_at AS ts, {say("Process: {coalesce(image, '(unknown)')}" + chr(10) + "Command line: {command}")} AS detail, [source_file] AS ev FROM (
 SELECT *, 'WMI remote process creation (wmic /node:)' f, 'T1047' a FROM (SELECT *, lower(command) low FROM {PROC}) r WHERE contains(low, '/node:') AND contains(low, 'process call create') AND NOT contains(low, '/node:localhost') AND NOT contains(low, '/node:127.0.0.1')
 UNION ALL SELECT *, 'DCOM lateral movement object (' || {first_('low', x.DCOM_OBJECTS)} || ')', 'T1021.003' FROM (SELECT *, lower(command) low FROM {PROC}) r WHERE {any_('low', x.DCOM_OBJECTS)}
 UNION ALL SELECT *, 'SMB admin-share access (' || CASE WHEN regexp_matches(low, '\\\\.*\\admin\$') THEN 'admin$' ELSE 'c$' END || ')', 'T1021.002' FROM (SELECT *, lower(command) low FROM {PROC}) r WHERE regexp_matches(low, '\\\\.*\\(admin|c)\$')) u""")
simple("winrm_activity", "events", detail=say("Remote management over {CASE WHEN event_id = 5986 THEN 'HTTPS' ELSE 'HTTP' END}, event {event_id}, {@written_at}"), where="(contains(lower(channel), 'winrm') OR contains(lower(provider), 'winrm')) AND (event_id IN (5985, 5986) OR contains(lower(payload_xml), 'wsman'))", title="'WinRM remote-management activity on ' || computer", severity="1", phase="'exploitation'", attack="'T1021.006'", ts="written_at")
add("yara_rollup", ["yara_matches"], f"""SELECT host_id, 'YARA match: ' || rule AS title, 3 AS severity, 'delivery' AS phase, NULL AS attack_id, NULL AS ts,
 {say("Rule {rule} matched {n} file{CASE WHEN n <> 1 THEN 's' END}." + chr(10) + "{array_to_string(paths[1:20], chr(10))}{CASE WHEN n > 20 THEN chr(10) || '…and ' || (n - 20) || ' more' END}")} AS detail, paths[1:20] AS ev FROM (SELECT host_id, rule, count(*) n, list_sort(list(path)) paths FROM a_yara_matches GROUP BY 1, 2) g""")
add("known_bad_hashes", ["bad_hashes", "iocs", "amcache"], f"""SELECT NULL AS host_id, 'Known-bad hash (IOC): ' || value AS title, 3 AS severity, 'delivery' AS phase, 'T1588.001' AS attack_id, NULL AS ts, {say("Hash {value} matches the known-bad hash set.{?IOC note: |nullif(note, '')}")} AS detail, [value] AS ev FROM a_iocs WHERE kind = 'hash' AND lower(trim(value)) IN (SELECT lower(trim(value)) FROM a_bad_hashes)
 UNION ALL SELECT host_id, 'Known-bad binary present (Amcache): ' || name, 4, 'delivery', 'T1204', registered_at, {say("{coalesce(full_path, name)}{?SHA-1: |sha1}{?Registered in Amcache: |@registered_at}")}, [coalesce(full_path, name), sha1] FROM a_amcache WHERE sha1 IS NOT NULL AND lower(trim(sha1)) IN (SELECT lower(trim(value)) FROM a_bad_hashes)""")

# ---- Linux ------------------------------------------------------------------------------------
simple("root_ssh", "auth_log", detail=say("Root came in over SSH by {coalesce(method, '?')}{' from ' || source_ip}."), where="kind = 'sshAccepted' AND \"user\" = 'root'", title="'Direct root SSH login from ' || coalesce(source_ip, 'unknown')", severity="CASE WHEN method = 'password' THEN 3 ELSE 2 END", phase="'exploitation'", attack="'T1021.004'", ts="timestamp")
add("ssh_brute_force", ["auth_log", "logins"], f"""SELECT f.host_id, 'SSH brute force from ' || f.ip || CASE WHEN o.ip IS NOT NULL THEN ' SUCCEEDED' ELSE '' END AS title, CASE WHEN o.ip IS NOT NULL THEN 4 WHEN d > 3 THEN 3 ELSE 2 END AS severity, 'exploitation' AS phase,
 CASE WHEN o.ip IS NOT NULL THEN 'T1110' WHEN d > 3 THEN 'T1110.003' ELSE 'T1110.001' END AS attack_id, CASE WHEN o.ip IS NOT NULL THEN coalesce(o.ok.t, last) ELSE last END AS ts,
 {say("{n} failed logins from {f.ip} ({d} account name(s): {array_to_string(names[1:8], ', ')}){CASE WHEN o.ip IS NOT NULL THEN ' and an accepted ' || coalesce(o.ok.m, '?') || ' login for ' || coalesce(o.ok.u, '?') END}{?First: |@first}{?Last: |@last}")} AS detail, files AS ev FROM
 (SELECT host_id, ip, count(*) n, count(DISTINCT CASE WHEN u <> '' THEN u END) d, list_sort(list(DISTINCT u) FILTER (u <> '')) names, min(timestamp) AS first, max(timestamp) AS last, list_sort(list(DISTINCT source_file)) files FROM (SELECT host_id, source_ip ip, "user" u, timestamp, source_file FROM a_auth_log WHERE kind IN ('sshFailed', 'sshInvalidUser') UNION ALL SELECT host_id, host, "user", timestamp, source_file FROM a_logins WHERE is_failed_login) x WHERE ip <> '' GROUP BY 1, 2 HAVING count(*) >= 10) f
 LEFT JOIN (SELECT host_id, source_ip ip, arg_min(struct_pack(m := method, u := "user", t := timestamp), struct_pack(a := timestamp IS NULL, b := coalesce(timestamp, TIMESTAMP '1970-01-01'), c := "user", d := method)) ok FROM a_auth_log WHERE kind = 'sshAccepted' AND source_ip IS NOT NULL GROUP BY 1, 2) o ON f.host_id = o.host_id AND f.ip = o.ip""")
simple("account_created", "auth_log", detail=say("{process}: {message}"), where="kind = 'userAdded'", title="'Account created: ' || coalesce(\"user\", '?')", severity="2", phase="'installation'", attack="'T1136.001'", ts="timestamp")
SC = [(any_("low", t) + (f" AND {any_('low', l.EXECUTION_TAILS)}" if a == "T1105" else ""), i) for i, (t, ti, s, p, a) in enumerate(l.SHELL_RULES)]
add("shell_rules", ["shell_history"], f"""SELECT host_id, {case_([(f'i = {i}', q(r[1])) for i, r in enumerate(l.SHELL_RULES)])} || ' (' || u || ')' AS title, {case_([(f'i = {i}', r[2]) for i, r in enumerate(l.SHELL_RULES)])} AS severity, {case_([(f'i = {i}', q(r[3])) for i, r in enumerate(l.SHELL_RULES)])} AS phase, {case_([(f'i = {i}', q(r[4])) for i, r in enumerate(l.SHELL_RULES)])} AS attack_id, last AS ts, {say("{u}'s {e.s} history{CASE WHEN n > 1 THEN ' (' || n || '×)' END}:" + chr(10) + "{e.c}")} AS detail, [e.f] AS ev
 FROM (SELECT host_id, i, u, low, count(*) n, max(timestamp) AS last, arg_max(struct_pack(c := command, s := shell, f := source_file), struct_pack(a := line_number, b := source_file, c := command)) e FROM (SELECT *, "user" u, {case_(SC)} i FROM (SELECT *, lower(command) low FROM a_shell_history) a) b WHERE i IS NOT NULL GROUP BY host_id, i, u, low) g""")
PK = case_([(f"kind = {q(k)}", q(v[0])) for k, v in l.PERSISTENCE_KINDS.items()])
RB = "coalesce(kind = 'cron' AND lower(schedule) = '@reboot', false)"
simple("linux_persistence", "linux_persistence", detail=say("{" + PK + "}{' as ' || \"user\"} — {concat_ws('; ', CASE WHEN kind = 'ldPreload' THEN 'every program loads it' END, CASE WHEN kind = 'shellInit' THEN 'each login shell runs it' END, 'holds ' || chr(34) || trim(" + first_("lower(command)", l.PERSISTENCE_TOKENS) + ") || chr(34), CASE WHEN " + RB + " THEN 'starts with the system' END)}.\n{command}"), title=f"{PK} || ' persistence: ' || coalesce(unit_name, coalesce(schedule, '?') || '  ' || regexp_extract(command, '^ *([^ ]+)', 1))",
       severity=case_([(f"kind = 'ldPreload' OR {any_('lower(command)', l.PERSISTENCE_TOKENS)}", 3), (f"kind = 'shellInit' OR {RB}", 2)]), phase="'installation'", attack=case_([(f"kind = {q(k)}", q(v[1])) for k, v in l.PERSISTENCE_KINDS.items()]))
FORCED = "list_filter(split(options, ','), lambda o: starts_with(lower(o), 'command='))"
add("access_privilege", ["ssh_keys", "sshd_settings", "linux_users", "shadow", "sudo_rules", "linux_groups"], rf"""
 SELECT host_id, CASE WHEN regexp_matches(lower(options), '(^|,)command=') THEN 'Forced-command SSH key for ' || coalesce("user", '?') ELSE 'SSH key authorized for root' END AS title, CASE WHEN regexp_matches(lower(options), '(^|,)command=') THEN 2 WHEN "user" = 'root' THEN 3 END AS severity, 'installation' AS phase, 'T1098.004' AS attack_id, NULL AS ts, {say("{" + FORCED + "[1]} {algorithm} {comment}")} AS detail, [source_file] AS ev FROM a_ssh_keys WHERE kind = 'authorized'
 UNION ALL SELECT host_id, CASE WHEN key = 'permitemptypasswords' THEN 'sshd permits empty passwords' ELSE 'sshd permits root login (PermitRootLogin ' || value || ')' END, CASE WHEN key = 'permitemptypasswords' AND lower(value) = 'yes' THEN 4 WHEN key = 'permitrootlogin' AND lower(value) = 'yes' THEN 3 WHEN key = 'permitrootlogin' AND lower(value) IN ('without-password', 'prohibit-password') THEN 2 END, 'exploitation', 'T1021.004', NULL, {say("{key} {value}")}, [coalesce(source_file, '/etc/ssh/sshd_config')] FROM a_sshd_settings
 UNION ALL SELECT host_id, 'Non-root account with UID 0: ' || name, 4, 'installation', 'T1136.001', NULL, {say("Home {home}, shell {shell}.")}, ['/etc/passwd'] FROM a_linux_users WHERE uid = 0 AND name <> 'root'
 UNION ALL SELECT host_id, 'Passwordless account: ' || account, 3, 'installation', 'T1098', NULL, {say("{account} can log in with no password.")}, ['/etc/shadow'] FROM a_shadow WHERE status = 'empty'
 UNION ALL SELECT host_id, 'Passwordless full sudo for ' || principal, 3, 'exploitation', 'T1548.003', NULL, {say("Runs as {coalesce(run_as, 'ALL')}")}, [source_file] FROM a_sudo_rules WHERE no_passwd AND upper(command) = 'ALL' AND NOT starts_with(principal, '%') AND lower(principal) <> 'root'
 UNION ALL SELECT host_id, 'Root-equivalent group ' || chr(39) || name || chr(39) || ': ' || replace(members, 'root,', ''), 2, 'exploitation', 'T1548', NULL, {say("Whoever is in {name} can become root.")}, ['/etc/group'] FROM a_linux_groups WHERE name IN ('docker', 'lxd') AND members <> 'root'""")
WB = "(SELECT *, lower(path || coalesce('?' || query, '')) low FROM a_web_access) w"
TGW = "path || coalesce('?' || query, '')"
add("web_attacks", ["web_access"], " UNION ALL ".join(f"""SELECT host_id, {q(t)} || ' from ' || client_ip || CASE WHEN bool_or(status BETWEEN 200 AND 399) THEN ' (got 2xx/3xx)' ELSE '' END AS title, CASE WHEN bool_or(status BETWEEN 200 AND 399) THEN 3 ELSE 2 END AS severity, 'exploitation' AS phase, 'T1190' AS attack_id, max(timestamp) AS ts,
 {say("Requests of the kind {lower(" + q(t) + ")}: {count(*)}, such as {arg_min(" + TGW + ", " + OLD.replace("{0}", TGW) + ")}")} AS detail, [arg_max(source_file, {NEW.format('source_file')})] AS ev FROM {WB} WHERE {any_('low', n)} GROUP BY host_id, client_ip""" for t, n in l.WEB_CLASSES.values()))
add("webshells", ["web_access"], f"""SELECT host_id, 'Possible webshell access' || CASE WHEN bool_or(status BETWEEN 200 AND 299) THEN ' (200 OK)' ELSE '' END AS title, CASE WHEN bool_or(status BETWEEN 200 AND 299) THEN 4 ELSE 3 END AS severity, 'installation' AS phase, 'T1505.003' AS attack_id, max(timestamp) AS ts,
 {say("A path that looks like a web shell was asked for {count(*)} times: {arg_max(" + TGW + ", " + NEW.replace("{0}", TGW) + ")}.")} AS detail, [arg_max(source_file, {NEW.format('source_file')})] AS ev FROM {WB} WHERE {any_('low', l.WEBSHELL_TOKENS)} GROUP BY host_id, path, client_ip""")
add("web_scanners", ["web_access"], f"""SELECT host_id, 'Web scanner: ' || tool AS title, 2 AS severity, 'reconnaissance' AS phase, 'T1595.002' AS attack_id, max(timestamp) AS ts, {say("{tool} names itself in {count(*)} requests ({arg_max(user_agent, " + NEW.format('user_agent') + ")}).")} AS detail, [arg_max(source_file, {NEW.format('source_file')})] AS ev FROM (SELECT *, {first_('lower(user_agent)', l.SCANNER_AGENTS)} tool FROM a_web_access) a WHERE tool IS NOT NULL GROUP BY host_id, tool""")
add("directory_brute_force", ["web_access"], f"""SELECT host_id, 'Directory brute-force from ' || client_ip AS title, CASE WHEN n >= 100 THEN 1 END AS severity, 'reconnaissance' AS phase, 'T1595.003' AS attack_id, NULL AS ts, {say("{client_ip} asked for {n} pages that do not exist.")} AS detail, [file] AS ev FROM (SELECT host_id, client_ip, count(*) FILTER (status = 404) n, arg_min(source_file, {OLD.format('source_file')}) file FROM a_web_access GROUP BY 1, 2) g""")
simple("offensive_packages", "packages", detail=say("{manager} {upper(substr(action, 1, 1)) || lower(substr(action, 2))} of {package}{' ' || version}"), where=f"action IN ('install', 'reinstall') AND lower(package) IN {in_(l.OFFENSIVE_PACKAGES)}", title="'Offensive/dual-use package installed: ' || package", severity="CASE WHEN package IN ('gcc', 'make') THEN 1 ELSE 2 END", phase="'installation'", attack="'T1588.002'", ts="timestamp")
add("mass_package_removal", ["packages"], f"""SELECT host_id, 'Mass package removal (' || n || ' packages)' AS title, CASE WHEN n >= 2 THEN 2 END AS severity, 'actionsOnObjectives' AS phase, 'T1070' AS attack_id, last AS ts, {say("One run took out {n} packages ({array_to_string(names[1:8], ', ')}…)")} AS detail, [file] AS ev FROM
 (SELECT host_id, epoch_us(timestamp) // 60000000 k, count(*) n, max(timestamp) AS last, list(package ORDER BY timestamp, package) names, arg_min(source_file, {OLD.format('source_file')}) file FROM a_packages WHERE action IN ('remove', 'purge') GROUP BY 1, 2) g""")
JS = r"""(SELECT *, regexp_extract(message, ' from *([^ ]+)', 1) ip, CASE WHEN starts_with(message, 'Invalid user ') THEN regexp_extract(message, 'Invalid user *([^ ]+)', 1) WHEN contains(message, ' for invalid user ') THEN regexp_extract(message, ' for invalid user *([^ ]+)', 1) ELSE regexp_extract(message, ' for *([^ ]+)', 1) END nm FROM a_journald WHERE lower(coalesce(identifier, comm, '')) = 'sshd') j"""
add("journal_ssh", ["journald"], f"""SELECT f.host_id, 'SSH brute force from ' || f.ip || CASE WHEN o.ip IS NOT NULL THEN ' SUCCEEDED' ELSE '' END || ' (journal)' AS title, CASE WHEN o.ip IS NOT NULL THEN 4 WHEN d > 3 THEN 3 ELSE 2 END AS severity, 'exploitation' AS phase, CASE WHEN o.ip IS NOT NULL THEN 'T1110' WHEN d > 3 THEN 'T1110.003' ELSE 'T1110.001' END AS attack_id, CASE WHEN o.ip IS NOT NULL THEN coalesce(o.ok.t, last) ELSE last END AS ts, {say("SSH refused {f.ip} {n} times, names tried: {d}.{?|o.ok.m}")} AS detail, [file] AS ev
 FROM (SELECT host_id, ip, count(*) n, count(DISTINCT nullif(nm, '')) d, max(timestamp) last, arg_max(source_file, {NEW.format('source_file')}) file FROM {JS} WHERE (starts_with(message, 'Failed ') OR starts_with(message, 'Invalid user ')) AND ip <> '' GROUP BY 1, 2 HAVING count(*) >= 10) f
 LEFT JOIN (SELECT host_id, ip, arg_max(struct_pack(m := message, t := timestamp), {NEW.format('message')}) ok FROM {JS} WHERE starts_with(message, 'Accepted ') AND ip <> '' GROUP BY 1, 2) o ON f.host_id = o.host_id AND f.ip = o.ip
 UNION ALL SELECT host_id, 'Direct root SSH login (journal) from ' || ip, 2, 'exploitation', 'T1021.004', timestamp, message, [source_file] FROM {JS} WHERE starts_with(message, 'Accepted ') AND regexp_extract(message, ' for *([^ ]+)', 1) = 'root'""")
add("sudo_failures", ["journald"], f"""SELECT host_id, 'Repeated sudo authentication failures (journal)' AS title, CASE WHEN count(*) >= 5 THEN 2 END AS severity, 'exploitation' AS phase, 'T1548.003' AS attack_id, max(timestamp) AS ts, {say("sudo refused a password {count(*)} times." + chr(10) + "{arg_min(message, " + OLD.format('message') + ")}")} AS detail, [arg_max(source_file, {NEW.format('source_file')})] AS ev
 FROM a_journald WHERE lower(coalesce(identifier, comm)) = 'sudo' AND (contains(message, 'authentication failure') OR contains(message, 'incorrect password')) GROUP BY host_id""")
AU = """(SELECT a.*, u.n an, v.n un FROM a_audit a LEFT JOIN (SELECT host_id, uid, min(name) n FROM a_linux_users GROUP BY 1, 2) u ON a.host_id = u.host_id AND a.auid = u.uid LEFT JOIN (SELECT host_id, uid, min(name) n FROM a_linux_users GROUP BY 1, 2) v ON a.host_id = v.host_id AND a.uid = v.uid) r"""
BY = "CASE WHEN auid IS NOT NULL THEN ' by auid ' || coalesce(an, auid || '') END"
STG = any_("coalesce(exe, path, '')", l.EXEC_STAGING)
add("audit_exec", ["audit", "linux_users"], f"""SELECT host_id, CASE WHEN {STG} THEN 'Execution from staging path (audit): ' || coalesce(comm, '?') ELSE 'Shell/interpreter under service account ' || coalesce(an, un, '') || ' (audit)' END AS title, 3 AS severity, 'exploitation' AS phase, 'T1059.004' AS attack_id, timestamp AS ts, {say("The audit log shows the start of {coalesce(command_line, exe, '?')}{" + BY + "}.")} AS detail, [source_file] AS ev FROM {AU}
 WHERE (record_type = 'EXECVE' OR syscall IN ('execve', 'execveat')) AND ({STG} OR ((coalesce(an, un, '') IN {in_(l.SERVICE_RUNNERS)} OR lower(coalesce(comm, '')) IN {in_(l.SERVICE_RUNNERS)}) AND {any_("lower(coalesce(command_line, exe, ''))", l.INTERPRETERS)}))""")
add("audit_account_change", ["audit", "linux_users"], f"""SELECT host_id, 'Account/group change (audit): ' || coalesce(account, '?') AS title, CASE WHEN auid IS NULL THEN 3 ELSE 2 END AS severity, 'installation' AS phase, 'T1136.001' AS attack_id, timestamp AS ts,
 {say("auditd {record_type} for {coalesce(account, '?')}{coalesce(" + BY + ", ' by a non-interactive context (auid unset)')}.")} AS detail, [source_file] AS ev FROM {AU} WHERE (starts_with(record_type, 'ADD_USER') OR record_type IN ('ADD_GROUP', 'USER_MGMT') OR starts_with(record_type, 'GRP_')) AND coalesce(result, '') <> 'failed'""")
add("audit_auth_burst", ["audit"], f"""SELECT host_id, 'Local PAM auth-failure burst (audit) on ' || term AS title, CASE WHEN n < 10 THEN NULL WHEN d > 3 THEN 3 ELSE 2 END AS severity, 'exploitation' AS phase, CASE WHEN d > 3 THEN 'T1110.003' ELSE 'T1110.001' END AS attack_id, last AS ts, {say("On {term} authentication failed {n} times for {d} accounts.")} AS detail, [file] AS ev
 FROM (SELECT host_id, coalesce(tty, source_ip, 'local') term, count(*) n, count(DISTINCT account) d, max(timestamp) AS last, arg_max(source_file, {NEW.format('source_file')}) file FROM a_audit WHERE record_type IN ('USER_AUTH', 'USER_ACCT') AND result = 'failed' AND coalesce(comm, '') <> 'sshd' AND NOT contains(coalesce(exe, ''), 'sshd') GROUP BY 1, 2) g""")
SUMM = "coalesce(command_line, exe, record_type || ': ' || account || coalesce(' (' || result || ')', ''), record_type)"
add("audit_sensitive", ["audit", "linux_users"], f"""SELECT host_id, 'Sensitive file modified (audit): ' || path AS title, CASE WHEN auid IS NULL THEN 3 ELSE 2 END AS severity, 'installation' AS phase, CASE WHEN contains(path, 'authorized_keys') THEN 'T1098.004' WHEN contains(path, 'sudoers') THEN 'T1548.003' ELSE 'T1565.001' END AS attack_id, timestamp AS ts, {say("The audit log shows a change of {path}{" + BY + "}{' (rule key: ' || key || ')'}.")} AS detail, [source_file] AS ev
 FROM {AU} WHERE (key IS NOT NULL OR record_type = 'SYSCALL') AND {any_('path', l.SENSITIVE_FILES)} AND (syscall IS NULL OR syscall IN {in_(l.WRITE_CALLS)}) AND coalesce(success, true)
 UNION ALL SELECT host_id, 'SELinux execmem/execstack denial (audit)', 2, 'exploitation', 'T1211', timestamp, {SUMM}, [source_file] FROM a_audit WHERE record_type IN ('AVC', 'USER_AVC') AND {any_(f'lower({SUMM})', ['execmem', 'execstack', 'execheap'])}""")
add("usb_storage", ["syslog"], f"""SELECT host_id, 'USB storage device attached' AS title, 0 AS severity, 'delivery' AS phase, 'T1091' AS attack_id, last AS ts, {say("A removable disk was plugged in (kernel lines: {n})." + chr(10) + "{f.m}")} AS detail, [f.s] AS ev FROM (SELECT host_id, count(*) n, max(timestamp) AS last,
 arg_min(struct_pack(m := message, s := source_file), struct_pack(a := category <> 'massStorage', b := timestamp IS NULL, c := coalesce(timestamp, TIMESTAMP '1970-01-01'), d := message)) f FROM a_syslog WHERE category IN ('massStorage', 'usbDevice') GROUP BY host_id) g""")
add("segfaults", ["syslog"], rf"""SELECT host_id, 'Segfault' || CASE WHEN n > 1 THEN ' burst (' || n || ')' ELSE '' END || ' on ' || c AS title, CASE WHEN {any_('c', l.NETWORK_DAEMONS)} THEN 2 WHEN n >= 3 THEN 1 END AS severity, 'exploitation' AS phase, 'T1203' AS attack_id, last AS ts, {say("The kernel stopped {c} for a memory fault." + chr(10) + "{f.m}")} AS detail, [f.s] AS ev
 FROM (SELECT host_id, c, count(*) n, max(timestamp) AS last, arg_min(struct_pack(m := message, s := source_file), {OLD.format('message')}) f FROM (SELECT *, lower(regexp_extract(message, '^\[*([^\[]+)', 1)) c FROM a_syslog WHERE category = 'segfault') a GROUP BY 1, 2) g""")
add("crash_loops", ["syslog", "linux_persistence"], f"""SELECT s.host_id, 'Service crash loop: ' || un AS title, CASE WHEN n < 3 THEN NULL WHEN un <> '' AND NOT EXISTS (SELECT 1 FROM a_linux_persistence p WHERE p.host_id = s.host_id AND p.unit_name = un) AND NOT starts_with(un, 'systemd') AND NOT starts_with(un, 'network') THEN 3 ELSE 2 END AS severity, 'installation' AS phase, 'T1543.002' AS attack_id, last AS ts, {say("systemd started {un} again {n} times.")} AS detail, [file] AS ev
 FROM (SELECT host_id, coalesce(unit, message) un, count(*) n, max(timestamp) last, arg_min(source_file, {OLD.format('source_file')}) file FROM a_syslog WHERE category = 'crashLoop' GROUP BY 1, 2) s""")
simple("suspicious_cron", "syslog", detail=say("Cron ran: {coalesce(command, message)}"), where=f"category = 'cronExec' AND {any_('lower(coalesce(command, message))', l.CRON_TELLS)}", title="'Suspicious cron execution' || coalesce(' (' || \"user\" || ')', '')", severity="3", phase="'exploitation'", attack="'T1053.003'", ts="timestamp")
PUB = r"(regexp_matches(host, '^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$') AND NOT regexp_matches(host, '^(0|10|127)\.|^192\.168\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.'))"
add("last_login", ["lastlog", "linux_users", "linux_groups"], f"""SELECT host_id, CASE WHEN svc THEN 'Service account login recorded: ' || coalesce(u, 'uid ' || uid) ELSE 'Privileged login from external host: ' || u END AS title, CASE WHEN svc THEN 3 WHEN (u = 'root' OR priv) AND {PUB} THEN 2 END AS severity, 'exploitation' AS phase, CASE WHEN svc THEN 'T1078.003' ELSE 'T1078' END AS attack_id, timestamp AS ts, {say("{coalesce(u, 'uid ' || uid)} (uid {uid}) last logged in on {line}{CASE WHEN host <> '' THEN ' from ' || host END}.")} AS detail, [source_file] AS ev FROM
 (SELECT a.host_id, a."user" u, a.uid, a.host, a.timestamp, a.line, a.source_file, (coalesce(a."user" IN {in_(l.SERVICE_NAMES)}, false) OR coalesce(s.shell LIKE '%nologin' OR s.shell LIKE '%/false', false) OR (a."user" IS NULL AND a.uid < 1000 AND a.uid <> 0)) svc, EXISTS (SELECT 1 FROM a_linux_groups g WHERE g.host_id = a.host_id AND g.name IN {in_(l.PRIVILEGED_GROUPS)} AND list_contains(split(g.members, ','), a."user")) priv
  FROM a_lastlog a LEFT JOIN (SELECT host_id, name, arg_min(shell, struct_pack(a := uid, b := shell)) shell FROM a_linux_users GROUP BY 1, 2) s ON a.host_id = s.host_id AND a."user" = s.name) r""")
TGT = first_("cmd", l.LOG_TARGETS)
SEG = "len(list_filter(regexp_split_to_array(cmd, '&&|\\|\\||;|\\||&'), lambda s: contains(s, tgt) AND (contains(s, 'rm ') OR contains(s, 'shred ')))) > 0"
CLR = f"({SEG} OR contains(cmd, '> ' || tgt) OR contains(cmd, '>' || tgt) OR {any_('cmd', ['truncate -s 0', 'truncate --size=0', 'cp /dev/null', 'cat /dev/null >'])})"
HR = case_([(f"{any_('cmd', a)} AND {all_('cmd', n)}", q(t)) for a, n, t, s, k in l.HISTORY_RULES])
HS = case_([(f"{any_('cmd', a)} AND {all_('cmd', n)}", s) for a, n, t, s, k in l.HISTORY_RULES])
AT = case_([(any_("cmd", a), q(t)) for a, t, k in l.AUDIT_TAMPER])
AK = case_([(any_("cmd", a), q(k)) for a, t, k in l.AUDIT_TAMPER])
TS = first_("cmd", l.TOUCH_STAGING)
add("anti_forensics", ["shell_history", "audit", "syslog", "journald"], f"""SELECT host_id, title, sev AS severity, 'exploitation' AS phase, a AS attack_id, e.t AS ts, {say("{e.c}:" + chr(10) + "{cmd}")} AS detail, [e.f] AS ev FROM
 (SELECT host_id, sc, cmd, title, sev, a, arg_min(struct_pack(t := timestamp, f := source_file, c := context), struct_pack(a := timestamp IS NULL, b := coalesce(timestamp, TIMESTAMP '1970-01-01'), c := source_file, d := context)) e FROM h GROUP BY host_id, sc, cmd, title, sev, a) g""", f""",
 c AS (SELECT *, {TGT} tgt FROM (SELECT host_id, 'shell' sc, lower(command) cmd, "user" u, concat("user", chr(39), 's ', shell, ' history') context, timestamp, source_file FROM a_shell_history
 UNION ALL SELECT host_id, 'audit', lower(command_line), NULL, 'auditd EXECVE' || coalesce(' (auid ' || auid || ')', ''), timestamp, source_file FROM a_audit WHERE command_line <> ''
 UNION ALL SELECT host_id, 'log', lower(coalesce(command, message)), NULL, concat('syslog (', process, ')'), timestamp, source_file FROM a_syslog UNION ALL SELECT host_id, 'log', lower(message), NULL, 'journald', timestamp, source_file FROM a_journald) u WHERE cmd <> ''),
 h AS (SELECT *, {HR} || ' (' || u || ')' title, {HS} sev, 'T1070.003' a FROM c WHERE sc = 'shell' AND {HR} IS NOT NULL
 UNION ALL SELECT *, 'systemd journal cleared', 3, 'T1070.002' FROM c WHERE {any_('cmd', l.JOURNAL_WIPES)}
 UNION ALL SELECT *, 'System log ' || CASE WHEN {SEG} THEN 'deleted' ELSE 'truncated' END || ': ' || tgt, 3, 'T1070.002' FROM c WHERE NOT {any_('cmd', l.JOURNAL_WIPES)} AND tgt IS NOT NULL AND {CLR}
 UNION ALL SELECT *, {AT}, 2, {AK} FROM c WHERE {AT} IS NOT NULL
 UNION ALL SELECT *, 'File timestomping via touch' || coalesce(' in ' || trim({TS}, '/'), ''), CASE WHEN {TS} IS NULL THEN 2 ELSE 3 END, 'T1070.006' FROM c WHERE sc <> 'log' AND contains(cmd, 'touch ') AND {any_('cmd', l.TOUCH_FLAGS)})""")

# ---- macOS ------------------------------------------------------------------------------------
EXE = "coalesce(nullif(program, ''), split(program_arguments, ',')[1])"
SYS = lambda c: f"(NOT contains({c}, '/users/') AND {any_(c, m.SYSTEM_ROOTS)})"
STR = f"""((low <> '' AND {any_('low', m.LAUNCH_STAGING)}) OR (run_at_load AND {LEAF.format('low')} IN {in_(m.LAUNCH_TOOLS)}) OR (lower({LEAF.format("split(program_arguments, ',')[1]")}) IN {in_(m.SHELL_NAMES)} AND list_contains(split(program_arguments, ',')[2:], '-c')) OR (starts_with(lower(label), 'com.apple.') AND NOT {SYS('lower(plist_path)')} AND NOT {SYS('low')}))"""
LABEL = case_([(f'scope = {q(k)}', q(v[0])) for k, v in m.LAUNCH_SCOPES.items()])
LSTR = f"""CASE WHEN low <> '' AND {any_('low', m.LAUNCH_STAGING)} THEN 'program in an unusual place (' || {EXE} || ')' END, CASE WHEN run_at_load AND {LEAF.format('low')} IN {in_(m.LAUNCH_TOOLS)} THEN 'starts ' || {LEAF.format('low')} || ' as soon as it is loaded' END,
 CASE WHEN lower({LEAF.format("split(program_arguments, ',')[1]")}) IN {in_(m.SHELL_NAMES)} AND list_contains(split(program_arguments, ',')[2:], '-c') THEN 'hands a command line to a shell' END,
 CASE WHEN starts_with(lower(label), 'com.apple.') AND NOT {SYS('lower(plist_path)')} AND NOT {SYS('low')} THEN 'named like a part of the system (' || label || ') but kept elsewhere' END, CASE WHEN start_interval BETWEEN 1 AND 300 THEN 'starts again every ' || start_interval || ' s' END"""
simple("launch_items", "launch_items", detail=say("{" + LABEL + "} — {concat_ws('; ', " + LSTR + ")}.\n{CASE WHEN program_arguments IS NOT NULL THEN replace(program_arguments, ',', ' ') ELSE program END}"), ev="[plist_path]", src=f"(SELECT *, lower(coalesce({EXE}, '')) low FROM a_launch_items) r", title=f"{case_([(f'scope = {q(k)}', q(v[0])) for k, v in m.LAUNCH_SCOPES.items()])} || ' persistence: ' || label", severity=case_([(STR, 3), ("start_interval BETWEEN 1 AND 300", 2)]), phase="'installation'", attack=case_([(f"scope = {q(k)}", q(v[1])) for k, v in m.LAUNCH_SCOPES.items()]))
PT = f"coalesce(nullif(name, ''), CASE WHEN schedule IS NOT NULL THEN CASE WHEN regexp_extract(command, '^ *([^ ]+)', 1) = '' THEN schedule ELSE schedule || '  ' || regexp_extract(command, '^ *([^ ]+)', 1) END END, nullif(command, ''), {LEAF.format('source_file')})"
CRN = f"(lower(coalesce(schedule, '')) = '@reboot' OR {any_('lower(command)', m.SWEEP_STAGING)} OR len(list_filter(regexp_split_to_array(lower(command), '[ /]+'), lambda s: s IN {in_(m.SWEEP_TOOLS)})) > 0)"
simple("persistence_sweep", "mac_persistence", detail=say("{?Schedule: |schedule}{?User: |\"user\"}\nCommand: {command}"), title=f"CASE WHEN kind = 'emond' THEN 'emond persistence rule: ' || {PT} WHEN kind = 'loginHook' THEN 'macOS login hook: ' || command WHEN kind = 'logoutHook' THEN 'macOS logout hook: ' || command WHEN kind = 'cron' THEN 'Suspicious cron job: ' || {PT} WHEN kind = 'periodic' THEN 'Custom periodic script: ' || {PT} ELSE 'macOS rc.local boot script' END",
       severity=case_([(f"kind IN ('emond', 'loginHook', 'logoutHook') OR (kind = 'cron' AND {CRN}) OR (kind = 'rcScript' AND lower(name) = 'rc.local')", 3), ("kind = 'periodic'", 2)]), phase="'installation'", attack="CASE WHEN kind = 'emond' THEN 'T1546.014' WHEN kind IN ('loginHook', 'logoutHook') THEN 'T1037.002' WHEN kind = 'cron' THEN 'T1053.003' WHEN kind = 'periodic' THEN 'T1053' ELSE 'T1037.004' END")
QL = r"regexp_extract(regexp_extract(data_url, '^[^?#]*'), '^[a-z]+://[^/]+/(?:.*/)?([^/]+)/*$', 1)"
QX = f"lower(regexp_extract(coalesce(nullif({QL}, ''), {LEAF.format(chr(114) + 'egexp_extract(coalesce(data_url, ' + q('') + '), ' + q('^[^?]*') + ')')}), '^.+\\.([^.]+)$', 1))"
TLD = lambda c: "(" + " OR ".join(f"ends_with({c}, {q(t)})" for t in m.QUARANTINE_TLDS) + ")"
QB = lambda c: f"coalesce({IP4.format(c)} OR {any_(c, m.QUARANTINE_HOSTS)} OR {TLD(c)}, false)"
BOTH = lambda f: f"(coalesce({f('dh')}, false) OR coalesce({f('oh')}, false))"
RAW, SHADY, TLDS = BOTH(IP4.format), BOTH(lambda c: any_(c, m.QUARANTINE_HOSTS)), BOTH(TLD)
QOLD = "struct_pack(a := timestamp IS NULL, b := coalesce(timestamp, TIMESTAMP '1970-01-01'), c := data_url, d := origin_url)"
add("quarantine_origin", ["quarantine"], f"""SELECT host_id, 'Risky quarantined download from suspicious origin: ' || h AS title, 3 AS severity, 'delivery' AS phase, 'T1105' AS attack_id, last AS ts,
 {say("Downloaded a .{upper(e.x)} file from {h} — {concat_ws(', ', CASE WHEN shady THEN 'a sharing or tunnel service' END, CASE WHEN raw THEN 'raw IP address' END, CASE WHEN tld THEN 'suspicious top-level domain' END)}.{?File: |d}{?Referrer: |o}{CASE WHEN n > 1 THEN chr(10) || 'Seen ' || n || ' times.' END}")} AS detail, [d, o, e.s] AS ev FROM
 (SELECT host_id, h, count(*) n, max(timestamp) AS last, bool_or({RAW}) raw, bool_or({SHADY}) shady, bool_or({TLDS}) tld, arg_min(data_url, CASE WHEN data_url <> '' THEN {QOLD} END) d, arg_min(origin_url, CASE WHEN origin_url <> '' THEN {QOLD} END) o, arg_max(struct_pack(s := source_file, x := ext), {NEW.format('data_url')}) e
  FROM (SELECT *, coalesce(dh, oh) h FROM (SELECT *, {HOST.format('data_url')} dh, {HOST.format('origin_url')} oh, {QX} ext FROM a_quarantine) a) b WHERE h IS NOT NULL AND ext IN {in_(m.QUARANTINE_EXTENSIONS)} AND ({QB('dh')} OR {QB('oh')}) GROUP BY 1, 2) g""")
AG = case_([(f"low = {q(t)} OR regexp_matches(low, '(^|[ /]){t}([0-9.\\-][^ /]*)?$') OR regexp_matches(low, '^[ /]*{t}([0-9.\\-][^ /]*)?([ /]|$)')", q(t)) for t in m.TOOL_AGENTS])
QS = "coalesce(data_url, origin_url, '')"
add("quarantine_agent", ["quarantine"], f"""SELECT host_id, 'Quarantined download by non-browser agent: ' || e.a AS title, 3 AS severity, 'delivery' AS phase, 'T1204' AS attack_id, last AS ts, {say("Downloaded by '{e.a}'.{?Example: |sample}{CASE WHEN n > 1 THEN chr(10) || 'Seen ' || n || ' times.' END}")} AS detail, [sample, e.s] AS ev FROM
 (SELECT host_id, tok, count(*) n, max(timestamp) AS last, arg_min({QS}, CASE WHEN {QS} <> '' THEN {QOLD} END) sample, arg_max(struct_pack(a := agent_name, s := source_file), {NEW.format('agent_name')}) e FROM (SELECT *, {AG} tok FROM (SELECT *, lower(agent_name) low FROM a_quarantine WHERE agent_name <> '') a WHERE NOT {any_('low', m.BROWSER_AGENTS)}) b WHERE tok IS NOT NULL GROUP BY 1, 2) g""")
FSP = f"regexp_matches({LEAF.format('low')}, '^.+\\.({'|'.join(m.FS_PAYLOADS)})$')"
def fs_rollup(name, label, severity, phase, attack, where):
    pick = "list(struct_pack(p := path, s := source_file) ORDER BY event_id, path, source_file)[1:8]"
    add(name, ["fsevents"], f"""SELECT host_id, '{label} (' || n || ')' AS title, {severity} AS severity, '{phase}' AS phase, '{attack}' AS attack_id, NULL AS ts,
 {say("{n} path(s):" + chr(10) + "{array_to_string(list_transform(few, lambda x: x.p), chr(10))}{CASE WHEN n > 8 THEN chr(10) || '…and ' || (n - 8) || ' more.' END}")} AS detail, list_transform(few, lambda x: x.s) AS ev FROM (SELECT host_id, count(*) n, {pick} few FROM (SELECT *, '/' || lower(path) low FROM a_fsevents) a WHERE {where} GROUP BY host_id) g""")


fs_rollup("fs_create_remove", "FSEvents: files created then deleted", 3, "actionsOnObjectives", "T1070.004", f"(flags & 16777216) <> 0 AND (flags & 33554432) <> 0 AND ({any_('low', m.FS_STAGING)} OR {FSP})")
fs_rollup("fs_launchd_write", "FSEvents: launchd persistence write", 2, "installation", "T1543", f"(flags & {0x01000000 | 0x08000000 | 0x10000000}) <> 0 AND {any_('low', m.LAUNCHD_FOLDERS)} AND ends_with(low, '.plist')")
P = "lower(coalesce(process, ''))"
LM = "lower(message)"
SAMPLE = f"arg_min(message, CASE WHEN message <> '' THEN {OLD.format('message')} END)"
SSHF = f"{P} = 'sshd' AND (starts_with(message, 'Failed password') OR starts_with(message, 'Invalid user') OR contains({LM}, 'authentication failure') OR contains({LM}, 'failed keyboard-interactive'))"
CMD = "trim(split_part(message, 'COMMAND=', 2))"
add("unified_log", ["unified_log"], f"""SELECT host_id, 'AppleScript / osascript execution' AS title, 2 AS severity, 'exploitation' AS phase, 'T1059.002' AS attack_id, max(timestamp) AS ts, {SAMPLE} AS detail, ['unified log'] AS ev FROM a_unified_log WHERE {P} = 'osascript' OR contains({LM}, 'osascript') GROUP BY host_id
 UNION ALL SELECT host_id, CASE WHEN n >= 5 THEN 'SSH brute-force burst — ' || n || ' failed logins' ELSE 'SSH authentication failures — ' || n END, CASE WHEN n >= 5 THEN 3 ELSE 2 END, 'exploitation', 'T1110.001', last, {say("{sample}{?Source(s): |array_to_string(ips[1:8], ', ')}")}, ['unified log'] FROM (SELECT host_id, count(*) n, max(timestamp) AS last, {SAMPLE} sample, list_sort(list(DISTINCT ip) FILTER (ip <> '')) ips FROM (SELECT *, regexp_extract(message, ' from ([^ ]+)', 1) ip FROM a_unified_log) a WHERE {SSHF} GROUP BY host_id) g
 UNION ALL SELECT host_id, 'Screen Sharing / VNC session authenticated', 3, 'exploitation', 'T1021.001', max(timestamp), {SAMPLE}, ['unified log'] FROM a_unified_log WHERE ({P} IN ('screensharingd', 'screensharingagent') OR contains({P}, 'ardagent')) AND contains({LM}, 'authentication') AND (contains({LM}, 'succeed') OR contains({LM}, 'success')) GROUP BY host_id
 UNION ALL SELECT host_id, 'Local account created — ' || count(*) || ' event(s)', 3, 'installation', 'T1136.001', max(timestamp), {SAMPLE}, ['unified log'] FROM a_unified_log WHERE ({P} = 'sysadminctl' AND contains({LM}, 'adduser')) OR ({P} = 'dscl' AND contains({LM}, 'create') AND contains(message, '/Users/')) OR contains({LM}, 'created user account') GROUP BY host_id
 UNION ALL SELECT host_id, 'SSH login accepted (unified log)', 2, 'exploitation', 'T1021.004', timestamp, message, [source_file] FROM a_unified_log WHERE {P} = 'sshd' AND starts_with(message, 'Accepted ')
 UNION ALL SELECT host_id, 'sudo privilege escalation — ' || len(cmds) || ' command(s)', 2, 'exploitation', 'T1548.003', last, {say("sudo ran, among others: {array_to_string(cmds[1:8], ', ')}{CASE WHEN len(cmds) > 8 THEN ' …' END}" + chr(10) * 2 + "Example: {sample}")}, ['unified log'] FROM
  (SELECT host_id, list_sort(list(DISTINCT {CMD}) FILTER ({CMD} <> '')) cmds, max(timestamp) AS last, arg_min(message, {OLD.format('message')}) sample FROM a_unified_log WHERE {P} = 'sudo' AND contains(message, 'COMMAND=') GROUP BY host_id) g""")
APL = "CASE WHEN client_type = 0 THEN starts_with(client, 'com.apple.') ELSE regexp_matches(lower(client), '^/(system|usr/libexec|usr/sbin|usr/bin)/') END"
SL = case_([(f"service = {q(k)}", q(v)) for k, v in m.SERVICE_LABELS.items()])
add("privacy_grants", ["tcc"], f"SELECT host_id, {SL} || ' granted to non-Apple app: ' || CASE WHEN min(client_type) = 1 THEN {LEAF.format('client')} ELSE client END AS title, 3 AS severity, {case_([(f'service = {q(k)}', q(v[1])) for k, v in m.SENSITIVE_SERVICES.items()])} AS phase, {case_([(f'service = {q(k)}', q(v[0])) for k, v in m.SENSITIVE_SERVICES.items()])} AS attack_id, min(last_modified) AS ts, {say('{client} may use {' + SL + '} (privacy database: {scope}).')} AS detail, [arg_min(source_file, struct_pack(a := last_modified IS NULL, b := coalesce(last_modified, TIMESTAMP '1970-01-01'), c := source_file))] AS ev FROM a_tcc WHERE service IN {in_(m.SENSITIVE_SERVICES)} AND auth_value = 2 AND NOT ({APL}) GROUP BY host_id, service, client, scope")
add("remote_app_use", ["knowledge"], f"SELECT host_id, 'Remote-access app in active use: ' || lower(value) AS title, 3 AS severity, 'commandAndControl' AS phase, 'T1219' AS attack_id, max(start_date) AS ts, {say("{lower(value)} was used {count(*)} times{' between ' || " + iso('min(start_date)') + " || ' and ' || " + iso('max(start_date)') + "}.")} AS detail, ['knowledgeC.db'] AS ev FROM a_knowledge WHERE stream IN ('/app/inFocus', '/app/usage', '/app/activity') AND {any_('lower(value)', m.REMOTE_HINTS)} GROUP BY host_id, lower(value)")
STB = "coalesce(lower(nullif(path, '')), 'sig:' || lower(nullif(signature, '')))"
OFP = f"arg_min(path, CASE WHEN path IS NOT NULL THEN {OLD.format('path')} END)"
OFS = f"arg_min(signature, CASE WHEN signature IS NOT NULL THEN {OLD.format('signature')} END)"
KN = lambda c: case_([(f"{c} = {q(k)}", q(v)) for k, v in m.SECURITY_KINDS.items()])
SE = f"(SELECT *, {STB} st, coalesce({STB}, 'msg:' || lower(message)) k FROM a_security_events) s"
add("security_malware", ["security_events"], f"SELECT host_id, {KN('kd')} || ' malware ' || CASE WHEN rem THEN 'remediation' ELSE 'detection' END || ': ' || coalesce(sg, p, k) AS title, 3 AS severity, 'installation' AS phase, 'T1204.002' AS attack_id, last AS ts, {say("{" + KN('kd') + "} {CASE WHEN rem AND det THEN 'detected and remediated' WHEN rem THEN 'remediated' ELSE 'detected' END}: {coalesce(sg, p, k)}.{CASE WHEN n > 1 THEN chr(10) || 'Seen ' || n || ' times.' END}")} AS detail, list_prepend(p, files) AS ev FROM (SELECT host_id, k, count(*) n, list_sort(list(DISTINCT source_file)) files, arg_max(kind, {NEW.format('kind')}) kd, bool_or(severity = 'detected') det, bool_or(severity = 'remediated') rem, {OFP} p, {OFS} sg, max(timestamp) last FROM {SE} WHERE severity IN ('detected', 'remediated') GROUP BY 1, 2) g")
OV = f"(SELECT host_id, st, list_sort(list(DISTINCT source_file)) files, {OFP} p, {OFS} sg, min(CASE WHEN severity IN ('blocked', 'detected') THEN timestamp END) fb, max(CASE WHEN severity = 'allowed' THEN timestamp END) la FROM {SE} WHERE st IS NOT NULL GROUP BY 1, 2 HAVING bool_or(severity IN ('blocked', 'detected')) AND bool_or(severity = 'allowed') AND NOT coalesce(max(CASE WHEN severity = 'allowed' THEN timestamp END) < min(CASE WHEN severity IN ('blocked', 'detected') THEN timestamp END), false)) o"
add("security_override", ["security_events"], f"SELECT host_id, 'Trust control overridden after block: ' || coalesce(sg, p, st) AS title, 3 AS severity, 'exploitation' AS phase, 'T1553.001' AS attack_id, coalesce(la, fb) AS ts, {say('{coalesce(sg, p, st)} ran after all, though it had been stopped before.{?Allowed at: |@la}')} AS detail, list_prepend(p, files) AS ev FROM {OV}")
add("security_disabled", ["security_events"], f"SELECT host_id, 'macOS security control disabled' AS title, 3 AS severity, 'exploitation' AS phase, 'T1562.001' AS attack_id, max(timestamp) AS ts, {say('Protection was switched off, going by this line: {arg_min(message, ' + OLD.format('message') + ')}')} AS detail, [arg_max(source_file, {NEW.format('source_file')})] AS ev FROM a_security_events WHERE {any_('lower(message)', m.DISABLE_HINTS)} GROUP BY host_id, coalesce(process, source_file)")
add("security_blocks", ["security_events"], f"SELECT host_id, CASE WHEN n >= 5 THEN 'Repeated macOS policy failures: ' ELSE 'macOS policy blocked untrusted binary: ' END || coalesce(p, sg, k) AS title, CASE WHEN n >= 5 THEN 3 ELSE 2 END AS severity, 'exploitation' AS phase, 'T1553.001' AS attack_id, last AS ts, {say("{" + KN('kd') + "} kept a program from running: {coalesce(p, sg, k)}.{CASE WHEN n > 1 THEN chr(10) || 'Failed assessment ' || n || ' times.' END}")} AS detail, list_prepend(p, files) AS ev FROM (SELECT host_id, k, arg_max(kind, {NEW.format('kind')}) kd, list_sort(list(DISTINCT source_file)) files, count(*) n, {OFP} p, {OFS} sg, max(timestamp) last FROM {SE} WHERE kind IN ('gatekeeper', 'syspolicyd') AND severity IN ('blocked', 'warning') AND (host_id, k) NOT IN (SELECT (host_id, st) FROM {OV}) GROUP BY 1, 2) g")
RSC = "lower(regexp_extract(value, '^([^:]*)://', 1))"
RH = f"CASE WHEN contains(value, '://') THEN CASE WHEN {RSC} IN {in_(m.REMOTE_SCHEMES)} THEN {HOST.format('value')} END WHEN kind IN ('servers', 'hosts') AND value <> '' AND NOT contains(value, ' ') AND contains(value, '.') THEN lower(value) END"
RL = case_([(f"NOT contains(value, '://')", q("remote host"))] + [(f"{RSC} = {q(k)}", q(v[1])) for k, v in m.REMOTE_SCHEMES.items()])
RA = case_([(f"NOT contains(value, '://')", q("T1021"))] + [(f"{RSC} = {q(k)}", q(v[0])) for k, v in m.REMOTE_SCHEMES.items()])
add("recent_servers", ["recent_items"], f"SELECT host_id, 'Recent connection to ' || r.l || ': ' || h AS title, CASE WHEN {IP4.format('h')} THEN 3 ELSE 2 END AS severity, 'exploitation' AS phase, r.a AS attack_id, last AS ts, {say("Recent connection to the {r.l} {h}{CASE WHEN n > 1 THEN ' (' || n || ' entries)' END}." + chr(10) + "Example: {sample}")} AS detail, files AS ev FROM (SELECT host_id, h, count(*) n, arg_min(value, {OLD.format('value')}) sample, list_sort(list(DISTINCT source_file)) files, max(timestamp) last, arg_max(struct_pack(l := lab, a := att), {NEW.format('value')}) r FROM (SELECT *, {RH} h, {RL} lab, {RA} att FROM a_recent_items) a WHERE h IS NOT NULL GROUP BY 1, 2) g")
RP = "lower(CASE WHEN starts_with(lower(value), 'file://') THEN replace(substr(value, 8), '%20', ' ') WHEN NOT contains(value, '://') AND (starts_with(value, '/') OR starts_with(value, '~/')) THEN value END)"
RX = case_([(f"ends_with(p, {q(e)})", q(e)) for e in m.RECENT_EXTENSIONS])
add("recent_paths", ["recent_items"], f"""SELECT host_id, 'Recent item in suspicious location: ' || {LEAF.format('p')} AS title, 2 AS severity, 'exploitation' AS phase, 'T1204.002' AS attack_id, last AS ts,
 {say("{" + case_([(f"kd = {q(k)}", q(v)) for k, v in m.RECENT_LABELS.items()]) + "} entry points to {p} — {concat_ws(', ', 'risky extension (' || " + RX + " || ')', 'staging path (' || " + first_("p", m.RECENT_STAGING) + " || ')')}.")} AS detail, list_prepend(p, files) AS ev FROM
 (SELECT host_id, p, max(timestamp) AS last, arg_max(kind, {NEW.format('kind')}) kd, list_sort(list(DISTINCT source_file)) files FROM (SELECT *, {RP} p FROM a_recent_items) a WHERE {any_('p', m.RECENT_STAGING)} OR {RX} IS NOT NULL GROUP BY 1, 2) g""")
add("third_party_extensions", ["kexts"], f"""SELECT host_id, CASE WHEN e.k = 'kext' THEN 'Third-party kernel extension: ' ELSE 'Third-party system extension: ' END || CASE WHEN e.n = '' THEN bundle_id ELSE e.n END AS title, CASE WHEN e.k = 'kext' THEN 3 ELSE 2 END AS severity, 'installation' AS phase, 'T1547.006' AS attack_id, NULL AS ts,
 {say("{bundle_id}{?Path: |p}")} AS detail, [p, e.s] AS ev FROM (SELECT host_id, bundle_id, coalesce(path, '') p, arg_min(struct_pack(k := kind, n := name, s := source_file), struct_pack(a := source_file, b := kind, c := name)) e FROM a_kexts WHERE NOT starts_with(lower(bundle_id), 'com.apple.') GROUP BY 1, 2, 3) g""")
BS = any_("lower(x)", m.BACKGROUND_STAGING)
add("background_items", ["background_items"], f"""SELECT host_id, CASE WHEN x <> '' AND {BS} THEN 'Background item from staging path: ' ELSE 'Non-Apple background item: ' END || shown AS title, CASE WHEN x <> '' AND {BS} THEN 3 ELSE 2 END AS severity, 'installation' AS phase, 'T1547.015' AS attack_id, NULL AS ts,
 {say("{shown}{?Bundle ID: |e.b}{?Executable: |e.x}{?Developer: |e.d}")} AS detail, [e.x, e.s] AS ev FROM (SELECT *, coalesce(nullif(name, ''), e.b, e.x, 'Background item') shown FROM (
 SELECT host_id, coalesce(bundle_id, '') b, coalesce(executable, '') x, name, arg_min(struct_pack(b := bundle_id, x := executable, d := developer_name, s := source_file), struct_pack(a := source_file, b := scope)) e FROM a_background_items WHERE NOT coalesce(starts_with(lower(bundle_id), 'com.apple.'), false) AND NOT coalesce(lower(developer_name) = 'apple', false) GROUP BY 1, 2, 3, 4) a) g""")
LNK = lambda c, t: f"(SELECT *, regexp_replace(u0, '^[()\\[\\]{{}}.,;!]+|[()\\[\\]{{}}.,;!]+$', '', 'g') url FROM (SELECT *, unnest(regexp_split_to_array({c}, '[ \\n\\t\\r<>\"'']+')) u0 FROM {t}) x)"
LK = lambda c, t: f"(SELECT *, {HOST.format('url')} h FROM {LNK(c, t)} y WHERE regexp_matches(lower(url), '^https?://')) z"
BADL = f"h IS NOT NULL AND ({IP4.format('h')} OR {any_('lower(url)', m.LINK_TOKENS)})"
SHOWM = """concat(CASE WHEN is_from_me THEN 'Sent' ELSE 'Received' END, ' — ', coalesce(nullif(handle, ''), nullif(chat_name, ''), 'unknown'), ': ', CASE WHEN length(replace(text, chr(10), ' ')) > 140 THEN substr(replace(text, chr(10), ' '), 1, 140) || '…' ELSE replace(text, chr(10), ' ') END)"""
add("message_links", ["messages"], f"""SELECT host_id, 'Suspicious link in Messages: ' || h AS title, CASE WHEN raw OR rec THEN 3 ELSE 2 END AS severity, 'delivery' AS phase, CASE WHEN rec THEN 'T1566.002' ELSE 'T1204.001' END AS attack_id, last AS ts,
 {say("{CASE WHEN rec THEN 'Received ' ELSE 'Sent ' END}{n} link(s) to {h}{CASE WHEN raw THEN ' (a raw IP address)' END}." + chr(10) * 2 + "Example: {sample}")} AS detail, files AS ev FROM
 (SELECT host_id, h, count(*) n, {IP4.format('h')} raw, bool_or(NOT is_from_me) rec, max(timestamp) AS last, arg_min({SHOWM}, struct_pack(a := timestamp IS NULL, b := coalesce(timestamp, TIMESTAMP '1970-01-01'), c := {SHOWM})) sample, list_sort(list(DISTINCT source_file)) files FROM {LK('text', 'a_messages')} WHERE {BADL} GROUP BY 1, 2) g""")
ML = "(SELECT *, coalesce(date_received, date_sent) timestamp, concat('from ', coalesce(sender, '?'), ': ', coalesce(nullif(subject, ''), '(no subject)')) shown FROM a_mail WHERE NOT coalesce(contains(lower(mailbox), '/sent') OR ends_with(lower(mailbox), 'sent'), false))"
DOM = r"regexp_replace(lower(trim(regexp_extract(sender, '^.*@(.*)$', 1))), '^\[(.*)\]$', '\1')"
add("inbound_mail", ["mail"], f"""SELECT host_id, 'Suspicious inbound mail: ' || h AS title, CASE WHEN raw THEN 3 ELSE 2 END AS severity, 'delivery' AS phase, 'T1566.002' AS attack_id, last AS ts,
 {say("Mail was received that has to do with {h}: {array_to_string(why, ', ')} ({n} message(s))." + chr(10) * 2 + "Example: {sample}")} AS detail, files AS ev FROM (SELECT host_id, h, count(*) n, bool_or(raw) raw, max(timestamp) AS last, list_sort(list(DISTINCT why)) why, arg_min(shown, {OLD.format('shown')}) sample, list_sort(list(DISTINCT source_file)) files FROM (
 SELECT host_id, h, timestamp, {IP4.format('h')} raw, 'subject line with a doubtful link' why, shown, source_file FROM {LK('subject', ML + ' w')} WHERE {BADL} UNION ALL SELECT host_id, {DOM}, timestamp, true, 'sender given by address only', shown, source_file FROM {ML} v WHERE {IP4.format(DOM)}) u GROUP BY 1, 2) g""")
NH = f"coalesce({HOST.format('identifier')}, identifier)"
simple("backup_targets", "network", detail=f"concat({say('Backups go to {identifier} on the network.')}, CASE WHEN {IP4.format(NH)} THEN ' Only an address is given, no name.' END)", where="kind = 'timeMachine' AND identifier <> ''", title=f"'Time Machine backup to a network destination: ' || {NH}", severity=f"CASE WHEN {IP4.format(NH)} THEN 3 ELSE 2 END", phase="'actionsOnObjectives'", attack="'T1074'", ts="timestamp")
TRX = "(" + " OR ".join(f"ends_with(lower(path), {q(e)})" for e in m.TRASH_EXTENSIONS) + ")"
TP = "arg_min(struct_pack(p := path, s := source_file), struct_pack(a := timestamp IS NULL, b := coalesce(timestamp, TIMESTAMP '1970-01-01'), c := path, d := source_file))"
add("trashed_payloads", ["user_activity"], f"SELECT host_id, 'Trashed payload: ' || {LEAF.format('min(path)')} AS title, 2 AS severity, 'actionsOnObjectives' AS phase, 'T1070.004' AS attack_id, min(timestamp) AS ts, {say('In the Trash: {' + TP + '.p}.')} AS detail, [{TP}.p, {TP}.s] AS ev FROM a_user_activity WHERE kind = 'trash' AND {TRX} GROUP BY host_id, lower(path)")
PO = lambda c: f"coalesce({any_(f'lower({c})', m.MAC_OFFENSIVE)} OR {LEAF.format(f'lower({c})')} IN {in_(m.MAC_OFFENSIVE_NAMES)}, false)"
PR = lambda c: f"coalesce({any_(f'lower({c})', m.REMOTE_HINTS)}, false)"
PS = lambda c: f"coalesce(contains(lower({c}), 'osascript'), false)"
add("powerlog_tools", ["powerlog"], f"""SELECT host_id, CASE WHEN off THEN 'Offensive tool executed (Powerlog): ' || coalesce(pl, k) WHEN rem THEN 'Remote-access app executed (Powerlog): ' || coalesce(pl, k) ELSE 'AppleScript/JXA execution (Powerlog): osascript' END AS title, CASE WHEN off OR rem THEN 3 WHEN scr THEN 2 END AS severity, CASE WHEN rem AND NOT off THEN 'commandAndControl' ELSE 'exploitation' END AS phase, CASE WHEN off THEN 'T1059' WHEN rem THEN 'T1219' ELSE 'T1059.002' END AS attack_id, last AS ts, {say("The power log has {coalesce(pl, k)} {n} times{' between ' || " + iso('first') + " || ' and ' || " + iso('last') + "}.")} AS detail, ['CurrentPowerlog.PLSQL'] AS ev
 FROM (SELECT host_id, coalesce(lower(nullif(bundle_id, '')), lower(process_name)) k, count(*) n, min(date) AS first, bool_or({PO('process_name')} OR {PO('bundle_id')}) off, bool_or({PR('process_name')} OR {PR('bundle_id')}) rem, bool_or({PS('process_name')} OR {PS('bundle_id')}) scr, max(date) last,
  min(least(CASE WHEN NOT contains(process_name, '.') THEN lower(process_name) END, CASE WHEN NOT contains(bundle_id, '.') THEN lower(bundle_id) END)) pl FROM a_powerlog WHERE coalesce(lower(nullif(bundle_id, '')), lower(process_name)) <> '' GROUP BY 1, 2) g""")
simple("configuration_posture", "config", detail="interpretation", ev=f"[{LEAF.format(chr(115) + 'ource_file')}]", where="risk <> 'none'", title="CASE WHEN scope IN ('system', '') THEN '' ELSE '[' || scope || '] ' END || name || ': ' || value", severity="CASE risk WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END", phase=case_([(f"category = {q(k)}", q(v)) for k, v in m.CONFIG_PHASES.items()]), attack="attack_id")
FID = "split(package_identifiers, ',')[1]"
IDN = f"CASE WHEN coalesce({FID}, display_name, '') <> '' THEN coalesce({FID}, display_name) || '|' || coalesce(version, '') ELSE coalesce(CAST(epoch_us(date) // 1000000 AS VARCHAR), '') || '|' || coalesce(version, '') END"
IHY = f"lower(coalesce(display_name, '') || chr(1) || replace(package_identifiers, ',', chr(1)) || chr(1) || coalesce({LEAF.format('package_file')}, ''))"
IBS = f"lower({LEAF.format('process_name')})"
SHW = f"coalesce(nullif(display_name, ''), nullif({FID}, ''), 'install')"
add("installs", ["installs"], f"""SELECT host_id, CASE knd WHEN 'A' THEN 'Package installed by a non-installer process: ' WHEN 'O' THEN 'Offensive tool installed: ' ELSE 'Remote-access tool installed: ' END || r.s AS title, 3 AS severity, CASE WHEN knd = 'R' THEN 'commandAndControl' ELSE 'installation' END AS phase, CASE knd WHEN 'A' THEN 'T1059' WHEN 'O' THEN 'T1588.002' ELSE 'T1219' END AS attack_id, r.d AS ts, {say("'{r.s}' matched '{hit}'.")} AS detail, [{LEAF.format('r.f')}] AS ev FROM
 (SELECT host_id, knd, hit, idn, arg_min(struct_pack(s := shw, d := date, f := source_file), struct_pack(a := date IS NULL, b := coalesce(date, TIMESTAMP '1970-01-01'), c := source_file, d := shw)) r FROM (
  SELECT host_id, date, source_file, {SHW} shw, {IDN} idn, 'A' knd, {IBS} hit FROM a_installs WHERE {IBS} IN {in_(m.ABNORMAL_INSTALLERS)}
  UNION ALL SELECT host_id, date, source_file, {SHW}, {IDN}, 'O', {first_(IHY, m.MAC_OFFENSIVE)} FROM a_installs WHERE {any_(IHY, m.MAC_OFFENSIVE)}
  UNION ALL SELECT host_id, date, source_file, {SHW}, {IDN}, 'R', {first_(IHY, m.REMOTE_HINTS)} FROM a_installs WHERE NOT {any_(IHY, m.MAC_OFFENSIVE)} AND {any_(IHY, m.REMOTE_HINTS)}) u GROUP BY 1, 2, 3, 4) g""")
WU = "split(urls, ',')[1]"
WHH = rf"regexp_extract(regexp_replace(regexp_extract(regexp_replace(lower({WU}), '^.*?://', ''), '^([^/?#]*)', 1), '^.*@', ''), '^([^:]*)', 1)"
SV = case_([(f"h = {q(s)} OR ends_with(h, {q('.' + s)})", q(s)) for s in m.DOWNLOAD_SERVICES])
PV = r"regexp_matches(h, '^(10|127)\.|^169\.254\.|^192\.168\.|^172\.(1[6-9]|2[0-9]|3[01])\.')"
add("download_origins", ["where_froms"], f"""SELECT host_id, CASE WHEN raw THEN 'File downloaded from a raw IP address: ' ELSE 'File downloaded from a paste/anon-share service: ' END || {LEAF.format('path')} AS title, CASE WHEN raw AND NOT priv THEN 3 ELSE 2 END AS severity, 'delivery' AS phase, CASE WHEN raw THEN 'T1105' ELSE 'T1102' END AS attack_id, NULL AS ts,
 {say("'{" + LEAF.format('path') + "}' was downloaded from {url}{CASE WHEN priv THEN ' (an internal/private address)' END}.")} AS detail, [path] AS ev FROM
 (SELECT host_id, path, raw, CASE WHEN raw THEN h ELSE s END k, min({WU}) url, bool_or(raw AND {PV}) priv FROM (SELECT *, {IP4.format('h')} raw, {SV} s FROM (SELECT *, {WHH} h FROM a_where_froms) a) b WHERE raw OR s IS NOT NULL GROUP BY 1, 2, 3, 4) c""")

# ---- Credentials ------------------------------------------------------------------------------
CWHAT = case_([(all_("low", t), q(w_)) for w_, t, a in c.COMMANDS] + [(f"contains(low, {q(t)})", q("tool " + t)) for t in c.TOOLS])
CTECH = case_([(all_("low", t), q(a)) for w_, t, a in c.COMMANDS] + [(f"contains(low, {q(t)})", q(a)) for t, a in c.TOOLS.items()])
TOOL = lambda hay: case_([(f"contains(lower({hay}), {q(t)})", q(t)) for t in c.TOOLS])
TECH = lambda hay: case_([(f"contains(lower({hay}), {q(t)})", q(a)) for t, a in c.TOOLS.items()])


def tools(table: str, where: str, hay: str, shown: str, ts: str, ev: str) -> str:
    return f"""SELECT host_id, {q(f'Credential-dumping tool in {where}: ')} || {TOOL(hay)}, 3, 'exploitation', {TECH(hay)}, {ts}, {say('{' + shown + '}{?Time: |@' + ts + '}')}, {ev} FROM a_{table} WHERE {TOOL(hay)} IS NOT NULL"""


add("credential_dumping", ["events", "shell_history", "prefetch", "amcache", "shimcache", "lnk", "browser_history"], f"""SELECT host_id, 'Credential dumping: ' || {CWHAT} AS title, 4 AS severity, 'exploitation' AS phase, {CTECH} AS attack_id, at1 AS ts, {say("{origin} shows: {line}")} AS detail, [source_file] AS ev FROM (SELECT *, lower(line) low FROM (
  SELECT host_id, written_at at1, source_file, {HAY} line, 'Process on ' || computer origin FROM {PROC} UNION ALL SELECT host_id, timestamp, source_file, command, 'Shell history of ' || "user" FROM a_shell_history) u) v WHERE {CWHAT} IS NOT NULL
 UNION ALL SELECT host_id, 'Credential dumping: LSASS opened by ' || coalesce({base('src')}, '?'), 3, 'exploitation', 'T1003.001', written_at, {say("{src} asked for {mask} on {tgt}, {@written_at}")}, [source_file] FROM {ev(src="SourceImage", tgt="TargetImage", mask="GrantedAccess")} WHERE event_id = 10 AND contains(lower(channel), 'sysmon') AND lower({base('tgt')}) = 'lsass.exe' AND lower(mask) IN {in_(c.LSASS_MASKS)}
 UNION ALL {tools("prefetch", "Prefetch", "executable_name", "coalesce(executable_path, executable_name)", "coalesce(run1, run2)", "[source_file]")}
 UNION ALL {tools("amcache", "Amcache", "concat_ws(' ', name, full_path)", "full_path", "registered_at", "[full_path]")}
 UNION ALL {tools("shimcache", "Shimcache", "path", "path", "last_modified", "[path]")}
 UNION ALL {tools("lnk", "a shortcut", "concat_ws(' ', local_path, network_path, arguments)", "coalesce(local_path, network_path)", "target_modified", "[source_file]")}
 UNION ALL {tools("browser_history", "browser history", "concat_ws(' ', url, target_path)", "url", "timestamp", "[url, source_file]")}""")


def run_all() -> str:
    """The rows of all detections."""
    return " UNION ALL ".join(f"(SELECT host_id, title, severity, phase, attack_id, ts_us, detail, evidence FROM ({o}) d{i})" for i, o in enumerate(ORACLES.values()))
