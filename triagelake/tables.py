"""Case tables: fixed schemas, Parquet storage partitioned by host, JSON import."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake import commits
from triagelake.functions.payload import with_payload

# Every table starts with host_id. Types: s string, l long, i int, d double, b boolean,
# t timestamp, as array<string>, at array<timestamp>, x binary.
_CODES = {
    "s": T.StringType(), "l": T.LongType(), "i": T.IntegerType(), "d": T.DoubleType(), "b": T.BooleanType(),
    "t": T.TimestampType(), "as": T.ArrayType(T.StringType()), "at": T.ArrayType(T.TimestampType()), "x": T.BinaryType(),
}
_COLUMNS = {
    # shared
    "hosts": "display_name:s kind:s source_path:s acquired_at:t",
    "files": "id:l meta_addr:l fs_id:l name:s parent_path:s size:l is_directory:b is_deleted:b modified:t accessed:t changed:t created:t",
    "volumes": "id:l fs_type:s offset_bytes:l size_bytes:l",
    "browser_history": "browser:s kind:s url:s title:s timestamp:t visit_count:l typed_count:l target_path:s received_bytes:l total_bytes:l referrer:s user_profile:s source_file:s",
    "yara_matches": "rule:s path:s file_id:l file_size:l scanned_at:t",
    "entropy": "ext:s sampled:l high:l mean_entropy:d max_entropy:d",
    # Windows
    "events": "record_number:l written_at:t event_id:l level:i channel:s provider:s computer:s payload_xml:s source_file:s",
    "registry": "hive:s path:s name:s type:s data:s last_written:t source_file:s",
    "prefetch": "executable_name:s executable_path:s run_count:l run_times:at file_count:l volume_count:l format_version:i source_file:s",
    "amcache": "name:s full_path:s sha1:s size:l link_date:t product_name:s publisher:s binary_type:s registered_at:t source:s source_file:s",
    "shimcache": "path:s last_modified:t insertion_order:l version:s source_file:s",
    "lnk": "source_file:s local_path:s network_path:s description:s arguments:s working_directory:s icon_location:s target_size:l target_created:t target_modified:t target_accessed:t drive_type:s volume_label:s volume_serial:s machine_identifier:s",
    "jumplist": "app_id:s application:s list_type:s entry_id:l target_path:s arguments:s last_accessed:t access_count:l hostname:s pinned:b source_file:s",
    "usn": "usn:l timestamp:t file_name:s is_directory:b mft_entry:l mft_sequence:i parent_mft_entry:l reason_raw:l file_attributes:l source_file:s",
    "mft": "record_number:l sequence:i in_use:b is_directory:b file_name:s full_path:s parent_record:l volume:s si_created_raw:l si_modified_raw:l si_changed_raw:l si_accessed_raw:l fn_created_raw:l fn_modified_raw:l fn_changed_raw:l fn_accessed_raw:l size:l resident_data:x source_file:s",
    "srum": "kind:s timestamp:t application:s user_sid:s bytes_sent:l bytes_received:l interface_luid:l bytes_read:l bytes_written:l connect_start:t connected_seconds:l source_file:s",
    "recycle_bin": "original_path:s deleted_at:t size_bytes:l recycled_name:s sid:s source_file:s",
    "wmi": "kind:s consumer_name:s consumer_type:s filter_name:s query:s command:s script_engine:s script_text:s is_common_benign:b source_file:s",
    # Linux
    "auth_log": "timestamp:t host:s process:s pid:l kind:s user:s source_ip:s port:l method:s command:s message:s source_file:s",
    "logins": "type:s pid:l line:s user:s host:s timestamp:t is_failed_login:b source_file:s",
    "shell_history": "user:s shell:s command:s timestamp:t line_number:l source_file:s",
    "linux_persistence": "kind:s schedule:s user:s command:s unit_name:s detail:s source_file:s",
    "linux_users": "name:s uid:l gid:l home:s shell:s",
    "linux_host": "pretty_name:s os_id:s version_id:s hostname:s time_zone:s ip_addresses:as",
    "ssh_keys": "kind:s user:s algorithm:s comment:s options:as host:s source_file:s",
    "sudo_rules": "principal:s run_as:s no_passwd:b command:s source_file:s",
    "linux_groups": "name:s gid:l members:as",
    "shadow": "account:s status:s",
    "sshd_settings": "key:s value:s source_file:s",
    "web_access": "timestamp:t client_ip:s method:s path:s query:s http_version:s status:i bytes:l referer:s user_agent:s server:s source_file:s",
    "packages": "timestamp:t action:s package:s version:s manager:s source_file:s",
    "journald": "timestamp:t message:s priority:i comm:s pid:l unit:s identifier:s hostname:s uid:l boot_id:s source_file:s",
    "audit": "timestamp:t serial:l record_type:s syscall:s success:b exit:l exe:s comm:s command_line:s path:s auid:l uid:l ses:l tty:s key:s account:s result:s source_ip:s source_file:s",
    "syslog": "timestamp:t host:s process:s pid:l category:s message:s user:s command:s unit:s source_file:s",
    "lastlog": "uid:l user:s timestamp:t line:s host:s source_file:s",
    # macOS
    "launch_items": "label:s program:s program_arguments:as run_at_load:b start_interval:l watch_paths:as scope:s plist_path:s",
    "mac_persistence": "kind:s schedule:s user:s command:s name:s detail:s source_file:s",
    "quarantine": "agent_name:s data_url:s origin_url:s timestamp:t event_id:s source_file:s",
    "where_froms": "path:s urls:as scope:s",
    "fsevents": "path:s event_id:l flags:l node_id:l source_file:s",
    "unified_log": "timestamp:t event_type:s level:s pid:l process:s subsystem:s category:s message:s source_file:s",
    "tcc": "service:s client:s client_type:i auth_value:i auth_reason:i last_modified:t scope:s source_file:s",
    "knowledge": "stream:s value:s value_int:l start_date:t end_date:t scope:s source_file:s",
    "recent_items": "kind:s title:s value:s timestamp:t scope:s source_file:s",
    "security_events": "kind:s severity:s timestamp:t process:s message:s path:s signature:s scope:s source_file:s",
    "kexts": "kind:s bundle_id:s name:s version:s team_id:s path:s enabled:b scope:s source_file:s",
    "background_items": "name:s executable:s bundle_id:s developer_name:s team_id:s type_raw:l disposition:l scope:s source_file:s",
    "messages": "guid:s service:s handle:s is_from_me:b text:s timestamp:t has_attachment:b chat_name:s scope:s source_file:s",
    "mail": "subject:s sender:s sender_display:s recipients:s date_sent:t date_received:t mailbox:s scope:s source_file:s",
    "network": "kind:s name:s identifier:s timestamp:t detail:s scope:s source_file:s",
    "user_activity": "kind:s path:s timestamp:t detail:s scope:s source_file:s",
    "doc_versions": "file_path:s version_time:t size:l generation_path:s scope:s source_file:s",
    "notifications": "app_id:s title:s body:s delivered_date:t scope:s source_file:s",
    "powerlog": "kind:s process_name:s bundle_id:s pid:l event:s date:t end_date:t bytes_in:l bytes_out:l scope:s source_file:s",
    "config": "category:s key:s name:s value:s interpretation:s risk:s attack_id:s attack_name:s domain:s scope:s source_file:s",
    "installs": "display_name:s package_identifiers:as version:s date:t process_name:s content_type:s package_file:s install_prefix:s source:s scope:s source_file:s",
    "mac_host": "product_name:s product_version:s build_version:s computer_name:s local_host_name:s time_zone:s ip_addresses:as",
    "mac_users": "name:s uid:l home:s shell:s",
}
# Case-wide tables without a host.
_CASE_COLUMNS = {
    "iocs": "kind:s value:s note:s pos:l",
    "bad_hashes": "value:s",
    "feeds": "tier:i provider_order:i source:s kind:s value:s verdict:s detail:s",
    "annotations": "target_kind:s target_key:s host_id:s tag:s note:s author:s title:s timestamp:t source_label:s created_at:t modified_at:t",
    "custody": "timestamp:t action:s actor:s detail:s host_id:s",
}


def _struct(text: str, host: bool) -> T.StructType:
    fields = [T.StructField("host_id", T.StringType())] if host else []
    for item in text.split():
        name, code = item.split(":")
        fields.append(T.StructField(name, _CODES[code]))
    return T.StructType(fields)


SCHEMAS: dict[str, T.StructType] = {
    **{n: _struct(c, True) for n, c in _COLUMNS.items()},
    **{n: _struct(c, False) for n, c in _CASE_COLUMNS.items()},
}


def conform(df: DataFrame, name: str) -> DataFrame:
    """Casts to the table's schema; absent columns become null, extra ones are dropped."""
    have = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields]
    )


class CaseTables(Mapping):
    """Name -> DataFrame. A table nobody supplied reads as empty, never as an error."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame] | None = None):
        self.spark = spark
        self._tables = dict(tables or {})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            if name not in SCHEMAS:
                raise KeyError(name)
            self._tables[name] = self.spark.createDataFrame([], SCHEMAS[name])
        return self._tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)

    def supplied(self, name: str) -> bool:
        return name in self._tables

    def with_tables(self, **more: DataFrame) -> CaseTables:
        return CaseTables(self.spark, {**self._tables, **more})

    def for_hosts(self, hosts: list[str] | None) -> CaseTables:
        """The same case seen through some of its hosts (all of them for None)."""
        if hosts is None:
            return self
        scoped = {n: d.filter(F.col("host_id").isin(hosts)) if "host_id" in d.columns else d for n, d in self._tables.items()}
        return CaseTables(self.spark, scoped)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> CaseTables:
        """Every table found below a case folder."""
        found = {}
        for name in SCHEMAS:
            try:
                found[name] = read_table(spark, root, name)
            except FileNotFoundError:
                continue
        return cls(spark, found)


# ---- Storage ----------------------------------------------------------------------------------
def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def has_hosts(name: str) -> bool:
    return name not in _CASE_COLUMNS


def read_table(spark: SparkSession, root: str, name: str, hosts: list[str] | None = None, at: int | None = None) -> DataFrame:
    """A stored table as of its last commit (or commit `at`); only the folders of the wanted hosts are opened."""
    path = f"{root}/{name}"
    if not _exists(spark, f"{path}/commits"):
        raise FileNotFoundError(path)
    return commits.read(spark, path, SCHEMAS[name], has_hosts(name), hosts if has_hosts(name) else None, at)


def write_table(df: DataFrame, root: str, name: str) -> int:
    """Replaces the hosts present in the data, or a table without hosts, in one step; returns the commit's number."""
    return commits.replace_parts(conform(df, name), f"{root}/{name}", has_hosts(name))


def append_table(df: DataFrame, root: str, name: str) -> int:
    """Adds rows; what is there is not rewritten."""
    return commits.append(conform(df, name), f"{root}/{name}", has_hosts(name))


def merge_table(df: DataFrame, root: str, name: str, combine) -> int:
    """Rewrites the touched hosts (or a table without hosts) as combine(present rows, new rows)."""
    return commits.merge(conform(df, name), f"{root}/{name}", SCHEMAS[name], has_hosts(name), lambda a, b: conform(combine(a, b), name))


def parse_instant(text):
    """Instants written with or without fractional seconds."""
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssX")),
    )


def import_json(spark: SparkSession, path: str, name: str, host_id: str, rename: dict[str, str] | None = None) -> DataFrame:
    """A JSON array file of one host as table rows; absent fields become null.

    `rename` maps a field name of the file to a column name. Times may carry fractions or not.
    """
    back = {v: k for k, v in (rename or {}).items()}
    fields, picks = [], []
    for f in SCHEMAS[name].fields:
        if f.name == "host_id":
            continue
        src = back.get(f.name, f.name)
        is_time = isinstance(f.dataType, T.TimestampType)
        fields.append(T.StructField(src, T.StringType() if is_time else f.dataType))
        picks.append((parse_instant(F.col(src)) if is_time else F.col(src)).alias(f.name))
    rows = spark.read.schema(T.StructType(fields)).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.select(F.lit(host_id).alias("host_id"), *picks)


def light_events(events: DataFrame) -> DataFrame:
    """Event rows without the payload; Parquet then never reads that column."""
    return events.drop("payload_xml", "payload")


def ingest_events(events: DataFrame) -> DataFrame:
    """Event rows with the payload parsed once into a map."""
    return with_payload(events)
