"""Export rows and their CSV and JSON files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.text import code_label, lookup
from triagelake.operators.findings import PHASES, SEVERITY_LABELS, text
from triagelake.operators.ioc import KIND_LABELS

# Labels of custody actions and tags.
ACTION_LABELS = {
    "acquired": "Acquired", "addedToCase": "Added to case", "analysed": "Analysed", "hashRecorded": "Hash recorded",
    "hashVerified": "Hash verified", "enrichmentPerformed": "Enrichment", "exported": "Exported", "noteAdded": "Note",
    "summarized": "AI summary",
}
TAG_LABELS = {"malicious": "Malicious", "suspicious": "Suspicious", "benign": "Benign", "followUp": "Follow up"}


def iso(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def _named(df: DataFrame, hosts: DataFrame, out: str) -> DataFrame:
    """Adds the host's display name (the first on record); empty when unknown."""
    names = hosts.groupBy("host_id").agg(F.min("display_name").alias("_n"))
    return df.join(names, "host_id", "left").withColumn(out, F.coalesce("_n", F.lit(""))).drop("_n")


def timeline_rows(timeline: DataFrame, hosts: DataFrame) -> DataFrame:
    return _named(timeline, hosts, "host").select(
        iso(F.col("date")).alias("timestamp_iso"), "source", F.col("kind").alias("macb"), F.coalesce(F.col("event_id").cast("string"), F.lit("")).alias("event_id"),
        "path", "size", F.when(F.col("is_deleted"), "true").otherwise("false").alias("deleted"), "host",
    )


def finding_rows(findings: DataFrame, hosts: DataFrame) -> DataFrame:
    blank = F.lit("")
    return _named(findings, hosts, "host").select(
        iso(F.col("timestamp")).alias("timestamp_iso"), code_label(F.col("severity"), SEVERITY_LABELS).alias("severity"), lookup(F.col("phase"), PHASES).alias("phase"),
        F.coalesce("technique.attack_id", blank).alias("attack_id"), F.coalesce("technique.name", blank).alias("attack_name"), "title", "detail",
        F.array_join("evidence", "; ").alias("evidence_paths"), "host",
    )


def ioc_rows(matches: DataFrame, hosts: DataFrame) -> DataFrame:
    at = lambda f: F.col(f"location.{f}")
    key = F.concat_ws("\\", at("hive"), at("path"), F.when(at("name") != "", at("name")))
    detail = (
        F.when(at("type") == "event", text(at("channel"), " EID ", at("event_id"), " record ", at("record_number"), " [", at("source_file"), "]"))
        .when(at("type") == "registry", key)
        .otherwise(at("path"))
    )
    return _named(matches, hosts, "host").select(
        iso(F.col("timestamp")).alias("timestamp_iso"), lookup(F.col("ioc_kind"), KIND_LABELS).alias("ioc_kind"), "ioc_value", at("type").alias("location_type"),
        detail.alias("location_detail"), "context", "host",
    )


def custody_rows(log: DataFrame, hosts: DataFrame) -> DataFrame:
    return _named(log, hosts, "evidence").orderBy("timestamp", "action", "detail").select(
        iso(F.col("timestamp")).alias("timestamp_iso"), lookup(F.col("action"), ACTION_LABELS).alias("action"), "actor", "detail", "evidence"
    )


def annotation_rows(annotations: DataFrame, hosts: DataFrame) -> DataFrame:
    ordered = _named(annotations, hosts, "evidence").orderBy(F.col("timestamp").asc_nulls_last(), "created_at", "target_key")
    return ordered.select(
        iso(F.col("timestamp")).alias("target_timestamp_iso"), F.coalesce(lookup(F.col("tag"), TAG_LABELS), F.lit("")).alias("tag"), "target_kind",
        F.col("source_label").alias("source"), "title", "note", "author", iso(F.col("created_at")).alias("created_iso"), iso(F.col("modified_at")).alias("modified_iso"), "evidence",
    )


def guard(field: Column) -> Column:
    """A leading character a spreadsheet would take for a formula is defused by an apostrophe."""
    return F.when(field.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), field)).otherwise(field)


def csv_record(row: DataFrame) -> Column:
    """One CSV line of a row: guarded fields, quoted only where needed."""
    def field(c: str) -> Column:
        f = guard(F.coalesce(F.col(c).cast("string"), F.lit("")))
        return F.when(f.rlike("[,\"\\n\\r]"), F.concat(F.lit('"'), F.replace(f, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(f)

    return F.concat_ws(",", *[field(c) for c in row.columns])


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header in every file, CRLF line ends and guarded fields, written by all tasks (`part-*.txt`).

    Lines are composed here and written as text, as Spark's CSV writer turns line feeds inside of fields into CRLF.
    """
    header = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\r\n') else c for c in rows.columns)

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() == 0
        for batch in batches:
            if first is not None:
                yield pa.RecordBatch.from_arrays([pa.array([header])], ["value"])
                first = None
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string())], ["value"])
        if first:
            yield pa.RecordBatch.from_arrays([pa.array([header])], ["value"])

    lines = rows.select(csv_record(rows).alias("value")).mapInArrow(headed, "value string")
    lines.write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object per line; null fields are kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_timeline(timeline: DataFrame, path: str) -> None:
    """The timeline sorted by time within and across files: a range-partitioned write."""
    timeline.repartitionByRange("date", "host_id", "path").sortWithinPartitions("date", "host_id", "path").write.mode("overwrite").parquet(path)
