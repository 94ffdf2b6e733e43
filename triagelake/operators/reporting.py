"""Findings grouped, digested, checked and rolled up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.functions.substring import substring_pairs
from triagelake.functions.text import code_label, lookup
from triagelake.operators.findings import PHASES, SEVERITY_LABELS, with_finding_id

# Weight of a severity in the weighted recall.
WEIGHTS = {4: 5, 3: 4, 2: 3, 1: 2, 0: 1}


def bucket_key() -> Column:
    """Technique id, or the title when there is none."""
    return F.coalesce("technique.attack_id", "title")


def phase_order() -> Column:
    return lookup(F.col("phase"), {p: i for i, p in enumerate(PHASES)})


def kill_chain_groups(findings: DataFrame) -> DataFrame:
    """Per phase the technique groups with count, worst severity and newest time.

    A finding without a technique is a group of its own."""
    rows = with_finding_id(findings)
    single = F.concat(F.lit("ungrouped:"), F.col("finding_id"))
    rows = rows.withColumn("group_key", F.coalesce("technique.attack_id", single))
    return rows.groupBy("phase", "group_key").agg(
        F.min("technique.name").alias("technique_name"), F.min("title").alias("first_title"), F.count(F.lit(1)).alias("n"),
        F.max("severity").alias("max_severity"), F.max("timestamp").alias("newest"),
    ).select("phase", phase_order().alias("phase_order"), "group_key", F.coalesce("technique_name", "first_title").alias("title"), "n", "max_severity", "newest")


def digest_groups(findings: DataFrame) -> DataFrame:
    """One row per technique or title: count, worst severity, and the worst finding as its face."""
    face = F.struct("host_id", "title", "phase", "severity", "timestamp", "evidence")
    order = F.struct((-F.col("severity")).alias("s"), F.col("host_id"), F.col("title"), F.col("timestamp"), F.array_join("evidence", "|").alias("e"))
    return findings.groupBy(bucket_key().alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.max("severity").alias("max_severity"), F.min_by(face, order).alias("rep")
    )


def digest(findings: DataFrame, cap: int | None = None) -> DataFrame:
    """The groups, worst and largest first, numbered F01, F02, …; only the first `cap` if that is given."""
    top = digest_groups(findings)
    if cap is not None:
        top = top.orderBy(F.col("max_severity").desc(), F.col("n").desc(), "key").limit(cap)
    # The window runs over groups, a row per technique or title.
    rank = F.row_number().over(Window.orderBy(F.col("max_severity").desc(), F.col("n").desc(), "key"))
    return top.select(F.format_string("F%02d", rank).alias("id"), "key", "n", "max_severity", "rep")


def digest_omitted(findings: DataFrame, cap: int) -> DataFrame:
    """How many groups there are, and how many of them a digest of `cap` leaves out."""
    groups = digest_groups(findings).agg(F.count(F.lit(1)).alias("groups"))
    return groups.select("groups", F.greatest(F.col("groups") - cap, F.lit(0)).alias("omitted"))


def clean_ref(ref: Column) -> Column:
    return F.regexp_replace(ref, "^[()\\[\\]{} \\t\"'.,;]+|[()\\[\\]{} \\t\"'.,;]+$", "")


def claim_refs(claims: DataFrame) -> DataFrame:
    """References of each claim, cleaned, once each, in order."""
    refs = F.array_distinct(F.filter(F.transform("refs", clean_ref), lambda r: r != ""))
    return claims.select("claim_id", F.posexplode(refs).alias("pos", "ref"))


def path_tokens(text: Column) -> Column:
    words = F.transform(F.split(text, "[ \\n\\t]+"), lambda w: F.regexp_replace(w, "^[\"'`(),.;]+|[\"'`(),.;]+$", ""))
    return F.filter(words, lambda w: w.rlike(r"^/.*/") | w.rlike(r"^\p{L}:\\"))


def flagged_paths(claims: DataFrame, known_paths: DataFrame) -> DataFrame:
    """Path-like words of kept claims that no known path contains."""
    tokens = claims.select("claim_id", F.explode(F.array_distinct(path_tokens(F.col("statement")))).alias("token"))
    needles = tokens.select(F.col("token").alias("needle")).distinct()
    known = substring_pairs(known_paths.select("path").distinct(), "path", needles).select(F.col("needle").alias("token")).distinct()
    return tokens.join(known, "token", "left_anti")


def validate_claims(claims: DataFrame, digest_rows: DataFrame) -> DataFrame:
    """Claims that cite at least one digest row, with severity and phase taken from what they cite.

    claims: claim_id, statement, phase, severity, refs. Unknown references are counted as
    phantom; a claim with only those is kept as a row with kept = false.
    """
    known = digest_rows.select(F.col("id").alias("ref"), F.col("max_severity").alias("s"), F.col("rep.phase").alias("p"), F.col("rep.evidence").alias("ev"), "key")
    cited = claim_refs(claims).join(known, "ref", "left")
    hit = F.col("s").isNotNull()
    agg = cited.groupBy("claim_id").agg(
        F.count_if(~hit).alias("phantom"),
        F.count_if(hit).alias("cited"),
        F.max("s").alias("max_s"),
        F.max_by("p", F.when(hit, F.struct(F.col("s"), -F.col("pos")))).alias("top_phase"),
        F.transform(F.array_sort(F.collect_list(F.when(hit, F.struct("pos", "key", "ev")))), lambda c: c).alias("refs_in_order"),
    )
    order = F.col("refs_in_order")
    return claims.join(agg, "claim_id", "left").select(
        "claim_id",
        "statement",
        (F.coalesce("cited", F.lit(0)) > 0).alias("kept"),
        F.coalesce("max_s", "severity").alias("severity"),
        F.coalesce("top_phase", "phase").alias("phase"),
        F.array_distinct(F.flatten(F.transform(order, lambda c: c["ev"]))).alias("citations"),
        F.array_distinct(F.transform(order, lambda c: c["key"])).alias("technique_keys"),
        F.coalesce("phantom", F.lit(0)).alias("phantom_refs"),
    )


def claim_report(validated: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    counts = validated.agg(
        F.count(F.lit(1)).alias("proposed"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"), F.coalesce(F.sum("phantom_refs"), F.lit(0)).alias("phantom_refs")
    )
    if flagged is None:
        return counts
    kept = validated.filter("kept").select("claim_id")
    n = flagged.join(kept, "claim_id", "left_semi").agg(F.count_distinct("token").alias("flagged_paths"))
    return counts.crossJoin(n)  # one row each


def claim_metrics(validated: DataFrame, findings: DataFrame, unsupported_pairs: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """Recall, precision, severity-weighted recall, confabulation, drop rate and digest ceiling.

    unsupported_pairs: (a, b) technique keys that must not be linked in one claim, a < b.
    """
    groups = digest_groups(findings).select("key", F.col("max_severity").alias("s"))
    shown = digest(findings, cap).select("key").withColumn("shown", F.lit(True))
    asserted = validated.filter("kept").select(F.explode("technique_keys").alias("key")).distinct().withColumn("asserted", F.lit(True))
    keys = groups.join(shown, "key", "left").join(asserted, "key", "full")
    is_shown, is_asserted = F.coalesce("shown", F.lit(False)), F.coalesce("asserted", F.lit(False))
    flat = keys.select("key", "s", is_shown.alias("shown"), is_asserted.alias("asserted"), F.col("s").isNotNull().alias("real"))
    by_severity = flat.filter("shown").groupBy("s").agg((F.count_if("asserted") / F.count(F.lit(1))).alias("rate"))
    weight = code_label(F.col("s"), WEIGHTS)
    weighted = by_severity.agg((F.sum(weight * F.col("rate")) / F.sum(weight)).alias("w"))
    totals = flat.agg(
        F.count_if("shown").alias("ground_truth"), F.count_if(F.col("shown") & F.col("asserted")).alias("covered"),
        F.count_if("asserted").alias("asserted"), F.count_if(F.col("asserted") & F.col("real")).alias("asserted_real"), F.count_if("real").alias("in_case"),
    )
    pairs = F.array_distinct("technique_keys")
    claims = validated.select("claim_id", "kept", F.when(F.col("kept"), F.size(pairs)).alias("k"))
    counted = claims.agg(F.count(F.lit(1)).alias("proposed"), F.count_if(~F.col("kept")).alias("dropped"), F.count_if(F.col("k") >= 2).alias("causal"))
    if unsupported_pairs is not None:
        named = validated.filter("kept").select("claim_id", F.explode(pairs).alias("key"))
        left = named.join(unsupported_pairs.select(F.col("a").alias("key"), "b"), "key")
        bad = left.join(named.withColumnRenamed("key", "b"), ["claim_id", "b"], "left_semi").agg(F.count_distinct("claim_id").alias("confabulated"))
    else:
        bad = claims.agg(F.lit(0).cast("bigint").alias("confabulated"))
    # Four one-row results side by side.
    one = totals.crossJoin(weighted).crossJoin(counted).crossJoin(bad)
    rate = lambda a, b, empty: F.when(F.col(b) == 0, F.lit(empty)).otherwise(F.col(a) / F.col(b))
    return one.select(
        rate("covered", "ground_truth", 1.0).alias("recall"),
        rate("asserted_real", "asserted", 1.0).alias("precision"),
        F.coalesce("w", F.lit(1.0)).alias("severity_weighted_recall"),
        F.when(F.col("causal") > 0, F.col("confabulated") / F.col("causal")).alias("confabulation_rate"),
        rate("dropped", "proposed", 0.0).alias("drop_rate"),
        rate("ground_truth", "in_case", 1.0).alias("digest_ceiling"),
        "ground_truth", "covered", "causal", "confabulated",
    )


# ---- Report roll-up ---------------------------------------------------------------------------
def select_severities(findings: DataFrame, severities: list[int] | None) -> DataFrame:
    return findings if severities is None else findings.filter(F.col("severity").isin(severities))


def severity_filter_note(severities: list[int] | None) -> str | None:
    """The severities included, worst first, or None when all are."""
    if severities is None or len(set(severities)) == len(SEVERITY_LABELS):
        return None
    return ", ".join(SEVERITY_LABELS[s] for s in sorted(set(severities), reverse=True))


def severity_counts(findings: DataFrame, severities: list[int] | None = None) -> DataFrame:
    """Counts per host and severity with host and case totals (null = all)."""
    rows = select_severities(findings, severities)
    return rows.rollup("host_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def phase_counts(findings: DataFrame, severities: list[int] | None = None) -> DataFrame:
    """Per host the non-empty phases in kill-chain order."""
    rows = select_severities(findings, severities)
    return rows.groupBy("host_id", "phase").agg(F.count(F.lit(1)).alias("n"), F.max("severity").alias("max_severity")).withColumn("phase_order", phase_order())


def phase_matrix(findings: DataFrame) -> DataFrame:
    """One row per host, one column per phase."""
    return findings.groupBy("host_id").pivot("phase", list(PHASES)).agg(F.count(F.lit(1))).na.fill(0)


def dated_excerpt(findings: DataFrame, severities: list[int] | None = None) -> DataFrame:
    """The dated findings, for reading in time order."""
    return select_severities(findings, severities).filter("timestamp IS NOT NULL").orderBy("timestamp", "host_id", "title")


def host_sections(t, findings: DataFrame, ioc_matches: DataFrame, severities: list[int] | None = None) -> DataFrame:
    """Per host the numbers a report opens with."""
    chosen = select_severities(findings, severities)

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("host_id").agg(F.count(F.lit(1)).alias(name))

    parts = [
        count(t["files"], "files"), count(t["events"], "events"), count(t["registry"], "registry_values"),
        count(chosen, "findings"), count(ioc_matches, "ioc_matches"),
    ]
    out = t["hosts"].select("host_id", "display_name", F.col("kind").alias("kind"))
    for p in parts:
        out = out.join(p, "host_id", "left")
    return out.na.fill(0)


def overview(t, timeline: DataFrame, findings: DataFrame) -> DataFrame:
    """Files, deleted files, timeline rows, log events, registry values and findings, as rows."""
    def one(name: str, df: DataFrame, cond: Column | None = None) -> DataFrame:
        n = F.count(F.lit(1)) if cond is None else F.count_if(cond)
        return df.agg(n.alias("n")).select(F.lit(name).alias("metric"), "n")

    parts = [
        one("files", t["files"]), one("deleted", t["files"], F.col("is_deleted")), one("timeline_events", timeline),
        one("log_events", t["events"]), one("registry_values", t["registry"]), one("findings", findings),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    by_severity = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("severity_"), F.col("severity").cast("string")).alias("metric"), "n")
    return out.unionByName(by_severity)
