"""Aggregates, rankings and selections over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dictionaries as d
from ..functions.scalar import severity_name, severity_score

SEVERITIES = ["critical", "high", "medium", "low"]


def cleaned(findings: DataFrame) -> DataFrame:
    """One spelling of severity and pattern type; risk scores that are NaN become null."""
    kind = F.regexp_replace(F.lower(F.trim("pattern_type")), r"[-\s]+", "_")
    return findings.withColumns({"severity": severity_name(F.col("severity")), "pattern_type": kind, "risk_score": F.when(~F.isnan("risk_score"), F.col("risk_score"))})


def _mean(c: str) -> Column:
    return F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)


def severity_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def pattern_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("pattern_type").agg(F.count("*").alias("n"))


def report_summary(findings: DataFrame) -> DataFrame:
    """One row: total, a count per severity, mean and highest risk (0 without findings)."""
    per = [F.count_if(F.col("severity") == s).alias(f"{s}_findings") for s in SEVERITIES]
    return findings.agg(F.count("*").alias("total_findings"), *per, _mean("risk_score").alias("average_risk_score"), F.coalesce(F.max("risk_score"), F.lit(0.0)).alias("highest_risk_score"))


def detailed_stats(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("total_findings"), F.countDistinct("file_path").alias("affected_files"), _mean("risk_score").alias("average_risk_score"), F.coalesce(F.max("risk_score"), F.lit(0.0)).alias("max_risk_score"))


def per_file(findings: DataFrame) -> DataFrame:
    """(file_path, findings, max_severity, average_risk_score, one count per severity); map-side folded, so a hot file is no
    more than one row per task. The least severity is low; a null path is a file of its own."""
    top = F.max(F.struct(severity_score(F.col("severity")).alias("s"), F.when(severity_score(F.col("severity")) > 1, F.col("severity")).otherwise("low").alias("name")))["name"]
    per = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    return findings.groupBy("file_path").agg(F.count("*").alias("findings"), top.alias("max_severity"), _mean("risk_score").alias("average_risk_score"), *per)


def most_affected_files(findings: DataFrame, n: int = 10) -> DataFrame:
    return per_file(findings).orderBy(F.col("findings").desc(), F.col("file_path")).limit(n).select("file_path", "findings", "max_severity", "average_risk_score")


def most_frequent_patterns(findings: DataFrame, n: int = 5) -> DataFrame:
    return pattern_counts(findings).orderBy(F.col("n").desc(), "pattern_type").limit(n)


def files_by_severity(findings: DataFrame) -> DataFrame:
    """Files with their most severe first; equal ones by path."""
    files = per_file(findings)
    return files.orderBy(severity_score(F.col("max_severity")).desc(), "file_path").select("file_path", "max_severity", "findings")


def findings_by_severity(findings: DataFrame, tie: str = "finding_id") -> DataFrame:
    """Findings by file, the severest of a file first; a range sort, so that a hot file is no group of one task."""
    return findings.orderBy("file_path", severity_score(F.col("severity")).desc(), tie)


def totals_without_ignored(findings: DataFrame, ignored_paths: DataFrame) -> DataFrame:
    """One row: counts per severity and in all, of findings in files that are not ignored; other severities count nowhere."""
    kept = findings.join(ignored_paths.select("file_path").distinct(), "file_path", "left_anti")
    per = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    return kept.agg(*per).withColumn("total", sum((F.col(s) for s in SEVERITIES[1:]), F.col(SEVERITIES[0])))


def is_critical(severity: Column, risk: Column) -> Column:
    return F.coalesce((severity == "critical") | ((severity == "high") & (risk >= 70)), F.lit(False))


def critical_findings(findings: DataFrame, n: int = 20, tie: str = "finding_id") -> DataFrame:
    """The n critical findings of highest risk, equal risk by the smaller tie value, with a suggestion each."""
    top = findings.where(is_critical(F.col("severity"), F.col("risk_score"))).orderBy(F.col("risk_score").desc_nulls_last(), tie).limit(n)
    return top.select(tie, "file_path", translated(F.col("description"), d.DESCRIPTION_RU).alias("description"), translated(F.col("severity"), d.SEVERITY_RU).alias("severity"), "risk_score", suggestion(F.col("pattern_type")).alias("suggestion"))


def translated(c: Column, words: dict[str, str]) -> Column:
    """A word from a dictionary; what it lacks passes through."""
    pairs = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), c)


def suggestion(pattern_type: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in d.SUGGESTION_RU.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, pattern_type), F.lit(d.SUGGESTION_DEFAULT))


def files_with_text(findings: DataFrame, text: str, severity: str | None = None) -> DataFrame:
    """Paths of files with a finding of that severity and a finding or path that holds the text, letter case aside."""
    t = text.lower()
    hit = F.contains(F.lower("file_path"), F.lit(t)) | F.contains(F.lower("description"), F.lit(t)) | F.contains(F.lower("pattern_type"), F.lit(t))
    has = F.lit(True) if severity is None else F.bool_or(F.coalesce(F.col("severity") == severity, F.lit(False)))
    return findings.where(F.col("file_path").isNotNull()).groupBy("file_path").agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("hit"), (has if severity else F.bool_or(F.lit(True))).alias("has"), F.count("*").alias("findings")).where("hit AND has").select("file_path", "findings")


def selected_by_severity(findings: DataFrame, severity: str) -> DataFrame:
    """Paths of files with at least one finding of that severity."""
    return findings.where((F.col("severity") == severity) & F.col("file_path").isNotNull()).select("file_path").distinct()


def scan_counters(file_status: DataFrame) -> DataFrame:
    """One row: files scanned, skipped, in error, and bytes scanned; ignored paths count nowhere. A row that repeats
    another exactly counts once."""
    s = F.lower(F.trim("scan_status"))
    rows = file_status.dropDuplicates()
    return rows.agg(
        F.count_if(s == "scanned").alias("files_scanned"), F.count_if(s == "skipped").alias("files_skipped"), F.count_if(s == "error").alias("error_count"),
        F.coalesce(F.sum(F.when(s == "scanned", F.col("size_bytes"))), F.lit(0)).alias("total_size"),
    )


def skip_reasons(file_status: DataFrame) -> DataFrame:
    reason = F.lower(F.trim("skip_reason"))
    return file_status.dropDuplicates().where(F.col("skip_reason").isNotNull()).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def batch_metadata(batches: DataFrame) -> DataFrame:
    """Totals over scan batches, and the data scanned as the report words it."""
    return batches.agg(
        F.sum("files_scanned").alias("files_scanned"), F.sum("files_skipped").alias("files_skipped"), F.sum("error_count").alias("error_count"),
        F.concat(F.coalesce(F.sum("total_size"), F.lit(0)).cast("string"), F.lit(" bytes")).alias("total_data_scanned"),
    )


def risk_assessment(findings: DataFrame) -> DataFrame:
    """One row: level by the number of critical, high and all findings."""
    c, h, n = F.col("critical_findings"), F.col("high_findings"), F.col("total_findings")
    level = (
        F.when((c >= 10) | ((c >= 5) & (h >= 10)), "critical")
        .when((c >= 3) | (h >= 10), "high")
        .when((c >= 1) | (h >= 5), "medium")
        .when((h >= 1) | (n >= 10), "moderate")
        .otherwise("low")
    )
    return report_summary(findings).select("total_findings", "critical_findings", "high_findings", level.alias("risk_level"), "average_risk_score", "highest_risk_score")


def recommendations(findings: DataFrame) -> DataFrame:
    """(place, recommendation), in order; computed from one row of counts."""
    r, kinds = d.RECOMMENDATIONS, ["private_key", "password", "api_key", "aws_key", "credit_card", "connection_string"]
    counts = findings.agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "critical").alias("c"), F.count_if(F.col("severity") == "high").alias("h"), *[F.count_if(F.col("pattern_type") == k).alias(k) for k in kinds])
    advice = [
        F.when(F.col("c") > 0, r["critical"]), F.when(F.col("private_key") > 0, r["private_key"]), F.when(F.col("password") > 0, r["password"]),
        F.when((F.col("api_key") > 0) | (F.col("aws_key") > 0), r["api_key"]), F.when(F.col("credit_card") > 0, r["credit_card"]), F.when(F.col("connection_string") > 0, r["connection_string"]),
        *[F.when(F.col("n") > 0, x) for x in r["any"]], F.when((F.col("c") > 0) | (F.col("h") > 0), r["again"]),
    ]
    return counts.select(F.posexplode(F.array_compact(F.array(*advice))).alias("place", "recommendation"))
