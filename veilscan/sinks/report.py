"""Reports of findings: JSON, CSV and text, as one file each, and partitioned tables for scale."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dictionaries as d
from ..functions.scalar import truncated
from ..operators import stats

FIELDS = {"file_path": "FilePath", "line_number": "LineNumber", "column_start": "ColumnStart", "column_end": "ColumnEnd", "pattern_type": "PatternType", "severity": "Severity", "description": "Description", "matched_text": "MatchedText", "context": "Context", "entropy_score": "EntropyScore", "risk_score": "RiskScore"}
ORDER = ["file_path", "line_number", "column_start", "pattern_type"]


def json_rows(findings: DataFrame) -> DataFrame:
    """One JSON object per finding, with the report's field names; <, > and & are escaped."""
    row = F.to_json(F.struct(*[F.col(c).alias(n) for c, n in FIELDS.items()]), {"ignoreNullFields": "false"})
    for sign in "<>&":
        row = F.replace(row, F.lit(sign), F.lit(f"\\u{ord(sign):04x}"))
    return findings.select(row.alias("value"), *ORDER)


def csv_rows(findings: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of the CSV report under its header, texts cut to 100 bytes."""
    values = [
        F.col("file_path"), F.col("line_number").cast("string"), F.col("column_start").cast("string"), F.col("column_end").cast("string"),
        stats.translated(F.col("pattern_type"), d.PATTERN_RU), stats.translated(F.col("severity"), d.SEVERITY_RU),
        F.format_string("%.2f", F.bround("risk_score", 2)), F.format_string("%.4f", F.bround("entropy_score", 4)), stats.translated(F.col("description"), d.DESCRIPTION_RU), truncated(F.col("matched_text")), truncated(F.col("context")),
    ]
    return findings.select(*[v.alias(n) for v, n in zip(values, d.CSV_HEADER)], *ORDER, *keep)


def _summary(findings: DataFrame) -> dict:
    row = stats.report_summary(findings).first().asDict()
    row["pattern_counts"] = {r["pattern_type"]: r["n"] for r in stats.pattern_counts(findings).collect()}  # as many as rules
    return row


def write_json(findings: DataFrame, path: str, metadata: dict | None = None) -> None:
    """The whole report as one indented file; findings stream through the driver, one partition at a time."""
    head = json.dumps({"metadata": metadata or {}, "summary": _summary(findings)}, ensure_ascii=False, indent=2)
    with open(path, "w", encoding="utf-8") as f:
        f.write(head[:-2] + ',\n  "findings": [')
        for k, r in enumerate(json_rows(findings).orderBy(*ORDER).toLocalIterator()):
            f.write((",\n    " if k else "\n    ") + r["value"])
        f.write(f'\n  ],\n  "generated_at": "{datetime.now().astimezone().isoformat(timespec="seconds")}"\n}}\n')


def _csv(values: list) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(values)
    return out.getvalue()


def write_csv(findings: DataFrame, path: str) -> None:
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write("﻿" + _csv(d.CSV_HEADER))
        for r in csv_rows(findings).orderBy(*ORDER).toLocalIterator():
            f.write(_csv([r[n] for n in d.CSV_HEADER]))


def text_lines(findings: DataFrame, metadata: dict | None = None) -> Iterator[str]:
    s = _summary(findings)
    yield "SECURITY SCAN REPORT"
    yield datetime.now().strftime("%d.%m.%Y %H:%M:%S")
    for k, v in (metadata or {}).items():
        yield f"{k}: {v}"
    for k in ("total_findings", *[f"{x}_findings" for x in stats.SEVERITIES], "average_risk_score", "highest_risk_score"):
        yield f"{k}: {s[k]}"
    for k, n in sorted(s["pattern_counts"].items(), key=lambda kn: (-kn[1], kn[0] or "")):
        yield f"  {d.PATTERN_RU.get(k, k)}: {n}"
    for k, r in enumerate(findings.orderBy(*ORDER).toLocalIterator(), 1):
        yield f"{k}. {r['file_path']}:{r['line_number']} [{d.SEVERITY_RU.get(r['severity'], r['severity'])}] {d.DESCRIPTION_RU.get(r['description'], r['description'])} ({r['risk_score']})"


def write_text(findings: DataFrame, path: str, metadata: dict | None = None) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(line + "\n" for line in text_lines(findings, metadata))


def write_all(findings: DataFrame, folder: str, metadata: dict | None = None) -> list[str]:
    """All three reports under one time-stamped name."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    base = Path(folder) / f"отчёт-утечки_{datetime.now():%Y%m%d_%H%M%S}"
    paths = [f"{base}.{e}" for e in ("json", "csv", "txt")]
    write_json(findings, paths[0], metadata)
    write_csv(findings, paths[1])
    write_text(findings, paths[2], metadata)
    return paths


def write_table(findings: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Findings at scale: a table partitioned by severity; json and csv keep the report's columns."""
    if fmt == "json":
        json_rows(findings).select("value").write.mode("overwrite").text(path)
    elif fmt == "csv":
        csv_rows(findings).select(*d.CSV_HEADER).write.mode("overwrite").csv(path, header=True)
    else:
        findings.write.mode("overwrite").partitionBy("severity").parquet(path)


def analysis_text(findings: DataFrame, insights: str | None = None) -> str:
    """The analysis report: totals, risk level, rankings, critical findings and recommendations."""
    s, level = stats.detailed_stats(findings).first(), stats.risk_assessment(findings).first()
    out = ["ОТЧЁТ АНАЛИЗА БЕЗОПАСНОСТИ", f"{s['total_findings']} / {s['affected_files']}", dict(d.RISK_LEVELS)[level["risk_level"]], f"{s['average_risk_score']:.1f} / {s['max_risk_score']:.1f}", ""]
    out += [f"{r['file_path']}: {r['findings']}" for r in stats.most_affected_files(findings).collect()]
    out += [f"{r['pattern_type']}: {r['n']}" for r in stats.most_frequent_patterns(findings).collect()]
    tie = "finding_id" if "finding_id" in findings.columns else "line_number"
    out += ["", *[f"{k}. {r['file_path']} {r['description']} {r['severity']} {r['risk_score']:.0f}% — {r['suggestion']}" for k, r in enumerate(stats.critical_findings(findings, tie=tie).collect(), 1)]]
    out += ["", *[f"{r['place'] + 1}. {r['recommendation']}" for r in stats.recommendations(findings).orderBy("place").collect()]]
    return "\n".join(out + ([insights] if insights else [])) + "\n"
