"""python -m veilscan.cli scan DIR [--out DIR] ... | deps | help"""

from __future__ import annotations

import argparse
import shutil
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .functions import dictionaries as d
from .operators import stats
from .sinks import report
from .sources.files import ScanOptions, scan_files

TOOLS = {"tesseract": "text in images", "pdftotext": "text in PDF files", "pdftoppm": "pages of PDF files as images"}


def dependencies() -> list[tuple[str, str, bool]]:
    """(tool, use, whether it is there) of the optional programs."""
    return [(t, use, shutil.which(t) is not None) for t, use in TOOLS.items()]


def summary(findings: DataFrame, status: DataFrame, shown: int = 10) -> list[str]:
    """What the console says after a scan: counters, findings per severity, and the first reasons files were skipped for."""
    out = [str(stats.scan_counters(status).first().asDict())]
    per = {r["severity"]: r["n"] for r in stats.severity_summary(findings).collect()}  # as many as severities
    out += [f"{d.CONSOLE_SEVERITY_RU[s]} {per.get(s, 0)}" for s in stats.SEVERITIES]
    skipped = status.where("skip_reason IS NOT NULL").orderBy("file_path").limit(shown + 1).collect()
    out += [f"{r['file_path']}: {r['skip_reason']}" for r in skipped[:shown]]
    return [*out, "..."] if len(skipped) > shown else out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veilscan")
    sub = p.add_subparsers(dest="command")
    s = sub.add_parser("scan", aliases=["скан"])
    s.add_argument("dir")
    s.add_argument("--out", default=".")
    s.add_argument("--table", help="a folder for the findings as a partitioned table; nothing but counts then passes through the driver")
    s.add_argument("--max-size", type=int, default=100 << 20)
    for flag in ("docs", "archives", "images"):
        s.add_argument(f"--{flag}", action="store_true")
    s.add_argument("--preset", choices=["text", "documents", "images", "archives"])
    sub.add_parser("deps")
    sub.add_parser("help")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "deps":
        for tool, use, there in dependencies():
            print(f"{'+' if there else '-'} {tool}: {use}")
        return 0
    if args.command not in ("scan", "скан"):
        parser().print_help()
        return 0 if args.command == "help" else 1
    if not Path(args.dir).exists():
        print(f"no such directory: {args.dir}", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("veilscan").getOrCreate()
    options = ScanOptions(max_size=args.max_size, documents=args.docs, archives=args.archives, images=args.images)
    if args.preset:
        options.preset(args.preset)
    findings, status = scan_files(spark, args.dir, options)
    print(*summary(findings, status), sep="\n")
    for r in findings.orderBy(findings["risk_score"].desc(), *report.ORDER).limit(10).collect():
        print(f"{r['file_path']}:{r['line_number']} {r['pattern_type']} {r['risk_score']}")
    if args.table:
        report.write_table(findings, args.table)
        print(args.table)
        return 0
    print(*report.write_all(findings, args.out, stats.scan_counters(status).first().asDict()), sep="\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
