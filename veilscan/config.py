"""Settings on disk: options with bounds, recently used folders, ignored findings; driver-side JSON."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.ignore import unignored

UNITS = {"": 1, "B": 1, "K": 1 << 10, "KB": 1 << 10, "M": 1 << 20, "MB": 1 << 20, "G": 1 << 30, "GB": 1 << 30, "T": 1 << 40, "TB": 1 << 40}


def parse_size(text: str) -> int:
    """Bytes of a number with a unit such as 50MB; an unknown unit counts as bytes, no number as 0."""
    m = re.match(r"\s*(\d+)\s*([A-Za-z]*)", text)
    return int(m[1]) * UNITS.get(m[2].upper(), 1) if m else 0


def size_text(n: int) -> str:
    """A readable size: digits grouped below 1 KB, two decimals at most above, cut and not rounded."""
    if n < 1024:
        return f"{n:,} B"
    value, unit = float(n), ""
    for unit in ("KB", "MB", "GB", "TB"):
        value /= 1024
        if value < 1024:
            break
    cut = int(value * 100)
    return f"{cut // 100:,}" + (f".{cut % 100:02d}" if cut % 100 else "") + f" {unit}"


@dataclass
class Settings:
    max_file_size: int = 100 << 20
    concurrency: int = 16
    window_width: int = 1200
    window_height: int = 800
    documents: bool = False
    archives: bool = False
    images: bool = False
    recent: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Settings:
        """Defaults where the file is missing or damaged, or lacks a value."""
        try:
            raw = json.loads(Path(path).read_text(encoding="utf-8"))
            known = {f.name for f in fields(cls)}
            return cls(**{k: v for k, v in raw.items() if k in known}).clamped()
        except (OSError, ValueError, AttributeError, TypeError):
            return cls()

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), ensure_ascii=False, indent=2), encoding="utf-8")

    def clamped(self) -> Settings:
        self.max_file_size = min(max(self.max_file_size, 1 << 10), 1 << 30)
        self.concurrency = min(max(self.concurrency, 1), 64)
        self.window_width, self.window_height = max(self.window_width, 800), max(self.window_height, 600)
        return self

    def used(self, folder: str, most: int = 10) -> Settings:
        """The folder first among the recently used, each once."""
        self.recent = [folder, *[r for r in self.recent if r != folder]][:most]
        return self


class IgnoreState:
    """Ignored files and findings, kept in a JSON file that each change rewrites."""

    def __init__(self, path: str):
        self.path, self.files, self.keys = Path(path), set(), set()
        try:
            raw = json.loads(self.path.read_text(encoding="utf-8"))
            self.files, self.keys = set(raw.get("files", [])), {tuple(k) for k in raw.get("findings", [])}
        except (OSError, ValueError, AttributeError):
            pass

    def _saved(self) -> IgnoreState:
        self.path.write_text(json.dumps({"files": sorted(self.files), "findings": sorted(self.keys)}, ensure_ascii=False), encoding="utf-8")
        return self

    def ignore_file(self, path: str) -> IgnoreState:
        self.files.add(path)
        return self._saved()

    def ignore_finding(self, path: str, line: int, kind: str) -> IgnoreState:
        self.keys.add((path, line, kind))
        return self._saved()

    def restore_finding(self, path: str, line: int, kind: str) -> IgnoreState:
        self.keys.discard((path, line, kind))
        return self._saved()

    def restore(self, path: str) -> IgnoreState:
        """The file and all of its findings."""
        self.files.discard(path)
        self.keys = {k for k in self.keys if k[0] != path}
        return self._saved()

    def clear(self) -> IgnoreState:
        self.files, self.keys = set(), set()
        return self._saved()

    def counts(self) -> tuple[int, int]:
        return len(self.files), len(self.keys)

    def applied(self, spark: SparkSession, findings: DataFrame) -> DataFrame:
        files = spark.createDataFrame([(f,) for f in sorted(self.files)], "file_path string")
        keys = spark.createDataFrame(sorted(self.keys), "file_path string, line_number int, pattern_type string")
        return unignored(findings, files, keys)


def selected(findings: DataFrame, paths: list[str]) -> DataFrame:
    """The files of a stated list with their findings, gathered per file only for that list."""
    rows = F.struct("line_number", "pattern_type", "severity", "matched_text", "risk_score")
    return findings.where(F.col("file_path").isin(*paths)).groupBy("file_path").agg(F.sort_array(F.collect_list(rows)).alias("findings"))
