"""Which paths are left out: rule lists and their column predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dictionaries as d
from ..functions.scalar import extension


def glob_to_regex(glob: str) -> str:
    """** any signs, * and ? within one path part, all else literal; the whole path must match."""
    out = []
    for part in re.split(r"(\*\*|\*|\?)", glob):
        out.append({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.sub(r"([.+()|\[\]{}^$\\])", r"\\\1", part)))
    return "^" + "".join(out) + "$"


@dataclass
class IgnoreRules:
    """Directories, files and extensions by name, and globs over the whole path."""

    dirs: set[str] = field(default_factory=set)
    files: set[str] = field(default_factory=set)
    extensions: set[str] = field(default_factory=set)
    globs: list[str] = field(default_factory=list)

    @classmethod
    def default(cls) -> IgnoreRules:
        return cls(set(d.IGNORED_DIRS), set(d.IGNORED_FILES), set(d.IGNORED_EXTENSIONS))

    @classmethod
    def parse(cls, text: str) -> IgnoreRules:
        """A rule file: # comments; /x a directory name; *.e an extension; with * or ? a glob; else a file name."""
        rules = cls()
        for line in map(str.strip, text.splitlines()):
            if not line or line.startswith("#"):
                continue
            if line.startswith("/"):
                rules.dirs.add(line.rstrip("/").rsplit("/", 1)[-1])
            elif re.fullmatch(r"\*\.[^*?/]+", line):
                rules.extensions.add(line[1:].lower())
            elif "*" in line or "?" in line:
                rules.globs.append(line)
            else:
                rules.files.add(line.rsplit("/", 1)[-1])
        return rules

    def merged(self, other: IgnoreRules) -> IgnoreRules:
        return IgnoreRules(self.dirs | other.dirs, self.files | other.files, self.extensions | other.extensions, self.globs + other.globs)

    def enable(self, *kinds: str) -> IgnoreRules:
        """Documents, images or archives taken off the ignored extensions."""
        gone = {e for k in kinds for e in d.PRESETS[k]}
        return IgnoreRules(set(self.dirs), set(self.files), self.extensions - gone, list(self.globs))

    def empty(self) -> bool:
        return not (self.dirs or self.files or self.extensions or self.globs)

    def ignores_dir(self, path: str) -> bool:
        return path.rstrip("/").rsplit("/", 1)[-1] in self.dirs

    def column(self, path: Column) -> Column:
        """True for ignored paths; any part of the path may be an ignored directory. Null stays null."""
        parts = F.split(path, "/")
        out = F.lit(False)
        if self.extensions:
            out = out | extension(path).isin(*sorted(self.extensions))
        if self.files:
            out = out | F.element_at(parts, -1).isin(*sorted(self.files))
        if self.dirs:
            out = out | F.arrays_overlap(parts, F.array(*map(F.lit, sorted(self.dirs))))
        for g in self.globs:
            out = out | path.rlike(glob_to_regex(g))
        return F.when(path.isNotNull(), out)


def only_extensions(path: Column, extensions: list[str]) -> Column:
    """A whitelist; letter case and leading dots are put right; an empty list lets all through."""
    wanted = sorted({"." + e.strip().lower().lstrip(".") for e in extensions if e.strip()})
    return extension(path).isin(*wanted) if wanted else F.lit(True)


def unignored(findings: DataFrame, files: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Findings without those of ignored files (file_path) or ignored keys (file_path, line_number, pattern_type)."""
    out = findings
    if files is not None:
        out = out.join(files.select("file_path").distinct(), "file_path", "left_anti")
    if keys is not None:
        out = out.join(keys.select("file_path", "line_number", "pattern_type").distinct(), ["file_path", "line_number", "pattern_type"], "left_anti")
    return out
