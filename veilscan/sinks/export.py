"""Archives of selected files and their passwords; driver-side, outside the DataFrame plan; and tables of texts as files."""

from __future__ import annotations

import os
import secrets
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "!@#$%^&*()-_=+[]{}"


@dataclass
class ExportStats:
    files: int
    total_size: int
    archive_size: int

    @property
    def ratio(self) -> float:
        return self.archive_size / self.total_size if self.total_size else 0.0


def texts_as_files(texts: DataFrame, name_col: str, text_col: str, folder: str) -> int:
    """Every text of a table as a file of its own in a folder the executors share; returns their number. Null texts have
    none. Names must be unique; a task that runs again writes the same files again."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, text in zip(batch["name"], batch["text"]):
                system.create_dir(os.path.dirname(f"{path}/{name}"))
                with system.open_output_stream(f"{path}/{name}") as f:
                    f.write(text.encode("utf-8", "replace"))
            yield pd.DataFrame({"n": [len(batch)]})

    rows = texts.where(F.col(text_col).isNotNull()).select(F.col(name_col).cast("string").alias("name"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def generate_password(length: int = 32, symbols: bool = True) -> str:
    """Of 8 to 128 signs, each drawn evenly."""
    signs = string.ascii_letters + string.digits + (SYMBOLS if symbols else "")
    return "".join(secrets.choice(signs) for _ in range(min(max(length, 8), 128)))


def valid_password(password: str) -> bool:
    return len(password) >= 4


def _members(paths: list[str]) -> Iterator[tuple[str, str]]:
    for p in paths:
        if not os.path.exists(p):
            raise FileNotFoundError(p)
        if os.path.isdir(p):
            base = os.path.basename(os.path.normpath(p))
            for at, _, files in os.walk(p):
                for f in sorted(files):
                    full = os.path.join(at, f)
                    yield full, os.path.join(base, os.path.relpath(full, p))
        else:
            yield p, os.path.basename(p)


def export(paths: list[str], archive: str, password: str, writer: Callable | None, cancelled: Callable[[], bool] = lambda: False) -> ExportStats:
    """An encrypted archive of files and folders.

    The standard library cannot write AES archives, so the caller gives the writer: writer(archive, password) opens an
    object with add(path, name) and close(). Without one nothing is written. A missing file fails at once; an archive
    that fails or is cancelled is removed.
    """
    if writer is None:
        raise ValueError("an encrypting archive writer is needed")
    if not valid_password(password):
        raise ValueError("the password is too short")
    members = list(_members(paths))
    out, done, size = writer(archive, password), 0, 0
    try:
        for path, name in members:
            if cancelled():
                raise InterruptedError("cancelled")
            out.add(path, name)
            done, size = done + 1, size + os.path.getsize(path)
        out.close()
    except BaseException:
        if os.path.exists(archive):
            os.remove(archive)
        raise
    return ExportStats(done, size, os.path.getsize(archive))
