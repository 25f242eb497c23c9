"""Directory trees as DataFrames: listing with pruning, routing, and texts of files."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dictionaries import ARCHIVE_EXTENSIONS, DOCUMENT_EXTENSIONS, IMAGE_EXTENSIONS, PRESETS
from ..operators import image, scan
from ..operators.ignore import IgnoreRules, only_extensions
from . import extract, images

LISTED = "path string, length long"
READ = "path string, length long, route string, scan_status string, skip_reason string, text string, part int, lines_before long, page int, width int, height int, seen string"
READ_COLUMNS = [c.split()[0] for c in READ.split(", ")]
IGNORE_FILE = ".veilscan-ignore"


@dataclass
class ScanOptions:
    max_size: int = 100 << 20
    documents: bool = False
    archives: bool = False
    images: bool = False
    only: list[str] = field(default_factory=list)
    rules: IgnoreRules | None = None
    ocr: Callable[[bytes], str] | None = None
    pdf_pages: Callable[[bytes], Iterable[tuple[int, bytes]]] | None = None
    partitions: int = 0

    def preset(self, name: str) -> ScanOptions:
        """A whitelist by kind of file; documents, images and archives are switched on with it."""
        self.only = list(PRESETS[name])
        if name != "text":
            setattr(self, name, True)
        return self

    def clamped(self) -> ScanOptions:
        """Sizes between 1 KiB and 1 GiB."""
        self.max_size = min(max(self.max_size, 1 << 10), 1 << 30)
        return self

    def ignore_rules(self, root: str) -> IgnoreRules:
        rules = self.rules or IgnoreRules.default()
        on = [k for k in ("documents", "images", "archives") if getattr(self, k)]
        rules = rules.enable(*on) if on else rules
        path = os.path.join(root, IGNORE_FILE)
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                rules = rules.merged(IgnoreRules.parse(f.read()))
        return rules


def _walk(top: str, rules: IgnoreRules) -> Iterator[tuple[str, int]]:
    """Files below a directory, ignored directories pruned; links to directories are not followed."""
    for at, dirs, files in os.walk(top):
        dirs[:] = [d for d in dirs if not rules.ignores_dir(d)]
        for name in files:
            path = os.path.join(at, name)
            try:
                yield path, os.stat(path).st_size
            except OSError:
                yield path, -1


def listed(spark: SparkSession, root: str, options: ScanOptions) -> DataFrame:
    """(path, length) of all files that no rule ignores, hidden ones included.

    The driver lists two levels; every subtree below is walked by a task. A root that cannot be read gives no rows.
    """
    rules = options.ignore_rules(root)
    files, tops = [], []
    try:
        level = [e for e in os.scandir(root)]
    except OSError:
        level = []
    for e in level:
        if not e.is_dir(follow_symlinks=False):
            files.append((e.path, e.stat().st_size if e.is_file() else -1))
        elif not rules.ignores_dir(e.name):
            for f in os.scandir(e.path):
                if f.is_dir(follow_symlinks=False):
                    if not rules.ignores_dir(f.name):
                        tops.append(f.path)
                else:
                    files.append((f.path, f.stat().st_size if f.is_file() else -1))

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for top in batch["path"]:
                yield pd.DataFrame(list(_walk(top, rules)), columns=["path", "length"])

    here = spark.createDataFrame(files, LISTED)
    if tops:
        n = options.partitions or min(len(tops), 8 * spark.sparkContext.defaultParallelism)
        here = here.unionByName(spark.createDataFrame([(t,) for t in tops], "path string").repartition(n).mapInPandas(below, LISTED))
    return here.where(~F.coalesce(rules.column(F.col("path")), F.lit(False)))


def read(files: DataFrame, options: ScanOptions) -> DataFrame:
    """What listed files hold: path, length, route, scan_status, skip_reason, text, part, lines_before; and of images and
    of pages of a PDF page, width, height and seen, the text that is judged.

    What a gzip file holds comes in pieces of whole lines, a row each; the first row of every file is part 0.

    Whitelist and size are decided before a byte is read. Route is text, document, archive or image. A NUL in the first
    512 bytes makes a file binary, which is skipped without a reason, like a file too large or of another extension. An
    image is judged by its sides and the text a reader given by the caller finds in it, else by its readable bytes; pages
    of a PDF are judged where the caller gives a function that draws them.
    """
    ocr, pages_of, docs, archives, pictures, most = options.ocr, options.pdf_pages, options.documents, options.archives, options.images, options.max_size
    known_docs = {e for e in DOCUMENT_EXTENSIONS if e not in (".pptx", ".ppt", ".odt", ".ods", ".odp")}

    def one(path: str, length: int) -> Iterator[tuple]:
        e = extract.ending(path)
        route = "document" if e in known_docs else "archive" if e in ARCHIVE_EXTENSIONS else "image" if e in IMAGE_EXTENSIONS else "text"
        off = {"document": not docs, "archive": not archives, "image": not pictures}.get(route, False)

        def row(status: str, reason: str | None = None, text: str | None = None, part: int = 0, before: int = 0, page: int | None = None, seen: tuple = (None, None, None)) -> tuple:
            return path, length, route, status, reason, text, part, before, page, *seen

        if off:
            yield row("skipped", f"{route} scanning is off")
            return
        try:
            with open(path, "rb") as f:
                data = f.read(most + 1)
        except OSError as x:
            yield row("error", str(x))
            return
        if route == "text":
            yield row("skipped") if b"\0" in data[:512] else row("scanned", text=data.decode("utf-8", "replace"))
            return
        if route == "image":
            text, failed = None, None
            try:
                text = ocr(data) if ocr else None
            except Exception as x:  # readers raise whatever they raise; the image is judged all the same
                failed = f"extraction failed: {x}"
            yield row("scanned", failed, text=text if text and text.strip() else None, page=1, seen=(*images.sides(data), text or images.readable_bytes(data)))
            return
        if e == ".pdf" and pages_of:
            try:
                for number, drawn in pages_of(data):
                    yield row("page", part=-1, page=number, seen=(*images.sides(drawn), (ocr(drawn) if ocr else None) or images.readable_bytes(drawn)))
            except Exception:  # a PDF that cannot be drawn still has a text
                pass
        part = 0
        try:
            for before, text in extract.pieces_of(path, data, ocr):
                if text.strip():
                    yield row("scanned", text=text, part=part, before=before)
                    part += 1
        except Exception as x:  # damaged containers raise whatever their reader raises
            yield row("error", f"extraction failed: {x}")
            return
        if not part:
            yield row("skipped", "no text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, length in zip(batch["path"], batch["length"]):  # one file in memory at a time
                for row in one(path, length):
                    yield pd.DataFrame([row], columns=READ_COLUMNS).astype({"page": "Int32", "width": "Int32", "height": "Int32"})

    fits = only_extensions(F.col("path"), options.only) & (F.col("length") <= options.max_size)
    left_out = files.where(~fits).select("path", "length", F.lit(None).cast("string").alias("route"), F.lit("skipped").alias("scan_status"), F.lit(None).cast("string").alias("skip_reason"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("lines_before"), *[F.lit(None).cast(t).alias(c) for c, t in (("page", "int"), ("width", "int"), ("height", "int"), ("seen", "string"))])
    taken = files.where(fits)
    if options.partitions:
        taken = taken.repartition(options.partitions)
    return taken.mapInPandas(run, READ).unionByName(left_out)


def scan_files(spark: SparkSession, root: str, options: ScanOptions | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, file_status) of a tree. A text file with a line of 64 KiB or more is an error without findings; findings
    of archives and of the text in images carry a mark at the end of their path. An image, or a page of a PDF, that is a
    document is a critical finding itself."""
    options = (options or ScanOptions()).clamped()
    texts = read(listed(spark, root, options), options)
    long_line = (F.col("route") == "text") & scan.too_long_lines(F.col("text"))
    texts = texts.withColumn("scan_status", F.when(long_line, "error").otherwise(F.col("scan_status")))
    status = texts.where("part = 0").select(F.col("path").alias("file_path"), "scan_status", "skip_reason", F.col("length").alias("size_bytes"))
    good = texts.where("scan_status = 'scanned' AND text IS NOT NULL")
    mark = F.when(F.col("route") == "archive", F.lit(" (архив)")).when(F.col("route") == "image", F.lit(" (OCR)")).otherwise(F.lit(""))
    good = good.select(F.concat("path", mark).alias("file_path"), "route", "text", "lines_before")
    plain = scan.findings(good.where("route = 'text'"), "file_path", "text", strip_cr=True)
    pieces = good.where("route <> 'text'").select(F.struct("file_path", "lines_before").alias("piece"), "text")
    extracted = scan.findings(pieces, "piece", "text").withColumn("line_number", (F.col("line_number") + F.col("piece.lines_before")).cast("int"))
    found = plain.unionByName(extracted.withColumn("piece", F.col("piece.file_path")).withColumnRenamed("piece", "file_path"))
    if options.images or options.pdf_pages:
        judged = image.judged(texts.where("seen IS NOT NULL"), "path", "width", "height", "seen", keep=("route", "page"))
        documents = [image.document_findings(judged.where("route = 'image'"), "path", F.col("path")), image.document_findings(judged.where("route = 'document'"), "path", F.col("path"), F.col("page"))]
        for some in documents:
            found = found.unionByName(some.select([c for c in some.columns if c in found.columns]), allowMissingColumns=True)
    return found, status
