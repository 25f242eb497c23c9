"""Text out of file bytes, by format; standard library only. Used inside executors, one file at a time."""

from __future__ import annotations

import codecs
import contextlib
import gzip
import io
import re
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import IO

BLOCK = 16 << 20  # bytes read, and signs of a piece of text
MEMBER_LIMIT = 100 << 20  # bytes; larger members of zip and tar archives are left out, those of compressed tar archives are not
#: Extensions of members that are read as text (fixed values).
ZIP_TEXT = {".txt", ".md", ".json", ".xml", ".yaml", ".yml", ".env", ".cfg", ".conf", ".ini"}
TAR_TEXT = {".txt", ".md", ".rst", ".json", ".xml", ".yaml", ".yml", ".csv", ".env", ".cfg", ".conf", ".ini", ".log", ".sql", ".py", ".js", ".ts", ".go", ".java", ".c", ".cpp", ".h", ".sh", ".bash", ".zsh", ".html", ".htm", ".css"}
PLAIN = {".txt", ".md", ".json", ".xml", ".yaml", ".yml", ".csv", ".log"}
OCR_IMAGES = {".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".tif"}
FORMATS = ["PDF", "DOCX", "DOC", "XLSX", "XLS", "ZIP", "TAR", "GZIP/TGZ", "plain text"]
PRINTABLE = bytes([9, 10, 13, *range(32, 127)])
AS_BLANKS = bytes(b if b in PRINTABLE else 32 for b in range(256))


class Unsupported(ValueError):
    """No extractor for this format."""


def ending(name: str) -> str:
    base = name.rsplit("/", 1)[-1]
    return base[base.rindex(".") :].lower() if "." in base else ""


def printable(data: bytes) -> bool:
    return len(data) > 0 and sum(data.count(b) for b in PRINTABLE) / len(data) > 0.7


def _decoded(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def pdf(data: bytes) -> str:
    """Strings shown by Tj and TJ inside text objects, then streams that are readable as they stand."""
    shown: list[bytes] = []
    for block in re.findall(rb"BT.*?ET", data, re.S):
        shown += re.findall(rb"\((.*?)\)\s*Tj", block)
        for array in re.findall(rb"\[(.*?)\]\s*TJ", block):
            shown += re.findall(rb"\((.*?)\)", array)
    shown += [s for s in re.findall(rb"stream\s*(.*?)\s*endstream", data, re.S) if printable(s)]
    return _decoded(b" ".join(shown))


def _parts(data: bytes, wanted: Callable[[str], bool]) -> list[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [(i.filename, z.read(i)) for i in z.infolist() if wanted(i.filename) and i.file_size <= MEMBER_LIMIT]


def docx(data: bytes) -> str:
    """Runs of the document, headers and footers; runs without a separator, parts on lines of their own."""
    parts = _parts(data, lambda n: n == "word/document.xml" or re.match(r"word/(?:header|footer)[^/]*\.xml$", n) is not None)
    return "\n".join("".join(t for t in re.findall(r"<w:t[^>]*>([^<]*)</w:t>", _decoded(p)) if t.strip()) for _, p in parts)


def xlsx(data: bytes) -> str:
    """Shared strings, then the values of all sheets, on one line."""
    parts = dict(_parts(data, lambda n: n == "xl/sharedStrings.xml" or n.startswith("xl/worksheets/")))
    words = re.findall(r"<t[^>]*>([^<]*)</t>", _decoded(parts.pop("xl/sharedStrings.xml", b"")))
    for sheet in parts.values():
        words += re.findall(r"<v>([^<]*)</v>", _decoded(sheet))
    return " ".join(words)


def doc(data: bytes) -> str:
    """Runs of more than ten printable bytes."""
    return " ".join(r.decode("ascii") for r in re.findall(rb"[\x20-\x7e\n\r\t]{11,}", data))


def xls(data: bytes) -> str:
    return data.translate(AS_BLANKS).decode("ascii")


def _member(name: str, text: str) -> str:
    return f"=== {name} ===\n{text}"


def zipped(data: bytes) -> str:
    """Text members and nested documents, each under its name; a locked member leaves one line."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for i in z.infolist():
            if i.is_dir():
                continue
            if i.flag_bits & 1:
                out.append(f"[encrypted member: {i.filename}]")
            elif i.file_size <= MEMBER_LIMIT and ending(i.filename) in ZIP_TEXT | {".docx"}:
                try:
                    raw = z.read(i)
                except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, OSError):
                    continue  # a damaged member; the others are read
                out.append(_member(i.filename, docx(raw) if ending(i.filename) == ".docx" else _decoded(raw)))
    return "\n\n".join(out)


def _blocks(f: IO[bytes]) -> Iterator[str]:
    """Decoded text of a file, a block at a time."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    while block := f.read(BLOCK):
        yield decoder.decode(block)
    yield decoder.decode(b"", True)


def _members(data: bytes, mode: str, most: int | None) -> Iterator[str]:
    sep = ""
    with tarfile.open(fileobj=io.BytesIO(data), mode=mode) as t:
        for m in _until_damaged(t):
            if m.isfile() and (most is None or m.size <= most) and ending(m.name) in TAR_TEXT:
                yield sep + _member(m.name, "")
                yield from _blocks(t.extractfile(m))
                sep = "\n\n"


def _until_damaged(t: tarfile.TarFile) -> Iterator[tarfile.TarInfo]:
    """Members of an archive; one that is cut off ends them, and those before it count."""
    members = iter(t)
    while True:
        try:
            m = next(members)
            if m.isfile() and t.fileobj is not None:
                with contextlib.closing(t.extractfile(m)) as f:  # a member that is cut off raises here
                    while f.read(BLOCK):
                        pass
            yield m
        except (StopIteration, EOFError, OSError, zlib.error, tarfile.TarError):
            return


def tarred(data: bytes) -> str:
    return "".join(_members(data, "r:", MEMBER_LIMIT))


def _unzipped(data: bytes, name: str) -> Iterator[str]:
    """The whole text of a .gz, or of the members of a compressed tar archive, whatever its size, a block at a time."""
    if name.endswith((".tar.gz", ".tgz")):
        yield from _members(data, "r:gz", None)
    else:
        with gzip.GzipFile(fileobj=io.BytesIO(data)) as g:
            yield from _blocks(g)


def gzipped(data: bytes, name: str) -> str:
    return "".join(_unzipped(data, name))


def _by_lines(blocks: Iterator[str]) -> Iterator[tuple[int, str]]:
    """(lines before, text): the blocks cut anew at ends of lines, the ends left out; a line is never cut."""
    before, held, size = 0, [], 0
    for block in blocks:
        held.append(block)
        size += len(block)
        if size >= BLOCK and "\n" in block:
            whole, _, rest = "".join(held).rpartition("\n")
            yield before, whole
            before, held, size = before + whole.count("\n") + 1, [rest], len(rest)
    yield before, "".join(held)


def pieces_of(name: str, data: bytes, ocr: Callable[[bytes], str] | None = None) -> Iterator[tuple[int, str]]:
    """(lines before, text) of the text of a file, in pieces where it may be far larger than the file. Such a file is read
    twice, so that a damaged one raises before its first piece."""
    if ending(name) not in (".gz", ".tgz"):
        yield 0, text_of(name, data, ocr)
        return
    for _ in _unzipped(data, name):
        pass
    yield from _by_lines(_unzipped(data, name))


def text_of(name: str, data: bytes, ocr: Callable[[bytes], str] | None = None) -> str:
    """The text of a file by the extension of its name; OCR only through a given callable."""
    by = {".pdf": pdf, ".docx": docx, ".doc": doc, ".xlsx": xlsx, ".xls": xls, ".zip": zipped, ".tar": tarred}
    e = ending(name)
    if e in by:
        text = by[e](data)
        return ocr(data) if e == ".pdf" and not text.strip() and ocr else text
    if e in (".gz", ".tgz"):
        return gzipped(data, name)
    if e in PLAIN:
        return _decoded(data)
    if e in OCR_IMAGES and ocr:
        return ocr(data)
    raise Unsupported(e or name)
