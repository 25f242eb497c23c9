"""What can be told of an image file without reading its pixels: its sides, and the text that stands in its bytes."""

from __future__ import annotations

import struct

#: Markers of JPEG frames that hold the sides (fixed values).
JPEG_FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
BLANKS = bytes(32 if b in (9, 10, 13) else b for b in range(256))
UNREADABLE = bytes(b for b in range(256) if not 32 <= b <= 126 and b not in (9, 10, 13))


def sides(data: bytes) -> tuple[int | None, int | None]:
    """(width, height) from the header of a PNG, GIF or JPEG; nulls where it is another or a damaged file."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data):
        if data[at] != 0xFF:
            break
        marker = data[at + 1]
        if marker == 0xFF or 0xD0 <= marker <= 0xD9 or marker == 1:
            at += 1 if marker == 0xFF else 2
            continue
        if marker in JPEG_FRAMES:
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None, None


def readable_bytes(data: bytes) -> str:
    """The printable ASCII of a file, ends of lines and tabs as blanks; what stands for text where no reader is given."""
    return data.translate(BLANKS, UNREADABLE).decode("ascii")
