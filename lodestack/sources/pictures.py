"""Width and height of pictures from their headers, wherever in the file these stand."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: JPEG marks that start a frame: 0xC0-0xCF without tables, extensions and arithmetic conditioning (fixed values).
_FRAMES = set(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
_JXL_BOX = b"\0\0\0\x0cJXL \r\n\x87\n"
#: Ratios of width to height of a JPEG XL header, by number (fixed values).
_RATIOS = [(1, 1), (12, 10), (4, 3), (3, 2), (16, 9), (5, 4), (2, 1)]
_PNM = re.compile(rb"P[1-6](?:\s|(?=#))(?:\s|#[^\r\n]*[\r\n])*(\d+)(?:\s|#[^\r\n]*[\r\n])+(\d+)[\s#]")


def _jpeg(b: bytes) -> tuple | None:
    at = 2
    while at + 4 <= len(b) and b[at] == 0xFF:
        mark = b[at + 1]
        if mark == 0xFF:
            at += 1
        elif mark == 1 or 0xD0 <= mark <= 0xD7:
            at += 2
        elif mark in (0xD8, 0xD9):
            return None
        elif mark in _FRAMES:
            return struct.unpack_from(">HH", b, at + 5)[::-1] if at + 9 <= len(b) else None
        else:
            at += 2 + max(2, int.from_bytes(b[at + 2 : at + 4]))
    return None


def _tiff(b: bytes) -> tuple | None:
    order = "<" if b[:2] == b"II" else ">"
    at = struct.unpack_from(order + "I", b, 4)[0]
    n = min(struct.unpack_from(order + "H", b, at)[0], 1024)
    found = {}
    for entry in range(at + 2, at + 2 + 12 * n, 12):
        tag, kind = struct.unpack_from(order + "HH", b, entry)
        if tag in (256, 257):
            found[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), b, entry + 8)[0] if kind in (3, 4) else 0
    return found.get(256, 0), found.get(257, 0)


def _boxes(b: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and end of the content of each box; one of size 0 runs to the end."""
    while at + 8 <= end:
        size, head = int.from_bytes(b[at : at + 4]), 8
        if size == 1:
            size, head = int.from_bytes(b[at + 8 : at + 16]), 16
        size = size or end - at
        if size < head:
            return
        yield b[at + 4 : at + 8], at + head, min(at + size, end)
        at += size


def _heif(b: bytes) -> tuple | None:
    """The largest of the extents that the properties in the meta box give."""
    for kind, start, end in _boxes(b, 0, len(b)):
        if kind == b"meta":
            inner = [c for k, s, e in _boxes(b, start + 4, end) if k == b"iprp" for c in _boxes(b, s, e) if c[0] == b"ipco"]
            sizes = [struct.unpack_from(">II", b, s + 4) for _, s0, e0 in inner for k, s, e in _boxes(b, s0, e0) if k == b"ispe" and e - s >= 12]
            return max(sizes, key=lambda s: s[0] * s[1], default=None)
    return None


def _jxl(b: bytes) -> tuple | None:
    if b.startswith(_JXL_BOX):
        stream = b""
        for kind, start, end in _boxes(b, 12, len(b)):
            if kind in (b"jxlc", b"jxlp"):
                stream += b[start + 4 * (kind == b"jxlp") : end][: 16 - len(stream)]
            if len(stream) >= 16:
                break
        b = stream
    if b[:2] != b"\xff\x0a":
        return None
    bits, used = int.from_bytes(b[2:16], "little"), 0

    def take(n: int) -> int:
        nonlocal used
        used += n
        return (bits >> (used - n)) & ((1 << n) - 1)

    small = take(1)
    side = lambda: (take(5) + 1) * 8 if small else take((9, 13, 18, 30)[take(2)]) + 1
    height = side()
    ratio = take(3)
    width = height * _RATIOS[ratio - 1][0] // _RATIOS[ratio - 1][1] if ratio else side()
    return (width, height) if used <= 8 * (len(b) - 2) else None


def _pnm(b: bytes) -> tuple | None:
    found = _PNM.match(b)
    return (int(found[1]), int(found[2])) if found else None


def _webp(b: bytes) -> tuple | None:
    if b[12:16] == b"VP8X":
        return 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little")
    if b[12:16] == b"VP8L":
        bits = int.from_bytes(b[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    return tuple(n & 0x3FFF for n in struct.unpack_from("<HH", b, 26))


def _bmp(b: bytes) -> tuple | None:
    width, height = struct.unpack_from("<HH" if b[14:18] == b"\x0c\0\0\0" else "<ii", b, 18)
    return width, abs(height)


#: Kinds of pictures by their first bytes (fixed values).
READERS: list[tuple[bytes, Callable]] = [
    (b"\x89PNG\r\n\x1a\n", lambda b: struct.unpack_from(">II", b, 16)),
    (b"\xff\xd8", _jpeg),
    (b"GIF8", lambda b: struct.unpack_from("<HH", b, 6)),
    (b"BM", _bmp),
    (b"qoif", lambda b: struct.unpack_from(">II", b, 4)),
    (b"farbfeld", lambda b: struct.unpack_from(">II", b, 8)),
    (b"II*\0", _tiff),
    (b"MM\0*", _tiff),
    (_JXL_BOX, _jxl),
    (b"\xff\x0a", _jxl),
]


def _size(b: bytes | None) -> tuple | None:
    b = bytes(b or b"")
    read = next((r for magic, r in READERS if b.startswith(magic)), None)
    if read is None:
        read = _heif if b[4:8] == b"ftyp" else _webp if b[:4] == b"RIFF" and b[8:12] == b"WEBP" else _pnm if b[:1] == b"P" else None
    try:
        size = read(b) if read else None
    except struct.error:  # the file ends inside its header
        return None
    return size if size and 0 < size[0] < 2**32 and 0 < size[1] < 2**32 else None


@F.pandas_udf(StructType().add("width", "long").add("height", "long"))
def picture_size(content: pd.Series) -> pd.DataFrame:
    """width and height in pixels of a picture; both null where the bytes are null, empty, cut off inside
    the header, of another kind, or say 0."""
    sizes = [_size(b) or (None, None) for b in content]
    return pd.DataFrame(sizes, columns=["width", "height"], dtype="Int64")
