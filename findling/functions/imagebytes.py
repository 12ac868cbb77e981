"""Whether stored bytes are a whole image: PNG, JPEG and GIF read block by block, without decoding pixels.

A fault is what a decoder would meet first: an unknown or empty file, a header out of range, a block cut short, a bad
checksum, data that does not unpack to its rows, a missing end.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

PNG, GIF = b"\x89PNG\r\n\x1a\n", (b"GIF87a", b"GIF89a")
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  #: of PNG's colour types
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}  #: JPEG markers of a frame's header
Found = tuple[str | None, int | None, int | None, str | None]


class Cut(Exception):
    """The bytes end too early."""


def _take(data: memoryview, at: int, n: int) -> memoryview:
    if at + n > len(data):
        raise Cut
    return data[at : at + n]


def png_chunks(data: memoryview) -> Iterator[tuple[bytes, memoryview, bool]]:
    """(name, body, whether the checksum is right) up to the end chunk."""
    at = len(PNG)
    while True:
        size = int.from_bytes(_take(data, at, 4))
        name, body = bytes(_take(data, at + 4, 4)), _take(data, at + 8, size)
        yield name, body, zlib.crc32(_take(data, at + 4, size + 4)) == int.from_bytes(_take(data, at + 8 + size, 4))
        if name == b"IEND":
            return
        at += size + 12


def _png(data: memoryview) -> Found:
    width = height = None
    rows, unpack, got = 0, zlib.decompressobj(), 0
    try:
        for i, (name, body, right) in enumerate(png_chunks(data)):
            if not right:
                return "png", width, height, f"checksum of {name.decode('latin-1')}"
            if i == 0:
                if name != b"IHDR" or len(body) != 13:
                    return "png", None, None, "no header"
                width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
                if not width or not height or colour not in CHANNELS or depth not in (1, 2, 4, 8, 16):
                    return "png", width, height, "header out of range"
                rows = None if interlaced else height * (1 + (width * depth * CHANNELS[colour] + 7) // 8)
            elif name == b"IDAT":
                got += len(unpack.decompress(body))
    except Cut:
        return "png", width, height, "cut short"
    except zlib.error:
        return "png", width, height, "data do not unpack"
    if not unpack.eof or rows is not None and got != rows:
        return "png", width, height, "rows missing"
    return "png", width, height, None


def _jpeg(data: memoryview) -> Found:
    width = height = None
    at, raw = 2, bytes(data)
    try:
        while True:
            if _take(data, at, 1)[0] != 0xFF:
                return "jpeg", width, height, "no marker"
            marker = _take(data, at + 1, 1)[0]
            if marker == 0xFF:  # filling
                at += 1
                continue
            if marker == 0xD9:
                return "jpeg", width, height, None if width and height else "no frame"
            size = int.from_bytes(_take(data, at + 2, 2))
            body = _take(data, at + 4, size - 2) if size >= 2 else None
            if body is None:
                return "jpeg", width, height, "header out of range"
            if marker in FRAMES:
                height, width = struct.unpack(">HH", _take(body, 1, 4))
                if not width or not height:
                    return "jpeg", width, height, "header out of range"
            at += 2 + size
            if marker == 0xDA:  # coded data: up to the next marker that is no stuffed byte and no restart
                while True:
                    at = raw.find(b"\xff", at)
                    if at < 0 or at + 1 >= len(raw):
                        raise Cut
                    if raw[at + 1] == 0 or 0xD0 <= raw[at + 1] <= 0xD7:
                        at += 2
                    else:
                        break
    except Cut:
        return "jpeg", width, height, "cut short"


def _gif(data: memoryview) -> Found:
    width = height = None
    try:
        width, height, flags = struct.unpack("<HHB", _take(data, 6, 5))
        at, frames = 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), 0
        while True:
            sign = _take(data, at, 1)[0]
            if sign == 0x3B:
                return "gif", width, height, None if frames and width and height else "no frame"
            if sign == 0x2C:
                own = _take(data, at + 9, 1)[0]
                at += 11 + (3 << (own & 7) + 1 if own & 0x80 else 0)
                frames += 1
            elif sign == 0x21:
                at += 2
            else:
                return "gif", width, height, "no block"
            while n := _take(data, at, 1)[0]:
                _take(data, at + 1, n)
                at += 1 + n
            at += 1
    except Cut:
        return "gif", width, height, "cut short"


def looked_at(data: bytes | None) -> Found:
    """(format, width, height, first fault)."""
    if not data:
        return None, None, None, "empty"
    view = memoryview(data)
    if data.startswith(PNG):
        return _png(view)
    if data.startswith(b"\xff\xd8"):
        return _jpeg(view)
    if data.startswith(GIF):
        return _gif(view)
    return None, None, None, "unknown format"


@F.pandas_udf(StructType([StructField("format", StringType()), StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("fault", StringType())]))
def image_facts(content: pd.Series) -> pd.DataFrame:
    rows = pd.DataFrame([looked_at(c) for c in content], columns=["format", "width", "height", "fault"])
    return rows.astype({"width": "Int32", "height": "Int32"})
