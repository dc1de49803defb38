"""Sides of images from the first bytes of their files: pixels aren't decoded."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def sides(data: bytes | None) -> tuple[int, int] | None:
    """(width, height) of a PNG, GIF, BMP or JPEG file; None for anything else."""
    data = bytes(data or b"")
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
            return struct.unpack(">II", data[16:24])
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", data[6:10])
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return w, abs(h)
        if data[:2] == b"\xff\xd8":
            at = 2
            while data[at] == 0xFF:
                kind = data[at + 1]
                if kind == 0xFF:  # a fill byte
                    at += 1
                elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame's header
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return w, h
                elif kind == 0x01 or 0xD0 <= kind <= 0xD7:
                    at += 2
                else:
                    at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    except (struct.error, IndexError):
        return None
    return None


@F.pandas_udf(StructType().add("width", "long").add("height", "long"))
def _sides(data: pd.Series) -> pd.DataFrame:
    found = [sides(x) or (None, None) for x in data]
    return pd.DataFrame(found, columns=["width", "height"]).astype("Int64")


def image_size(data: Column) -> Column:
    """(width, height) of an image file's bytes, both null if they can't be told."""
    return _sides(data)
