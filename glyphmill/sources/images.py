"""Pixels: repacking to RGBA, PNG encoding, data URLs."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def to_rgba(data: bytes, width: int, height: int, channels: int, order: str = "rgb") -> bytes:
    """Gray, three or four channels (``bgr`` swaps red and blue) to RGBA; missing alpha is opaque; short data are filled with zeros."""
    n = width * height
    raw = np.zeros(n * channels, np.uint8)
    got = np.frombuffer(data, np.uint8)[: n * channels]
    raw[: len(got)] = got
    px = raw.reshape(n, channels)
    out = np.full((n, 4), 255, np.uint8)
    if channels == 1:
        out[:, :3] = px
    else:
        out[:, :3] = px[:, 2::-1] if order == "bgr" else px[:, :3]
        if channels == 4:
            out[:, 3] = px[:, 3]
    return out.tobytes()


def to_png(rgba: bytes, width: int, height: int) -> bytes:
    rows = b"".join(b"\0" + rgba[y * width * 4 : (y + 1) * width * 4] for y in range(height))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def png_of(data: Column, width: Column, height: Column, channels: Column, order: str = "rgb") -> Column:
    """PNG bytes of raw pixels; null where they are null or empty."""

    @F.pandas_udf("binary")
    def png(d: pd.Series, w: pd.Series, h: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([to_png(to_rgba(bytes(a), int(b), int(e), int(f), order), int(b), int(e)) if a is not None and b > 0 and e > 0 else None for a, b, e, f in zip(d, w, h, c, strict=True)], dtype=object)

    return png(data, width, height, channels)
