"""PNG files from and to images of bytes: 8 bits, grey, grey with alpha, RGB or RGBA, not interlaced."""

from __future__ import annotations

import struct
import zlib
from pathlib import Path

import numpy as np

from boardsift.operators.pixels import coerced

_HEAD = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encoded(image: np.ndarray) -> bytes:
    bgr = coerced(image)
    h, w = bgr.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), bgr[:, :, ::-1].reshape(h, -1)], 1)
    return _HEAD + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes())) + _chunk(b"IEND", b"")


def _unfiltered(rows: np.ndarray, n: int) -> np.ndarray:
    """Bytes of rows that each begin with their filter; n bytes a pixel."""
    out = np.zeros((len(rows) + 1, rows.shape[1] - 1 + n), np.uint8)
    for y, row in enumerate(rows, 1):
        kind, up = int(row[0]), out[y - 1]
        if kind > 4:
            raise ValueError("not a PNG: unknown filter")
        if kind in (0, 2):
            out[y, n:] = row[1:] + (up[n:] if kind else 0)
            continue
        line, above = [0] * n + row[1:].tolist(), up.tolist()
        for i in range(n, len(line)):
            a, b, c = line[i - n], above[i], above[i - n]
            if kind == 1:
                add = a
            elif kind == 3:
                add = (a + b) // 2
            else:
                pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                add = a if pa <= pb and pa <= pc else b if pb <= pc else c
            line[i] = (line[i] + add) & 255
        out[y] = line
    return out[1:, n:]


def decoded(source) -> np.ndarray:
    """BGR bytes of a path, bytes, a binary file or an array; ValueError if there is no image in it."""
    if isinstance(source, np.ndarray):
        return coerced(source)
    if isinstance(source, (str, Path)):
        if not Path(source).is_file():
            raise ValueError(f"no such file: {source}")
        source = Path(source).read_bytes()
    raw = bytes(source.read() if hasattr(source, "read") else source)
    if not raw.startswith(_HEAD):
        raise ValueError("not a PNG" if raw else "empty")
    try:
        at, head, body = len(_HEAD), b"", []
        while at < len(raw):
            (size,) = struct.unpack_from(">I", raw, at)
            kind, data = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + size]
            if struct.unpack_from(">I", raw, at + 8 + size)[0] != zlib.crc32(kind + data):
                raise ValueError("not a PNG: damaged")
            at += 12 + size
            if kind == b"IHDR":
                head = data
            elif kind == b"IDAT":
                body.append(data)
            elif kind == b"PLTE" and head[9:10] == b"\x03":
                raise ValueError("PNG with a palette")
        w, h, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
        if bits != 8 or colour not in _CHANNELS or interlaced:
            raise ValueError(f"PNG of an unsupported kind: {bits} bits, colour {colour}, interlaced {interlaced}")
        n = _CHANNELS[colour]
        rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, w * n + 1)
    except (struct.error, zlib.error) as e:
        raise ValueError(f"not a PNG: {e}") from e
    a = _unfiltered(rows, n).reshape(h, w, n)
    return coerced(a[:, :, :1] if n < 3 else a[:, :, 2::-1])
