"""Numpy arrays in one binary value, for shuffles that carry columns of numbers rather than rows."""

from __future__ import annotations

import json
import struct

import numpy as np
import zstandard

#: One compressor a process and level, and a decompressor.
_codecs: dict = {}


def _codec(level: int):
    if level not in _codecs:
        _codecs[level] = zstandard.ZstdCompressor(level=level) if level else zstandard.ZstdDecompressor()
    return _codecs[level]


def pack(level_: int = 1, **arrays: np.ndarray) -> bytes:
    """Arrays under their names; sorted unsigned integers are kept as differences, byte plane by byte plane."""
    head, body = [], []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        delta = a.dtype.kind == "u" and a.size > 1 and bool((a[1:] >= a[:-1]).all())
        b = np.concatenate([a[:1], np.diff(a)]) if delta else a
        body.append(b.view(np.uint8).reshape(-1, b.dtype.itemsize).T.tobytes() if b.size else b"")
        head.append([name, a.dtype.str, int(a.size), int(delta)])
    h = json.dumps(head).encode()
    return _codec(level_).compress(struct.pack("<I", len(h)) + h + b"".join(body))


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    raw = _codec(0).decompress(bytes(blob))
    (n,) = struct.unpack_from("<I", raw)
    at, out = 4 + n, {}
    for name, kind, size, delta in json.loads(raw[4:at]):
        dt = np.dtype(kind)
        planes = np.frombuffer(raw, np.uint8, size * dt.itemsize, at).reshape(dt.itemsize, size)
        a = np.ascontiguousarray(planes.T).view(dt).reshape(size)
        out[name] = np.cumsum(a, dtype=dt) if delta else a
        at += size * dt.itemsize
    return out
