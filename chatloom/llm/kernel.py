"""Vectorised word and line work on the UTF-8 bytes of an Arrow string column.

Everything here takes a whole batch of texts as one byte buffer and returns flat
numpy arrays, so that no Python loop runs per word or per line.  Words are
identified by 64-bit polynomial hashes over randomised bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

U64 = np.uint64

#: Bytes that separate words: space and 9 to 13.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def tidy() -> None:
    """Give free memory back: a worker lives on after its task, and should not keep what one batch or group has needed."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    x = np.asarray(x, dtype=U64)
    with np.errstate(over="ignore"):
        x = x + U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _class_of(pred) -> np.ndarray:
    return np.array([pred(b) for b in range(256)], dtype=bool)


#: Word bytes of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = _class_of(lambda b: b not in SPACES)
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z is lower-cased.
ALNUM = _class_of(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)
_TABLE = mix64(np.arange(256, dtype=U64) + U64(77)) | U64(1)
_P = U64(0xD6E8FEB86659FD93)
_P_INV = U64(pow(int(_P), -1, 2**64))


#: Powers that a process keeps; longer tables, for long texts, are made for one block.
KEPT = (1 << 20) + 1


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(size, _P, dtype=U64), np.full(size, _P_INV, dtype=U64)
        up[0] = down[0] = U64(1)
        return np.cumprod(up, out=up), np.cumprod(down, out=down)


@cache
def _kept() -> tuple[np.ndarray, np.ndarray]:
    return _powers(KEPT)


def _powers_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _kept() if n < KEPT else _powers(n + 1)


@dataclass
class Block:
    """Some texts of a batch: ``data`` holds their bytes, text i at ``offsets[i]`` to ``offsets[i + 1]``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8", "replace")


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 20) -> Iterator[Block]:
    """The texts of a column in blocks of about ``limit`` bytes; one longer text is a block of its own. Null counts as empty."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    done = 0
    for chunk in chunks:
        chunk = chunk.cast(pa.large_binary())
        if chunk.null_count:
            chunk = chunk.fill_null(b"")
        n = len(chunk)
        if not n:
            continue
        offsets = np.frombuffer(chunk.buffers()[1], dtype=np.int64, count=n + 1 + chunk.offset)[chunk.offset :]
        raw = chunk.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            end = min(n, max(at + 1, end))
            yield Block(done + at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
            at = end
        done += n
    tidy()


@dataclass
class Words:
    """Words of a block: byte ``start`` and ``end``, ``doc`` (index in the block), ``hash``; text i has words ``first[i]`` to ``first[i + 1]``."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def spans(block: Block, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes under ``mask``; no run crosses the end of a text."""
    n = len(block.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, dtype=bool)
    cut[block.offsets] = True
    begins = mask.copy()
    begins[1:] &= ~mask[:-1] | cut[1:n]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:] | cut[1:n]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def running(data: np.ndarray) -> np.ndarray:
    """Sums from which :func:`range_hashes` takes the hash of any range of ``data``."""
    up, _ = _powers_for(len(data))
    with np.errstate(over="ignore"):
        sums = np.empty(len(data) + 1, dtype=U64)
        sums[0] = 0
        np.cumsum(_TABLE[data] * up[: len(data)], out=sums[1:])
    return sums


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each byte range; equal bytes have equal hashes wherever they stand."""
    if not len(start):
        return np.zeros(0, U64)
    _, down = _powers_for(len(data))
    sums = running(data) if sums is None else sums
    with np.errstate(over="ignore"):
        h = (sums[end] - sums[start]) * down[start]
    return mix64(h ^ (end - start).astype(U64))


def words(block: Block, byte_class: np.ndarray = NOT_SPACE, sums: tuple[np.ndarray, np.ndarray] | None = None, hashed: bool = True) -> Words:
    """Words of A-Z lower-cased texts, as maximal runs of ``byte_class``; ``sums``: the lowered bytes and their running sums, if known."""
    low, run = sums if sums else (lowered(block.data), None)
    start, end = spans(block, byte_class[low])
    first = np.searchsorted(start, block.offsets)
    doc = np.repeat(np.arange(len(block)), np.diff(first))
    return Words(start, end, range_hashes(low, start, end, run) if hashed else np.zeros(0, U64), doc, first)


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside a text; a shorter text, if not empty, has its whole run.

    Returns (hash, doc, first word); ordered by text, then position.
    """
    count = np.diff(w.first)
    n = np.where(count >= size, count - size + 1, (count > 0).astype(count.dtype))
    doc = np.repeat(np.arange(len(count)), n)
    begin = np.cumsum(n) - n
    at = w.first[:-1][doc] + (np.arange(len(doc)) - begin[doc])
    up, down = _powers_for(len(w.hash) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(w.hash) + 1, dtype=U64)
        sums[0] = 0
        np.cumsum(w.hash * up[: len(w.hash)], out=sums[1:])
        end = np.minimum(at + size, w.first[1:][doc])
        h = (sums[end] - sums[at]) * down[at]
    return mix64(h ^ mix64((end - at).astype(U64))), doc, at


def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique(key, return_inverse=True)`` of numbers from 0, by one sort of numbers that hold a key's first bits and its place."""
    k, n = key.astype(np.uint64, copy=False), len(key)
    bits = max(1, n.bit_length())
    drop = max(0, int(k.max()).bit_length() + bits - 64) if n else 0
    packed = np.sort((k >> np.uint64(drop)) << np.uint64(bits) | np.arange(n, dtype=np.uint64))
    order = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
    ordered = k[order]
    if drop and (ordered[1:] < ordered[:-1]).any():  # keys that differ in the last bits only
        return np.unique(key, return_inverse=True)
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])[:n]
    place = np.empty(n, np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new].astype(key.dtype, copy=False), place
