"""Frequent hashes by shard: hashes travel as packed numbers of many texts, not as a row each; what a shard finds comes back by place."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.runtime import ship

#: kind 0: hashes and where they are, to be counted; 1: places that are known to be frequent; 2: hashes that are known to be frequent.
_COUNT, _PLACES, _HASHES = 0, 1, 2
_DEALT = "shard int, kind int, keys binary, ts binary, sizes binary, gaps binary"
#: Bytes that are kept of a hash within its shard and of a text.
KEY_BYTES, TEXT_BYTES = 6, 5


def _low(a: np.ndarray, width: int) -> bytes:
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _of_low(raw: bytes, width: int) -> np.ndarray:
    a = np.zeros((len(raw) // width, 8), np.uint8)
    a[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return a.view("<i8").reshape(-1)


def _small(a: np.ndarray) -> bytes:
    """Mostly small numbers: their lowest bytes together, then the next."""
    return zlib.compress(a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _of_small(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any column."""
    new = np.ones(columns[0].size, bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _rows(kind: int, shard: np.ndarray, keys: np.ndarray | None, text: np.ndarray | None, t: np.ndarray | None, place: np.ndarray | None) -> Iterator[tuple]:
    """A row for each shard of entries that are sorted by shard, text and place."""
    cuts = _starts(shard)
    for a, b in zip(cuts, [*cuts[1:], shard.size], strict=True):
        packed = None if keys is None else _low(keys[a:b], KEY_BYTES)
        if text is None:
            yield int(shard[a]), kind, packed, None, None, None
            continue
        first = _starts(text[a:b])
        gaps = np.diff(place[a:b], prepend=0)
        gaps[first] = place[a:b][first]
        yield int(shard[a]), kind, packed, _low(t[a:b][first], TEXT_BYTES), _small(np.diff(first, append=b - a)), _small(gaps)


def _dealer(shards: int, threshold: int):
    """Entries of a batch by shard; hashes that one batch makes frequent are told once, so that no shard gets all of their places."""

    def run(batches):
        for batch in batches:
            ts, lists = batch.column(0).to_numpy(), batch.column(1)
            h, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            if not h.size:
                continue
            text = np.repeat(np.arange(sizes.size), sizes)
            place = np.arange(h.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            shard = ((h.view(np.uint64) >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
            values, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
            known = (count > threshold)[inverse]
            at = np.flatnonzero(~known)
            at = at[np.argsort(shard[at], kind="stable")]
            rows = list(_rows(_COUNT, shard[at], h[at], text[at], ts[text[at]], place[at])) if at.size else []
            if known.any():
                t, p = ts[text[known]], place[known]
                order = np.lexsort((p, t, t % shards))
                t, p = t[order], p[order]
                once = _starts(t, p)  # of equal texts of a batch one
                rows += _rows(_PLACES, t[once] % shards, None, t[once], t[once], p[once])
                told = values[count > threshold]
                own = ((told.view(np.uint64) >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(own, kind="stable")
                rows += _rows(_HASHES, own[order], told[order], None, None, None)
            kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "kind", "keys", "ts", "sizes", "gaps"])

    return run


def _where(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Texts and places of all entries."""
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.concatenate([_of_small(r["sizes"]) for r in rows])
    gaps = np.concatenate([_of_small(r["gaps"]) for r in rows])
    ts = _of_low(b"".join(r["ts"] for r in rows), TEXT_BYTES)
    first, to = np.cumsum(sizes) - sizes, np.cumsum(gaps)
    return np.repeat(ts, sizes), to - np.repeat(to[first] - gaps[first], sizes)


def _counter(threshold: int):
    def count(table: pa.Table) -> pa.Table:
        rows = table.select(["kind", "keys", "ts", "sizes", "gaps"]).to_pylist()
        counted, known, told = ([r for r in rows if r["kind"] == k] for k in (_COUNT, _PLACES, _HASHES))
        keys = _of_low(b"".join(r["keys"] for r in counted), KEY_BYTES)
        ordered = np.sort(keys)
        often = ordered[threshold:][ordered[threshold:] == ordered[: max(0, keys.size - threshold)]]
        del ordered
        often = np.unique(np.concatenate([often, _of_low(b"".join(r["keys"] for r in told), KEY_BYTES)]))
        hot = np.zeros(keys.size, bool)
        if often.size:
            hot = often[np.minimum(np.searchsorted(often, keys), often.size - 1)] == keys
        del keys
        found, at = [_where(known)], 0
        for r in counted:  # one by one: most places are dropped
            t, place = _where([r])
            mine = hot[at : at + t.size]
            found.append((t[mine], place[mine]))
            at += t.size
        t, place = (np.concatenate(parts) for parts in zip(*found, strict=True))
        order = np.lexsort((place, t))
        t, place = t[order], place[order]
        once = _starts(t, place)
        t, place = t[once], place[once]
        first = _starts(t)
        places = pa.ListArray.from_arrays(pa.array(np.append(first, t.size), pa.int32()), pa.array(place, pa.int32()))
        return pa.table({"t": pa.array(t[first], pa.int64()), "places": places})

    return count


def frequent_places(hashes: DataFrame, shards: int, threshold: int) -> DataFrame:
    """t, places of ``hashes`` (t: a number below 2^40, hs: array of longs): all places in ``hs`` whose value occurs more than
    ``threshold`` times in all rows, repeats counted, and perhaps a few more, since ``KEY_BYTES`` of a hash are compared.

    ``shards`` should grow with the input: the hashes of one are counted in one task.
    """
    ship(hashes.sparkSession)
    dealt = hashes.select("t", "hs").mapInArrow(_dealer(shards, threshold), _DEALT)
    found = dealt.groupBy("shard").applyInArrow(_counter(threshold), "t long, places array<int>")
    return found.groupBy("t").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
