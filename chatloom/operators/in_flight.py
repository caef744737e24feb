"""Requests in flight: a bounded window of them in each task, spread over ports by how busy these are, answered in the rows' order."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any

import pyarrow as pa

#: Results that may wait for an earlier row, as a multiple of the window.
AHEAD = 8


class Ports:
    """Ports of one service; a request takes the one with the fewest requests in flight, the first of several."""

    def __init__(self, ports: list[int]):
        self.ports, self.counts, self._lock = list(ports), [0] * len(ports), threading.Lock()

    @contextmanager
    def one(self) -> Iterator[int]:
        with self._lock:
            i = self.counts.index(min(self.counts))
            self.counts[i] += 1
        try:
            yield self.ports[i]
        finally:
            with self._lock:
                self.counts[i] -= 1


def in_order(items: Iterator, work: Callable[[Any], Any], window: int) -> Iterator:
    """``work(item)`` of each item, in their order; at most ``window`` at a time, and bounded many beyond the oldest one that is not done."""
    if window <= 1:
        yield from map(work, items)
        return
    pool, waiting = ThreadPoolExecutor(window), deque()
    try:
        for item in items:
            waiting.append(pool.submit(work, item))
            while waiting and (len(waiting) >= AHEAD * window or waiting[0].done()):
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()
    finally:
        pool.shutdown(wait=True, cancel_futures=True)


def answered(batches: Iterator[pa.RecordBatch], columns: list[str], work: Callable[[tuple], Any], window: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Each batch with ``work`` of its rows' ``columns``; the window reaches over batches."""
    held: deque[pa.RecordBatch] = deque()

    def rows() -> Iterator[tuple]:
        for b in batches:
            held.append(b)
            yield from zip(*(b[c].to_pylist() for c in columns), strict=True)

    got: list = []
    for result in in_order(rows(), work, window):
        while not held[0].num_rows:
            yield held.popleft(), []
        got.append(result)
        if len(got) == held[0].num_rows:
            yield held.popleft(), got
            got = []
    while held:
        yield held.popleft(), []
