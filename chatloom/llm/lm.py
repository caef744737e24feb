"""Hierarchical Pitman-Yor language model over words.

Three levels: every word and the document start is a context with a restaurant of its
own; contexts whose words end alike (a class: a hash of the last two bytes, 63
of them, and the start) share a parent restaurant; the classes share the root, whose base
is uniform over the vocabulary and one unknown token.  A context's customers are the
words that followed it in training text, and a restaurant's tables are customers of
its parent.  Seatings are sampled by Gibbs: given the rest, the
number of tables of a word in a restaurant is drawn from its exact conditional,
which sums over all seatings of its customers (generalised Stirling numbers: a table of
them up to ``EXACT`` customers, above it contour integrals over all numbers of tables
within ``TAIL`` of the mode's log weight).  A sweep takes each restaurant's words in two halves,
holding the other half and the parent's predictive fixed; the other tables of a hot context
are those at the begin of a phase.  After ``burn`` sweeps, for which each word has one
table in a parent, the parents are seated anew from the sampled tables, and ``samples``
further sweeps each give a predictive; their average scores the text.  The draw of a
context's word comes from a hash of both, so scores do not depend on partitions.

Restaurants are dealt to shards by hash, as many as keep a shard below ``shard`` tokens.
Hot contexts, by a count of all tokens, are dealt by context and word, so
that no shard holds one; their totals are summed over shards.  Counts
travel as blobs of numbers, one for each chunk of documents and shard; the parents'
words are ranges of hashes, and each exchange with them names every word and class of a shard
once.  All counts cover all training text, and every text is scored whole.

Cases: null and empty texts consist of one end token; rows with equal texts and ids
have a score each; rows without an id are learned from; without training text the
model is uniform; very long texts are scored whole, in a block of their own; an empty table
gives no row; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm import kernel
from chatloom.llm.blobs import pack, unpack
from chatloom.runtime import discard, materialise, ship, shuffle_partitions, table

U64 = kernel.U64
#: The last bits of a token are its class as a context; a document's start has one of its own.
CLASSES = 64
_CLASS = U64(CLASSES - 1)
START, END = kernel.mix64(np.array([101, 102], np.uint64)) & ~_CLASS | np.array([CLASSES - 1, 0], np.uint64)
EXACT = 192
TAIL, REACH, STEP, KNOTS = 32.0, 8.0, 0.25, 16
#: Bins of contexts, by their first bits, that are counted to find the hot ones.
BINS = 1 << 16
STATE, REPLY, SEEN, WORDS, DOCS, SEATED = range(6)
_ROW = "kind int, shard int, unit long, blob binary"


@dataclass(frozen=True)
class Settings:
    burn: int = 2
    samples: int = 2
    theta: float = 1.0
    d_class: float = 0.8
    d_root: float = 0.5
    seed: int = 7
    shard: int = 1_500_000  #: tokens


PRODUCTION = Settings()


@dataclass
class Totals:
    """What every task needs: a few numbers, and those of the hot contexts."""

    shards: int
    bins: np.ndarray  #: whether contexts of a bin are hot
    settings: Settings
    d: float = 0.5
    vocab: int = 0
    tokens: int = 0
    class_c: np.ndarray = None  #: customers and tables of classes and the root, by sample
    class_t: np.ndarray = None
    root_c: np.ndarray = None
    root_t: np.ndarray = None
    hot: np.ndarray = None  #: hot contexts, sorted; their customers and (by sample) tables over all shards
    hot_c: np.ndarray = None
    hot_t: np.ndarray = None

    def is_hot(self, u: np.ndarray) -> np.ndarray:
        return self.bins[(u >> U64(48)).astype(np.int64)]

    def hot_totals(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables (by sample) of contexts that are hot; 0 of such as have none."""
        at = np.searchsorted(self.hot, u)
        found = np.zeros(len(u), bool)
        found[at < len(self.hot)] = self.hot[at[at < len(self.hot)]] == u[at < len(self.hot)]
        c, t = np.zeros(len(u), np.int64), np.zeros((len(self.hot_t), len(u)), np.int64)
        c[found], t[:, found] = self.hot_c[at[found]], self.hot_t[:, at[found]]
        return c, t


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def stirling(d: float, most: int = EXACT) -> np.ndarray:
    """log S_d(c, t), generalised Stirling numbers, for c and t up to ``most``."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(most):
            stay = out[c] + np.log(np.maximum(c - t * d, 0.0))
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay[1:])
    return out


def _log_complement(y: np.ndarray) -> np.ndarray:
    """log(1 - exp(-y))."""
    small = y.real < 0.7
    out = np.empty_like(y)
    out[small], out[~small] = np.log(-np.expm1(-y[small])), np.log1p(-np.exp(-y[~small]))
    return out


def _saddle(log_y: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Tables for each customer at which y is the saddle point of ``log_sibuya``; log of its generating function there."""
    y = np.exp(log_y)
    log_w = _log_complement(y)
    f = -np.expm1(d * log_w)
    return f * np.exp((1 - d) * log_w + y) / d, np.log(f)


def _bisect(low: np.ndarray, high: np.ndarray, is_below, times: int) -> np.ndarray:
    for _ in range(times):
        mid = (low + high) / 2
        below = is_below(mid)
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def log_sibuya(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log of d^t t! S_d(c, t) / c!, which is the probability that t Sibuya(d) variables sum to c.

    Cauchy's integral of their generating function (1 - (1 - z)^d)^t, z = exp(-y), on a parabola of y
    through the saddle point, or on a full circle of z where nearly every customer has a table of its own.
    """
    # any point is right; nearer the branch point than 3 / c or off the saddle only costs digits
    y0 = np.exp(_bisect(np.log(3.0 / c), np.full(len(c), 3.0), lambda m: _saddle(m, d)[0] * c < t, 20))
    log_w = _log_complement(y0)
    f = -np.expm1(d * log_w)
    f1 = -d * np.exp((d - 1) * log_w - y0)
    f2 = d * np.exp((d - 1) * log_w - y0) * (1 + (1 - d) * np.exp(-y0 - log_w))
    bend = np.maximum(t * (f2 / f - (f1 / f) ** 2), 1e-300)
    scale = np.minimum(1 / np.sqrt(bend), 2 * y0)
    k = np.arange(round(REACH / STEP) + 1)
    u = 1 + 1j * (scale / (2 * y0))[:, None] * STEP * k
    y, dy = y0[:, None] * u**2, (STEP * scale)[:, None] * u
    full = scale * REACH > np.pi
    y[full], dy[full] = y0[full, None] + 1j * np.pi * k / k[-1], np.pi / k[-1]
    top = c * y0 + t * np.log(f)
    e = np.exp(c[:, None] * y + t[:, None] * np.log(-np.expm1(d * _log_complement(y))) - top[:, None]) * dy
    # the lower half of the contour mirrors the upper; a circle's ends are the same two points for both
    total = 2 * e.real.sum(axis=1) - e.real[:, 0] - np.where(full, e.real[:, -1], 0.0)
    return top + np.log(total / (2 * np.pi))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift = sum(np.log(x + k) for k in range(8))
    x = x + 8
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - (1 / 360 - 1 / (1260 * x * x)) / (x * x)) / x - shift


def _by_number(c: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where each number of tables has an integral of its own: a parabola's is smooth in t, a circle's has a meaning for whole t only."""
    return (high - low < KNOTS) | (high > c - 12) | ((2 * high > c) & (high > 8 * low))


def _band(c: np.ndarray, low: np.ndarray, high: np.ndarray, a: np.ndarray, p: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tables from ``low`` to ``high`` (a row for each item, the last repeated) and their log weights."""
    width = high - low + 1
    t = np.minimum(low[:, None] + np.arange(width.max()), high[:, None])
    weights = t * np.log(p)[:, None] + _log_gamma(a[:, None] + t) - _log_gamma(t + 1.0)
    every = _by_number(c, low, high)
    sums = np.empty(t.shape)
    if every.any():
        n = width[every].max()
        sums[every, :n] = log_sibuya(np.repeat(c[every], n), t[every, :n].ravel().astype(float), d).reshape(-1, n)
    if not every.all():
        i = np.flatnonzero(~every)
        x = np.cos(np.pi * (np.arange(KNOTS) + 0.5) / KNOTS)
        mid, half = np.log(high[i] * low[i].astype(float)) / 2, np.log(high[i] / low[i]) / 2
        knots = np.exp(mid[:, None] + half[:, None] * x)
        values = log_sibuya(np.repeat(c[i], KNOTS), knots.ravel(), d).reshape(knots.shape) - np.log(knots)
        series = values @ (np.cos(np.arange(KNOTS) * np.arccos(x)[:, None]) * np.where(np.arange(KNOTS), 2, 1) / KNOTS)
        log_t = np.log(t[i])
        sums[i] = np.polynomial.chebyshev.chebval((log_t - mid[:, None]) / half[:, None], series.T[:, :, None], tensor=False) + log_t
    weights += sums
    weights[np.arange(t.shape[1]) >= width[:, None]] = -np.inf
    return t, weights


def _resample_many(c: np.ndarray, rest: np.ndarray, p: np.ndarray, theta: float, d: float, draws: np.ndarray) -> np.ndarray:
    """As ``resample``, for numbers of customers without a row of Stirling numbers."""
    out = np.ones(len(c), np.int64)
    a = rest + theta / d

    def slope(m: np.ndarray, i: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        share, log_f = _saddle(m, d)
        return share * c[i], np.log(p[i] * (1 + a[i] / (share * c[i]))) + log_f

    m = _bisect(np.full(len(c), -80.0), np.full(len(c), 3.0), lambda m: slope(m)[1] > 0, 40)
    (t0, g0), (t1, g1) = slope(m - 1e-3), slope(m + 1e-3)
    spread = 8 * np.sqrt(np.maximum(t1 - t0, 0.0) / np.maximum(g0 - g1, 1e-12)) + 16
    mode = np.clip(slope(m)[0], 1, c)
    low, high = np.maximum(1, mode - spread).astype(np.int64), np.minimum(c, mode + spread).astype(np.int64)
    left = np.arange(len(c))
    while len(left):
        width = high[left] - low[left] + 1
        cells = np.where(_by_number(c[left], low[left], high[left]), 50 * width, 50 * KNOTS + width)
        order = np.argsort(cells, kind="stable")
        left, cells = left[order], cells[order]
        n = max(1, int(np.searchsorted(cells * np.arange(1, len(cells) + 1), 250_000)))
        i, left = left[:n], left[n:]
        t, weights = _band(c[i], low[i], high[i], a[i], p[i], d)
        best, last = weights.max(axis=1), weights[np.arange(len(i)), high[i] - low[i]]
        below, above = (low[i] > 1) & (weights[:, 0] > best - TAIL), (high[i] < c[i]) & (last > best - TAIL)
        more = high[i] - low[i]
        low[i], high[i] = np.where(below, np.maximum(1, low[i] - more), low[i]), np.where(above, np.minimum(c[i], high[i] + more), high[i])
        wide = below | above
        chance = np.cumsum(np.exp(weights - best[:, None]), axis=1)
        draw = (chance <= (draws[i] * chance[:, -1])[:, None]).sum(axis=1)
        out[i[~wide]] = t[np.arange(len(i)), draw][~wide]
        left = np.concatenate([i[wide], left])
    return out


def resample(c: np.ndarray, rest: np.ndarray, p: np.ndarray, theta: float, d: float, log_s: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Numbers of tables of words with ``c`` customers in restaurants with ``rest`` other tables; ``p``: the parent's predictive.

    ``draws``: a uniform number for each word.
    """
    out = np.minimum(c, 1)
    for cc in np.unique(c[(c > 1) & (c < len(log_s))]):
        which = np.flatnonzero(c == cc)
        for at in range(0, len(which), max(1, 500_000 // int(cc))):
            i = which[at : at + max(1, 500_000 // int(cc))]
            step = np.log((theta + d * (rest[i, None] + np.arange(cc))) * p[i, None])
            logit = np.cumsum(step, axis=1) + log_s[cc, 1 : cc + 1]
            chance = np.cumsum(np.exp(logit - logit.max(axis=1)[:, None]), axis=1)
            out[i] = (chance <= (draws[i] * chance[:, -1])[:, None]).sum(axis=1) + 1
    i = np.flatnonzero(c >= len(log_s))
    out[i] = _resample_many(c[i], rest[i], p[i], theta, d, draws[i])
    return out


def uniform(key: np.ndarray, *salt: int) -> np.ndarray:
    """A number from 0 to below 1 for each key."""
    for x in salt:
        key = kernel.mix64(key ^ kernel.mix64(np.array([x], np.uint64)))
    return (key >> U64(11)).astype(np.float64) * 2.0**-53


def _shard(u: np.ndarray, w: np.ndarray, totals: Totals) -> np.ndarray:
    x = kernel.mix64(u)
    return _range(np.where(totals.is_hot(u), kernel.mix64(x ^ w), x), totals.shards)


def _range(x: np.ndarray, shards: int) -> np.ndarray:
    """Which of ``shards`` ranges of hashes each hash is in; grows with the hash."""
    return ((x >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def tokens(block: kernel.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, token, doc) of each token: a document's words, then an end."""
    w = kernel.words(block)
    n = len(block)
    low = kernel.lowered(block.data).astype(np.uint64)
    ending = low[w.end - 1] + U64(256) * np.where(w.end - w.start > 1, low[w.end - 2], U64(0))
    token = np.empty(len(w.hash) + n, np.uint64)
    token[np.arange(len(w.hash)) + w.doc] = w.hash & ~_CLASS | kernel.mix64(ending) % U64(CLASSES - 1)
    ends = w.first[1:] + np.arange(n)
    token[ends] = END
    context = np.concatenate([[START], token[:-1]]) if n else token
    context[w.first[:-1] + np.arange(n)] = START
    return context, token, np.repeat(np.arange(n), np.diff(w.first) + 1)


class Codes:
    """Words of a shard under the classes of their contexts: a code is a word whose last bits are the class."""

    def __init__(self, words: np.ndarray, mask: np.ndarray):
        """``mask``: a bit for each class under which the word stands."""
        self.words, self.mask = words, mask
        n = np.bitwise_count(mask).astype(np.int64)
        self.first = np.cumsum(n) - n
        self.size = int(n.sum())

    @classmethod
    def of_pairs(cls, words: np.ndarray, word: np.ndarray, group: np.ndarray) -> Codes:
        here = np.zeros((len(words), CLASSES), bool)
        here[word, group] = True
        return cls(words, np.packbits(here, axis=1, bitorder="little").view(np.uint64).ravel())

    @classmethod
    def of_codes(cls, codes: np.ndarray) -> Codes:
        plain = codes & ~_CLASS
        words = plain[np.concatenate([[True], plain[1:] != plain[:-1]])[: len(plain)]]
        return cls.of_pairs(words, np.searchsorted(words, plain), (codes & _CLASS).astype(np.int64))

    def place(self, word: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Which code a word (its place) under a class is."""
        return self.first[word] + np.bitwise_count(self.mask[word] & ((U64(1) << group.astype(np.uint64)) - U64(1)))

    def codes(self) -> np.ndarray:
        bits = np.unpackbits(self.mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        word, group = np.nonzero(bits)
        return self.words[word] | group.astype(np.uint64)


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8 if not len(x) or x.max() < 256 else np.uint16 if x.max() < 65536 else np.uint32)


def _types(u: np.ndarray, w: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
    """Pairs in order of contexts, as arrays of few bytes: contexts, words, how many pairs of each context, places of words."""
    first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, np.int64)
    words, place = kernel.ranked(w)
    return {"u": u[first], "n": _small(np.diff(np.append(first, len(u)))), "w": words, "i": _small(place), "c": _small(count)}


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["kind", "shard", "unit", "blob"])


#: Bytes of text in a chunk, whose words are named once for each shard.
CHUNK = 12 << 20


def _by_pair(pair: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs in order; of each (pair, document) in order the pair's place, the document and how often it is there."""
    if len(pair) and int(pair.max()) >= (2**63 - docs) // max(1, docs):  # too large for one number
        pair, place = kernel.ranked(pair)
        seen, times = np.unique(place * np.int64(docs) + doc, return_counts=True)
        return pair, *np.divmod(seen, docs), times
    seen = np.sort(pair * np.int64(docs) + doc)
    first = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]])[: len(seen)])
    own, doc_of = np.divmod(seen[first], docs)
    new = np.concatenate([[True], own[1:] != own[:-1]])[: len(own)]
    return own[new], np.cumsum(new) - 1, doc_of, np.diff(np.append(first, len(seen)))


def _emit(shared):
    """Blobs of a chunk's pairs by shard, with the documents of each; its words' counts in training text; and its documents."""

    def chunks(b: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Rows, and the tokens and documents of these."""
        start, size, token, doc = 0, 0, [], []
        for block in kernel.blocks(b["text"]):
            _, w, d = tokens(block)
            token.append(w)
            doc.append((d + (block.first - start)).astype(np.int32))
            size += len(block.data)
            if size >= CHUNK or block.first + len(block) == b.num_rows:
                end = block.first + len(block)
                yield slice(start, end), np.concatenate(token), np.concatenate(doc)
                start, size, token, doc = end, 0, [], []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Totals = shared.value
        for b in batches:
            held_all = b["held_out"].to_numpy(zero_copy_only=False)
            for part, token, doc in chunks(b):
                held, rows = held_all[part], []
                known, at = kernel.ranked(np.append(token, START))
                at = at.astype(np.int32)
                context = np.append(at[-1:], at[:-2])
                at, start_at = at[:-1], at[-1]
                context[np.concatenate([[True], doc[1:] != doc[:-1]])] = start_at
                trained = np.bincount(at[~held[doc]], minlength=len(known))
                pair = context * np.int64(len(known)) + at
                del token, at, context
                pair, of, doc_of, times = _by_pair(pair, doc, len(held))
                u, w = (known[x] for x in np.divmod(pair, len(known)))
                w = w & ~_CLASS
                # by shard, in order of contexts and words
                shard = _shard(u, w, totals)
                order = np.argsort(_small(shard), kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(totals.shards + 1))
                docs_of = np.bincount(of, minlength=len(pair))
                begin = np.cumsum(docs_of) - docs_of
                ids = b["doc_id"].slice(part.start, len(held))
                sig = b["sig"].to_numpy()[part].view(np.uint64)
                unit = int(kernel.mix64(sig ^ kernel.mix64(np.arange(len(sig), dtype=np.uint64))).view(np.int64).sum())
                rows.append((DOCS, unit % totals.shards, unit, pack(id=ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), null=np.asarray(ids.is_null()), held=held)))
                for s, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if z > a:
                        mine = order[a:z]
                        n = docs_of[mine]
                        i = np.repeat(begin[mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                        rows.append((SEEN, s, unit, pack(3, **_types(u[mine], w[mine], n), doc=_small(doc_of[i]), k=_small(times[i]), held=np.packbits(held))))
                words, c = known[trained > 0] & ~_CLASS, trained[trained > 0]
                cuts = np.searchsorted(_range(words, totals.shards), np.arange(totals.shards + 1))
                rows += [(WORDS, s, 0, pack(w=words[a:z], c=_small(c[a:z]))) for s, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a]
                del known, pair, u, w, order, of, doc_of, times
                kernel.tidy()
                yield _rows(rows)

    return run


def _tidied(run):
    """A function of a group that leaves no free memory with the worker."""

    def then_tidy(t: pa.Table) -> pa.Table:
        out = run(t)
        kernel.tidy()
        return out

    return then_tidy


def _sum_by(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    names, place = np.unique(key, return_inverse=True)
    return names, *(np.bincount(place, weights=v, minlength=len(names)).astype(np.int64) for v in values)


_STATE_ROW = "kind int, shard int, unit long, blob binary, x long, y long, hot binary"


def _state_rows(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
    names = ("kind", "shard", "unit", "blob", "x", "y", "hot")
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


def _hot_part(u: np.ndarray, c: np.ndarray, t: np.ndarray, totals: Totals) -> bytes:
    """Of the hot contexts that a shard has: context, customers, tables by sample."""
    here = np.flatnonzero(totals.is_hot(u))
    return pack(u=u[here], c=c[here], t=np.ascontiguousarray(t[:, here]).ravel())


def _merge(shared):
    """A shard's blobs as its restaurants (tables: one for each pair) and, for each unit, documents by pair; or as its words' counts.

    Pairs that only held-out text has are kept, without customers, so that a pair's place says all when texts are scored.
    """

    def run(t: pa.Table) -> pa.Table:
        totals: Totals = shared.value
        kind, shard = t["kind"][0].as_py(), t["shard"][0].as_py()
        units = t["unit"].to_pylist()
        if kind == DOCS:
            return _state_rows([(DOCS, shard, unit, b.as_py(), 0, 0, b"") for unit, b in zip(units, t["blob"], strict=True)])
        parts = [unpack(b.as_py()) for b in t["blob"]]
        if kind == WORDS:
            w, c = _sum_by(np.concatenate([p["w"] for p in parts]), np.concatenate([p["c"] for p in parts]))
            return _state_rows([(WORDS, shard, 0, pack(w=w, c=c.astype(np.uint64)), int(c.sum()), len(w), b"")])
        words, contexts = (np.unique(np.concatenate([p[k] for p in parts])) for k in ("w", "u"))
        of = np.concatenate([np.repeat(np.searchsorted(contexts, p["u"]), p["n"]) for p in parts])
        word = np.concatenate([np.searchsorted(words, p["w"])[p["i"]] for p in parts])
        group = (contexts & _CLASS).astype(np.int64)[of]
        coder = Codes.of_pairs(words, word, group)
        vocab = coder.codes()
        key = of * len(vocab) + coder.place(word, group)
        del of, word, group, coder, words
        key, place = kernel.ranked(key)
        c, rows, base = np.zeros(len(key), np.int64), [], 0
        for unit, p in zip(units, parts, strict=True):
            mine = place[base : base + len(p["i"])]
            base += len(mine)
            trained = np.where(np.unpackbits(p["held"])[p["doc"]], 0, p["k"])
            which = np.repeat(np.arange(len(mine)), p["c"])
            c[mine] += np.bincount(which, weights=trained, minlength=len(mine)).astype(np.int64)
            rows.append((SEEN, shard, unit, pack(3, at=mine.astype(np.uint32), c=p["c"], doc=p["doc"], k=p["k"]), 0, 0, b""))
        at, i = np.divmod(key, len(vocab))
        here, n = np.unique(at, return_counts=True)
        contexts, first, tables = contexts[here], np.cumsum(n) - n, np.minimum(c, 1)
        blob = pack(s=np.array([1]), vocab=vocab, u=contexts, n=_small(n), i=i.astype(np.uint32), c=_small(c), t=_small(tables))
        hot = _hot_part(contexts, np.add.reduceat(c, first), np.add.reduceat(tables, first)[None], totals)
        return _state_rows([(STATE, shard, 0, blob, int((c == 1).sum()), int((c == 2).sum()), hot), *rows])

    return _tidied(run)


def _tables(x: dict[str, np.ndarray]) -> np.ndarray:
    """Tables by sample and pair."""
    return x["t"].reshape(int(x["s"][0]), len(x["i"])).astype(np.int64)


def _ask(shared):
    """A state's words under their classes, and their tables, to the parents' shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Totals = shared.value
        for b in batches:
            for shard, blob in zip(b["shard"].to_pylist(), b["blob"], strict=True):
                x = unpack(blob.as_py())
                sums = np.stack([np.bincount(x["i"], weights=t, minlength=len(x["vocab"])).astype(np.uint64) for t in _tables(x)])
                cuts = np.searchsorted(_range(x["vocab"], totals.shards), np.arange(totals.shards + 1))
                rows = [(STATE, s, shard, pack(w=x["vocab"][a:z], t=_small(sums[:, a:z].ravel()))) for s, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a]
                if rows:
                    yield _rows(rows)
                kernel.tidy()

    return run


_PARENT_ROW = "shard int, blob binary, ask binary, sums array<long>"


def _predictive(c: np.ndarray, t: np.ndarray, d: float, theta: float, all_c: np.ndarray, all_t: np.ndarray, parent: np.ndarray) -> np.ndarray:
    return (c - d * t + (theta + d * all_t) * parent) / (theta + all_c)


def _root(x: dict[str, np.ndarray], totals: Totals) -> np.ndarray:
    """The root's predictive of a shard's words, by sample."""
    s = totals.settings
    c, t = (x[k].reshape(len(totals.root_c), -1) for k in ("c0", "t0"))
    return _predictive(c, t, s.d_root, s.theta, totals.root_c[:, None], totals.root_t[:, None], np.full((1, 1), 1.0 / (totals.vocab + 1)))


def _seat_parent(shared, phase: int):
    """A range of words: customers and tables of the classes' restaurants and of the root, and who asked for which.

    In phase 0 every word has one table; later ones draw, given the state of the phase before.
    """

    def run(t: pa.Table) -> pa.Table:
        totals: Totals = shared.value
        s = totals.settings
        asked, counted, before = [], [], None
        for kind, unit, blob in zip(t["kind"].to_pylist(), t["unit"].to_pylist(), t["blob"], strict=True):
            if kind == SEATED:
                before = unpack(blob.as_py())
            else:
                (counted if kind == WORDS else asked).append((unit, unpack(blob.as_py())))
        asked.sort(key=lambda a: a[0])
        codes = np.unique(np.concatenate([x["w"] for _, x in asked] or [np.zeros(0, np.uint64)]))
        words = np.unique(np.concatenate([codes & ~_CLASS, *(x["w"] for _, x in counted)]))
        of, group = np.searchsorted(words, codes & ~_CLASS), (codes & _CLASS).astype(np.int64)
        samples = len(asked[0][1]["t"]) // len(asked[0][1]["w"]) if asked else 1
        customers, places = np.zeros((samples, len(codes)), np.int64), []
        for _, x in asked:
            at = np.searchsorted(codes, x["w"])
            customers[:, at] += x["t"].reshape(samples, -1).astype(np.int64)
            places.append(at)
        count = np.zeros(len(words), np.int64)
        for _, x in counted:
            count[np.searchsorted(words, x["w"])] = x["c"]
        tables, guests, seats = np.minimum(customers, 1), np.zeros((samples, len(words)), np.int64), np.zeros((samples, len(words)), np.int64)
        if before is not None:
            root = _root(before, totals)
            old1, old0 = (before[k].reshape(len(root), -1).astype(np.int64) for k in ("t1", "t0"))
            log_1, log_0 = stirling(s.d_class), stirling(s.d_root)
        for i in range(samples):
            j = 0 if before is None else min(i, len(root) - 1)
            if before is not None:
                rest = totals.class_t[j][group] - old1[j]
                tables[i] = resample(customers[i], rest.astype(float), root[j][of], s.theta, s.d_class, log_1, uniform(codes, s.seed, 1, phase, i))
            guests[i] = np.bincount(of, weights=tables[i], minlength=len(words))
            seats[i] = np.minimum(guests[i], 1)
            if before is not None:
                base = np.full(len(words), 1.0 / (totals.vocab + 1))
                seats[i] = resample(guests[i], (totals.root_t[j] - old0[j]).astype(float), base, s.theta, s.d_root, log_0, uniform(words, s.seed, 2, phase, i))
        ask = pack(who=np.array([a[0] for a in asked], np.int64), n=np.array([len(p) for p in places], np.int64), step=np.diff(np.concatenate([*places, np.zeros(0, np.int64)]), prepend=0).astype(np.int32))
        blob = pack(w=codes, of=of.astype(np.uint32), c1=customers.ravel(), t1=tables.ravel(), c0=guests.ravel(), t0=seats.ravel(), n=count)
        by_class = [np.bincount(group, weights=v, minlength=CLASSES) for v in (*customers, *tables)]
        sums = np.concatenate([*by_class, guests.sum(axis=1), seats.sum(axis=1)]).astype(np.int64)
        return pa.table({"shard": t["shard"][:1].cast(pa.int32()), "blob": [blob], "ask": [ask], "sums": [sums.tolist()]})

    return _tidied(run)


def _answer(shared, counts: bool):
    """The parents' predictive of the words that each state asked for, by sample, and with ``counts`` their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Totals = shared.value
        s = totals.settings
        for b in batches:
            for shard, blob, ask in zip(b["shard"].to_pylist(), b["blob"], b["ask"], strict=True):
                x, q = unpack(blob.as_py()), unpack(ask.as_py())
                samples = len(totals.root_c)
                c, t = (x[k].reshape(samples, -1) for k in ("c1", "t1"))
                group = (x["w"] & _CLASS).astype(np.int64)
                p = _predictive(c, t, s.d_class, s.theta, totals.class_c[:, group], totals.class_t[:, group], _root(x, totals)[:, x["of"]])
                n, places = x["n"][x["of"]], np.cumsum(q["step"], dtype=np.int64)
                rows, at = [], 0
                for who, size in zip(q["who"].tolist(), q["n"].tolist(), strict=True):
                    i = places[at : at + size]
                    at += size
                    rows.append((REPLY, who, shard, pack(p=p[:, i].astype(np.float32).ravel(), **({"n": _small(n[i])} if counts else {}))))
                if rows:
                    yield _rows(rows)
                kernel.tidy()

    return run


def _received(t: pa.Table, samples: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """A shard's restaurants, and the predictive and count of each word of its vocabulary."""
    kinds, units = t["kind"].to_pylist(), t["unit"].to_pylist()
    state = next((unpack(t["blob"][i].as_py()) for i, k in enumerate(kinds) if k == STATE), None)
    replies = [unpack(t["blob"][i].as_py()) for _, i in sorted((units[i], i) for i, k in enumerate(kinds) if k == REPLY)]
    p = np.concatenate([r["p"].reshape(samples, -1) for r in replies], axis=1).astype(np.float64) if replies else np.zeros((samples, 0))
    return state, p, np.concatenate([r["n"].astype(np.int64) for r in replies if "n" in r] or [np.zeros(0, np.int64)])


def _sweep(shared, sweeps: int, keep: int, phase: int):
    """``sweeps`` Gibbs sweeps over a shard's restaurants; the last ``keep`` states are kept."""

    def run(t: pa.Table) -> pa.Table:
        totals: Totals = shared.value
        s = totals.settings
        x, p, _ = _received(t, 1)
        c, n = x["c"].astype(np.int64), x["n"].astype(np.int64)
        first, of = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
        start = _tables(x)[-1]
        now = start.copy()
        total = lambda v: np.add.reduceat(v, first) if len(first) else v
        hot = totals.is_hot(x["u"])
        fixed = totals.hot_totals(x["u"])[1][-1]
        log_s, kept = stirling(totals.d), []
        word = p[0][x["i"].astype(np.int64)]
        key = kernel.mix64(np.repeat(x["u"], n) ^ kernel.mix64(x["vocab"][x["i"].astype(np.int64)]))
        half = uniform(key, s.seed, 3) < 0.5
        for turn in range(sweeps):
            draws = uniform(key, s.seed, 4, phase, turn)
            for part in (half, ~half):
                i = np.flatnonzero(part & (c > 1))  # one customer has one table
                rest = np.where(hot[of[i]], fixed[of[i]] - start[i], total(now)[of[i]] - now[i])
                now[i] = resample(c[i], rest.astype(float), word[i], s.theta, totals.d, log_s, draws[i])
            if turn >= sweeps - keep:
                kept.append(now.copy())
        tables = np.stack(kept)
        sums = np.stack([total(v) for v in tables])
        blob = pack(s=np.array([keep]), vocab=x["vocab"], u=x["u"], n=x["n"], i=x["i"], c=x["c"], t=_small(tables.ravel()))
        return _state_rows([(STATE, t["shard"][0].as_py(), 0, blob, 0, 0, _hot_part(x["u"], total(c), sums, totals))])

    return _tidied(run)


def _score(shared):
    """Log predictive and base sums of a shard's tokens, for each unit's documents."""

    def run(t: pa.Table) -> pa.Table:
        totals: Totals = shared.value
        theta, d, samples = totals.settings.theta, totals.d, len(totals.root_c)
        shard = t["shard"][0].as_py()
        kinds, units = t["kind"].to_pylist(), t["unit"].to_pylist()
        rows = [(DOCS, shard, units[i], t["blob"][i].as_py()) for i, k in enumerate(kinds) if k == DOCS]
        x, p, count = _received(t, samples)
        if x is not None:
            c, n = x["c"].astype(np.int64), x["n"].astype(np.int64)
            first, of, tables = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n), _tables(x)
            customers, own_tables = np.add.reduceat(c, first), np.stack([np.add.reduceat(v, first) for v in tables])
            hot = totals.is_hot(x["u"])
            customers[hot], own_tables[:, hot] = totals.hot_totals(x["u"][hot])
            i = x["i"].astype(np.int64)
            prob = np.zeros(len(i))
            for j in range(samples):
                back = p[j][i]
                own = c - d * tables[j]  # 0 of a pair without customers
                prob += np.where(customers[of] > 0, (own + (theta + d * own_tables[j][of]) * back) / (theta + customers[of]), back)
            score, seen_w = np.log10(prob / samples), count[i]
            base, known, starts = np.log10(seen_w + 1.0), seen_w > 0, (x["u"] == START)[of]
        for unit, kind, b in zip(units, kinds, t["blob"], strict=True):
            if kind != SEEN:
                continue
            y = unpack(b.as_py())
            pair = np.repeat(y["at"].astype(np.int64), y["c"])
            here = np.bincount(y["doc"]) > 0
            docs, doc = np.flatnonzero(here).astype(y["doc"].dtype), (np.cumsum(here) - 1)[y["doc"]]
            times = y["k"].astype(np.int64)
            sums = [np.bincount(doc, weights=times * v, minlength=len(docs)) for v in (score[pair], base[pair], known[pair], 1, starts[pair])]
            whole = dict(zip(("known", "n", "rows"), (_small(v.astype(np.int64)) for v in sums[2:]), strict=True))
            rows.append((SEEN, shard, unit, pack(doc=docs, score=sums[0], base=sums[1], **whole)))
        return pa.Table.from_batches([_rows(rows)])

    return _tidied(run)


def _finish(shared):
    def run(t: pa.Table) -> pa.Table:
        totals: Totals = shared.value
        parts = sorted(zip(t["kind"].to_pylist(), t["shard"].to_pylist(), (unpack(b.as_py()) for b in t["blob"]), strict=True), key=lambda r: r[:2])
        docs = next(x for k, _, x in parts if k == DOCS)
        n = len(docs["id"])
        sums = {k: np.zeros(n) for k in ("score", "base", "known", "n", "rows")}
        for kind, _, x in parts:
            if kind == SEEN:
                for k, v in sums.items():
                    v[x["doc"]] += x[k]
        # chunks that are equal meet here: each document then counts as often as it starts
        times = np.maximum(1, sums.pop("rows")).astype(np.int64)
        one = {k: np.repeat(v / times, times) for k, v in sums.items()}
        length = np.rint(one["n"]).astype(np.int64)
        base = one["base"] - length * np.log10(totals.tokens + totals.vocab + 1)
        ids = pa.array(np.repeat(docs["id"], times), pa.int64(), mask=np.repeat(docs["null"], times))
        return pa.table({"doc_id": ids, "held_out": pa.array(np.repeat(docs["held"], times).astype(bool)), "n_tokens": length, "n_known": np.rint(one["known"]).astype(np.int64), "train_tokens": np.full(len(length), totals.tokens, np.int64), "base_score": base, "score": one["score"]})

    return _tidied(run)


def _bin_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of each bin: one row a bin and task."""
    total = np.zeros(BINS, np.int64)
    for b in batches:
        for block in kernel.blocks(b["text"]):
            total += np.bincount((tokens(block)[0] >> U64(48)).astype(np.int64), minlength=BINS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bin", "n"])


def _hot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for blob in b["hot"]:
            x = unpack(blob.as_py())
            samples = len(x["t"]) // max(1, len(x["u"]))
            for i in range(samples):
                cols = [x["u"].view(np.int64), np.full(len(x["u"]), i, np.int32), x["c"], x["t"].reshape(samples, -1)[i]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["u", "sample", "c", "t"])


def _add_hot(totals: Totals, state: DataFrame, samples: int) -> None:
    """Hot contexts' totals over all shards: a row for each of them and sample."""
    rows = state.where(F.col("kind") == STATE).select("hot").mapInArrow(_hot_rows, "u long, sample int, c long, t long")
    got = rows.groupBy("u", "sample").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).toArrow()
    u, sample = got["u"].to_numpy().view(np.uint64), got["sample"].to_numpy()
    totals.hot, at = np.unique(u, return_inverse=True)
    totals.hot_c, totals.hot_t = np.zeros(len(totals.hot), np.int64), np.zeros((samples, len(totals.hot)), np.int64)
    totals.hot_c[at], totals.hot_t[sample, at] = got["c"].to_numpy(), got["t"].to_numpy()


def _totals(rows: DataFrame, s: Settings) -> Totals:
    counts = rows.select("text").mapInArrow(_bin_counts, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()  # BINS rows at most
    n, total = counts["n"].to_numpy(), int(counts["n"].to_numpy().sum())
    bins = np.zeros(BINS, bool)
    bins[counts["bin"].to_numpy()[n > max(s.shard // 4, 8 * total // BINS)]] = True
    return Totals(max(shuffle_partitions(rows.sparkSession), -(-total // s.shard)), bins, s)


def score(docs: DataFrame, is_held_out: Column, s: Settings = PRODUCTION) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs`` (doc_id, text); learned from the others."""
    spark = docs.sparkSession
    ship(spark)
    share = spark.sparkContext.broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", is_held_out.alias("held_out"), F.xxhash64("doc_id", "text").alias("sig"))
    totals = _totals(rows, s)

    def dealt(df: DataFrame) -> DataFrame:
        """As many tasks as shards, whatever the session's number of shuffle partitions."""
        return df.repartition(totals.shards, "shard")

    blobs = rows.mapInArrow(_emit(share(totals)), _ROW)
    merged = materialise(dealt(blobs).groupBy("kind", "shard").applyInArrow(_merge(share(totals)), _STATE_ROW), "lm-merged", by="kind")

    def rows_of(now: DataFrame) -> DataFrame:
        return now.select("kind", "shard", "unit", "blob")

    words = rows_of(merged.where(F.col("kind") == WORDS))
    sums = {r.kind: r for r in merged.where(F.col("kind").isin(STATE, WORDS)).groupBy("kind").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).collect()}
    if WORDS in sums:
        totals.tokens, totals.vocab = sums[WORDS].x, sums[WORDS].y
    if STATE in sums and sums[STATE].x:
        totals.d = float(np.clip(sums[STATE].x / (sums[STATE].x + 2 * sums[STATE].y), 0.1, 0.9))
    state = merged.where(F.col("kind") == STATE)
    _add_hot(totals, state, 1)
    seated = None

    def parent(now: DataFrame, phase: int, samples: int) -> DataFrame:
        """Replies of the parents, seated anew from the tables of ``now``."""
        nonlocal seated
        asked, before = now.mapInArrow(_ask(share(totals)), _ROW).unionByName(words), seated
        if before is not None:
            asked = asked.unionByName(before.select(F.lit(SEATED).alias("kind"), "shard", F.lit(0).cast("long").alias("unit"), "blob"))
        seated = materialise(dealt(asked).groupBy("shard").applyInArrow(_seat_parent(share(totals), phase), _PARENT_ROW), f"lm-parent-{phase}")
        if before is not None:
            discard(before)
        got = seated.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).toArrow()  # some numbers for each class and sample
        v = np.zeros(samples * 2 * (CLASSES + 1))
        # shards without words have one sample's zeros
        inside = got["at"].to_numpy() < len(v)
        v[got["at"].to_numpy()[inside]] = got["v"].to_numpy()[inside]
        split = samples * CLASSES
        totals.class_c, totals.class_t = v[:split].reshape(samples, CLASSES), v[split : 2 * split].reshape(samples, CLASSES)
        totals.root_c, totals.root_t = v[2 * split : 2 * split + samples], v[2 * split + samples :]
        return seated.mapInArrow(_answer(share(totals), phase == 2), _ROW)

    for phase, sweeps, keep in ((0, s.burn, 1), (1, s.samples, s.samples)):
        both = rows_of(state).unionByName(parent(state, phase, 1))
        swept = materialise(dealt(both).groupBy("shard").applyInArrow(_sweep(share(totals), sweeps, keep, phase), _STATE_ROW), f"lm-swept-{phase}")
        discard(*((state,) if phase else (merged, f"kind={STATE}")))
        state = swept
        _add_hot(totals, state, keep)
    seen = rows_of(merged.where(F.col("kind").isin(SEEN, DOCS)))
    everything = rows_of(state).unionByName(parent(state, 2, s.samples)).unionByName(seen)
    parts = dealt(everything).groupBy("shard").applyInArrow(_score(share(totals)), _ROW)
    return parts.groupBy("unit").applyInArrow(_finish(share(totals)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), held_out(F.col("doc_id")))
