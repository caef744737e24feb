"""Toxicity by nearest labelled examples.

A text is a TF-IDF vector over all its terms: words, and their first four, five and
six bytes, which catch inflected forms.  A term weighs (1 + log tf) * idf * strength;
idf counts all documents, strength is ``floor`` plus the standard errors above ``z`` by which
the term is more frequent in toxic examples, so a term of neither class still counts.  The ``k``
nearest examples by exact cosine come from a block-max inverted index: examples are
sorted by their heaviest terms and kept in blocks; frequent terms have the largest
weight of each block, rare ones have postings.  What rare terms give is summed from
postings, frequent terms' largest weights bound the rest, and blocks are taken by
falling bound, unless it is below the k-th best cosine.  Components are whole
multiples of 2^-26, so that a cosine is exact in whatever order it is summed.
Votes weighted by cosine, smoothed towards the examples' rate, are calibrated by
isotonic regression over leave-one-out votes of the examples.  A text without a
term that any example has gets the smoothed rate of the examples without terms.

The model is fitted on at most ``examples`` labelled rows (those of smallest hash of
doc_id): that bounds what the driver collects and what is broadcast; all terms of
these rows are indexed.  All rows and whole texts are scored.  Labels, language,
source and id are no inputs of a score.

Cases: null and empty texts have no terms and get that rate; very long texts are scored whole; rows without an id are
scored, and never learned from; a document with several labels is toxic if one says
so; ties of cosine go to the smaller id; equal rows get equal scores; without any
labels every score is 0; an empty table gives no row; other columns pass through, and
those named ``score`` and ``evidence`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.llm import kernel
from chatloom.runtime import materialise, ship, table

THRESHOLD = 0.3
#: Queries searched together.
GROUP = 64
SCALE = float(1 << 26)
PREFIXES = (4, 5, 6)
_NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Settings:
    examples: int = 2_000
    z: float = 4.5
    floor: float = 0.1
    k: int = 15
    block: int = 64
    smooth: float = 0.5
    frequent: int = 8  #: terms in more than one of so many examples have weights in blocks, not postings


PRODUCTION = Settings()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features(block: kernel.Block) -> tuple[np.ndarray, np.ndarray]:
    """(term hash, doc) of every word of a block and its beginnings."""
    low = kernel.lowered(block.data)
    start, end = kernel.spans(block, kernel.ALNUM[low])
    doc = np.searchsorted(block.offsets, start, side="right") - 1
    sums = kernel.running(low)
    made, docs = [kernel.range_hashes(low, start, end, sums)], [doc]
    for n in PREFIXES:
        longer = end - start > n
        made.append(kernel.mix64(kernel.range_hashes(low, start[longer], start[longer] + n, sums) + kernel.U64(n)))
        docs.append(doc[longer])
    return np.concatenate(made), np.concatenate(docs)


def _counted(doc: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, term) and how often each stands, by doc and term."""
    order = np.lexsort((f, doc))
    f, doc = f[order], doc[order]
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], f[first], np.diff(np.append(first, len(f)))


class Vocabulary:
    """Places of terms among sorted ``hashes``, by a chained table over their last bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, n = hashes, len(hashes)
        self.mask = kernel.U64((1 << max(4, n.bit_length() + 1)) - 1)
        slot = hashes & self.mask
        order = np.argsort(slot, kind="stable")
        self.head, self.next = np.full(int(self.mask) + 1, -1, np.int32), np.full(n, -1, np.int32)
        same = slot[order][1:] == slot[order][:-1]
        self.next[order[:-1][same]] = order[1:][same]
        begins = order[np.concatenate([[True], ~same])] if n else order
        self.head[slot[begins]] = begins

    def places(self, f: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 for others."""
        out = self.head[f & self.mask]
        left = np.flatnonzero(out >= 0)
        while len(left):
            left = left[self.hashes[out[left]] != f[left]]
            out[left] = self.next[out[left]]
            left = left[out[left] >= 0]
        return out

    def vectors(self, texts) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per block: first row, rows, and (doc, place of a term, tf) by doc and place."""
        for block in kernel.blocks(texts, 1 << 20):
            f, doc = _features(block)
            at = self.places(f)
            known = at >= 0
            key, tf = np.unique(doc[known] * np.int64(len(self.hashes)) + at[known], return_counts=True)
            yield block.first, len(block), *np.divmod(key, len(self.hashes)), tf


@dataclass
class Model:
    hashes: np.ndarray  #: of all terms of the examples, sorted
    weight: np.ndarray  #: idf times strength of each
    ids: np.ndarray  #: examples with a term, sorted into blocks
    toxic: np.ndarray
    settings: Settings = PRODUCTION
    place: np.ndarray = None  #: of a frequent term in ``dense``, else -1
    dense: np.ndarray = None  #: weights of frequent terms by example, the last block padded
    block_max: np.ndarray = None
    first: np.ndarray = None  #: postings of term i are ``first[i]`` to ``first[i + 1]``
    posted: np.ndarray = None
    posted_weight: np.ndarray = None
    least_id: np.ndarray = None  #: of each block
    rate: float = 0.0  #: of the examples with a term
    bare: float = 0.0  #: score without any term
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    levels: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))

    def weights(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int) -> np.ndarray:
        """Components of ``n`` unit vectors, in 2^-26."""
        w = (1 + np.log(tf)) * self.weight[term]
        return np.rint(w / np.sqrt(np.bincount(doc, weights=w * w, minlength=n))[doc] * SCALE)

    def search(self, doc: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples of each of ``n`` queries, whose components are sorted by query.

        Only positive cosines count: what is missing has place -1 and cosine 0.  Ties go to the
        smaller id.  ``without``: a place for each query that is not to be found.
        """
        k = self.settings.k
        places, cosines = np.full((n, k), -1, np.int64), np.zeros((n, k))
        for lo in range(0, n, GROUP):
            hi = min(n, lo + GROUP)
            a, z = np.searchsorted(doc, (lo, hi))
            places[lo:hi], cosines[lo:hi] = self._search(doc[a:z] - lo, term[a:z], w[a:z], hi - lo, None if without is None else without[lo:hi])
        return places, cosines / (SCALE * SCALE)

    def _search(self, doc: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, without: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        k, size, blocks = self.settings.k, self.settings.block, self.block_max.shape[1]
        place = self.place[term]
        q = np.zeros((n, len(self.dense)))
        q[doc[place >= 0], place[place >= 0]] = w[place >= 0]
        long = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term] - (np.cumsum(long) - long), long) + np.arange(int(long.sum()))
        rare = np.bincount(np.repeat(doc * (blocks * size), long) + self.posted[at], weights=np.repeat(w, long) * self.posted_weight[at], minlength=n * blocks * size)
        rare = rare.astype(float).reshape(n, blocks, size)
        if without is not None:
            rare[np.arange(n), without // size, without % size] = -np.inf
        bound = q @ self.block_max + rare.max(axis=2)
        places, cosines, ids = np.full((n, k), -1, np.int64), np.zeros((n, k)), np.full((n, k), _NO_ID)
        for b in np.argsort(-bound.max(axis=0), kind="stable"):
            top, kth = bound[:, b], cosines[:, -1]
            # a block whose bound ties with the k-th best can only win by a smaller id
            row = np.flatnonzero((top > kth) | ((top == kth) & (top > 0) & (self.least_id[b] < ids[:, -1])))
            if not len(row):
                continue
            here = np.arange(b * size, (b + 1) * size)
            got = q[row] @ self.dense[:, here[0] : here[-1] + 1].astype(float) + rare[row, b]
            reach = got.max(axis=1) >= np.maximum(kth[row], 1.0)
            row, got = row[reach], got[reach]
            if not len(row):
                continue
            p = np.hstack([places[row], np.where(got > 0, here, -1)])
            c = np.hstack([cosines[row], np.maximum(got, 0.0)])
            i = np.hstack([ids[row], np.where(got > 0, self.ids[np.minimum(here, len(self.ids) - 1)], _NO_ID)])
            best = np.lexsort((i, -c), axis=-1)[:, :k]
            places[row], cosines[row], ids[row] = (np.take_along_axis(x, best, axis=1) for x in (p, c, i))
        return places, cosines

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        a = self.settings.smooth
        return ((cosines * self.toxic[places]).sum(axis=1) + a * self.rate) / (cosines.sum(axis=1) + a)

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(votes, self.knots, self.levels), 0.0, 1.0)


def _isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the mean vote and the smoothed rate of each pool."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for xi, yi in zip(x[order], y[order], strict=True):
        pools.append([xi, yi, 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            a = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], a, strict=True)]
    knots = np.array([p[0] / p[2] for p in pools])
    levels = np.array([(p[1] + 0.5 * k) / (p[2] + 0.5) for p, k in zip(pools, knots, strict=True)])
    return knots, np.maximum.accumulate(levels)


def strength(toxic: np.ndarray, doc: np.ndarray, term: np.ndarray, terms: int, s: Settings) -> np.ndarray:
    """What the examples' classes say of each term."""
    n, bad = len(toxic), toxic.sum()
    df = np.bincount(term, minlength=terms)
    if not 0 < bad < n:
        return np.full(terms, s.floor)
    in_bad = np.bincount(term, weights=toxic[doc], minlength=terms)
    spread = df / n * (1 - df / n) * (1 / bad + 1 / (n - bad))
    z = (in_bad / bad - (df - in_bad) / (n - bad)) / np.sqrt(np.where(spread > 0, spread, np.inf))
    return s.floor + np.maximum(0.0, z - s.z)


def build(hashes: np.ndarray, weight: np.ndarray, ids: np.ndarray, toxic: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, s: Settings = PRODUCTION) -> Model:
    """A model over examples ``ids``; (doc, term, tf), by doc and term, are their counted terms."""
    n = len(ids)
    has = np.bincount(doc, minlength=n) > 0
    m = Model(hashes, weight, ids[has], toxic[has].astype(float), s)
    if n:
        m.bare = float((toxic[~has].sum() + min(toxic.mean(), 0.1)) / ((~has).sum() + 2))  # towards half the rate: nothing speaks against the text
    if not has.any():
        m.ids = m.ids[:0]
        return m
    doc = (np.cumsum(has) - 1)[doc]
    n = len(m.ids)
    w = m.weights(doc, term, tf, n)
    # blocks of alike examples: by their heaviest terms
    order = np.lexsort((term, -w, doc))
    begin = np.searchsorted(doc, np.arange(n))
    rank = np.arange(len(doc)) - begin[doc]
    heaviest = np.full((4, n), -1, np.int64)
    for j in range(4):
        heaviest[j, doc[rank == j]] = term[order][rank == j]
    at = np.lexsort((m.ids, *heaviest[::-1]))
    new = np.empty(n, np.int64)
    new[at] = np.arange(n)
    m.ids, m.toxic, doc = m.ids[at], m.toxic[at], new[doc]
    m.rate = float(m.toxic.mean())
    order = np.lexsort((doc, term))
    doc, term, w = doc[order], term[order], w[order]
    df = np.bincount(term, minlength=len(hashes))
    frequent = df * s.frequent > n
    m.place = np.where(frequent, np.cumsum(frequent) - 1, -1).astype(np.int32)
    blocks = -(-n // s.block)
    m.dense = np.zeros((int(frequent.sum()), blocks * s.block), np.int32)
    often = frequent[term]
    m.dense[m.place[term[often]], doc[often]] = w[often]
    m.block_max = m.dense.reshape(len(m.dense), blocks, s.block).max(axis=2, initial=0).astype(float)
    m.first = np.concatenate([[0], np.cumsum(np.where(frequent, 0, df))])
    m.posted, m.posted_weight = doc[~often].astype(np.int32), w[~often].astype(np.int32)
    m.least_id = np.minimum.reduceat(m.ids, np.arange(0, n, s.block))
    order = np.lexsort((term, doc))
    votes = m.vote(*m.search(doc[order], term[order], w[order], n, without=np.arange(n)))
    m.knots, m.levels = _isotonic(votes, m.toxic)
    return m


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block in kernel.blocks(b["text"], 1 << 20):
            f, doc = _features(block)
            doc, f, tf = _counted(doc, f)
            cut = pa.array(np.searchsorted(doc, np.arange(len(block) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(v)) for v in (f.view(np.int64), tf.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(b[c].slice(block.first, len(block)) for c in ("doc_id", "toxic")), *lists], ["doc_id", "toxic", "term", "tf"])


def _document_counts(shared):
    """Documents that hold each term of the vocabulary: one row a term and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(shared.value)
        df = np.zeros(len(v.hashes), np.int64)
        for b in batches:
            for _, _, _, term, _ in v.vectors(b["text"]):
                df += np.bincount(term, minlength=len(df))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["term", "df"])

    return run


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, s: Settings = PRODUCTION) -> Model:
    """A model of the labelled documents; ``learn``: a condition on doc_id."""
    spark = docs.sparkSession
    ship(spark)
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows if learn is None else rows.where(learn)
    rows = rows.groupBy("doc_id").agg((F.max("toxic") >= 1).cast("int").alias("toxic"))
    text = docs.select(F.col("doc_id").alias("__d"), "text")
    # labelled rows whose document is in ``docs``, then the bounded choice of them
    held = rows.join(text.select("__d"), F.col("__d") == F.col("doc_id"), "left_semi")
    chosen = held.orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(s.examples)
    own = text.join(F.broadcast(chosen), F.col("__d") == F.col("doc_id")).groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))  # at most ``examples`` ids
    got = own.mapInArrow(_example_terms, "doc_id long, toxic int, term array<long>, tf array<int>").orderBy("doc_id").toArrow()
    n = got.num_rows
    ids, toxic = got["doc_id"].to_numpy().astype(np.int64), got["toxic"].to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(n), got["term"].combine_chunks().value_lengths().to_numpy() if n else 0)
    flat = [got[c].combine_chunks().flatten().to_numpy() if n else np.zeros(0, np.int64) for c in ("term", "tf")]
    hashes, term = np.unique(flat[0].view(np.uint64), return_inverse=True)
    del got
    if not len(hashes):
        return build(hashes, np.zeros(0), ids, toxic, doc, term, flat[1], s)
    counts = docs.select("text").mapInArrow(_document_counts(spark.sparkContext.broadcast(hashes)), "term int, df long")
    counts = counts.groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row for each term of the examples
    df = np.zeros(len(hashes))
    df[counts["term"].to_numpy()] = counts["df"].to_numpy()
    idf = np.log((1 + docs.count()) / (1 + df)) + 1
    order = np.lexsort((term, doc))
    doc, term, tf = doc[order], term[order], flat[1][order]
    return build(hashes, idf * strength(toxic, doc, term, len(hashes), s), ids, toxic, doc, term, tf, s)


_EVIDENCE = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("toxic", T.IntegerType())]))


def score(docs: DataFrame, model: Model, evidence: int = 3) -> DataFrame:
    """``docs`` with ``score`` and ``evidence`` (the nearest examples)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # Settings bound its size
    docs = docs.drop("score", "evidence")
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("evidence", _EVIDENCE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        v = Vocabulary(m.hashes) if len(m.ids) else None
        for b in batches:
            scores, places, cosines = np.full(b.num_rows, m.bare), np.full((b.num_rows, evidence), -1), np.zeros((b.num_rows, evidence))
            for first, n, doc, term, tf in v.vectors(b["text"]) if v else ():
                if not len(doc):
                    continue
                row, doc = np.unique(doc, return_inverse=True)
                p, c = m.search(doc, term, m.weights(doc, term, tf, len(row)), len(row))
                scores[first + row] = m.calibrated(m.vote(p, c))
                places[first + row], cosines[first + row] = p[:, :evidence], c[:, :evidence]
            found = places >= 0
            cut = pa.array(np.concatenate([[0], np.cumsum(found.sum(axis=1))]).astype(np.int32))
            of = places[found]
            shown = pa.StructArray.from_arrays([pa.array(m.ids[of]), pa.array(cosines[found]), pa.array(m.toxic[of].astype(np.int32))], ["doc_id", "cosine", "toxic"])
            yield pa.RecordBatch.from_arrays([*[b[c] for c in names], pa.array(scores), pa.ListArray.from_arrays(cut, shown)], [*names, "score", "evidence"])

    return docs.mapInArrow(run, schema)


def production_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    return fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~held_out(F.col("doc_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, production_model(spark, docs, sf_dir))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.get("evidence", F.lit(0))["doc_id"].alias("nearest_id"))
