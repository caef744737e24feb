"""Languages of the words of a text by a linear-chain conditional random field.

Words are runs of letters.  A word's features are its byte pairs and triples, its
beginnings and ends, the word itself, and the lexicons that hold it; hashed into a table
of weights by language, they give its score in each language.  Learned weights of
transitions join the scores of neighbouring words, and forward-backward gives each word
its probabilities.  A text's score is the mean over its words, its language the
likeliest; ``identify`` also gives the runs of words of one language.

Learning: documents have one label each, their words take it.  Sequences join two spans
of different documents, so that labels switch inside them and transitions are learned.
The conditional likelihood is raised by Adam over the whole sample, with a ridge.
Lexicons count the words of all learnable documents: a language's lexicon has the words
that make up a ``common`` share of its words, so it has 1 / ``common`` words at most.
Weights are fitted on a bounded sample: about ``spans`` spans of ``chars`` characters,
dealt evenly over the languages by the hash of doc_id.  Languages of fewer than a ``rare``
share of the documents are not learned; that bounds how many there are.

All rows and whole texts are scored.  A sequence has ``piece`` words; longer texts are
several, whose probabilities are averaged.  Forward-backward runs over the sequences of a
block side by side, and the features of a word are added up once while a task remembers it.

Cases: null texts, empty ones and texts without a letter are ``und`` with score 0; a text whose
letters stand only in rare symbols gets the most frequent language and its share; equal
probabilities go to the language that sorts first; rows without an id are scored and never
learned from; equal rows get equal scores; very long texts are many sequences; without a learnable
document every text is ``und``; an empty table gives no row; other columns pass through,
and those named ``lang_pred``, ``score`` and ``runs`` are replaced.
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

NONE = "und"


@dataclass(frozen=True)
class Settings:
    spans: int = 4_000
    chars: int = 400
    common: float = 1e-4
    rare: float = 1e-3
    weights: int = 1 << 20  #: numbers of the table of weights
    rounds: int = 40
    rate: float = 0.15
    ridge: float = 1e-5
    piece: int = 512
    block: int = 2 << 20  #: bytes of text scored together
    known: int = 1 << 18  #: words that a task remembers


PRODUCTION = Settings()
_LETTER = np.array([0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
_OTHER = np.array([b in (0xAA, 0xB5, 0xBA) for b in range(256)])  # letters among the signs after 0xC2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capitals from U+00C0 to U+00DE in lower case."""
    low = kernel.lowered(data)
    at = np.flatnonzero(low[:-1] == 0xC3) + 1
    at = at[(low[at] >= 0x80) & (low[at] <= 0x9E) & (low[at] != 0x97)]
    low[at] += 0x20
    return low


def _letters(low: np.ndarray) -> np.ndarray:
    """Bytes of letters: a-z and all beyond ASCII but for signs of Latin-1 and of U+2000 to U+2BFF."""
    mask = _LETTER[low]
    at = np.flatnonzero(low[:-1] == 0xC2)
    mask[at] = mask[at + 1] = _OTHER[low[at + 1]]
    at = np.flatnonzero(low[:-1] == 0xC3)
    at = at[(low[at + 1] == 0x97) | (low[at + 1] == 0xB7)]
    mask[at] = mask[at + 1] = False
    at = np.flatnonzero(low[:-2] == 0xE2)
    at = at[low[at + 1] <= 0xAF]
    mask[at] = mask[at + 1] = mask[at + 2] = False
    return mask


def _words(block: kernel.Block) -> tuple[np.ndarray, kernel.Words]:
    low = _lowered(block.data)
    start, end = kernel.spans(block, _letters(low))
    first = np.searchsorted(start, block.offsets)
    return low, kernel.Words(start, end, kernel.range_hashes(low, start, end), np.repeat(np.arange(len(block)), np.diff(first)), first)


def _ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())


def features(low: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, lexicons: list[np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, weight row) of all features of words; rows from ``buckets`` on are those of lexicons."""
    size = end - start
    begin = np.cumsum(size + 2) - size - 2
    text = np.full(int(size.sum()) + 2 * len(size), 0x20, np.uint8)
    text[_ragged(begin + 1, size)] = low[_ragged(start, size)]
    sums, word, rows = kernel.running(text), [], []

    def add(of: np.ndarray, a: np.ndarray, n: int | np.ndarray, kind: int) -> None:
        h = kernel.mix64(kernel.range_hashes(text, a, a + n, sums) + np.uint64(kind))
        word.append(of)
        rows.append((h % np.uint64(buckets)).astype(np.int64))

    every = np.arange(len(size))
    for n in (2, 3):
        count = np.maximum(0, size + 3 - n)
        add(np.repeat(every, count), _ragged(begin, count), n, 0)
    for n in (4, 5):
        of = every[size + 1 >= n]
        add(of, begin[of], n, 0)
        add(of, begin[of] + size[of] + 2 - n, n, 0)
    add(every, begin, size + 2, 1)
    for i, lexicon in enumerate(lexicons):
        at = np.minimum(np.searchsorted(lexicon, hashes), max(0, len(lexicon) - 1))
        of = every[lexicon[at] == hashes] if len(lexicon) else every[:0]
        word.append(of)
        rows.append(np.full(len(of), buckets + i))
    word, rows = np.concatenate(word), np.concatenate(rows)
    order = np.argsort(word, kind="stable")
    return word[order], rows[order]


def _totals(word: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by word, which is sorted and has at least one row for each of ``n``."""
    return np.add.reduceat(values, np.searchsorted(word, np.arange(n))) if n else np.zeros((0, values.shape[1]))


def forward_backward(score: np.ndarray, first: np.ndarray, length: np.ndarray, start: np.ndarray, move: np.ndarray, pairs: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Probabilities of each word's labels, and the log of the sum over labellings; sequences are ``length`` rows from ``first`` on.

    ``start`` and ``move`` are log weights. Expected transitions are added to ``pairs``. Sequences advance side by side, the longest first.
    """
    top = score.max(axis=1, keepdims=True) if score.size else score
    e, out, norm = np.exp(score - top), np.empty_like(score), np.ones(len(score))
    step, begin = np.exp(move), np.exp(start)
    order = np.argsort(-length, kind="stable")
    f, size = first[order], length[order]
    live = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), side="right")
    for t, n in enumerate(live):
        i = f[:n] + t
        a = e[i] * (begin if t == 0 else out[i - 1] @ step)
        norm[i] = a.sum(axis=1)
        out[i] = a / norm[i][:, None]
    after = np.ones((len(f), score.shape[1]))
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        i = f[:n] + t
        back = e[i] * after[:n] / norm[i][:, None]
        if t and pairs is not None:
            pairs += (out[i - 1].T @ back) * step
        out[i] *= after[:n]
        after[:n] = back @ step.T
    return out, float(np.log(norm).sum() + top.sum())


@dataclass
class Model:
    """Languages in order, weights (bucket or lexicon, language), log weights of transitions and starts, lexicons as sorted hashes."""

    langs: list[str]
    lexicons: list[np.ndarray]
    buckets: int
    weight: np.ndarray
    move: np.ndarray
    start: np.ndarray
    share: np.ndarray
    settings: Settings = field(default_factory=Settings)


class Scorer:
    """A model, and the scores of the words that a task has met."""

    def __init__(self, model: Model):
        self.model, self.hashes, self.scores = model, np.zeros(0, np.uint64), np.zeros((0, len(model.langs)))

    def scored(self, low: np.ndarray, w: kernel.Words) -> np.ndarray:
        m = self.model
        u, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.hashes, u), max(0, len(self.hashes) - 1))
        known = self.hashes[place] == u if len(self.hashes) else np.zeros(len(u), bool)
        out = np.empty((len(u), len(m.langs)))
        out[known] = self.scores[place[known]]
        new = np.flatnonzero(~known)
        for lo in range(0, len(new), 1 << 14):
            part = new[lo : lo + (1 << 14)]
            word, rows = features(low, w.start[at[part]], w.end[at[part]], u[part], m.lexicons, m.buckets)
            out[part] = _totals(word, m.weight[rows], len(part))
        if len(self.hashes) + len(new) > m.settings.known:
            self.hashes, self.scores = u[: m.settings.known], out[: m.settings.known]
        else:
            order = np.argsort(hashes := np.concatenate([self.hashes, u[new]]), kind="stable")
            self.hashes, self.scores = hashes[order], np.concatenate([self.scores, out[new]])[order]
        return out[back]

    def labels(self, block: kernel.Block) -> tuple[np.ndarray, kernel.Words]:
        """Probabilities of the languages of each word of a block."""
        low, w = _words(block)
        piece, count = self.model.settings.piece, np.diff(w.first)
        pieces = -(-count // piece)
        nth = _ragged(np.zeros(len(pieces), np.int64), pieces)
        of = np.repeat(np.arange(len(count)), pieces)
        first = w.first[:-1][of] + nth * piece
        length = np.minimum(piece, w.first[1:][of] - first)
        return forward_backward(self.scored(low, w), first, length, self.model.start, self.model.move)[0], w


def train(spans: list[tuple[str, int]], langs: list[str], lexicons: list[np.ndarray], share: np.ndarray, s: Settings = PRODUCTION) -> Model:
    """A model fitted on (text, language index) spans; a sequence is two spans that follow each other."""
    k = len(langs)
    buckets = max(1 << 10, s.weights // k)
    m = Model(langs, lexicons, buckets, np.zeros((buckets + k, k), np.float32), np.zeros((k, k)), np.zeros(k), share, s)
    column = pa.array([t for t, _ in spans], pa.string())
    lows, starts, ends, hashes, counts, at = [], [], [], [], [], 0
    for block in kernel.blocks(column):
        low, w = _words(block)
        lows.append(low)
        starts.append(w.start + at)
        ends.append(w.end + at)
        hashes.append(w.hash)
        counts.append(np.diff(w.first))
        at += len(low)
    count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    if not count.sum():
        return m
    low, start, end = np.concatenate(lows), np.concatenate(starts), np.concatenate(ends)
    gold = np.repeat(np.array([g for _, g in spans]), count)
    u, place, back = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    word, rows = features(low, start[place], end[place], u, lexicons, buckets)
    used, rows = np.unique(rows, return_inverse=True)
    total = np.add.reduceat(count, np.arange(0, len(count), 2))
    total = total[total > 0]
    first = np.cumsum(total) - total
    inner = np.ones(len(gold), bool)
    inner[first] = False
    inner = np.flatnonzero(inner)
    told = np.zeros((k, k))
    np.add.at(told, (gold[inner - 1], gold[inner]), 1)
    began = np.bincount(gold[first], minlength=k)
    x = [np.zeros((len(used), k)), m.move, m.start]
    mean, square = [np.zeros_like(v) for v in x], [np.zeros_like(v) for v in x]
    for i in range(1, s.rounds + 1):
        expected = np.zeros((k, k))
        p, _ = forward_backward(_totals(word, x[0][rows], len(u))[back], first, total, x[2], x[1], expected)
        start_gap = p[first].sum(axis=0) - began
        p[np.arange(len(gold)), gold] -= 1
        by_word = np.stack([np.bincount(back, p[:, j], len(u)) for j in range(k)], axis=1)
        of_word = by_word[word]
        by_row = np.stack([np.bincount(rows, of_word[:, j], len(used)) for j in range(k)], axis=1)
        for j, g in enumerate((by_row, expected - told, start_gap)):
            g = g / len(gold) + s.ridge * x[j]
            mean[j] += 0.1 * (g - mean[j])
            square[j] += 0.01 * (g * g - square[j])
            x[j] -= s.rate * (mean[j] / (1 - 0.9**i)) / (np.sqrt(square[j] / (1 - 0.99**i)) + 1e-8)
    m.weight[used], m.move, m.start = x[0], x[1], x[2]
    return m


def _word_counts(of: dict[str, int]):
    """Words by language: one row a word, language and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = np.array([of[v] for v in b["lang"].to_pylist()], np.int64)
            for block in kernel.blocks(b["text"]):
                _, w = _words(block)
                mine = lang[block.first : block.first + len(block)][w.doc]
                order = np.lexsort((w.hash, mine))
                h, g = w.hash[order], mine[order]
                cut = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])) if len(h) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(g[cut].astype(np.int32)), pa.array(h[cut].view(np.int64)), pa.array(np.diff(np.concatenate([cut, [len(h)]])))], ["lang", "hash", "n"])

    return run


def _span(text: Column, chars: int, seed: Column) -> Column:
    """``chars`` characters from a place that ``seed`` gives, without the words that its ends cut."""
    room = F.greatest(F.length(text) - chars, F.lit(0))
    at = F.pmod(seed, room + 1).cast("int")
    cut = F.substring(text, at + 1, F.lit(chars))
    cut = F.when(at > 0, F.regexp_replace(cut, r"^\p{L}+", "")).otherwise(cut)
    return F.when(at < room, F.regexp_replace(cut, r"\p{L}+$", "")).otherwise(cut)


def fit(docs: DataFrame, learn: Column | None = None, s: Settings = PRODUCTION) -> Model | None:
    """A model of ``docs`` (doc_id, text, lang) under ``learn``, a condition on doc_id; None without a learnable document."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows if learn is None else rows.where(learn)
    total = rows.count()
    counts = rows.groupBy("lang").count().where(F.col("count") >= s.rare * total).collect()
    if not counts:
        return None
    counts = {r.lang: r["count"] for r in sorted(counts, key=lambda r: r.lang)}
    langs = list(counts)
    of = {g: i for i, g in enumerate(langs)}
    learned = rows.where(F.col("lang").isin(langs))
    words = learned.select("lang", "text").mapInArrow(_word_counts(of), "lang int, hash long, n long").groupBy("lang", "hash").agg(F.sum("n").alias("n"))
    words = materialise(words, "language-words")
    sums = {r.lang: r.n for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    least = F.element_at(F.create_map(*[F.lit(v) for i in range(len(langs)) for v in (i, s.common * sums.get(i, 0))]), F.col("lang"))
    held = words.where(F.col("n") >= least).toArrow()  # 1 / common words of a language at most
    lang, hashes = held["lang"].to_numpy(), held["hash"].to_numpy().view(np.uint64)
    lexicons = [np.sort(hashes[lang == i]) for i in range(len(langs))]
    want = max(20, s.spans // len(langs))
    share = F.element_at(F.create_map(*[F.lit(v) for g in langs for v in (g, min(1.0, want / counts[g]))]), F.col("lang"))
    draw = F.xxhash64(F.lit(11), F.col("doc_id").cast("string"))
    chosen = learned.where((F.pmod(draw, F.lit(1 << 30)) / float(1 << 30)) < share)
    chosen = chosen.select(draw.alias("draw"), "lang", _span(F.col("text"), s.chars, F.xxhash64(F.lit(12), F.col("doc_id").cast("string"))).alias("span"))
    spans = sorted((r.draw, r.span or "", of[r.lang]) for r in chosen.collect())
    n = np.array([counts[g] for g in langs], float)
    return train([(t, g) for _, t, g in spans], langs, lexicons, n / n.sum(), s)


_RUNS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("lang", T.StringType())]))


def identify(docs: DataFrame, model: Model | None, runs: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, and if asked ``runs``: (first word, words, language) of neighbours of one language."""
    ship(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "runs")
    names = docs.columns
    fields = [*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *([T.StructField("runs", _RUNS)] if runs else [])]
    if model is None:
        out = docs.withColumns({"lang_pred": F.lit(NONE), "score": F.lit(0.0)})
        return out.withColumn("runs", F.array().cast(_RUNS)) if runs else out
    shared = docs.sparkSession.sparkContext.broadcast(model)  # Settings bound its size
    mark = "__letter"
    marked = docs.withColumn(mark, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        scorer, langs, k = Scorer(m), np.array([*m.langs, NONE], object), len(m.langs)
        for b in batches:
            lettered = b[mark].to_numpy(zero_copy_only=False)
            best, score = np.where(lettered, int(m.share.argmax()), k), np.where(lettered, m.share.max(), 0.0)
            found = [[] for _ in range(b.num_rows)]
            for block in kernel.blocks(b["text"], m.settings.block):
                p, w = scorer.labels(block)
                n = np.diff(w.first)
                sums = np.stack([np.bincount(w.doc, p[:, j], len(block)) for j in range(k)], axis=1)
                here = np.flatnonzero((n > 0) & lettered[block.first : block.first + len(block)])
                mean = np.round(sums[here] / n[here][:, None], 9)
                best[block.first + here] = mean.argmax(axis=1)
                score[block.first + here] = np.clip(mean.max(axis=1), 0.0, 1.0)
                if runs and len(p):
                    own = p.argmax(axis=1)
                    cut = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (w.doc[1:] != w.doc[:-1])]))
                    for a, z in zip(cut, [*cut[1:], len(own)], strict=True):
                        found[block.first + w.doc[a]].append({"first": int(a - w.first[w.doc[a]]), "words": int(z - a), "lang": m.langs[own[a]]})
            columns = [*(b[c] for c in names), pa.array(langs[best], pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(found, pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())])))] if runs else [])], [f.name for f in fields])

    return marked.mapInArrow(run, T.StructType(fields))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, ~held_out(F.col("doc_id")))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
