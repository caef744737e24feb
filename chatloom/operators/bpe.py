"""Byte-pair encoding of conversations: each is encoded once, and its ids are cut at the ends of its segments."""

from __future__ import annotations

import heapq
import json
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from chatloom.runtime import ship

#: Fixed value: the pieces of text inside which byte-level vocabularies merge, where they say nothing else.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of a vocabulary file, which every task holds; encoded pieces that a task remembers.
FILE_BYTES, KNOWN = 64 << 20, 1 << 16


class Unstable(ValueError):
    """The ids of the text up to a segment's end are not the first ids of the whole text."""


def _signs() -> list[str]:
    """The sign that stands for each byte in a vocabulary file: printable ones for themselves, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@dataclass
class Vocabulary:
    """Ids and ranks of byte strings; special tokens are split off first, then ``pieces``, in which pairs merge by rank."""

    ids: dict[bytes, int]
    ranks: dict[tuple[bytes, bytes], int]
    special: dict[str, int] = field(default_factory=dict)
    pieces: str = PIECES

    @staticmethod
    def of(merges: list[tuple[bytes, bytes]], special: tuple[str, ...] = (), pieces: str = PIECES) -> Vocabulary:
        """A vocabulary of the bytes, the merges and the special tokens, in that order."""
        symbols = [*(bytes([b]) for b in range(256)), *(a + b for a, b in merges)]
        return Vocabulary({s: i for i, s in enumerate(dict.fromkeys(symbols))}, {m: i for i, m in enumerate(merges)}, pieces=pieces).with_special(special)

    @staticmethod
    def parse(text: str) -> Vocabulary:
        """Out of the JSON of a byte-level vocabulary file."""
        data = json.loads(text)
        byte = {s: b for b, s in enumerate(_signs())}
        raw = lambda token: bytes(byte[c] for c in token)
        added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        before = data.get("pre_tokenizer") or {}
        steps = before.get("pretokenizers", [before])
        if data["model"]["type"] != "BPE" or not any(s.get("type") == "ByteLevel" for s in steps) or any(s.get("add_prefix_space") for s in steps) or data.get("normalizer"):
            raise ValueError("this is no plain byte-level vocabulary")
        pieces = next((s["pattern"]["Regex"] for s in steps if s.get("type") == "Split"), PIECES)
        merges = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in data["model"]["merges"]]
        ids = {raw(t): i for t, i in data["model"]["vocab"].items() if t not in added}
        return Vocabulary(ids, {m: i for i, m in enumerate(merges)}, added, pieces)

    def text(self) -> str:
        """The JSON that :meth:`parse` reads."""
        signs = _signs()
        shown = lambda b: "".join(signs[x] for x in b)
        vocab = {shown(b): i for b, i in self.ids.items()} | self.special
        before = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": self.pieces}, "behavior": "Isolated", "invert": False}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}]}
        added = [{"id": i, "content": t, "special": True, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False} for t, i in self.special.items()]
        return json.dumps({"version": "1.0", "added_tokens": added, "normalizer": None, "pre_tokenizer": before, "post_processor": None, "decoder": None, "model": {"type": "BPE", "vocab": vocab, "merges": [[shown(a), shown(b)] for a, b in self.ranks]}})

    def with_special(self, tokens: tuple[str, ...]) -> Vocabulary:
        """With the special tokens that it lacks, under the next ids."""
        special, at = dict(self.special), max([*self.ids.values(), *self.special.values()], default=-1) + 1
        for t in tokens:
            if t not in special:
                special[t], at = at, at + 1
        return Vocabulary(self.ids, self.ranks, special, self.pieces)


def merge(piece: bytes, ranks: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """The piece's bytes, of which the pair of least rank, the leftmost first, is joined until none has a rank."""
    part = [piece[i : i + 1] for i in range(len(piece))]
    after, before = [*range(1, len(part)), -1], [-1, *range(len(part) - 1)]
    queue: list[tuple[int, int, bytes, bytes]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] >= 0 and (r := ranks.get((part[i], part[after[i]]))) is not None:
            heapq.heappush(queue, (r, i, part[i], part[after[i]]))

    for i in range(len(part) - 1):
        offer(i)
    while queue:
        _, i, a, b = heapq.heappop(queue)
        j = after[i]
        if part[i] != a or j < 0 or part[j] != b:  # one of them has been joined since
            continue
        part[i], part[j], after[i] = a + b, b"", after[j]
        if after[j] >= 0:
            before[after[j]] = i
        after[j] = -1
        offer(before[i])
        offer(i)
    return [p for p in part if p]


class Encoder:
    """A vocabulary at work in one task."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {}
        self.pieces = regex.compile(vocabulary.pieces)
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def _piece(self, piece: str) -> tuple[list[int], list[int]]:
        """Ids of a piece and the bytes that each stands for."""
        if piece not in self.known:
            if len(self.known) >= KNOWN:
                self.known.clear()
            got = merge(piece.encode(), self.vocabulary.ranks)
            self.known[piece] = [self.vocabulary.ids[p] for p in got], [len(p) for p in got]
        return self.known[piece]

    def _stretches(self, text: str) -> Iterator[tuple[int, int, int | None]]:
        """(begin, end, id) of special tokens, and of the text between them without an id."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            if m.start() > at:
                yield at, m.start(), None
            yield m.start(), m.end(), self.vocabulary.special[m[0]]
            at = m.end()
        if at < len(text):
            yield at, len(text), None

    def encode(self, segments: list[str]) -> list[list[int]]:
        """Ids of the joined segments, by segment; :class:`Unstable` where those of a prefix would be others."""
        text, ids, ends, size, starts, firsts = "".join(segments), [], [], 0, [], []
        for begin, end, special in self._stretches(text):
            if special is not None:
                starts.append(begin)
                firsts.append(len(ids))
                size += len(text[begin:end].encode())
                ids.append(special)
                ends.append(size)
                continue
            for m in self.pieces.finditer(text, begin, end):
                starts.append(m.start())
                firsts.append(len(ids))
                for i, n in zip(*self._piece(m[0]), strict=True):
                    size += n
                    ids.append(i)
                    ends.append(size)
        out, done, cut, bytes_ = [], 0, 0, 0
        for s in segments:
            cut, bytes_ = cut + len(s), bytes_ + len(s.encode())
            at = bisect_left(ends, bytes_) + 1 if bytes_ else 0
            if bytes_ and (ends[at - 1] != bytes_ or not self._stable(text, cut, starts, firsts, ids, at)):
                raise Unstable(f"ids change at character {cut}")
            out.append(ids[done:at])
            done = at
        return out

    def _stable(self, text: str, cut: int, starts: list[int], firsts: list[int], ids: list[int], at: int) -> bool:
        """Whether text up to ``cut`` has the ids up to ``at``. Only the white space before the cut, and the piece before that, can tell."""
        if cut == len(text):
            return True
        solid = cut
        while solid > 0 and text[solid - 1].isspace():
            solid -= 1
        piece = max(0, bisect_left(starts, solid) - 1)
        tail, again = text[starts[piece] : cut], []
        for a, z, special in self._stretches(tail):
            again += [special] if special is not None else [i for m in self.pieces.finditer(tail, a, z) for i in self._piece(m[0])[0]]
        return ids[firsts[piece] : at] == again


def encoder(vocabulary: Vocabulary, strict: bool = True) -> Callable[[Column], Column]:
    """A tokenizer of an array of texts that follow one another: ids of each. Unstable ones are an error, or null if not ``strict``."""
    spark = SparkSession.active()
    ship(spark)
    shared = spark.sparkContext.broadcast(vocabulary)  # FILE_BYTES bounds it

    @F.arrow_udf("array<array<bigint>>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = Encoder(shared.value)
        for b in batches:
            out = []
            for segments in b.to_pylist():
                try:
                    out.append(None if segments is None else work.encode([s or "" for s in segments]))
                except Unstable:
                    if strict:
                        raise
                    out.append(None)
            yield pa.array(out, pa.list_(pa.list_(pa.int64())))

    return ids


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def load(spark: SparkSession, path: str) -> Vocabulary:
    fs, at = _store(spark, path)
    if fs.getFileStatus(at).getLen() > FILE_BYTES:
        raise ValueError(f"{path} has more than {FILE_BYTES} bytes")
    return Vocabulary.parse(spark.read.text(path, wholetext=True).first()[0])


def save(spark: SparkSession, vocabulary: Vocabulary, path: str) -> None:
    """Written under another name, then renamed."""
    fs, final = _store(spark, path)
    _, made = _store(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(made, True)
    out.write(bytearray(vocabulary.text().encode()))
    out.close()
    fs.delete(final, False)
    if not fs.rename(made, final):
        raise OSError(f"{path} can't be written")


def prepare(spark: SparkSession, source: str, target: str, special: tuple[str, ...]) -> Vocabulary:
    """A vocabulary file with special tokens added, saved, read again and verified: each is one id of its own, also inside text."""
    save(spark, load(spark, source).with_special(special), target)
    made = load(spark, target)
    work = Encoder(made)
    ids = [made.special.get(t) for t in special]
    if None in ids or len(set(ids)) != len(ids) or any(work.encode([f"a {t} b"])[0].count(i) != 1 or work.encode([t]) != [[i]] for t, i in zip(special, ids, strict=True)):
        raise ValueError("a special token is missing from the saved vocabulary, or is no single id")
    return made
