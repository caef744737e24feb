"""Codes of vectors by a codebook for each part, learned with Yinyang Lloyd rounds.

Components become integers, floor(256 * x), and vectors are cut into ``parts`` equal
consecutive parts.  The codebook of a part starts as that part of the vectors of
smallest ids.  A round gives each part its nearest entry (squared Euclidean distance,
ties to the lower index) and replaces entries by the floors of their means; after the
last round parts are assigned once more.

Entries of a codebook are clustered into groups once.  Besides its entry each part
keeps one number a group: a lower bound of its distance to the group's other entries.
When entries have moved, a bound falls by the largest drift in its group; a group is
scanned only where the bound no longer exceeds the distance to the part's own entry.
Bounds are 16-bit floats, rounded down, in units of the codebook's extent.  Floats
decide only what is scanned: all distances that are compared are exact integers, held in
floats where 53 bits are enough and in Python's integers beyond, so ties are true ties.

Each round is one pass over rows where they lie: no vector is shuffled.  A task adds up
its parts by entry and sends one row an entry; only the sums meet.  The driver and every
task hold the codebooks (``entries`` times a vector), nothing that grows with the table.
Each round's rows are written to shared storage and the round's before it deleted.

Cases: vectors that are null or hold null or non-finite components are dropped; vectors
shorter than the longest, and lengths that are no multiple of ``parts``, count as padded
with zeros; very long vectors are taken in blocks of few rows; rows with equal ids are rows
each, and start in order of their components; a null id is kept, and last in that order;
equal vectors among the first give equal entries, of which the lower index takes all; with
fewer vectors than entries there are as many entries as vectors; an empty table gives no
row; components beyond 2^61 are held there, and errors at the end of 64 bits; extra columns, whatever their names, do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.skew import salted_join
from chatloom.llm.topk import integers, matrix
from chatloom.runtime import discard, materialise, ship, table

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Entries of a group, on average; numbers of a block of rows.
GROUP, BLOCK = 10, 1 << 20
_EXACT, _HELD, _END = 2.0**53, 2.0**61, 2**63 - 1


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows: as floats that hold them, or as Python's integers where ``x`` has these."""
    if x.dtype == object:
        return np.array([((x - e) ** 2).sum(axis=1) for e in c], object).T
    return np.einsum("ij,ij->i", x, x)[:, None] - 2 * (x @ c.T) + np.einsum("ij,ij->i", c, c)


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def _down(v: np.ndarray) -> np.ndarray:
    """16-bit floats of at most ``v``, which is not negative."""
    with np.errstate(over="ignore"):
        h = np.minimum(v, 65504.0).astype(np.float16)
    h = np.where(h.astype(np.float64) > v, np.nextafter(h, np.float16(0)), h)
    return np.where(np.isinf(v), np.float16(np.inf), h)


@dataclass
class Codebooks:
    """Entries (part, entry, component), the group of each, its drift since the round before, and a unit for bounds of each part."""

    entries: np.ndarray
    group: np.ndarray
    groups: int
    drift: np.ndarray
    unit: np.ndarray

    @staticmethod
    def of(entries: np.ndarray, group_size: int = GROUP) -> Codebooks:
        parts, k, _ = entries.shape
        groups = max(1, k // group_size)
        group = np.zeros((parts, k), np.int64)
        for p, c in enumerate(entries.astype(np.float64)):
            middle = c[np.linspace(0, k - 1, groups).astype(int)]
            for _ in range(5):
                group[p] = ((c[:, None] - middle[None]) ** 2).sum(axis=2).argmin(axis=1)
                for g in np.unique(group[p]):
                    middle[g] = c[group[p] == g].mean(axis=0)
        extent = np.abs(entries.astype(np.float64)).max(axis=(1, 2), initial=0)
        return Codebooks(entries, group, groups, np.zeros((parts, groups)), np.maximum(1.0, extent / 256))

    def moved(self, sums: dict[int, tuple[int, list[int]]]) -> Codebooks:
        """The next round's: floors of means by part * entries + entry; an entry without a sum stays."""
        parts, k, width = self.entries.shape
        after = self.entries.copy()
        for cell, (n, total) in sums.items():
            after[divmod(cell, k)] = [t // n for t in total]
        step = np.sqrt(((after - self.entries).astype(np.float64) ** 2).sum(axis=2)) * (1 + 1e-9)
        drift = np.zeros((parts, self.groups))
        for p in range(parts):
            np.maximum.at(drift[p], self.group[p], step[p])
        return Codebooks(after, self.group, self.groups, drift, self.unit)

    def assign(self, p: int, x: np.ndarray, near: np.ndarray | None, low: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Nearest entry, squared distance and groups' lower bounds of rows of part ``p``, and how many distances that took.

        ``near`` and ``low`` are those of the round before; without them all groups are scanned.
        """
        n, c = len(x), self.entries[p].astype(np.float64)
        most = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
        if 4.0 * most * most * x.shape[1] >= _EXACT:
            x, c = (np.array([[int(v) for v in r] for r in a], object).reshape(a.shape) for a in (x, self.entries[p]))
        rows = np.arange(n)
        best = np.full(n, -1) if near is None else near.astype(np.int64)
        old, d = best.copy(), np.full(n, np.inf, x.dtype)
        if near is not None:
            d = ((x - c[best]) ** 2).sum(axis=1)
        own, reach = d.copy(), _root(d)  # infinite in the first round
        low = np.zeros((n, self.groups)) if low is None else np.maximum(0.0, low.astype(np.float64) * self.unit[p] * (1 - 1e-9) - self.drift[p])
        first, second = low.copy(), low.copy()
        scanned, took = np.zeros((n, self.groups), bool), 0 if near is None else n
        for g in range(self.groups):
            members = np.flatnonzero(self.group[p] == g)
            at = np.flatnonzero(low[:, g] <= reach * (1 + 1e-9))
            if not len(members) or not len(at):
                continue
            got = _squares(x[at], c[members])
            took += got.size
            scanned[at, g] = True
            place = got.argmin(axis=1)
            least = got[np.arange(len(at)), place]
            first[at, g] = _root(least)
            rest = got.copy()
            rest[np.arange(len(at)), place] = np.inf
            second[at, g] = _root(rest.min(axis=1))
            wins = (least < d[at]) | ((least == d[at]) & (members[place] < best[at]))
            best[at[wins]], d[at[wins]] = members[place[wins]], least[wins]
        # bounds: of a group that was scanned the least distance to an entry other than the part's own
        inside = self.group[p][best]
        out = np.where(scanned, first, low)
        out[rows, inside] = np.where(scanned[rows, inside], second[rows, inside], low[rows, inside])
        left = (best != old) & (old >= 0)
        home = self.group[p][old[left]]
        out[left, home] = np.minimum(out[left, home], _root(own[left]))
        out[:, np.bincount(self.group[p], minlength=self.groups) == 0] = np.inf
        return best, d, _down(np.where(np.isinf(out), np.inf, out * (1 - 1e-9) / self.unit[p])), took


def _pass(shared, first: bool, last: bool):
    """Rows of a round, and after them the task's sums by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: Codebooks = shared.value
        parts, k, width = books.entries.shape
        schema = pa.schema([("kind", pa.int32()), ("vec_id", pa.int64()), ("label", pa.string()), ("vec", pa.list_(pa.float64())), ("near", pa.binary()), ("low", pa.binary()), ("error", pa.int64()), ("cell", pa.int32()), ("n", pa.int64()), ("high", pa.list_(pa.int64())), ("rest", pa.list_(pa.int64()))])

        def made(rows: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)

        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), object)
        for whole in batches:
            size = max(1, BLOCK // max(k, parts * width))
            for lo in range(0, whole.num_rows, size):
                b = whole.slice(lo, size)
                n, x = b.num_rows, matrix(b["vec"], parts * width)
                near, low = np.zeros((n, parts), np.uint16), np.zeros((n, parts, books.groups), np.float16)
                if not first:
                    near = np.frombuffer(b"".join(b["near"].to_pylist()), np.uint16).reshape(n, parts).copy()
                    low = np.frombuffer(b"".join(b["low"].to_pylist()), np.float16).reshape(low.shape).copy()
                error = np.zeros(n, object)
                for p in range(parts):
                    own = x[:, p * width : (p + 1) * width]
                    at, d, bound, _ = books.assign(p, own, None if first else near[:, p], None if first else low[:, p])
                    near[:, p], low[:, p] = at, bound
                    if last:
                        error += d.astype(np.int64).astype(object) if d.dtype != object else d
                    else:
                        count[p] += np.bincount(at, minlength=k)
                        if np.abs(own).max(initial=0) * n < _EXACT:
                            hot = np.zeros((n, k))
                            hot[np.arange(n), at] = 1
                            total[p] += (hot.T @ own).astype(np.int64).astype(object)
                        else:
                            np.add.at(total[p], at, np.array([[int(v) for v in r] for r in own], object).reshape(n, width))
                codes = pa.array([r.tobytes() for r in near], pa.binary())
                if last:
                    yield made(n, kind=pa.array(np.zeros(n, np.int32)), vec_id=b["vec_id"], label=b["label"], near=codes, error=pa.array([min(int(e), _END) for e in error], pa.int64()))
                else:
                    yield made(n, kind=pa.array(np.zeros(n, np.int32)), vec_id=b["vec_id"], label=b["label"], vec=b["vec"], near=codes, low=pa.array([r.tobytes() for r in low], pa.binary()))
        used = np.flatnonzero(count)
        if len(used):
            sums = total.reshape(parts * k, width)[used]
            high, rest = ([[int(v) >> 32 for v in r] for r in sums], [[int(v) & 0xFFFFFFFF for v in r] for r in sums])
            yield made(len(used), kind=pa.array(np.ones(len(used), np.int32)), cell=pa.array(used.astype(np.int32)), n=pa.array(count.reshape(-1)[used]), high=pa.array(high, pa.list_(pa.int64())), rest=pa.array(rest, pa.list_(pa.int64())))

    return run


_ROWS = "kind int, vec_id long, label string, vec array<double>, near binary, low binary, error long, cell int, n long, high array<long>, rest array<long>"


def _sums(rows: DataFrame, width: int) -> dict[int, tuple[int, list[int]]]:
    """Count and sums by entry: as many rows as the codebooks have components."""
    parts = rows.where("kind = 1").select("cell", "n", F.posexplode(F.arrays_zip("high", "rest")).alias("i", "s"))
    wide = "decimal(38,0)"
    found: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("cell", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s.high").cast(wide)).alias("high"), F.sum(F.col("s.rest").cast(wide)).alias("rest")).collect():
        found.setdefault(r.cell, (r.n, [0] * width))[1][r.i] = (int(r.high) << 32) + int(r.rest)
    return found


@dataclass
class Coded:
    """Rows (vec_id, label as text, codes, error) and the final codebooks (part, entry, component), None of an empty table."""

    rows: DataFrame
    entries: np.ndarray | None

    def digest(self) -> str:
        """Hex digest of all components' decimals by part, entry and position."""
        flat = [] if self.entries is None else self.entries.reshape(-1)
        return hashlib.sha256(",".join(str(int(v)) for v in flat).encode()).hexdigest()


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Coded:
    """Codes of ``vectors`` (vec_id, embedding, label): ``codes`` is a list of entry indexes in part order."""
    spark = vectors.sparkSession
    ship(spark)
    if not 0 < entries <= 65536:
        raise ValueError("a code has 16 bits")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), integers(F.col("embedding")).alias("vec"))
    rows = rows.where(F.col("vec").isNotNull()).withColumn("vec", F.transform("vec", lambda v: F.least(F.greatest(v, F.lit(-_HELD)), F.lit(_HELD))))
    first = rows.select("vec_id", "vec").orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).collect()
    if not first:
        return Coded(spark.createDataFrame([], "vec_id long, label string, codes array<int>, error long"), None)
    width = -(-max(1, rows.agg(F.max(F.size("vec"))).first()[0]) // parts)
    start = np.zeros((len(first), parts * width), np.int64)
    for i, r in enumerate(first):
        start[i, : len(r.vec)] = [int(v) for v in r.vec]
    books = Codebooks.of(start.reshape(len(first), parts, width).transpose(1, 0, 2).copy())
    for i in range(rounds):
        step = rows.mapInArrow(_pass(spark.sparkContext.broadcast(books), i == 0, False), _ROWS)
        written = materialise(step, "codes-round", by="kind")
        books = books.moved(_sums(written, width))
        if i:
            discard(before)  # noqa: F821  of the round before
        before, rows = written, written.where("kind = 0")
    last = rows.mapInArrow(_pass(spark.sparkContext.broadcast(books), not rounds, True), _ROWS)
    codes = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.conv(F.hex(F.reverse(F.substring(F.col("near"), 2 * p + 1, F.lit(2)))), 16, 10).cast("int"))
    done = materialise(last.select("vec_id", "label", "near", "error"), "codes")
    if rounds:
        discard(before)
    return Coded(done.select("vec_id", "label", codes.alias("codes"), "error"), books.entries)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "embeddings"))
    total = coded.rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    rows = salted_join(coded.rows, total, ["label"])
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return rows.select("vec_id", code.alias("code"), "error", F.least("total", F.lit(_END)).cast("long").alias("label_error"), F.lit(coded.digest()).alias("codebooks_sha256"))


def _oracle() -> str:
    square = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT x.rn, x.p, any_value(x.v) AS v, arg_min(c.e, ({square}, c.e)) AS e, min({square}) AS d FROM x JOIN c{i} c ON c.p = x.p GROUP BY x.rn, x.p)")
        if i < ROUNDS:
            steps.append(
                f"""s{i} AS (SELECT p, e, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) AS i FROM a{i}) GROUP BY p, e, i),
m{i} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{i} GROUP BY p, e),
c{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (p, e))"""
            )
    last = f"a{ROUNDS}"
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, vec) - 1 AS rn, vec_id, label, vec FROM (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
w AS (SELECT CAST(ceil(max(len(vec)) / {PARTS}) AS BIGINT) AS w FROM k),
x AS MATERIALIZED (SELECT rn, p, list_resize(vec[p * w + 1:p * w + w], w, 0) AS v FROM k, w, range({PARTS}) t(p)),
c0 AS (SELECT p, rn AS e, v FROM x WHERE rn < {ENTRIES}),
{", ".join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS}),
r AS (SELECT rn, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM {last} GROUP BY rn)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN k USING (rn), h"""


ORACLE = _oracle()
