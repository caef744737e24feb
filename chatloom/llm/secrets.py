r"""Secret scan with multipart credential linking.

Strong patterns are reported wherever they stand.  Weak parts (an account or key
identifier, a high-entropy token, an endpoint) mean little alone: each token is
linked by an interval join with identifiers and endpoints whose spans lie within
``scope`` characters of its own, and all three are reported if both complements
are there.

The join is on document and position bucket: parts of a kind do not overlap and
have six characters at least, so a bucket of ``scope`` characters holds a bounded
number of them, whatever the document's length.

Cases: null texts count as empty; equal rows (id and text) are found out once and
each has its row; rows with equal ids and different texts keep apart by a hash of
the text; very long texts are searched whole; an empty table gives no row; extra columns do not matter.

Only DataFrame functions run here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.runtime import materialise, table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
#: Parts of the linking method.
IDENTIFIER = r"""(?i)(?:client_?id|access_?id|account|username|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{6,}"""
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"""(?i)(?:https?://|host["']?\x20*[:=]\x20*["']?)[^\x00-\x20"'<>]{4,}"""
SCOPE = 200
_FEW = 512
_SPANS = "array<struct<s:bigint,e:bigint,m:string>>"


def _offsets(pairs: Column, start: Column) -> Column:
    def step(acc: Column, p: Column) -> Column:
        s = acc["at"] + p["gap"]
        e = s + p["len"]
        return F.struct(e.alias("at"), F.array_append(acc["out"], F.struct(s.alias("s"), e.alias("e"), p["m"].alias("m"))).alias("out"))

    return F.aggregate(pairs, F.struct(start.cast("long").alias("at"), F.array().cast(_SPANS).alias("out")), step)["out"]


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once: a lambda's body is worked out anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _long(pairs: Column) -> Column:
    """Offsets of many matches: sums of chunks first, so that the work stays far below the square of their number."""
    chunks = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _FEW).cast("int"))
    cut = F.transform(chunks, lambda c: F.slice(pairs, c * _FEW + 1, _FEW))
    sums = F.transform(cut, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, p: a + p["gap"] + p["len"]))
    starts = F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
    return F.flatten(F.zip_with(cut, F.slice(starts, F.lit(1), F.size(chunks)), _offsets))


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as (s, e, m): code points, end exclusive, and the match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # the text between matches; what follows the last one has no match beside it
    pairs = F.zip_with(found, F.split(text, pattern, -1), lambda m, g: F.struct(F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("len"), m.alias("m")))
    pairs = F.filter(pairs, lambda p: p["m"].isNotNull())
    made = _bound(pairs, lambda p: F.when(F.size(p) <= _FEW, _offsets(p, F.lit(0))).otherwise(_long(p)))
    return F.when(~text.rlike(pattern), F.array().cast(_SPANS)).otherwise(made)


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the row), and the spans of each kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    kinds = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "identifier": IDENTIFIER, "token": TOKEN, "endpoint": ENDPOINT}
    rows = rows.select("doc_id", "key", *[spans(F.col("text"), p).alias(k) for k, p in kinds.items()])
    rows = rows.withColumn("assign", F.filter("assign", lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 12))
    rows = rows.withColumn("access", F.filter("access", lambda x: F.length(x["m"]) >= 18))
    return rows.select("doc_id", "key", *[F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(k) for k in kinds])


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, key, kind, s, e of weak parts that have both complements in their scope."""
    base = found.where(F.size("token") > 0).select("doc_id", "key", "access", "identifier", "token", "endpoint").distinct()

    def wide(spans_: Column, kind: str) -> DataFrame:
        out = base.select("doc_id", "key", F.explode(spans_).alias("x")).select("doc_id", "key", F.col("x.s").alias("s"), F.col("x.e").alias("e"))
        # a part is put in every bucket that a token within its scope can start in
        low, high = F.floor((F.col("s") - scope) / scope), F.floor((F.col("e") + scope) / scope)
        if kind == "token":
            return out.withColumn("bucket", F.floor(F.col("s") / scope))
        return out.withColumn("bucket", F.explode(F.sequence(low - 1, high)))

    tokens = wide(F.col("token"), "token").alias("t")
    ids = wide(F.array_union("access", "identifier"), "identifier").alias("i")
    ends = wide(F.col("endpoint"), "endpoint").alias("n")

    def near(left: str, right: str) -> Column:
        gap = F.greatest(F.col(f"{left}.s") - F.col(f"{right}.e"), F.col(f"{right}.s") - F.col(f"{left}.e"))
        # parts that overlap are one string, not two that complement each other
        same = [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in ("doc_id", "key", "bucket")]
        return same[0] & same[1] & same[2] & (gap >= 0) & (gap <= scope)

    with_id = tokens.join(ids, near("t", "i")).select("t.doc_id", "t.key", "t.bucket", "t.s", "t.e", F.struct("i.s", "i.e").alias("id")).alias("t")
    both = with_id.join(ends, near("t", "n")).select("t.doc_id", "t.key", F.struct("t.s", "t.e").alias("token"), "t.id", F.struct("n.s", "n.e").alias("end"))
    named = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c)["s"].alias("s"), F.col(c)["e"].alias("e")) for k, c in (("weak_id", "id"), ("weak_secret", "token"), ("endpoint", "end"))])
    return both.select("doc_id", "key", F.explode(named).alias("x")).select("doc_id", "key", "x.*").distinct()


_ORDER = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")


def _listed(found: Column) -> Column:
    order = F.array_sort(F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.array_position(F.array(*[F.lit(k) for k in _ORDER]), x["kind"]).alias("k"), x["e"].alias("e"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda x: F.concat(x["kind"], F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def _named(kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, assign, access, hex, linked of each row: arrays of (kind, s, e)."""
    found = materialise(parts(docs), "secret-parts")
    linked = link(found, scope).groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("kind", "s", "e"))).alias("linked"))
    linked = materialise(linked, "secret-links").select(F.col("doc_id").alias("__d"), F.col("key").alias("__k"), "linked")
    out = found.join(linked, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("key") == F.col("__k")), "left")
    # an AKIA identifier that takes part in a link is a strong span already
    weak = F.filter("linked", lambda x: ~F.exists("access", lambda a: (a["s"] == x["s"]) & (a["e"] == x["e"]) & (x["kind"] == "weak_id")))
    return out.select("doc_id", *[_named(k).alias(k) for k in ("assign", "access", "hex")], F.coalesce(weak, F.array().cast("array<struct<kind:string,s:bigint,e:bigint>>")).alias("linked"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat(base, F.col("linked"))).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )
