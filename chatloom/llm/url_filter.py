r"""URL filter: fixed rules, and a path-template tree per host for what no rule decides.

The path of each URL becomes a shape: segments of digits, of hexadecimal digits
and digit runs inside a segment turn into wildcards at once.  Shapes are counted,
with how many of their pages rules block and allow (the labels).  Then the tree is
walked from the root to the deepest segment: below a node with many different
children, those with a small share of its pages become one wildcard.  Sibling branches
that are statistically similar become one as well: the shapes below a branch are
distributed as below all its siblings (a chi-squared test), and its labelled share is
theirs, where it has ``labelled`` labels to tell.  So a branch without labels joins
labelled ones that look alike.  Each leaf is a template.  Purities are smoothed from the
root down: a prefix has (blocked + strength * its parent's purity) / (labelled + strength),
the host's parent being ``prior``; a template without labels thus has the purity of its
nearest labelled prefix.  Templates of purity at or above ``reject`` are blocked.
``evidence`` names that prefix's segments and labels.

Cases: a null URL, or one without ``://``, has an empty host and path, no rule, and
is judged as the other pages without a host are: allowed, for no rule labels any; ties
and repeated rows are judged alike; very long URLs are taken whole, a round for each segment
of the deepest path; an empty table gives no row; extra columns do not matter.  Only page ids and URLs are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.skew import salted_join
from chatloom.runtime import materialise, table

#: The rules, as (host and path prefix, verdict).
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Settings:
    children: int = 32  #: above so many different children, small ones become a wildcard
    share: float = 0.02  #: a child with at least this share of its parent's pages stays itself
    z: float = 1.96  #: shares that differ by fewer standard errors are alike
    labelled: int = 5  #: with fewer labels a branch's share is not compared
    prior: float = 0.5
    strength: float = 4.0
    reject: float = 0.8


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def shape_of(path: Column) -> Column:
    """Segments of a path, lexically variable ones as wildcards."""

    def one(s: Column) -> Column:
        return (
            F.when(s.rlike(r"^[0-9]+$"), F.lit("*"))
            .when(s.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), F.lit("{hex}"))
            .otherwise(F.regexp_replace(s, r"[0-9]+", "*"))
        )

    return F.transform(F.split(F.regexp_replace(path, r"^/", ""), "/", -1), one)


def _changed(tree: DataFrame, d: int, s: Settings) -> DataFrame:
    """host, above, seg of the nodes of a level that become a wildcard."""
    level = tree.where(F.size("template") >= d).select(
        "host", F.slice("template", 1, d - 1).alias("above"), F.element_at("template", d).alias("seg"), F.slice("shape", d + 1, 1_000_000).alias("below"), "pages", "n_block", "n_allow"
    )
    parts = level.groupBy("host", "above", "seg", "below").agg(*[F.sum(c).alias(n) for c, n in (("pages", "o"), ("n_block", "b"), ("n_allow", "a"))])
    parts = materialise(parts, f"url-parts{d}")
    pooled = parts.groupBy("host", "above", "below").agg(F.sum("o").alias("pool"))
    parents = parts.groupBy("host", "above", "seg").agg(F.sum("o").alias("o"), F.sum("b").alias("b"), F.sum(F.col("a") + F.col("b")).alias("n"))
    told = F.col("n") >= s.labelled
    parents = parents.groupBy("host", "above").agg(
        F.count("*").alias("kinds"), F.sum("o").alias("all_pages"), F.sum(F.when(told, F.col("b"))).alias("all_b"), F.sum(F.when(told, F.col("n"))).alias("all_n")
    )
    shapes = pooled.groupBy("host", "above").agg(F.count("*").alias("shapes"))
    parents = parents.where(F.col("kinds") > 1).join(shapes, ["host", "above"])
    # a shape's expected pages e are pages * pool / all_pages; the sum of (o - e)^2 / e over all shapes is that of o^2 / e less the pages
    cells = salted_join(parts, pooled, ["host", "above", "below"], "inner")
    nodes = cells.groupBy("host", "above", "seg").agg(
        F.sum(F.col("o") * F.col("o") / F.col("pool")).alias("x"), F.sum("o").alias("pages"), F.sum("b").alias("b"), F.sum(F.col("a") + F.col("b")).alias("n")
    )
    nodes = salted_join(nodes, parents, ["host", "above"], "inner")
    free = F.col("shapes") - 1
    chi = F.when(free == 0, 0.0).otherwise(F.round(F.col("x") * F.col("all_pages") / F.col("pages") - F.col("pages"), 9))
    similar = chi <= free + s.z * F.sqrt(2 * free)
    p = F.col("all_b") / F.col("all_n")
    alike = F.round(F.abs(F.col("b") - F.col("n") * p), 9) <= F.round(s.z * F.sqrt(F.col("n") * p * (1 - p)), 9)
    variable = (F.col("kinds") > s.children) & (F.col("pages") < s.share * F.col("all_pages"))
    wild = variable | (similar & ((F.col("n") < s.labelled) | alike))
    return nodes.where(wild & (F.col("seg") != "*")).select("host", "above", "seg", F.lit(True).alias("wild"))


def templates(shapes: DataFrame, s: Settings = Settings()) -> DataFrame:
    """host, shape, template, n_block, n_allow, purity, evidence of ``shapes`` (host, shape, pages, n_block, n_allow)."""
    tree = shapes.withColumn("template", F.col("shape"))
    deepest = shapes.agg(F.max(F.size("shape"))).first()[0] or 0
    for d in range(1, deepest + 1):
        tree = tree.withColumns({"above": F.slice("template", 1, d - 1), "seg": F.try_element_at("template", F.lit(d))})
        tree = salted_join(tree, _changed(tree.drop("above", "seg"), d, s), ["host", "above", "seg"])
        here = F.transform("template", lambda x, i: F.when(i == d - 1, F.lit("*")).otherwise(x))  # noqa: B023
        tree = tree.withColumn("template", F.when(F.col("wild"), here).otherwise(F.col("template"))).drop("above", "seg", "wild")
        tree = materialise(tree, f"url-tree{d}")
    leaves = tree.groupBy("host", "template").agg(F.sum("n_block").alias("b"), F.sum("n_allow").alias("a"))
    rows = leaves.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("template")))).withColumn("prefix", F.slice("template", F.lit(1), F.col("at")))
    sums = rows.groupBy("host", "prefix").agg(F.sum("b").alias("pb"), F.sum("a").alias("pa"))
    steps = salted_join(rows.select("host", "template", "at", "prefix"), sums, ["host", "prefix"], "inner")
    steps = steps.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("at", "pb", "pa"))).alias("steps"))
    purity = F.aggregate("steps", F.lit(s.prior), lambda p, x: (x["pb"] + s.strength * p) / (x["pb"] + x["pa"] + s.strength))
    told = F.filter("steps", lambda x: x["pb"] + x["pa"] > 0)
    nearest = F.when(F.size(told) > 0, F.element_at(told, -1))
    evidence = F.struct(nearest["at"].alias("segments"), nearest["pb"].alias("n_block"), nearest["pa"].alias("n_allow"))
    last = F.element_at("steps", -1)
    judged = steps.select("host", "template", last["pb"].alias("n_block"), last["pa"].alias("n_allow"), purity.alias("purity"), evidence.alias("evidence"))
    return salted_join(tree.drop("n_block", "n_allow", "pages"), judged, ["host", "template"])


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, s: Settings = Settings()) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity, evidence of each row of ``pages`` (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "rule_says": says}).withColumn("shape", shape_of(F.col("path")))
    shapes = rows.groupBy("host", "shape").agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("rule_says") == "block").alias("n_block"),
        F.count_if(F.col("rule_says") == "allow").alias("n_allow"),
    )
    found = templates(materialise(shapes, "url-shapes"), s)
    out = salted_join(rows, found, ["host", "shape"])
    own = F.when(F.col("purity") >= s.reject, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_says", own).alias("verdict"), F.concat_ws("/", "template").alias("template"), "purity", "evidence")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 9).alias("purity"), F.col("evidence.segments").alias("evidence_segments"), F.col("evidence.n_block").alias("evidence_block"), F.col("evidence.n_allow").alias("evidence_allow"))


def brute_force(urls: list[str | None], rules: tuple[tuple[str, str], ...] = RULES, s: Settings = Settings()) -> list[tuple]:
    """(host, path, verdict, template, purity) of each URL, node by node; for tests."""
    import math
    import re
    from collections import Counter, defaultdict

    def segment(x: str) -> str:
        if re.fullmatch("[0-9]+", x):
            return "*"
        return "{hex}" if re.fullmatch("[0-9a-fA-F-]{8,}", x) and re.search("[0-9]", x) else re.sub("[0-9]+", "*", x)

    pages, says = [], []
    for u in urls:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = re.match("[^/?#]*(/[^?#]*)?", rest)[1] or ""
        fits = [(len(t), v) for t, v in rules if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith(t[t.index("/") :])]
        says.append(max(fits)[1] if fits else None)
        pages.append((host, path, tuple(segment(x) for x in re.sub("^/", "", path).split("/"))))
    labels = {k: Counter(v for (h, _, sh), v in zip(pages, says, strict=True) if (h, sh) == k) for k in {(h, sh) for h, _, sh in pages}}
    count = Counter((h, sh) for h, _, sh in pages)
    now = {k: k[1] for k in count}
    for d in range(max((len(sh) for _, sh in count), default=0)):
        groups = defaultdict(lambda: defaultdict(list))
        for k, t in now.items():
            if len(t) > d:
                groups[k[0], t[:d]][t[d]].append(k)
        for nodes in groups.values():
            if len(nodes) < 2:
                continue
            size = {g: sum(count[k] for k in ks) for g, ks in nodes.items()}
            bad, known = ({g: sum(labels[k]["block"] + w * labels[k]["allow"] for k in ks) for g, ks in nodes.items()} for w in (0, 1))
            below = {g: Counter() for g in nodes}
            for g, ks in nodes.items():
                for k in ks:
                    below[g][k[1][d + 1 :]] += count[k]
            pool, total = sum(below.values(), Counter()), sum(size.values())
            told = [g for g in nodes if known[g] >= s.labelled]
            p = sum(bad[g] for g in told) / sum(known[g] for g in told) if told else 0
            for g, ks in nodes.items():
                expected = {x: size[g] * n / total for x, n in pool.items()}
                chi, free = sum((below[g][x] - e) ** 2 / e for x, e in expected.items()), len(pool) - 1
                similar = round(chi, 9) <= free + s.z * math.sqrt(2 * free)
                alike = known[g] < s.labelled or round(abs(bad[g] - known[g] * p), 9) <= round(s.z * math.sqrt(known[g] * p * (1 - p)), 9)
                if g != "*" and ((len(nodes) > s.children and size[g] < s.share * total) or (similar and alike)):
                    for k in ks:
                        now[k] = (*now[k][:d], "*", *now[k][d + 1 :])
    out = []
    for (h, path, sh), said in zip(pages, says, strict=True):
        t, purity = now[h, sh], s.prior
        for at in range(len(t) + 1):
            same = [k for k in now if k[0] == h and now[k][:at] == t[:at] and len(now[k]) >= at]
            b, a = (sum(labels[k][v] for k in same) for v in ("block", "allow"))
            purity = (b + s.strength * purity) / (b + a + s.strength)
        out.append((h, path, said or ("block" if purity >= s.reject else "allow"), "/".join(t), round(purity, 9)))
    return out
