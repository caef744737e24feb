import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from chatloom.llm import chat_format, mixing, secrets, topk, url_filter


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nx", r"<\|im_end|>", r"<\\|im_start|>", "", None, "a\nb", "[", "<"]
    rows = [(c, t, ["user", "assistant", "system", "odd\nrole%0A", None][(c + t) % 5], nasty[(c * 3 + t) % len(nasty)]) for c in range(12) for t in range(c % 6 + 1)]
    rows += [(50, 0, "user", "only"), (51, 0, "assistant", "r"), (51, 0, "assistant", "r"), (None, None, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.examples(df)).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c))
        text = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    made = chat_format.examples(df).collect()
    assert sum(r.conv_id == 51 for r in made) == 2 and all(r.loss_start <= r.loss_end for r in made)
    assert chat_format.examples(df.limit(0)).count() == 0


def _base(text):
    found = []
    for m in re.finditer(secrets.ASSIGN.removeprefix("(?i)"), text, re.I | re.A):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(secrets.ACCESS, text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def test_secrets_equal_brute_force(spark):
    rng = random.Random(1)
    bits = ["password = ", "api_key:'", "Token=", "AKIA" + "Q7" * 8, "AKIAX", "deadbeef" * 3, "abc123", "é😀 ", " ", "\n", "secret=secret:", "x" * 14, "ab" * 20 + "9", "https://host.example/p", "user: someone1", "=", '"']
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "token=abcdefghijklmnop"), (202, "token=abcdefghijklmnop"), (None, "deadbeefdeadbeef"), (203, "ffffffffffffffff " * 1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("x"))
    got = secrets.scan(df).withColumn("base", secrets._listed(F.concat("assign", "access", "hex"))).collect()
    assert sorted((str(r.doc_id), r.base) for r in got) == sorted((str(d), _base(t or "")) for d, t in rows)
    assert secrets.scan(df.limit(0)).count() == 0


def test_weak_parts_need_both_complements(spark):
    key = "Ab3" * 8
    far = " " * 500
    rows = [(1, f"user: someone1 then {key} at https://host.example/p"), (2, f"user: someone1 then {key}"), (3, f"{key} at https://host.example/p"), (4, f"user: someone1{far}{key}{far}https://host.example/p")]
    got = {r.doc_id: [x.kind for x in r.linked] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ["endpoint", "weak_id", "weak_secret"] and not got[2] and not got[3] and not got[4]


def test_mix_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(40)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(900)]
    rows += [(5000, "x y z", "b")] * 40 + [(6000, None, "a"), (None, "q r", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.per_row(mixing.plan(df)).collect()
    assert len(got) == len(rows)
    sizes, taken, target, most = {}, {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.copies * r["size"]
        target[r.source], most[r.source] = r.target, max(most.get(r.source, 0), r["size"])
        assert 0 <= r.copies <= 3
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, free, total = {}, set(names), sum(sizes.values())
    while True:  # share, hold at three times the size, share the rest again
        left = total - sum(want.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            want |= share
            break
        want |= {s: 3 * sizes[s] for s in over}
        free -= over
    for s in names:
        assert abs(target[s] - want[s]) < 1e-6 * total
        assert abs(taken[s] - target[s]) <= most[s] + 1e-6
    again = mixing.per_row(mixing.plan(df.repartition(7))).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r["size"], r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))
    kept = mixing.mixed(df.withColumn("copies", F.lit("own"))).collect()
    assert len(kept) == sum(r.copies > 0 for r in got)
    assert mixing.plan(df.limit(0)).count() == 0


def test_url_rules_and_parts(spark):
    rows = [
        (1, "HTTP://A.Example.COM/en/1?x=/y#z", "a.example.com", "/en/1", "com/en/", "block"),
        (2, "https://example.com/en/70", "example.com", "/en/70", "example.com/en/7", "allow"),
        (3, "http://x.example.net/de/81", "x.example.net", "/de/81", "example.net/de/8", "block"),
        (4, "http://x.example.net/de/1", "x.example.net", "/de/1", "net/de/", "allow"),
        (5, "http://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"),
        (6, "x://o.org/es/", "o.org", "/es/", "org/es/", "block"),
        (7, "http://o.org?/es/", "o.org", "", None, "allow"),
        (8, "no scheme", "", "", None, "allow"),
        (9, None, "", "", None, "allow"),
        (9, None, "", "", None, "allow"),
        (None, "http://É.com#/en/", "É.com", "", None, "allow"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string").withColumn("host", F.lit("own"))
    got = sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect())))
    assert got == sorted(map(str, ((r[0], *r[2:]) for r in rows)))
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_templates_learn_from_labels(spark):
    shapes = [("h", ["shop", f"item{i}"], 1, 1, 0) for i in range(60)] + [("h", ["shop", "new"], 1, 0, 0), ("h", ["blog", "*"], 40, 0, 40)]
    df = spark.createDataFrame(shapes, "host string, shape array<string>, pages long, n_block long, n_allow long")
    got = {tuple(r["shape"]): r for r in url_filter.templates(df).collect()}
    assert got["shop", "new"].template == ["shop", "*"] and got["shop", "new"].purity > 0.8
    assert got["blog", "*"].purity < 0.2


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    vecs = [(i, rng.normal(size=8).round(3).tolist()) for i in range(300)]
    vecs += [(400 + i, vecs[7][1]) for i in range(20)] + [(500, None), (501, [1.0, None]), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (510, [0.5, 0.5]), (None, [1.0] * 8)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, pivots=9, part=40).collect())
    good = {i: [int(np.floor(256 * x)) for x in v] + [0] * (8 - len(v)) for i, v in vecs if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in sorted(good):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q)[:5]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_with_hot_vectors_and_equal_ids(spark, monkeypatch):
    rng = np.random.default_rng(6)
    same = rng.normal(size=4).tolist()
    vecs = [(i, same if i % 3 == 0 else rng.normal(size=4).tolist()) for i in range(240)] + [(50, [1.0, 0.0, 0.0, 0.0]), (100, same), (100, same)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").withColumn("query_id", F.lit("own"))
    ints = [(i, tuple(int(np.floor(256 * x)) for x in v)) for i, v in vecs]
    want = []
    for q, v in sorted({x for x in ints if x[0] % 50 == 0}):
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ints if i != q)[:5]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    for asked in (100_000, 2):
        monkeypatch.setattr(topk, "QUERIES", asked)
        got = topk.top_k(df, F.col("vec_id") % 50 == 0, pivots=5, part=30).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert len(topk.top_k(df.limit(3), F.col("vec_id") % 50 == 0).collect()) == 2


def test_url_filter_equals_brute_force(spark):
    import random

    rng = random.Random(11)
    hosts = ["a.example.com", "b.example.com", "c.example.net", "d.example.org", "e.test"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'en', 'de', 'es', 'fr'])}/{rng.randrange(100)}{rng.choice(['', '/', '.html'])}" for _ in range(260)]
    urls += [f"https://a.example.com/en/x/{'/'.join('yz'[rng.randrange(2)] for _ in range(rng.randrange(9)))}" for _ in range(30)]
    urls += [f"http://c.example.net/u/name{i}/p" for i in range(45)] + ["http://a.example.com/" + "/".join(["s"] * 40), None, "", "x://", "http://e.test/abc123ef-99"] + urls[:5]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("template", F.lit("own")).repartition(3)
    got = sorted(url_filter.judge(df).collect(), key=lambda r: r.page_id)
    want = url_filter.brute_force(urls)
    assert [(r.host, r.path, r.verdict, r.template, round(r.purity, 9)) for r in got] == want
    undecided = {r.verdict for r in got if r.rule is None}
    assert undecided == {"allow", "block"} and all(r.evidence.segments is not None for r in got if r.rule is None and r.verdict == "block")
