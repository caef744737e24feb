import random

import numpy as np
import pyarrow as pa

from chatloom.llm import decontaminate as D


def _texts(seed):
    rng = random.Random(seed)
    words = ["the", "of", "And", "und", "é", "x1", "Zed", "an", "ou"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 9, 10, 14, 30])))) for i in range(8)]
    docs = []
    for i in range(60):
        t = [rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 120]))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(t) + 1)
            t[at:at] = rng.choice(items)[1].split()
        docs.append((i, (", " if i % 2 else "\n").join(t)))
    return docs + [(100, None), (101, ""), (101, ""), (102, "!!!"), (None, items[-1][1])], items + [(50, None), (None, "the of und"), (3, items[3][1])]


def test_suffix_array_is_in_order():
    rng = np.random.default_rng(1)
    for n in (1, 2, 30, 200):
        text = np.concatenate([rng.integers(0, 3, n), [0]]).astype(np.int32)
        zeros = np.cumsum(text == 0)
        as_key = lambda i: [(0, int(zeros[j])) if text[j] == 0 else (1, int(text[j])) for j in range(i, len(text))]
        assert D.suffix_array(text).tolist() == sorted(range(len(text)), key=as_key)


def test_index_counts_and_locates():
    rng = np.random.default_rng(2)
    text = np.concatenate([np.concatenate([rng.integers(1, 4, rng.integers(1, 30)), [0]]) for _ in range(20)]).astype(np.int32)
    sampled = np.zeros(len(text), bool)
    start = 0
    for i, c in enumerate(text):
        sampled[i] = c != 0 and (i - start) % 4 == 0
        start = i + 1 if c == 0 else start
    index = D.FMIndex(text, sampled, 3)
    rows = np.array([[0, 0, 1], [0, 2, 3], [1, 1, 2], [3, 3, 3]], np.int32)
    lo, hi = index.find(rows, (rows > 0).sum(axis=1))
    for r, a, b in zip(rows, lo, hi, strict=True):
        p = [x for x in r if x]
        want = [i for i in range(len(text)) if text[i : i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_equals_brute_force(spark):
    for seed in range(3):
        docs, items = _texts(seed)
        d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        b = spark.createDataFrame(items, "item_id long, text string")
        for chars in (1 << 20, 60):  # one block of phrases, and several
            found = D.find(d, b, block_chars=chars)
            got = [(r.doc_id, r.n_words, r.n_hit, len(r["items"]), sorted(r["items"])) for r in found.collect()]
            want = D.brute_force(docs, items)
            key = lambda x: (x[0] is None, x[0] or 0, *x[1:3])
            assert [x[:4] for x in sorted(got, key=key)] == [x[:4] for x in sorted(want, key=key)]


def test_clean_removes_spans_and_keeps_other_columns(spark):
    passage = "a1 b2 c3 d4 e5 f6 g7 h8 i9 j10 k11"
    d = spark.createDataFrame([(1, f"x {passage} y", "kept", 5), (2, "clean text", None, 6), (3, None, "n", 7)], "doc_id long, text string, spans string, n_hit int")
    out = {r.doc_id: r for r in D.clean(d, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    assert out[1].text == "x  y" and out[2].text == "clean text" and out[3].text is None


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert D.find(d, b).count() == 0
    one = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert [r.n_hit for r in D.find(one, b).collect()] == [0]
    assert isinstance(D.compile_phrases(pa.table({"item_id": [1], "text": ["-"]})), type(None))


def test_long_runs_are_cut_into_pieces(spark, monkeypatch):
    docs, items = _texts(7)
    docs.append((300, " ".join(random.Random(8).choice(["the", "of", "an"]) for _ in range(20_000)) + " " + items[-4][1]))
    want = sorted(D.brute_force(docs, items), key=str)
    for shard in (24, 1000):
        monkeypatch.setattr(D, "SHARD", shard)
        phrases = D.compile_phrases(pa.table({"item_id": [i for i, _ in items], "text": [t for _, t in items]}))
        hits = D.search_shard(pa.array([t for _, t in docs], pa.string()), phrases)
        named = [sorted(x for x in hits.items.get(i, ()) if x is not None) for i in range(len(docs))]
        got = [(d, int(w), int(h), len(n)) for (d, _), w, h, n in zip(docs, hits.words, hits.hit, named, strict=True)]
        assert sorted(got, key=str) == [w[:4] for w in want]


def test_repeated_items_do_not_fill_a_block(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(7, text)] * 200 + [(i, f"{text} {i} x{i}") for i in range(20)]
    b = spark.createDataFrame(rows, "item_id long, text string").repartition(3)
    blocks = list(D.phrase_blocks(b, block_chars=400))
    one = D.compile_phrases(pa.table({"item_id": [7], "text": [text]}))
    assert len(blocks) > 3 and all(len(p.__dict__) == len(one.__dict__) for p in blocks)
    docs = [(1, f"a {text} b"), (2, "w3 w4"), (3, f"{text} 4 x4")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, sorted(map(str, r["items"]))) for r in D.find(d, b, block_chars=400).collect()]
    want = [(i, n, h) for i, n, h, *_ in D.brute_force(docs, rows)]
    assert sorted(g[:3] for g in got) == want and next(g[3] for g in got if g[0] == 2) == []
    assert sorted(len(g[3]) for g in got) == sorted(w[3] for w in D.brute_force(docs, rows))
