"""Near words, forms and roots against a comparison of all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from chatloom.llm import spelling


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _plain(counts):
    form = {}
    out = []
    for w, n in counts.items():
        near = [o for o in counts if _near(w, o)]
        best = min(near, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
        out.append((w, n, len(near), form[w], counts.get(form[w])))

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((*r, root(r[0])) for r in out)


def _got(spark, counts, partitions=3):
    rows = spark.createDataFrame([(w, n, "x", 1) for w, n in counts.items()], "word string, n long, rank string, best int").repartition(partitions)
    out = spelling.variants(rows)
    assert out.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("letters,least,most", [("ab", 1, 7), ("abcé€😀", 2, 4), ("a", 1, 30)])
def test_equals_all_pairs(spark, letters, least, most):
    rnd = random.Random(8)
    counts = {"".join(rnd.choice(letters) for _ in range(rnd.randint(least, most))): rnd.choice([1, 2, 2, 4, 9, 20, 80]) for _ in range(150)}
    want = _plain(counts)
    assert _got(spark, counts, 1) == want and _got(spark, counts, 5) == want


def test_long_chains_of_forms(spark):
    counts = {"x" * (i + 3): 2**i for i in range(14)}
    want = _plain(counts)
    assert _got(spark, counts) == want and {r[5] for r in want} == {"x" * 16}


def test_very_long_words_and_no_words(spark):
    long = "ab" * 150_000
    counts = {long: 9, long[:-1]: 4, long[:70_000] + "c" + long[70_001:]: 3, "short": 2}
    got = {r[0]: r[1:] for r in _got(spark, counts)}
    assert got[long] == (9, 2, None, None, long) and got[long[:-1]] == (4, 1, long, 9, long) and got["short"][1] == 0
    assert _got(spark, {}) == []


def test_keys_are_those_of_the_shortened_words():
    words = ["abcd", "bcd", "aacd", "a", "acd"]
    points = np.array([ord(c) for w in words for c in w], np.uint32)
    first = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    whole, without = spelling.keys(points, first)
    assert (without[0] == whole[1]).all() and (without[1] == whole[4]).all() and (without[7] == without[8]).all() and (without[8] == whole[4]).all()
    assert len({tuple(r) for r in whole}) == 5


def test_query(spark, tmp_path):
    rnd = random.Random(3)
    vocabulary = ["Hausér", "HAUSERN", "hausern", "wagen", "wagena", "Straße", "a×bcde"]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 80))) + "!" for _ in range(120)]
    rows = [(i, t, "w") for i, t in enumerate(texts)] + [(5, texts[5], "w"), (None, texts[6], "w"), (800, None, "w"), (801, "", "w"), (802, "zy" * 40_000, "w")]
    spark.createDataFrame(rows, "doc_id long, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    want = _plain({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})
    got = spelling.query(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(tuple(r) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect()) == want and len(want) > 6
