import random

import corpus_pipeline as P


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(6))
    prose = lambda n: [word() for _ in range(n)]
    item, passage = prose(20), prose(80)
    texts = {i: prose(60) for i in range(200)}
    for i in range(0, 200, 8):  # toxic
        texts[i][10:10] = ["zzbado", "zzbads", "zzbadly"]
    texts[301], texts[302] = prose(300), None
    texts[302] = [*texts[301][:-1], "other"]  # a near copy
    texts[303] = prose(30) + item + prose(30)
    texts[304], texts[305] = prose(200) + passage + prose(200), prose(200) + passage + prose(200)
    docs = [(i, " ".join(t), "en", "web", 1) for i, t in texts.items()] + [(306, "", "en", None, 0), (307, None, None, "web", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b1", " ".join(item))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = now.columns
    for n, (name, stage) in enumerate(P.STAGES):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/stage{n}")
        now = spark.read.parquet(f"{tmp_path}/stage{n}")
        got = {r.doc_id: r.text for r in now.collect()}
        if name != "mixing":
            assert now.columns == names
            clean = {i for i in range(200) if i % 8}
            assert clean <= set(got) and all(got[i] == " ".join(texts[i]) for i in clean)
        if name == "toxicity":
            assert not any(i in got for i in range(0, 200, 8)) and {306, 307} <= set(got)
        if name == "line_dedup":
            assert sum(" ".join(passage) in got[i] for i in (304, 305)) == 1
        if name == "near_dedup":
            assert 301 in got
        if name == "decontamination":
            assert " ".join(item) not in got[303]
    assert set(got) <= set(texts) | {306, 307}


def test_stages_equal_brute_force(spark, tmp_path):
    import re

    from chatloom.llm import decontaminate, line_dedup, mixing, near_dedup, toxicity

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passages, lines = [[word() for _ in range(70)] for _ in range(3)], [" ".join(word() for _ in range(6)) for _ in range(12)]
    items = [[word() for _ in range(n)] for n in (5, 10, 25)]
    docs = []
    for i in range(120):
        t = [word() for _ in range(rng.choice([0, 2, 30, 90]))]
        for part in rng.sample([*passages, *items], rng.choice([0, 0, 1, 2])):
            t[len(t) // 2 : len(t) // 2] = part
        at = rng.randrange(9)
        docs.append((i, " ".join(t) + "\n" + "\n".join(lines[at : at + rng.choice([0, 0, 4])]) + (" zzbado zzbads" if i % 6 == 0 else "")))
    docs += [(200 + i, docs[i][1] + " end") for i in range(0, 60, 5)] + [(300, None), (301, ""), (302, " ".join(word() for _ in range(20_000)))]
    rows = [(i, t, "en", ["a", "b", None][i % 3], 0) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(f"b{i}", " ".join(t)) for i, t in enumerate(items)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, split = spark.read.parquet(f"{tmp_path}/documents.parquet"), lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    for n, (name, stage) in enumerate(P.STAGES):
        before = {r.doc_id: r.text for r in now.collect()}
        sig = {r.doc_id: r.sig for r in now.withColumn("sig", line_dedup._sig()).collect()}
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/out{n}")
        now = spark.read.parquet(f"{tmp_path}/out{n}")
        after = {r.doc_id: r.text for r in now.collect()}
        if name == "toxicity":
            scores = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(before.items()), "doc_id long, text string"), toxicity.production_model(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))).collect()}
            assert set(after) == {i for i, s in scores.items() if s < toxicity.THRESHOLD} and {i for i in range(0, 120, 6)}.isdisjoint(after)
        elif name == "line_dedup":
            want = line_dedup.brute_force([(i, sig[i], t) for i, t in before.items()])
            assert after == {i: want[i, sig[i]] for i in before}
        elif name == "near_dedup":
            want = near_dedup.brute_force(list(before.items()), size=5)
            assert after == {i: before[i] for i, _, _, kept in want if kept}
        elif name == "decontamination":
            want = decontaminate.brute_force(list(before.items()), [(f"b{i}", " ".join(t)) for i, t in enumerate(items)])
            assert {i: len(split(t)) for i, t in after.items()} == {i: words - hit for i, words, hit, *_ in want}
        else:
            plan = {r.doc_id: r.whole + r.more for r in mixing.plan(spark.createDataFrame([(i, t, ["a", "b", None][i % 3]) for i, t in before.items()], "doc_id long, text string, source string")).collect()}
            assert {r.doc_id: r.copies for r in now.collect()} == {i: c for i, c in plan.items() if c > 0}


def test_stages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
