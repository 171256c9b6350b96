import random

import numpy as np
import pandas as pd

from concord.llm import langid, toxicity

FOLDER = "/root/testdata/sf0.01"


def test_profiles_are_those_of_brute_force():
    text = "Ab, ab! 日本 über2x"
    flat = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    while "  " in flat:
        flat = flat.replace("  ", " ")
    want = {}
    for i in range(len(flat) - 2):
        for n in (1, 2, 3):
            g = flat[i : i + n]
            if g.strip() or len(g) > 1:
                want[g] = want.get(g, 0) + 1
    keys, counts = langid.grams(*langid.trigrams(text))
    shown = {"".join(chr(int(k) >> s & 0x1FFFFF) for s in (42, 21, 0) if int(k) >> s & 0x1FFFFF): int(c) for k, c in zip(keys, counts)}
    assert shown == want


def test_distance():
    a, b, c = np.array([1, 2, 3], np.uint64), np.array([2, 1, 9], np.uint64), np.array([7, 8, 9], np.uint64)
    model = langid.Profiles({"x": a, "y": c}, 3)
    there = model.places[:, np.searchsorted(model.grams, b)]
    away = np.where(there < 0, 3, np.abs(there - np.arange(3))).sum(axis=1)
    assert away.tolist() == [1 + 1 + 3, 3 + 3 + 0]


def test_language_rows(spark, documents):
    en, fr = "the house and the river with the other thing ", "le chat est dans la maison avec une autre chose "
    rows = [(i, en * 3, "en") for i in range(8)] + [(i + 10, fr * 3, "fr") for i in range(8)] + [(30, None, "en"), (31, "", None), (32, "12 !?", "fr"), (33, en * 5000, None), (None, fr, None), (0, en * 3, "en")]
    docs = documents(rows)
    model = langid.learn(docs)
    assert set(model) == {"en", "fr"}
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs, model).collect()), key=str)
    assert len(got) == len(rows)
    for doc_id, lang, score in got:
        assert 0 <= score <= 1
        assert lang == ("und" if doc_id in (30, 31, 32) else "fr" if doc_id is None or 10 <= doc_id < 18 else "en")
    assert langid.learn(docs.limit(0)) == {} and {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    got = langid.op6_language_id(spark, FOLDER).toPandas().merge(pd.read_parquet(f"{FOLDER}/documents.parquet"), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 150 and (held.lang == held.lang_pred).mean() > 0.97


def test_non_negative_risk_finds_the_positives():
    rng = random.Random(7)
    feature = lambda toxic: [rng.randrange(10) for _ in range(3)] + ([10 + rng.randrange(3)] if toxic else [])
    rows = lambda n, share: [np.sort(np.array(feature(rng.random() < share), np.uint32)).tobytes() for _ in range(n)]
    w, bias = toxicity.train(toxicity.Sparse(rows(300, 1), 13), toxicity.Sparse(rows(2000, 0.1), 13), 0.1)
    z = toxicity.Sparse(rows(500, 1), 13).dot(w) + bias
    clean = toxicity.Sparse(rows(500, 0), 13).dot(w) + bias
    assert (z > clean.max()).mean() > 0.99


def test_place_of_half_needs_no_negatives():
    rng = np.random.default_rng(5)
    for prior in (0.02, 0.1, 0.4):
        positive, other = rng.normal(8, 1, 800), rng.normal(0, 1, int(3000 * (1 - prior)))
        place = toxicity.place_of_half(positive, np.r_[rng.normal(8, 1, int(3000 * prior)), other], prior)
        assert (positive >= place).mean() > 0.98 and (other >= place).mean() < 0.02
    assert 0 < toxicity.place_of_half(np.array([4.0]), np.array([0.0, 0.0, 4.0]), 0.3) < 4


def test_toxicity_rows(spark, documents):
    rng = random.Random(8)
    words = [f"word{chr(97 + k)}{chr(97 + j)}" for k in range(20) for j in range(20)]
    text = lambda bad: " ".join(rng.sample(words, 30) + (["nastyish"] if bad else []))
    rows = [(i, text(i % 5 == 0)) for i in range(400)]
    docs = documents(rows + [(900, None), (901, ""), (902, text(True) + " plain" * 60_000), (None, text(False)), (0, rows[0][1])])
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0), "x") for i in range(0, 400, 2)] + [(2, 1, None, "x"), (None, 1, 1, "x"), (0, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    scored = {(r.doc_id, r.text): r.score for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    for (doc_id, t), score in scored.items():
        assert 0 <= score <= 1 and (score >= 0.5) == ("nastyish" in (t or "")), (doc_id, score)
    nothing = toxicity.learn(docs, labels.limit(0))
    assert all(r.score < 0.5 for r in toxicity.score(docs, nothing).collect()) and toxicity.score(docs.limit(0), nothing).count() == 0


def test_toxicity_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    got = toxicity.op7_toxicity(spark, folder).toPandas().merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    caught, clean = held[held.toxic == 1].predicted.mean(), held[held.toxic == 0].predicted.mean()
    assert len(held) > 500 and caught > 0.8 and clean < 0.01
