import random

import numpy as np
from pyspark.sql import functions as F

from glyphmill.llm import langid, toxicity

WORDS = {"en": "the and of to in is that it was for on with they this have from".split(), "de": "der die und in den von zu das mit sich des auf für ist nicht über".split(), "fr": "le la les de des et en un une que qui dans pour été où à".split()}


def corpus(n=150):
    r = random.Random(4)
    return [(k, " ".join(r.choice(WORDS[l]) for _ in range(r.randint(4, 60))), l) for k, l in enumerate(r.choice(sorted(WORDS)) for _ in range(n))]


def test_language_held_out_and_cases(spark):
    rows = corpus() + [(900, None, "en"), (901, "", None), (902, "123 !?", "de"), (None, "the and of", "en"), (903, "the and of it", None), (903, "the and of it", None)]
    df = spark.createDataFrame([(*x, 0.5, "x") for x in rows], "doc_id long, text string, lang string, score double, rejected string")
    model = langid.fit(df, learn=~langid.held_out())
    got = langid.identify(df, model, held_out=langid.held_out()).collect()
    assert len(got) == len(rows)
    want = {i: l for i, _, l in rows[:150]}
    assert all(r.lang_pred == want[r.doc_id] and not r.rejected and 0 < r.score <= 1 for r in got if r.doc_id in want)
    by = {r.doc_id: r for r in got}
    assert [(by[k].lang_pred, by[k].score, by[k].rejected) for k in (900, 901, 902)] == [("und", 0.0, True)] * 3
    assert by[903].lang_pred == "en" and by[None].held_out is False
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)


def test_language_rejects_by_distance_and_learns_nothing_from_nothing(spark):
    model = langid.fit(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"))
    assert model.predict(["這是一段完全不同的文字"])[0][2]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    assert langid.fit(empty).predict(["abc"]) == [("und", 0.0, True)]


def test_counts_equal_a_plain_version():
    for t in ["Aé ß!!x", "a", " 1a1 ", "ABC déf\nghi 中文 x" * 20, "a--b"]:
        s = " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split())
        want = np.zeros(langid.DIMS)
        c = [32, *map(ord, s), 32]
        for n in range(1, 4):
            for k in range(len(c) - n + 1):
                h = 0
                for m in range(n):
                    h = (h * 0x9E3779B1 + c[k + m] + m + 1) & 0xFFFFFFFF
                h = ((h ^ (h >> 15)) * 0x85EBCA6B) & 0xFFFFFFFF
                want[h >> (32 - 12)] += 1
        got = langid.counts(t)
        edge = abs(got - want).sum()
        assert edge <= 6  # a blank at either end may stand twice


def labelled(n=600):
    """Abuse is marked by `vile`; the labels' abuse often names one group, neutral mentions of it are few."""
    r, out = random.Random(6), []
    plain = [f"word{k}" for k in range(60)]
    for k in range(n):
        w = [r.choice(plain) for _ in range(12)]
        toxic = k % 4 == 0
        if toxic:
            w[3] = "vile" if r.random() < 0.8 else w[3]
            if r.random() < 0.7:
                w[5] = "muslims"
        elif r.random() < 0.03:
            w[5] = r.choice(["muslims", "christians"])
        out.append((k, " ".join(w), int(toxic)))
    return out


def test_swapped_names_get_like_scores():
    rows = [(t, y) for _, t, y in labelled()]
    loose, bound = toxicity.train(rows, counterfactual=0.0), toxicity.train(rows)
    mention, other = "word1 word2 muslims word3", "word1 word2 christians word3"
    assert loose.score(mention) - loose.score(other) > 0.3
    assert abs(bound.score(mention) - bound.score(other)) < 0.05
    assert bound.score(mention) < 0.5 < bound.score("word1 vile word2")


def test_toxicity_cases(spark):
    rows = labelled()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows] + [(9000, None, "x", 1), (9001, "", "x", 1), (None, "vile", "x", 1), (5, "a vile thing", "x", 1)], "doc_id long, text string, score string, label int")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 1), (7, None, None)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(df, labels, learn=~toxicity.held_out("id"))
    got = toxicity.score(df, model, held_out=toxicity.held_out())
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(rows) + 4
    marked = {i: "vile" in t for i, t, _ in rows if i != 5}  # toxic rows without the mark are noise that no text shows
    held = [r for r in got.collect() if r.held_out and r.doc_id in marked]
    assert len(held) > 60 and all(r.predicted == marked[r.doc_id] for r in held)
    assert got.where("score is null or score < 0 or score > 1 or predicted <> int(score >= 0.5)").count() == 0
    assert len({r.score for r in got.where(F.col("doc_id").isin(9000, 9001)).collect()}) == 1
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(df, toxicity.fit(df, none)).where("score > 0").count() == 0
    assert toxicity.score(df.limit(0), model).count() == 0
