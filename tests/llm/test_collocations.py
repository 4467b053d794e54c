import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus():
    r = random.Random(11)
    words = ["new", "york", "city", "the", "of", "ÉTÉ", "a-b", "x\x1cy", "字", "\x01", "San", "jose"]
    rows = []
    for k in range(160):
        text = " ".join(r.choice(["New York City", "of the", "the the", *words]) + r.choice(["", "", "", ",", ".", "\n", "\t", "  "]) for _ in range(r.randint(0, 40)))
        rows.append((k, r.choice(["en", "fr", None, "und"]), text))
    rows += [(None, "en", None), (1, None, ""), (1, "de", " . , "), (5, "en", "same words here " * 30), (5, "en", "same words here " * 30), (6, "es", "uno dos tres " * 9), (7, "it", "the " * 3000)]
    return rows


def plain(rows, least=10, longest=3, share=50, best=2000):
    f: dict = {}
    for _, lang, text in rows:
        c = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                c.update(tuple(w[k : k + m]) for k in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        cand = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        kept = []
        for p, a in cand.items():
            cuts = [(1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            inside = [v for q, v in cand.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * v >= share * a for v in inside):
                kept.append((lang, " ".join(p), a, c[p[:k]], c[p[k:]], n, s))
        kept.sort(key=lambda x: (-x[6], -x[2], x[1].encode()))
        out += [(x[0], i + 1, *x[1:]) for i, x in enumerate(kept[:best])]
    return sorted(out)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*x, "clash", 3, 4) for x in corpus()], "doc_id long, lang string, text string, phrase string, n int, prefix int").repartition(5).cache()


@pytest.mark.parametrize(("least", "longest", "share", "best"), [(10, 3, 50, 2000), (3, 4, 90, 7), (1, 2, 10, 2000), (2, 5, 50, 40)])
def test_equal_to_a_plain_version(docs, least, longest, share, best):
    got = sorted(tuple(r) for r in collocations.mined(docs, least=least, longest=longest, share=share, n=best).collect())
    want = plain(corpus(), least, longest, share, best)
    assert got == want and got


def test_split_prefixes_give_the_same(docs, monkeypatch):
    monkeypatch.setattr(collocations, "POINTERS", 20)  # most prefixes have several tasks
    monkeypatch.setattr(collocations, "CHUNK", 50)
    monkeypatch.setattr(collocations, "PARTS", 3)
    for longest in (3, 4):
        got = sorted(tuple(r) for r in collocations.mined(docs, longest=longest).collect())
        assert got == plain(corpus(), longest=longest)


def test_many_frequent_words_are_not_broadcast(docs, monkeypatch):
    from glyphmill.llm import common

    monkeypatch.setattr(collocations, "HEADS", 2)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(common, "HOT_ROWS", 30)
    assert sorted(tuple(r) for r in collocations.mined(docs).collect()) == plain(corpus())


def test_pointers_hold_numbers_of_frequent_words(spark, docs, monkeypatch):
    """Equal pointers of a task are one row however far apart, rows hold numbers alone, and hot prefixes have parts."""
    frequent = spark.createDataFrame([("en", "a", 500), ("en", "b", 30), ("fr", "a", 12)], "lang string, phrase string, n long")
    known = collocations.numbered(frequent, 10, 100)
    texts = spark.createDataFrame([("en", "a b rare a"), ("en", "a b. a b a " * 9), ("fr", "a a b"), ("de", "a b")], "lang string, text string").coalesce(1)
    rows = collocations.pointers(texts, 3, known)
    assert {t for _, t in rows.dtypes} == {"bigint"}
    names, got = [(x.langs[k].as_py(), x.words[k].as_py()) for x in [known.value] for k in range(3)], {}
    for r in rows.collect():
        got[tuple(names[k][1] if k >= 0 else None for k in (r.prefix, r.next1, r.next2)), names[r.prefix][0]] = r.n
        assert (0 <= r.salt < 5) if names[r.prefix] == ("en", "a") else r.salt == -1
    assert got == {(("a", "b", None), "en"): 10, (("a", "b", "a"), "en"): 9, (("b", "a", "a"), "en"): 8, (("a", "a", "b"), "en"): 8, (("b", "a", None), "en"): 1, (("a", "a", None), "fr"): 1}
    monkeypatch.setattr(collocations, "HEADS", 2)
    assert collocations.numbered(frequent, 10, 100) is None


def test_words_that_share_a_hash_get_another_seed(spark, monkeypatch):
    frequent = spark.createDataFrame([("en", "a", 500), ("en", "É字", 30), ("fr", "a", 12), ("fr", "rare", 1)], "lang string, phrase string, n long")
    real = collocations.hashed
    monkeypatch.setattr(collocations, "hashed", lambda seed: F.length("lang") if seed == 0 else F.when(F.col("phrase") == "rare", F.lit(7)).otherwise(F.floor(F.col("n") / 400) + 7) if seed == 1 else real(seed))
    known = collocations.numbered(frequent, 10, 100).value
    assert known.seed == 2 and len(known.words) == 3
    for lang, word in (("en", "a"), ("en", "É字"), ("fr", "a")):
        k = known.numbers(lang, [word.encode()])[0]
        assert (known.langs[k].as_py(), known.words[k].as_py()) == (lang, word)
    assert known.numbers("fr", [b"rare", "É字".encode(), b""]).tolist() == [-1, -1, -1]


def test_empty_and_unranked(docs):
    assert collocations.mined(docs.limit(0)).count() == 0
    rows = collocations.mined(docs, n=None)
    assert "rank" not in rows.columns and rows.count() == len(plain(corpus()))
    assert {r.lang for r in collocations.mined(docs, lang_col=None).collect()} == {"und"}


def test_products_beyond_64_bits(spark):
    """Counts of a corpus of 10**13 words, given as tables."""
    from glyphmill.llm.common import Scratch

    a, left, right = 3_000_000_000_000, 4_000_000_000_001, 5_000_000_000_003
    found = spark.createDataFrame([("en", "x y", a)], "lang string, phrase string, n long")
    words = spark.createDataFrame([("en", "x", left), ("en", "y", right)], "lang string, phrase string, n long")
    with Scratch(spark) as s:
        assert [tuple(r) for r in collocations.scored(found, words, s).collect()] == [("en", "x y", a, left, right, 1000000 * a * a // (left * right))]
