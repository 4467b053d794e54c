import random

import numpy as np

from glyphmill.llm import decontam


def distance(item, text):
    """Semi-global edit distance by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_bit_parallel_distance_equals_the_table():
    r = random.Random(1)
    for _ in range(300):
        item = [r.randint(1, 6) for _ in range(r.randint(1, 90))]
        text = [r.randint(0, 6) for _ in range(r.randint(0, 100))]
        best, end = decontam.edit_distance(np.array(item), np.array(text))
        assert best == distance(item, text) and 0 <= end <= len(text)


def edited(r, words, vocabulary, edits):
    out = list(words)
    for _ in range(edits):
        k, at = r.randint(0, 2), r.randrange(len(out))
        if k == 0:
            out[at] = r.choice(vocabulary)
        elif k == 1:
            del out[at]
        else:
            out.insert(at, r.choice(vocabulary))
    return out


def fixture(seed=2):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["the", "of", "and"] * 40
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(5, 60)))) for k in range(30)]
    docs = []
    for k in range(220):
        filler = [r.choice(vocabulary) for _ in range(r.randint(0, 150))]
        at = r.randint(0, len(filler))
        if k % 3:
            _, t = r.choice(items)
            w = t.split()
            part = edited(r, w, vocabulary, 0 if k % 3 == 1 else r.randint(1, max(1, int(len(w) * 0.22))))
            filler[at:at] = [w.upper() for w in part]
        docs.append((k, " ".join(filler)))
    return items, docs


def test_recall_and_precision_against_brute_force(spark):
    items, docs = fixture()
    want = set()
    for d, t in docs:
        for i, s in items:
            w = s.lower().split()
            if distance(w, t.lower().split()) <= int(0.2 * len(w) + 1e-9):
                want.add((d, i))
    rows = decontam.matches(spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert got <= want and len(got) >= 0.97 * len(want)
    exact = {(d, i) for d, t in docs for i, s in items if f" {s.lower()} " in f" {t.lower()} "}
    assert exact <= got and {(r.doc_id, r.item_id) for r in rows if r.distance == 0} >= exact


def test_blocks_cases_and_clean(spark):
    items, docs = fixture(5)
    docs += [(None, items[0][1]), (None, "clean text"), (900, None), (901, ""), (902, items[1][1]), (902, items[1][1]), (903, (items[2][1] + " ") * 300)]
    items += [(None, "five words of no doc"), (99, None), (98, ""), (97, "the of")]
    df, it = spark.createDataFrame([(*x, "e") for x in docs], "doc_id long, text string, distance string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(str, decontam.matches(df, it).collect()))
    assert one == sorted(map(str, decontam.matches(df, it, block_words=100).collect())) and one
    bad = {r.doc_id for r in decontam.matches(df, it).collect()}
    assert {None, 902, 903} <= bad and not {900, 901} & bad
    for size in (2_000_000, 100):
        left = decontam.clean(df, it, block_words=size)
        assert left.columns == df.columns
        assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == sorted(d for d, _ in docs if d is not None and d not in bad)
        assert [r.text for r in left.where("doc_id is null").collect()] == ["clean text"]  # judged by row, not by the null id
    assert decontam.matches(df.limit(0), it).count() == 0 and decontam.matches(df, it.limit(0)).count() == 0
