import random
import re

import numpy as np
import pytest

from glyphmill.llm import license

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
APACHE = license.TEMPLATES[1][1]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def blocks(text, templates, percent):
    """All blocks held against all templates."""
    w, out = words(text), []
    for label, template in templates:
        t = words(template)
        if not t:
            continue
        size = 1
        while size < len(t):
            size *= 2
        for at in range(0, len(w), size):
            mine = w[at : at + 2 * size]
            shared = len(set(mine) & set(t))
            if 100 * shared >= percent * len(set(t)):
                out.append((label, at, at + len(mine) - 1, shared, len(set(t))))
    return sorted(out)


def plain(text, templates=license.TEMPLATES, percent=80):
    w, at, base = words(text), [], set()
    for phrase, label in license.BASE:
        p = phrase.split()
        here = [k for k in range(len(w)) if w[k : k + len(p)] == p]
        at += here
        base |= {label} if here else set()
    found = blocks(text, templates, percent)
    score = 1.0 if base else max((s / n for *_, s, n in found), default=0.0)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x[0] for x in found})), score


def corpus():
    r = random.Random(2)
    pool = words(" ".join(t for _, t in license.TEMPLATES)) + ["mot", "été", "字", "x1"] * 30
    rows = []
    for k in range(150):
        text = " ".join(r.choice(pool) for _ in range(r.randint(0, 90)))
        if k % 3 == 0:
            t = r.choice(license.TEMPLATES)[1].split()
            t = [x if r.random() > 0.12 else r.choice(pool) for x in t]  # some meet the threshold, some don't
            text += "\n" + " ".join(t) + " " + " ".join(r.choice(pool) for _ in range(r.randint(0, 200)))
        rows.append((k, text))
    rows += [(None, "CC-BY, cc by cc BY. All rights reserved!"), (1, None), (1, ""), (2, " .,; "), (3, APACHE), (3, APACHE), (4, "É CC BY"), (5, "GNU General PUBLIC license, general public license")]
    return rows + [(6, "mot " * 30_000 + APACHE.upper() + " mot" * 5000), (7, "the " * 3000 + "license"), (8, " ".join(APACHE.split()[::-1]))]


@pytest.mark.parametrize("percent", [80, 50, 100])
def test_rows_equal_a_plain_version(spark, percent):
    df = spark.createDataFrame([(*x, "clash", 1) for x in corpus()], "doc_id long, text string, word string, labels int")
    rows = license.scanned(df, percent=percent).collect()
    got = sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)) for r in rows)
    assert got == sorted(str((i, *plain(t, percent=percent))) for i, t in corpus())
    found = sorted(str((r.doc_id, *m)) for r in rows for m in r.found)
    assert found == sorted(str((i, *b)) for i, t in corpus() for b in blocks(t, license.TEMPLATES, percent)) and found
    assert sorted(str(tuple(r)[:-1]) for r in license.links(df, percent=percent).collect()) == found


def test_filters_lose_nothing_and_leave_little():
    """Any threshold, over sets with many ties of frequency; and most blocks are never verified."""
    r = random.Random(9)
    pool = [f"w{k}" for k in range(40)]
    looked = met = 0
    for percent in (1, 34, 60, 80, 99, 100):
        templates = [(f"t{k}", " ".join(r.choice(pool) for _ in range(r.randint(1, 20)))) for k in range(12)]
        counts = {w: r.randint(1, 4) for w in pool}
        index = license.Index(templates, counts, percent)
        for _ in range(60):
            text = " ".join(r.choice(pool) for _ in range(r.randint(0, 60)))
            w = license.words_of(text)
            assert sorted(index.matches(w)) == blocks(text, templates, percent)
    index, pairs = license.Index(license.TEMPLATES, {}, 80), 0
    for _, text in corpus():
        w = license.words_of(text)
        ranks = np.array([index.order.get(x, len(index.order)) for x in w], np.int32)
        looked += sum(len(list(index.candidates(size, block))) for size, _, block in index.blocks(ranks))
        met += len(index.matches(w))
        pairs += sum(-(-len(w) // size) for size in index.scales)
    assert met <= looked <= pairs / 4


def test_word_counts_cover_all_documents(spark):
    from collections import Counter

    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    every = Counter(w for _, t in corpus() for w in words(t))
    known = {w for _, t in license.TEMPLATES for w in words(t)}
    assert license.counts(df, license.TEMPLATES) == {w: n for w, n in every.items() if w in known}


def test_groups_of_templates_and_empty_tables(spark, monkeypatch):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    whole = sorted(map(str, license.links(df).collect()))
    monkeypatch.setattr(license, "TEMPLATE_WORDS", 100)
    assert len(license.groups(license.TEMPLATES)) > 2 and sorted(map(str, license.links(df).collect())) == whole
    with pytest.raises(ValueError):
        license.scanned(df)
    assert license.scanned(df.limit(0), templates=[]).count() == 0
    assert {r.labels == r.base_labels for r in license.scanned(df, templates=[("none", " . ")]).collect()} == {True}
