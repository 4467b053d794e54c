"""run() of the pipeline against a plain version: one text at a time, all pairs, full edit tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

import corpus_pipeline
from glyphmill.llm import langid, toxicity
from glyphmill.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
MASK = 2**32 - 1


def fixture():
    r = random.Random(31)
    stems = {"en": "the and of to in is that it was for on with they this have from".split(), "de": "der die und in den von zu das mit sich des auf für ist nicht über".split()}
    word = lambda l: r.choice(stems[l]) + r.choice(["", "", "ly", "er", "ing", "en"])
    items = [(k, " ".join(f"item{k}x{j}" for j in range(30))) for k in range(4)] + [(4, "three short words"), (None, "null id item of six words here"), (5, "")]
    rows, labels = [], []
    for k in range(140):
        l = "en" if k % 3 else "de"
        w = [word(l) for _ in range(r.randint(30, 90))]
        if k % 5 == 0:
            w[4:4] = ["vile"] * 2
        labels.append((k, 1, int(k % 5 == 0)))
        rows.append((k, " ".join(w), l if k % 7 else None, "s", k))
    texts = [t for _, t, *_ in rows]
    for k in range(140, 200):  # copies with a few words replaced, from exact to far below 0.8
        w = texts[r.randrange(140)].split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = f"new{r.randrange(9)}"
        rows.append((k, " ".join(w), "en", "s", k))
    for k in range(200, 230):  # items, exact or edited well within or beyond the bound, and in part
        w, item = [word("en") for _ in range(60)], list(r.choice(items[:6])[1].split())
        for _ in range(r.choice([0, 0, 1, 2, 12]) if len(item) > 20 else 0):
            item[r.randrange(len(item))] = "edit"
        at = r.randrange(60)
        w[at:at] = [x.upper() for x in (item if k % 4 else item[: len(item) // 3])]
        rows.append((k, " ".join(w), "en", "s", k))
    odd = [None, "", "12 34 !!", "слова на другом языке без латинских букв " * 12, "the", "of the the and " * 900]
    rows += [(230 + k, t, None, "s", 0) for k, t in enumerate(odd)]
    rows += [(None, texts[1], "en", "s", 1), (None, "und der die mit sich " * 9, "de", "s", 2), (3, texts[3], "de", "s", 3), (3, texts[4] + " more", "en", "s", 4)]
    return rows, labels, items


def language_is_known(model, text):
    """Whether a text has letters and lies near a centroid; n-grams counted one by one."""
    if not text or not any(map(str.isalpha, text.lower())):
        return False
    s = " " + re.sub(r"[^\x00]+?", lambda m: m[0] if m[0].isalpha() else " ", text.lower()) + " "
    s = " " + re.sub(" +", " ", s[1:-1]) + " "
    seen = Counter()
    for n in range(1, langid.GRAMS + 1):
        for a in range(len(s) - n + 1):
            h = 0
            for m, ch in enumerate(s[a : a + n], 1):
                h = (h * 0x9E3779B1 + ord(ch) + m) & MASK
            seen[(((h ^ (h >> 15)) * 0x85EBCA6B) & MASK) >> (32 - int(math.log2(langid.DIMS)))] += 1
    v = {k: math.log(1 + c) * float(model.idf[k]) for k, c in seen.items()}
    size = math.sqrt(sum(x * x for x in v.values()))
    best = max(sum(x * float(c[k]) for k, x in v.items()) / size for c in model.centroids)
    bound = model.least * min(1.0, sum(seen.values()) / langid.SHORT) ** 0.5
    assert abs(best - bound) > 1e-4  # the fixture holds no text at the bound
    return best >= bound


def toxic(model, text):
    words = set(re.findall(r"[^\W\d_]+", text.lower()))
    parts = words | {f"{w[:n]}*" for w in words for n in toxicity.PREFIXES if len(w) > n}
    z = model.bias + math.fsum(model.weights.get(xxhash.xxh3_64_intdigest(p), 0.0) for p in parts)
    return z >= 0


def words_of(text):
    return [w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def near_copies_gone(rows):
    """Of each group one row stays: the least id, null last."""
    rows = list(dict.fromkeys((i, t) for i, t in rows))

    def shingles(t):
        w = words_of(t)
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets, of = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and of[a] != of[b]:
                of = [of[b] if x == of[a] else x for x in of]
    groups = defaultdict(list)
    for g, row in zip(of, rows):
        groups[g].append(row)
    return [min(g, key=lambda x: (x[0] is None, x[0] or 0)) for g in groups.values()]


def holds(text, item):
    words, n = words_of(text), len(item)
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row) <= n * 20 // 100


def test_run_equals_the_plain_version(spark, tmp_path):
    rows, labels, items = fixture()
    for name, data, schema in (("documents", rows, SCHEMA), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    known = langid.fit(docs, learn=~langid.held_out())
    left = [r for r in rows if language_is_known(known, r[1])]
    assert {r[0] for r in rows} - {r[0] for r in left} >= {230, 231, 232, 233}
    rude = toxicity.fit(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), learn=~toxicity.held_out("id"))
    clean = [(i, t) for i, t, *_ in left if not toxic(rude, t)]
    assert 0 < len(left) - len(clean) < 80
    single = near_copies_gone(clean)
    assert len(single) < len(clean)
    listed = [words_of(t) for _, t in items if t]
    want = [(i, t) for i, t in single if not any(holds(t, x) for x in listed)]
    assert len(want) < len(single)

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    e = Encoder()
    windows, pieces = defaultdict(list), defaultdict(list)
    for x in got:
        windows[x.sequence_id].append(x)
        pieces[x.doc_id, x.doc_tokens].append(x)
    for w in windows.values():
        w.sort(key=lambda x: x.offset)
        assert [x.offset for x in w] == list(np.cumsum([0, *(x.length for x in w)]))[:-1] and sum(x.length for x in w) <= 2048
    expected = Counter((i, len(e.ids(t))) for i, t in want)
    assert {k: sum(x.length for x in v) for k, v in pieces.items()} == {k: k[1] * n for k, n in expected.items()}
    ids = {i: np.array(e.ids(t), "<u4") for i, t in want if i is not None}
    for x in got:
        if x.doc_id is not None and expected[x.doc_id, x.doc_tokens] == 1 and len(ids[x.doc_id]) == x.doc_tokens:
            assert x.ids_crc32 == zlib.crc32(ids[x.doc_id][x.start : x.start + x.length].tobytes())
