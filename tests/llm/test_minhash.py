import random
import re

from glyphmill.llm import minhash


def brute(rows, width=3, percent=85):
    """Components by comparing all pairs of texts."""
    sets = []
    for doc, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((doc, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())))
    top = {doc: doc for doc, _ in rows if doc is not None}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[k + 1 :]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return sorted(((d, len(s), root(d) if d is not None else None, d is None or root(d) == d) for d, s in sets), key=str)


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, cls string, key int")
    assert sorted((tuple(r) for r in minhash.components(df).collect()), key=str) == brute(rows)


def test_groups_of_copies_chains_and_cases(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for size in (12, 40, 90, 200):
        base = [r.choice(words) for _ in range(size)]
        for k in range(14):
            new = list(base)
            for _ in range(r.randint(0, 1 + size // 60)):
                new[r.randrange(size)] = r.choice(words)
            rows.append((n := n + 1, " ".join(new)))
        chain = list(base)
        for k in range(8):
            chain = [*chain[1:], r.choice(words)]
            rows.append((n := n + 1, " ".join(chain).upper()))
    rows += [(n + k, " ".join(r.choice(words) for _ in range(r.randint(1, 60)))) for k in range(1, 60)]
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "one"), (5004, "ONE"), (5005, "one two"), (None, "one two"), (5006, "é É"), (5007, "É é"), (5008, "a b")]
    rows += [(3, rows[2][1]), (5010, "x y z " * 3000), (5011, "x y z " * 2999 + "x y")]
    check(spark, rows)


def test_a_link_that_no_hub_shows(spark):
    """Two groups, each around its own original, joined by one pair of outer copies."""
    r = random.Random(9)
    base = [f"v{k}" for k in range(100)]
    outer = base[4:] + ["n1", "n2", "n3", "n4"]
    rows = [(1, " ".join(base)), *[(10 + k, " ".join(base[:50] + [f"q{k}"] + base[51:])) for k in range(6)]]
    rows += [(40, " ".join(outer)), (41, " ".join(outer[4:] + ["m1", "m2", "m3", "m4"])), *[(50 + k, " ".join(outer[4:30] + [f"z{k}"] + outer[31:] + ["m1", "m2", "m3", "m4"])) for k in range(6)]]
    r.shuffle(rows)
    check(spark, rows)


def test_empty(spark):
    assert minhash.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_buckets_in_blocks(spark, monkeypatch):
    """A wide group whose outer copies link with each other only; blocks of a few sets."""
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "BLOCK_ITEMS", 700)
    r = random.Random(11)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(60):
        new = list(base)
        for at in r.sample(range(60), r.randint(0, 5)):
            new[at] = f"e{r.randint(0, 3)}"
        rows.append((k, " ".join(new)))
    check(spark, rows)


def test_rows_that_share_an_id_are_one_vertex(spark):
    rows = [(5, "a b c d e"), (5, "v w x y z"), (2, "V W X Y Z"), (9, "a b c d e"), (7, "p q r"), (7, None), (3, "p q s")]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 3, 2, False), (2, 3, 2, True), (9, 3, 2, False), (7, 1, 7, True), (7, 0, 7, True), (3, 1, 3, True)}


def test_a_hub_with_5000_near_copies(spark, monkeypatch):
    base = [f"w{k}" for k in range(120)]
    rows = [(0, " ".join(base))] + [(k, " ".join([*base[:60], f"x{k}", *base[60:]])) for k in range(1, 5001)] + [(9000, "quite another text " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    seen = []
    known = minhash.known_of_both
    monkeypatch.setattr(minhash, "known_of_both", lambda pairs, right, hot: seen.append(hot.count()) or known(pairs, right, hot))
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.components(df).collect()}
    assert got == {k: (0, k == 0) for k in range(5001)} | {9000: (9000, True)}
    assert max(seen) == 1  # the hub's pairs were dealt by their other texts


def test_pairs_of_hot_classes_join_as_all_do(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (4, 5), (3, 9)], "a long, b long")
    known = spark.createDataFrame([(k, f"r{k}") for k in range(10)], "cls long, rep string")
    want = {(a, b, f"r{a}", f"r{b}") for a, b in [(1, 2), (1, 3), (2, 3), (4, 5), (3, 9)]}
    for hot in ([], [1], [3], [1, 2, 3], [9], list(range(10))):
        got = minhash.known_of_both(pairs, known, spark.createDataFrame([(k,) for k in hot], "cls long"))
        rows = [(r.a, r.b, r.rep_a, r.rep_b) for r in got.collect()]
        assert set(rows) == want and len(rows) == 5
