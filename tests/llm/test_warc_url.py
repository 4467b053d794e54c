import base64
import hashlib
import random
import re
from itertools import combinations

from glyphmill.llm import queries, urlrules, warc


def test_archives_give_pages_back(spark):
    r = random.Random(2)
    rows = [(k, f"http://h{k % 7}.example/p q\n{k}", "é" * r.randint(0, 3000)) for k in range(200)]
    rows += [(300 + k, "u", "same copy") for k in range(50)] + [(400, None, None), (401, "", ""), (402, "x", None), (None, "n", "same copy"), (None, "n", "alone"), (349, "u", "same copy"), (403, "y", "\r\n\r\nWARC/1.0\r\n\r\n")]
    df = spark.createDataFrame([(*x, 7) for x in rows], "page_id long, url string, html string, offset int")
    index = warc.write(df)
    got = warc.read(index).collect()
    assert len(got) == len(rows) == index.count()
    digest = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    html = {i: h or "" for i, _, h in rows if i is not None}
    for x in got:
        if x.page_id is not None:
            assert x.payload_digest == digest(html[x.page_id])
            assert x.payload is None if x.record_type == "revisit" else x.payload.decode() == html[x.page_id]
    kinds = {(x.page_id, x.record_type, x.refers_to) for x in got}
    assert {(300 + k, "revisit", 349) for k in range(49)} | {(349, "response", None), (400, "revisit", 402), (401, "revisit", 402), (402, "response", None), (0, "response", None)} <= kinds
    final = warc.resolved(warc.read(index, payloads=False)).collect()
    assert all(x.payload_bytes == len(html[x.page_id].encode()) for x in final if x.page_id is not None) and len(final) == len(rows)
    some = warc.read(index.where("page_id in (3, 77, 150)")).collect()
    assert sorted(x.page_id for x in some) == [3, 77, 150]
    whole = warc.resolved(warc.read(warc.write(df, least_bytes=1), payloads=False)).where("page_id between 400 and 402").collect()
    assert {x.record_type for x in whole} == {"response"}
    assert warc.read(warc.write(df.limit(0))).count() == 0


def parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)(.*)", url or "", re.S)
    return ("", "", "") if not m else (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2], m[3])


def tokens(url):
    return {f"{k}:{t}" for k, s in zip("hpq", parts(url)) for t in re.findall(r"[^\W_]+", s.lower())}


def test_rules_and_verdicts_equal_a_plain_version(spark):
    r = random.Random(5)
    hosts = ["good.example.org", "Spam.Example.net", "mixed.example.io", "example.com", "notexample.com", "a.example.com"]
    rows = []
    for k in range(400):
        h = r.choice(hosts)
        rows.append((k, f"http{r.choice(['', 's'])}://{h}/{r.choice(['en', 'de', 'es'])}/{r.choice([7, 8, 71, 9])}{r.choice(['', '?utm=1', '#top', '?x=win'])}"))
    rows += [(500, None), (501, ""), (502, "no scheme/en/"), (503, "a://COM/en/x"), (504, "a://b://c/d"), (505, "http://com"), (None, "http://Spam.Example.net/de/7"), (7, rows[7][1]), (506, "http://x.org?/es/"), (507, "://q/\n/es/")]
    labels = [(k, int(not ("Spam" in u or ("mixed" in u and "win" in u) or r.random() < 0.05)), 0) for k, u in rows[:300]] + [(None, 0, 1), (3, None, None)]
    pages = spark.createDataFrame([(*x, 1.0, "t") for x in rows], "page_id long, url string, confidence double, tokens string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    mined = urlrules.mine(pages, lab, min_support=0.02)
    bad = {}
    for k, q, t in labels:
        bad[k] = bad.get(k, False) or q == 0 or t == 1
    baskets = [(tokens(u), bad[k]) for k, u in rows if k in bad and k is not None and tokens(u)]
    n, base, want, least = len(baskets), sum(b for _, b in baskets), {}, []
    where = {}
    for k, (t, _) in enumerate(baskets):
        for x in t:
            where.setdefault(x, []).append(k)
    folded = {}
    for x in sorted(where):
        folded.setdefault(tuple(where[x]), []).append(x)
    whole = {x[0]: x for x in folded.values()}  # tokens of the same URLs are one item
    baskets = [({x for x in t if x in whole}, b) for t, b in baskets]
    for size in (1, 2, 3, 4, 5, 6, 7):
        for x in {c for t, _ in baskets for c in combinations(sorted(t), size)}:
            has = [b for t, b in baskets if t.issuperset(x)]
            c = sum(has) / len(has)
            if sum(has) >= max(0.02 * n, 8) and c >= 0.6 and c / (base / n) >= 1.5 and not any(set(y) < set(x) for y in least):
                least.append(x)
                want[tuple(sorted(t for y in x for t in whole[y]))] = c
    got = {tuple(x.tokens): x.confidence for x in mined.collect()}
    assert got.keys() == want.keys() and got and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    judged = urlrules.judge(pages, mined, queries.URL_RULES).collect()
    assert len(judged) == len(rows)
    by = {}
    for i, u in rows:
        host, path, _ = parts(u)
        fits = [(len(h + p), -k, v, h + p) for k, (v, h, p) in enumerate(queries.URL_RULES) if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
        c = max((want[x] for x in want if tokens(u).issuperset(x)), default=None)
        by.setdefault(i, []).append((host, path, max(fits)[3] if fits else None, max(fits)[2] if fits else ("block" if c else "allow"), c and round(c, 9)))
    for x in judged:
        assert (x.host, x.path, x.rule, x.verdict, x.confidence and round(x.confidence, 9)) in by[x.page_id]


def test_no_labels_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    none = urlrules.mine(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert urlrules.judge(pages, none).first().verdict == "allow" and urlrules.judge(pages.limit(0), none).count() == 0


def test_a_trap_of_many_parameters_makes_few_rules(spark):
    """Parameters of blocked URLs, all together or each with a chance of 0.9, of blocked and other URLs: sets are not mined one by one."""
    r = random.Random(1)
    rows, labels = [], []
    for k in range(120):
        if k < 40:
            query = "&".join(f"p{j}=1" for j in range(30))
        elif k < 80:
            query = "&".join(f"q{j}=1" for j in range(30) if r.random() < 0.9)
        else:
            query = "&".join(f"c{j}=1" for j in range(30) if r.random() < 0.9)
        rows.append((k, f"http://h{k}.example/x?{query}"))
        labels.append((k, int(k >= 80), 0))
    mined = urlrules.mine(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {tuple(x.tokens) for x in mined.collect()}
    assert tuple(sorted(f"q:p{j}" for j in range(30))) in found and {(f"q:q{j}",) for j in range(30)} <= found and len(found) < 50


def test_the_first_of_equally_long_rules_wins(spark):
    pages = spark.createDataFrame([(1, "http://a.com/xy/z"), (None, None), (None, None)], "page_id long, url string")
    none = urlrules.mine(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    for fixed in ([("block", "com", "/xy/z"), ("allow", "a.com", "/xy")], [("allow", "a.com", "/xy"), ("block", "com", "/xy/z")]):
        assert urlrules.judge(pages, none, fixed).where("page_id = 1").first().verdict == fixed[0][0]
    assert urlrules.judge(pages, none).where("page_id is null and host = '' and verdict = 'allow'").count() == 2


def test_fixed_rules_are_those_of_the_contract(spark):
    cases = [("a.com/en/1", "com/en/", "block"), ("example.com/en/71", "example.com/en/7", "allow"), ("x.net/de/1", "net/de/", "allow"), ("example.net/de/7", "net/de/", "allow"), ("a.example.net/de/8", "example.net/de/8", "block"), ("x.org/es/", "org/es/", "block")]
    pages = spark.createDataFrame([(k, f"http://{c[0]}") for k, c in enumerate(cases)], "page_id long, url string")
    none = spark.createDataFrame([], urlrules.RULES_SCHEMA)
    judged = urlrules.judge(pages, none, queries.URL_RULES).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in judged] == [c[1:] for c in cases]
