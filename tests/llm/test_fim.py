import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.llm import fim

SPACE = " \t\n\x0b\x0c\r"


def units(text):
    """Tokens by a scan of characters."""
    out, k = [], 0
    while k < len(text):
        a = k
        while k < len(text) and text[k] in SPACE:
            k += 1
        while k < len(text) and text[k] not in SPACE:
            k += 1
        out.append(text[a:k])
    return out


def plain(doc_id, text):
    t = units(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if text == "" or re.search("<[PSM]>", text) or c % 100 >= 50:
        return len(t), "plain", None, None, text
    x, y = sorted((a % (len(t) + 1), b % (len(t) + 1)))
    p, m, s = ("".join(z) for z in (t[:x], t[x:y], t[y:]))
    form = "spm" if d % 100 < 80 else "psm"
    return len(t), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def corpus():
    r = random.Random(5)
    signs = "ab <>PSM\n\té字\U0001f600  \x1c"
    rows = [(k, "".join(r.choice(signs) for _ in range(r.randint(0, 60)))) for k in range(300)]
    rows += [(k, "one two  three\n four " * r.randint(1, 4)) for k in range(300, 600)]
    rows += [(None, None), (None, "a b c"), (7, ""), (8, None), (9, "  \n "), (9, "  \n "), (10, "x <M> y"), (11, "word " * 200_000), (12, " " * 100_000), (13, "z" * 100_000), (-5, "a b"), (2**40, "<P <S <M")]
    return rows


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab \n\té字\U0001f600 <>"), max_size=40), st.integers(-(2**40), 2**40))
def test_a_cut_equals_a_plain_version(text, doc_id):
    assert fim.cut(text, doc_id, fim.SEED, fim.CUT, fim.SUFFIX_FIRST) == plain(doc_id, text)


def test_ends_take_any_ranks():
    text = " a  b\tc \n"
    t = units(text)
    for x in range(len(t) + 1):
        for y in range(x, len(t) + 1):
            assert fim.ends(text, x, y) == (len("".join(t[:x])), len("".join(t[:y])))


def test_rows_equal_a_plain_version_and_are_restored(spark):
    df = spark.createDataFrame([(*x, "clash", 1) for x in corpus()], "doc_id long, text string, form string, n int")
    got = sorted(map(str, (tuple(r) for r in fim.transformed(df).collect())))
    assert got == sorted(str((i, *plain(i, t or ""))) for i, t in corpus())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted(str((i, *(p := plain(i, t or ""))[:4], sha(p[4]), sha(t or ""))) for i, t in corpus())
    assert sorted(str(tuple(r)) for r in fim.digests(fim.transformed(df)).collect()) == want
    assert {p[1] for p in (plain(i, t or "") for i, t in corpus())} == {"plain", "spm", "psm"}
    assert fim.transformed(df.limit(0)).count() == 0


def test_rates(spark):
    df = spark.createDataFrame([(k, "a b c d e") for k in range(400)], "doc_id long, text string")
    assert {r.form for r in fim.transformed(df, rate=0).collect()} == {"plain"}
    assert {r.form for r in fim.transformed(df, rate=100, suffix_first=0).collect()} == {"psm"}
    assert [r.output for r in fim.transformed(df, seed=1).orderBy("doc_id").collect()] != [r.output for r in fim.transformed(df).orderBy("doc_id").collect()]
    with pytest.raises(Exception):
        fim.transformed(df, text_col="absent")
