import pytest

from glyphmill.functions import tagdata
from glyphmill.operators import tags


def tagged(spark, text, lang=""):
    df = spark.createDataFrame(list(enumerate(text.split("\n"), 1)), "line_no long, line string")
    return {r.tag: r.n for r in tags.counts(df, lang).collect()}


def test_there_are_158_tags_and_ranges_name_them():
    assert len(tagdata.TAGS) == 158
    assert {t for _, _, t in tagdata.ranges()} | {f"{t}_CHAR" for t in tagdata.BY_CHARACTER} | set(tagdata.LETTERS.values()) <= tagdata.TAGS.keys()


#: Texts and how often each tag counts, by the rules of the survey.
KNOWN = [
    ("the cannot 12 .", "", {"ASCII_LETTER": 2, "UNSPLIT_NOT": 1}),
    ("don't John's we'll", "", {"UNSPLIT_NOT": 1, "UNSPLIT_APO_S": 1, "UNSPLIT_APO_V": 1, "UNSPLIT_PUNCT": 3, "ASCII_LETTER": 3}),
    ("well-known ab@cd.org #tag", "", {"UNSPLIT_PUNCT_ALPHA_HYPHEN": 1, "UNSPLIT_PUNCT": 1, "EMAIL": 1, "HASHTAG": 1, "ASCII_LETTER": 3}),
    ("word, x9,a 7. Dr.", "", {"UNSPLIT_PERIOD": 2, "UNSPLIT_PUNCT": 2, "NUM_UNSPLIT_PERIOD": 1, "BEN_UNSPLIT_PERIOD": 1, "ASCII_LETTER": 3}),
    ("'s 1/2 10:30am $5", "", {"BEN_UNSPLIT_APO": 1, "BEN_UNSPLIT_PUNCT": 2, "CURRENCY": 1, "UNSPLIT_PUNCT": 1, "ASCII_LETTER": 2}),
    ("été", "", {"LATIN_PLUS_ALPHA": 1, "ASCII_LETTER": 1}),
    ("été", "fr", {"LANGUAGE_SPECIFIC": 1, "ASCII_LETTER": 1}),
    ("–a—b–", "", {"NON_ASCII_PUNCT": 1, "NON_ASCII_PUNCT_CHAR": 2, "ASCII_LETTER": 1}),
    ("é–—", "", {"LATIN_PLUS_ALPHA": 1, "NON_ASCII_PUNCT": 1, "NON_ASCII_PUNCT_CHAR": 1}),
    ("كتابي ککک xیی", "", {"ARABIC_LETTER": 1, "ARABIC_NON_STANDARD": 2, "FARSI_LETTER_KEHEF": 2, "FARSI_LETTER_YEH": 2, "MIXED_ARABIC_ASCII": 1, "ASCII_LETTER": 1}),
    ("﻿a b​", "", {"INITIAL_BYTE_ORDER_MARK": 1, "ZERO_WIDTH": 1, "ASCII_LETTER": 2}),
    ("Oк да. .да", "", {"MIXED_CYRILLIC_LATIN": 1, "CYRILLIC": 3, "CYRILLIC_PLUS_PERIOD": 1, "PUNCT_CYRILLIC": 1, "UNSPLIT_PERIOD": 2, "ASCII_LETTER": 1}),
    ("\u092c\u0921\u0947\u093c \u0958", "", {"DEVANAGARI": 2, "STD_SEP_NUKTA": 1, "DIS_VSGN_NUKTA": 1, "ALT_CMP_NUKTA": 1}),
    ("http : / / www . abc . com now", "", {"BROKEN_URL": 1, "ASCII_LETTER": 5}),
    ("john @ abc . org or a &amp; b &#39;", "", {"BROKEN_EMAIL": 1, "XML_ESC_STD": 1, "XML_ESC_DEC": 1, "ASCII_LETTER": 7, "UNSPLIT_PUNCT": 1, "UNSPLIT_PERIOD": 2}),
    ("a" * 25 + " " + "é" * 31, "", {"LONG_TOKEN_20": 1, "LONG_TOKEN_30": 1, "ASCII_LETTER": 1, "LATIN_PLUS_ALPHA": 1}),
    ("x &amp; y &#39; &#x41; &bullet;", "", {"XML_ESC_STD": 1, "XML_ESC_DEC": 1, "XML_ESC_HEX": 1, "XML_ESC_ABC": 1, "UNSPLIT_PERIOD": 4, "UNSPLIT_PUNCT": 3, "ASCII_LETTER": 5}),
    ("", "", {}),
]


@pytest.mark.parametrize(("text", "lang", "want"), KNOWN)
def test_tags_count_as_known(spark, text, lang, want):
    assert tagged(spark, text, lang) == want


def test_examples_places_and_report(spark):
    df = spark.createDataFrame([(k, "he'll go" if k % 2 else "we'll you'll we'll") for k in range(1, 31)], "line_no long, line string")
    found = tags.issues(df, examples=2, places=3)
    rows = {r.example: r for r in found.where("tag = 'UNSPLIT_APO_V'").collect()}
    assert {k: (r.rank, r.n_example, r.places) for k, r in rows.items()} == {"he'll": (1, 15, [1, 3, 5]), "we'll": (2, 30, [2, 2, 4])}
    assert rows["he'll"].n == 60 and rows["he'll"].n_examples == 3
    text = tags.printed(found, examples=2, places=3, n_tokens=75, n_lines=30)
    assert "Unsplit 'd/'ll/'m/'ve (60 instances)\n  we'll (30 instances; lines 2, 2, 4, ...)\n  he'll (15 instances; lines 1, 3, 5, ...)\n  ...\n" in text
    assert "No examples shown" in tags.printed(found, lang="en")
    assert tags.issues(df.limit(0)).count() == 0


def test_ill_formed_bytes(spark):
    df = spark.createDataFrame([(b"ok caf\xe9 \xc0\xaf",), ("fine é".encode(),), (None,)], "raw binary")
    assert {r.tag: r.n for r in tags.ill_formed(df).collect()} == {"NON_UTF8": 1, "UTF8_NON_SHORTEST": 1}


def test_counts_of_some_tags_look_at_no_more_than_these_need(spark):
    lines = spark.createDataFrame([(1, "аb é & lt ; &amp; x,y"), (2, "été $5 &#39; http : / / www . abc . com")], "line_no long, line string")
    every = {r.tag: r.n for r in tags.counts(lines).collect()}
    escapes, mixed = frozenset({"XML_ESC_DEC", "XML_ESC_STD"}), frozenset({"MIXED_CYRILLIC_LATIN"})
    for only in (escapes, mixed, escapes | mixed, frozenset(every)):
        assert {r.tag: r.n for r in tags.counts(lines, only=only).collect()} == {k: n for k, n in every.items() if k in only}
    plan = lambda only: tags.counts(lines, only=only)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan(escapes) and "aggregate(sequence" not in plan(mixed) and "Join" not in plan(mixed)


def test_no_token_is_tagged_twice_and_no_line_searched_twice(spark):
    lines = spark.createDataFrame([(1, "x é–— http : / / www . abc . com")], "line_no long, line string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    every, inside = plan(tags.counts(lines)), plan(tags.character_counts(lines))
    assert every.count("aggregate(sequence") == 1 and every.count("LONG_TOKEN_30") == 1
    # characters meet the ranges of their classes alone: no token is joined to its count again
    assert inside.count("Join") == 1 and "LONG_TOKEN_30" not in inside
    found = spark.createDataFrame([("é–—", 7), ("–a–", 2)], "token string, n long")
    rows = {(r.token, r.n, r.tag, r.example, r.times) for r in tags.char_tags(found).collect()}
    assert rows == {("é–—", 7, "LATIN_PLUS_ALPHA", "é–—", 1), ("é–—", 7, "NON_ASCII_PUNCT", "é–—", 1), ("é–—", 7, "NON_ASCII_PUNCT_CHAR", "–", 1), ("–a–", 2, "NON_ASCII_PUNCT", "–a–", 1), ("–a–", 2, "NON_ASCII_PUNCT_CHAR", "–", 1)}
