import pytest
from pyspark.sql import functions as F

from glyphmill import catalog
from glyphmill.functions import mappings as M
from glyphmill.operators import analyze, normalize

CASES = [
    ("repair-encoding-errors", "Ã©tÃ© â\u0082¬ \u0092 \u0081", "été € ’ "),
    ("del-ctrl-char", "a\u0001b\tc︎", "ab\tc"),
    ("del-zero-width", "a​b﻿c", "abc"),
    ("pres-form", "ﷲ ﺏ", "الله ب"),
    ("cjk", "㎢ 豈", "km² 豈"),
    ("width", "ＡＢ１", "AB1"),
    ("font", "𝐀ℂ𝟘", "AC0"),
    ("enclosure", "① 🄐 ㉑", "(1) (A) (21)"),
    ("hangul", "한", "한"),
    ("combining-compose", "é ü ṻ", "é ü ṻ"),
    ("combining-decompose", "क़", "क़"),
    ("digit", "١٢ ९ ൦", "12 9 0"),
    ("georgian-char", "Ⴀ ჳ", "ა ვი"),
    ("repair-xml", "&amp;amp;quot; &amp; &amp;lt;", "&quot; &amp; &lt;"),
    ("repair-token", "12ب٪", "12 ب٪"),
]


@pytest.mark.parametrize(("step", "text", "want"), CASES)
def test_step(spark, step, text, want):
    df = spark.createDataFrame([(text,), (None,), ("plain text",)], "text string")
    got = [r.x for r in df.select(normalize.normalize(F.col("text"), frozenset({step})).alias("x")).collect()]
    assert got == [want.rstrip(" "), None, "plain text"]


def test_gates_look_at_the_original(spark):
    """Punctuation changes only where a core compatibility character stands; a soft hyphen goes only beside another control."""
    df = spark.createDataFrame([("«x»",), ("«x»…",), ("a­b",), ("a­b​",)], "text string")
    steps = frozenset({"punct", "del-zero-width"})
    assert [r.x for r in df.select(normalize.normalize(F.col("text"), steps).alias("x")).collect()] == ["«x»", "“x”...", "a­b", "ab"]


def test_url_escapes_cannot_be_switched_off_and_trailing_spaces_go(spark):
    df = spark.createDataFrame([("a%25C3%25AB  \nb \t",)], "text string")
    assert df.select(normalize.normalize(F.col("text"), frozenset())).first()[0] == "a%C3%AB\nb\t"


def test_tables_have_their_sizes():
    assert [len(t()) for t in (M.core, M.digits, M.mojibake, M.presentation, M.cjk, M.enclosure, M.font)] == [191, 541, 241, 731, 1720, 468, 1255]


def test_chosen():
    assert normalize.chosen("none", add=["space"], skip=["space"]) == {"space"}
    assert normalize.chosen("default", skip=["hangul"]) == normalize.DEFAULT - {"hangul"} and len(normalize.NAMES) == len(set(normalize.NAMES))


def test_analysis(spark):
    df = spark.createDataFrame([(1, "Aé б\nx"), (2, None), (3, "")], "doc_id long, text string")
    assert tuple(analyze.overview(df).first()) == (3, 8)
    assert {r.script: (r.n, r.letters) for r in analyze.letter_scripts(df).collect()} == {"LATIN": (3, "Axé"), "CYRILLIC": (1, "б")}
    assert analyze.lines(df.where("doc_id = 1")).collect()[1].line == "x"


def test_catalog_is_consistent():
    assert catalog.ORACLE_SQL.keys() <= catalog.QUERIES.keys() and len(catalog.QUERIES) > 50


def test_only_words_with_a_source_go_through_the_steps(spark):
    """Words apart, one after the other, at both ends, after two blanks and after an end of line; what stands between them is kept."""
    text = "plain  бo x\n️ &   áb ́̂̃c\ttab\nno  odd word here\n12ب %25C3%25A9 end é \u0001"
    steps = normalize.chosen("all")
    df = spark.createDataFrame([(text,), ("\n \n",), ("plain é  words\n\n only ",)], "text string")
    words = [s for s in normalize.STEPS if s.name in steps]
    got = df.select("text", normalize.collapsed(F.col("text"), words).alias("c"))
    rows = got.select("c", normalize.restored(F.col("c"), F.col("text"), words).alias("r"), "text").collect()
    assert all(r.r == r.text for r in rows) and [r.c for r in rows[1:]] == ["\n", "\n"] and rows[0].c.count("\n") == 4
    stepwise = F.col("text")
    for s in words:
        if s.name not in ("farsi-char", "pashto-char", "arabic-char", "punct"):  # gates that are shut here
            stepwise = s.apply(stepwise)
    both = df.select(normalize.normalize(F.col("text"), steps).alias("n"), F.regexp_replace(stepwise, "(?m) +(?=\t|$)", "").alias("s")).collect()
    assert all(r.n == r.s for r in both)


def test_a_long_text_of_words_needs_no_stack(spark):
    df = spark.range(1).select(F.concat(F.repeat(F.lit("word "), 200_000), F.repeat(F.lit(" x "), 200_000), F.repeat(F.lit("y"), 500_000)).alias("text"))
    assert df.select(F.length(normalize.normalize(F.col("text"), frozenset({"space"})))).first()[0] == 1_000_000 + 600_000 + 500_000
