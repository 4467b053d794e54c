import json

import duckdb
import pytest
from pyspark.sql import functions as F

from glyphmill import __main__ as program
from glyphmill import catalog
from glyphmill.operators import analyze, bytesafe, lookalike, report
from glyphmill.plans import analysis
from glyphmill.sources import text
from glyphmill.streaming import stream


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(1, "Hеllο! é é"), (2, None), (3, ""), (4, "Tschüß &amp;lt; ـa"), (4, "x@y")], "doc_id long, text string")


def test_look_alikes(spark):
    """Whole words to Latin or Cyrillic, Roman numbers, words to split, and words that stay."""
    cases = [("Austіn", "Austin"), ("жəне", "және"), ("CTVтелеарнасына", "CTV телеарнасына"), ("XІ", "XI"), ("abcгде.ж", "abc где.ж"), ("aбв", "абв"), ("ab.гдж", "ab.гдж"), ("plain text", "plain text"), (None, None), ("", "")]
    df = spark.createDataFrame(cases, "t string, want string")
    assert [(r.t, r.x) for r in df.select("t", lookalike.repaired(F.col("t")).alias("x")).collect()] == cases


def test_bytes(spark):
    """Lone bytes go, or are read as Windows-1252 where an anchor stands; well-formed text stays."""
    df = spark.createDataFrame([(b"a\x80b",), ("Ã".encode() + b"\x93q",), ("\U0001d49cé".encode(),), (None,), (b"",), (b"\xed\xa0\x80x",)], "b binary")
    assert [r.x for r in df.select(bytesafe.text_of(F.col("b")).alias("x")).collect()] == ["ab", "Ã“q", "\U0001d49cé", None, "", "x"]


def test_pattern_of(spark):
    """Two escapes of a kind collapse, the third stays; words, numbers and marks get their names."""
    cases = [("x&a;&b;&c;", "Word&Xml;&Xml;&Word;"), ("ab1-23", "WordNumber-Number"), ("%41%42", "%Xml"), ("́!", "Modifier!"), ("abـcd", "WordـWord")]
    df = spark.createDataFrame(cases, "t string, want string")
    assert [(r.t, r.x) for r in df.select("t", report.pattern_of(F.col("t")).alias("x")).collect()] == cases


def test_non_canonical(docs):
    assert [tuple(r) for r in report.non_canonical(docs).collect()] == [("é", "é", 1, 1, ["compose"], "NFD", "NFC")]


def test_notable_and_rollup(docs):
    got = {(r.heading, r.token): r.n for r in report.notable(docs).collect()}
    assert got == {("XML ESCAPE TOKENS (BASIC)", "&amp;"): 1, ("XML ESCAPE TOKENS (NESTED)", "&amp;lt;"): 1, ("WORDS WITH CHARACTERS FROM MULTIPLE SCRIPTS (CYRILLIC, GREEK, LATIN)", "Hеllο"): 1, ("WORDS WITH CHARACTERS FROM MULTIPLE SCRIPTS (ARABIC, LATIN)", "ـa"): 1}
    found = analysis.rollup(docs).collect()
    assert {r.kind: (r.categories, r.types, r.instances) for r in found if r.level == 1} == {"XML escape tokens": (2, 2, 2), "Words with characters from multiple scripts": (2, 2, 2)}
    assert [(r.categories, r.types, r.instances) for r in found if r.level == 3] == [(4, 4, 4)] and sum(r.instances for r in found if r.level == 0) == 4


def test_issues_are_one_row_a_document(docs):
    got = [r.issues for r in report.issues(docs).collect()]
    assert got == ["3 letter scripts: LATIN, GREEK, CYRILLIC; multi-script word", "", "", "XML escape token; Tatweel", ""]


def test_json_and_report(docs):
    rows = {r.section for r in analysis.as_json(docs).collect() if json.loads(r.json)}
    assert rows == {"overview", "letter-script", "other-script", "non-canonical", "notable-token", "pattern", "block"}
    assert "WORDS WITH CHARACTERS FROM MULTIPLE SCRIPTS" in analysis.printed(docs)


def test_lines_keep_their_numbers_over_splits(spark, tmp_path):
    """Small splits, several files, an ill-formed byte: numbers run from 1 in each file."""
    (tmp_path / "in").mkdir()
    for name in ("a.txt", "b.txt"):
        (tmp_path / "in" / name).write_bytes(b"".join(b"%s %d \n" % (name[:1].encode(), k) for k in range(1, 2001)) + b"x\xffy\n")
    (tmp_path / "in" / "c.dat").write_text("no")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        rows = text.read_lines(spark, str(tmp_path / "in"), "*.txt").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name in "ab":
        got = sorted((r.line_no, r.text) for r in rows if r.doc_id.endswith(f"{name}.txt"))
        assert got == [*((k, f"{name} {k}") for k in range(1, 2001)), (2001, "xy")]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "t.txt").write_text("  a \n<range>\nb\n")
    (tmp_path / "ids").write_text("r1\nr2\nr3\n")
    (tmp_path / "m.tsv").write_text('src\ttgt\tcomment\n"\t\'\tq\nx\t\tgone\n')
    lines = text.read_lines(spark, str(tmp_path / "t.txt"))
    kept = text.with_ref_ids(text.without_range_lines(lines), text.read_ref_ids(spark, str(tmp_path / "ids")))
    assert sorted((r.line_no, r.text, r.ref_id) for r in kept.collect()) == [(1, "a", "r1"), (3, "b", "r3")]
    assert [tuple(r) for r in text.read_mapping(spark, str(tmp_path / "m.tsv")).collect()] == [('"', "'"), ("x", "")]
    text.write_json(kept, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_streams(spark, tmp_path):
    spark.createDataFrame([("aabـ",), (None,)], "text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    for df, name, mode in ((stream.char_counts(stream.normalized(source)), "counts", "complete"), (stream.normalized(source), "plain", "append")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    assert {r.ch: r.n for r in spark.table("counts").collect()} == {"a": 2, "b": 1}
    assert {r.text for r in spark.table("plain").collect()} == {"aab", None}


def test_program(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "t.txt").write_text("aـb &amp;lt;\nwоrd\n")
    program.main(["norm", str(tmp_path / "t.txt"), str(tmp_path / "out")])
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["ab &lt;", "wоrd"]
    program.main(["ana", str(tmp_path / "t.txt"), "--summary"])
    assert "Tatweel; XML escape token; multi-script word" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        program.names("no-such-step")


def test_scripts_and_blocks(spark):
    from glyphmill.operators import scripts

    df = spark.createDataFrame([(1, "aé b. ა٣5½"), (2, "b́ж中 \u0001़"), (3, None), (4, "")], "doc_id long, text string")
    got = {(r.kind, r.script): (r.n, r.ex) for r in scripts.script_counts(df).collect()}
    assert got[("letter", "LATIN")] == (4, None) and got[("letter", "CJK")] == (1, "中") and got[("letter", "GEORGIAN")] == (1, "ა") and got[("letter", "CYRILLIC")] == (1, "ж")
    assert {s: v for (k, s), v in got.items() if k == "number"} == {"ARABIC_INDIC_DIGIT": (1, "٣"), "ASCII_DIGIT": (1, "5"), "VULGAR_FRACTION": (1, "½")}
    assert got[("other", "ASCII_PUNCTUATION")] == (1, ".") and got[("other", "DEVANAGARI_MODIFIERS")] == (1, "़") and got[("other", "C0_CONTROL")] == (1, "\u0001")
    assert got[("other", "COMBINING_DIACRITICAL_MARKS")] == (1, "́") and got[("other", "SPACE")][0] == 3
    rows = {r.ch: (r.block, r.code_point, r.n, r.ex) for r in scripts.block_table(df).collect()}
    assert rows["b"] == ("BASIC_LATIN", "U+0062", 2, [1, 2]) and rows["é"][0] == "LATIN_EXTENDED_LETTER" and rows["中"][0] == "CJK_UNIFIED_IDEOGRAPHS"
    assert scripts.script_counts(df.limit(0)).count() == 0


def test_empty_texts_are_counted_as_in_the_sql(spark, tmp_path):
    rows = [("a\U0001f600 a", "en"), ("", "en"), ("", "de"), ("", None), (None, "de"), ("é", None)]
    spark.createDataFrame(rows, "text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("char_count", "char_count_by_lang"):
        got = sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()), key=str)
        assert got == sorted(db.sql(catalog.ORACLE_SQL[name]).fetchall(), key=str) and any("" in r for r in got)
    assert {r.ch for r in analyze.char_counts(spark.createDataFrame(rows, "text string, lang string")).collect()} == {"a", "\U0001f600", " ", "é"}
