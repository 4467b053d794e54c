"""Files, pipes and options of the programs, and the public objects."""

import io
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import glyphmill
from glyphmill import __main__ as program
from glyphmill.functions import register, tables
from glyphmill.operators import normalize
from glyphmill.sources import text

HERE = Path(__file__).parent / "fixtures"


def sample():
    return (HERE / "sample.txt").read_text(encoding="utf-8").removesuffix("\n").split("\n")


class Pipe:
    def __init__(self, raw):
        self.buffer = io.BytesIO(raw)


def test_a_pipe_goes_through_normalization(spark, capsys, monkeypatch):
    monkeypatch.setattr("sys.stdin", Pipe((HERE / "sample.txt").read_bytes()))
    assert program.main(["norm", "--lc", "fa", "-v"]) == 0
    got = capsys.readouterr()
    assert got.out == (HERE / "sample-fas.txt").read_text(encoding="utf-8")
    assert " lines changed; " in got.err


def test_lines_of_a_pipe(spark):
    def read(raw, **options):
        return [(r.line_no, r.text) for r in text.read_stdin(spark, io.BytesIO(raw), **options).orderBy("line_no").collect()]

    assert read(b"") == []
    assert read(b"a  \r\n\nb") == [(1, "a"), (2, ""), (3, "b")]
    assert read(b"x\xff \n", repair=False, strip=False) == [(1, "x ")]


def test_options_that_contradict_each_other(spark, capsys, monkeypatch):
    monkeypatch.setattr("sys.stdin", Pipe("a b—\n".encode()))
    program.main(["norm", "--only", "space", "--add", "punct-dash", "--skip", "space"])
    got = capsys.readouterr()
    assert got.out == "a b-\n" and "steps both to be done and not to be done are done: space" in got.err
    with pytest.raises(SystemExit):
        program.names("no-such-step")


def test_look_alikes_and_mappings_from_files(spark, tmp_path):
    rows, table = tmp_path / "rows.txt", tmp_path / "table.tsv"
    rows.write_text("﻿::section Identical-looking characters\nz з\n\n::section Similar-looking characters\no о\n", encoding="utf-8")
    table.write_text('src\ttgt\tcomment\na\tAA\tx\n"\t\tdeleted\n', encoding="utf-8")
    assert text.read_look_alikes(spark, str(rows)) == ["z з"]
    assert text.mapping_of(spark, str(table)) == {"a": "AA", '"': ""}
    n = glyphmill.Normalizer("none", ["look-alike"], look_alikes=text.read_look_alikes(spark, str(rows)), table=text.mapping_of(spark, str(table)))
    df = spark.createDataFrame([('"buзz" ba', 1), (None, 2)], "text string, k int")
    assert [r.text for r in n.table_of(df).orderBy("k").collect()] == ["buzz bAA", None]
    with pytest.raises(ValueError):
        glyphmill.Normalizer(table={"": "c"}).column("text")
    assert [r[0] for r in df.select(glyphmill.Normalizer("none", table={"b": "c", "bu": "d"}).column("text")).collect()] == ['"dзz" ca', None]
    with pytest.raises(ValueError):
        glyphmill.Normalizer(add=["no-such-step"])


def test_exclusions_are_read(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text("# a remark\n0958    #  DEVANAGARI LETTER QA\n# 0340 COMBINING GRAVE TONE MARK\n# 2F800..2F802 CJK\n", encoding="utf-8")
    assert sorted(text.read_exclusions(spark, str(path))) == sorted("क़̀\U0002f800\U0002f801\U0002f802")


def test_tables_are_written_and_read_back(spark, tmp_path):
    text.write_mapping(spark, tables.TABLES["core"](), f"{tmp_path}/core")
    assert text.mapping_of(spark, f"{tmp_path}/core") == tables.TABLES["core"]()
    assert text.described("a\u0001") == "U+0061 (LATIN SMALL LETTER A) U+0001 (Control character)"


def test_departures_from_form_kc(spark):
    found = {(r.name, r.side, r.text): (r.ours, r.kc, r.note) for r in tables.compared(spark).collect()}
    assert found["digit", "source", "١"] == ("1", "١", None)
    assert found["literal", "source", "ـ"] == ("", "ـ", "deleted")
    assert all(ours != kc for ours, kc, _ in found.values())


def test_sql_functions_do_what_the_columns_do(spark):
    df = spark.createDataFrame([*enumerate(sample()), (99, None)], "k int, t string")
    names = ["default", "space", "look-alike", "hangul", "digit", "repair-token"]
    made = register.register(spark, names)
    assert made[:3] == ["glyphmill_default", "glyphmill_space", "glyphmill_look_alike"]
    for name, f in zip(names, made):
        steps = normalize.chosen(name) if name == "default" else frozenset([name])
        both = df.select(F.expr(f"{f}(t)").alias("a"), normalize.normalize(F.col("t"), steps).alias("b"))
        assert both.where("not (a <=> b)").count() == 0
    plan = df.selectExpr("glyphmill_space(t) AS t")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    with pytest.raises(ValueError):
        register.register(spark, ["no-such-step"])


def test_the_report_document_and_tags_of_a_pipe(spark, capsys, monkeypatch):
    raw = (HERE / "mixed.txt").read_bytes()

    def run(*options):
        monkeypatch.setattr("sys.stdin", Pipe(raw))
        assert program.main(["ana", *options]) == 0
        return capsys.readouterr().out

    a = glyphmill.Analysis.of_strings(spark, *raw.decode().removesuffix("\n").split("\n"))
    assert run() == a.report() + "\n"
    assert '"n_lines": 2' in run("--document")
    assert run("--tags").startswith("Encoding, script, and tokenization analysis:\nAnalysed ")
    assert [r.doc_id for r in a.summary().orderBy("doc_id").collect()] == [1, 2]
    assert a.tags().count() > 0


def test_the_report_names_lines_by_their_ids(spark, capsys, tmp_path):
    (tmp_path / "ids.txt").write_text("first\nsecond\n", encoding="utf-8")
    assert program.main(["ana", str(HERE / "mixed.txt"), "--ref-ids", str(tmp_path / "ids.txt")]) == 0
    assert "(first)" in capsys.readouterr().out
