"""Outputs that are known for a sample of 25 lines and for small texts (fixed values, in tests/fixtures)."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import normalize
from glyphmill.plans import cases

HERE = Path(__file__).parent / "fixtures"


def read(name):
    return (HERE / name).read_text(encoding="utf-8")


def lines(spark, name):
    text = read(name)
    return spark.createDataFrame([(k, t) for k, t in enumerate(text.removesuffix("\n").split("\n"), 1)], "line_no long, text string"), text.endswith("\n")


@pytest.mark.parametrize(("name", "steps", "lang"), [("sample-fas.txt", normalize.DEFAULT, "fas"), ("sample-fas-without.txt", normalize.chosen("default", skip=["del-ctrl-char", "del-tatweel"]), "fas"), ("sample-all.txt", normalize.chosen("all"), "")])
def test_the_sample_is_normalized_as_known(spark, name, steps, lang):
    df, _ = lines(spark, "sample.txt")
    got = [r.t for r in df.orderBy("line_no").select(normalize.normalize(F.rtrim("text"), steps, lang).alias("t")).collect()]
    assert got == read(name).removesuffix("\n").split("\n")


def test_what_must_not_change_does_not(spark):
    rows = [tuple(x.split("\t")) for x in read("preserved.tsv").split("\n")[1:] if x]
    assert len(rows) == 276
    df = spark.createDataFrame(rows, "orig string, expected string")
    assert df.where(normalize.normalize(F.col("orig"), normalize.chosen("all")) != F.col("expected")).count() == 0


def test_the_document_and_report_of_mixed_words(spark):
    df, newline = lines(spark, "mixed.txt")
    doc = cases.nested(df, final_newline=newline)
    assert doc == json.loads(read("mixed.json"))
    assert cases.written(doc) == read("mixed-report.txt")


def test_lines_of_issues_and_line_ids(spark):
    want = dict(x.split(": ", 1) if ": " in x else (x.rstrip(": "), "") for x in read("phrases-issues.txt").splitlines())
    docs = {}
    for name in want:
        df, newline = lines(spark, f"phrases/{name}")
        docs[name] = cases.nested(df, final_newline=newline)
        assert cases.line_of_issues(docs[name]) == want[name].strip()
    refs = dict(enumerate(read("phrases/eng.txt").splitlines(), 1))
    assert cases.written(docs["deu.txt"], refs=refs) == read("phrases-deu-report.txt")


def test_the_report_of_the_sample(spark):
    df, newline = lines(spark, "sample.txt")
    got, want = cases.written(cases.nested(df, final_newline=newline)).splitlines(), read("sample-report.txt").splitlines()
    missing, extra = [x for x in want if x not in got], [x for x in got if x not in want]
    assert (missing, extra) == ([], [])
    assert got == want
