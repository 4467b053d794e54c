import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glyphmill import __main__ as program
from glyphmill.plans import cases, documents

HERE = Path(__file__).parent / "fixtures"
FILES = ["mixed.txt", "phrases/deu.txt", "sample.txt"]
ODD = ["", "é é x́y ﬁ \"q\" \\ \t \u0001", "كک ي یـx 1̈ a­b", "&amp;lt; wоrd אb %C3%A9 \U0001d400 क़"]


def rows():
    out = []
    for name in FILES:
        text = (HERE / name).read_text(encoding="utf-8").removesuffix("\n")
        out += [(name, k, t) for k, t in enumerate(text.split("\n"), 1)]
    return out + [("odd", k, t) for k, t in enumerate(ODD, 1)] + [("empty", 1, "")]


@pytest.mark.parametrize("limit", [None, 2])
def test_documents_of_many_files_equal_those_of_each(spark, limit):
    df = spark.createDataFrame(rows(), "doc_id string, line_no long, text string").repartition(3)
    got = {r.doc_id: json.loads(r.document) for r in documents.documents(df, cases=limit).collect()}
    assert set(got) == {*FILES, "odd", "empty"}
    for name in ("mixed.txt", "odd") if limit else got:
        want = json.loads(json.dumps(cases.nested(df.where(F.col("doc_id") == name).select("line_no", "text"), cases=limit)))
        assert got[name] == want
        for part in ("letter-script", "number-script", "other-script", "block", "pattern"):
            assert list(got[name][part]) == list(want[part]) or part == "pattern"
    assert documents.documents(df.limit(0)).count() == 0


def test_the_known_document(spark):
    text = (HERE / "mixed.txt").read_text(encoding="utf-8")
    df = spark.createDataFrame([("m", k, t) for k, t in enumerate(text.removesuffix("\n").split("\n"), 1)], "doc_id string, line_no long, text string")
    plan = documents.documents(df, cases=None, final_newline=text.endswith("\n"))
    assert json.loads(plan.first().document) == json.loads((HERE / "mixed.json").read_text(encoding="utf-8"))


def test_a_directory_is_read_once(spark, tmp_path, monkeypatch):
    for name, text in (("a.txt", "café\nwоrd\n"), ("b.txt", "plain\n")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    reads = []
    monkeypatch.setattr(program.text, "read_lines", lambda *a, of=program.text.read_lines, **k: reads.append(1) or of(*a, **k))
    lines = program.text.read_lines(spark, str(tmp_path), strip=False)
    found = {Path(r.doc_id).name: json.loads(r.document) for r in documents.documents(lines).collect()}
    assert found["b.txt"]["n_lines"] == 1 and list(found["a.txt"]["non-canonical"]) == ["é"] and len(reads) == 1
    assert any("MULTIPLE SCRIPTS" in h for h in found["a.txt"]["notable-token"])


def test_sections_look_at_different_characters_and_tokens_alone(spark):
    df = spark.createDataFrame([("a", 1, " Ab, é x-y wоrd &lt; Ab, Ab, "), ("a", 2, "Ab, q.é x-y"), ("b", 1, "Ab,")], "doc_id string, line_no long, text string")
    found = {(r.doc_id, r.pattern): (r.n, tuple(r.first), [(x.text, x.line_no) for x in r.ex]) for r in cases.patterns(df, 2, ["doc_id"]).collect()}
    assert found["a", "Word,"] == (4, (1, 0), [("Ab,", 1), ("Ab,", 2)]) and found["b", "Word,"] == (1, (1, 0), [("Ab,", 1)])
    assert found["a", "Word-Word"] == (2, (1, 2), [("x-y", 1), ("x-y", 2)])
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    shapes, inside, odd = plan(cases.patterns(df, 2)), plan(cases.characters(df, 2)), plan(cases.report.non_canonical(df))
    # the tokens of a line are found once for counts and once for examples, not again by an explode's filter
    assert shapes.count("regexp_extract_all") == 2
    # a line's characters are not counted by line, and are counted before they are looked at
    assert "Aggregate [line_no" not in inside and "orig_count" in next(x for x in odd.splitlines() if r"^\p{L}\p{M}*$" in x)
