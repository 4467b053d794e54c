import json
import random

from pyspark.sql import functions as F

from glyphmill.operators import lonebytes, tags
from glyphmill.plans import documents

LINES = [b"ok caf\xe9 and \xe9t\xe9", "fine é".encode(), b"over \xc0\xaf \xe0\x80\x80 \xf0\x80\x80\x80", None, b"", b"\xff\xfe x", b"ok caf\xe9", "字".encode()[:2] + b"a"]


def surrogates(raw):
    """The bytes that the decoder of Python finds ill-formed."""
    return [f"0x{ord(c) - 0xDC00:X}" for c in raw.decode("utf-8", "surrogateescape") if 0xDC80 <= ord(c) <= 0xDCFF]


def test_units_equal_those_of_another_decoder(spark):
    r = random.Random(4)
    rows = [bytes(r.choice([r.randint(0, 255), 0x61, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0xED, 0xA0]) for _ in range(r.randint(0, 12))).replace(b"\n", b"") for _ in range(600)]
    df = spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(rows)], "line_no long, raw binary")
    got = {x.line_no: x.u for x in df.select("line_no", F.transform(F.regexp_extract_all(lonebytes.marked(F.col("raw")), F.lit(lonebytes.PAIR), F.lit(0)), lambda x: F.concat(F.lit("0x"), F.hex(lonebytes.byte_of(x)))).alias("u")).collect()}
    assert got == {k: surrogates(x) for k, x in enumerate(rows)} and sum(map(len, got.values())) > 500
    text = {x.line_no: x.t for x in df.select("line_no", lonebytes.shown(lonebytes.marked(F.col("raw"))).alias("t")).collect()}
    assert text == {k: "".join("�" if 0xDC80 <= ord(c) <= 0xDCFF else c for c in x.decode("utf-8", "surrogateescape")) for k, x in enumerate(rows)}


def test_block_rows_tags_and_document(spark):
    df = spark.createDataFrame([(k, None if x is None else bytearray(x)) for k, x in enumerate(LINES, 1)], "line_no long, raw binary")
    rows = {r.code_point: (r.block, r.ch, r.name, r.n, [tuple(x) for x in r.ex]) for r in lonebytes.table(df).collect()}
    assert rows["0xE9"] == ("LOW_SURROGATES", "�", "UTF-8 ENCODING ERROR (BYTE SURROGATE: U+DCE9)", 4, [("caf�", 1), ("�t�", 1), ("caf�", 7)])
    assert rows["0xFF"][3:] == (1, [("��", 6)]) and rows["0xAD"][4] == [("��a", 8)]
    assert sum(x[3] for x in rows.values()) == sum(len(surrogates(x or b"")) for x in LINES)
    lines = df.withColumn("line", F.when(F.is_valid_utf8(F.col("raw").cast("string")), F.col("raw").cast("string")).otherwise("x"))
    found = {(r.tag, r.example): (r.n, r.n_example, r.places) for r in tags.issues(lines, raw_col="raw").where("tag in ('NON_UTF8', 'UTF8_NON_SHORTEST')").collect()}
    assert found[("NON_UTF8", "caf<E9>")] == (5, 2, [1, 7]) and found[("NON_UTF8", "<E5><AD>a")][1:] == (1, [8])
    assert {e for t, e in found if t == "UTF8_NON_SHORTEST"} == {"<C0><AF>", "<E0><80><80>", "<F0><80><80><80>"}
    text = lines.select(F.lit("f").alias("doc_id"), "line_no", F.col("line").alias("text"), "raw").where("raw is not null")
    doc = json.loads(documents.documents(text).first().document)
    assert doc["block"]["LOW_SURROGATES"]["0xE9"] == {"char": "�", "id": "0xE9", "name": "UTF-8 ENCODING ERROR (BYTE SURROGATE: U+DCE9)", "count": 4, "ex": [["caf�", 1], ["�t�", 1], ["caf�", 7]]}
    assert lonebytes.table(df.limit(0)).count() == 0


def test_lines_are_counted_beyond_the_examples(spark):
    """All lines with a byte count, though only the first examples are kept; a byte that a line holds twice counts once."""
    df = spark.range(1, 301).select(F.col("id").alias("line_no"), F.concat(F.encode(F.col("id").cast("string"), "UTF-8"), F.unhex(F.lit("E9E9"))).alias("raw"))
    assert [tuple(r) for r in lonebytes.line_counts(df).collect()] == [("0xE9", 300, 1)]
    assert [(r.n, len(r.ex)) for r in lonebytes.table(df).collect()] == [(600, 5)]
    assert lonebytes.line_counts(df.limit(0)).count() == 0
