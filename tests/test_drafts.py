import unicodedata as ud
from pathlib import Path

from glyphmill.functions import tables


def test_drafts_leave_out_what_is_known_or_alike(spark):
    known = [x.split("\t")[0] for x in (Path(__file__).parent / "fixtures/preserved.tsv").read_text(encoding="utf-8").split("\n")[1:] if x]
    chars = [chr(c) for c in (*range(0xA0, 0x180), *range(0x2070, 0x20A0), *range(0x2150, 0x2190), 0x2E9F, 0x2F00, 0xFB01)]
    df = spark.createDataFrame([(c,) for c in chars + chars[:9]], "ch string")
    every = {r.orig: r for r in tables.drafted(df, spark.createDataFrame([], "orig string")).collect()}
    assert all(r.ours != r.kc == ud.normalize("NFKC", r.orig) for r in every.values()) and "a" not in every
    left = {r.orig for r in tables.drafted(df, spark.createDataFrame([(c,) for c in known], "orig string")).collect()}
    assert left == every.keys() - set(known) and len(left) < len(every)
    kept = {r.orig: r.category for r in tables.drafted(df, spark.createDataFrame([], "orig string"), kept_only=True).collect()}
    assert (kept["²"], kept["₂"], kept["½"], kept["¨"]) == ("SUPERSCRIPT", "SUBSCRIPT", "FRACTION", "DIACRITIC")
    assert tables.category_of("⺟") == "RADICAL" and tables.category_of("a") is None
