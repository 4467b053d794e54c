import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.functions import masks, tries
from glyphmill.operators import changelog, normalize
from glyphmill.streaming import stream
from glyphmill.operators import report

TABLE = {"a": "1", "ab": "22", "abc": "", "c": "a", "ca": "x.", "\U0001d400b": "é", "]": "[", "\\": "/", "$^": "-"}
TEXTS = ["abcab ca abca", "\U0001d400b\U0001d400", "]\\$^$", "", None, "plain z", "aabbcc" * 50]


def test_the_longest_source_wins_in_one_pass(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    assert [r[0] for r in df.select(tries.replaced(F.col("t"), TABLE)).collect()] == [None if t is None else tries.plain(t, TABLE) for t in TEXTS]
    assert [r[0] for r in df.select(normalize.normalize(F.col("t"), frozenset(), table=TABLE)).collect()][0] == tries.plain(TEXTS[0], TABLE)
    with pytest.raises(ValueError):
        tries.replaced(F.col("t"), {"": "x"})


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=4), min_size=1, max_size=12), st.text("abcd", max_size=30))
def test_the_pattern_of_a_trie_matches_as_a_scan(sources, text):
    import re

    table = {s: f"<{s}>" for s in sources}
    p = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), tries.pattern(tries.trie(sources)))
    assert re.sub(p, lambda m: table[m[0]], text) == tries.plain(text, table)
    assert re.sub(tries.alternatives(sources), lambda m: table[m[0]], text) == tries.plain(text, table)


def test_the_change_log_counts_a_mapping(spark):
    df = spark.createDataFrame([("abc",), ("zzz",), ("xc",)], "text string")
    rows = {r.step: (r.n_calls, r.n_changed) for r in changelog.change_log(df, frozenset(), table=TABLE).collect()}
    assert rows["mapping"] == (3, 2) and rows["all"] == (3, 2)


def test_streamed_examples_equal_those_of_a_table_in_any_order(spark, tmp_path):
    rows = [(k, "ab" if k % 3 else "bc é") for k in range(40)]
    for n, part in enumerate((rows[30:], rows[:10], rows[10:30])):
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    whole = spark.createDataFrame(rows, "doc_id long, text string")
    source = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = stream.character_examples(source, f"{tmp_path}/kept", k=4)
    query.awaitTermination()
    assert query.lastProgress.batchId == 2
    got = sorted(tuple(r) for r in stream.seen_examples(query, spark, f"{tmp_path}/kept").collect())
    assert got == sorted(tuple(r) for r in report.char_examples(whole, 4).select("ch", "n", "ex").collect())


def test_classes_of_many_ranges_are_trees(spark):
    """No part of a class has more than FEW ranges side by side, and it matches the same characters, also within and without a negation."""
    chars = [chr(c) for c in (*range(0x21, 0x3000, 7), *range(0x1F100, 0x1F200, 3), *range(0x4E00, 0x4E20), 0x10FFFF)]
    found = masks.class_of(chars)
    assert max(len(re.findall(r"\\x", p)) for p in re.split(r"&&|[\[\]]+", found)) <= 2 * masks.FEW
    every = "".join(map(chr, (*range(0x20, 0x5000), *range(0x1F000, 0x1F300), 0x10FFFF)))
    df = spark.createDataFrame([(every,)], "t string")
    kept, gone = df.select(F.regexp_replace("t", F.lit(f"[^{found[1:]}+"), F.lit("")), F.regexp_replace("t", F.lit(f"{found}+"), F.lit(""))).first()
    assert kept == "".join(c for c in every if c in set(chars)) and gone == "".join(c for c in every if c not in set(chars))
    low, = df.select(F.regexp_replace("t", F.lit(rf"[^\x{{0}}-\x{{24F}}{masks.class_of(c for c in chars if ord(c) > 0x24F)[1:]}+"), F.lit(""))).first()
    assert low == "".join(c for c in every if ord(c) <= 0x24F or c in set(chars))
