import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyarrow.parquet import ParquetFile
from pyspark.sql import functions as F

from glyphmill.llm import bfd, common, lm
from glyphmill.llm.tokens import Encoder


def corpus():
    r = random.Random(8)
    words = [f"w{k}" for k in range(30)] + ["the"] * 10
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randint(1, 50)))) for k in range(80)]
    return rows + [(None, "the THE w1"), (5, "w1 w2\tw3\n"), (5, "w1 w2\tw3\n"), (90, None), (91, ""), (92, " \n "), (93, "word " * 3000)]


def brute(rows, order, least=1, alpha=0.4, corpus=None):
    counts, out = Counter(), []
    texts = [(i, (t or "").lower().split()) for i, t in rows]
    counted = texts if corpus is None else [(i, (t or "").lower().split()) for i, t in corpus]
    for _, w in counted:
        for n in range(1, order + 1):
            counts.update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    total = sum(len(w) for _, w in counted)

    def s(gram):
        if len(gram) == 1:
            return math.log((counts[gram] or alpha) / total)
        if counts[gram] >= least:
            return math.log(counts[gram] / counts[gram[:-1]])
        return math.log(alpha) + s(gram[1:])

    for i, w in texts:
        out.append((i, len(w), sum(s(tuple(w[max(0, k - order + 1) : k + 1])) for k in range(len(w)))))
    return sorted(out, key=lambda x: (str(x[0]), x[1]))


def held(got, want):
    got = sorted((tuple(r) for r in got), key=lambda x: (str(x[0]), x[1], x[2]))
    want = sorted(want, key=lambda x: (str(x[0]), x[1], x[2]))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(g[2] == pytest.approx(w[2], rel=1e-9, abs=1e-9) and (g[3] is None) == (g[1] == 0) for g, w in zip(got, want))


@pytest.mark.parametrize(("order", "least", "chunk"), [(3, 1, 1_000_000), (3, 2, 50), (2, 3, 400), (1, 2, 7), (4, 1, 100), (5, 2, 1000)])
def test_scores_equal_a_plain_version(spark, monkeypatch, order, least, chunk):
    monkeypatch.setattr(lm, "CHUNK", chunk)
    monkeypatch.setattr(lm, "ROWS", 11)
    df = spark.createDataFrame([(*x, 1, 2) for x in corpus()], "doc_id long, text string, chunk int, words int")
    held(lm.score(df, order=order, min_count=least).collect(), brute(corpus(), order, least))
    assert lm.score(df.limit(0)).count() == 0


def test_stored_chunks_are_read_a_few_at_a_time(spark, monkeypatch):
    """A chunk is a row of some MB: no group of rows, which a task holds whole, may have a hundred of them."""
    monkeypatch.setattr(common, "LONG_ROWS", 1 << 20)
    words = spark.range(0, 40, 1, 1).select("id", F.expr("transform(sequence(1, 16), k -> sha2(string(id * 16 + k), 512))").alias("w"))
    rows = words.select(F.expr("cast(array_join(transform(sequence(1, 200), k -> concat_ws('', w)), '') as binary)").alias("words"))
    kept = []
    monkeypatch.setattr(common, "removed", lambda _, path: kept.append(path.removeprefix("file://")))
    with common.Scratch(spark) as s:
        assert s.stored(rows, "chunks", "zstd", long_rows=True).agg(F.sum(F.length("words"))).first()[0] == 40 * 16 * 128 * 200
        lm.score(spark.createDataFrame([(k, f"w{k} " * 90_000) for k in range(6)], "doc_id long, text string").coalesce(1))
    files = [ParquetFile(f).metadata for path in kept for f in Path(path).glob("*.parquet") if "-chunks-" in path]
    groups = [m.row_group(k).total_byte_size for m in files for k in range(m.num_row_groups)]
    # a group ends with the row that fills it; without long_rows each file has one group
    assert len(kept) > 2 and len(groups) >= len(files) + 10 and max(groups) <= 5 << 20


@pytest.mark.parametrize("least", [1, 2])
def test_scores_by_another_corpus(spark, least):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    others = [(1, "the w1 w2 the w1"), (2, None), (3, "w3 the w1 w2 unheard"), (4, "w1 w2")]
    held(lm.score(df, corpus=spark.createDataFrame(others, "doc_id long, text string"), min_count=least).collect(), brute(corpus(), 3, least, corpus=others))


def test_no_key_has_more_than_a_row_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 200)
    rows = [(k, "of the " * 20) for k in range(50)]
    chunks = lm.chunked(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).cache()
    n = chunks.select("chunk").distinct().count()
    per = [lm.exploded(chunks, 3, k).groupBy("gram").count().agg({"count": "max"}).first()[0] or 0 for k in range(lm.PARTS)]
    assert n >= 10 and 0 < max(per) <= n


def test_a_range_of_ngrams_is_one_row_a_chunk(spark):
    """Rows grow with chunks and ranges, not with n-grams; counts go back alone."""
    rows = [(k, " ".join(f"x{k}y{j}" for j in range(900))) for k in range(20)]
    chunks = lm.chunked(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).cache()
    found = [lm.exploded(chunks, 3, k).cache() for k in range(lm.PARTS)]
    n = sum(f.agg({"n": "count"}).first()[0] for f in found)
    assert 0 < n <= 3 * lm.RANGES * chunks.count() < 20 * 900
    assert sum(len(r.grams) for f in found for r in f.collect()) == 8 * 20 * (900 + 899 + 898)
    sums = [r for f in found for r in lm.counted(f).collect()]
    assert len(sums) == n and sum(len(r.n) for r in sums) == 8 * 20 * (900 + 899 + 898)


@pytest.mark.parametrize(("rows", "chunk"), [(1, 1), (50, 300), (2_000_000, 5)])
def test_any_number_of_ranges_gives_the_same(spark, monkeypatch, rows, chunk):
    monkeypatch.setattr(lm, "ROWS", rows)
    monkeypatch.setattr(lm, "CHUNK", chunk)
    monkeypatch.setattr(lm, "RANGES", 1)
    some = corpus()[:9] + [(None, None), (5, "a b a b a"), (5, "a b a b a"), (6, " ")]
    held(lm.score(spark.createDataFrame(some, "doc_id long, text string").coalesce(2)).collect(), brute(some, 3))


def test_best_fit_decreasing_equals_a_plain_search():
    r = random.Random(3)
    for size in (7, 64, 100, 2048):
        lengths = [r.randint(1, size) for _ in range(300)]
        room, want = [], []
        for k in sorted(range(300), key=lambda k: -lengths[k]):
            fit = [x for x in room if x >= lengths[k]]
            if fit:
                room.remove(min(fit))
                room.append(min(fit) - lengths[k])
            else:
                room.append(size - lengths[k])
        got = bfd.best_fit(lengths, size)
        assert sorted(k for w in got for k in w) == list(range(300))
        assert sorted(size - sum(lengths[k] for k in w) for w in got) == sorted(room)


def test_matrices_hold_every_id(spark):
    rows = corpus()
    df = spark.createDataFrame([(*x, "f") for x in rows], "doc_id long, text string, file string")
    e, seen, files = Encoder(), [], {}
    docs: dict = {}
    for r in bfd.write(df, buffer=5000).collect():
        m = files.setdefault(r.file, bfd.load(r.file, r.width))
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 2048 and r.position_resets == r.cu_seqlens[:-1]
        assert (m[r.row, r.n_tokens :] == bfd.PAD).all()
        for d, s, a, z in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            docs.setdefault(d, []).append((s, m[r.row, a:z].tolist()))
    for doc, parts in docs.items():
        want = [e.ids(t).tolist() for i, t in rows if i == doc]
        if len(want) == 1:
            assert sum((x for _, x in sorted(parts)), []) == want[0]
        else:
            assert sorted(x for _, x in parts) == sorted(want)
    assert set(docs) == {i for i, _ in rows} and bfd.write(df.limit(0)).count() == 0
    assert np.dtype(f"<u{2}").itemsize == 2
