import random

import numpy as np
from pyspark.sql import functions as F

from glyphmill.llm import packing
from glyphmill.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, start string, offset string"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", None) for i, t in rows], SCHEMA)


def test_ids_equal_the_tokenizers():
    e, r = Encoder(), random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèêçñóáÉÑİŁſ0123456789'’.,;:!?-_()<>|@#×÷ªºς²½ ,\t\n\x01 中あ😀"
    for _ in range(3000):
        s = "".join(r.choice(letters) for _ in range(r.randint(0, 20)))
        assert e.ids(s).tolist() == [*e.tokenizer.encode(s, add_special_tokens=False).ids, 1], repr(s)


def test_best_level_is_the_least_sum_of_squares():
    r, p = random.Random(1), packing.SumOfSquares(64)
    for k in range(500):
        n = r.randint(1, 64)
        if n < 64:
            costs = {}
            for h in range(0, 64 - n + 1):
                if h == 0 or p.count[h]:
                    c = p.count.copy()
                    c[h] -= h > 0
                    if h + n < 64:
                        c[h + n] += 1
                    costs[h] = int((c[1:64] ** 2).sum())
            assert costs[p.best(n)] == min(costs.values())
        p.place((k, 0, np.zeros(n, "<u4"), n))


def test_round_trip_and_cases(spark):
    r = random.Random(2)
    rows = [(k, " ".join(r.choice(["alpha", "beta,", "GAMMA.", "x1"]) for _ in range(r.choice([1, 5, 90, 700, 3000])))) for k in range(60)]
    rows += [(100, None), (101, ""), (None, "no id"), (7, "again"), (7, "again")]
    got = packing.pack(rows_of(spark, rows)).collect()
    e = Encoder()
    want = sorted(e.ids(t).tobytes() for _, t in rows)
    docs, at = {}, {}
    for x in sorted(got, key=lambda x: (x.sequence_id, x.offset)):
        assert x.offset == at.get(x.sequence_id, 0) and x.length == len(x.ids) // 4 > 0
        at[x.sequence_id] = x.offset + x.length
        docs.setdefault((x.doc_id, x.doc_tokens), []).append((x.start, bytes(x.ids)))
    assert max(at.values()) <= 2048
    rebuilt = []
    for (doc, n), pieces in docs.items():
        if doc == 7 and len(pieces) > 1 and all(s == 0 for s, _ in pieces):
            rebuilt += [b for _, b in pieces]
            continue
        rebuilt.append(b"".join(b for _, b in sorted(pieces)))
        assert len(rebuilt[-1]) == 4 * n
    assert sorted(rebuilt) == want
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in at.values())
    assert padding == 0


def test_empty_table_and_checksums(spark):
    assert packing.pack(rows_of(spark, [])).count() == 0
    d = packing.digests(packing.pack(rows_of(spark, [(1, "a b")])))
    import zlib

    ids = Encoder().ids("a b")  # three ids: a sequence of two, and one
    assert {r.ids_crc32 for r in d.collect()} == {zlib.crc32(ids[:2].tobytes()), zlib.crc32(ids[2:].tobytes())}
    assert d.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert d.where(F.col("length") < 1).count() == 0
