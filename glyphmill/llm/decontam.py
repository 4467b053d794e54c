"""Benchmark decontamination (6): CGK random-walk embedding and bit-sampling LSH over item-sized windows, then exact
edit verification.

matches(docs, items) returns one row per place, adjacent ones included, where a document holds an item: doc_id, item_id, distance, similarity,
end_word, item_words. Words are split at ASCII white space and A-Z lower-cased; an item of n words is held where some
stretch of the document is within d = floor((1 - similarity) * n) word edits (similarity: at least 0.8).

1. Windows start at every word. By the q-gram lemma a window of n words within d edits keeps n - 1 - 2d of the item's
   word pairs (and of its different pairs all but 2d), so windows with fewer pairs of items of that length hold none;
   the others are embedded.
2. The CGK walk of repetition t copies the window's word at the walk's pointer to each of 3n places and moves the pointer by a
   random bit of (t, place, word). Windows near in edit distance then agree in most places.
3. Each repetition samples BITS places; windows and items with equal samples are candidates. REPEATS repetitions reach
   the target recall (measured in the tests against brute force, at least 0.9; exact copies always meet).
4. Candidates are verified exactly by Myers' bit-parallel semi-global edit distance over the stretch around the windows.

Items are a stated query set: they are taken in blocks of at most BLOCK_WORDS words, each of which scans the corpus once
and travels to the tasks. Documents are never shuffled. Memory per task is one document's words and one block.

Items too short for an edit (fewer than five words at 0.8) have no windows to embed: they are found where their words
stand, by a table of first words. A worker makes the index of a block once.

Cases. Null or empty texts hold nothing, and items without words are held nowhere. Null doc_id: reported with a null doc_id. Repeated rows: a row each. Null item_id: a null item_id.
Empty tables: no rows. Very long texts: scanned whole in one task, window by window. Ties: each place that an item matches is told.
Other columns are not read.
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import over_batches, small_batches

SIMILARITY, REPEATS, BITS, BLOCK_WORDS, SEED = 0.8, 48, 4, 2_000_000, 17
TABLE_BITS = 22


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def embedded(x: np.ndarray, starts: np.ndarray, n: int, repeats: int = REPEATS, bits: int = BITS) -> np.ndarray:
    """Keys (windows x repeats, at most 64) of the windows of n word ids that begin at starts in x: the sampled places of each
    walk, as one hash. Bit t of a hash of (place, word) is the coin of repetition t."""
    r, t = np.random.default_rng([SEED, n]), np.arange(repeats, dtype=np.uint64)[None, :]
    sampled: list[list[int]] = [[] for _ in range(3 * n)]
    for k in range(repeats):
        for place in r.choice(3 * n, min(bits, 3 * n), replace=False):
            sampled[place].append(k)
    x = np.concatenate([x, np.zeros(n + 1, x.dtype)]).astype(np.uint64)
    at = np.repeat(starts.astype(np.int64)[:, None], repeats, axis=1)
    end = starts.astype(np.int64)[:, None] + n
    seen, filled = np.zeros((*at.shape, bits), np.uint64), [0] * repeats
    for place, cols in enumerate(sampled):
        if cols:
            p = at[:, cols]
            seen[:, cols, [filled[k] for k in cols]] = np.where(p < end, x[p], np.uint64(0))
            for k in cols:
                filled[k] += 1
        coins = mixed(x + np.uint64((place + 1) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF))
        at += ((coins.take(at) >> t) & np.uint64(1)).view(np.int64)
        np.minimum(at, end, out=at)
    key = np.zeros((len(starts), repeats), np.uint64)
    for k in range(bits):
        key = mixed(key ^ seen[:, :, k]) + np.uint64(k + 1)
    return key


def edit_scores(item: np.ndarray, stretch: np.ndarray) -> list[int]:
    """Least edits between the item and any part of the stretch that ends at each place, from place 0 (an empty part)."""
    n = len(item)
    peq: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        peq[w] = peq.get(w, 0) | (1 << k)
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score, scores = full, 0, n, [n]
    for w in stretch.tolist():
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        scores.append(score)
    return scores


def edit_distance(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int]:
    """Least edits between the item and any part of the stretch, and the (first) end of such a part."""
    scores = edit_scores(item, stretch)
    return min(scores), scores.index(min(scores))


def places(item: np.ndarray, stretch: np.ndarray, d: int) -> list[tuple[int, int]]:
    """(edits, end) of each place of the item within d edits, in order. The best ends are taken first; ends nearer to one taken than
    the shortest place is long (n - d words) belong to it."""
    taken: list[int] = []
    scores = edit_scores(item, stretch)
    for end in sorted((j for j, x in enumerate(scores) if x <= d), key=lambda j: (scores[j], j)):
        k = bisect.bisect(taken, end)
        if all(abs(end - taken[j]) >= len(item) - d for j in (k - 1, k) if 0 <= j < len(taken)):
            taken.insert(k, end)
    return [(scores[j], j) for j in taken]


class Index:
    """Items of one block: word ids, pairs by item length, and hash tables by length and repetition."""

    def __init__(self, items: list[tuple[int | None, str]], similarity: float = SIMILARITY, repeats: int = REPEATS, bits: int = BITS):
        self.vocabulary: dict[bytes, int] = {}
        self.repeats, self.bits = repeats, bits
        self.items, self.ids, self.edits, self.least = [], [], {}, {}
        by_length: dict[int, list[int]] = {}
        self.short: dict[int, dict[tuple[int, ...], list[int]]] = {}
        for item_id, text in items:
            w = words_of(text)
            if not w:
                continue
            x = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w]
            if int((1 - similarity) * len(w) + 1e-9):
                by_length.setdefault(len(w), []).append(len(self.items))
            else:
                self.short.setdefault(x[0], {}).setdefault(tuple(x), []).append(len(self.items))
            self.ids.append(item_id)
            self.items.append(np.array(x, np.int64))
        self.begins = np.zeros(len(self.vocabulary) + 1, bool)  # whether a short item begins with the word
        self.begins[list(self.short)] = True
        self.pairs: dict[int, list[int]] = {}
        self.maybe = np.zeros(1 << TABLE_BITS, bool)
        self.tables: dict[int, list[dict[int, list[int]]]] = {}
        for n, ks in by_length.items():
            d = self.edits[n] = int((1 - similarity) * n + 1e-9)
            # pairs that differ: an item that repeats some has fewer to keep
            self.least[n] = min(len(set(zip(self.items[k][:-1].tolist(), self.items[k][1:].tolist()))) for k in ks) - 2 * d
            for k in ks:
                x = self.items[k]
                for pair in set(((x[:-1] << 32) | x[1:]).tolist()):
                    known = self.pairs.setdefault(pair, [])
                    if not known or known[-1] != n:
                        known.append(n)
            keys = embedded(np.concatenate([self.items[k] for k in ks]), np.arange(len(ks)) * n, n, repeats, bits)
            tables = self.tables[n] = [{} for _ in range(repeats)]
            for row, k in zip(keys.tolist(), ks):
                for t, key in enumerate(row):
                    tables[t].setdefault(key, []).append(k)
        if self.pairs:
            self.maybe[self._slot(np.array(list(self.pairs), np.int64))] = True

    @staticmethod
    def _slot(pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def _exact(self, x: np.ndarray) -> Iterator[tuple[int | None, int, int, int]]:
        """The places of short items; of places that overlap the first."""
        free: dict[int, int] = {}
        for at in np.flatnonzero(self.begins[x]).tolist():
            for item, ks in self.short[int(x[at])].items():
                n = len(item)
                if tuple(x[at : at + n].tolist()) == item:
                    for k in ks:
                        if at >= free.get(k, 0):
                            free[k] = at + n
                            yield self.ids[k], 0, at + n, n

    def find(self, text: str | None) -> list[tuple[int | None, int, int, int]]:
        """(item_id, distance, end word, item words) of each place."""
        words = words_of(text)
        if not words or not self.items:
            return []
        get = self.vocabulary.get
        x = np.array([get(w, 0) for w in words], np.int64)
        out = list(self._exact(x))
        pairs = (x[:-1] << 32) | x[1:]
        where = np.flatnonzero((x[:-1] > 0) & (x[1:] > 0))
        where = where[self.maybe[self._slot(pairs[where])]]
        hits: dict[int, list[int]] = {}
        known = self.pairs.get
        for p, pair in zip(where.tolist(), pairs[where].tolist()):
            for n in known(pair, ()):
                hits.setdefault(n, []).append(p)
        for n, at in hits.items():
            d = self.edits[n]
            least = n - 1 - 2 * d
            if len(at) < least:
                continue
            a = np.array(at)
            first, last = a[: len(a) - least + 1], a[least - 1 :]
            ok = last - first <= n - 2
            if not ok.any():
                continue
            # windows that hold these pairs, from the last pair's reach to the first pair
            lo, hi = np.maximum(last[ok] - (n - 2), 0), np.minimum(first[ok], max(0, len(x) - n + d))
            mark = np.zeros(len(x) + 2, np.int64)
            np.add.at(mark, lo, 1)
            np.add.at(mark, np.maximum(hi, lo) + 1, -1)
            starts = np.flatnonzero(np.cumsum(mark) > 0)
            found: dict[int, list[int]] = {}
            gaps = np.flatnonzero(np.diff(starts) > n) + 1
            runs = [s for s in np.split(starts, gaps) if len(np.unique(pairs[a[np.searchsorted(a, s[0]) : np.searchsorted(a, s[-1] + n)]])) >= self.least[n]]
            for s in (run[b : b + 512] for run in runs for b in range(0, len(run), 512)):
                keys = embedded(x[s[0] : s[-1] + n], s - s[0], n, self.repeats, self.bits)
                for t, table in enumerate(self.tables[n]):
                    for start, key in zip(s.tolist(), keys[:, t].tolist()):
                        for k in table.get(key, ()):
                            found.setdefault(k, []).append(start)
            for k, ss in found.items():
                ss = sorted(set(ss))
                groups = [[ss[0], ss[0]]]
                for s in ss[1:]:
                    if s <= groups[-1][1] + n:
                        groups[-1][1] = s
                    else:
                        groups.append([s, s])
                for a0, z0 in groups:
                    begin = max(0, a0 - d)
                    for dist, end in places(self.items[k], x[begin : z0 + n + d], d):
                        out.append((self.ids[k], dist, begin + end, n))
        return out


def blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of at most block_words words (or one item)."""
    held, size = [], 0
    for r in items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").toLocalIterator():
        n = len(words_of(r.t))
        if held and size + n > block_words:
            yield held
            held, size = [], 0
        held.append((r.i, r.t))
        size += n
    if held:
        yield held


_index: dict[str, Index] = {}


def index_of(shared: Broadcast, similarity: float) -> Index:
    """The index of a broadcast (name, block): a worker keeps the last one."""
    name, block = shared.value
    key = f"{name} {similarity}"
    if key not in _index:
        _index.clear()
        _index[key] = Index(block, similarity)
    return _index[key]


SCHEMA = "doc_id long, item_id long, distance int, similarity double, end_word int, item_words int"


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per place of an item in a document."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("similarity", pa.float64()), ("end_word", pa.int32()), ("item_words", pa.int32())])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    out = spark.createDataFrame([], SCHEMA)
    for block in blocks(items, item_col, item_text_col, block_words):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = index_of(shared, similarity)
            for b in batches:
                found = [(doc, i, d, 1 - d / n, e, n) for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, d, e, n in index.find(text)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

        part = over_batches(rows, work, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def holder(shared: Broadcast, similarity: float) -> Callable[[Column], Column]:
    """Whether a text holds an item of a broadcast block; the index is made once a task."""

    @F.pandas_udf("boolean")
    def holds(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = index_of(shared, similarity)
        for texts in parts:
            yield pd.Series([bool(index.find(t)) for t in texts], dtype=bool)

    return holds


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs whose own text holds no item, all columns, by one filter a block of items: nothing is joined or
    shuffled, and ids, null or repeated, play no part."""
    spark = docs.sparkSession
    small_batches(spark)
    for block in blocks(items, item_col, item_text_col, block_words):
        holds = holder(spark.sparkContext.broadcast((uuid.uuid4().hex, block)), similarity)
        docs = docs.where(~holds(F.col(text_col).cast("string")))
    return docs
