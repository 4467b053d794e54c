"""LM scoring (2): stupid-backoff scores from n-gram count tables partitioned by hash, by joins and sums.

score(docs) counts the n-grams (n up to order) of all documents, or of another corpus, and scores every document by them:

1. Each row's words become 64-bit hashes, stored once, in chunks of CHUNK words at most of whole documents, a row each.
2. Chunks are exploded to ranges of n-grams: of each n, the hashes of the n-grams that a chunk holds and how often it does, in order, a
   row (gram, chunk, grams, n) for each range of hashes. So no n-gram, however common, has more than one entry a chunk, and a range
   has one row a chunk; ranges grow with the words, so that one holds some ROWS entries at most, and no key is hot.
3. One shuffle by range serves both sides: in a range, sorted, the n-grams of all chunks make the count table, and are joined to it where
   they lie, so that each gets its count. What goes back to a chunk are the counts alone, in the order of its n-grams.
   This is done for PARTS parts of the hashes in turn, so that the disk holds the n-grams of one part.
4. A chunk and its counts meet in one task (in TURNS turns by chunk), which puts its n-grams in order again, so that counts stand
   beside them, scores place by place and sums per document: a word
   after the longest context of which the n-gram is seen gets log count(n-gram) - log count(context), log BACKOFF for each shorter
   one tried, and a single word log count - log words.

An n-gram is seen from min_count occurrences on (MIN_COUNT 1: whatever occurs); single words always are. Counts are 64 bits and
cover the whole corpus. N-grams are told apart by n and 64-bit hashes: two of m of one n share one with a chance of m / 2**64 each, which
adds their counts; rows are never told apart by hashes.

Cases. Null or word-less text: n_words 0, log_score 0, mean null. Null ids and repeated rows: a row each; repeats count as
often as they occur. A word that the corpus lacks: BACKOFF / words. Empty table: no rows. Very long texts: a chunk of their own, about 100
bytes a word in one task. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import Scratch, over_batches, shuffles_removed, stored

ORDER, MIN_COUNT, BACKOFF = 3, 1, 0.4
#: Words held by a worker's memo, and words of a chunk.
MEMO, CHUNK = 200_000, 500_000
#: There is a range of hashes for so many words of the corpus and the documents; ranges at least.
ROWS, RANGES = 2_000_000, 64
#: Parts of the hashes, and of the chunks, that are done in turn.
PARTS, TURNS = 4, 4
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def words_of(text: str | None, memo: Hashes) -> np.ndarray:
    """Hashes of a text's words, which lie between ASCII white space; A-Z lower-cased."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def grams(h: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 ... order the hashes of the n-grams of words, by their first word's place."""
    out, now = [], np.zeros(len(h), np.uint64)
    for n in range(1, order + 1):
        now = (now[: max(0, len(h) - n + 1)] * M2 + h[n - 1 :] + np.uint64(n)) * M1
        now = now ^ (now >> np.uint64(32))
        out.append(now)
    return out


def held(now: np.ndarray, left: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """n, the places where an n-gram begins that its document holds whole, and their n-grams. left: words from each place to its document's end."""
    for n, g in enumerate(grams(now, order), 1):
        at = np.flatnonzero(left >= n)
        yield n, at, g[at]


def packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Values of 64 bits as bytes, in rows that end at ends. A million numbers pass through Spark as one value, not as a million."""
    offsets = np.append([0], np.asarray(ends) * 8).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The values of all rows of packed()."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    ends = [np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1] for c in chunks]
    return np.concatenate([np.empty(0, np.int64), *(np.frombuffer(c.buffers()[2], np.int64, (z[-1] - z[0]) // 8, z[0]) for c, z in zip(chunks, ends) if z[-1] > z[0])])


def to_end(sizes: np.ndarray) -> np.ndarray:
    """Of words of documents of these sizes, how many there are to the document's end."""
    return np.repeat(np.cumsum(sizes), sizes) - np.arange(sizes.sum())


def chunked(docs: DataFrame) -> DataFrame:
    """chunk, doc_ids, sizes (of documents, in words), words (packed) of docs(doc_id, text), a row for each chunk."""
    schema = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("words", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, size, ids, words = Hashes(), 0, [], []
        chunk = TaskContext.get().partitionId() << 32

        def done() -> pa.RecordBatch:
            all_words = np.concatenate(words)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([chunk], [ids], [[*map(len, words)]]), schema)] + [packed(all_words, [len(all_words)])], schema=schema)

        for b in batches:
            for doc, text in zip(b.column(0), b.column(1)):
                w = words_of(text.as_py(), memo)
                if size and size + len(w) > CHUNK:
                    yield done()
                    chunk, size, ids, words = chunk + 1, 0, [], []
                size += max(1, len(w))
                ids.append(doc.as_py())
                words.append(w)
        if ids:
            yield done()

    return over_batches(docs, work, "chunk long, doc_ids array<long>, sizes array<long>, words binary")


def exploded(chunks: DataFrame, order: int, part: int, ranges: int = RANGES, asks: bool = False) -> DataFrame:
    """gram, chunk, grams, n (both packed): the n-grams of each chunk whose hashes lie in a part of PARTS, and how often each occurs there (0
    if the chunk only asks), a row for each range of hashes that has some. gram: the range's number, over all n."""
    schema = pa.schema([("gram", pa.int64()), ("chunk", pa.int64()), ("grams", pa.binary()), ("n", pa.binary())])
    of, half = np.uint64(ranges), np.uint64(32)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                sizes, words = b.column(1)[k].values.to_numpy(), unpacked(b.column(2)[k : k + 1])
                for n, _, g in held(words.view(np.uint64), to_end(sizes), order):
                    g, times = np.unique(g[(g >> half) * np.uint64(PARTS) >> half == part], return_counts=True)
                    at = ((g >> half) * of >> half).astype(np.int64)
                    ends = np.append(np.flatnonzero(np.diff(at)) + 1, len(at))
                    if len(g):
                        row = pa.array(at[ends - 1] + n * ranges), pa.repeat(b.column(0)[k], len(ends)), packed(g, ends), packed(times * (not asks), ends)
                        yield pa.RecordBatch.from_arrays([*row], schema=schema)

    return chunks.select("chunk", "sizes", "words").mapInArrow(work, "gram long, chunk long, grams binary, n binary")


def counted(rows: DataFrame) -> DataFrame:
    """chunk, gram, n of the rows (gram, chunk, grams, n) that have a chunk; n now over all rows. The sorted n-grams of a range are the count
    table and what is joined to it: a run of an n-gram is summed, and each of its entries gets the sum."""

    def work(t: pa.Table) -> pa.Table:
        g, n = unpacked(t.column("grams")), unpacked(t.column("n"))
        order = np.argsort(g)
        g = g[order]
        first = np.flatnonzero(np.diff(g, prepend=~g[0]))
        n[order] = np.repeat(np.add.reduceat(n[order], first), np.diff(first, append=len(g)))
        sums = packed(n, np.cumsum(pc.binary_length(t.column("n")).to_numpy()) // 8)
        return pa.table({"chunk": t.column("chunk"), "gram": t.column("gram"), "n": sums}).filter(t.column("chunk").is_valid())

    return rows.groupBy("gram").applyInArrow(work, "chunk long, gram long, n binary")


def place_scores(words: np.ndarray, left: np.ndarray, counts: np.ndarray, order: int, total: int, min_count: int, backoff: float) -> np.ndarray:
    """Each word's score after its context. counts: how often the n-grams that words hold occur, by n and hash."""
    score, before, used = np.empty(len(words)), np.empty(0, np.int64), 0
    for n, at, g in held(words, left, order):
        if not len(g):
            break
        by = np.argsort(g)
        first = np.flatnonzero(np.diff(g[by], prepend=~g[by[0]]))
        c = np.zeros(len(words), np.int64)
        c[at[by]] = np.repeat(counts[used : used + len(first)], np.diff(first, append=len(g)))
        used += len(first)
        now = c[at]
        if n == 1:
            score[at] = np.where(now > 0, np.log(np.maximum(now, 1)), math.log(backoff)) - math.log(max(total, 1))
        else:
            longer = np.log(np.maximum(now, 1)) - np.log(np.maximum(before[at], 1))
            score[at + n - 1] = np.where(now >= max(min_count, 1), longer, math.log(backoff) + score[at + n - 1])
        before = c
    if used != len(counts):
        raise ValueError(f"a chunk holds {used} n-grams, and there are counts of {len(counts)}")
    return score


def scored(chunks: DataFrame, counts: DataFrame, order: int, total: int, min_count: int, backoff: float) -> DataFrame:
    """doc_id, n_words, log_score of each document of chunks by counts(chunk, gram, n) of the n-grams that the chunk holds."""

    def work(docs: pa.Table, known: pa.Table) -> pa.Table:
        ids = pa.chunked_array([c.flatten() for c in docs.column("doc_ids").chunks], pa.int64())
        sizes, words = np.concatenate([c.flatten().to_numpy() for c in docs.column("sizes").chunks]), unpacked(docs.column("words"))
        counts = unpacked(known.sort_by("gram").column("n"))
        place = place_scores(words.view(np.uint64), to_end(sizes), counts, order, total, min_count, backoff)
        sums, some = np.zeros(len(sizes)), sizes > 0
        if some.any():
            sums[some] = np.add.reduceat(place, (np.cumsum(sizes) - sizes)[some])
        return pa.table({"doc_id": ids, "n_words": pa.array(sizes), "log_score": pa.array(sums)})

    return chunks.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(work, "doc_id long, n_words long, log_score double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, min_count: int = MIN_COUNT, backoff: float = BACKOFF, corpus: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, log_score (sum of natural logs), mean_log_score per row of docs, by the counts of corpus (docs without)."""
    text, words = F.col(text_col).cast("string").alias("text"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))
    with shuffles_removed(docs.sparkSession), Scratch(docs.sparkSession) as s:
        chunks = s.stored(chunked(docs.select(F.col(id_col).cast("long").alias("doc_id"), text)), "chunks", "zstd", long_rows=True)
        source = chunks if corpus is None else s.stored(chunked(corpus.select(F.lit(None).cast("long").alias("doc_id"), text)), "corpus", "zstd", long_rows=True)
        total, counts = source.agg(words).first()[0] or 0, None
        ranges = max(RANGES, math.ceil((total if corpus is None else total + (chunks.agg(words).first()[0] or 0)) / ROWS))
        for part in range(PARTS):
            rows = exploded(chunks, order, part, ranges, asks=corpus is not None)
            if corpus is not None:
                rows = rows.unionByName(exploded(source, order, part, ranges).withColumn("chunk", F.lit(None).cast("long")))
            found = s.stored(counted(rows), "counts", "zstd", long_rows=True)
            counts = found if counts is None else counts.unionByName(found)
        out = None
        for part in range(TURNS):
            mine = F.pmod(F.xxhash64("chunk"), F.lit(TURNS)) == part
            rows = stored(scored(chunks.where(mine), counts.where(mine), order, total, min_count, backoff), "scored")
            out = rows if out is None else out.unionByName(rows)
    return out.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
