"""Phrase collocation mining (13): PrefixSpan-style contiguous pattern growth, one distributed task per prefix.

mined(docs) returns the best phrases of each language: lang, rank, phrase, a, l, r, n, score.

1. Words of each language are counted. Words of MIN_COUNT occurrences or more are the frequent prefixes.
2. Projection: every occurrence of a word in a piece of text becomes a pointer to the words after it there (longest - 1 at most, ending
   where the piece does). Pointers to equal words are one row with a weight within a task, so copies and common phrases shrink
   before anything is shuffled. The frequent words are broadcast if they are HEADS at most; a piece ends at any other word, as no frequent
   phrase holds it, and pointers hold numbers. Tasks find a word's number by a hash of 64 bits, of a seed by which no two words of the corpus share one. Of more words the pointers hold the words themselves, and prefixes are done in TURNS turns by a
   hash. Each turn has one shuffle, whose files go with it.
3. One task per prefix gets the pointers of that prefix and extends it to the right: its pointers, in order, are parted by their next
   word, the phrases that are frequent are kept, and it goes on from them with their own pointers alone.
   A prefix of more than POINTERS occurrences (or a HEADSth of all, so that hot ones are few) has several tasks, dealt by a hash of the words pointed to: whole phrases of the
   greatest length meet in one of them, shorter ones are summed over the tasks before they are held against MIN_COUNT.
4. Candidates are cut at every place and joined to the counts of both parts; the cut with the lowest score counts. Those that lie in a
   longer candidate with a share of SHARE percent of their occurrences or more go. Each language's best are chosen in two steps, so
   that no task sorts a language.

Counts and totals are over all documents, as longs; the score's products are decimals of 38 digits (exact to 5e15 occurrences).
Phrases are keyed by their text, so no two share a key. Joins on parts take hot parts out (see common.lookup).

Cases. Null or empty text: no words. Null lang: `und`, with rows that say `und`. Null ids and repeated rows: every row counts. Ties: by
a, then by phrase; of cuts, the first. Very long texts: read in one task, a whole text's pointers summed at once. A language
without candidates has no row. Empty table: no rows. Other columns are not read; lang and text may have any other names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import Scratch, long_batches, lookup, over_batches, shuffles_removed, stored

MIN_COUNT, LONGEST, SHARE, BEST = 10, 3, 50, 2000
#: Occurrences of a prefix that one task takes; distinct words, and words in texts, that a task sums before it hands them on.
POINTERS, DISTINCT, CHUNK = 200_000, 300_000, 1_500_000
#: Frequent words that are broadcast (some 30 bytes each), and hot ones at most: those with more than POINTERS and than a HEADSth of all occurrences.
HEADS = 4_000_000
#: Prefixes of words that are not broadcast are done in so many turns, by a hash, so that the disk holds the pointers of one.
TURNS = 2
#: Odd numbers that mix the words of a pointer.
MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Rows of whole prefixes that a task grows at once.
RUN = 200_000
#: A language's phrases are ranked in so many parts first.
PARTS = 64
BREAKS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, with an empty word at the end of each piece."""
    out: list[bytes] = []
    for piece in text.encode("utf-8", "replace").lower().translate(BREAKS).split(b"\n") if text else ():
        if found := piece.split():
            out += found
            out.append(b"")
    return out


def _after(longest: int) -> list[str]:
    """Names of the columns of the words after a prefix."""
    return [f"next{k}" for k in range(1, longest)]


class Seen(dict):
    """Numbers of words as they come; of the end of a piece, with which it begins, -1."""

    def __init__(self):
        self[b""] = -1

    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self) - 1
        return got


def hashed(seed: int) -> Column:
    """Hash of a phrase of a lang, by a seed."""
    return F.xxhash64(F.concat(F.lit(f"{seed} "), "lang"), "phrase")


@dataclass
class Known:
    """The frequent words, by number: their hashes in order and the seed of these, lang, word and, of hot ones, how many parts there are (else 0)."""

    hashes: np.ndarray
    seed: int
    langs: pa.Array
    words: pa.Array
    parts: np.ndarray

    def numbers(self, lang: str, words: Iterable[bytes]) -> np.ndarray:
        """Numbers of words of a lang, -1 for what is not frequent; hashes as in hashed()."""
        seed = xxhash.xxh64_intdigest(f"{self.seed} {lang}".encode(), 42)
        h = np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64).view(np.int64)
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, phrase, n: words and how often they occur, summed over what a task has at hand."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])

    def flushed(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, found in held.items():
            found.pop(b"", None)
            rows = [*found.items()]
            for at in range(0, len(rows), 50_000):
                words, n = zip(*rows[at : at + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], schema=schema)
        held.clear()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0), b.column(1)):
                held.setdefault(lang.as_py(), Counter()).update(words_of(text.as_py()))
                if sum(map(len, held.values())) > DISTINCT:
                    yield from flushed(held)
        yield from flushed(held)

    return over_batches(docs, work, "lang string, phrase string, n long")


def in_order(columns: list[np.ndarray]) -> np.ndarray:
    """Order of rows by columns of numbers from -1 on."""
    bits = [int(c.max(initial=0) + 1).bit_length() for c in columns]
    if sum(bits) > 63:
        return np.lexsort(columns[::-1])
    key = np.zeros(len(columns[0]), np.int64)
    for c, b in zip(columns, bits):
        key = key << b | c + 1
    return np.argsort(key)


def starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where rows in order differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def distinct_pointers(words: np.ndarray, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The words of each place that another follows and the words after it (-1 from the end of its piece on), each different row once, and how often."""
    columns = [words[:-1], words[1:], *(np.append(words[k:], np.full(min(k - 1, len(words) - 1), -1)) for k in range(2, width))]
    some = (columns[0] >= 0) & (columns[1] >= 0)
    columns = [c[: len(some)][some] for c in columns]
    for k in range(2, width):
        columns[k][columns[k - 1] < 0] = -1
    by = in_order(columns)
    columns = [c[by] for c in columns]
    first = np.flatnonzero(starts(columns))
    return [c[first] for c in columns], np.diff(first, append=len(by))


def pointers(docs: DataFrame, width: int, known: Broadcast | None = None, turn: int = 0) -> DataFrame:
    """Occurrences n of words (prefix) with the words after them in their piece (next1 ..., width - 1 at most), summed over what a task has at
    hand; those that a word follows. With known frequent words: numbers (-1 for none), all others end a piece; and salt, which part of a hot
    prefix a pointer belongs to (else -1). Without: lang, and words (null for none) of a turn."""
    names = ["prefix", *_after(width)]
    schema = pa.schema([*((c, pa.int64()) for c in names), ("salt", pa.int64()), ("n", pa.int64())] if known else [*((c, pa.string()) for c in ("lang", *names)), ("n", pa.int64())])

    def flushed(held: dict[str, list[np.ndarray]], seen: dict[str, Seen]) -> Iterator[pa.RecordBatch]:
        for lang, words in held.items():
            vocabulary, words = [*seen[lang]][1:], np.concatenate(words)
            if known:
                words = np.append(known.value.numbers(lang, vocabulary), -1)[words]
            columns, n = distinct_pointers(words, width)
            if known:
                parts, mixed = known.value.parts[columns[0]], np.zeros(len(n), np.uint64)
                for c in columns[1:]:
                    mixed = (mixed ^ c.view(np.uint64)) * MIX
                    mixed = (mixed ^ mixed >> np.uint64(32)) * MIX2
                salt = (mixed >> np.uint64(32)).astype(np.int64) % np.maximum(parts, 1)
                rows = [*columns, np.where(parts > 0, salt, -1), n]
            else:
                every = pa.array(vocabulary, pa.binary()).cast(pa.string())
                mine = np.array([crc32(w) % TURNS == turn for w in vocabulary], bool)[columns[0]]
                rows = [every.take(pa.array(c[mine], mask=c[mine] < 0)) for c in columns] + [n[mine]]
                rows = [pa.repeat(pa.scalar(lang), len(rows[0])), *rows]
            for at in range(0, len(rows[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(r[at : at + 50_000]) for r in rows], schema=schema)
        held.clear()
        seen.clear()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        seen: dict[str, Seen] = {}
        size = 0
        for b in batches:
            for lang, text in zip(b.column(0), b.column(1)):
                if w := words_of(text.as_py()):
                    lang = lang.as_py()
                    codes = seen.setdefault(lang, Seen())
                    held.setdefault(lang, []).append(np.fromiter(map(codes.__getitem__, w), np.int64, len(w)))
                    size += len(w)
                    if size > CHUNK:
                        yield from flushed(held, seen)
                        size = 0
        yield from flushed(held, seen)

    return over_batches(docs, work, ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in schema))


def grow(prefixes: list[np.ndarray], after: list[np.ndarray], weights: np.ndarray, shared: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Extensions to the right of whole prefixes, by length: a row of each phrase, how many words it has after the prefix, its count.
    prefixes: numbers that tell prefixes apart, by pointer; after: by distance, the codes of the words that follow (-1 for none); weights: how
    often. shared: other tasks hold pointers of the prefix too, so only its phrases of full length are whole."""
    at = in_order([*prefixes, *after])
    new = starts([c[at] for c in prefixes])
    for depth, codes in enumerate(after):
        if not len(at):
            return
        word = codes[at]
        new[1:] |= word[1:] != word[:-1]
        first = np.flatnonzero(new)
        sums = np.add.reduceat(weights[at], first)
        need = least if depth + 1 == len(after) else np.where(shared[at[first]], 1, least)
        keep = (sums >= need) & (word[first] >= 0)
        yield at[first[keep]], depth + 1, sums[keep]
        mine = np.repeat(keep, np.diff(first, append=len(at)))
        at, new = at[mine], new[mine]


def grown(dealt: DataFrame, least: int, longest: int, known: Broadcast | None = None) -> DataFrame:
    """lang, phrase, n from the pointers of whole prefixes (lang unless known, prefix, salt, next1 ..., n); salt: which part of a hot prefix, -1
    of others. Rows are sorted by a hash of (lang, prefix, salt), prefixes that share one are told apart."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])
    names, key = _after(longest), ("prefix", "salt") if known else ("lang", "prefix", "salt")

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Phrases of a table of whole groups."""
        n, salt = len(t), t.column("salt").to_numpy()
        if known:
            prefix, *after = (t.column(c).to_numpy() for c in ("prefix", *names))
            langs, of, every = known.value.langs, prefix, known.value.words
        else:
            words = pa.chunked_array([c for x in ("prefix", *names) for c in t.column(x).chunks], pa.string()).combine_chunks().dictionary_encode()
            codes = words.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            prefix, *after = (codes[k * n : (k + 1) * n] for k in range(longest))
            lang = t.column("lang").combine_chunks().dictionary_encode()
            langs, of, every = lang.dictionary, lang.indices.to_numpy().astype(np.int64), words.dictionary
        groups = [prefix, salt] if known else [of, prefix, salt]
        for rows, depth, times in grow(groups, after, t.column("n").to_numpy(), salt >= 0, least):
            if len(rows):
                phrase = pc.binary_join_element_wise(*(every.take(pa.array(c[rows])) for c in (prefix, *after[:depth])), " ")
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(of[rows])).cast(pa.string()), phrase, pa.array(times)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if size >= RUN and (whole := np.flatnonzero(np.diff(b.column("h").to_numpy(), prepend=held[-1].column("h")[-1].as_py()))).size:
                cut = int(whole[0])
                yield from run(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held, size, b = [], 0, b.slice(cut)
            held.append(b)
            size += len(b)
        if held:
            yield from run(pa.Table.from_batches(held))

    dealt = dealt.select(*key, *names, "n").repartition(*key)
    together = dealt.select(F.xxhash64(*key).alias("h"), *key, *names, "n").sortWithinPartitions("h")
    return together.mapInArrow(work, "lang string, phrase string, n long")


def numbered(words: DataFrame, least: int, most: int) -> Broadcast | None:
    """The frequent of all words for all tasks, those of more than most occurrences as hot; None if they are more than HEADS."""
    frequent = words.where(F.col("n") >= least)
    if frequent.limit(HEADS + 1).count() > HEADS:
        return None
    seed = 0
    while words.groupBy(hashed(seed).alias("h")).count().where("count > 1").limit(1).count():  # other words must not pass for frequent ones
        seed += 1
    found = frequent.select(hashed(seed).alias("h"), "lang", "phrase", "n").toArrow().sort_by("h").combine_chunks()
    h, langs, names, n = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in found.columns)
    n = n.to_numpy()
    known = Known(h.to_numpy(), seed, langs.cast(pa.string()).dictionary_encode(), names.cast(pa.string()), np.where(n > most, -(-n // most), 0))
    return words.sparkSession.sparkContext.broadcast(known)


def phrases(docs: DataFrame, s: Scratch, least: int, longest: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored in s: frequent words (lang, phrase, n), frequent phrases of 2 to longest words (the same), words of each lang (lang, words)."""
    words = s.stored(word_counts(docs).groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "words")
    totals = s.stored(words.groupBy("lang").agg(F.sum("n").alias("words")), "totals")
    frequent = s.stored(words.where(F.col("n") >= least), "frequent")
    total = totals.agg(F.sum("words")).first()[0] or 0
    most = max(POINTERS, total // HEADS)
    known, found = numbered(words, least, most), None
    hot = frequent.where(F.col("n") > most).select("lang", F.col("phrase").alias("prefix"), F.ceil(F.col("n") / most).cast("long").alias("of"))
    for turn in range(1 if known else TURNS):
        dealt = pointers(docs, longest, known, turn)
        if not known:
            salt = F.coalesce(F.pmod(F.xxhash64(*_after(longest)), "of"), F.lit(-1).cast("long"))
            dealt = dealt.join(F.broadcast(hot), ["lang", "prefix"], "left").withColumn("salt", salt)
        with long_batches(docs.sparkSession):
            mine = s.stored(grown(dealt, least, longest, known).groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrases")
        found = mine if found is None else found.unionByName(mine)
    return frequent, found, totals


def scored(found: DataFrame, frequent: DataFrame, s: Scratch) -> DataFrame:
    """lang, phrase, a, l, r, score of every phrase, by its lowest cut."""
    counts = frequent.unionByName(found).select(F.struct("lang", F.col("phrase").alias("part")).alias("key"), F.col("n").alias("of"))
    w, k = F.split("phrase", " "), F.col("k")
    cuts = found.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size(w) - 1)).alias("k"))
    left, right = F.array_join(F.slice(w, F.lit(1), k), " "), F.array_join(F.slice(w, k + 1, F.size(w)), " ")
    rows = s.stored(cuts.withColumns({"left": F.struct("lang", left.alias("part")), "right": F.struct("lang", right.alias("part"))}), "cuts")
    for side, name in (("left", "l"), ("right", "r")):
        # every part is frequent, as the phrase is
        parts = s.stored(rows.groupBy(F.col(side).alias("key")).agg(F.count("*").alias("times")).join(counts, "key"), side)
        rows = s.stored(lookup(rows.withColumnRenamed(side, "key"), parts, "key", "times").drop("key", "times").withColumnRenamed("of", name), name)
    whole = "cast({0} AS decimal(19, 0))"
    score = F.expr(f"(1000000 * {whole.format('a')} * {whole.format('a')}) div ({whole.format('l')} * {whole.format('r')})")
    best = rows.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def independent(rows: DataFrame, found: DataFrame, share: int) -> DataFrame:
    """Rows whose words don't lie in a longer phrase of found with share percent of their occurrences or more."""
    w, at = F.split("phrase", " "), F.sequence(F.lit(1), F.size(F.split("phrase", " ")))
    within = F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.size(w) - i + 1), lambda m: F.when((m > 1) & (m < F.size(w)), F.array_join(F.slice(w, i, m), " "))))
    longer = found.select("lang", F.explode(F.array_compact(F.flatten(within))).alias("phrase"), F.col("n").alias("in")).groupBy("lang", "phrase").agg(F.max("in").alias("in"))
    return rows.join(longer, ["lang", "phrase"], "left").where(F.col("in").isNull() | (F.col("in") * 100 < F.col("a") * share)).drop("in")


def best(rows: DataFrame, n: int) -> DataFrame:
    """Each lang's first n with their rank: the first n of each of its parts, of these the first n."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    first = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= n)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= n).drop("part")


def mined(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", least: int = MIN_COUNT, longest: int = LONGEST, share: int = SHARE, n: int | None = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's first n phrases of 2 to longest words (all, without rank, if n is None)."""
    lang = F.lit("und") if lang_col is None else F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    docs = docs.select(lang.alias("lang"), F.col(text_col).cast("string").alias("text"))
    with shuffles_removed(docs.sparkSession), Scratch(docs.sparkSession) as s:
        frequent, found, totals = phrases(docs, s, least, longest)
        rows = independent(scored(found, frequent, s), found, share)
        rows = rows if n is None else best(rows, n)
        columns = ["lang", *(["rank"] if n is not None else []), "phrase", "a", "l", "r", F.col("words").alias("n"), "score"]
        return stored(lookup(rows, totals, "lang", "words").select(*columns), "collocations")
