"""MinHash near-dedup (10): universal hash minima with banding, signature verification, exact confirmation, and
connected components by alternating large-star and small-star.

components(docs) returns one row per document row: doc_id, n_shingles, component_id, kept.

1. Each text becomes the set of its word shingles (64-bit hashes) and, in the same pass, a signature of HASHES minima of
   universal functions (a*x + b, upper bits). Equal sets form a class at once, by a digest: copies meet only in a
   partial aggregation and are never compared.
2. Classes are dealt to buckets by BANDS bands of ROWS minima. A pair at the threshold 0.85 shares no band with
   probability (1 - 0.85**5)**32 < 1e-8.
3. Pairs within a bucket are not enumerated. Each bucket gets a hub, the member that meets most others over all its
   buckets, and every member is compared with the hubs of its buckets. In a group of copies around one original, the
   original is the hub, so a group of m costs m comparisons.
4. Signatures are verified first (agreement of at least the threshold less SLACK, over six standard deviations), then the full
   sets, re-read for the candidates alone.
5. Components of these links; then what shares a bucket but not a component is compared too, so a link that no hub showed
   is found: pair by pair in buckets of up to SMALL members; larger ones are split into blocks of about BLOCK_ITEMS
   shingles, and each task compares the full sets of two blocks bit-parallel and emits at most one link per member.
   Components again.

Only a bucket whose members are alike but unlinked makes step 5 long; nothing is capped. Rows of a bucket, or of a vertex of many
links, are never brought into one task: what is known of a hot key is broadcast to them. All tables on the way are removed
when the result, three numbers a row, has been stored.

Cases. Null or word-less text: n_shingles 0, linked with nothing. Very long texts: a set is made and compared in one task, about 40 bytes
a word. Ties: of classes that meet as many others, the hub is the one with the greatest digest; no link hangs on it. Null doc_id: component_id null, kept true. Repeated
rows: one row out for each, equal values. Rows with words that share a doc_id are one vertex, whatever their sets. Empty
table: no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import BROADCAST_ROWS, HOT_ROWS, Scratch, lookup, over_batches, stored, with_ids

BANDS, ROWS, SLACK = 32, 5, 0.25
HASHES = BANDS * ROWS
SEED = 20240229
#: Words held by a worker's memo of hashes; it starts anew when full.
MEMO = 200_000
#: Buckets beyond SMALL members are compared in blocks of about BLOCK_ITEMS shingles and BLOCK_MEMBERS members; a task holds a bit a
#: member and shingle of two blocks, 100 MB at most.
SMALL, BLOCK_ITEMS, BLOCK_MEMBERS = 16, 400_000, 1024
#: Hot classes of candidate pairs, and bytes of sets and signatures of them that are broadcast.
HOT_CLASSES, HOT_BYTES = 10_000, 64 << 20
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class Words(dict):
    """Hashes of words, by word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * MIX[0]
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: Words, width: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: words without ASCII white space, A-Z lower-cased."""
    found = text.encode("utf-8", "replace").lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    k = min(width, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k))
    for j in range(k):
        out = mixed(out * MIX[1] + h[j : len(h) - k + 1 + j])
    return np.unique(out)


def functions(n: int = HASHES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)


def signature(items: np.ndarray, fs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Minima of the functions over a set, as unsigned 32 bits."""
    a, b = fs
    x, least = items >> np.uint64(32), np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(x), 256):
        y = np.multiply.outer(x[k : k + 256], a)
        y += b
        np.minimum(least, y.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, cls (digest of the set), sig, per row. Empty sets have no cls and no sig."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("sig", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, fs = Words(), functions()
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = shingles(text, words, width)
                cls = int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())))) if len(s) else None
                rows.append((doc, len(s), cls, signature(s, fs).tobytes() if len(s) else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return over_batches(docs, work, "doc_id long, n long, cls long, sig binary")


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, cls, items (the whole set)."""
    schema = pa.schema([("doc_id", pa.int64()), ("cls", pa.int64()), ("items", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            ids, cls, items = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = shingles(text, words, width)
                if len(s):
                    ids.append(doc)
                    cls.append(int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())))))
                    items.append(s.view(np.int64))
            if ids:
                offsets = pa.array(np.cumsum([0, *map(len, items)]), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cls, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(items)))], schema=schema)

    return over_batches(docs, work, "doc_id long, cls long, items array<long>")


def connected(links: DataFrame, label: str = "found") -> DataFrame:
    """(node, component) of every vertex of links(u, v), component the least vertex, stored; large-star and small-star in turn. Each
    round's edges replace those of the round before."""
    spark, mark = links.sparkSession, None
    held = Scratch(spark)
    edges = held.stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    n = edges.count()

    def least(edges: DataFrame, s: Scratch, rule: Column) -> DataFrame:
        """Edges with m, the least vertex next to u: of few edges the vertices are few, and broadcast; else see lookup."""
        low = edges.groupBy("u").agg(rule.alias("m"), F.count("*").alias("n"))
        return edges.join(F.broadcast(low), "u") if 2 * n <= BROADCAST_ROWS else lookup(edges, s.stored(low, "low"), "u", "n")

    while True:
        with Scratch(spark) as s:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = least(both, s, F.least("u", F.min("v"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            large = large if 2 * n <= BROADCAST_ROWS else s.stored(large, "large")
            small = least(large, s, F.min("v")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
            after = Scratch(spark)
            edges = after.stored(small, "edges")
        held.__exit__()
        held = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark, n = now, now[0]
    found = stored(edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node"), label)
    held.__exit__()
    return found


def hot_classes(pairs: DataFrame, signs: DataFrame, s: Scratch) -> DataFrame:
    """Classes with more than HOT_ROWS pairs and more than a HOT_CLASSESth of all, the hottest first as far as their sets take up HOT_BYTES; so
    what is known of them can be broadcast. signs: cls, n. Stored; mostly empty."""
    total = pairs.count()
    each = pairs.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("pairs"))
    hot = each.where(F.col("pairs") > max(HOT_ROWS, total // HOT_CLASSES)).join(signs.select("cls", "n"), "cls")
    size = F.sum(F.col("n") * 8 + 4 * HASHES).over(Window.orderBy(F.col("pairs").desc(), "cls"))
    return s.stored(hot.withColumn("bytes", size).where(F.col("bytes") <= HOT_BYTES).select("cls"), "hot")


def known_of_both(pairs: DataFrame, known: DataFrame, hot: DataFrame) -> DataFrame:
    """pairs (a, b) with the columns of known (cls, others) of either class, named other_a and other_b. Pairs with a hot class are
    dealt by their other class, and the hot one's columns are broadcast to them: no task gets all pairs of a hub."""
    others = [c for c in known.columns if c != "cls"]
    a, b = (known.select(F.col("cls").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in others)) for x in "ab")
    if hot.isEmpty():
        return pairs.join(a, "a").join(b, "b")
    keys = {x: F.broadcast(hot.select(F.col("cls").alias(x), F.lit(True).alias(f"hot_{x}"))) for x in "ab"}
    marked = pairs.join(keys["a"], "a", "left").join(keys["b"], "b", "left")
    few = {x: F.broadcast(side.join(F.broadcast(hot.select(F.col("cls").alias(x))), x, "left_semi")) for x, side in (("a", a), ("b", b))}
    cold = marked.where("hot_a is null and hot_b is null").join(a, "a").join(b, "b")
    by_a = marked.where("hot_a").join(few["a"], "a").join(b, "b")
    by_b = marked.where("hot_a is null and hot_b").join(few["b"], "b").join(a, "a")
    return cold.unionByName(by_a).unionByName(by_b).drop("hot_a", "hot_b")


def confirmed(pairs: DataFrame, signs: DataFrame, docs: DataFrame, width: int, percent: int, keep: Scratch) -> DataFrame:
    """Of candidate pairs of classes (a, b), those whose full sets meet the threshold, as (u, v) of their representatives.

    signs: cls, rep, n, sig; a class's text is that of the row with doc_id rep and its digest. The links are stored in keep."""
    least = int((percent / 100 - SLACK) * HASHES)

    @F.pandas_udf("int")
    def agreement(x, y):
        import pandas as pd

        return pd.Series([int((np.frombuffer(a, "<u4") == np.frombuffer(b, "<u4")).sum()) for a, b in zip(x, y)], dtype="int32")

    with Scratch(docs.sparkSession) as s:
        hot = hot_classes(pairs, signs, s)
        near = s.stored(known_of_both(pairs, signs.select("cls", "rep", "sig"), hot).where(agreement("sig_a", "sig_b") >= least).select("a", "b", "rep_a", "rep_b"), "near")
        wanted = s.stored(near.select(F.explode(F.array(F.struct(F.col("a").alias("cls"), F.col("rep_a").alias("doc_id")), F.struct(F.col("b").alias("cls"), F.col("rep_b").alias("doc_id")))).alias("x")).select("x.*").distinct(), "wanted")
        sets = sets_of(with_ids(docs, wanted.select("doc_id").distinct(), "doc_id"), width)
        sets = s.stored(sets.join(wanted, ["cls", "doc_id"], "left_semi").dropDuplicates(["cls"]).select("cls", "items"), "sets")
        both = known_of_both(near, sets, hot).select("rep_a", "rep_b", F.size("items_a").alias("p"), F.size("items_b").alias("q"), F.size(F.array_intersect("items_a", "items_b")).alias("i"))
        return keep.stored(both.where(f"100L * i >= {percent}L * (p + q - i)").select(F.col("rep_a").alias("u"), F.col("rep_b").alias("v")), "links")


def joined(cls: list[int], block: list[int], component: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join what is apart within one pair of blocks, by full sets; at most one less than its members."""
    size = np.array([len(s) for s in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[place]  # what one member alone has is in no intersection
    width = int(shared.max(initial=0)) // 8 + 1
    bits, at = np.zeros((len(sets), width), np.uint8), 0
    for k, n in enumerate(size):
        row, here = np.zeros(width * 8, bool), shared[at : at + n]
        row[here[here >= 0]] = True
        bits[k], at = np.packbits(row), at + n
    label, side, links = np.array(component), np.array(block), []
    two = side.min() != side.max()  # else all pairs of one block
    for k in range(len(sets) - 1):
        rest = np.arange(k + 1, len(sets))
        rest = rest[(label[rest] != label[k]) & (100 * np.minimum(size[rest], size[k]) >= percent * np.maximum(size[rest], size[k]))]
        rest = rest[side[rest] != side[k]] if two else rest
        for a in range(0, len(rest), 1024):
            part = rest[a : a + 1024]
            inter = np.bitwise_count(bits[part] & bits[k]).sum(axis=1, dtype=np.int64)
            for j in part[100 * inter >= percent * (size[part] + size[k] - inter)]:
                if label[j] != label[k]:
                    links.append((cls[k], cls[j]))
                    label[label == label[j]] = label[k]
    return links


def block_links(members: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame | None:
    """Links (u, v) of representatives within large buckets; members (stored): key, cls, component. None without such buckets."""
    if members.isEmpty():
        return None
    wanted = classes.join(members.select("cls").distinct(), "cls", "left_semi").select("cls", "rep", "n")
    texts = with_ids(docs, wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id")
    sets = sets_of(texts, width).join(wanted.select("cls", F.col("rep").alias("doc_id")), ["cls", "doc_id"], "left_semi").dropDuplicates(["cls"]).select("cls", "items")
    sized = members.join(wanted, "cls")
    blocks = sized.groupBy("key").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_ITEMS, F.count("*") / BLOCK_MEMBERS)).cast("int").alias("blocks"))
    tasks = blocks.agg(F.sum(F.col("blocks").cast("long") * (F.col("blocks") + 1))).first()[0] // 4  # about two pairs of blocks each
    dealt = sized.join(blocks, "key").withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "cls", "component", "rep").join(sets, "cls")
    dealt = dealt.select("key", "x", "y", "mine", "rep", "component", "items")
    n = max(12, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(100_000, tasks))
    dealt = dealt.repartition(n, "key", "x", "y").sortWithinPartitions("key", "x", "y")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) > 1 and len({h[2] for h in held}) > 1:
                links = joined(*map(list, zip(*held)), percent)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], schema=schema)

        for b in batches:
            items = b.column(6)
            for k, (key, x, y, mine, rep, component) in enumerate(zip(*(b.column(c).to_pylist() for c in range(6)))):
                if (key, x, y) != now:
                    yield from done()
                    now, held = (key, x, y), []
                held.append((rep, mine, component, items[k].values.to_numpy()))
        yield from done()

    return over_batches(dealt, work, "u long, v long")


def shared_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (u, v) that make one vertex of the rows of a doc_id whose sets differ; mostly none."""
    known = rows.where("cls is not null and doc_id is not null").select("doc_id", "cls", "n")
    several = known.groupBy("doc_id").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).where("x < y").select("doc_id")
    return known.join(several, "doc_id", "left_semi").join(classes.select("cls", "n", "rep"), ["cls", "n"]).where("rep <> doc_id").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row of docs: documents whose sets of width-word shingles have at least
    percent/100 of their union in common are linked."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    with Scratch(docs.sparkSession) as s:
        rows = s.stored(signed(docs, width), "signatures")
        classes = s.stored(rows.where("cls is not null and doc_id is not null").groupBy("cls", "n").agg(F.min("doc_id").alias("rep"), F.max(F.struct("sig")).alias("s")).select("cls", "n", "rep", "s.sig"), "classes")
        signs = classes.select("cls", "rep", "n", "sig")
        step = 4 * ROWS
        keys = F.array(*[F.xxhash64(F.lit(k), F.substring("sig", k * step + 1, step)) for k in range(BANDS)])
        dealt = classes.select("cls", F.explode(keys).alias("key"))
        shared = s.stored(dealt.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "shared")
        members = s.stored(lookup(dealt, shared, "key", "members"), "members")
        rank = members.groupBy("cls").agg(F.sum("members").alias("rank"))
        hubs = s.stored(members.join(rank, "cls").groupBy("key").agg(F.max(F.struct("rank", "cls")).alias("hub"), F.count("*").alias("many")).select("key", F.col("hub.cls").alias("hub"), "many"), "hubs")
        first = s.stored(lookup(members, hubs, "key", "many").where("cls <> hub").select(*ordered("cls", "hub")).distinct(), "pairs")
        links = confirmed(first, signs, docs, width, percent, s)
        found = connected(links)
        at = classes.select("cls", "rep").join(found, F.col("rep") == F.col("node"), "left").select("cls", F.coalesce("component", "rep").alias("component"))
        placed = s.stored(members.select("key", "cls").join(at, "cls"), "placed")
        apart = s.stored(placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("many")).where("x < y").select("key", "many"), "apart")
        left = s.stored(lookup(placed, apart, "key", "many"), "apart")
        few = left.where(F.col("many") <= SMALL)
        x, y = (few.select("key", F.col("cls").alias(c), F.col("component").alias(f"in_{c}")) for c in "xy")
        rest = x.join(y, "key").where("x < y and in_x <> in_y").select(*ordered("x", "y")).distinct().join(first, ["a", "b"], "left_anti")
        more = confirmed(s.stored(rest, "rest"), signs, docs, width, percent, s).unionByName(shared_ids(rows, classes))
        large = block_links(s.stored(left.where(F.col("many") > SMALL).select("key", "cls", "component"), "large"), classes, docs, width, percent)
        more = s.stored(more if large is None else more.unionByName(large), "links")
        if not more.isEmpty():
            found = connected(links.unionByName(more))
        final = classes.select("cls", "n", "rep").join(found, F.col("rep") == F.col("node"), "left").select("cls", "n", F.coalesce("component", "rep").alias("component"))
        out = rows.select("doc_id", "n", "cls").join(final, ["cls", "n"], "left")
        out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        return stored(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "groups")
