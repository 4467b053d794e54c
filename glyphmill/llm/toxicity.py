"""Toxicity (3): a counterfactually regularised linear classifier over word features.

A text is the set of its words and their beginnings (PREFIXES letters), lower-cased, as 64-bit hashes. Of these, the features
kept are those seen in LEAST_DF texts or more whose rates in toxic and other texts differ by Z standard errors, and all
identity terms. Logistic regression is fitted with a second penalty: for each labelled text that names a group, the same
text with the name swapped for another of its kind must get the same score; the squared differences of the logits count
COUNTERFACTUAL times. Neutral mentions of a group that labels associate with abuse then stop raising the score.

Fitted on the driver from at most about SAMPLE labelled rows, chosen by a hash of the id; their ids (a bounded set) are
broadcast, so the texts are not shuffled. The driver gets no text: executors count features, and then write each row as
the numbers of its features that are kept. Scores use every word of every text.

Cases. Null or empty text: the score of a text without features. No label to learn from: score 0. Null doc_id: never learned
from; held_out false. Repeated rows: equal values; a label given twice counts once (the larger); rows of an id count once
each if their features differ. Ties: none, features go in the order of their hashes. Very long texts: their words once each.
Empty table: no rows. Other columns are kept by scored() and ignored by score().
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import Scratch, crc_of_id, small_batches

SAMPLE, LEAST_DF, Z, RIDGE, COUNTERFACTUAL, PREFIXES = 8_000, 4, 3.5, 0.3, 20.0, (4, 5, 6, 7)
#: Words held by a worker's memo; it starts anew when full.
MEMO = 400_000
WORD = re.compile(r"[^\W\d_]+")
#: Names of groups by kind; a name is swapped for others of its kind.
IDENTITY = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "sikh"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants", "sikhs"),
    ("black", "white", "asian", "latino", "arab", "african", "european", "indigenous"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer", "homosexual", "heterosexual"),
    ("man", "woman"), ("men", "women"), ("boy", "girl"), ("boys", "girls"), ("male", "female"),
    ("immigrant", "refugee", "foreigner", "migrant"), ("immigrants", "refugees", "foreigners", "migrants"),
    ("american", "mexican", "german", "french", "spanish", "chinese", "russian", "indian", "turkish", "polish"),
    ("deaf", "blind", "disabled", "autistic"), ("old", "young"),
    # German
    ("christ", "muslim", "jude", "hindu", "buddhist", "atheist", "katholik", "protestant"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten", "katholiken", "protestanten"),
    ("mann", "frau"), ("männer", "frauen"), ("junge", "mädchen"),
    ("einwanderer", "flüchtling", "ausländer", "migrant"), ("einwanderinnen", "flüchtlinge", "migranten", "asylbewerber"),
    ("deutsche", "franzosen", "spanier", "türken", "polen", "russen", "araber", "amerikaner"),
    ("schwule", "lesben", "bisexuelle", "homosexuelle", "transgender"), ("blinde", "gehörlose", "behinderte"),
    # French
    ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée", "catholique", "protestant"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées", "catholiques", "protestants"),
    ("homme", "femme"), ("hommes", "femmes"), ("garçon", "fille"), ("garçons", "filles"),
    ("immigré", "réfugié", "étranger", "migrant"), ("immigrés", "réfugiés", "étrangers", "migrants"),
    ("allemands", "français", "espagnols", "turcs", "polonais", "russes", "arabes", "américains"),
    ("gays", "lesbiennes", "bisexuels", "homosexuels", "transgenres"), ("aveugles", "sourds", "handicapés"),
    # Spanish
    ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo", "católico", "protestante"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos", "católicos", "protestantes"),
    ("hombre", "mujer"), ("hombres", "mujeres"), ("chico", "chica"), ("chicos", "chicas"),
    ("inmigrante", "refugiado", "extranjero", "migrante"), ("inmigrantes", "refugiados", "extranjeros", "migrantes"),
    ("alemanes", "franceses", "españoles", "turcos", "polacos", "rusos", "árabes", "americanos"),
    ("gais", "lesbianas", "bisexuales", "homosexuales", "transexuales"), ("ciegos", "sordos", "discapacitados"),
)
#: A term of several kinds counts as one of the first.
KIND = {term: kind for kind in reversed(IDENTITY) for term in kind}


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def features_of(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    return [xxhash.xxh3_64_intdigest(word), *(xxhash.xxh3_64_intdigest(f"{word[:n]}*") for n in PREFIXES if len(word) > n)]


class Features(dict):
    """Features of words, by word; of those kept alone if kept is given."""

    def __init__(self, kept: Iterable[int] | None = None):
        self.kept = None if kept is None else frozenset(kept)

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.clear()
        got = self[word] = tuple(f for f in features_of(word) if self.kept is None or f in self.kept)
        return got

    def of(self, words: set[str]) -> set[int]:
        return {f for w in words for f in self[w]}


class Model:
    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.memo = Features(weights)

    def __reduce__(self):
        return Model, (self.weights, self.bias)

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights[f] for f in sorted(self.memo.of(words_of(text))))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500)))) if z > float("-inf") else 0.0


def identity() -> set[int]:
    return {f for t in KIND for f in features_of(t)}


def telling(features: np.ndarray, toxic: np.ndarray, other: np.ndarray, n1: int, n0: int, z: float = Z, least_df: int = LEAST_DF) -> np.ndarray:
    """Which features to keep, of counts in toxic and in other texts."""
    p = (toxic + other) / max(1, n1 + n0)
    error = np.sqrt(p * (1 - p) * (1 / max(1, n1) + 1 / max(1, n0)))
    apart = np.abs(toxic / max(1, n1) - other / max(1, n0)) >= z * error
    return features[(toxic + other >= least_df) & apart & (error > 0)] if n1 and n0 else features[:0]


#: A text as the numbers of its features, and for each name of a group in it what a swap adds and takes away.
Row = tuple[list[int], list[tuple[list[int], list[int]]]]


def row_of(text: str | None, memo: Features, index: dict[int, int]) -> Row:
    ws = words_of(text)
    got, swaps = memo.of(ws), []
    for t in sorted(ws & KIND.keys()):
        kind = KIND[t]
        turn = xxhash.xxh3_64_intdigest(text) % (len(kind) - 1)
        swapped = memo.of((ws - {t}) | {kind[(kind.index(t) + 1 + turn) % len(kind)]})
        swaps.append((sorted(index[f] for f in swapped - got), sorted(index[f] for f in got - swapped)))
    return sorted(index[f] for f in got), swaps


def solved(rows: list[Row], y: list[int], kept: list[int], counterfactual: float = COUNTERFACTUAL, ridge: float = RIDGE, rounds: int = 400) -> Model:
    """Logistic regression with both penalties, by accelerated gradient descent."""
    m, n, n1 = len(kept), len(y), sum(y)
    if not n:
        return Model({}, float("-inf"))
    change = [s for _, swaps in rows for s in swaps]
    r = np.repeat(np.arange(n), [len(c) for c, _ in rows])
    c, target = np.array([k for cols, _ in rows for k in cols], np.int64), np.array(y, float)
    cr = np.array([i for i, (p, q) in enumerate(change) for _ in (*p, *q)], np.int64)
    cc = np.array([k for p, q in change for k in (*p, *q)], np.int64)
    cv = np.array([v for p, q in change for v in (*[1.0] * len(p), *[-1.0] * len(q))])
    pairs = max(1, len(change))
    degree = np.bincount(r, minlength=n).max(initial=0) + 1  # the step follows from the largest row sums
    step = 1.0 / (0.25 * degree + ridge / n + (counterfactual * 2 * float(np.bincount(cr, minlength=1).max(initial=0)) if len(cr) else 0))
    w, bias = np.zeros(m), float(np.log((1 + n1) / (1 + n - n1)))
    v, vb = w.copy(), bias
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, v[c], minlength=n) + vb, -500, 500)))
        e = (p - target) / n
        g = np.bincount(c, e[r], minlength=m) + ridge * v / n
        if len(cr):
            d = np.bincount(cr, cv * v[cc], minlength=len(change))
            g += counterfactual / pairs * np.bincount(cc, cv * d[cr], minlength=m)
        new, nb = v - step * g, vb - step * e.sum()
        v, vb = new + k / (k + 3) * (new - w), nb + k / (k + 3) * (nb - bias)
        w, bias = new, nb
    return Model({f: float(x) for f, x in zip(kept, w) if abs(x) > 1e-9}, float(bias))


def counted(texts: Iterable[tuple[str | None, int]], memo: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of (text, label) pairs, and their counts in toxic and in other texts."""
    found = [(np.fromiter(memo.of(words_of(t)), np.uint64), label) for t, label in texts]
    every, place = np.unique(np.concatenate([f for f, _ in found] or [np.empty(0, np.uint64)]), return_inverse=True)
    labels = np.repeat([label for _, label in found], [len(f) for f, _ in found]) if found else np.empty(0)
    return every, np.bincount(place[labels == 1], minlength=len(every)), np.bincount(place[labels == 0], minlength=len(every))


def train(texts: Iterable[tuple[str | None, int]], counterfactual: float = COUNTERFACTUAL, ridge: float = RIDGE, z: float = Z, least_df: int = LEAST_DF) -> Model:
    """Fits a model on (text, label) pairs at hand."""
    texts = list(texts)
    y = [label for _, label in texts]
    features, toxic, other = counted(texts, Features())
    kept = sorted(identity() | set(telling(features, toxic, other, sum(y), len(y) - sum(y), z, least_df).tolist()))
    memo, index = Features(kept), {f: k for k, f in enumerate(kept)}
    return solved([row_of(t, memo, index) for t, _ in texts], y, kept, counterfactual, ridge)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn: Column | None = None, sample: int = SAMPLE, counterfactual: float = COUNTERFACTUAL) -> Model:
    """Learns from labelled rows where learn (over the column id) holds; about sample rows at most."""
    small_batches(docs.sparkSession)
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    if learn is not None:
        ids = ids.where(learn)
    n = ids.count()
    if n > sample:
        ids = ids.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(sample / n * 1_000_000))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "id").select("id", "text", F.col("label").cast("int").alias("label"))
    with Scratch(docs.sparkSession) as s:
        chosen = s.stored(texts, "labelled")  # about sample rows, read twice

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo = Features()
            for b in batches:
                f, toxic, other = counted(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), memo)
                yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(toxic, pa.int64()), pa.array(other, pa.int64())], names=["f", "toxic", "other"])

        y = {r.label: r.n for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
        n1, n0 = y.get(1, 0), y.get(0, 0)
        sums = chosen.select("text", "label").mapInArrow(count, "f long, toxic long, other long").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        found = sums.where(F.col("toxic") + F.col("other") >= LEAST_DF).toArrow()
        f, toxic, other = (found.column(c).to_numpy() for c in range(3))
        kept = sorted(identity() | set(telling(f.view(np.uint64), toxic, other, n1, n0).tolist()))

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo, index = Features(kept), {f: k for k, f in enumerate(kept)}
            for b in batches:
                rows = [json.dumps(row_of(t, memo, index)) for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), b.column(1), b.column(2)], names=["row", "label", "id"])

        rows = sorted({(str(r.id), r.row, r.label) for r in chosen.select("text", "label", F.col("id").cast("string").alias("id")).mapInArrow(number, "row string, label int, id string").collect()})
    return solved([json.loads(x) for _, x, _ in rows], [label for _, _, label in rows], kept, counterfactual)


def scored(model: Model, text: Column) -> Column:
    """The score of a text column, 0 to 1."""
    shared = model

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.score(t) for t in texts], dtype="float64")

    return score(text.cast("string"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted per row."""
    small_batches(docs.sparkSession)
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    out = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), scored(model, F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(id_col: str = "doc_id") -> Column:
    return crc_of_id(F.col(id_col)) % 5 == 0
