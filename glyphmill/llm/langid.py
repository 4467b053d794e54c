"""Language ID (7): nearest of several centroids per language, by cosine of TF-IDF n-gram vectors.

A text becomes counts of its letter 1- to 3-grams (other characters act as one blank), hashed into DIMS places, damped,
weighted by inverse document frequency and normalised. Per language, CENTROIDS spherical k-means centres are fitted on
at most about PER_LANGUAGE labelled rows, chosen by a hash of the id; vectors, not texts, travel to the driver
(at most DIMS * 8 bytes a row). A text takes the language of the nearest centroid. It is rejected if it has no letter or if
it lies farther from every centroid than nearly all training rows: cosine under REJECT times the lowest thousandth of training
rows with SHORT n-grams or more. A text of fewer n-grams shares less with any centroid; its bound shrinks as the root of
their number.

Cases. Null text or no letter: `und`, score 0, rejected. Nothing to learn from: `und` for all, rejected. Null doc_id or lang:
never learned from; held_out false for a null id. Repeated rows: equal values. Ties: the alphabetically first language.
Empty table: no rows, and nothing learned. Very long texts: read whole in one task, a count a different n-gram.
Other columns stay as they are in predicted(); identify() returns its own columns alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from glyphmill.llm.common import crc_of_id, small_batches

DIMS, CENTROIDS, PER_LANGUAGE, REJECT, GRAMS, SHORT = 4096, 3, 1200, 0.6, 3, 400
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter; made once per worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text; None without a letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    is_letter = letters()[c]
    if not is_letter.any():
        return None
    c = np.where(is_letter, c, 32)
    c = c[np.concatenate(([True], is_letter[1:] | is_letter[:-1]))]  # one blank for a run of others
    c = np.concatenate(([32], c, [32])).astype(np.uint32)
    out = np.zeros(DIMS)
    h = np.zeros(len(c), np.uint32)
    for n in range(1, GRAMS + 1):
        h = h[: len(c) - n + 1] * np.uint32(0x9E3779B1) + c[n - 1 :] + np.uint32(n)
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        out += np.bincount(mixed >> np.uint32(32 - DIMS.bit_length() + 1), minlength=DIMS)
    return out


def damped(x: np.ndarray) -> np.ndarray:
    return np.log1p(x)


@F.pandas_udf(BinaryType())
def packed_counts(texts: pd.Series) -> pd.Series:
    """Places and counts of what is not 0, as little-endian uint16 and float32."""

    def one(t):
        if (x := counts(t)) is None:
            return None
        at = np.flatnonzero(x)
        return at.astype("<u2").tobytes() + x[at].astype("<f4").tobytes()

    return texts.map(one)


def unpacked(blob: bytes) -> np.ndarray:
    n, out = len(blob) // 6, np.zeros(DIMS, np.float32)
    out[np.frombuffer(blob[: 2 * n], "<u2")] = np.frombuffer(blob[2 * n :], "<f4")
    return out


class Model:
    """languages[k] is the language of centroid k; idf and centroids are in the space of damped counts."""

    def __init__(self, languages: list[str], idf: np.ndarray, centroids: np.ndarray, least: float):
        self.languages, self.idf, self.centroids, self.least = languages, idf, centroids, least

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
        for a in range(0, len(texts), 256):
            found = [(k, x) for k in range(a, min(a + 256, len(texts))) if (x := counts(texts[k])) is not None]
            if not found or not self.languages:
                continue
            m = unit(damped(np.array([x for _, x in found])).astype(np.float32) * self.idf)
            cos = m @ self.centroids.T
            for (k, x), row in zip(found, cos):
                j = int(row.argmax())
                s = float(min(1.0, max(0.0, row[j])))
                out[k] = (self.languages[j], s, s < self.least * min(1.0, x.sum() / SHORT) ** 0.5)
        return out


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def clustered(m: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far-apart rows; deterministic."""
    centres = [unit(m.mean(axis=0, keepdims=True))[0]]
    while len(centres) < min(k, len(m)):
        centres.append(m[(m @ np.array(centres).T).max(axis=1).argmin()])
    c = np.array(centres)
    for _ in range(rounds):
        near = (m @ c.T).argmax(axis=1)
        c = unit(np.array([m[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))]))
    return c


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: Column | None = None, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> Model:
    """Learns from the rows where learn holds (default: all) and the language is not null; about per_language rows of each."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"), (F.lit(True) if learn is None else learn).alias("ok"))
    rows = rows.where("ok and l is not null and i is not null and t is not null")
    sizes = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), 0.0)
    share = F.create_map(*[F.lit(x) for l, n in sorted(sizes.items()) for x in (l, min(1.0, per_language / n))])
    small_batches(docs.sparkSession)
    chosen = rows.where(F.pmod(F.xxhash64("i"), F.lit(1_000_000)) < share[F.col("l")] * 1_000_000).select("i", "l", packed_counts("t").alias("x"))
    # a filter on x in the plan would count each text twice, by a second worker a task
    got = sorted((r.l, r.i, bytes(r.x)) for r in chosen.collect() if r.x is not None)
    if not got:
        return Model([], np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), 0.0)
    m = np.array([unpacked(x) for _, _, x in got], np.float32)
    long = m.sum(axis=1) >= SHORT
    idf = np.log((1 + len(m)) / (1 + (m > 0).sum(axis=0))).astype(np.float32) + 1
    m = unit(damped(m) * idf).astype(np.float32)
    names = np.array([l for l, _, _ in got])
    langs: list[str] = []
    parts = []
    for l in sorted(set(names)):
        c = clustered(m[names == l], centroids)
        langs += [str(l)] * len(c)
        parts.append(c)
    all_centres = np.concatenate(parts).astype(np.float32)
    nearest = (m @ all_centres.T).max(axis=1)
    nearest = np.sort(nearest[long] if long.any() else nearest)
    return Model(langs, idf, all_centres, REJECT * float(nearest[len(nearest) // 1000]))


def predicted(model: Model, text: Column) -> Column:
    """A struct of lang_pred, score, rejected for a text column."""
    shared = model  # travels with the function; DIMS * 4 bytes a centroid

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.predict([None if t is None else str(t) for t in texts]), columns=["lang_pred", "score", "rejected"])

    return predict(text.cast("string"))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected per row."""
    small_batches(docs.sparkSession)
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    return docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), predicted(model, F.col(text_col)).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def held_out(id_col: str = "doc_id") -> Column:
    return crc_of_id(F.col(id_col)) % 3 == 1
