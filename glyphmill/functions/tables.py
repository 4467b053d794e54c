"""The mapping tables by name, and where they depart from Unicode form KC, as tables."""

from __future__ import annotations

import unicodedata as ud
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import mappings as M
from glyphmill.operators import normalize

TABLES: dict[str, Callable[[], dict[str, str]]] = {
    "core": M.core,
    "arabic-presentation-form": M.presentation,
    "cjk": M.cjk,
    "font": M.font,
    "enclosure": M.enclosure,
    "digit": M.digits,
    "combining-compose": lambda: M.composing()[0],
    "combining-decompose": lambda: M.composing()[1],
    "encoding-repair": M.mojibake,
    "literal": M.literal,
}


def dimension(spark: SparkSession) -> DataFrame:
    """name, src, tgt of all tables: bounded by Unicode, some thousand rows."""
    return spark.createDataFrame([(n, k, v) for n, t in TABLES.items() for k, v in t().items()], "name string, src string, tgt string")


def form_kc(rows: list[str]) -> list[str]:
    return [ud.normalize("NFKC", x) for x in rows]


def compared(spark: SparkSession, steps: frozenset[str] | None = None) -> DataFrame:
    """name, side (source or target), text, ours, kc, note of the sources and targets of all tables that normalization (by default with
    all steps) makes into something else than form KC does. note: `deleted` where we drop what form KC keeps."""
    steps = normalize.chosen("all") if steps is None else steps
    rows = [(n, s, x) for n, t in TABLES.items() for s, xs in (("source", t()), ("target", t().values())) for x in sorted(set(xs)) if x]
    pairs = spark.createDataFrame([(*r, k) for r, k in zip(rows, form_kc([x for *_, x in rows]))], "name string, side string, text string, kc string")
    found = pairs.withColumn("ours", normalize.normalize(F.col("text"), steps)).where("ours <> kc")
    return found.select("name", "side", "text", "ours", "kc", F.when((F.col("ours") == "") & (F.col("kc") == F.col("text")), "deleted").alias("note"))


def compared_characters(spark: SparkSession, steps: frozenset[str] | None = None) -> DataFrame:
    """code_point, text, ours, kc of the assigned characters that normalization and form KC treat differently."""
    steps = normalize.chosen("all") if steps is None else steps
    rows = [(c, chr(c)) for c in range(1, 0x30000) if ud.category(chr(c)) not in ("Cn", "Cs", "Co")]
    pairs = spark.createDataFrame([(*r, k) for r, k in zip(rows, form_kc([x for _, x in rows]))], "code_point int, text string, kc string")
    return pairs.withColumn("ours", normalize.normalize(F.col("text"), steps)).where("ours <> kc").select("code_point", "text", "ours", "kc")


#: Categories of characters that are kept, in order: of those with a decomposition by its tag, then by range or shape.
TAGGED = {"super": "SUPERSCRIPT", "sub": "SUBSCRIPT", "fraction": "FRACTION"}


def category_of(ch: str) -> str | None:
    """What kind of character it is that form KC takes apart and normalization may keep."""
    tag, _, rest = ud.decomposition(ch).partition("> ")
    if (found := TAGGED.get(tag[1:])) is not None:
        return found
    if 0x2E80 <= ord(ch) <= 0x2FDF:
        return "RADICAL"
    parts = rest.split()
    return "DIACRITIC" if tag == "<compat" and len(parts) > 1 and parts[0] == "0020" and ud.combining(chr(int(parts[1], 16))) else None


def drafted(chars: DataFrame, known: DataFrame, steps: frozenset[str] | None = None, kept_only: bool = False) -> DataFrame:
    """orig, ours, kc, category, comment of the different characters (ch) that no row of known (orig) asserts yet and that normalization (by
    default with all steps) and form KC treat differently; kept_only: of these, those of a category that normalization leaves as they are."""
    new = chars.select(F.col("ch").alias("orig")).distinct().join(known.select("orig"), "orig", "left_anti")
    done = new.withColumn("ours", normalize.normalize(F.col("orig"), normalize.chosen("all") if steps is None else steps))

    def described(parts):
        for t in parts:
            t["kc"] = form_kc(list(t["orig"]))
            t["category"] = [category_of(c) for c in t["orig"]]
            names = lambda x: " ".join(f"U+{ord(c):04X} ({ud.name(c, 'NO_NAME')})" for c in x)
            t["comment"] = [f"{names(a)} {names(b) if b != a else ''} {c or ''}".strip() for a, b, c in zip(t["orig"], t["ours"], t["category"])]
            yield t

    # no more rows than there are characters
    rows = done.mapInPandas(described, "orig string, ours string, kc string, category string, comment string").where("ours <> kc")
    return rows.where("category is not null and ours = orig") if kept_only else rows
