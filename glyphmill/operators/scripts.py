"""Characters by Unicode block, and scripts of letters, numbers and other characters, as tidy tables.

Characters are counted first. The JVM gives each distinct character its block; the few distinct characters alone are described.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.functions import blocks as B
from glyphmill.operators import analyze, report

#: Longest list of a script's characters that is shown: kind, for the most frequent script, for others (0: never).
SHOWN = (("letter", 0, 500), ("number", 80, 500), ("other", 80, 80))


def described(chars: DataFrame) -> DataFrame:
    """ch, n, block, kind, script of a table of distinct characters ch, n."""
    raw = F.java_method(F.lit("java.lang.Character$UnicodeBlock"), F.lit("of"), F.ascii("ch"))

    def describe(it):
        for pdf in it:
            pdf["block"] = [B.block_of(c, "OTHER" if b == "null" else b) for c, b in zip(pdf["ch"], pdf["block"])]
            kinds = [B.kind_of(c, b) for c, b in zip(pdf["ch"], pdf["block"])]
            pdf["kind"], pdf["script"] = [k for k, _ in kinds], [s for _, s in kinds]
            yield pdf

    return chars.select("ch", "n", raw.alias("block")).mapInPandas(describe, "ch string, n long, block string, kind string, script string")


def script_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """kind (letter, number, other), script, n, ex: the script's characters in code point order, null where there are too many."""
    return script_rows(df, text_col).drop("first_char")


def script_rows(df: DataFrame, text_col: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """script_counts() and first_char, the script's least character, of all rows or by columns."""
    counts = analyze.char_counts(df, text_col, by)
    kinds = described(counts.groupBy("ch").agg(F.sum("n").alias("n"))).select("ch", "kind", "script") if by else None
    found = (described(counts) if kinds is None else counts.join(kinds, "ch")).groupBy(*by, "kind", "script").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("ch")).alias("chars"))
    # equal counts: the script of the least character goes first
    ranked = found.withColumn("first", F.row_number().over(Window.partitionBy(*by, "kind").orderBy(F.desc("n"), F.ascii(F.col("chars")[0]))) == 1)
    shown = F.coalesce(*[F.when(F.col("kind") == k, F.when(F.col("first"), a).otherwise(b)) for k, a, b in SHOWN])
    return ranked.select(*by, "kind", "script", "n", F.when(F.size("chars") <= shown, F.array_join("chars", "")).alias("ex"), F.col("chars")[0].alias("first_char"))


def block_table(df: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """block, ch, code_point, name, n, ex: each character under its block, with the first k rows that hold it."""
    chars = report.char_examples(df, k, id_col, text_col)
    return described(chars).select("ch", "block").join(chars, "ch").select("block", "ch", "code_point", "name", "n", "ex")
