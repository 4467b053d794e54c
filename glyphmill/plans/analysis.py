"""Whole analyses: every section as a table, as JSON rows, or as a printed report of bounded length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.operators import analyze, report, scripts


def analysis(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> dict[str, DataFrame]:
    """Section to table; nothing runs until one is read."""
    by_script = scripts.script_counts(df, text_col)
    return {
        "overview": analyze.overview(df, text_col),
        **{f"{kind}-script": by_script.where(F.col("kind") == kind).drop("kind") for kind in ("letter", "number", "other")},
        "non-canonical": report.non_canonical(df, text_col),
        "char-conflict": analyze.char_conflicts(df, text_col),
        "notable-token": report.notable(df, text_col),
        "pattern": report.pattern_groups(df, text_col),
        "block": scripts.block_table(df, k, id_col, text_col),
    }


def as_json(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """section, json: a row per row of each section."""
    out = None
    for name, t in analysis(df, id_col, text_col).items():
        rows = t.select(F.lit(name).alias("section"), F.to_json(F.struct(*t.columns)).alias("json"))
        out = rows if out is None else out.unionByName(rows)
    return out


def rollup(df: DataFrame, text_col: str = "text") -> DataFrame:
    """kind, heading, level, categories, types, instances of notable tokens: of each heading (level 0), each kind (1) and all (3); kind and
    heading are null where they are summed over."""
    kind = F.when(F.col("heading").startswith("XML"), "XML escape tokens").otherwise("Words with characters from multiple scripts")
    found = report.notable(df, text_col).withColumn("kind", kind).rollup("kind", "heading")
    return found.agg(F.grouping_id().cast("int").alias("level"), F.countDistinct("heading").alias("categories"), F.countDistinct("heading", "token").alias("types"), F.sum("n").alias("instances"))


def printed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_cases: int = 100) -> str:
    """A report to read, with at most max_cases rows a group."""
    lines = []
    for name, t in analysis(df, id_col, text_col).items():
        group = next((c for c in ("heading", "key", "block") if c in t.columns), None)
        count = next((c for c in ("n", "orig_count", "n_lines") if c in t.columns), t.columns[0])
        order = [F.desc(count), *[c for c in t.columns if c not in (count, "ex", "changes")]]
        w = Window.partitionBy(group or F.lit(0)).orderBy(*order)
        kept = t.orderBy(*order).limit(max_cases) if group is None else t.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_cases).drop("_r").orderBy(group, *order).limit(50 * max_cases)
        lines.append(f"{name.upper()}:")
        lines += ["    " + ", ".join(f"{c}={v}" for c, v in r.asDict().items()) for r in kept.collect()]
    return "\n".join(lines)
