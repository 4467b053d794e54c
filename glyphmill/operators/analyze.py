"""Analysis of a text column as tidy tables: characters, scripts, tokens, examples, issues.

Everything is exploded and aggregated by the engine; per-row duplicates are reduced before anything is joined. The character
dimension holds one row per character seen, so that no lookup runs per occurrence.
"""

from __future__ import annotations

import unicodedata as ud
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

WORD, COMPLEX = r"(?:\p{L}\p{M}*){2,}", r"\p{L}\p{M}+"
XML = {"xml_decimal": r"(?i)&#\d{1,7};", "xml_hex": r"(?i)&#x[0-9a-f]{1,6};", "xml_named": r"(?i)&[a-z]{1,6};"}
# Names of characters that the Unicode data gives none; after `;` what Windows-1252 has there.
CONTROLS = {
    0x00: "NULL", 0x01: "START OF HEADING", 0x02: "START OF TEXT", 0x03: "END OF TEXT", 0x04: "END OF TRANSMISSION", 0x05: "ENQUIRY", 0x06: "ACKNOWLEDGE",
    0x07: "BELL", 0x08: "BACKSPACE", 0x09: "TAB", 0x0A: "LINE FEED", 0x0B: "LINE TABULATION", 0x0C: "FORM FEED", 0x0D: "CARRIAGE RETURN", 0x0E: "SHIFT OUT",
    0x0F: "SHIFT IN", 0x10: "DATA LINK ESCAPE", 0x11: "DEVICE CONTROL ONE", 0x12: "DEVICE CONTROL TWO", 0x13: "DEVICE CONTROL THREE", 0x14: "DEVICE CONTROL FOUR",
    0x15: "NEGATIVE ACKNOWLEDGE", 0x16: "SYNCHRONOUS IDLE", 0x17: "END OF TRANSMISSION BLOCK", 0x18: "CANCEL", 0x19: "END OF MEDIUM", 0x1A: "SUBSTITUTE",
    0x1B: "ESCAPE", 0x1C: "INFORMATION SEPARATOR FOUR", 0x1D: "INFORMATION SEPARATOR THREE", 0x1E: "INFORMATION SEPARATOR TWO", 0x1F: "INFORMATION SEPARATOR ONE",
    0x7F: "DELETE", 0x80: "PADDING CHARACTER; Euro Sign", 0x81: "HIGH OCTET PRESET", 0x82: "BREAK PERMITTED HERE; Single Low-9 Quotation Mark",
    0x83: "NO BREAK HERE; Latin Small Letter F With Hook", 0x84: "INDEX; Double Low-9 Quotation Mark", 0x85: "NEXT LINE; Horizontal Ellipsis",
    0x86: "START OF SELECTED AREA; Dagger", 0x87: "END OF SELECTED AREA; Double Dagger", 0x88: "CHARACTER TABULATION SET; Modifier Letter Circumflex Accent",
    0x89: "CHARACTER TABULATION WITH JUSTIFICATION; Per Mille Sign", 0x8A: "LINE TABULATION SET; Latin Capital Letter S With Caron",
    0x8B: "PARTIAL LINE FORWARD; Single Left-Pointing Angle Quotation Mark", 0x8C: "PARTIAL LINE BACKWARD; Latin Capital Ligature OE", 0x8D: "REVERSE LINE FEED",
    0x8E: "SINGLE SHIFT TWO; Latin Capital Letter Z With Caron", 0x8F: "SINGLE SHIFT THREE", 0x90: "DEVICE CONTROL STRING",
    0x91: "PRIVATE USE ONE; Left Single Quotation Mark", 0x92: "PRIVATE USE TWO; Right Single Quotation Mark", 0x93: "SET TRANSMIT STATE; Left Double Quotation Mark",
    0x94: "CANCEL CHARACTER; Right Double Quotation Mark", 0x95: "MESSAGE WAITING; Bullet", 0x96: "START OF GUARDED AREA; En Dash", 0x97: "END OF GUARDED AREA; Em Dash",
    0x98: "START OF STRING; Small Tilde", 0x99: "SINGLE GRAPHIC CHARACTER INTRODUCER; Trade Mark Sign", 0x9A: "SINGLE CHARACTER INTRODUCER; Latin Small Letter S With Caron",
    0x9B: "CONTROL SEQUENCE INTRODUCER; Single Right-Pointing Angle Quotation Mark", 0x9C: "STRING TERMINATOR; Latin Small Ligature OE", 0x9D: "OPERATING SYSTEM COMMAND",
    0x9E: "PRIVACY MESSAGE; Latin Small Letter Z With Caron", 0x9F: "APPLICATION PROGRAM COMMAND; Latin Capital Letter Y With Diaeresis",
    0xFEFF: "ZERO WIDTH NO-BREAK SPACE (BYTE ORDER MARK)",
}
NESTED = r"(?i)&(?:amp;)+(?:#\d{1,7}|#x[0-9a-f]{1,6}|[a-z]{1,6});"


def name_of(ch: str) -> str:
    """The character's name; a control's, with what Windows-1252 has in its place."""
    name, _, meant = CONTROLS.get(ord(ch), "").partition("; ")
    return f"{name} (W1252: {meant})" if meant else name or ud.name(ch, "")


def exploded(df: DataFrame, array: Column, name: str, *rest: Column | str) -> DataFrame:
    """rest and a row for each entry of an array. Outer: an inner explode has a filter that makes the array again."""
    return df.select(*rest, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    """A row per line: the other columns, line_no from 1, line."""
    rest = [c for c in df.columns if c != text_col]
    return df.select(*rest, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def overview(df: DataFrame, text_col: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """n_lines and n_characters, of all rows or by columns; each line counts its end."""
    per = df.where(F.col(text_col).isNotNull()).select(*by, F.size(F.split(text_col, "\n")).alias("n"), F.length(text_col).alias("c"))
    return per.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_lines"), F.coalesce(F.sum("c") + F.count("*"), F.lit(0)).alias("n_characters"))


def char_counts(df: DataFrame, text_col: str = "text", by: Sequence[str] = (), empty: bool = False) -> DataFrame:
    """Occurrences of each character, of all rows or by columns; with empty, empty texts are counted as the character ''."""
    chars = exploded(df, F.split(text_col, ""), "ch", *by)
    return (chars if empty else chars.where("ch <> ''")).groupBy(*by, "ch").agg(F.count("*").alias("n"))


def first_holding(df: DataFrame, k: int, id_col: str, text_col: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """by, ch, the ids of the first k rows that hold each character. A text gives each of its characters once, and a task keeps k ids of
    each, before anything is shuffled."""
    each = exploded(df, F.array_distinct(F.split(text_col, "")), "ch", *by, F.col(id_col)).where("ch <> ''")
    rank = F.dense_rank().over(Window.partitionBy(*by, "ch").orderBy(id_col))
    return each.withColumn("r", rank).where(F.col("r") <= k).select(*by, "ch", id_col).distinct()


def char_dim(chars: DataFrame) -> DataFrame:
    """ch, code_point, category, name, script (first word of a letter's name) of a small table of distinct characters."""
    schema = T.StructType([T.StructField("ch", T.StringType()), T.StructField("code_point", T.StringType()), T.StructField("category", T.StringType()), T.StructField("name", T.StringType()), T.StructField("script", T.StringType())])

    def describe(it):
        for pdf in it:
            pdf["code_point"] = [f"U+{ord(c):04X}" for c in pdf["ch"]]
            pdf["category"] = [ud.category(c) for c in pdf["ch"]]
            pdf["name"] = [name_of(c) for c in pdf["ch"]]
            pdf["script"] = [n.split(" ")[0] if k[0] == "L" and n else None for n, k in zip(pdf["name"], pdf["category"])]
            yield pdf

    return chars.select("ch").mapInPandas(describe, schema)


def letter_scripts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Letters by script: script, n, and the distinct letters in code point order."""
    counts = char_counts(df, text_col)
    return counts.join(char_dim(counts), "ch").where("script is not null").groupBy("script").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("ch")), "").alias("letters"))


def tokens(df: DataFrame, pattern: str, text_col: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """token, n of all matches of a pattern, of all rows or by columns."""
    return exploded(df, F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0)), "token", *by).groupBy(*by, "token").agg(F.count("*").alias("n"))


def examples(df: DataFrame, pattern: str, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first k rows (by id) in which each token occurs: token, doc_id, rank."""
    found = df.select(F.col(id_col).alias("doc_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0)))).alias("token"))
    # A dense rank gives rows of one id one place, and lets Spark prune each task's rows before they are shuffled.
    return found.withColumn("rank", F.dense_rank().over(Window.partitionBy("token").orderBy("doc_id"))).where(F.col("rank") <= k).distinct()


def mixed_scripts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Words that mix Latin, Greek and Cyrillic letters: token, n."""
    t = tokens(df, WORD, text_col)
    scripts = sum((F.col("token").rlike(rf"\p{{Is{s}}}").cast("int") for s in ("Latin", "Greek", "Cyrillic")), F.lit(0))
    return t.where(scripts >= 2)


def orphan_marks(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Tokens with a mark that follows no letter."""
    return tokens(df, r"\S+", text_col).where(F.col("token").rlike(r"(^|[^\p{L}\p{M}])\p{M}"))


def char_conflicts(df: DataFrame, text_col: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """Pairs of look-alike letters that both occur: key, ch, n, of all rows or by columns."""
    key = F.when(F.col("ch").isin("ك", "ک"), "kaf").when(F.col("ch").isin("ي", "ی"), "yeh")
    c = char_counts(df, text_col, by).withColumn("key", key).where("key is not null")
    return c.join(c.groupBy(*by, "key").agg(F.count("*").alias("m")).where("m >= 2").select(*by, "key"), [*by, "key"]).select(*by, "key", "ch", "n")


def long_tokens(df: DataFrame, least: int = 20, text_col: str = "text") -> DataFrame:
    return tokens(df, r"\S+", text_col).where(F.length("token") >= least)
