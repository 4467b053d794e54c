"""Text files in and out: numbered lines that keep ill-formed bytes, directories, line ids, tables; lines and JSON out."""

from __future__ import annotations

import re
import sys
import unicodedata as ud
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.operators import bytesafe


def read_lines(spark: SparkSession, path: str, glob: str | None = None, repair: bool = True, strip: bool = True, keep_raw: bool = False) -> DataFrame:
    """doc_id (the file's path), line_no from 1, text of the lines of a file or directory; raw, their bytes, if asked for.

    Large files stay split: a line's number is its place in its split plus the lines of the file's splits before it. Trailing
    spaces go if strip is set; ill-formed bytes are read as Windows-1252 or dropped.
    """
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    raw = reader.text(path).select(F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_k"), F.col("value").cast("binary").alias("_raw"))
    splits = raw.groupBy("doc_id", "_at").agg(F.min("_k").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("doc_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    numbered = raw.join(splits.withColumn("_before", F.coalesce(before, F.lit(0))), ["doc_id", "_at"])
    text = bytesafe.text_of(F.col("_raw"), repair)
    text = F.regexp_replace(text, "[ \r]+$", "") if strip else text
    return numbered.select("doc_id", (F.col("_k") - F.col("_first") + F.col("_before") + 1).alias("line_no"), text.alias("text"), *([F.col("_raw").alias("raw")] if keep_raw else []))


def read_stdin(spark: SparkSession, stream: BinaryIO | None = None, repair: bool = True, strip: bool = True, keep_raw: bool = False) -> DataFrame:
    """doc_id (`-`), line_no from 1, text of the lines of a pipe (standard input). A pipe has one reader, so its bytes pass through the
    driver's memory; what does not fit there must come as files."""
    raw = (sys.stdin.buffer if stream is None else stream).read()
    lines = re.split(rb"\r\n|\r|\n", raw)
    if not lines[-1]:
        lines.pop()
    rows = spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(lines, 1)], "line_no long, _raw binary")
    text = bytesafe.text_of(F.col("_raw"), repair)
    return rows.select(F.lit("-").alias("doc_id"), "line_no", (F.regexp_replace(text, "[ \r]+$", "") if strip else text).alias("text"), *([F.col("_raw").alias("raw")] if keep_raw else []))


def without_range_lines(lines: DataFrame, text_col: str = "text") -> DataFrame:
    """Lines as an analysis takes them: stripped, without the markers <range>."""
    return lines.withColumn(text_col, F.regexp_replace(text_col, r"^(?U)\s+|(?U)\s+$", "")).where(F.col(text_col) != "<range>")


def read_ref_ids(spark: SparkSession, path: str) -> DataFrame:
    """line_no, ref_id: the stripped lines of a file of ids."""
    return read_lines(spark, path).select("line_no", F.trim("text").alias("ref_id"))


def with_ref_ids(lines: DataFrame, refs: DataFrame) -> DataFrame:
    """Lines with ref_id; ids that name their file go to its lines alone."""
    return lines.join(refs, ["doc_id", "line_no"] if "doc_id" in refs.columns and "doc_id" in lines.columns else "line_no", "left")


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """src, tgt of a tab-separated table with a header; quotes have no meaning."""
    t = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("ignoreLeadingWhiteSpace", False).csv(path)
    return t.select(F.col(t.columns[0]).alias("src"), F.coalesce(F.col(t.columns[1]), F.lit("")).alias("tgt"))


def mapping_of(spark: SparkSession, path: str) -> dict[str, str]:
    """A mapping table's sources and targets, for normalize(table=...): single characters, so it is as small as Unicode at most."""
    return {r.src: r.tgt for r in read_mapping(spark, path).where(F.col("src") != "").collect()}


def write_mapping(spark: SparkSession, table: dict[str, str], path: str) -> None:
    """A table as tab-separated rows with a header: source, target, a description of both."""
    rows = [(k, v, f"{described(k)} -> {described(v) or 'deleted'}") for k, v in sorted(table.items())]
    out = spark.createDataFrame(rows, "src string, tgt string, comment string").coalesce(1).sortWithinPartitions("src")
    plain = {"sep": "\t", "header": True, "quote": "", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    out.write.mode("errorifexists").options(**plain).csv(path)


def described(s: str) -> str:
    """Code points and names of a string's characters."""
    return " ".join(f"U+{ord(c):04X} ({ud.name(c, None) or ('Control character' if ud.category(c) == 'Cc' else 'NO_NAME')})" for c in s)


def _small(spark: SparkSession, path: str) -> list[str]:
    """The lines of a file of settings, in order."""
    return [r.text for r in read_lines(spark, path, repair=False).orderBy("line_no").collect()]


def read_look_alikes(spark: SparkSession, path: str, section: str = "Identical-looking") -> list[str]:
    """Rows of characters that look alike, for normalize(look_alikes=...), of the section whose heading (`::section ...`) has that name."""
    rows, inside = [], False
    for line in _small(spark, path):
        if "::section" in line:
            inside = section.lower() in line.lower()
        elif inside and len(line.split()) > 1:
            rows.append(line.strip())
    return rows


def read_exclusions(spark: SparkSession, path: str) -> dict[str, str]:
    """Characters that are not to be composed, with their names, of a list of them: `0958 # name`, and in comments `# 0340 name` and
    ranges `# 2F800..2FA1D`."""
    out = {}
    for line in _small(spark, path):
        if m := re.match(r"#?\s*([0-9A-Fa-f]{4,5})(?:\.\.([0-9A-Fa-f]{4,5}))?(?=\s)(\s*#)?", line):
            first, last = int(m[1], 16), int(m[2] or m[1], 16)
            if m[2] or m[3] or line.startswith("#"):
                out |= {chr(c): ud.name(chr(c), "NO_NAME") for c in range(first, last + 1)}
    return out


def write_lines(df: DataFrame, path: str, text_col: str = "text") -> None:
    """One line out for each row, in the order of line_no within each file's lines if there is one."""
    order = [c for c in ("doc_id", "line_no") if c in df.columns]
    (df.orderBy(*order) if order else df).select(text_col).write.mode("errorifexists").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)
