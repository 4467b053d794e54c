"""Ill-formed bytes in an analysis: each is a unit of its own, with counts, examples, places and tags.

marked() keeps such a byte in a string as a pair of noncharacters (U+FDD8-U+FDDF for its upper, U+FDE0-U+FDEF for its lower half), which
Unicode reserves for uses like this; so patterns, tokens and counts of the engine see it, and nothing else is changed by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.operators import bytesafe

HIGH, LOW = 0xFDD0, 0xFDE0
PAIR = r"[\x{FDD8}-\x{FDDF}][\x{FDE0}-\x{FDEF}]"
BLOCK = "LOW_SURROGATES"


def pair(byte: int) -> str:
    return chr(HIGH + byte // 16) + chr(LOW + byte % 16)


def pairs(first: int, last: int) -> str:
    """A pattern of the pairs of bytes of a range."""
    return "(?:" + "|".join(pair(b) for b in range(first, last + 1)) + ")"


#: Characters in more bytes than they need.
OVERLONG = f"{pairs(0xC0, 0xC1)}{pairs(0x80, 0xBF)}|{pair(0xE0)}{pairs(0x80, 0x9F)}{pairs(0x80, 0xBF)}|{pair(0xF0)}{pairs(0x80, 0x8F)}{pairs(0x80, 0xBF)}{{2}}"


def marked(raw: Column) -> Column:
    """The string of a binary column with a pair for each ill-formed byte. Null stays null."""
    parts = F.regexp_extract_all(F.decode(raw, "ISO-8859-1"), F.lit(f"{bytesafe.WELL_FORMED}|[\\x80-\\xFF]"), F.lit(0))
    single = lambda x: (F.length(x) == 1) & (x >= "\x80")
    read = lambda x: F.encode(x, "ISO-8859-1").cast("string")
    half = lambda start, by: F.substring(F.lit("".join(chr(start + k) for k in range(16))), by + 1, F.lit(1))
    lone = lambda x: F.concat(half(HIGH, F.shiftright(F.ascii(x), 4)), half(LOW, F.ascii(x).bitwiseAND(F.lit(15))))
    odd = F.array_join(F.transform(parts, lambda x: F.when(single(x), lone(x)).otherwise(read(x))), "")
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(odd)


def byte_of(unit: Column) -> Column:
    """The byte's number, of its pair."""
    return (F.ascii(unit) - HIGH) * 16 + F.ascii(F.substring(unit, 2, 1)) - LOW


def shown(c: Column) -> Column:
    """Text to be read: a replacement character for each ill-formed byte."""
    return F.regexp_replace(c, F.lit(PAIR), F.lit("�"))


def coded(c: Column) -> Column:
    """Text to be told apart: each ill-formed byte as <80>."""
    parts = F.regexp_extract_all(c, F.lit(rf"{PAIR}|[^\x{{FDD8}}-\x{{FDDF}}]+|[\s\S]"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(f"^{PAIR}$"), F.concat(F.lit("<"), F.hex(byte_of(x)), F.lit(">"))).otherwise(x)), "")


def table(raw: DataFrame, k: int = 5, by: tuple[str, ...] | list[str] = (), raw_col: str = "raw", no_col: str = "line_no") -> DataFrame:
    """by, block, ch, code_point, name, n, ex of each different ill-formed byte in lines (by, line_no, raw), as rows of characters: ex are
    the first k runs of letters and ill-formed bytes around one, with their lines."""
    odd = raw.where(~F.is_valid_utf8(F.col(raw_col).cast("string"))).select(*by, F.col(no_col).alias("line_no"), marked(F.col(raw_col)).alias("_text"))
    run = rf"(?:\p{{L}}\p{{M}}*|{PAIR})*"
    runs = odd.select(*by, "line_no", F.posexplode(F.regexp_extract_all("_text", F.lit(rf"{run}{PAIR}{run}"), F.lit(0))).alias("pos", "run"))
    units = runs.select(*by, "line_no", "pos", "run", F.explode(F.regexp_extract_all("run", F.lit(PAIR), F.lit(0))).alias("unit"))
    counts = units.groupBy(*by, "unit").agg(F.count("*").alias("n"))
    texts = units.groupBy(*by, "unit", shown(F.col("run")).alias("text"), "line_no").agg(F.min("pos").alias("pos"))
    near = texts.withColumn("r", F.row_number().over(Window.partitionBy(*by, "unit").orderBy("line_no", "pos", "text"))).where(F.col("r") <= k)
    ex = F.transform(F.array_sort(F.collect_list(F.struct("r", "text", F.col("line_no").cast("long").alias("line_no")))), lambda x: F.struct(x["text"].alias("text"), x["line_no"].alias("line_no")))
    found = counts.join(near.groupBy(*by, "unit").agg(ex.alias("ex")), [*by, "unit"])
    code = F.hex(byte_of(F.col("unit")))
    name = F.concat(F.lit("UTF-8 ENCODING ERROR (BYTE SURROGATE: U+DC"), code, F.lit(")"))
    return found.select(*by, F.lit(BLOCK).alias("block"), F.lit("�").alias("ch"), F.concat(F.lit("0x"), code).alias("code_point"), name.alias("name"), "n", "ex")


def line_counts(raw: DataFrame, raw_col: str = "raw", no_col: str = "line_no") -> DataFrame:
    """code_point, n_lines, first_line of each different ill-formed byte: all the lines that hold it, whatever examples are kept."""
    odd = raw.where(~F.is_valid_utf8(F.col(raw_col).cast("string"))).select(F.col(no_col).alias("line_no"), marked(F.col(raw_col)).alias("_text"))
    units = odd.select("line_no", F.explode(F.array_distinct(F.regexp_extract_all("_text", F.lit(PAIR), F.lit(0)))).alias("unit"))
    # two steps, so that no task holds the lines of a byte
    counts = units.groupBy("unit", "line_no").agg(F.lit(1).alias("_")).groupBy("unit").agg(F.count("*").alias("n_lines"), F.min("line_no").alias("first_line"))
    return counts.select(F.concat(F.lit("0x"), F.hex(byte_of(F.col("unit")))).alias("code_point"), "n_lines", "first_line")


def tokens(raw: DataFrame, raw_col: str = "raw", no_col: str = "line_no") -> DataFrame:
    """line_no, pos, token of tokens with ill-formed bytes, these as pairs."""
    line = F.trim(F.regexp_replace(marked(F.col(raw_col)), r"[ \t-\r]+", " "))
    odd = raw.where(~F.is_valid_utf8(F.col(raw_col).cast("string"))).select(F.col(no_col).alias("line_no"), F.posexplode(F.split(line, " ")).alias("pos", "token"))
    return odd.where(F.col("token").rlike(PAIR))


def tagged(found: DataFrame) -> DataFrame:
    """token, tag, example, times of different tokens with ill-formed bytes."""
    tag = F.when(F.col("token").rlike(OVERLONG), "UTF8_NON_SHORTEST").otherwise("NON_UTF8")
    return found.select("token").distinct().select("token", tag.alias("tag"), coded(F.col("token")).alias("example"), F.lit(1).cast("long").alias("times"))
