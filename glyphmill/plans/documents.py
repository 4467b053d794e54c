"""Analyses of many files (or other groups of lines) in one plan: a row a group with its whole analysis as one JSON document.

Every section is computed for all groups at once, under the group's key; its bounded rows are written as JSON and joined to the
overview, one row a group and section. Nothing is collected to the driver and no group is read again. With `cases` a document
holds cases + 1 entries a heading at most; without, a document is as large as what it lists and is made in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.operators import analyze, lonebytes
from glyphmill.plans import cases as C

#: Letters that look alike, in the order of a conflict's name.
PAIRS = {"kaf": "كک", "yeh": "يی"}


def quoted(c: Column) -> Column:
    """A JSON string; null for null."""
    whole = F.to_json(F.array(c))
    return F.when(c.isNotNull(), F.substring(whole, F.lit(2), F.length(whole) - 2))


def fields(**values: Column) -> Column:
    """A JSON object of columns that are JSON already; `_` in a name stands for `-`. Null ones are left out."""
    named = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k.replace("_", "-")}":'), v)) for k, v in values.items()]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*named)), ","), F.lit("}"))


def objects(rows: DataFrame, by: Sequence[str], key: Column, value: Column, *order: Column) -> DataFrame:
    """by, json, least (key): an object for each group, of its rows' keys and values (JSON) in the given order."""
    entry = F.struct(F.struct(*(o.alias(f"o{k}") for k, o in enumerate((*order, key)))).alias("o"), F.concat(quoted(key), F.lit(":"), value).alias("e"))
    listed = F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"])
    return rows.groupBy(*by).agg(F.concat(F.lit("{"), F.array_join(listed, ","), F.lit("}")).alias("json"), F.min(key).alias("least"))


def capped(rows: DataFrame, by: Sequence[str], order: list[Column], cases: int | None) -> DataFrame:
    if cases is None:
        return rows
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= cases + 1).drop("_r")


def number(name: str) -> Column:
    return F.col(name).cast("string")


def shown(ex: str = "ex") -> Column:
    """Examples as arrays of a text and a line's number."""
    pairs = F.transform(ex, lambda x: F.concat(F.lit("["), quoted(x["text"]), F.lit(","), x["line_no"].cast("string"), F.lit("]")))
    return F.concat(F.lit("["), F.array_join(pairs, ","), F.lit("]"))


def visible(c: Column) -> Column:
    """Controls, separators and marks by their code points."""
    code = lambda ch: F.concat(F.lit("<U+"), F.when(F.length(F.hex(F.ascii(ch))) < 4, F.lpad(F.hex(F.ascii(ch)), 4, "0")).otherwise(F.hex(F.ascii(ch))), F.lit(">"))
    return F.array_join(F.transform(F.split(c, ""), lambda ch: F.when(ch.rlike(r"[\p{C}\p{Z}\p{M}]"), code(ch)).otherwise(ch)), "")


def documents(lines: DataFrame, by: Sequence[str] = ("doc_id",), k: int = 5, cases: int | None = 100, final_newline: bool = True) -> DataFrame:
    """by, document: the analysis of the lines (by, line_no, text, maybe raw; as they were read) of each group as JSON. Ill-formed
    bytes have their codes as keys in their block."""
    by = list(by)
    s = C.sections(lines, k, by)
    parts: dict[str, DataFrame] = {}
    clause = lambda f: quoted(F.coalesce(F.concat(f, F.lit(", ")), F.lit("")))
    for kind in ("letter", "number", "other"):
        mine = s["script"].where(F.col("kind") == kind)
        parts[f"{kind}-script"] = objects(mine, by, F.col("script"), fields(count=number("n"), ex=quoted(F.col("ex"))), -F.col("n"), F.col("first_char"))
    odd = fields(orig=quoted(F.col("orig")), norm=quoted(F.col("norm")), orig_count=number("orig_count"), norm_count=number("norm_count"), orig_form=clause(F.col("orig_form")), norm_form=clause(F.col("norm_form")), changes=F.to_json("changes"))
    parts["non-canonical"] = objects(s["non-canonical"], by, F.col("orig"), odd)
    names = F.create_map(*[F.lit(x) for chars in PAIRS.values() for c in chars for x in (c, analyze.name_of(c))])
    letter = fields(char=quoted(F.col("ch")), id=quoted(F.concat(F.lit("U+0"), F.hex(F.ascii("ch")))), name=quoted(names[F.col("ch")]), count=number("n"))
    pairs = s["char-conflict"].groupBy(*by, "key").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ch", letter.alias("j")))), lambda x: x["j"]), ","), F.lit("]")).alias("j"))
    title = F.create_map(*[F.lit(x) for key, chars in PAIRS.items() for x in (key, "/".join(chars))])
    parts["char-conflict"] = objects(pairs, by, title[F.col("key")], F.col("j"), F.col("key"))
    grouped = {
        "notable-token": ("heading", [F.col("token")], F.col("token"), fields(token=quoted(F.col("token")), count=number("n"), ex=shown())),
        "pattern": ("heading", [F.desc("n"), F.col("first")], F.col("pattern"), fields(pattern=quoted(visible(F.col("pattern"))), count=number("n"), ex=shown())),
        "block": ("block", [F.col("ch"), F.col("code_point")], F.when(F.col("block") == lonebytes.BLOCK, F.col("code_point")).otherwise(F.col("ch")), fields(char=quoted(F.col("ch")), id=quoted(F.col("code_point")), name=quoted(F.col("name")), count=number("n"), ex=shown())),
    }
    for name, (group, order, key, value) in grouped.items():
        rows = capped(s[name], [*by, group], order, cases)
        inner = objects(rows, [*by, group], key, value, *([F.col("first")] if name == "pattern" else []))
        place = F.coalesce(F.create_map(*[F.lit(x) for n, b in enumerate(C.BLOCK_ORDER) for x in (b, n)])[F.col("block")], F.lit(len(C.BLOCK_ORDER))) if name == "block" else F.lit(0)
        parts[name] = objects(inner, by, F.col(group), F.col("json"), place, *([F.col("least")] if name == "block" else []))
    size = s["overview"]
    head = {"n_lines": number("n_lines"), "n_characters": (F.col("n_characters") - F.lit(0 if final_newline else 1)).cast("string")}
    out = size.select(*by, F.concat_ws(",", *[F.concat(F.lit(f'"{x}":'), c) for x, c in head.items()]).alias("_json"))
    for name, part in parts.items():
        out = out.join(part.drop("least"), by, "left").select(*by, F.concat("_json", F.lit(f',"{name}":'), F.coalesce("json", F.lit("{}"))).alias("_json"))
    return out.select(*by, F.concat(F.lit("{"), "_json", F.lit("}")).alias("document"))
