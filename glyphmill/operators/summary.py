"""The line of issues of each document: letter and number scripts, controls, non-canonical forms, conflicts, flags.

facts() gives what each row holds as a small array, in one pass; issues() writes the line of each row from it, by_document() that of
the rows of an id together. Null or nothing odd: an empty line. A tatweel has its own flag and makes no letter script.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import blocks as B
from glyphmill.operators import analyze, normalize, report

FACT = "array<struct<kind: string, key: string, n: bigint, first: int>>"
#: Kinds: scripts of letters and numbers; forms that are not canonical; halves of a conflict; flags, `first` their place.
LETTER, NUMBER, FORM, CONFLICT, FLAG = "letter", "number", "form", "conflict", "flag"
MULTI = "multi-script word"
TATWEEL = "\u0640"
NO_BASE = ("SPACING_MODIFIER_LETTERS", "MODIFIER_TONE_LETTERS")


#: What unicode_blocks() found, by version of Spark and Java: constant, so it is asked for once.
_BLOCKS: dict[tuple[str, str], tuple[list[int], list[str]]] = {}


def unicode_blocks(spark: SparkSession) -> tuple[list[int], list[str]]:
    """First code points of the runs of a Unicode block, and the block's name (OTHER between blocks), from the JVM; a job, once."""
    version = spark.version, spark.range(1).select(F.java_method(F.lit("java.lang.System"), F.lit("getProperty"), F.lit("java.version"))).first()[0]
    if version not in _BLOCKS:
        _BLOCKS[version] = _unicode_blocks(spark)
    return _BLOCKS[version]


def _unicode_blocks(spark: SparkSession) -> tuple[list[int], list[str]]:
    cps = spark.range(0, 0x110000).select(F.col("id").cast("int").alias("cp"))
    name = F.java_method(F.lit("java.lang.Character$UnicodeBlock"), F.lit("of"), F.col("cp"))
    found = cps.select("cp", name.alias("name")).where("name is not null and name <> 'null'").groupBy("name").agg(F.min("cp").alias("a"), F.max("cp").alias("z")).collect()
    starts = {0: "OTHER"} | {r.z + 1: "OTHER" for r in found} | {r.a: r.name for r in found}
    order = sorted(starts)
    return order, [starts[k] for k in order]


def _scripts(spark: SparkSession):
    """Facts of scripts and of words of several scripts, of a text and its distinct words that are not ASCII."""
    order, names = unicode_blocks(spark)

    @F.pandas_udf(FACT)
    def scripts(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        memo: dict[str, tuple[str, str, str]] = {}

        def known(ch: str) -> tuple[str, str, str]:
            if ch not in memo:
                block = B.block_of(ch, names[bisect.bisect_right(order, ord(ch)) - 1])
                memo[ch] = (*B.kind_of(ch, block), B.script_of(block))
            return memo[ch]

        def mixed(word: str) -> bool:
            return len({s for ch in word if ch.isalpha() and (s := known(ch)[2]) not in NO_BASE}) >= 2

        def facts(text: str | None, words) -> list[dict]:
            out: dict[tuple[str, str], list[int]] = {}
            for ch, n in Counter(text or "").items():
                kind, script, _ = known(ch)
                if kind in (LETTER, NUMBER) and ch != TATWEEL:
                    x = out.setdefault((kind, script), [0, ord(ch)])
                    x[0], x[1] = x[0] + n, min(x[1], ord(ch))
            found = [{"kind": k, "key": s, "n": n, "first": cp} for (k, s), (n, cp) in out.items()]
            if words is not None and any(map(mixed, words)):
                found.append({"kind": FLAG, "key": MULTI, "n": 1, "first": len(report.FLAGS)})
            return found

        for texts, words in parts:
            yield pd.Series([facts(t, w) for t, w in zip(texts, words)])

    return scripts


def _forms(c: Column) -> Column:
    """The letters, and letters with marks, that are not in their canonical form, as often as they occur."""
    steps = {s.name: s.apply for s in normalize.STEPS}

    def canonical(x: Column, names: list[str]) -> Column:
        return x if not names else normalize.let(steps[names[0]](x), lambda y: canonical(y, names[1:]))

    found = F.concat(F.regexp_extract_all(c, F.lit(analyze.COMPLEX), F.lit(0)), F.regexp_extract_all(c, F.lit(r"[\p{L}&&[^\x{0}-\x{7F}]]"), F.lit(0)))
    names = [s for _, s in report.CANON]
    return normalize.let(F.filter(F.array_distinct(found), lambda x: canonical(x, names) != x), lambda odd: F.filter(found, lambda x: F.array_contains(odd, x)))


def facts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df with _facts."""
    c = F.col(text_col)

    def fact(kind: str, key: Column, first: int = 0) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(1).cast("long").alias("n"), F.lit(first).alias("first"))

    held = [F.when(c.contains(ch), fact(CONFLICT, F.lit(ch))) for ch in "كکيی"] + [F.when(c.rlike(p), fact(FLAG, F.lit(name), k)) for k, (p, name) in enumerate(report.FLAGS)]
    words = F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(analyze.WORD), F.lit(0)), lambda w: w.rlike("[^A-Za-z]")))
    forms = F.coalesce(F.transform(_forms(c), lambda x: fact(FORM, x)), F.array().cast(FACT))
    return df.withColumn("_facts", F.concat(_scripts(df.sparkSession)(c, words), F.filter(F.array(*held), lambda x: x.isNotNull()), forms))


def line(found: Column) -> Column:
    """The line of issues of facts."""

    def of(kind: str) -> Column:
        return F.filter(found, lambda x: x["kind"] == kind)

    def counted(n: Column, noun: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))

    def scripts(kind: str) -> Column:
        """Names by falling count, then by the least character."""
        ranked = F.array_sort(F.transform(of(kind), lambda x: F.struct((-x["n"]).alias("n"), x["first"].alias("first"), x["key"].alias("key"))))
        return F.transform(ranked, lambda x: x["key"])

    def several(kind: str) -> Column:
        usual = F.array(F.lit("ASCII_DIGIT"), F.lit("VULGAR_FRACTION"))
        return normalize.let(scripts(kind), lambda s: F.when((F.size(s) >= 2) & (s != usual), F.concat(counted(F.size(s), f"{kind} script"), F.lit(": "), F.array_join(s, ", "))))

    forms, keys = of(FORM), F.transform(of(CONFLICT), lambda x: x["key"])
    kinds = F.size(F.array_distinct(F.transform(forms, lambda x: x["key"])))
    instances = F.aggregate(forms, F.lit(0).cast("long"), lambda n, x: n + x["n"])
    both = sum(((F.array_contains(keys, a) & F.array_contains(keys, b)).cast("int") for a, b in ("كک", "يی")), F.lit(0))
    flags = F.array_distinct(F.transform(F.array_sort(F.transform(of(FLAG), lambda x: F.struct(x["first"].alias("first"), x["key"].alias("key")))), lambda x: x["key"]))
    controls = ("C0_CONTROL", "C1_CONTROL")
    non_canonical = F.when(kinds > 0, F.concat(counted(kinds, "non-canonical character combination"), F.lit(" ("), counted(instances, "instance"), F.lit(")")))
    return F.concat_ws("; ", several(LETTER), several(NUMBER), F.filter(flags, lambda x: x.isin(*controls)), non_canonical, F.when(both > 0, counted(both, "character set conflict")), F.filter(flags, lambda x: ~x.isin(*controls)))


def issues(df: DataFrame, by: str = "doc_id", text_col: str = "text") -> DataFrame:
    """by, issues: the line of each row, without a shuffle."""
    return facts(df.select(by, text_col), text_col).select(by, F.explode(F.array("_facts")).alias("_facts")).select(by, line(F.coalesce("_facts", F.array().cast(FACT))).alias("issues"))


def by_document(df: DataFrame, by: str = "doc_id", text_col: str = "text") -> DataFrame:
    """by, issues: the line of all rows of an id together, for documents in lines; ids without issues too."""
    one = facts(df.select(by, text_col), text_col).select(by, F.explode_outer("_facts").alias("x")).groupBy(by, "x.kind", "x.key").agg(F.sum("x.n").alias("n"), F.min("x.first").alias("first"))
    found = one.groupBy(by).agg(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "key", "n", "first"))).alias("_facts"))
    return found.select(by, line(F.col("_facts")).alias("issues"))
