"""The change log of a normalization: lines in all and changed, and per step calls and changed lines, in one pass.

A step is called on a line where its gate, tested on the original, is open, and counts as a change where the line differs before
and after it; the steps before it have been applied. Trailing spaces, which go at the end, are no change. Null texts are no lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.functions import masks
from glyphmill.operators import lookalike, normalize

#: What becomes of mixed words, in the order of the printed log.
OUTCOMES = ("to-Latin", "to-Cyrillic", "to-Greek", "split", "unchanged")
ALL = "all"
WORDS = "array<struct<word: string, kind: string>>"


def _after(s: normalize.Step, gate: Column, rows: Iterable[str] | None) -> Callable[[Column], Column]:
    """The state after a step, of the state before it."""

    def after(was: Column) -> Column:
        kinds = F.when(gate, lookalike.outcomes(was["t"], rows)).otherwise(was["k"]) if s.name == "look-alike" else was["k"]
        new = F.when(gate, s.apply(was["t"])).otherwise(was["t"])
        return normalize.let(new, lambda y: F.struct(y.alias("t"), F.concat(was["c"], F.array(y != was["t"])).alias("c"), kinds.alias("k")))

    return after


def _logged(text: Column, steps: list[normalize.Step], gates: Column, rows: Iterable[str] | None) -> Column:
    """t: the text after the steps, c: whether each of them changed it, k: what became of mixed words."""
    out = F.struct(text.alias("t"), F.array().cast("array<boolean>").alias("c"), F.array().cast(WORDS).alias("k"))
    for k, s in enumerate(steps):
        out = normalize.let(out, _after(s, F.get(gates, F.lit(k)), rows))
    return out


def _of_kind(outcome: str) -> Column:
    return F.filter("x.k", lambda w: w["kind"] == outcome)


def _states(df: DataFrame, steps: frozenset[str] | None, lang: str, text_col: str, look_alikes: Iterable[str] | None, table: dict[str, str] | None = None, no_col: str | None = None, k: int = 0) -> tuple[DataFrame, list[normalize.Step]]:
    """_text (a line's words that steps may change), g (which gates of the line are open), x (what the steps make of _text), n (how many
    lines have these words and classes of characters) and the enabled steps. With no_col, of lines that hold such words alone: nos, the
    first k numbers of these lines, in place of n.

    Lines of the same words and classes go through the steps once. A mapping table sees whole lines, which go through one by one."""
    enabled = normalize.DEFAULT if steps is None else steps
    chosen = [s for s in normalize.with_look_alikes(look_alikes) if s.name in enabled or s.name in normalize.ALWAYS]
    chosen += [normalize.mapping(table)] if table else []
    text, key = F.col(text_col), ("_m", "_text")
    asked = frozenset().union(*(s.opens.classes for s in chosen))
    words = text if table else normalize.collapsed(text, chosen)
    lines = df.where(text.isNotNull()).select(words.alias("_text"), masks.mask(text, asked).alias("_m"), *([F.col(no_col).alias("_no")] if no_col else []))
    if no_col:
        first = lines.where(~normalize.nothing_odd(F.col("_text"))).withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("_no"))).where(F.col("_r") <= k)
        lines = first.groupBy(*key).agg(F.collect_list("_no").alias("nos"))
    elif table:
        lines = lines.withColumn("n", F.lit(1).cast("long"))
    else:
        lines = lines.groupBy(*key).agg(F.count("*").alias("n"))
    # Few rows are much work here, so they are dealt to all cores.
    lines = lines if table else lines.repartition(df.sparkSession.sparkContext.defaultParallelism)
    # Exploded, so that the plan repeats neither the gates nor the steps.
    gates = F.array(*[s.opens(F.col("_m"), lang) for s in chosen])
    rest = ("_text", "nos" if no_col else "n")
    opened = lines.select(*rest, F.explode(F.array(gates)).alias("g"))
    logged = _logged(F.col("_text"), chosen, F.col("g"), look_alikes)
    if not table:
        logged = F.when(normalize.nothing_odd(F.col("_text")), F.struct(F.col("_text").alias("t"), F.array_repeat(F.lit(False), len(chosen)).alias("c"), F.array().cast(WORDS).alias("k"))).otherwise(logged)
    return opened.select(*rest, "g", F.explode(F.array(logged)).alias("x")), chosen


def first_lines(df: DataFrame, steps: frozenset[str] | None = None, lang: str = "", text_col: str = "text", no_col: str = "line_no", k: int = 20, look_alikes: Iterable[str] | None = None) -> DataFrame:
    """step, lines: the first k lines (by no_col) that each step changes; steps that change none have no row. Spark keeps a step's first k
    of each task before they are shuffled."""
    states, chosen = _states(df, steps, lang, text_col, look_alikes, no_col=no_col, k=k)
    names = F.array(*[F.lit(s.name) for s in chosen])
    changed = states.select("nos", F.explode(F.filter(names, lambda _, i: F.get("x.c", i))).alias("step")).select("step", F.explode("nos").alias("line_no"))
    first = changed.withColumn("r", F.row_number().over(Window.partitionBy("step").orderBy("line_no"))).where(F.col("r") <= k)
    return first.groupBy("step").agg(F.array_sort(F.collect_list("line_no")).alias("lines"))


def unchanged_words(df: DataFrame, steps: frozenset[str] | None = None, lang: str = "", text_col: str = "text", k: int = 100, look_alikes: Iterable[str] | None = None) -> DataFrame:
    """word, n: the k most frequent mixed words that look-alike leaves as they are, equal ones by the word."""
    states, _ = _states(df, steps, lang, text_col, look_alikes)
    words = states.select("n", F.explode(_of_kind("unchanged")).alias("w")).groupBy(F.col("w.word").alias("word")).agg(F.sum("n").alias("n"))
    return words.orderBy(F.desc("n"), "word").limit(k)


def change_log(df: DataFrame, steps: frozenset[str] | None = None, lang: str = "", text_col: str = "text", look_alikes: Iterable[str] | None = None, table: dict[str, str] | None = None) -> DataFrame:
    """place, step, n_calls, n_changed: first `all` (lines, changed lines), then the enabled steps in order of application and, with a
    mapping table, `mapping`; after look-alike its words by outcome (n_calls: mixed words seen, n_changed: those with this outcome)."""
    states, chosen = _states(df, steps, lang, text_col, look_alikes, table)

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c.cast("long") * F.col("n")), F.lit(0))

    sums = [(ALL, total(F.lit(1)), total(F.col("x.t") != F.col("_text")))]
    for k, s in enumerate(chosen):
        sums.append((s.name, total(F.get("g", F.lit(k))), total(F.get("x.c", F.lit(k)))))
        if s.name == "look-alike":
            sums += [(f"look-alike {o}", total(F.size("x.k")), total(F.size(_of_kind(o)))) for o in OUTCOMES]
    one = states.agg(*[c.alias(f"{k}{p}") for p, (_, calls, changed) in enumerate(sums) for k, c in (("n", calls), ("c", changed))])
    rows = F.array(*[F.struct(F.lit(p).alias("place"), F.lit(name).alias("step"), F.col(f"n{p}").alias("n_calls"), F.col(f"c{p}").alias("n_changed")) for p, (name, _, _) in enumerate(sums)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def printed(log: DataFrame) -> str:
    """The log as one line: steps that changed something, look-alike with its words by outcome."""
    rows = {r.step: r for r in log.orderBy("place").collect()}

    def lines(n: int) -> str:
        return "line" if n == 1 else "lines"

    out = f"{rows[ALL].n_changed} out of {rows[ALL].n_calls} {lines(rows[ALL].n_changed)} changed"
    for name in (*normalize.NAMES, "mapping"):
        if name in rows and (n := rows[name].n_changed):
            out += f"; {name} in {n}/{rows[name].n_calls} {lines(n)}"
            if name == "look-alike":
                out += f" ({'/'.join(str(rows[f'look-alike {o}'].n_changed) for o in OUTCOMES)} L/C/G/S/-)"
    return out
