"""SQL functions of normalization: Column expressions written as SQL and registered, so that a query's plan holds the expression itself.

register(spark) makes, for the session, `glyphmill_default(text)`, `glyphmill_all(text)`, and a function for each step by its name,
`glyphmill_space(text)` for the step space. Nothing runs in Python; null stays null.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import normalize

PREFIX = "glyphmill_"
#: An array of string literals alone, as Spark writes it: taken as it is, in one call.
STRINGS = re.compile(r"array\((?:'(?:[^'\\]|\\[\s\S])*'(?:, (?=')|(?=\))))+\)")


def _each(seq) -> Iterable:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def sql_of(node) -> str:
    """The SQL of a Column's node. Function names are quoted, so that operators can be written as functions."""
    kind = node.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        if node.functionName() == "array" and STRINGS.fullmatch(text := node.sql()):
            return text
        return f"`{node.functionName()}`({', '.join(map(sql_of, _each(node.arguments())))})"
    if kind == "LambdaFunction":
        names = [a.name() for a in _each(node.arguments())]
        return f"{names[0] if len(names) == 1 else '(' + ', '.join(names) + ')'} -> {sql_of(node.function())}"
    if kind == "UnresolvedNamedLambdaVariable":
        return node.name()
    if kind == "CaseWhenOtherwise":
        whens = " ".join(f"WHEN {sql_of(b._1())} THEN {sql_of(b._2())}" for b in _each(node.branches()))
        other = f" ELSE {sql_of(node.otherwise().get())}" if node.otherwise().isDefined() else ""
        return f"CASE {whens}{other} END"
    if kind == "Cast":
        return f"CAST({sql_of(node.child())} AS {node.dataType().sql()})"
    if kind == "Alias":
        return sql_of(node.child())
    if kind == "UnresolvedExtractValue":
        return f"{sql_of(node.child())}[{sql_of(node.extraction())}]"
    if kind in ("Literal", "UnresolvedAttribute"):
        return node.sql()
    raise ValueError(f"no SQL for {kind}")


def function(spark: SparkSession, name: str, body: Column) -> None:
    """Registers name(text STRING) for the session; body is an expression of the column text."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS STRING RETURN {sql_of(body._jc.node())}")


def register(spark: SparkSession, names: Iterable[str] | None = None, lang: str = "") -> list[str]:
    """Registers presets (default, all) and steps, all of them without names; returns the functions' names. lang is the language of
    the text, as for normalize()."""
    made = []
    for name in ["default", "all", *normalize.NAMES] if names is None else names:
        if name not in ("default", "all", *normalize.NAMES):
            raise ValueError(f"no preset or step {name}")
        steps = normalize.chosen(name) if name in ("default", "all") else frozenset([name])
        made.append(PREFIX + name.replace("-", "_"))
        function(spark, made[-1], normalize.normalize(F.col("text"), steps, lang))
    return made
