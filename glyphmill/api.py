"""The library's two objects: a Normalizer is a choice of steps, an Analysis is what there is to say about numbered lines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import register
from glyphmill.operators import changelog, normalize, summary, tags
from glyphmill.plans import cases


class Normalizer:
    """Steps, a language, and tables of one's own; add beats skip. Use it on a column, on a table's column, or for SQL."""

    def __init__(self, base: str = "default", add: Iterable[str] = (), skip: Iterable[str] = (), lang: str = "", look_alikes: Iterable[str] | None = None, table: dict[str, str] | None = None):
        if unknown := ({*add, *skip} - {*normalize.NAMES, "del-surrogate"}):
            raise ValueError(f"unknown steps: {', '.join(sorted(unknown))}")
        self.steps = normalize.chosen(base, add, skip)
        self.lang = {"fa": "fas"}.get(lang, lang)
        self.look_alikes = None if look_alikes is None else list(look_alikes)
        self.table = table

    def column(self, text: Column | str) -> Column:
        text = F.col(text) if isinstance(text, str) else text
        return normalize.normalize(text, self.steps, self.lang, self.look_alikes, self.table)

    def table_of(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """df with the column normalized; all others stay."""
        return df.withColumn(text_col, self.column(df[text_col]))

    def log(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """The change log of these steps over the column."""
        return changelog.change_log(df, self.steps, self.lang, text_col, self.look_alikes, self.table)

    def first_lines(self, df: DataFrame, text_col: str = "text", no_col: str = "line_no", k: int = 20) -> DataFrame:
        """step, lines: the first lines that each step changes."""
        return changelog.first_lines(df, self.steps, self.lang, text_col, no_col, k, self.look_alikes)

    def unchanged_words(self, df: DataFrame, text_col: str = "text", k: int = 100) -> DataFrame:
        """word, n: the most frequent mixed words that stay as they are."""
        return changelog.unchanged_words(df, self.steps, self.lang, text_col, k, self.look_alikes)

    def register(self, spark: SparkSession, name: str) -> None:
        """Makes name(text) an SQL function of the session."""
        register.function(spark, name, self.column("text"))


class Analysis:
    """Of lines (line_no, text). Tables by section are lazy; document, report and summary bring bounded rows to the driver."""

    def __init__(self, lines: DataFrame, examples: int = 5, cases: int = 100):
        self.lines, self.examples, self.cases = lines, examples, cases

    @classmethod
    def of_strings(cls, spark: SparkSession, *strings: str, **options) -> Analysis:
        """Of given strings, each a line."""
        return cls(spark.createDataFrame([(k, s) for k, s in enumerate(strings, 1)], "line_no long, text string"), **options)

    def sections(self) -> dict[str, DataFrame]:
        return cases.sections(self.lines, self.examples)

    def document(self) -> dict:
        return cases.nested(self.lines, self.examples)

    def report(self, refs: dict[int, str] | None = None) -> str:
        return cases.written(cases.nested(self.lines, self.examples, self.cases), self.cases, refs)

    def summary(self) -> DataFrame:
        """The line of issues of each row."""
        return summary.issues(self.lines.withColumnRenamed("line_no", "doc_id"))

    def tags(self, lang: str = "") -> DataFrame:
        return tags.issues(self.lines.withColumnRenamed("text", "line"), lang)
