"""Streams: normalization is row by row; counts are kept as state, by window of event time where there is one. Tables that a stream
keeps up to date are written by foreachBatch, a version a batch: a batch that is run again writes the same version again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphmill.operators import normalize, report


def normalized(stream: DataFrame, steps: frozenset[str] | None = None, lang: str = "", text_col: str = "text") -> DataFrame:
    """The stream with its text normalized; append mode, no state."""
    return stream.withColumn(text_col, normalize.normalize(F.col(text_col), steps, lang))


def char_counts(stream: DataFrame, text_col: str = "text", time_col: str | None = None, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """ch, n of the stream so far (update or complete mode); with a time column by window, closed when rows come no later than late."""
    chars = stream.select(*([time_col] if time_col else []), F.explode(F.split(text_col, "")).alias("ch")).where("ch <> ''")
    if not time_col:
        return chars.groupBy("ch").agg(F.count("*").alias("n"))
    return chars.withWatermark(time_col, late).groupBy(F.window(time_col, window), "ch").agg(F.count("*").alias("n"))


def kept(counts: DataFrame, path: str) -> StreamingQuery:
    """Starts a stream of what is there at once that keeps its whole result (complete mode) as a table at path/table."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table")

    return counts.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()


def character_examples(stream: DataFrame, path: str, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> StreamingQuery:
    """Starts a stream that keeps ch, n, ex (the first k ids that hold it) of all rows so far, as report.char_examples gives them; see
    seen_examples. The state has a row a different character with k ids at most, and the first ids are the same in whatever order
    files come. A version holds what the one before it and its batch give."""

    def merge(batch: DataFrame, number: int) -> None:
        new = report.char_examples(batch, k, id_col, text_col).select("ch", "n", "ex")
        if number:
            new = new.unionByName(batch.sparkSession.read.parquet(f"{path}/{number - 1}"))
        first = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ex")))), 1, k)
        new.groupBy("ch").agg(F.sum("n").alias("n"), first.alias("ex")).write.mode("overwrite").parquet(f"{path}/{number}")

    return stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(merge).start()


def seen_examples(query: StreamingQuery, spark: SparkSession, path: str) -> DataFrame:
    """The table of the last batch of a character_examples() that has ended."""
    return spark.read.parquet(f"{path}/{query.lastProgress.batchId}")
