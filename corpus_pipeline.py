"""A corpus pipeline of five stages over documents: language ID, toxicity, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents. run() writes each stage's rows as Parquet in the shared folder and reads them for the next.

Cases. Null or repeated ids reject no row: near-dedup keeps one row of each group of copies, whatever their ids. Null or letter-less
texts go at language ID. Extra columns stay, whatever their names. Empty table: no rows. Ties: of rows equal in id and text, the
first by its columns as JSON stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import decontam, langid, minhash, packing, toxicity
from glyphmill.llm.common import Scratch, fresh, lookup, removed, small_batches, stored, table, with_ids, without_ids

#: Near copies share 80 % of their five-word shingles; op10 has values of its own.
SHINGLE_WORDS, LEAST_PERCENT = 5, 80
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the learned languages go: no letter, or far from every centroid."""
    small_batches(spark)
    model = langid.fit(docs, learn=~langid.held_out())
    return docs.where(~langid.predicted(model, F.col("text"))["rejected"])


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    small_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=~toxicity.held_out("id"))
    return docs.where(toxicity.scored(model, F.col("text")) < 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that of the least doc_id, null ids last. What is compared is rows, by a key of id
    and text, so that ids that clash or are null join nothing; rows equal in both are one.

    Texts meet one list of keys, those that go or stand several times; it is broadcast if its counted size is in bounds, else
    the texts are shuffled once."""
    key = fresh(docs, "_key")
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id"), F.col("text")))
    found = minhash.components(keyed, id_col=key, width=SHINGLE_WORDS, percent=LEAST_PERCENT)
    with Scratch(spark) as s:
        groups = found.groupBy(F.col("doc_id").alias("key")).agg(F.min("component_id").alias("group"))
        rows = s.stored(keyed.groupBy(F.col(key).alias("key")).agg(F.min("doc_id").alias("id"), F.count("*").alias("n")).join(groups, "key"), "rows")
        best = rows.groupBy("group").agg(F.count("*").alias("m"), F.min(F.struct(F.col("id").isNull().alias("x"), "id", "key")).alias("b")).where("m > 1").select("group", "m", F.col("b.key").alias("best"))
        gone = s.stored(lookup(rows, s.stored(best, "best"), "group", "m").where("key <> best").select("key"), "gone")
        again = rows.where("n > 1").join(gone, "key", "left_anti").select("key", F.lit(True).alias("again"))
        touched = stored(gone.select("key", F.lit(False).alias("again")).unionByName(again), "touched")
    for path in found.inputFiles()[:1]:
        removed(spark, path.rpartition("/")[0])
    again = touched.where("again").select(F.col("key").alias(key))
    left = without_ids(keyed, touched.select(F.col("key").alias(key)), key).select(docs.columns)
    if again.isEmpty():
        return left
    row = F.struct(*[docs[c] for c in docs.columns])
    several = with_ids(keyed, again, key).groupBy(key).agg(F.min_by(row, F.to_json(row)).alias("r")).select("r.*")
    return left.unionByName(several)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, in windows."""
    return packing.digests(packing.pack(docs))


STAGES = [("language ID", language_id), ("toxicity", toxicity_filter), ("near-dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]
#: Language ID, toxicity and packing can't be expressed in SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return docs
