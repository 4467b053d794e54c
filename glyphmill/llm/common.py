"""What the operators of this subpackage share: stored tables and their removal, Arrow batches, counted broadcasts, joins on
keys of which some hold many rows."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Spark hands to a Python worker at once; whole texts are long.
BATCH_ROWS = 1000
#: Bytes of a batch that Spark hands to a Python worker.
BATCH_BYTES = 16 << 20
#: Bytes of a group of rows in stored tables of long rows. Without it Parquet looks at the size of a group from its hundredth row on.
LONG_ROWS = 16 << 20
#: A set of ids is broadcast up to this many rows (8 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: lookup() broadcasts at most this many rows, and counts keys with more than HOT_ROWS as hot.
BROADCAST_ROWS, HOT_ROWS = 200_000, 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a session in one process (tests) gets a
    temporary folder; a cluster gets an error, as its executors would each write to a disk of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("glyphmill.shared.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^,\]]*(,\d+)?\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder there that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='glyphmill-')}"
        spark.conf.set("glyphmill.shared.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/glyphmill-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Stored tables of one stretch of work, removed at its end: what is still needed must have been stored outside by then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, label: str, compression: str | None = None, long_rows: bool = False) -> DataFrame:
        """long_rows: of rows of up to some MB, LONG_ROWS bytes at most and a row are held by a task that writes or reads them."""
        self.paths.append(path := new_path(self.spark, label))
        options = {"parquet.block.size": LONG_ROWS, "parquet.page.size.row.check.min": 1} if long_rows else {}
        df.write.options(**options).parquet(path, compression=compression)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            removed(self.spark, path)
        self.paths.clear()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it Spark removes a query's shuffle files as soon as the query has ended, so that stored steps don't add theirs up."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def long_batches(spark: SparkSession, rows: int = 100_000) -> Iterator[None]:
    """Within it Python workers get rows of numbers and words in batches of so many (BATCH_BYTES at most); for stages without whole texts."""
    small_batches(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def lookup(left: DataFrame, right: DataFrame, key: str, size: str) -> DataFrame:
    """left.join(right, key), where right (stored) has one row a key and in size the key's rows in left. A small right side is
    broadcast. Of a larger one only hot keys are, those with more than HOT_ROWS rows or more than a BROADCAST_ROWSth of all;
    so they are BROADCAST_ROWS at most, and no task gets all rows of a hot key."""
    found = right.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("rows")).first()
    if found.n <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key)
    hot = right.where(F.col(size) > max(HOT_ROWS, found.rows // BROADCAST_ROWS))
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right, key)
    return cold.unionByName(left.join(F.broadcast(hot), key))


def small_batches(spark: SparkSession) -> None:
    """Keeps batches of whole texts small in Python workers, by rows and by bytes. Both are settings of the session and stay; lower
    ones of the caller's are left."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size, "256m")) > BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


def over_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(work, schema)


def with_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in ids (one column named key, distinct). ids is broadcast only if its counted size is in bounds."""
    bounded = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if bounded else ids, key, "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is not in ids, as with_ids."""
    bounded = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if bounded else ids, key, "left_anti")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of its names."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_of_id(col: Column) -> Column:
    """crc32 of an id written as text; null for null."""
    return F.crc32(col.cast("string").cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
