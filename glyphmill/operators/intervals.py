"""Range joins: points to the intervals that hold them, by equality of blocks.

An interval stands under every block of `width` numbers that it touches; a point has one block. So the join hashes or broadcasts like any
other, and its condition on both ends only drops what shares a block.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 4096


def disjoint(ranges: Iterable[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Inclusive ranges that may overlap, the earlier before the later, as sorted ranges of which each number is in one at most."""
    ranges = list(ranges)
    cuts = sorted({a for a, _, _ in ranges} | {z + 1 for _, z, _ in ranges})
    out: list[list] = []
    for a, z in zip(cuts, cuts[1:]):
        name = next((x for lo, hi, x in ranges if lo <= a <= hi), None)
        if name is not None and out and out[-1][1] == a - 1 and out[-1][2] == name:
            out[-1][1] = z - 1
        elif name is not None:
            out.append([a, z - 1, name])
    return [(a, z, name) for a, z, name in out]


def table(spark: SparkSession, ranges: Iterable[tuple[int, int, str]]) -> DataFrame:
    """low, high, name of given ranges, from one literal, so that the plan stays short."""
    rows = F.split(F.lit("\n".join(f"{a}\t{z}\t{name}" for a, z, name in ranges)), "\n")
    cells = F.split("row", "\t")
    return spark.range(1).select(F.explode(rows).alias("row")).where("row <> ''").select(cells[0].cast("long").alias("low"), cells[1].cast("long").alias("high"), cells[2].alias("name"))


def joined(points: DataFrame, intervals: DataFrame, point: str, width: int = BLOCK, how: str = "left") -> DataFrame:
    """points with the columns of every interval (low, high, others) that holds their number; how: left or inner."""
    block = "_block"
    blocks = F.sequence((F.col("low") / width).cast("long"), (F.col("high") / width).cast("long"))
    right = intervals.withColumn(block, F.explode(blocks))
    left = points.withColumn("_of", (F.col(point) / width).cast("long"))
    on = (left["_of"] == right[block]) & (right["low"] <= left[point]) & (left[point] <= right["high"])
    return left.join(right, on, how).drop("_of", block)
