"""Fill-in-middle transformation (12): a constant-memory matcher of two passes cuts texts at two ranks of their units.

transformed(docs) returns one row per document row: doc_id, n, form, prefix_chars, middle_chars, output.

A unit is a run of white space with the run of other characters after it, or white space at the end of the text. Four numbers of
32 bits come from the SHA-256 of `seed:doc_id`: two ranks among the n + 1 places between units, whether the text is cut, and the
order of its parts. The first pass counts the units by running a lazy match iterator to its end; the second advances a new one to
the lower rank, notes the offset, goes on to the upper rank and stops. Neither keeps a unit: beside the text a task holds one match.
Rows are independent, so nothing is shuffled, no row waits for another, and a lost executor costs its own partitions alone.

restored(rows) rebuilds the text from output and form by JVM expressions: as no cut text holds a marker, and a marker can't begin
in the text and end in a marker, each stands once.

Cases. Null or empty text: n 0, plain, empty output. A text with a marker of its own: plain. White space alone: one unit.
Null doc_id: numbers of `seed:`. Repeated rows: a row each, equal values; ids that clash: equal numbers, ranks by each text.
Equal ranks: an empty middle. Very long texts: two scans, no list of units; the output is as long as the text and three markers, and
must be under Arrow's 2 GB a value. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import over_batches

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are cut; of 100 cut ones so many have their suffix first.
SEED, CUT, SUFFIX_FIRST = 42, 50, 80
FIELDS = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]


def numbers(seed: int, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def ends(text: str, low: int, high: int) -> tuple[int, int]:
    """Offsets after the first low and the first high units, in one pass that stops there."""
    units = UNIT.finditer(text)

    def advanced(steps: int, at: int) -> int:
        return next(islice(units, steps - 1, None)).end() if steps else at

    first = advanced(low, 0)
    return first, advanced(high - low, first)


def cut(text: str, doc_id: int | None, seed: int, rate: int, suffix_first: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, characters of prefix and of middle, output of one text."""
    n = sum(1 for _ in UNIT.finditer(text))
    a, b, c, d = numbers(seed, doc_id)
    if not text or c % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    x, y = sorted((a % (n + 1), b % (n + 1)))
    x, y = ends(text, x, y)
    if d % 100 < suffix_first:
        return n, "spm", x, y - x, f"{SUFFIX}{text[y:]}{PREFIX}{text[:x]}{MIDDLE}{text[x:y]}"
    return n, "psm", x, y - x, f"{PREFIX}{text[:x]}{SUFFIX}{text[y:]}{MIDDLE}{text[x:y]}"


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output per row of docs."""
    schema = pa.schema(FIELDS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k.as_py(), *cut(t.as_py() or "", k.as_py(), seed, rate, suffix_first)) for k, t in zip(b.column(0), b.column(1))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return over_batches(rows, work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text that a form's output was made of."""

    def after(c: Column, marker: str) -> Column:
        return F.substr(c, F.locate(marker, c) + len(marker))

    def before(c: Column, marker: str) -> Column:
        return F.substring_index(c, marker, 1)

    middle = after(output, MIDDLE)
    psm = F.concat(before(after(output, PREFIX), SUFFIX), middle, before(after(output, SUFFIX), MIDDLE))
    spm = F.concat(before(after(output, PREFIX), MIDDLE), middle, before(after(output, SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(rows: DataFrame) -> DataFrame:
    """Of transformed rows: doc_id, n, form, prefix_chars, middle_chars, and digests of the output and of the text rebuilt from it."""
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))
