"""Token-ID output (4): best-fit-decreasing packing with segment-tree search, written as packed id matrices.

write(docs) tokenizes each document where it is scanned, cuts documents longer than a window into whole windows and a
rest, sorts the pieces of a buffer (BUFFER ids at most, or one document) by length, longest first, and places each in the window whose
room is least but enough. A segment tree over the room left (1 ... size) finds it in log2(size) steps.

Each buffer becomes one matrix file in the shared folder (raw little-endian unsigned ids, rows of `size`, padded with PAD), 16
bits wide if the vocabulary allows, else 32; the table returned has a row per sequence: file, row, cumulative segment
lengths, the documents and starts of its segments, and the places where positions begin anew. No id is lost or repeated.
File names are new for each attempt, so a task that runs again leaves at most an unused file.

Cases. Null text: as empty (the end id alone). Null doc_id: packed with a null. Repeated rows: a document each. Ties in
length: in order of arrival. Very long texts: split over rows of the matrix. Empty table: no rows, no files. Other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import new_path, over_batches, stored
from glyphmill.llm.tokens import END, Encoder

WINDOW, BUFFER, PAD = 2048, 4_000_000, 0
SCHEMA = "file string, row int, width int, n_tokens int, cu_seqlens array<int>, doc_ids array<long>, doc_starts array<long>, position_resets array<int>, ids_crc32 long"


class Rooms:
    """A segment tree over rooms 0 ... size: which of them some window has."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def _change(self, room: int, by: int) -> None:
        k = room + self.leaves
        while k:
            self.tree[k] += by
            k >>= 1

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) of least room of need or more; it leaves the tree."""
        tree, k = self.tree, need + self.leaves
        while not tree[k]:  # climb to the next subtree on the right that is not empty
            while k & 1:
                k >>= 1
                if k <= 1:
                    return None
            k += 1
        while k < self.leaves:
            k = 2 * k if tree[2 * k] else 2 * k + 1
        room = k - self.leaves
        self._change(room, -1)
        return room, self.windows[room].pop()


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Windows of piece numbers, by best fit decreasing."""
    rooms, out = Rooms(size), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = rooms.take(lengths[k])
        room, w = found if found else (size, len(out))
        if not found:
            out.append([])
        out[w].append(k)
        if room > lengths[k]:
            rooms.add(room - lengths[k], w)
    return out


def write(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, tokenizer: str | None = None, end: int | None = END, buffer: int = BUFFER) -> DataFrame:
    """Writes the matrices now; a row per sequence."""
    folder = new_path(docs.sparkSession, "packed")
    types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64())
    schema = pa.schema(list(zip((x.split()[0] for x in SCHEMA.split(", ")), types)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, end)
        kind = "<u2" if encoder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        store, path = fs.FileSystem.from_uri(folder)
        pieces: list[tuple[int | None, int, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            name = f"{uuid.uuid4().hex}.ids"
            packed = best_fit([len(p[2]) for p in pieces], size)
            matrix = np.full((len(packed), size), PAD, kind)
            rows = []
            for r, ks in enumerate(packed):
                ends = np.cumsum([0, *(len(pieces[k][2]) for k in ks)]).tolist()
                matrix[r, : ends[-1]] = np.concatenate([pieces[k][2] for k in ks])
                rows.append((f"{folder}/{name}", r, matrix.itemsize, ends[-1], ends, [pieces[k][0] for k in ks], [pieces[k][1] for k in ks], ends[:-1], zlib.crc32(matrix[r, : ends[-1]].astype("<u4").tobytes())))
            store.create_dir(path, recursive=True)
            with store.open_output_stream(f"{path}/{name}", compression=None) as f:
                f.write(matrix.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        held = 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encoder.ids(text)
                if pieces and held + len(ids) > buffer:
                    yield from flush()
                    pieces, held = [], 0
                pieces += [(doc, a, ids[a : a + size].astype(kind)) for a in range(0, len(ids), size)]
                held += len(ids)
        if pieces:
            yield from flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(over_batches(rows, work, SCHEMA), "sequences")


def load(file: str, width: int, size: int = WINDOW) -> np.ndarray:
    """The matrix of a file."""
    store, path = fs.FileSystem.from_uri(file)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), f"<u{width}").reshape(-1, size)
