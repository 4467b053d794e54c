"""Packing (9): sum-of-squares online packing of documents into fixed windows.

pack(docs) tokenizes each document once, where its rows are scanned (no shuffle), and places it online: of all fill
levels that still have room, and a new window, it takes the one after which the sum of the squared numbers of partly
filled windows per level is least. A level array holds those numbers, and a stack per level the windows. A document
longer than a window is first cut into whole windows; its rest is placed as any other.

When a partition ends, the windows still open are closed with little padding: pieces of the emptiest are cut to fill the
fullest, so that at most one is left, and that one is cut at powers of two, lengths that need no padding.

Every id lies in exactly one piece. Each task holds open windows only (their pieces' ids); the number of windows open at
once stays small since the squares are minimised. A task that runs again gives the same rows: its scan order is fixed.

Cases. Null text: as empty, that is the end id alone. Null doc_id: packed, with a null doc_id. Repeated rows: each row is a
document of its own. Very long texts: cut into pieces in one task. Empty table: no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import over_batches
from glyphmill.llm.tokens import END, Encoder

WINDOW = 2048
#: sequence_id: the partition times this, plus the window's number there.
STRIDE = 1 << 40
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, `offset` long"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
#: (doc_id, start in the document, ids, document's ids)
Piece = tuple[int | None, int, np.ndarray, int]


class SumOfSquares:
    """Online packing of one stream. close(pieces) is called for each window as it is full."""

    def __init__(self, size: int = WINDOW):
        self.size = size
        self.count = np.zeros(size + 1, dtype=np.int64)  # open windows by fill level
        self.open: list[list[list[Piece]]] = [[] for _ in range(size + 1)]

    def best(self, length: int) -> int:
        """The level to place a piece on; 0 is a new window."""
        c, last = self.count, self.size - length  # last: the fullest level that has room
        change = np.empty(last + 1, dtype=np.float64)
        to = c[length : self.size + 1].astype(np.float64)  # at index h: windows at level h + length
        change[:] = 2 * to + 1 - 2 * c[: last + 1] + 1
        change[0] = 2 * to[0] + 1
        change[last] = -2 * c[last] + 1 if last else 0  # a full window leaves the array
        change[1:][c[1 : last + 1] == 0] = np.inf
        return int(np.flatnonzero(change == change.min())[-1])  # of equals the fullest

    def place(self, piece: Piece) -> list[Piece] | None:
        """Places a piece of at most a window; returns the window if it is full now."""
        n = len(piece[2])
        if n == self.size:
            return [piece]
        h = self.best(n)
        window: list[Piece] = []
        if h:
            window = self.open[h].pop()
            self.count[h] -= 1
        window.append(piece)
        if h + n == self.size:
            return window
        self.open[h + n].append(window)
        self.count[h + n] += 1
        return None

    def finish(self) -> Iterator[list[Piece]]:
        """Closes what is open: the emptiest windows are poured into the fullest, the last is cut at powers of two."""
        left = [w for level in reversed(self.open) for w in level]  # fullest first
        pour: list[Piece] = []
        while left:
            window = left.pop(0)
            room = self.size - sum(len(p[2]) for p in window)
            while room and (pour or left):
                if not pour:
                    pour = left.pop()
                piece = pour.pop()
                window.append(cut(piece, 0, min(room, len(piece[2]))))
                if len(piece[2]) > room:
                    pour.append(cut(piece, room, len(piece[2])))
                room -= len(window[-1][2])
            if not left and pour:
                left, pour = [pour], []
            if room == 0:
                yield window
            else:
                yield from powers(window)


def cut(piece: Piece, a: int, b: int) -> Piece:
    return (piece[0], piece[1] + a, piece[2][a:b], piece[3])


def powers(window: list[Piece]) -> Iterator[list[Piece]]:
    """Cuts a window into sequences whose lengths are powers of two."""
    rest = list(window)
    while total := sum(len(p[2]) for p in rest):
        room, out = 1 << (total.bit_length() - 1), []
        while room:
            piece = rest.pop(0)
            out.append(cut(piece, 0, min(room, len(piece[2]))))
            if len(piece[2]) > room:
                rest.insert(0, cut(piece, room, len(piece[2])))
            room -= len(out[-1][2])
        yield out


def windows(docs: Iterator[tuple[int | None, np.ndarray]], size: int = WINDOW) -> Iterator[list[Piece]]:
    """All windows of a stream of (doc_id, ids)."""
    packer = SumOfSquares(size)
    for doc, ids in docs:
        n = len(ids)
        for a in range(0, n, size):
            full = packer.place((doc, a, ids[a : a + size], n))
            if full:
                yield full
    yield from packer.finish()


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, tokenizer: str | None = None, end: int | None = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32 bits), doc_tokens, sequence_id, offset."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder(tokenizer, end), TaskContext.get().partitionId()

        def read() -> Iterator[tuple[int | None, np.ndarray]]:
            for b in batches:
                yield from ((i, encoder.ids(t)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))

        rows: list[tuple] = []
        for k, window in enumerate(windows(read(), size)):
            at = 0
            for doc, start, ids, n in window:
                rows.append((doc, start, len(ids), ids.tobytes(), n, part * STRIDE + k, at))
                at += len(ids)
            if len(rows) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)

    return over_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), work, SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    """The rows of pack() with a checksum in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
