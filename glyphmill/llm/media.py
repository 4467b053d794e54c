"""Media columns (8): AVI motion-JPEG.

A media column holds whole AVI files. clips(df) parses the RIFF index of each, decodes every intra frame and detects shots:
frame t opens a new shot where the difference of its histogram to that of t - 1 exceeds ADAPT standard deviations over
the mean of the last MEMORY differences (and LEAST). One row per clip, timed by the stream's rate.

stored_bytes() writes bytes as such a file without loss: baseline JPEG, quantisation 1 but for the first coefficient (8),
so that a flat block of 8 x 8 pixels is one sample. The Huffman code gives the difference categories 8 ... 0 codes of
1 ... 9 bits, which with the category's bits makes 9 bits for any difference, and one bit ends the block: 10 bits a
sample, written and read by whole arrays. Any baseline decoder shows the same samples. Frames of other writers are decoded
by the general path (baseline, Huffman, any sampling, restart intervals; tables in the frame).

Cases. Null bytes or text: as empty. A file that cannot be parsed: one row with error set, by clips(). Empty table: no
rows. Equal bytes, equal values, so repeated rows too. Null ids: a null id. Very long texts: a film is held whole in one task and must
be under Arrow's 2 GB a value (about 1.7 GB of text). Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import over_batches

#: A frame has SIDE * SIDE blocks; frames a second; histogram bins.
SIDE, RATE, BINS = 32, 25, 32
FRAME = SIDE * SIDE
ADAPT, LEAST, MEMORY = 3.0, 0.25, 12
#: The order in which a block's coefficients are stored.
ZIGZAG = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def head(side_y: int) -> bytes:
    """All of a frame before its samples."""
    dc = bytes([0, *([1] * 9), *([0] * 7), *range(8, -1, -1)])  # one code each of 1 to 9 bits
    ac = bytes([0x10, 1, *([0] * 15), 0])  # the end of the block, in one bit
    return b"\xff\xd8" + segment(0xDB, bytes([0, 8, *[1] * 63])) + segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * side_y, 8 * SIDE, 1, 1, 0x11, 0)) + segment(0xC4, dc) + segment(0xC4, ac) + segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """10 bits for each difference (-255 ... 255, at +255), and back (-1000 where none)."""
    to, back = np.zeros(511, np.int64), np.full(1024, -1000, np.int64)
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        length = 9 - cat
        code = (1 << length) - 2  # 0, 10, 110 ...
        bits = d if d >= 0 else d + (1 << cat) - 1
        to[d + 255] = ((code << cat) | bits) << 1  # a 0 ends the block
        back[to[d + 255]] = d
    return to, back


CODE, DIFF = _codes()


def encode_frames(payload: np.ndarray, rows: int) -> list[bytes]:
    """JPEG frames of whole frames of samples."""
    top, out = head(rows), []
    for f in payload.reshape(-1, rows * SIDE):
        v = f.astype(np.int64) - 128
        c = CODE[np.diff(v, prepend=0) + 255].reshape(-1, 4)
        word = (c[:, 0] << 30) | (c[:, 1] << 20) | (c[:, 2] << 10) | c[:, 3]
        data = word.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].ravel()
        full = np.flatnonzero(data == 0xFF)
        out.append(top + np.insert(data, full + 1, 0).tobytes() + b"\xff\xd9")
    return out


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def wrap(frames: list[bytes], width: int, height: int, rate: int, note: bytes = b"") -> bytes:
    """An AVI file of motion-JPEG frames with an index; note goes to an INFO list."""
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // rate, largest * rate, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, rate, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", form)))
    info = chunk(b"LIST", b"INFO" + chunk(b"ICMT", note)) if note else b""
    parts, index, at = [], [], 4
    for f in frames:
        parts.append(chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(parts[-1])
    return chunk(b"RIFF", b"AVI " + header + info + chunk(b"LIST", b"movi" + b"".join(parts)) + chunk(b"idx1", b"".join(index)))


def stored_bytes(payload: bytes) -> bytes:
    """Bytes (a multiple of 64) as an AVI file, without loss; the note tells their number."""
    n = len(payload)
    rows = min(SIDE, -(-n // SIDE))
    x = np.zeros(-(-n // (rows * SIDE)) * rows * SIDE, np.uint8)
    x[:n] = np.frombuffer(payload, np.uint8)
    return wrap(encode_frames(x, rows), 8 * SIDE, 8 * rows, RATE, b"bytes=%d" % n)


def parse(data: bytes) -> dict:
    """rate, width, height, note, frames [(offset, size)] of an AVI file: by its index, or without one by its chunks."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out: dict = {"rate": 0.0, "width": 0, "height": 0, "note": b"", "frames": []}
    movi, index = None, None
    todo = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body, after = at + 8, at + 8 + size + (size & 1)
            if name == b"LIST":
                kind = data[body : body + 4]
                if kind == b"movi":
                    movi = (body, min(len(data), body + size))
                else:
                    todo.append((body + 4, min(end, body + size)))
            elif name == b"avih":
                us = struct.unpack_from("<I", data, body)[0]
                out["rate"] = out["rate"] or (1e6 / us if us else 0.0)
                out["width"], out["height"] = struct.unpack_from("<II", data, body + 32)
            elif name == b"strh" and data[body : body + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", data, body + 20)
                out["rate"] = rate / scale if scale and rate else out["rate"]
            elif name == b"ICMT":
                out["note"] = data[body : body + size].rstrip(b"\0")
            elif name == b"idx1":
                index = (body, size)
            at = after
    if movi is None:
        raise ValueError("no movi list")
    if index:
        base = None
        for k in range(index[0], index[0] + index[1] - 15, 16):
            name, _, at, size = struct.unpack_from("<4sIII", data, k)
            if name[2:] not in (b"dc", b"db"):
                continue
            if base is None:  # offsets count from the list or from the file's start
                base = movi[0] if data[movi[0] + at : movi[0] + at + 4] == name else 0
            out["frames"].append((base + at + 8, size))
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name == b"LIST":
                at += 12
                continue
            if name[2:] in (b"dc", b"db"):
                out["frames"].append((at + 8, size))
            at += 8 + size + (size & 1)
    return out


_heads: dict[bytes, tuple[int, int] | None] = {}


def samples(frame: bytes) -> np.ndarray:
    """A frame's brightness, one value per flat block for our own frames, else per pixel."""
    rows = None
    sos = frame.find(b"\xff\xda", 0, 400)
    if sos > 0:
        top = frame[: sos + 10]
        if top not in _heads:
            if len(_heads) > 1000:
                _heads.clear()
            sof = top.find(b"\xff\xc0")
            high = struct.unpack_from(">H", top, sof + 5)[0] // 8 if sof > 0 else 0
            _heads[top] = (high, len(top)) if 0 < high <= SIDE and head(high) == top else None
        rows = _heads[top]
    if rows:
        data = np.frombuffer(frame, np.uint8)[rows[1] : -2]
        stuffed = np.flatnonzero(data[:-1] == 0xFF) + 1
        data = np.delete(data, stuffed) if len(stuffed) else data
        w = np.zeros((rows[0] * SIDE // 4, 8), np.uint8)
        w[:, 3:] = data.reshape(-1, 5)
        word = w.view(">u8").ravel().astype(np.int64)
        d = DIFF[np.stack([word >> 30, (word >> 20) & 1023, (word >> 10) & 1023, word & 1023], axis=1).ravel()]
        if d.min() < -255:
            raise ValueError("bad code")
        return (np.cumsum(d) + 128).astype(np.uint8)
    return decode(frame).ravel()


def decode(frame: bytes) -> np.ndarray:
    """The first component of any baseline JPEG frame, as height x width bytes."""
    at, quant, huff, comps, restart = 2, {}, {}, [], 0
    height = width = 0
    scan = None
    while at + 4 <= len(frame) and scan is None:
        if frame[at] != 0xFF:
            raise ValueError("no marker")
        m = frame[at + 1]
        if m == 0xFF or m == 0x01:
            at += 1 if m == 0xFF else 2
            continue
        size = struct.unpack_from(">H", frame, at + 2)[0]
        b = frame[at + 4 : at + 2 + size]
        if m == 0xDB:
            k = 0
            while k < len(b):
                wide = b[k] >> 4
                quant[b[k] & 15] = np.frombuffer(b, ">u2" if wide else "u1", 64, k + 1).astype(np.int64)
                k += 1 + 64 * (1 + bool(wide))
        elif m == 0xC4:
            k = 0
            while k < len(b):
                key, n, table, code, p = b[k], b[k + 1 : k + 17], {}, 0, k + 17
                for bits, many in enumerate(n, 1):
                    for _ in range(many):
                        table[(bits, code)] = b[p]
                        code, p = code + 1, p + 1
                    code <<= 1
                huff[key] = table
                k = p
        elif m == 0xC0:
            _, height, width, n = struct.unpack_from(">BHHB", b)
            comps = [{"id": b[6 + 3 * k], "h": b[7 + 3 * k] >> 4, "v": b[7 + 3 * k] & 15, "q": b[8 + 3 * k]} for k in range(n)]
        elif m in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("not baseline")
        elif m == 0xDD:
            restart = struct.unpack_from(">H", b)[0]
        elif m == 0xDA:
            for k in range(b[0]):
                for c in comps:
                    if c["id"] == b[1 + 2 * k]:
                        c["dc"], c["ac"] = huff[b[2 + 2 * k] >> 4], huff[0x10 | (b[2 + 2 * k] & 15)]
            scan = at + 2 + size
        at += 2 + size
    if scan is None or not comps:
        raise ValueError("no scan")
    hm, vm = max(c["h"] for c in comps), max(c["v"] for c in comps)
    if len(comps) == 1:
        comps[0]["h"] = comps[0]["v"] = hm = vm = 1
    nx, ny = -(-width // (8 * hm)), -(-height // (8 * vm))
    first = comps[0]
    blocks = np.zeros((ny * first["v"], nx * first["h"], 64))
    pos, buf, have = scan, 0, 0

    def need(n: int) -> None:
        nonlocal pos, buf, have
        while have < n:
            x = frame[pos] if pos < len(frame) else 0
            if x == 0xFF and pos + 1 < len(frame) and frame[pos + 1] != 0:
                x = 0  # a marker: zeros follow
            else:
                pos += 2 if x == 0xFF else 1
            buf, have = ((buf << 8) | x) & 0xFFFFFFFFFF, have + 8

    def take(n: int) -> int:
        nonlocal have
        if not n:
            return 0
        need(n)
        have -= n
        return (buf >> have) & ((1 << n) - 1)

    def symbol(table: dict) -> int:
        code = 0
        for bits in range(1, 17):
            code = (code << 1) | take(1)
            if (got := table.get((bits, code))) is not None:
                return got
        raise ValueError("bad code")

    def value(cat: int) -> int:
        x = take(cat)
        return x if not cat or x >> (cat - 1) else x - (1 << cat) + 1

    last = [0] * len(comps)
    for mcu in range(nx * ny):
        if restart and mcu and mcu % restart == 0:
            have, last = 0, [0] * len(comps)
            while not (frame[pos] == 0xFF and 0xD0 <= frame[pos + 1] <= 0xD7):
                pos += 1
            pos += 2
        for k, c in enumerate(comps):
            for j in range(c["h"] * c["v"]):
                last[k] += value(symbol(c["dc"]))
                block = np.zeros(64)
                block[0] = last[k] * quant[c["q"]][0]
                i = 1
                while i < 64:
                    s = symbol(c["ac"])
                    if s == 0:
                        break
                    i += s >> 4
                    if s & 15 and i < 64:
                        block[ZIGZAG[i]] = value(s & 15) * quant[c["q"]][i]
                    i += 1
                if k == 0:
                    blocks[mcu // nx * c["v"] + j // c["h"], mcu % nx * c["h"] + j % c["h"]] = block
    u = np.arange(8)
    t = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)[None, :]
    pixels = np.einsum("xu,abuv,yv->axby", t, blocks.reshape(*blocks.shape[:2], 8, 8), t).reshape(blocks.shape[0] * 8, blocks.shape[1] * 8)
    high, wide = -(-height * first["v"] // vm), -(-width * first["h"] // hm)
    return np.clip(np.round(pixels + 128), 0, 255).astype(np.uint8)[:high, :wide]


def shots(frames: list[np.ndarray]) -> list[tuple[int, int, float]]:
    """(first, after last, difference at its start) of each shot."""
    if not frames:
        return []
    hist = np.array([np.bincount(f >> 3, minlength=BINS) / max(1, len(f)) for f in frames])
    change = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    starts, at = [(0, 0.0)], 0
    for t, x in enumerate(change):
        near = change[max(at, t - MEMORY) : t]  # within the shot so far
        if x > LEAST and x > (near.mean() + ADAPT * near.std() if len(near) else LEAST):
            starts.append((t + 1, float(x)))
            at = t + 1
    return [(a, b, d) for (a, d), (b, _) in zip(starts, [*starts[1:], (len(frames), 0.0)])]


def clips(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per shot: doc_id, clip, first_frame, frames, start_s, end_s, change, level, error."""
    schema = pa.schema([("doc_id", pa.int64()), ("clip", pa.int32()), ("first_frame", pa.int32()), ("frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("change", pa.float64()), ("level", pa.float64()), ("error", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    film = parse(data or b"")
                    seen = [samples(data[a : a + n]) for a, n in film["frames"] if n]
                    rate = film["rate"] or RATE
                    rows += [(doc, k, a, z - a, a / rate, z / rate, d, float(np.mean([f.mean() for f in seen[a:z]])), None) for k, (a, z, d) in enumerate(shots(seen))]
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    rows.append((doc, None, None, None, None, None, None, None, str(e) or type(e).__name__))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return over_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).cast("binary").alias("m")), work, "doc_id long, clip int, first_frame int, frames int, start_s double, end_s double, change double, level double, error string")


def padded(payload: bytes) -> bytes:
    return payload + b"\0" * (max(64, -(-len(payload) // 64) * 64) - len(payload))


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text, padded to a positive multiple of 64 bytes, as a film."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x or b"" for x in b.column(1).to_pylist()]
            for k in range(0, len(raw), 100):
                part = raw[k : k + 100]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 100), pa.array(map(len, part), pa.int64()), pa.array([stored_bytes(padded(x)) for x in part], pa.binary())], schema=schema)

    return over_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("t")), work, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Reads the films of to_media() back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, n, data in zip(*(c.to_pylist() for c in b.columns)):
                film = parse(data)
                seen = [samples(data[a : a + k]) for a, k in film["frames"]]
                payload = np.concatenate(seen).tobytes()[: int(film["note"].removeprefix(b"bytes="))]
                cuts = shots(seen)
                feature = f"{film['width']}x{film['height']} frames={len(seen)} shots={len(cuts)} cuts=" + ",".join(f"{a / film['rate']:.2f}" for a, _, _ in cuts[1:])
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return over_batches(media, work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
