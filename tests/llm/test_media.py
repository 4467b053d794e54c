import hashlib
import struct
import zlib

import numpy as np
import pytest

from glyphmill.llm import media


def test_films_give_their_bytes_back():
    r = np.random.default_rng(1)
    for n in (64, 128, 1024, 1088, 5056, 40_000 // 64 * 64):
        for data in (r.integers(0, 256, n, np.uint8).tobytes(), b"\xff\x00" * (n // 2), bytes(n)):
            film = media.stored_bytes(data)
            p = media.parse(film)
            seen = [media.samples(film[a : a + k]) for a, k in p["frames"]]
            assert np.concatenate(seen).tobytes()[:n] == data and p["note"] == b"bytes=%d" % n
            a, k = p["frames"][0]
            pixels = media.decode(film[a : a + k])  # any baseline decoder sees flat blocks of the same samples
            assert pixels.shape == (p["height"], p["width"])
            assert (pixels[::8, ::8].ravel() == seen[0]).all() and (pixels[7::8, 7::8].ravel() == seen[0]).all()


def test_index_and_scan_agree():
    film = media.stored_bytes(bytes(range(64)) * 100)
    at = film.find(b"idx1")
    assert media.parse(film)["frames"] == media.parse(film[:at])["frames"]
    with pytest.raises(ValueError):
        media.parse(b"RIFFxxxxWAVE")


def test_general_decoder_with_other_coefficients_and_restarts():
    """One frame of two blocks, the second after a restart marker, with a horizontal wave in the first."""
    dc = bytes([0, 0, 2, *[0] * 14, 0, 5])
    ac = bytes([0x10, 0, 2, *[0] * 14, 0, 3])  # 00: end; 01: next coefficient, 3 bits
    bits = "01" + "10100" + "01" + "101" + "00"  # DC +20, AC +5, end
    bits += "1" * (-len(bits) % 8)
    second = "00" + "00"
    second += "1" * (-len(second) % 8)
    raw = lambda s: int(s, 2).to_bytes(len(s) // 8, "big")
    frame = b"\xff\xd8" + media.segment(0xDB, bytes([0, *[4] * 64])) + media.segment(0xC0, struct.pack(">BHHBBBB", 8, 8, 16, 1, 1, 0x11, 0)) + media.segment(0xC4, dc) + media.segment(0xC4, ac) + media.segment(0xDD, b"\0\1") + media.segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + raw(bits) + b"\xff\xd0" + raw(second) + b"\xff\xd9"
    x = np.arange(8)
    want = 128 + 80 / 8 + 20 * 0.5 * np.sqrt(0.125) * np.cos((2 * x + 1) * np.pi / 16)
    got = media.decode(frame)
    assert got.shape == (8, 16) and (got[:, :8] == np.round(want)[None, :]).all() and (got[:, 8:] == 128).all()


def test_shots_are_timed_and_errors_kept(spark):
    dark, light = np.zeros(media.FRAME, np.uint8), np.full(media.FRAME, 200, np.uint8)
    film = media.wrap(media.encode_frames(np.concatenate([dark] * 10 + [light] * 15 + [dark] * 5), media.SIDE), 256, 256, 25)
    df = spark.createDataFrame([(1, bytearray(film), "x"), (2, bytearray(b"junk"), "x"), (3, None, "x")], "doc_id long, media binary, clip string")
    rows = media.clips(df).orderBy("doc_id", "clip").collect()
    assert [(r.doc_id, r.first_frame, r.frames, r.start_s, r.end_s, r.level) for r in rows[:3]] == [(1, 0, 10, 0.0, 0.4, 0.0), (1, 10, 15, 0.4, 1.0, 200.0), (1, 25, 5, 1.0, 1.2, 0.0)]
    assert [r.doc_id for r in rows[3:]] == [2, 3] and all(r.error for r in rows[3:])


def test_every_text_round_trips(spark):
    texts = [None, "", "a", "x" * 64, "é" * 5000, "long text " * 20_000, "a"]
    df = spark.createDataFrame([(k if k else None, t, b"x") for k, t in enumerate(texts)], "doc_id long, text string, media binary")
    got = {r.doc_id: r for r in media.features(media.to_media(df)).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        pad = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[k or None]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
    assert got[2].media_sha256 == got[6].media_sha256 and got[2].feature == got[6].feature
    assert media.features(media.to_media(df.limit(0))).count() == 0
