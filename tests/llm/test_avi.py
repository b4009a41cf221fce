import hashlib
import os
import zlib

import numpy as np
import pytest

from signalbase.llm.avi import clip_rows, cuts, decode_frame, decode_frames, encode_avi, padded, parse_avi, read_avi, write_avi


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 255, 256, 257, 5000, 300_000])
def test_round_trip(n):
    payload = padded(os.urandom(n))
    video = parse_avi(encode_avi(payload))
    assert len(payload) % 64 == 0 and len(payload) >= 64 and video.payload_bytes == len(payload)
    assert decode_frames(video.frames).astype(np.uint8).tobytes()[: len(payload)] == payload


def test_frames_are_plain_jpeg():
    video = parse_avi(encode_avi(padded(bytes(range(256)))))
    pixels = decode_frame(bytes(video.frames[0]))
    assert pixels.shape == (128, 128)
    assert np.allclose(pixels.reshape(16, 8, 16, 8).mean(axis=(1, 3)).ravel(), np.arange(256))
    assert np.allclose(pixels[:8, :8], pixels[0, 0])


def other_jpeg():
    """A frame by other tables: two blocks, the second with one AC coefficient."""
    from signalbase.llm.avi import _segment

    head = b"\xff\xd8" + _segment(0xDB, b"\0" + b"\x10" * 64) + _segment(0xC0, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0]))
    head += _segment(0xC4, b"\0" + bytes([0, 2] + [0] * 14) + bytes([0, 3])) + _segment(0xC4, b"\x10" + bytes([0, 2] + [0] * 14) + bytes([0, 0x02])) + _segment(0xDA, b"\x01\x01\0\0\x3f\0")
    # DC: category 3, value 5; end of block. DC: category 0; AC: run 0, size 2, value 3; end of block.
    bits = "01" + "101" + "00" + "00" + "01" + "11" + "00"
    bits += "1" * (-len(bits) % 8)
    return head + int(bits, 2).to_bytes(len(bits) // 8, "big") + b"\xff\xd9"


def test_other_tables():
    pixels = decode_frame(other_jpeg())
    assert pixels.shape == (8, 16) and np.allclose(pixels[:, :8], 128 + 5 * 16 / 8)
    wave = 138 + 3 * 16 * np.cos((2 * np.arange(8) + 1) * np.pi / 16) * 0.5 * np.sqrt(0.125)
    assert np.allclose(pixels[:, 8:], wave[None, :])


def test_cuts_at_changes_of_the_histogram():
    rnd = np.random.default_rng(0)
    dark, light = rnd.integers(0, 60, (10, 256)), rnd.integers(180, 250, (7, 256))
    assert cuts(np.concatenate([dark, light, dark])) == [0, 10, 17]
    assert cuts(dark) == [0] and cuts(dark[:1]) == [0] and cuts(dark[:0]) == []


def test_columns(spark):
    texts = [(1, "a" * 3000 + "é" * 2000, "k"), (2, None, "k"), (3, "", None), (3, "", None), (None, "\U0001f600", "k")]
    frame = spark.createDataFrame(texts, "doc_id long, text string, media string")
    rows = read_avi(write_avi(frame.drop("media").withColumn("n_chars", frame.doc_id))).collect()
    assert len(rows) == 5
    for r in rows:
        text = next((t or "" for i, t, _ in texts if i == r["doc_id"]), None)
        payload = padded(text.encode())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    clips = clip_rows(read_avi(write_avi(frame.drop("media")))).filter("doc_id = 1").orderBy("first_frame").collect()
    assert clips[0]["start_ms"] == 0 and clips[-1]["end_ms"] == 40.0 * -(-7000 // 256) and len(clips) >= 2
    assert write_avi(frame.filter("doc_id > 9")).count() == 0


@pytest.mark.parametrize("media", [None, b"", b"RIFF", b"nonsense" * 9, encode_avi(padded(b"x"))[:-30], encode_avi(padded(b"x")).replace(b"\xff\xd8\xff\xdb", b"\0\0\0\0")])
def test_malformed(spark, media):
    row = read_avi(spark.createDataFrame([(1, media)], "id long, media binary")).first()
    assert row["payload_bytes"] is None and row["clips"] == []
