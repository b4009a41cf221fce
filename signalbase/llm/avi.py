"""AVI motion-JPEG columns: write payloads as video, read video as timed shots.

Writing stores each byte of a payload as the flat grey level of an 8x8 block
of a baseline JPEG frame: with a quantiser of 8 the block's DC coefficient is
the level itself, so nothing is lost. The frame's Huffman table gives the
category k of a DC difference 9 - k bits, so a difference always takes nine
bits, its end-of-block one more, and a frame is coded and decoded by array
operations. ``decode_frame`` also reads any other baseline grey frame, by the
tables it carries.

Reading parses the RIFF lists and the ``idx1`` index, decodes the intra
frames it points to, and detects shots: a cut is where the distance of two
frames' grey histograms exceeds the mean of the distances before it in the
shot by ``CUT_SIGMAS`` standard deviations, and ``CUT_LEAST`` in any case.
Each shot is a timed clip row.

Defined cases: null and empty payloads become one frame of zeros; a null or
malformed video gives no payload and no clips; repeated rows give equal
results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbase.llm.common import by_size

BLOCKS = 16  # blocks a frame side; a frame holds 256 bytes
FRAME_BYTES = BLOCKS * BLOCKS
FRAME_MS = 40
PAD = 64
BINS = 16
CUT_SIGMAS = 3.0
CUT_LEAST = 0.25

_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for u in range(8)] for x in range(8)])


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


#: DC categories 8 to 0 with codes of 1 to 9 bits; AC: the end of block, one bit.
_DC_COUNTS, _DC_SYMBOLS = bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1))
_AC_COUNTS, _AC_SYMBOLS = bytes([1] + [0] * 15), bytes([0])
_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, b"\0" + b"\x08" + b"\x01" * 63)
    + _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * BLOCKS, 8 * BLOCKS, 1, 1, 0x11, 0))
    + _segment(0xC4, b"\0" + _DC_COUNTS + _DC_SYMBOLS)
    + _segment(0xC4, b"\x10" + _AC_COUNTS + _AC_SYMBOLS)
    + _segment(0xDA, b"\x01\x01\0\0\x3f\0")
)


def _codes() -> np.ndarray:
    """Ten-bit code of each DC difference from -255 to 255, at index difference + 255."""
    out = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        k = abs(d).bit_length()
        code = (1 << (9 - k)) - 2  # canonical: all ones but the last bit
        out[d + 255] = (((code << k) | (d if d >= 0 else d + (1 << k) - 1)) << 1) if k else (code << 1)
    return out


_CODES = _codes()
_DIFFS = np.full(1024, -999, np.int16)
_DIFFS[_CODES] = np.arange(-255, 256)


def padded(payload: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of 64."""
    return payload.ljust(max(PAD, -(-len(payload) // PAD) * PAD), b"\0")


def encode_avi(payload: bytes) -> bytes:
    """An AVI file whose frames hold the payload; its length is kept in an INFO comment."""
    n = -(-len(payload) // FRAME_BYTES)
    levels = np.frombuffer(payload.ljust(n * FRAME_BYTES, b"\0"), np.uint8).reshape(n, FRAME_BYTES).astype(np.int16)
    codes = _CODES[np.diff(levels, axis=1, prepend=np.int16(128)) + 255]
    # Four ten-bit codes fill five bytes.
    c = codes.reshape(n, -1, 4).astype(np.uint64)
    five = (c[..., 0] << 30) | (c[..., 1] << 20) | (c[..., 2] << 10) | c[..., 3]
    scans = np.ascontiguousarray(five.astype(">u8").view(np.uint8).reshape(n, -1, 8)[..., 3:]).reshape(n, -1)
    frames = [_HEAD + s.tobytes().replace(b"\xff", b"\xff\0") + b"\xff\xd9" for s in scans]
    chunks, index, at = [], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        chunks.append(_chunk(b"00dc", f))
        at += len(chunks[-1])
    side, most = 8 * BLOCKS, max(map(len, frames))
    header = struct.pack("<14I", 1000 * FRAME_MS, most * 1000 // FRAME_MS, 0, 0x10, n, 0, 1, most, side, side, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, FRAME_MS, 1000, 0, n, most, 0, 0, 0, 0, side, side)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 8, b"MJPG", side * side, 0, 0, 0, 0)
    lists = _list(b"hdrl", _chunk(b"avih", header) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", bitmap)))
    lists += _list(b"INFO", _chunk(b"ICMT", b"payload_bytes=%d\0" % len(payload)))
    return _chunk(b"RIFF", b"AVI " + lists + _list(b"movi", b"".join(chunks)) + _chunk(b"idx1", b"".join(index)))


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def _list(name: bytes, data: bytes) -> bytes:
    return _chunk(b"LIST", name + data)


@dataclass
class Video:
    frames: list[memoryview]
    frame_ms: float
    payload_bytes: int | None


def parse_avi(media: bytes) -> Video:
    """The frames that the index points to (all of ``movi`` where there is no index)."""
    view = memoryview(media)
    if view[:4] != b"RIFF" or view[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    index, movi, micro, size = None, None, 1000 * FRAME_MS, None

    def walk(at: int, end: int) -> None:
        nonlocal index, movi, micro, size
        while at + 8 <= end:
            name, n = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
            body = at + 8
            if body + n > end:
                raise ValueError("a chunk is longer than its list")
            if name == b"LIST":
                if view[body : body + 4] == b"movi":
                    movi = (body, body + n)
                else:
                    walk(body + 4, body + n)
            elif name == b"avih":
                micro = struct.unpack_from("<I", view, body)[0]
            elif name == b"idx1":
                index = view[body : body + n]
            elif name == b"ICMT" and (m := re.match(rb"payload_bytes=(\d+)", view[body : body + n])):
                size = int(m[1])
            at = body + n + n % 2

    walk(12, min(len(view), 8 + struct.unpack_from("<I", view, 4)[0]))
    if movi is None:
        raise ValueError("no movi list")
    frames, base = [], movi[0]
    if index is not None:
        for name, _, at, n in struct.iter_unpack("<4sIII", index):
            if name[2:] in (b"dc", b"db"):
                # Offsets count from the list's name, in some files from the file's start.
                start = base + at if view[base + at : base + at + 4] == name else at
                frames.append(view[start + 8 : start + 8 + n])
    else:
        at = base + 4
        while at + 8 <= movi[1]:
            n = struct.unpack_from("<I", view, at + 4)[0]
            if bytes(view[at + 2 : at + 4]) in (b"dc", b"db"):
                frames.append(view[at + 8 : at + 8 + n])
            at += 8 + n + n % 2
    return Video(frames, micro / 1000, size)


def decode_frames(frames: list[memoryview]) -> np.ndarray:
    """Grey levels of frames' blocks (the mean of each), one row a frame."""
    scans = [bytes(f[len(_HEAD) : -2]).replace(b"\xff\0", b"\xff") if bytes(f[: len(_HEAD)]) == _HEAD else None for f in frames]
    own = [k for k, s in enumerate(scans) if s is not None and len(s) == FRAME_BYTES * 10 // 8]
    out: list[np.ndarray] = [np.empty(0)] * len(frames)
    if own:
        b = np.frombuffer(b"".join(scans[k] for k in own), np.uint8).reshape(-1, 5).astype(np.uint64)
        five = (b[:, 0] << 32) | (b[:, 1] << 24) | (b[:, 2] << 16) | (b[:, 3] << 8) | b[:, 4]
        codes = np.stack([five >> 30, five >> 20, five >> 10, five], axis=1) & 1023
        levels = np.cumsum(_DIFFS[codes].reshape(len(own), FRAME_BYTES), axis=1, dtype=np.int32) + 128
        for k, row in zip(own, levels):
            out[k] = row
    for k in set(range(len(frames))) - set(own):
        pixels = decode_frame(bytes(frames[k]))
        h, w = (x // 8 * 8 for x in pixels.shape)
        out[k] = np.rint(pixels[:h, :w].reshape(h // 8, 8, w // 8, 8).mean(axis=(1, 3))).astype(np.int32).ravel()
    return np.stack(out) if len({len(x) for x in out}) == 1 else np.array(out, object)


def decode_frame(jpeg: bytes) -> np.ndarray:
    """Pixels of a baseline JPEG frame with one component."""
    at, quant, trees, dims, interval = 2, {}, {}, None, 0
    while True:
        marker, n = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        data = jpeg[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while data:
                wide = data[0] >> 4
                quant[data[0] & 15] = np.frombuffer(data[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                data = data[65 + 64 * wide :]
        elif marker == 0xC4:
            while data:
                counts, code, place, tree = data[1:17], 0, 17, {}
                for bits, count in enumerate(counts, 1):
                    for _ in range(count):
                        tree[bits, code] = data[place]
                        code, place = code + 1, place + 1
                    code <<= 1
                trees[data[0]] = tree
                data = data[place:]
        elif marker in (0xC0, 0xC1):
            _, h, w, parts, _, _, table = struct.unpack_from(">BHHBBBB", data)
            if parts != 1:
                raise ValueError("only frames with one component are read")
            dims = h, w, table
        elif marker == 0xDD:
            interval = struct.unpack(">H", data)[0]
        elif marker == 0xDA:
            dc, ac = trees[data[2] >> 4], trees[16 | data[2] & 15]
            break
    h, w, table = dims
    parts = re.split(rb"\xff[\xd0-\xd7]", jpeg[at : jpeg.rindex(b"\xff\xd9")])
    rows, columns = -(-h // 8), -(-w // 8)
    total, out = rows * columns, np.zeros((rows * columns, 64))
    done = 0
    for part in parts:
        data = part.replace(b"\xff\0", b"\xff")
        bits, place, last = int.from_bytes(data, "big"), 0, 0
        length = 8 * len(data)

        def take(n: int) -> int:
            nonlocal place
            place += n
            return (bits >> (length - place)) & ((1 << n) - 1) if n else 0

        def symbol(tree: dict) -> int:
            code = 0
            for n in range(1, 17):
                code = code << 1 | take(1)
                if (n, code) in tree:
                    return tree[n, code]
            raise ValueError("unknown Huffman code")

        def number(k: int) -> int:
            v = take(k)
            return v if not k or v >> (k - 1) else v - (1 << k) + 1

        for _ in range(interval or total):
            if done == total:
                break
            last += number(symbol(dc))
            block = np.zeros(64)
            block[0], k = last * quant[table][0], 1
            while k < 64:
                run_size = symbol(ac)
                if not run_size:
                    break
                k += run_size >> 4
                if run_size & 15:
                    block[k] = number(run_size & 15) * quant[table][k]
                k += 1
            out[done, _ZIGZAG] = block
            done += 1
    pixels = _COS @ out.reshape(-1, 8, 8) @ _COS.T + 128
    return np.clip(pixels, 0, 255).reshape(rows, columns, 8, 8).swapaxes(1, 2).reshape(8 * rows, 8 * columns)[:h, :w]


def cuts(levels: np.ndarray) -> list[int]:
    """Frames at which a shot begins, the first included."""
    n = len(levels)
    if n < 2:
        return [0][:n]
    hist = np.stack([np.bincount(np.asarray(r) * BINS >> 8, minlength=BINS) / len(r) for r in levels])
    apart, out = (np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2).tolist(), [0]
    count = total = squares = 0.0
    for k, d in enumerate(apart, 1):
        mean = total / count if count else 0.0
        sigma = max(0.0, squares / count - mean * mean) ** 0.5 if count else 0.0
        if d > CUT_LEAST and d > mean + CUT_SIGMAS * sigma and (count >= 2 or d > 2 * CUT_LEAST):
            out.append(k)
            count = total = squares = 0.0
        else:
            count, total, squares = count + 1, total + d, squares + d * d
    return out


CLIP = pa.list_(pa.struct([("first_frame", pa.int64()), ("n_frames", pa.int64()), ("start_ms", pa.float64()), ("end_ms", pa.float64())]))
CLIP_SQL = "array<struct<first_frame:bigint,n_frames:bigint,start_ms:double,end_ms:double>>"


def write_avi(df: DataFrame, text: str = "text", media: str = "media", n_bytes: str = "n_bytes") -> DataFrame:
    """``df`` without ``text``, with its UTF-8 bytes, padded, as an AVI file in ``media`` and their number before padding."""
    rest = [c for c in df.columns if c not in (text, media, n_bytes)]
    fields = [df.schema[c] for c in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist()]
            columns = [pa.array(map(len, raw), pa.int64()), pa.array([encode_avi(padded(r)) for r in raw], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*rest, n_bytes, media])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + f"`{n_bytes}` bigint, `{media}` binary"
    return df.select(F.col(text).alias("_text"), *(df[c] for c in rest)).mapInArrow(run, schema)


def read_avi(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` without ``media``, with what it holds: payload digests, the file's own, and its clips."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips"]
    rest = [c for c in df.columns if c not in (media, *names)]

    def read(m: bytes | None) -> tuple:
        if m is None:
            return (None,) * 5 + ([],)
        own = len(m), sha256(m).hexdigest()
        try:
            video = parse_avi(m)
            levels = decode_frames(video.frames)
        except (ValueError, KeyError, IndexError, TypeError, struct.error):
            return None, None, None, *own, []
        starts = cuts(levels)
        clips = [{"first_frame": a, "n_frames": b - a, "start_ms": a * video.frame_ms, "end_ms": b * video.frame_ms} for a, b in zip(starts, [*starts[1:], len(levels)])]
        if video.payload_bytes is None:
            return None, None, None, *own, clips
        data = levels.astype(np.uint8).tobytes()[: video.payload_bytes]
        return len(data), sha256(data).hexdigest(), crc32(data[-PAD:]), *own, clips

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), CLIP]
        for batch in by_size(batches):
            rows = zip(*map(read, (x.as_py() for x in batch.column(0)))) if batch.num_rows else [()] * 6
            columns = [pa.array(list(x), kind) for x, kind in zip(rows, types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*rest, *names])

    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in rest)
    schema += f"payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, clips {CLIP_SQL}"
    return df.select(F.col(media).alias("_media"), *(df[c] for c in rest)).mapInArrow(run, schema)


def clip_rows(df: DataFrame) -> DataFrame:
    """A row for each shot: the columns of ``df`` with ``clips`` unfolded."""
    return df.withColumn("clip", F.explode("clips")).select(*[c for c in df.columns if c != "clips"], "clip.*")


def feature() -> Column:
    """The clips as one string: first frames and lengths."""
    return F.concat(F.lit("shots="), F.size("clips").cast("string"), F.lit(";"), F.array_join(F.transform("clips", lambda c: F.concat_ws("+", c["first_frame"], c["n_frames"])), ","))
