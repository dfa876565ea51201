"""Motion-JPEG AVI columns: write and parse RIFF, decode intra frames, cut shots by adaptive histogram differences.

The writer keeps bytes losslessly in the format's own unit, the quantised DCT coefficient: 64 bytes make one 8x8 block,
a byte ``v`` the coefficient ``v`` (128 and over) or ``v - 255`` (below), which JPEG codes as category 8 and the byte
itself.  The Huffman tables give that category a one-bit code, so that a block takes 72 bytes, and a restart interval is
``RESTART`` blocks, which keeps the sum of DC differences in range.  A frame has ``FRAME_BLOCKS`` blocks; blocks after
the end of the payload are empty (DC difference 0, end of block).  All of it is baseline JPEG in a plain AVI 1.0 file with an index, so one
file stays below 4 GB (texts of up to about 3 GB).

The reader walks the RIFF index, parses each frame's markers, takes out stuffed bytes, reads the coefficients back and
inverts the DCT to get samples.  Frames of this writer, whose codes all have one length, are decoded many at once; any
other baseline frame (``file_clips``) goes through ``jpeg.decode``, symbol by symbol.

Shots: the difference of neighbouring frames is half the L1 distance of their 16-bin luma histograms; a cut is where it
exceeds both a floor and the mean plus ``k`` standard deviations of the up to eight differences before it in the shot.

Nulls and empty texts: a payload of 64 zero bytes, one frame, one clip.  Equal payloads give equal files and clips.
Repeated rows are encoded each.  An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jpeg
from .common import load

FRAME_BLOCKS, RESTART, WIDTH, HEIGHT, FRAME_MS = 16, 4, 32, 32, 40
# By the number of full blocks in a restart interval: the bits of its empty blocks (1010 each), padded with ones.
_EMPTY = [b"\xaa\xaa", b"\xaa\xaf", b"\xaa", b"\xaf", b""]

_RESTARTS = [bytes([0xFF, 0xD0 + i % 8]) for i in range(FRAME_BLOCKS // RESTART - 1)] + [b""]


def _marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def _table(kind: int) -> bytes:
    """A Huffman table of two codes: 0 for category 8, 10 for category 0 (or end of block)."""
    return bytes([kind, 1, 1, *[0] * 14, 0x08, 0x00])


_HEAD = b"\xff\xd8" + _marker(0xDB, bytes([0, *[1] * 64])) + _marker(0xC0, struct.pack(">BHHBBBB", 8, HEIGHT, WIDTH, 1, 1, 0x11, 0)) + _marker(0xC4, _table(0x00) + _table(0x10)) + _marker(0xDD, struct.pack(">H", RESTART)) + _marker(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


_IDCT = jpeg.inverse_dct().astype(np.float32)


def encode_frames(payload: bytes) -> list[bytes]:
    """JPEG frames that hold a payload whose length is a multiple of 64."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    bits = np.zeros((len(blocks), 64, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(blocks, axis=1).reshape(-1, 64, 8)
    coded = np.packbits(bits.reshape(len(blocks), -1), axis=1)
    frames = []
    for at in range(0, len(blocks), FRAME_BLOCKS):
        own = [coded[i : min(i + RESTART, at + FRAME_BLOCKS)] for i in range(at, at + FRAME_BLOCKS, RESTART)]
        scan = b"".join(x.tobytes().replace(b"\xff", b"\xff\x00") + _EMPTY[len(x)] + _RESTARTS[i] for i, x in enumerate(own))
        frames.append(_HEAD + scan + b"\xff\xd9")
    return frames


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def write_avi(frames: list[bytes]) -> bytes:
    largest = max(map(len, frames))
    main = struct.pack("<14I", FRAME_MS * 1000, largest * 1000 // FRAME_MS, 0, 0x10, len(frames), 0, 1, largest, WIDTH, HEIGHT, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, FRAME_MS, 1000, 0, len(frames), largest, 0, 0, 0, 0, WIDTH, HEIGHT)
    shape = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 24, b"MJPG", WIDTH * HEIGHT * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", shape)))
    body, index, at = [], [], 4
    for f in frames:
        body.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(body[-1])
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"movi" + b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def parse_avi(data: bytes) -> tuple[int, list[bytes]]:
    """(microseconds a frame, frames) through the file's index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, end, movi, index, micro = 12, 8 + struct.unpack_from("<I", data, 4)[0], None, None, 0
    while at + 8 <= end:
        name, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            micro = struct.unpack_from("<I", data, data.index(b"avih", at) + 8)[0]
        elif name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = struct.iter_unpack("<4sIII", data[at + 8 : at + 8 + n])
        at += 8 + n + n % 2
    if movi is None or index is None:
        raise ValueError("no movi list or no idx1 chunk")
    return micro, [data[movi + off + 8 : movi + off + 8 + n] for name, _, off, n in index if name[2:] == b"dc"]


@functools.lru_cache(maxsize=64)
def _parse_head(head: bytes) -> tuple[int, int]:
    """(width, height) of a frame's header; raises unless it has the tables that this reader decodes."""
    at, seen = 2, {}
    while at < len(head):
        code, n = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        seen[code] = seen.get(code, b"") + head[at + 4 : at + 2 + n]
        at += 2 + n
    want = {0xDB: bytes([0, *[1] * 64]), 0xC4: _table(0x00) + _table(0x10), 0xDD: struct.pack(">H", RESTART), 0xDA: bytes([1, 1, 0x00, 0, 63, 0])}
    for code, body in want.items():
        if seen.get(code) != body:
            raise ValueError(f"marker FF{code:02X} is not one that this reader decodes")
    height, width = struct.unpack_from(">HH", seen[0xC0], 1)
    return width, height


def decode_frames(frames: list[bytes]) -> tuple[bytes, np.ndarray]:
    """(payload read back from the coefficients, luma samples of shape (frames, blocks, 64))."""
    scans = []
    for f in frames:
        start = f.index(b"\xff\xda") + 2
        start += struct.unpack_from(">H", f, start)[0]
        _parse_head(f[:start])
        scans.append(f[start:-2])
    parts = [part.replace(b"\xff\x00", b"\xff") for s in scans for part in _at_restarts(s)]
    count = np.fromiter((len(x) // 72 for x in parts), np.int64, len(parts))
    coded = np.frombuffer(b"".join([x[: len(x) // 72 * 72] for x in parts]), np.uint8).reshape(-1, 72)
    values = np.packbits(np.unpackbits(coded, axis=1).reshape(len(coded), 64, 9)[:, :, 1:], axis=2).reshape(-1, 64)
    blocks = np.zeros((len(parts), RESTART, 64), np.float32)
    full = np.arange(RESTART) < count[:, None]
    blocks[full] = values
    blocks[full] -= np.float32(255) * (values < 128)
    np.cumsum(blocks[:, :, 0], axis=1, out=blocks[:, :, 0])
    light = blocks.reshape(-1, 64) @ _IDCT
    light += np.float32(128.5)
    np.clip(light, 0, 255, out=light)
    return values.tobytes(), light.astype(np.uint8).reshape(len(frames), -1, 64)


def _at_restarts(scan: bytes) -> list[bytes]:
    parts, at = [], 0
    for mark in _RESTARTS[:-1]:
        stop = scan.index(mark, at)
        parts.append(scan[at:stop])
        at = stop + 2
    return [*parts, scan[at:]]


def shots(samples: np.ndarray, k: float = 3.0, floor: float = 0.25) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of each shot."""
    n = len(samples)
    bins = np.bincount((np.arange(n)[:, None] * 16 + (samples.reshape(n, -1) >> 4)).ravel(), minlength=16 * n).reshape(n, 16)
    return cuts(np.abs(np.diff(bins, axis=0)).sum(1) / (2 * samples[0].size), k, floor)


def cuts(diff: np.ndarray, k: float = 3.0, floor: float = 0.25) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of each shot, from the differences of neighbouring frames."""
    starts, before = [0], []
    for i, d in enumerate(diff.tolist()):
        mean = sum(before) / len(before) if before else 0.0
        spread = (sum((x - mean) ** 2 for x in before) / len(before)) ** 0.5 if before else 0.0
        if d > max(floor, mean + k * spread):
            starts.append(i + 1)
            before = []
        else:
            before = [*before[-7:], d]
    return list(zip(starts, [*starts[1:], len(diff) + 1]))


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """One row for each text: the AVI file of its payload, what the file gives back, and its shots.

    doc_id, n_bytes, media binary (null without ``keep_media``), media_bytes, media_sha256, payload_bytes,
    payload_sha256, tail_crc32 (of the last 64 bytes read back), frames, clips array<struct<first, last, mean>>.
    """
    kind = dict(docs.dtypes)[id_col]
    clip = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("mean", pa.int32())]))
    schema = f"doc_id {kind}, n_bytes long, media binary, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, frames int, clips array<struct<first: int, last: int, mean: int>>"
    names = ["doc_id", "n_bytes", "media", "media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "frames", "clips"]
    types = [None, pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), clip]

    def one(text: bytes) -> tuple:
        stored = write_avi(encode_frames(text + b"\x00" * (-len(text) % 64 or 64 * (not text))))
        _, frames = parse_avi(stored)
        back, samples = decode_frames(frames)
        clips = [{"first": a, "last": b - 1, "mean": int(samples[a:b].sum(dtype=np.int64) // samples[a:b].size)} for a, b in shots(samples)]
        return len(text), stored if keep_media else None, len(stored), hashlib.sha256(stored).hexdigest(), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(frames), clips

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cols = zip(*(one(t or b"") for t in part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, types[1:]))], names=names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def clips(found: DataFrame) -> DataFrame:
    """A row for each clip: doc_id, clip, start_ms, end_ms, mean luma."""
    return found.select("doc_id", F.posexplode("clips").alias("clip", "c")).select("doc_id", "clip", (F.col("c.first") * FRAME_MS).alias("start_ms"), ((F.col("c.last") + 1) * FRAME_MS).alias("end_ms"), F.col("c.mean").alias("mean_luma"))


def file_clips(files: DataFrame, id_col: str = "path", media_col: str = "content") -> DataFrame:
    """A row for each clip of motion-JPEG AVI files (id, clip, start_ms, end_ms, mean_luma); ``files``: id, binary.

    A null or empty value has no clips; a file that is not AVI, or a frame that is not baseline JPEG, is an error.  Frames
    are decoded one at a time; of each only its histogram stays.
    """
    kind = dict(files.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0), []
            for i, data in enumerate(batch.column(1)):
                micro, frames = parse_avi(data.as_py()) if data.as_py() else (0, [])
                shares, means = np.zeros((len(frames), 16)), np.zeros(len(frames))
                for j, frame in enumerate(frames):
                    light = jpeg.decode(frame)[0]
                    shares[j], means[j] = np.bincount((light >> 4).ravel(), minlength=16) / light.size, light.mean()
                found = cuts(np.abs(np.diff(shares, axis=0)).sum(1) / 2) if frames else []
                rows += [(i, k, a * micro / 1000, b * micro / 1000, float(means[a:b].mean())) for k, (a, b) in enumerate(found)]
            at, *cols = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.float64(), pa.float64(), pa.float64())))], names=["id", "clip", "start_ms", "end_ms", "mean_luma"])

    return files.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, f"id {kind}, clip int, start_ms double, end_ms double, mean_luma double")


def op6_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media(load(spark, sf_dir, "documents"), keep_media=False)
    times = F.expr(f"array_join(transform(clips, c -> concat(c.first * {FRAME_MS}, '-', (c.last + 1) * {FRAME_MS}, ':', c.mean)), ' ')")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat(F.lit("frames="), "frames", F.lit(" clips="), times).alias("feature"))
