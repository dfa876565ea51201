"""Baseline JPEG frames to samples: any Huffman and quantisation tables, subsampled chroma, restart intervals.

Motion-JPEG files often leave the Huffman tables out and mean those of the standard, which stand in here.  A frame's
scans are read symbol by symbol into coefficients; blocks are dequantised and inverted together as matrices.
"""

from __future__ import annotations

import functools
import re
import struct

import numpy as np

# Fixed values of the JPEG standard: the zigzag order of an 8x8 block.
ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])

# Fixed values of the JPEG standard: typical Huffman tables, numbers of codes of 1 to 16 bits and the codes' values.
DC_VALUES = "00 01 02 03 04 05 06 07 08 09 0A 0B"
STANDARD = {
    0x00: ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], DC_VALUES),
    0x01: ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], DC_VALUES),
    0x10: (
        [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125],
        "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 A1 08 23 42 B1 C1 15 52 D1 F0 24 33 62 72 82 09 0A 16 17 18 19 1A 25 26 27 28 29 2A 34 35 36 37 38 39 3A 43 44 45 46 47 48 49 4A 53 54 55 56 57 58 59 5A 63 64 65 66 67 68 69 6A 73 74 75 76 77 78 79 7A 83 84 85 86 87 88 89 8A 92 93 94 95 96 97 98 99 9A A2 A3 A4 A5 A6 A7 A8 A9 AA B2 B3 B4 B5 B6 B7 B8 B9 BA C2 C3 C4 C5 C6 C7 C8 C9 CA D2 D3 D4 D5 D6 D7 D8 D9 DA E1 E2 E3 E4 E5 E6 E7 E8 E9 EA F1 F2 F3 F4 F5 F6 F7 F8 F9 FA",
    ),
    0x11: (
        [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119],
        "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 A1 B1 C1 09 23 33 52 F0 15 62 72 D1 0A 16 24 34 E1 25 F1 17 18 19 1A 26 27 28 29 2A 35 36 37 38 39 3A 43 44 45 46 47 48 49 4A 53 54 55 56 57 58 59 5A 63 64 65 66 67 68 69 6A 73 74 75 76 77 78 79 7A 82 83 84 85 86 87 88 89 8A 92 93 94 95 96 97 98 99 9A A2 A3 A4 A5 A6 A7 A8 A9 AA B2 B3 B4 B5 B6 B7 B8 B9 BA C2 C3 C4 C5 C6 C7 C8 C9 CA D2 D3 D4 D5 D6 D7 D8 D9 DA E2 E3 E4 E5 E6 E7 E8 E9 EA F2 F3 F4 F5 F6 F7 F8 F9 FA",
    ),
}


def inverse_dct() -> np.ndarray:
    """Matrix from 64 coefficients in zigzag order to 64 samples in row order."""
    x = np.arange(8)
    one = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) * np.where(x == 0, np.sqrt(0.125), 0.5)
    return np.einsum("yu,xv->uvyx", one, one).reshape(64, 64)[ZIGZAG]


@functools.lru_cache(maxsize=32)
def codes(counts: bytes, values: bytes) -> list[int]:
    """For every 16 bits, 32 * value + length of the canonical code that they begin with; 0 where none does."""
    table, code, at = np.zeros(1 << 16, np.int64), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            table[code << (16 - length) : (code + 1) << (16 - length)] = 32 * values[at] + length
            code, at = code + 1, at + 1
        code <<= 1
    return table.tolist()


class Part:
    """A component: its sampling, tables, and coefficients by block row and column."""

    def __init__(self, h: int, v: int, table: int) -> None:
        self.h, self.v, self.table = h, v, table
        self.width = self.height = 0
        self.blocks = np.zeros((0, 0, 64), np.int64)


def _segments(frame: bytes, at: int) -> tuple[list[bytes], int]:
    """A scan's entropy-coded segments between restart marks, without stuffing; where the next marker is."""
    end = at
    for found in re.finditer(rb"\xff[^\x00\xd0-\xd7\xff]", frame[at:]):
        end = at + found.start()
        break
    else:
        end = len(frame)
    return [x.replace(b"\xff\x00", b"\xff") for x in re.split(rb"\xff+[\xd0-\xd7]", frame[at:end])], end


def _read(segment: bytes, units: list[tuple[list[int], list[int], int, list]]) -> None:
    """Fill each unit's coefficients: (DC codes, AC codes, component, 64 numbers), in the order of the segment."""
    raw = np.frombuffer(segment + b"\xff" * 8, np.uint8).astype(np.int64)
    window = (raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]).tolist()
    p, last, limit = 0, {}, 8 * len(segment) + 32
    for dc, ac, part, out in units:
        k = 0
        while k < 64:
            if p >= limit:
                raise ValueError("a scan ends before its blocks do")
            hit = (ac if k else dc)[window[p >> 3] >> (16 - (p & 7)) & 0xFFFF]
            if not hit:
                raise ValueError("no Huffman code begins with these bits")
            p += hit & 31
            run, size = hit >> 9, hit >> 5 & 15
            if k and not size:
                if run == 15:
                    k += 16
                    continue
                break
            value = 0
            if size:
                value = window[p >> 3] >> (32 - (p & 7) - size) & ((1 << size) - 1)
                p += size
                if value < 1 << (size - 1):
                    value -= (1 << size) - 1
            if not k:
                value = last[part] = last.get(part, 0) + value
            k += run if k else 0
            if k > 63:
                raise ValueError("a block has over 64 coefficients")
            out[k] = value
            k += 1


def decode(frame: bytes) -> list[np.ndarray]:
    """The planes of a baseline frame, each as its component is sampled: luma first."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    quants: dict[int, np.ndarray] = {}
    huffs = {k: codes(bytes(n), bytes.fromhex(v)) for k, (n, v) in STANDARD.items()}
    parts: dict[int, Part] = {}
    at, interval, width, height = 2, 0, 0, 0
    while at < len(frame):
        while frame[at + 1 : at + 2] == b"\xff":  # fill bytes
            at += 1
        code = frame[at + 1]
        if code == 0xD9:
            break
        n = struct.unpack_from(">H", frame, at + 2)[0]
        body, at = frame[at + 4 : at + 2 + n], at + 2 + n
        if code == 0xDB:
            i = 0
            while i < len(body):
                wide, size = body[i] >> 4, 64 * (1 + (body[i] >> 4))
                quants[body[i] & 15] = np.frombuffer(body[i + 1 : i + 1 + size], ">u2" if wide else np.uint8).astype(np.float64)
                i += 1 + size
        elif code == 0xC4:
            i = 0
            while i < len(body):
                n_codes = sum(body[i + 1 : i + 17])
                huffs[body[i]] = codes(body[i + 1 : i + 17], body[i + 17 : i + 17 + n_codes])
                i += 17 + n_codes
        elif code in (0xC0, 0xC1):
            precision, height, width, count = struct.unpack_from(">BHHB", body)
            if precision != 8:
                raise ValueError(f"samples of {precision} bits")
            for i in range(count):
                name, sampling, table = body[6 + 3 * i : 9 + 3 * i]
                parts[name] = Part(sampling >> 4, sampling & 15, table)
            most_h, most_v = max(p.h for p in parts.values()), max(p.v for p in parts.values())
            across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
            for p in parts.values():
                p.width, p.height = -(-width * p.h // most_h), -(-height * p.v // most_v)
                p.blocks = np.zeros((down * p.v, across * p.h, 64), np.int64)
        elif 0xC2 <= code <= 0xCF and code != 0xCC:
            raise ValueError(f"marker FF{code:02X} is not a baseline frame")
        elif code == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif code == 0xDA:
            chosen = [(parts[body[1 + 2 * i]], body[2 + 2 * i] >> 4, 0x10 | body[2 + 2 * i] & 15) for i in range(body[0])]
            segments, at = _segments(frame, at)
            if len(chosen) == 1:  # blocks of the component itself
                p, dc, ac = chosen[0]
                places = [[(0, r, c)] for r in range(-(-p.height // 8)) for c in range(-(-p.width // 8))]
            else:
                places = [[(i, r * p.v + y, c * p.h + x) for i, (p, _, _) in enumerate(chosen) for y in range(p.v) for x in range(p.h)] for r in range(down) for c in range(across)]
            step = interval or len(places)
            if len(segments) < -(-len(places) // step):
                raise ValueError("a scan has too few restart intervals")
            for k in range(0, len(places), step):
                units = [(i, r, c, [0] * 64) for unit in places[k : k + step] for i, r, c in unit]
                _read(segments[k // step], [(huffs[chosen[i][1]], huffs[chosen[i][2]], i, out) for i, _, _, out in units])
                for i, r, c, out in units:
                    chosen[i][0].blocks[r, c] = out
    if not parts:
        raise ValueError("no frame header")
    planes = []
    for p in parts.values():
        rows, cols, _ = p.blocks.shape
        light = np.clip(np.floor((p.blocks * quants[p.table]).reshape(-1, 64) @ inverse_dct() + 128.5), 0, 255).astype(np.uint8)
        planes.append(light.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * cols)[: p.height, : p.width])
    return planes
