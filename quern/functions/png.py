"""PNG images in numpy: decoding, grey levels, and the 64 by 64 levels by which a blank image is told."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from numpy.typing import NDArray

Bytes = NDArray[np.uint8]
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by colour type: grey, colour, palette, grey and alpha, colour and alpha.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: What red, green and blue weigh in 65536ths of a grey level.
GREY = (19595, 38470, 7471)


def _chunks(data: bytes) -> dict[bytes, bytes]:
    """The contents of each kind of chunk, one after the other."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, out = 8, {}
    while at + 8 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        out[name] = out.get(name, b"") + data[at + 8 : at + 8 + size]
        at += 12 + size
    return out


def _average(line: list[int], up: list[int], step: int) -> list[int]:
    for i, above in enumerate(up):
        left = line[i - step] if i >= step else 0
        line[i] = (line[i] + (left + above >> 1)) & 255
    return line


def _nearest(line: list[int], up: list[int], step: int) -> list[int]:
    """The filter that predicts a byte by whichever of its left, upper and upper left neighbours is nearest to left + up - corner."""
    for i, b in enumerate(up):
        a, c = (line[i - step], up[i - step]) if i >= step else (0, 0)
        to_a, to_b, to_c = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        line[i] = (line[i] + (a if to_a <= to_b and to_a <= to_c else b if to_b <= to_c else c)) & 255
    return line


def _unfiltered(raw: bytes, height: int, width: int, step: int) -> Bytes:
    """Rows of ``width`` bytes from filtered ones; ``step``: bytes from a byte to its left neighbour."""
    rows = np.frombuffer(raw, np.uint8)[: height * (width + 1)].reshape(height, width + 1)
    out = np.zeros((height, width), np.uint8)
    up = np.zeros(width, np.uint8)
    for y in range(height):
        kind, line = int(rows[y, 0]), rows[y, 1:]
        if kind == 1:
            padded = np.zeros(-(-width // step) * step, np.uint8)
            padded[:width] = line
            line = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:width]
        elif kind == 2:
            line = line + up
        elif kind in (3, 4):
            line = np.array((_average if kind == 3 else _nearest)(line.tolist(), up.tolist(), step), np.uint8)
        elif kind:
            raise ValueError(f"PNG filter {kind} is not known")
        out[y] = up = line
    return out


def grey(data: bytes) -> Bytes:
    """The grey levels of an image, rows by columns; alpha plays no part. Interlaced images are an error."""
    chunks = _chunks(data)
    if len(chunks.get(b"IHDR", b"")) < 13:
        raise ValueError("a PNG without a header")
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunks[b"IHDR"][:13])
    if interlaced or colour not in SAMPLES or depth not in (1, 2, 4, 8, 16):
        raise ValueError("a kind of PNG that is not supported")
    n = SAMPLES[colour]
    rows = _unfiltered(zlib.decompress(chunks.get(b"IDAT", b"")), height, -(-width * n * depth // 8), max(1, n * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        rows = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:, : width * n]
        if colour == 0:
            rows = rows * np.uint8(255 // ((1 << depth) - 1))
    pixels = rows.reshape(height, width, n)
    if colour == 3:
        pixels = np.frombuffer(chunks.get(b"PLTE", b""), np.uint8).reshape(-1, 3)[pixels[:, :, 0]]
    if pixels.shape[2] < 3:
        return pixels[:, :, 0]
    return (sum(w * pixels[:, :, i].astype(np.int64) for i, w in enumerate(GREY)) + 32768 >> 16).astype(np.uint8)


def _weights(size: int, to: int) -> NDArray[np.int64]:
    """Cubic weights from ``size`` places to ``to``, wide enough that all places count when there are fewer, in 2**22ths."""
    scale = size / to
    wide = max(scale, 1.0)
    centre = (np.arange(to) + 0.5) * scale
    low, high = np.maximum((centre - 2 * wide + 0.5).astype(int), 0), np.minimum((centre + 2 * wide + 0.5).astype(int), size)
    x = np.abs((np.arange(size) - centre[:, None] + 0.5) / wide)
    cubic = np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))
    cubic[(np.arange(size) < low[:, None]) | (np.arange(size) >= high[:, None])] = 0
    return np.floor(cubic / cubic.sum(axis=1, keepdims=True) * (1 << 22) + 0.5).astype(np.int64)


def resized(levels: Bytes, side: int = 64) -> Bytes:
    """A square of grey levels by cubic weights, columns first, each step rounded to whole levels."""
    whole = lambda x: np.clip(x + (1 << 21) >> 22, 0, 255)
    across = whole(levels.astype(np.int64) @ _weights(levels.shape[1], side).T)
    return whole(_weights(levels.shape[0], side) @ across).astype(np.uint8)


def level_count(data: bytes | None) -> int | None:
    """How many grey levels an image has at 64 by 64; None if it can't be decoded."""
    try:
        return len(np.unique(resized(grey(data)))) if data else None
    except (ValueError, zlib.error, IndexError, struct.error):
        return None
