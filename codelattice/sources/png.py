"""PNG images as grey values and back, with zlib alone."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by PNG colour type: grey, RGB, palette, grey with alpha, RGB with alpha.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: First row, first column, rows apart and columns apart of the seven passes of an interlaced file.
PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def decode_grey(data: bytes) -> np.ndarray:
    """Rows of grey values 0 to 255; alpha is ignored, colours are weighed 299, 587, 114 per mille."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG file")
    at, body, palette = len(SIGNATURE), b"", None
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, chunk = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
        at += size + 12
    if colour not in CHANNELS or depth not in (1, 2, 4, 8, 16):
        raise ValueError("not a kind of PNG file that is defined")
    raw, start, channels = np.frombuffer(zlib.decompress(body), np.uint8), 0, CHANNELS[colour]
    pixels = np.zeros((height, width, channels), np.int64)
    for y0, x0, dy, dx in PASSES if interlaced else ((0, 0, 1, 1),):
        target = pixels[y0::dy, x0::dx]
        if target.size:
            size = target.shape[0] * (1 + (target.shape[1] * channels * depth + 7) // 8)
            target[...] = _samples(raw[start : start + size], *target.shape, depth)
            start += size
    if colour == 3:
        pixels = palette[pixels[:, :, 0]].astype(np.int64)
    else:
        pixels = pixels >> 8 if depth == 16 else pixels * 255 // ((1 << depth) - 1)
    if colour in (0, 4):
        return pixels[:, :, 0]
    return (pixels[:, :, :3] @ np.array([299, 587, 114]) + 500) // 1000


def _samples(raw: np.ndarray, height: int, width: int, channels: int, depth: int) -> np.ndarray:
    """The samples (height, width, channels) of filtered lines of so many bits a sample."""
    lines = raw.reshape(height, -1)
    step = max(1, channels * depth // 8)
    out = np.zeros((height, lines.shape[1] - 1), np.int64)
    above = out[0]
    for y in range(height):
        out[y] = above = _unfiltered(int(lines[y, 0]), lines[y, 1:].astype(np.int64), above, step)
    if depth == 16:
        out = out[:, 0::2] << 8 | out[:, 1::2]
    elif depth < 8:
        bits = np.unpackbits(out.astype(np.uint8), axis=1).reshape(height, -1, depth)
        out = bits @ (1 << np.arange(depth)[::-1])
    return out[:, : width * channels].reshape(height, width, channels)


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return (line + above) % 256
    out = np.zeros_like(line)
    for i in range(len(line)):
        left = out[i - step] if i >= step else 0
        corner = above[i - step] if i >= step else 0
        if kind == 1:
            guess = left
        elif kind == 3:
            guess = (left + above[i]) // 2
        else:
            base = left + above[i] - corner
            guess = min((left, above[i], corner), key=lambda v: abs(base - v))
        out[i] = (line[i] + guess) % 256
    return out


def encode_rgb(pixels: np.ndarray) -> bytes:
    """A PNG file of an array (height, width, 3) of 0 to 255."""
    height, width, _ = pixels.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.astype(np.uint8).reshape(height, -1)], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def resized(grey: np.ndarray, side: int) -> np.ndarray:
    """Grey values on a side x side grid by bilinear interpolation of pixel centers."""
    if grey.shape == (side, side):
        return grey.astype(float)

    def spots(n):
        at = np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = spots(grey.shape[0])
    x0, x1, fx = spots(grey.shape[1])
    top = grey[y0][:, x0] * (1 - fx) + grey[y0][:, x1] * fx
    bottom = grey[y1][:, x0] * (1 - fx) + grey[y1][:, x1] * fx
    return top * (1 - fy)[:, None] + bottom * fy[:, None]
