"""8-bit PNG images as numpy arrays of (height, width, channels), and operations on them."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def encode_png(image: np.ndarray, level: int = 6) -> bytes:
    height, width, channels = image.shape
    kind = {n: k for k, n in _CHANNELS.items()}[channels]
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    rows = np.zeros((height, width * channels + 1), np.uint8)
    rows[:, 1:] = image.reshape(height, -1)
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """8-bit images without interlace: grey, grey and alpha, RGB, RGBA and palettes."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, body, palette, alpha = 8, b"", None, b""
    while at < len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        at += 12 + size
        if name == b"IHDR":
            width, height, depth, kind, _, _, interlace = struct.unpack(">IIBBBBB", part)
        elif name == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            alpha = part
        elif name == b"IDAT":
            body += part
    if depth != 8 or interlace or (kind not in _CHANNELS and kind != 3):
        raise ValueError("only 8-bit images without interlace are read")
    bpp = 1 if kind == 3 else _CHANNELS[kind]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width * bpp + 1)
    out = np.zeros((height, width * bpp), np.uint8)
    before = np.zeros(width * bpp, np.uint8)
    for y in range(height):
        out[y] = before = _unfilter(raw[y, 0], raw[y, 1:], before, bpp)
    if kind != 3:
        return out.reshape(height, width, bpp)
    image = palette[out]
    if alpha:
        table = np.full(len(palette), 255, np.uint8)
        table[: len(alpha)] = np.frombuffer(alpha, np.uint8)
        image = np.concatenate([image, table[out][..., None]], axis=2)
    return image


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, bpp: int) -> np.ndarray:
    if kind == 0:
        return line.copy()
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, bpp), axis=0, dtype=np.uint8).reshape(-1)
    out = np.zeros(len(line) + bpp, np.int32)
    up = np.concatenate([np.zeros(bpp, np.int32), above.astype(np.int32)])
    for i, value in enumerate(line.tolist()):
        left, top, corner = int(out[i]), int(up[i + bpp]), int(up[i])
        if kind == 3:
            guess = (left + top) >> 1
        else:
            p = left + top - corner
            guess = min((abs(p - left), 0, left), (abs(p - top), 1, top), (abs(p - corner), 2, corner))[2]
        out[i + bpp] = (value + guess) & 255
    return out[bpp:].astype(np.uint8)


def has_alpha(image: np.ndarray) -> bool:
    return image.shape[2] in (2, 4)


def is_opaque(image: np.ndarray) -> bool:
    return not has_alpha(image) or bool((image[..., -1] == 255).all())


def is_empty(image: np.ndarray) -> bool:
    return has_alpha(image) and not image[..., -1].any()


def flatten(image: np.ndarray, color=(255, 255, 255)) -> np.ndarray:
    """Drawn on a colour; without alpha as it is."""
    if not has_alpha(image):
        return image
    a = image[..., -1:].astype(np.int32)
    base = np.array(color[: image.shape[2] - 1], np.int32)
    return ((image[..., :-1] * a + base * (255 - a) + 127) // 255).astype(np.uint8)


def adjust(image: np.ndarray, brightness: float = 0.0, contrast: float = 1.0, gamma: float = 1.0) -> np.ndarray:
    v = np.arange(256, dtype=np.float64)
    with np.errstate(invalid="ignore"):
        curve = np.power((v - 127.5) * contrast / 255 + 0.5 + brightness / 255, gamma) * 255
    table = np.clip(np.floor(np.nan_to_num(curve, nan=0.0, posinf=255, neginf=0) + 0.5), 0, 255).astype(np.uint8)
    out = image.copy()
    colors = image.shape[2] - has_alpha(image)
    out[..., :colors] = table[image[..., :colors]]
    return out


def overlay(front: np.ndarray, back: np.ndarray) -> np.ndarray:
    """front drawn over back, both RGBA."""
    fa, ba = front[..., 3:].astype(np.int64), back[..., 3:].astype(np.int64)
    alpha = fa * 255 + ba * (255 - fa)
    color = front[..., :3] * fa * 255 + back[..., :3] * ba * (255 - fa)
    safe = np.where(alpha > 0, alpha, 1)
    return np.concatenate([(color + safe // 2) // safe, (alpha + 127) // 255], axis=2).astype(np.uint8)


def to_rgba(image: np.ndarray) -> np.ndarray:
    channels = image.shape[2]
    color = np.repeat(image[..., :1], 3, axis=2) if channels < 3 else image[..., :3]
    alpha = image[..., -1:] if has_alpha(image) else np.full((*image.shape[:2], 1), 255, np.uint8)
    return np.concatenate([color, alpha], axis=2)


def halve(image: np.ndarray) -> np.ndarray:
    """Mean of 2 x 2 blocks in each channel."""
    h, w, c = image.shape
    blocks = image.reshape(h // 2, 2, w // 2, 2, c).astype(np.int32)
    return ((blocks.sum(axis=(1, 3)) + 2) // 4).astype(np.uint8)


def enlarge(image: np.ndarray, steps: int, sub_x: int, sub_y: int) -> np.ndarray:
    """The sub-square of a tile 2**steps levels down, at full size, each pixel repeated."""
    size = image.shape[0]
    part = max(1, size >> steps)
    y, x = (sub_y * size) >> steps, (sub_x * size) >> steps
    index = np.arange(size) * part // size
    return image[y : y + part, x : x + part][index][:, index]


def dem_raw(image: np.ndarray) -> np.ndarray:
    rgb = image[..., :3].astype(np.int64)
    return rgb[..., 0] << 16 | rgb[..., 1] << 8 | rgb[..., 2]


def dem_halve(image: np.ndarray) -> np.ndarray:
    """Mean of 24-bit values of 2 x 2 blocks; with alpha only of visible pixels."""
    h, w, _ = image.shape
    fold = lambda v: v.reshape(h // 2, 2, w // 2, 2)
    raw = fold(dem_raw(image))
    if has_alpha(image):
        seen = fold(image[..., 3]) > 0
        n = seen.sum(axis=(1, 3))
        mean = ((raw * seen).sum(axis=(1, 3)) + n // 2) // np.maximum(n, 1)
        alpha = (fold(image[..., 3]).astype(np.int64).sum(axis=(1, 3)) + 2) // 4
        return np.stack([mean >> 16, mean >> 8 & 255, mean & 255, alpha], axis=2).astype(np.uint8)
    mean = (raw.sum(axis=(1, 3)) + 2) // 4
    return np.stack([mean >> 16, mean >> 8 & 255, mean & 255], axis=2).astype(np.uint8)
