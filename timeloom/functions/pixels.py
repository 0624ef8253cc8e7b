"""Pixel kernels: fixed-point arithmetic on whole arrays, exact to the bit.

A picture is a row-major buffer of four bytes a pixel (red, green, blue, alpha)
whose rows may be padded.  A descriptor is a 16 x 16 picture of three bytes a pixel.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The scale of scores, the side of descriptors, the weights of red,
# green and blue in 256ths.
SCALE = 10000
SIDE = 16
LUMA = (77, 150, 29)
ONE = 1 << 16
#: How far the crop search goes in from each edge, in cells: fixed values.
INSETS = (0, ONE // 2, ONE * 3 // 4, ONE)
# Bands of a hash, and how far a mean colour is shifted for its bucket.
BANDS = 4
BUCKET_SHIFT = 3


class PictureError(ValueError):
    """A buffer that isn't the picture it says it is."""


def picture(pixels: bytes, width: int, height: int, stride: int) -> np.ndarray:
    """height x width x 4, padding cut off."""
    if width <= 0 or height <= 0 or stride < 4 * width or len(pixels) != stride * height:
        raise PictureError(f"{width} x {height}, stride {stride}, {len(pixels)} bytes")
    return np.frombuffer(pixels, np.uint8).reshape(height, stride)[:, : 4 * width].reshape(height, width, 4)


def luma(rgb: np.ndarray) -> np.ndarray:
    w = np.array(LUMA, np.int64)
    return (rgb[..., :3].astype(np.int64) @ w + 128) >> 8


def luma_column(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(r * LUMA[0] + g * LUMA[1] + b * LUMA[2] + 128, 8)


def basis_points(difference, channels):
    """10000 less the mean difference, whose halves go up."""
    most = np.asarray(channels, np.int64) * 255
    return SCALE - np.minimum((np.asarray(difference, np.int64) * SCALE + most // 2) // np.maximum(most, 1), SCALE)


def most_difference(score, channels: int):
    """The largest sum of differences whose score isn't below ``score``."""
    most = channels * 255
    return ((SCALE + 1 - np.asarray(score, np.int64)) * most - most // 2 - 1) // SCALE


def sums_of_differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """n x m sums of n x planes x d and m x planes x d numbers, whose sums over a
    plane are below 2**16."""
    out = None
    for plane in range(a.shape[1]):
        x, y = a[:, plane].astype(np.int16), np.ascontiguousarray(b[:, plane].T, dtype=np.int16)
        total, d = np.zeros((len(x), y.shape[1]), np.uint16), np.empty((64, y.shape[1]), np.int16)
        for k in range(0, len(x), 64):  # rows whose differences stay in the cache
            part, into = x[k : k + 64], total[k : k + 64]
            d = d[: len(part)]
            for column, row in zip(part.T, y):
                np.subtract(row, column[:, None], out=d)
                np.abs(d, out=d)
                np.add(into, d.view(np.uint16), out=into)
        out = total if a.shape[1] == 1 else total.astype(np.int32) if out is None else out + total
    return out


def _sample(img: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear samples of (pictures of) h x w x 3 at 16.16 coordinates: len(y) x len(x) x 3."""
    h, w = img.shape[-3:-1]
    x0, y0 = np.minimum(x >> 16, w - 1), np.minimum(y >> 16, h - 1)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (x & 0xFFFF)[None, :, None], (y & 0xFFFF)[:, None, None]
    p = img.astype(np.int64)
    top, low = (p[..., r, :, :][..., x0, :] * (ONE - fx) + p[..., r, :, :][..., x1, :] * fx for r in (y0, y1))
    return np.minimum((top * (ONE - fy) + low * fy + (1 << 31)) >> 32, 255)


def resample(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, corners on corners: (pictures of) height x width x 3."""

    def axis(n: int, size: int) -> np.ndarray:
        return np.zeros(n, np.int64) if n <= 1 or size <= 1 else np.arange(n, dtype=np.int64) * (size - 1) * ONE // (n - 1)

    return _sample(img[..., :3], axis(width, img.shape[-2]), axis(height, img.shape[-3]))


def _bits(flags: np.ndarray) -> int:
    """First flag in the lowest bit, as a signed 64-bit number."""
    return int(np.packbits(flags.ravel().astype(np.uint8), bitorder="little").view(np.int64)[0])


def average_hash(img: np.ndarray) -> int:
    v = luma(resample(img, 8, 8)).ravel()
    return _bits(v >= (int(v.sum()) + 32) // 64)


def difference_hash(img: np.ndarray) -> int:
    """Of the descriptor: a bilinear 9 x 8 grid."""
    v = luma(resample(img, 9, 8))
    return _bits(v[:, :-1] > v[:, 1:])


def gate_hash(img: np.ndarray) -> int:
    """Of the group gate: a nearest 9 x 8 grid, another one than the descriptor's."""
    h, w = img.shape[:2]
    v = luma(img[np.arange(8) * (h - 1) // 7][:, np.arange(9) * (w - 1) // 8])
    return _bits(v[:, :-1] > v[:, 1:])


def descriptor(img: np.ndarray) -> bytes:
    return resample(img, SIDE, SIDE).astype(np.uint8).tobytes()


def described(imgs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Average hashes, difference hashes and descriptors of n pictures of one size."""
    bits = lambda flags: np.packbits(flags.reshape(len(imgs), 64), axis=1, bitorder="little").view(np.int64)[:, 0]
    v, w = luma(resample(imgs, 8, 8)).reshape(len(imgs), 64), luma(resample(imgs, 9, 8))
    return bits(v >= (v.sum(1, keepdims=True) + 32) // 64), bits(w[..., :-1] > w[..., 1:]), resample(imgs, SIDE, SIDE).astype(np.uint8)


def colour_bucket(d: np.ndarray) -> int:
    flat = d.reshape(-1, 3).astype(np.int64)
    q = np.minimum(((flat.sum(0) + len(flat) // 2) // len(flat)) >> BUCKET_SHIFT, 31)
    return int(q[0] | q[1] << 5 | q[2] << 10)


def near_buckets(bucket: int) -> list[int]:
    """The bucket and all within two steps in each colour."""
    parts = [bucket >> s & 31 for s in (0, 5, 10)]
    r, g, b = ([x for x in range(p - 2, p + 3) if 0 <= x <= 31] for p in parts)
    return [x | y << 5 | z << 10 for x in r for y in g for z in b]


def near_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of n x m buckets are within two steps in each colour."""
    out = np.ones((len(a), len(b)), bool)
    for s in (0, 5, 10):
        out &= np.abs((a >> s & 31).astype(np.int8)[:, None] - (b >> s & 31).astype(np.int8)[None]) <= 2
    return out


def rgb_similarity(a: np.ndarray, b: np.ndarray) -> int:
    if a.shape != b.shape:
        raise PictureError("sizes differ")
    d = np.abs(a[..., :3].astype(np.int64) - b[..., :3].astype(np.int64))
    return int(basis_points(d.sum(), d.size))


def luma_similarity(a: np.ndarray, b: np.ndarray) -> int:
    if a.shape != b.shape:
        raise PictureError("sizes differ")
    d = np.abs(luma(a) - luma(b))
    return int(basis_points(d.sum(), d.size))


def shifted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best likeness of n pairs of descriptors over moves of one cell."""
    best = np.zeros(len(a), np.int64)
    a, b = a.astype(np.int16), b.astype(np.int16)
    cut = {-1: (slice(1, None), slice(None, -1)), 0: (slice(None), slice(None)), 1: (slice(None, -1), slice(1, None))}
    for ya, yb in cut.values():
        for xa, xb in cut.values():
            d = np.abs(a[:, ya, xa] - b[:, yb, xb])
            best = np.maximum(best, basis_points(d.sum((1, 2, 3), dtype=np.int64), d[0].size if len(d) else 1))
    return best


def _axis_weights(inset: int) -> np.ndarray:
    """16 x 16 numbers that sample an axis cut by ``inset`` on both sides."""
    span = ((SIDE - 1) << 16) - 2 * inset
    at = inset + np.arange(SIDE, dtype=np.int64) * span // (SIDE - 1)
    lo, f = np.minimum(at >> 16, SIDE - 1), at & 0xFFFF
    w = np.zeros((SIDE, SIDE), np.int64)
    np.add.at(w, (np.arange(SIDE), lo), ONE - f)
    np.add.at(w, (np.arange(SIDE), np.minimum(lo + 1, SIDE - 1)), f)
    return w


# whole numbers below 2**53 as doubles: products and sums are exact
_WEIGHTS = {i: _axis_weights(i).astype(np.float64) for i in INSETS}


def crops(x: np.ndarray) -> np.ndarray:
    """All crops of n descriptors, resampled: crops x n x 768."""
    rows = np.ascontiguousarray(np.moveaxis(x, 3, 1), dtype=np.float64)  # n, colour, y, x
    wide = {i: rows @ _WEIGHTS[i].T for i in INSETS}
    out = []
    for ix in INSETS:
        for iy in INSETS:
            if ix or iy:
                s = np.minimum(np.floor((_WEIGHTS[iy] @ wide[ix] + (1 << 31)) / 2.0**32), 255)
                out.append(np.moveaxis(s.astype(np.int16), 1, 3).reshape(len(x), -1))
    return np.stack(out)


def cropped_of(a: np.ndarray, ia: np.ndarray, b: np.ndarray, ib: np.ndarray, at_once: int = 1024) -> np.ndarray:
    """Best likeness of the pairs a[ia], b[ib] over crops of the first, then of the
    second; each descriptor is cropped once, however many pairs it is in."""
    least = np.full(len(ia), np.iinfo(np.int64).max)
    for source, i, target, j in ((a, ia, b, ib), (b, ib, a, ia)):
        flat = target.reshape(len(target), -1).astype(np.int16)
        for cut in crops(source):
            for k in range(0, len(i), at_once):
                part = slice(k, k + at_once)
                d = np.abs(cut[i[part]] - flat[j[part]]).sum(1, dtype=np.int64)
                np.minimum(least[part], d, out=least[part])
    return basis_points(least, a[0].size if len(a) else 1)


def cropped(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    every = np.arange(len(a))
    return cropped_of(a, every, b, every)


def confirm(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of n pairs of n x 16 x 16 x 3 descriptors."""
    return np.maximum(shifted(a, b), cropped(a, b))


def confirm_of(a: np.ndarray, ia: np.ndarray, b: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Likeness of the pairs a[ia], b[ib]."""
    moved = [shifted(a[ia[k : k + 1024]], b[ib[k : k + 1024]]) for k in range(0, len(ia), 1024)]
    return np.maximum(np.concatenate(moved), cropped_of(a, ia, b, ib))


_MOVES = {-1: (slice(1, None), slice(None, -1)), 0: (slice(None), slice(None)), 1: (slice(None, -1), slice(1, None))}


def coarse(x: np.ndarray) -> np.ndarray:
    """Sums over 2 x 2 cells, and over what is left at an odd edge: n x planes x 64."""
    for axis in (1, 2):
        x = np.add.reduceat(x.astype(np.int16), np.arange(0, x.shape[axis], 2), axis=axis)
    return np.ascontiguousarray(np.moveaxis(x.reshape(len(x), 64, -1), 2, 1))


class Views:
    """n descriptors of n x 16 x 16 x planes under all moves and crops, as the left and
    the right of a pair: the cells, and their coarse sums, which differ by no more
    than the cells do."""

    def __init__(self, x: np.ndarray):
        self.x = x.astype(np.int16)
        cut = [c.reshape(x.shape) for c in crops(x)]
        moves = [(self.x[:, ya, xa], self.x[:, yb, xb]) for ya, yb in _MOVES.values() for xa, xb in _MOVES.values()]
        plain, sums = (self.x, coarse(x)), [(c, coarse(c)) for c in cut]
        self.left = [*((m, coarse(m)) for m, _ in moves), *sums, *[plain] * len(cut)]
        self.right = [*((m, coarse(m)) for _, m in moves), *[plain] * len(cut), *sums]


def likeness_above(a: Views, rows: slice, b: Views, asked: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The likeness of pairs of a[rows] and b. asked: which pairs, and for each row a
    score. A pair that reaches a score it was asked for has its likeness, any other
    a number below all of those scores."""
    best = np.full((rows.stop - rows.start, len(b.x)), -1, np.int16)
    for (x, cx), (y, cy) in zip(a.left, b.right):
        x, d, size = x[rows], sums_of_differences(cx[rows], cy), x[0].size
        hope = np.zeros(d.shape, bool)
        for pairs, least in asked:
            hope |= pairs & (d <= np.minimum(most_difference(least, size), np.iinfo(d.dtype).max).astype(d.dtype)[:, None])
        i, j = np.nonzero(hope)
        x, y = x.reshape(len(x), -1), y.reshape(len(y), -1)
        for k in range(0, len(i), 1024):
            p, q = i[k : k + 1024], j[k : k + 1024]
            cells = x[p]
            cells -= y[q]
            np.abs(cells, out=cells)
            best[p, q] = np.maximum(best[p, q], basis_points(cells.sum(1, dtype=np.int64), size))
    return best


def hybrid(a: np.ndarray, b: np.ndarray, max_distance: int = 8, least: int = 9700) -> str:
    """hash rejected, pixels rejected or accepted."""
    if a.shape != b.shape:
        raise PictureError("sizes differ")
    if ((gate_hash(a) ^ gate_hash(b)) & (2**64 - 1)).bit_count() > max_distance:
        return "hash rejected"
    return "accepted" if rgb_similarity(a, b) >= least else "pixels rejected"


def preview_size(width: int, height: int, edge: int) -> tuple[int, int]:
    """Within ``edge``, never enlarged, halves up, one pixel at least."""
    longest = max(width, height)
    if longest <= edge:
        return width, height
    return tuple(max(1, (x * edge + longest // 2) // longest) for x in (width, height))


def preview(img: np.ndarray, edge: int) -> np.ndarray:
    h, w = img.shape[:2]
    pw, ph = preview_size(w, h, edge)
    return img[np.arange(ph) * h // ph][:, np.arange(pw) * w // pw]


def encode_png(img: np.ndarray) -> bytes:
    """A lossless PNG of h x w x 3 or 4."""
    h, w, c = img.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = np.concatenate([np.zeros((h, 1), np.uint8), img.astype(np.uint8).reshape(h, w * c)], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", w, h, 8, 6 if c == 4 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


# Column forms

def band(h: Column, k: int) -> Column:
    return F.shiftrightunsigned(h, 16 * k).bitwiseAND(F.lit(65535)).cast("int")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("long")


def hash_score(d: Column) -> Column:
    x = d * SCALE + 32
    return (F.lit(SCALE) - (x - x % 64) / 64).cast("long")


def bits(flags: Column) -> Column:
    """An array of up to 64 booleans as a number, the first in the lowest bit."""
    return F.aggregate(
        F.transform(flags, lambda f, i: F.when(f, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x),
    )


def grid_average_hash(v: Column) -> Column:
    """Average hash of an array of 64 luma values."""
    total = F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x) + 32
    mean = ((total - total % 64) / 64).cast("long")
    return bits(F.transform(v, lambda x: x >= mean))


def grid_difference_hash(v: Column) -> Column:
    """Left greater than right within the rows of an 8 x 8 grid: 7 bits a row."""
    places = F.array(*[F.lit(r * 8 + c) for r in range(8) for c in range(7)])
    return bits(F.transform(places, lambda p: F.element_at(v, p + 1) > F.element_at(v, p + 2)))


def mean_absolute(a: Column, b: Column, n: int) -> Column:
    d = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda s, x: s + x)
    x = d * SCALE + (n * 255) // 2
    return (F.lit(SCALE) - (x - x % (n * 255)) / (n * 255)).cast("long")


def sample_at(pixels: Column, width: Column, height: Column, stride: Column, x: Column, y: Column) -> Column:
    """RRGGBBAA of a pixel, null outside."""
    inside = (x >= 0) & (y >= 0) & (x < width) & (y < height) & (stride >= width * 4) & (F.octet_length(pixels) == stride * height)
    return F.when(inside, F.hex(F.substring(pixels, y * stride + x * 4 + 1, F.lit(4))))
