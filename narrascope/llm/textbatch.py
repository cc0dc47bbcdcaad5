"""Texts of an Arrow column as byte arrays, their words, and 64-bit hashes of words and shingles.

All work is done on numpy arrays over blocks of about ``BLOCK`` bytes, so memory follows the block or the
longest single text, never the Arrow batch.  Null texts count as empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 19

# Workers are reused for many tasks: what Arrow frees goes back to the system at once.
pa.set_memory_pool(pa.system_memory_pool())

U = np.uint64
_GOLD = 0x9E3779B97F4A7C15
_ONES = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def _constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(_GOLD) + U(seed)) | U(1)


_PLACE = _constants(64, 23)
_START, _SIDE, _TWIST = (U(x) for x in _constants(3, 37).tolist())
#: Spans beyond this many bytes are hashed and compared one by one.
LONG = 256
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U)


#: Maps A-Z to a-z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words between ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False

#: Words of digits, small letters and anything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def string_column(col) -> pa.Array:
    """The column as one Arrow string array without nulls."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if col.null_count:
        col = pc.fill_null(col, "")
    return col


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array without a copy."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off


def blocks(col, size: int = BLOCK):
    """Yield ``(lo, hi, data, bounds)``: rows lo..hi of the column, their bytes, and each text's bounds in them."""
    data, off = raw(string_column(col))
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + size, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def codepoints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codepoints, byte positions) of UTF-8 bytes."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    c = data[at].astype(np.int32)
    if len(at) == len(data):
        return c, at
    wide = np.flatnonzero(c >= 0xC0)
    lead, p = c[wide], at[wide]
    tail = [data[np.minimum(p + k, len(data) - 1)].astype(np.int32) & 0x3F for k in (1, 2, 3)]
    two = (lead & 0x1F) << 6 | tail[0]
    three = (lead & 0x0F) << 12 | tail[0] << 6 | tail[1]
    four = (lead & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]
    c[wide] = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))
    return c, at


def word_spans(low: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, per_text): byte spans of the words, and the bounds of each text's words among them."""
    n = len(low)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    w = kind[low]
    first = w.copy()
    first[1:] &= ~w[:-1]
    at = bounds[:-1][bounds[:-1] < n]
    first[at] = w[at]
    last = w.copy()
    last[:-1] &= ~w[1:]
    at = bounds[1:][bounds[1:] > 0] - 1
    last[at] = w[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def eights(data: np.ndarray) -> np.ndarray:
    """The little-endian 64-bit number that starts at each byte, and one more; bytes beyond the end are 0."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ahead: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each byte span; ``ahead`` is ``eights(data)`` if it is at hand.

    Spans of up to eight bytes and one length never collide.  Longer ones run eight bytes at a time through two chained
    states of 64 bits, which each step scrambles without any linear relation between bytes; those beyond ``LONG``
    bytes through BLAKE2b.  So two given spans collide with a probability of about 2^-64.
    """
    if not len(starts):
        return np.zeros(0, U)
    ahead = eights(data) if ahead is None else ahead
    size = ends - starts
    x = ahead[starts] & _MASK[np.minimum(size, 8)]
    h = mix(x + _START)
    more = np.flatnonzero((size > 8) & (size <= LONG))
    if len(more):
        a, b = h[more], mix(x[more] * _TWIST + _SIDE)
        at, left = starts[more] + 8, size[more] - 8
        live = np.arange(len(more))
        while len(live):
            x = ahead[at[live]] & _MASK[np.minimum(left[live], 8)]
            one = mix(a[live] ^ x)
            b[live] = mix(b[live] + x * _TWIST) ^ one
            a[live] = one
            at[live] += 8
            left[live] -= 8
            live = live[left[live] > 0]
        h[more] = mix(a ^ (b << U(32) | b >> U(32)))
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(h + size.astype(U) * U(_GOLD))


def same_spans(x: np.ndarray, xs: np.ndarray, y: np.ndarray, ys: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of ``size`` bytes at ``xs`` and ``ys`` are equal, row by row; ``x`` and ``y`` are ``eights`` of the bytes."""
    same = np.ones(len(size), bool)
    live = np.flatnonzero(size <= LONG)
    for j in range(0, LONG, 8):
        live = live[size[live] > j]
        if not len(live):
            break
        differ = (x[xs[live] + j] ^ y[ys[live] + j]) & _MASK[np.minimum(size[live] - j, 8)]
        same[live[differ != 0]] = False
        live = live[differ == 0]
    for i in np.flatnonzero(size > LONG).tolist():
        at = np.append(np.arange(0, size[i] - 8, 8), size[i] - 8)
        same[i] = np.array_equal(x[xs[i] + at], y[ys[i] + at])
    return same


def sequence_hash(h: np.ndarray) -> int:
    """One hash for a whole sequence of hashes."""
    x = np.array([len(h)], U)
    for k in range(len(h)):
        x = mix(x * _TWIST + h[k : k + 1])
    return int(x[0])


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive entries."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, U)
    s = h[:m] * _PLACE[0]
    for j in range(1, k):
        s += h[j : m + j] * _PLACE[j]
    return mix(s)


def shingle_sets(col, k: int):
    """Yield ``(row, sorted distinct shingle hashes)``; a text of fewer words is one shingle, without words none."""
    for lo, hi, data, bounds in blocks(col):
        low = LOWER[data]
        starts, ends, per = word_spans(low, bounds, SPACED)
        h = span_hashes(low, starts, ends)
        s = shingle_hashes(h, k)
        for i in range(hi - lo):
            a, b = int(per[i]), int(per[i + 1])
            if b - a >= k:
                u = np.sort(s[a : b - k + 1])
                keep = np.empty(len(u), bool)
                keep[0] = True
                np.not_equal(u[1:], u[:-1], out=keep[1:])
                yield lo + i, u[keep]
            elif b > a:
                yield lo + i, np.array([sequence_hash(h[a:b])], U)
            else:
                yield lo + i, np.zeros(0, U)
