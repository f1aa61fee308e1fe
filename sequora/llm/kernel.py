"""Vectorised word hashing over UTF-8 buffers, shared by the text operators.

Texts arrive as Arrow string columns, so a batch is one byte buffer plus
offsets; everything here is numpy over slices of that buffer, and what is made
at a time is bounded by slices of about a megabyte, however long a text is.  A
word is a maximal run of bytes other than space and 0x09-0x0D (all ASCII, so
UTF-8 sequences are never split).

Words are read eight bytes at a time, and each step scrambles what it has before
the next is added; words over LONG bytes go through xxhash.  Runs of words are
hashed by doubling: the hash of 2k words scrambles those of its two halves.  No
step is linear in the bytes or words, so no pattern of them cancels out, and a
hash depends on its own words alone, not on the slice they lie in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
STEP = 1 << 20
LONG = 64
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(8)] + [0xFFFFFFFFFFFFFFFF], U64)
_NEXT, _SIDE = U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), in place."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; a null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes each; a longer text is alone in its range."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


def parts(data: np.ndarray, offsets: np.ndarray, step: int = STEP) -> Iterator[tuple[int, int]]:
    """Byte ranges of about `step` bytes between the first and last offset; none ends within a word."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    while lo < hi:
        end = min(lo + step, hi)
        while end < hi:
            text_end = int(offsets[np.searchsorted(offsets, end)])
            space = SPACE[data[end : min(end + step, text_end)]]
            if space.any():
                end += int(space.argmax())
                break
            end = min(end + step, text_end)
            if end == text_end:
                break
        yield lo, end
        lo = end


def hashes(raw: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches of raw, which has eight bytes more at its end."""
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    h = mix(lens.astype(U64) * _SIDE)
    at, left, of = starts, np.where(lens > LONG, 0, lens), np.arange(len(starts))
    while len(of):
        h[of] = mix((h[of] ^ (eight[at] & _LOW_BYTES[np.minimum(left, 8)])) * _NEXT)
        more = left > 8
        at, left, of = at[more] + 8, left[more] - 8, of[more]
    view = memoryview(raw)
    for i in np.flatnonzero(lens > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(view[starts[i] : starts[i] + lens[i]])
    return h


def word_parts(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each part of the texts between `offsets`: its byte range, and the hash, byte start and byte end of each word in it."""
    for lo, hi in parts(data, offsets):
        raw = np.zeros(hi - lo + 8, np.uint8)
        raw[:-8] = data[lo:hi]
        space = SPACE[raw[:-8]]
        first = ~space
        first[1:] &= space[:-1]
        cuts = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
        first[cuts] = ~space[cuts]
        last = ~space
        last[:-1] &= space[1:] | first[1:]
        starts = np.flatnonzero(first)
        lens = np.flatnonzero(last) + 1 - starts
        if lower:
            raw = LOWER[raw]
        yield lo, hi, hashes(raw, starts, lens), starts + lo, starts + lens + lo


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts between `offsets`: a 64-bit hash, byte start and byte end of each word, and each text's first word (n + 1)."""
    found = [x[2:] for x in word_parts(data, offsets, lower)]
    if not found:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U64), z, z, np.zeros(len(offsets), np.int64)
    h, starts, ends = (np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*found, strict=True))
    return h, starts, ends, np.searchsorted(starts, offsets)


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each k consecutive word hashes (runs over text ends too; the caller masks those)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    power, width, out, at = h, 1, None, 0
    while True:
        if k & width:
            part = power[at : at + n]
            out = part.copy() if out is None else mix((out ^ U64(width)) * _NEXT + part)
            at += width
        width *= 2
        if width > k:
            break
        power = mix(power[: -(width // 2)] * _NEXT + power[width // 2 :] + _SIDE)
    return mix(out + U64(2 * seed + 1) * _SIDE)


def leftmost_minima(g: np.ndarray, w: int) -> np.ndarray:
    """Index of the smallest value in each w consecutive ones, the leftmost of equal ones.

    Values are compared by all but their lowest bits, which hold the place in a block of w: the choice depends on the w
    values alone.
    """
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = U64((1 << (w - 1).bit_length()) - 1)
    pad = -len(g) % w
    v = np.concatenate([g, np.full(pad, np.iinfo(U64).max, U64)]).reshape(-1, w) & ~low
    v |= np.arange(w, dtype=U64)
    before = np.minimum.accumulate(v, 1).ravel()[w - 1 : w - 1 + n]
    after = np.minimum.accumulate(v[:, ::-1], 1)[:, ::-1].ravel()[:n]
    block = np.arange(n) // w * w
    right = (before & ~low) < (after & ~low)  # of equal ones the left block's
    return np.where(right, (np.arange(n) + w - 1) // w * w + (before & low).astype(np.int64), block + (after & low).astype(np.int64))


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray, step: int = STEP // 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kept words of each text joined by one space: a buffer, and where each text starts and ends in it."""
    lens = ends - starts
    place = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(np.where(keep, lens + 1, 0), out=place[1:])
    out = np.full(int(place[-1]), 0x20, np.uint8)
    for i in range(0, len(lens), step):
        kept = np.flatnonzero(keep[i : i + step]) + i
        inner = np.cumsum(lens[kept]) - lens[kept]
        byte = np.arange(int(lens[kept].sum()))
        out[np.repeat(place[kept] - inner, lens[kept]) + byte] = data[np.repeat(starts[kept] - inner, lens[kept]) + byte]
    begin, end = place[first[:-1]], place[first[1:]]
    return out, begin, np.maximum(end - 1, begin)
