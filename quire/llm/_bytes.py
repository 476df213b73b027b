"""Vectorised work on the bytes of many texts: words, polynomial hashes, windows, coverage.

Texts arrive as Arrow string columns. Here they are one byte buffer with the offsets of the texts,
so that every step runs over megabytes at a time and never over single words in Python.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one step takes; longer single texts are still taken whole.
PIECE = 1 << 20
_LOW = 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step
        have += more
    return out


_POW = _powers(_BASE, 1 << _LOW)
_INV = _powers(_INVERSE, 1 << _LOW)
_INV_HIGH = _powers(pow(_INVERSE, 1 << _LOW, 1 << 64), 1 << 12)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def _inverse_power(at: np.ndarray) -> np.ndarray:
    return _INV[at & ((1 << _LOW) - 1)] * _INV_HIGH[at >> _LOW]


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags: True for bytes of words, False for bytes inside the given ranges."""
    table = np.ones(256, bool)
    for a, b in ranges:
        table[a : b + 1] = False
    return table


#: White space as words [^\x20\x09-\x0D]+ have it.
SPACED = separators((0x20, 0x20), (0x09, 0x0D))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes stay."""
    return _LOWER[buf]


def buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and offsets (one more than texts); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offs = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together; a longer text makes a range alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j
        i = j


def words(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; a word never crosses texts."""
    inside = np.zeros(len(buf) + 1, bool)
    inside[:-1] = table[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offs] = True
    before = np.zeros(len(buf) + 1, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first))
    ends = np.flatnonzero(before & (~inside | first))
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def _prefix_at(values, n: int, *marks: np.ndarray) -> list[np.ndarray]:
    """Sums of value[i] * BASE**i over i < mark, modulo 2**64; values(a, b) gives a slice; marks ascend."""
    out = [np.zeros(len(m), np.uint64) for m in marks]
    carry, scale = np.uint64(0), np.uint64(1)
    jump = np.uint64(pow(_BASE, 1 << _LOW, 1 << 64))
    done = [0] * len(marks)
    with np.errstate(over="ignore"):
        for a in range(0, n, 1 << _LOW):
            b = min(n, a + (1 << _LOW))
            sums = np.empty(b - a + 1, np.uint64)
            sums[0] = 0
            np.cumsum(values(a, b) * _POW[: b - a], out=sums[1:])
            for k, m in enumerate(marks):
                e = int(np.searchsorted(m, b, "right"))
                out[k][done[k] : e] = sums[m[done[k] : e] - a] * scale + carry
                done[k] = e
            carry = carry + sums[-1] * scale
            scale = scale * jump
    return out


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; starts and ends ascend."""
    p, q = _prefix_at(lambda a, b: _BYTE[buf[a:b]], len(buf), starts, ends)
    return mix((q - p) * _inverse_power(starts) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hashes modulo 2**64 of every ``size`` consecutive values (64-bit hashes themselves)."""
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    for a in range(0, n, 1 << _LOW):
        b = min(n, a + (1 << _LOW))
        part = values[a : b + size - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _POW_LONG[: len(part)], out=sums[1:])
        out[a:b] = mix((sums[size:] - sums[:-size]) * _INV[: b - a])
    return out


_POW_LONG = _powers(_BASE, (1 << _LOW) + (1 << 12))


def gram_hashes(buf: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` consecutive bytes."""
    return window_hashes(_BYTE[buf], size)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def covered(starts: np.ndarray, size: int | np.ndarray, n: int) -> np.ndarray:
    """Flags of n places: True inside any [start, start + size)."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge[:-1]) > 0


def member(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each x is among the ascending values."""
    if not len(ordered):
        return np.zeros(len(x), bool)
    at = np.searchsorted(ordered, x)
    at[at == len(ordered)] = 0
    return ordered[at] == x


def shard_of(h: np.ndarray, n: int) -> np.ndarray:
    """Shard 0 to n - 1 of each hash, ascending with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


# The five primes of XXH64, as published.
_X1, _X2, _X3, _X4, _X5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def _lane(x: np.ndarray) -> np.ndarray:
    return _turned(x * _X2, 31) * _X1


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of the bytes of each span, all spans a step at a time."""
    data = np.append(buf, np.zeros(8, np.uint8))
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    size, start = ends - starts, np.uint64(seed)
    # by what is left after steps of 32 bytes, so that those that take a step stand together
    order = np.argsort((31 - (size & 31)).astype(np.uint8), kind="stable")
    at, size = starts[order], size[order]
    left = size & 31
    with np.errstate(over="ignore"):
        h = np.full(len(at), start + _X5)
        on = np.flatnonzero(size >= 32)
        if len(on):
            lanes = [np.full(len(on), x) for x in (start + _X1 + _X2, start + _X2, start, start - _X1)]
            more, done = np.arange(len(on)), size[on] >> 5
            for step in range(int(done.max())):
                more = more[done[more] > step]
                place = at[on[more]] + 32 * step
                for k, v in enumerate(lanes):
                    v[more] = _turned(v[more] + eight[place + 8 * k] * _X2, 31) * _X1
            whole = sum(_turned(v, n) for v, n in zip(lanes, (1, 7, 12, 18), strict=True))
            for v in lanes:
                whole = (whole ^ _lane(v)) * _X1 + _X4
            h[on] = whole
            at = at + (size & ~31)
        h += size.astype(np.uint64)
        for k in range(3):
            n = int(np.searchsorted(-left, -8 * (k + 1), "right"))
            h[:n] = _turned(h[:n] ^ _lane(eight[at[:n] + 8 * k]), 27) * _X1 + _X4
        rest = eight[np.minimum(at + (left & ~7), len(eight) - 1)]
        four = left & 4
        h = np.where(four > 0, _turned(h ^ (rest & np.uint64(0xFFFFFFFF)) * _X1, 23) * _X2 + _X3, h)
        rest = rest >> (8 * four).astype(np.uint64)
        for k in range(3):
            h = np.where((left & 3) > k, _turned(h ^ (rest >> np.uint64(8 * k) & np.uint64(0xFF)) * _X5, 11) * _X1, h)
        h = (h ^ h >> np.uint64(33)) * _X2
        h = (h ^ h >> np.uint64(29)) * _X3
        out = np.empty(len(h), np.uint64)
        out[order] = h ^ h >> np.uint64(32)
    return out


def shingles(buf: np.ndarray, offs: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 and text number of every ``size`` consecutive words of the texts, A-Z in lower case and joined by one
    space; a text of fewer words, but not none, is one shingle."""
    # a space after each text, so that every word has a separator to keep
    low = np.insert(lowered(buf), offs[1:], 32)
    starts, ends, text = words(low, offs + np.arange(len(offs)), SPACED)
    n = len(starts)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    lens = ends - starts
    after = np.cumsum(lens + 1)
    keep = SPACED[low]
    keep[ends] = True
    line = low[keep]
    line[after - 1] = 32
    head = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    count = np.diff(np.append(head, n))
    short = head[count < size]
    first = np.append(np.flatnonzero(text[: n - size + 1] == text[size - 1 :]) if n >= size else np.empty(0, np.int64), short)
    last = np.append(first[: len(first) - len(short)] + size - 1, short + count[count < size] - 1)
    order = np.argsort(first, kind="stable")
    first, last = first[order], last[order]
    out = np.empty(len(first), np.uint64)
    for a in range(0, len(first), 1 << 14):
        f, z = first[a : a + (1 << 14)], last[a : a + (1 << 14)]
        base = int(after[f[0]] - lens[f[0]] - 1)
        out[a : a + (1 << 14)] = xxh64(line[base : after[z[-1]]], (after - lens - 1)[f] - base, (after - 1)[z] - base, seed)
    return out, text[first]


def squeezed(x: np.ndarray) -> bytes:
    """Numbers packed: their bytes of equal weight side by side, then Zstandard."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def spread(data: bytes, kind: type) -> np.ndarray:
    """What ``squeezed`` has packed."""
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def distinct(x: np.ndarray) -> np.ndarray:
    """Ascending distinct values, by sorting."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def find(x: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each x among the ascending values, and whether it is there."""
    if not len(ordered):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.searchsorted(ordered, x)
    at[at == len(ordered)] = 0
    return at, ordered[at] == x


def release() -> None:
    """Gives memory that was freed back to the system: Spark keeps its Python workers, and their heaps, for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
