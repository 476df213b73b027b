"""Byte codecs and the arithmetic coder as Arrow functions: what no built-in expression can do."""

from __future__ import annotations

import zlib
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CODECS = ("zlib", "zstd")


def pack(data: bytes, codec: str) -> bytes:
    if codec == "zlib":
        return zlib.compress(data, 9)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=19).compress(data)
    raise ValueError(f"codec is one of {CODECS}")


def unpack(data: bytes, codec: str) -> bytes:
    if codec == "zlib":
        return zlib.decompress(data)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data)
    raise ValueError(f"codec is one of {CODECS}")


def compressed(data: Column, codec: str) -> Column:
    """Compressed bytes; null stays null. ``auto`` takes the smaller result, the first codec on ties."""

    def each(s: pd.Series) -> pd.Series:
        if codec == "auto":
            return s.map(lambda x: None if x is None else min((pack(bytes(x), c) for c in CODECS), key=len))
        return s.map(lambda x: None if x is None else pack(bytes(x), codec))

    return F.pandas_udf(each, "binary")(data)


def decompressed(data: Column, codec: str) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else unpack(bytes(x), codec)), "binary")(data)


_TOP, _HALF, _QUARTER = 1 << 32, 1 << 31, 1 << 30
_MOST = 1 << 16


class _Model:
    """Adaptive counts of n symbols; halved before their sum passes ``_MOST``."""

    def __init__(self, n: int):
        self.counts = [1] * n

    def bounds(self, symbol: int) -> tuple[int, int, int]:
        low = sum(self.counts[:symbol])
        return low, low + self.counts[symbol], sum(self.counts)

    def find(self, at: int) -> int:
        for k, c in enumerate(self.counts):
            if at < c:
                return k
            at -= c
        raise ValueError("broken code")

    def saw(self, symbol: int) -> None:
        self.counts[symbol] += 1
        if sum(self.counts) > _MOST:
            self.counts = [(c + 1) // 2 for c in self.counts]


def arithmetic_encode(symbols: list[int], n: int) -> bytes:
    """Witten-Neal-Cleary coding with 32-bit bounds and an adaptive model of n symbols."""
    model, low, high, pending, bits = _Model(n), 0, _TOP - 1, 0, []

    def put(bit: int) -> None:
        nonlocal pending
        bits.append(bit)
        bits.extend([1 - bit] * pending)
        pending = 0

    for s in symbols:
        a, b, total = model.bounds(s)
        span = high - low + 1
        low, high = low + span * a // total, low + span * b // total - 1
        while True:
            if high < _HALF:
                put(0)
            elif low >= _HALF:
                put(1)
                low, high = low - _HALF, high - _HALF
            elif low >= _QUARTER and high < _HALF + _QUARTER:
                pending += 1
                low, high = low - _QUARTER, high - _QUARTER
            else:
                break
            low, high = 2 * low, 2 * high + 1
        model.saw(s)
    pending += 1
    put(0 if low < _QUARTER else 1)
    bits += [0] * (-len(bits) % 8)
    return bytes(int("".join(map(str, bits[a:b])), 2) for a, b in pairwise(range(0, len(bits) + 1, 8)))


def arithmetic_decode(data: bytes, n: int, length: int) -> list[int]:
    """The ``length`` symbols that ``arithmetic_encode`` coded."""
    model, low, high, out = _Model(n), 0, _TOP - 1, []
    source = ((byte >> k) & 1 for byte in data for k in range(7, -1, -1))
    code = 0
    for _ in range(32):
        code = 2 * code + next(source, 0)
    for _ in range(length):
        total = sum(model.counts)
        span = high - low + 1
        s = model.find(((code - low + 1) * total - 1) // span)
        a, b, _ = model.bounds(s)
        low, high = low + span * a // total, low + span * b // total - 1
        while True:
            if high < _HALF:
                pass
            elif low >= _HALF:
                low, high, code = low - _HALF, high - _HALF, code - _HALF
            elif low >= _QUARTER and high < _HALF + _QUARTER:
                low, high, code = low - _QUARTER, high - _QUARTER, code - _QUARTER
            else:
                break
            low, high, code = 2 * low, 2 * high + 1, 2 * code + next(source, 0)
        model.saw(s)
        out.append(s)
    return out


def arithmetic_coded(symbols: Column, n: int) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda x: arithmetic_encode(list(map(int, x)), n)), "binary")(symbols)


def arithmetic_decoded(data: Column, length: Column, n: int) -> Column:
    def each(code: pd.Series, count: pd.Series) -> pd.Series:
        return pd.Series([arithmetic_decode(bytes(c), n, int(k)) for c, k in zip(code, count, strict=True)])

    return F.pandas_udf(each, "array<int>")(data, length)


def half_precision(x: Column) -> Column:
    """Doubles as they come back from 16-bit floats."""
    return F.pandas_udf(lambda s: s.astype("float16").astype("float64"), "double")(x)
