"""Which 64-bit keys occur more than once in a corpus, told to the blocks that hold them.

Each block sends its distinct keys, each with a flag for "more than once here", to the shards of
their hashes. So a passage that a third of all rows share costs one key for each block, not one for
each row, and keys spread evenly. A shard answers each block with those of its keys that repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm import _bytes as B
from quire.llm import _spark as S

BLOCK_ROWS = 512

_SENT = "shard int, _f long, _b long, keys binary, twice binary"
_TOLD = "_f long, _b long, keys binary"


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and whether each occurs more than once."""
    keys = np.sort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at], np.diff(np.append(at, len(keys))) > 1


def runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """The batch cut where the block changes: file, block, rows."""
    f, b = batch.column("_f").to_numpy(), batch.column("_b").to_numpy()
    if len(f):
        cut = [0, *(np.flatnonzero((f[1:] != f[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), len(f)]
        for i, j in zip(cut, cut[1:], strict=False):
            yield int(f[i]), int(b[i]), batch.slice(i, j - i)


def pack_by_shard(n: int, f: int, b: int, keys: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
    """A row for each shard: its part of the ascending keys and of the arrays beside them, as bytes."""
    owner = B.shard_of(keys, n)
    cut = np.flatnonzero(np.diff(owner)) + 1
    lo, hi = np.append(0, cut), np.append(cut, len(keys))
    part = lambda a: pa.array([a[i:j].tobytes() for i, j in zip(lo, hi, strict=True)], pa.binary())
    ids = owner[lo]
    fixed = [pa.array(ids, pa.int32()), pa.array(np.full(len(ids), f), pa.int64()), pa.array(np.full(len(ids), b), pa.int64())]
    return pa.RecordBatch.from_arrays([*fixed, part(keys), *map(part, more)], names=["shard", "_f", "_b", "keys", *(f"m{k}" for k in range(len(more)))])


def repeated(rows: DataFrame, keys_of: Callable[[np.ndarray, np.ndarray], np.ndarray], name: str) -> DataFrame:
    """``keys_of(buffer, offsets)`` gives the keys of some texts; one row of repeated keys for each block and shard.

    ``rows`` has _f, _b and text. The answer is written to the shared folder, so that the keys'
    shuffle is gone before the texts move.
    """
    n = S.shards(rows.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, b, part in runs(batch):
                buf, offs = B.buffer(part.column("text"))
                got = [keys_of(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in B.pieces(offs)]
                keys, twice = distinct(np.concatenate(got))
                if len(keys):
                    yield pack_by_shard(n, f, b, keys, twice).rename_columns(["shard", "_f", "_b", "keys", "twice"])
                B.release()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(f, b, np.frombuffer(k, np.uint64), np.frombuffer(t, bool)) for x in batches for f, b, k, t in zip(*(x.column(c).to_pylist() for c in ("_f", "_b", "keys", "twice")), strict=True)]
        if not held:
            return
        every = np.sort(np.concatenate([k for _, _, k, _ in held]))
        again = B.distinct(np.concatenate([every[1:][every[1:] == every[:-1]], *(k[t] for _, _, k, t in held)]))
        del every
        out = [(f, b, k[B.member(k, again)]) for f, b, k, _ in held]
        out = [(f, b, k) for f, b, k in out if len(k)]
        for i in range(0, len(out), 256):
            f, b, k = zip(*out[i : i + 256], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(b, pa.int64()), pa.array([x.tobytes() for x in k], pa.binary())], names=["_f", "_b", "keys"])

    sent = rows.select("_f", "_b", "text").mapInArrow(send, _SENT)
    return S.written(S.by_shard(sent, n, answer, _TOLD), name)


def joined(replies: pa.Table, column: str = "keys") -> np.ndarray:
    """All repeated keys of a block, ascending."""
    parts = [np.frombuffer(x, np.uint64) for x in replies.column(column).to_pylist() if x]
    return np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
