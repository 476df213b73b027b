"""Substring dedup: windows of words that occur anywhere else are found by Rabin-Karp hashes and removed.

Words are maximal runs of bytes other than white space (0x20, 0x09-0x0D). A word's hash is 64 bits
over its bytes, a window's is a Rabin-Karp polynomial over its words' hashes, modulo 2**64 and mixed.
All windows of all texts are counted over a Spark exchange by hash (``_repeats``); repeated windows
merge into maximal intervals, and their words go.

Two different windows are taken for equal with a chance of about n * n / 2**65 for n windows in all.

Defined results: null text has no words; a text shorter than a window keeps all; repeated rows are
texts like any other, so all copies of a repeated text of ``size`` words lose them all; null or
repeated ids don't matter, as rows are told apart by their place in the input; an empty table gives
an empty table; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import _bytes as B
from quire.llm import _repeats as R
from quire.llm import _spark as S

#: Words in a window.
WINDOW = 35


def _windows(buf: np.ndarray, offs: np.ndarray, size: int):
    """Starts and ends of words, first word of each whole window, and the windows' hashes."""
    starts, ends, text = B.words(buf, offs, B.SPACED)
    if len(starts) < size:
        return starts, ends, text, np.empty(0, np.int64), np.empty(0, np.uint64)
    hashes = B.window_hashes(B.span_hashes(buf, starts, ends), size)
    at = np.flatnonzero(text[: len(hashes)] == text[size - 1 :])
    return starts, ends, text, at, hashes[at]


def _intervals(gone: np.ndarray, first: np.ndarray) -> list[list[dict]]:
    """Maximal runs of removed words of each text, counted from its first word."""
    flag = np.append(gone, False)
    before = np.append(False, gone)
    cut = np.zeros(len(flag), bool)
    cut[first] = True
    a = np.flatnonzero(flag & (~before | cut))
    z = np.flatnonzero(before & (~flag | cut))
    out: list[list[dict]] = [[] for _ in first[1:]]
    for k, x, y in zip((np.searchsorted(first, a, "right") - 1).tolist(), a.tolist(), z.tolist(), strict=True):
        out[k].append({"first": x - int(first[k]), "after": y - int(first[k])})
    return out


def _kept(data: bytes, lo: int, hi: int, gone: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Words lo to hi without those that go, joined by one space."""
    keep = lo + np.flatnonzero(~gone[lo:hi])
    if len(keep) == hi - lo:
        return b" ".join(data[starts[lo] : ends[hi - 1]].split()) if hi > lo else b""
    return b" ".join([data[a:z] for a, z in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs``: the id, ``n_words``, ``n_removed``, ``kept`` (words joined by one
    space) and ``removed``, the maximal intervals [first word, word after the last) that went."""
    rows = S.row_keyed(docs, R.BLOCK_ROWS, id=F.col(id_col), text=F.col(text_col))
    live = R.repeated(rows, lambda buf, offs: _windows(buf, offs, size)[4], "windows")
    interval = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_removed long, kept string, removed array<struct<first:long,after:long>>"

    def finish(key: tuple, left: pa.Table, replies: pa.Table) -> pa.Table:
        again, ids, tables = R.joined(replies), left.column("id").combine_chunks(), []
        whole, bounds = B.buffer(left.column("text"))
        for i, j in B.pieces(bounds):
            buf, offs = whole[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            starts, ends, text, at, hashes = _windows(buf, offs, size)
            gone = B.covered(at[B.member(hashes, again)], size, len(starts))
            first = np.searchsorted(text, np.arange(j - i + 1))
            sums, data = np.append(0, np.cumsum(gone)), buf.tobytes()
            kept = [_kept(data, lo, hi, gone, starts, ends).decode() for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            columns = [ids.slice(i, j - i), pa.array(np.diff(first)), pa.array(sums[first[1:]] - sums[first[:-1]]), pa.array(kept, pa.string()), pa.array(_intervals(gone, first), interval)]
            tables.append(pa.Table.from_arrays(columns, names=["id", "n_words", "n_removed", "kept", "removed"]))
        return pa.concat_tables(tables) if tables else pa.table({c: pa.array([], t) for c, t in (("id", ids.type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("removed", interval))})

    return S.with_replies(rows, live, finish, schema).withColumnRenamed("id", id_col)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of ``substring_dedup`` over all documents, by windows of 35 words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
