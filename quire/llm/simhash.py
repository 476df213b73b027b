"""SimHash near-dedup with an inverted index of positional bytes.

A text's fingerprint has 64 bits: bit k is 1 if it is set in over half of the hashes of the text's word
shingles. Two fingerprints of eight bytes that differ in at most ``bits`` bits agree in at least 8 - ``bits``
bytes at their places: the guaranteed minimum. The index has lists of the fingerprints that hold the same
bytes at some places. With lists by single bytes, N fingerprints make N * N / 64 pairs; lists by ``TOGETHER``
bytes make 2**16 times fewer, and fewer places need lists: of any ``bits`` + ``TOGETHER`` places, linked
fingerprints agree in ``TOGETHER``. Each pair that meets in a list is tallied over all eight bytes; those
below the minimum go, and the others are verified bit by bit.

Equal fingerprints are one member of the index, so copies cost nothing there. A list gives the links that join
its components, not all its pairs; long lists are split over tasks (``_lists``). Components are joined in
Spark (``_components``).

Defined results: null text has no words, its fingerprint is zero and links like any other; ids may be
null (a component's id is the least that is not null) or repeated; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import _bytes as B
from quire.llm import _components as C
from quire.llm import _lists as X
from quire.llm import _spark as S

#: Words in a shingle, and most bits in which linked fingerprints differ.
WORDS = 4
BITS = 4
#: Positional bytes that a list has in common, unless the guaranteed minimum is less.
TOGETHER = 3
SEED = 42

_LANES = np.uint64(0x0101010101010101)


def fingerprints_of(buf: np.ndarray, offs: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The 64-bit fingerprints of texts."""
    hashes, text = B.shingles(buf, offs, words, SEED)
    out = np.zeros(len(offs) - 1, np.uint64)
    if not len(hashes):
        return out
    head = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    out[text[head]] = majority(hashes, head)
    return out


def majority(hashes: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of the hashes of each run; ``head``: where runs begin, 0 first."""
    size = np.diff(np.append(head, len(hashes)))
    # bits are counted in eight lanes of a byte, for at most 255 hashes at a time
    parts = -(-size // 255)
    owner = np.repeat(np.arange(len(head)), parts)
    first = np.cumsum(parts) - parts
    step = head[owner] + 255 * (np.arange(len(owner)) - first[owner])
    count = np.empty((len(head), 64), np.int64)
    for k in range(8):
        lanes = np.add.reduceat(hashes >> np.uint64(k) & _LANES, step).astype("<u8").view(np.uint8).reshape(-1, 8)
        count[:, k::8] = np.add.reduceat(lanes, first, axis=0, dtype=np.int64)
    return np.packbits(2 * count > size[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """_f, _r (the row's place), id and fp (the fingerprint as a signed long) of every row, as a written table."""
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = B.buffer(batch.column("text"))
            found = [np.empty(0, np.uint64), *(fingerprints_of(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], words) for i, j in B.pieces(offs))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_f", "_r", "id")), pa.array(np.concatenate(found).view(np.int64))], names=["_f", "_r", "id", "fp"])
            B.release()

    rows = S.row_keyed(docs, 1, id=F.col(id_col), text=F.col(text_col)).drop("_b")
    return S.written(rows.mapInArrow(each, f"_f long, _r long, id {kind}, fp long"), "fingerprints")


def lists(fp: Column, bits: int) -> Column:
    """The keys of a fingerprint's lists: for each choice of places, a hash of its bytes there and of the choice."""
    together = min(TOGETHER, 8 - bits)
    keys = []
    for k, places in enumerate(combinations(range(bits + together), together)):
        mask = sum(0xFF << 8 * p for p in places)
        keys.append(F.xxhash64(fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)), F.lit(k)))
    return F.array(*keys)


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many positional bytes the fingerprints of each pair share."""
    x = a ^ b
    x = x | x >> np.uint64(4)
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return 8 - np.bitwise_count(x & _LANES).astype(np.int8)


def linked(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs reach the guaranteed minimum of shared bytes and, verified, differ in few enough bits."""
    out = tally(a, b) >= 8 - bits
    out[out] = np.bitwise_count((a ^ b)[out]) <= bits
    return out


def links(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the components of the members of each list (``keys`` ascend): fingerprint and its component's first."""
    return X.few(fps, *X.pairs(keys, lambda a, b: linked(fps[a], fps[b], bits)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """_f, _r (the row's place), id, fp, root (the component's least fingerprint) and component_id (the least
    id that the row reaches by links)."""
    if not 0 <= bits < 8:
        raise ValueError("bits is 0 to 7")
    fps = fingerprints(docs, id_col, text_col, words)
    classes = S.written(fps.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    postings = classes.select(F.explode(lists(F.col("fp"), bits)).alias("list"), F.col("fp").alias("member"))
    found = C.components(X.met(postings, lambda keys, members, _: links(keys, members, bits)))
    joined = classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = S.written(joined, "classes")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(joined.join(least, "root").select("fp", "root", "component_id"), "fp").select("_f", "_r", "id", "fp", "root", "component_id")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: shingles of 4 words, at most 4 differing bits."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
