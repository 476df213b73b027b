"""Suffix-array dedup: bytes inside a string of ``size`` bytes that also starts in a text with a smaller id go.

1. A string's anchor is the least hash of its grams of ``GRAM`` bytes; equal strings have equal anchors.
   Neighbouring strings with one anchor make a segment of bounded length. Each block sends, for each of
   its distinct segments, the anchor, a 64-bit hash of all its bytes and the least id that holds it to
   the shard of the anchor. Copies of a passage are one segment, however many rows hold them.
2. The shard tells the blocks which anchors occur elsewhere. Where all segments of an anchor are the same
   string, its least id is the answer. The other anchors' segments meet again with their bytes. Those
   of an anchor that very many blocks hold go one string at a time by the string's own hash, so no
   anchor gathers in one task.
3. There the suffixes of all segments are put in order by column-wise construction of their collection's
   Burrows-Wheeler transform and common prefixes (``_columns``). Neighbours with ``size`` bytes in
   common are one string; the least id of each string goes back to the blocks.
4. A block marks the strings whose least id is below their own text's and cuts out what they cover.

Two different segments are taken for one only if both the anchors and the 64-bit hashes agree.

Defined results: null text is empty; shorter texts stay whole; rows with the same id don't remove each
other's bytes; a null id counts as larger than all; an empty table gives an empty table; other columns
are ignored. Kept bytes may begin or end inside a code point; ``kept_text`` drops such broken ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import _bytes as B
from quire.llm import _columns as C
from quire.llm import _repeats as R
from quire.llm import _spark as S

#: Bytes in a string.
SIZE = 50
#: Most bytes in a gram.
GRAM = 20
#: Most strings in a segment.
RUN = 48
#: An anchor with so many different segments, counted by block, is held by many.
MANY = 4096
#: Bytes of segments that one construction takes; an anchor's segments stay together.
BATCH = 1 << 20
_LAST = np.iinfo(np.int64).max

_PRINTS = "shard int, _f long, _b long, keys binary, prints binary, least binary, several binary, base long"
_TOLD = "_f long, _b long, keys binary, least binary, mixed binary, many binary"
_BYTES = "shard int, _f long, _b long, keys binary, number binary, lens binary, least binary, data binary"
_REPLY = "_f long, _b long, number binary, runs binary, lens binary, lowest binary"


def _names(schema: str) -> list[str]:
    return schema.replace(",", "").split()[::2]


def _segments(buf: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First string, number of strings and anchor of every segment; none crosses texts."""
    gram = min(GRAM, size)
    if len(buf) < size:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    # least hashes are small numbers; mixed, they spread evenly over shards
    anchors = B.mix(B.sliding_min(B.gram_hashes(buf, gram), size - gram + 1))
    inner, n = offs[1:-1], len(anchors)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.clip(inner - size + 1, 0, n), 1)
    np.add.at(edge, np.clip(inner, 0, n), -1)
    whole = np.cumsum(edge[:-1]) == 0
    other = np.ones(n + 1, bool)
    other[1:-1] = (anchors[1:] != anchors[:-1]) | ~whole[:-1] | ~whole[1:]
    a, z = np.flatnonzero(whole & other[:-1]), np.flatnonzero(whole & other[1:]) + 1
    starts, counts = _split(a, z - a, np.full(len(a), RUN))
    return starts, counts, anchors[starts]


def _split(starts: np.ndarray, counts: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run cut into runs of at most ``most`` strings."""
    parts = -(-counts // most)
    owner = np.repeat(np.arange(len(starts)), parts)
    at = starts[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * most[owner]
    return at, np.minimum((starts + counts)[owner] - at, most[owner])


def _each(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and place in its owner of each of ``counts`` members."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _prints(buf: np.ndarray, offs: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Distinct segments of some texts, by ascending anchor: anchor, hash, least id, whether several times."""
    found = []
    for i, j in B.pieces(offs):
        part, bounds = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        starts, counts, keys = _segments(part, bounds, size)
        found.append((keys, B.span_hashes(part, starts, starts + counts + size - 1), ids[i + np.searchsorted(bounds, starts, "right") - 1]))
    keys, prints, own = map(np.concatenate, zip(*found, strict=True))
    order = np.argsort(prints)
    head = np.flatnonzero(np.append(True, np.diff(prints[order]) != 0)[: len(order)])
    least = np.minimum.reduceat(own[order], head) if len(head) else own
    several = np.diff(np.append(head, len(order))) > 1
    keys, prints = keys[order][head], prints[order][head]
    order = np.argsort(keys)
    return keys[order], prints[order], least[order], several[order]


def _tell(held: list[tuple]) -> Iterator[tuple]:
    """From all segments of a shard, what each block needs to know: _TOLD."""
    keys, prints, least, several = (np.concatenate([x[k] for x in held]) for k in (2, 3, 4, 5))
    order = np.argsort(keys)
    ordered = keys[order]
    head = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    count = np.diff(np.append(head, len(keys)))
    by = prints[order]
    uniform = np.minimum.reduceat(by, head) == np.maximum.reduceat(by, head)
    live = (count > 1) | np.logical_or.reduceat(several[order], head)
    lowest = np.minimum.reduceat(least[order], head)
    group = np.empty(len(keys), np.int64)
    group[order] = np.repeat(np.arange(len(head)), count)
    mixed = live & ~uniform
    at = 0
    for f, b, k, _, own, sev in held:
        g = group[at : at + len(k)]
        at += len(k)
        one = live[g] & uniform[g] & (sev | (own > lowest[g]))
        more = mixed[g] & np.append(True, k[1:] != k[:-1])
        if one.any() or more.any():
            yield f, b, k[one].tobytes(), lowest[g[one]].tobytes(), k[more].tobytes(), (count[g[more]] >= MANY).tobytes()


class _Block:
    """A block's texts with what it was told: strings known to go, and segments that need their bytes."""

    def __init__(self, left: pa.Table, replies: pa.Table, size: int):
        left = left.take(pa.array(np.argsort(left.column("_r").to_numpy(), kind="stable")))
        self.rows, self.ids = left, left.column("id").fill_null(_LAST).to_numpy()
        self.buf, self.offs = B.buffer(left.column("text"))
        told = [x for x in replies.to_pylist() if x["keys"] is not None]
        join = lambda c, kind: np.frombuffer(b"".join(x[c] for x in told), kind)
        keys, least, mixed, many = join("keys", np.uint64), join("least", np.int64), join("mixed", np.uint64), join("many", bool)
        by, every = np.argsort(keys), np.sort(mixed)
        keys, least, many = keys[by], least[by], np.sort(mixed[many])
        gone, open_ = [], []
        for i, j in B.pieces(self.offs) if told else ():
            base = self.offs[i]
            buf, offs = self.buf[base : self.offs[j]], self.offs[i : j + 1] - base
            starts, counts, anchors = _segments(buf, offs, size)
            text = i + np.searchsorted(offs, starts, "right") - 1
            one = np.flatnonzero(B.member(anchors, keys))
            one = one[least[np.searchsorted(keys, anchors[one])] < self.ids[text[one]]]
            gone.append((starts[one] + base, counts[one] + size - 1))
            on = np.flatnonzero(B.member(anchors, every))
            hot = B.member(anchors[on], many)
            cold, hot = on[~hot], on[hot]
            open_.append((starts[cold] + base, counts[cold], anchors[cold]))
            at, _ = _split(starts[hot], counts[hot], np.ones(len(hot), np.int64))
            open_.append((at + base, np.ones(len(at), np.int64), B.span_hashes(buf, at, at + size)))
        none = (np.empty(0, np.int64),) * 2
        self.gone = tuple(map(np.concatenate, zip(none, *gone, strict=True)))
        self.starts, self.counts, key = map(np.concatenate, zip((*none, np.empty(0, np.uint64)), *open_, strict=True))
        self.text = np.searchsorted(self.offs, self.starts, "right") - 1
        data, known = self.buf.tobytes(), {}
        self.number = np.fromiter((known.setdefault(data[a:z], len(known)) for a, z in zip(self.starts.tolist(), (self.starts + self.counts + size - 1).tolist(), strict=True)), np.int64, len(self.starts))
        self.contents = list(known)
        first = np.empty(len(known), np.int64)
        first[self.number[::-1]] = np.arange(len(self.number))[::-1]
        self.key, self.strings = key[first], self.counts[first]
        self.least = np.full(len(known), _LAST)
        np.minimum.at(self.least, self.number, self.ids[self.text])


def _shared_parts(data: np.ndarray, lens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Content, first string and number of strings of each run of strings that may occur in several contents."""
    ends = np.cumsum(lens)
    counts = lens - size + 1
    owner, nth = _each(counts)
    hashes = B.gram_hashes(data, size)[(ends - lens)[owner] + nth]
    order = np.sort(hashes)
    on = B.member(hashes, B.distinct(order[1:][order[1:] == order[:-1]]))
    edge = np.append(True, owner[1:] != owner[:-1])
    a = np.flatnonzero(on & (edge | ~np.append(False, on[:-1])))
    z = np.flatnonzero(on & (np.append(edge[1:], True) | ~np.append(on[1:], False))) + 1
    return owner[a], nth[a], z - a


def _least_ids(keys: np.ndarray, contents: list[bytes], least: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For every string of the contents (one after another), the least id that holds it; and their bounds.

    Contents with one key meet, about ``BATCH`` bytes at a time. Only runs of strings whose hash occurs
    again are put in order, equal runs as one; what is equal is decided on their bytes.
    """
    lens = np.fromiter(map(len, contents), np.int64, len(contents))
    bound = np.append(0, np.cumsum(lens - size + 1))
    out = np.repeat(least, lens - size + 1)
    for at in _batches(keys, lens):
        owner, first, count = _shared_parts(np.frombuffer(b"".join([contents[i] for i in at.tolist()]), np.uint8), lens[at], size)
        owner = at[owner]
        known: dict[bytes, int] = {}
        number = np.fromiter((known.setdefault(contents[c][a:z], len(known)) for c, a, z in zip(owner.tolist(), first.tolist(), (first + count + size - 1).tolist(), strict=True)), np.int64, len(owner))
        parts = list(known)
        if not parts:
            continue
        key, own = np.empty(len(parts), np.uint64), np.full(len(parts), _LAST)
        key[number] = keys[owner]
        np.minimum.at(own, number, least[owner])
        low, start = _ordered(key, parts, own, size)
        run, nth = _each(count)
        place = (bound[owner] + first)[run] + nth
        out[place] = np.minimum(out[place], low[start[number[run]] + nth])
    return out, bound


def _batches(keys: np.ndarray, lens: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of the members of keys that have several, whole keys together, by about ``BATCH`` bytes."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    cut = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    width = np.diff(np.append(cut, len(keys)))
    order = order[np.repeat(width > 1, width)]
    width = width[width > 1]
    sums = np.cumsum(lens[order])[np.cumsum(width) - 1] if len(width) else width
    step = np.flatnonzero(np.append(np.diff(sums // BATCH) > 0, True)) if len(width) else width
    yield from np.split(order, np.cumsum(width)[step][:-1]) if len(width) else ()


def _ordered(keys: np.ndarray, contents: list[bytes], least: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The same, by the order of all suffixes of the contents of each key."""
    lens = np.fromiter(map(len, contents), np.int64, len(contents))
    bound = np.append(0, np.cumsum(lens - size + 1))
    out = np.repeat(least, lens - size + 1)
    for at in _batches(keys, lens):
        text, length, lcp = C.suffix_order(np.frombuffer(b"".join([contents[i] for i in at.tolist()]), np.uint8), lens[at], size)
        long = np.flatnonzero(length >= size)
        # a suffix too short to hold a string ends any run of equal strings, as its neighbours share less
        group = np.cumsum(lcp < size)[long]
        heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        owner = at[text[long]]
        value = np.repeat(np.minimum.reduceat(least[owner], heads), np.diff(np.append(heads, len(long))))
        out[bound[owner] + lens[owner] - length[long]] = value
    return out, bound


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, as_text: bool = False) -> DataFrame:
    """One row for each row of ``docs``: _f, _r (the row's place), the id, ``n_bytes``, ``n_removed``, ``n_spans``
    (maximal removed runs) and ``kept``, the remaining bytes, or with ``as_text`` the text of them, without code points
    that lost some of their bytes. The id is an integer."""
    if not 2 <= size < 200:
        raise ValueError("size is 2 to 199")
    n = S.shards(docs.sparkSession)
    rows = S.row_keyed(docs, R.BLOCK_ROWS, id=F.col(id_col).cast("long"), text=F.col(text_col))

    def send_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, b, part in R.runs(batch):
                ids = part.column("id").fill_null(_LAST).to_numpy()
                base = int(ids.min())
                keys, prints, least, several = _prints(*B.buffer(part.column("text")), ids, size)
                if len(keys):
                    least = least.astype(np.uint64) - np.uint64(base & (2**64 - 1))
                    narrow = np.uint32 if int(least.max()) < 2**32 else np.uint64
                    out = R.pack_by_shard(n, f, b, keys, prints, least.astype(narrow), several)
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array([base] * out.num_rows, pa.int64())], names=_names(_PRINTS))
                B.release()

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for x in (x for batch in batches for x in batch.to_pylist()):
            keys, prints = np.frombuffer(x["keys"], np.uint64), np.frombuffer(x["prints"], np.uint64)
            least = np.frombuffer(x["least"], np.uint32 if len(x["least"]) < len(x["keys"]) else np.uint64)
            held.append((x["_f"], x["_b"], keys, prints, (least + np.uint64(x["base"] & (2**64 - 1))).astype(np.int64), np.frombuffer(x["several"], bool)))
        for x in _tell(held) if held else ():
            yield pa.RecordBatch.from_arrays([pa.array([x[0]], pa.int64()), pa.array([x[1]], pa.int64()), *(pa.array([v], pa.binary()) for v in x[2:])], names=_names(_TOLD))

    def send_bytes(key: tuple, left: pa.Table, replies: pa.Table) -> pa.Table:
        got = _Block(left, replies, size)
        if not got.contents:
            return pa.table({c: pa.array([], t) for c, t in zip(_names(_BYTES), [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5], strict=True)})
        order = np.argsort(got.key, kind="stable")
        lens = np.fromiter(map(len, got.contents), np.uint16, len(got.contents))
        batch = R.pack_by_shard(n, key[0].as_py(), key[1].as_py(), got.key[order], order.astype(np.uint32), lens[order], got.least[order])
        bounds = np.append(0, np.cumsum([len(x) // 8 for x in batch.column("keys").to_pylist()])).tolist()
        ordered = order.tolist()
        data = [b"".join([got.contents[i] for i in ordered[a:z]]) for a, z in zip(bounds, bounds[1:], strict=False)]
        return pa.Table.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=_names(_BYTES))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        keys, sent = [], []
        for x in (x for batch in batches for x in batch.to_pylist()):
            cut = np.append(0, np.cumsum(np.frombuffer(x["lens"], np.uint16), dtype=np.int64)).tolist()
            at = np.fromiter((known.setdefault(x["data"][a:z], len(known)) for a, z in zip(cut, cut[1:], strict=False)), np.int64, len(cut) - 1)
            sent.append((x["_f"], x["_b"], np.frombuffer(x["number"], np.uint32), at, np.frombuffer(x["least"], np.int64)))
            keys.append(np.frombuffer(x["keys"], np.uint64))
        if not sent:
            return
        every = np.concatenate([x[3] for x in sent])
        least = np.full(len(known), _LAST)
        np.minimum.at(least, every, np.concatenate([x[4] for x in sent]))
        key = np.empty(len(known), np.uint64)
        key[every] = np.concatenate(keys)
        contents = list(known)
        del known, keys, every
        low, bound = _least_ids(key, contents, least, size)
        lowest = np.minimum.reduceat(low, bound[:-1])
        for f, b, num, at, own in sent:
            # only segments that know less than the shard are told
            tell = np.flatnonzero(lowest[at] < own)
            if not len(tell):
                continue
            owner, nth = _each((bound[at + 1] - bound[at])[tell])
            value = low[bound[at[tell]][owner] + nth]
            head = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])))
            runs = np.bincount(owner[head], minlength=len(tell)).astype(np.uint16)
            length = np.diff(np.append(head, len(value))).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int64()), pa.array([b], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (num[tell], runs, length, value[head]))], names=_names(_REPLY))

    told = S.written(S.by_shard(rows.select("_f", "_b", "id", "text").mapInArrow(send_prints, _PRINTS), n, tell, _TOLD), "anchors")
    low = S.written(S.by_shard(S.with_replies(rows, told, send_bytes, _BYTES), n, answer, _REPLY), "least")
    replies = told.unionByName(low, allowMissingColumns=True)

    def finish(key: tuple, left: pa.Table, replies: pa.Table) -> pa.Table:
        got = _Block(left, replies, size)
        bound = np.append(0, np.cumsum(got.strings))
        low = np.repeat(got.least, got.strings)
        for x in replies.to_pylist():
            if x["number"] is not None:
                num = np.frombuffer(x["number"], np.uint32).astype(np.int64)
                owner, nth = _each(got.strings[num])
                low[bound[num][owner] + nth] = np.repeat(np.frombuffer(x["lowest"], np.int64), np.frombuffer(x["lens"], np.uint16))
        owner, nth = _each(got.counts)
        hit = (got.starts[owner] + nth)[low[bound[got.number[owner]] + nth] < got.ids[got.text[owner]]]
        gone = B.covered(np.append(hit, got.gone[0]), np.append(np.full(len(hit), size), got.gone[1]), len(got.buf))
        offs = got.offs
        first = np.zeros(len(gone) + 1, bool)
        first[offs] = True
        begins = gone & (first[:-1] | ~np.append(False, gone)[:-1])
        sums, spans = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(begins))
        keep = got.buf[~gone].tobytes()
        cut = (offs - sums[offs]).tolist()
        rest = [keep[a:z] for a, z in zip(cut, cut[1:], strict=False)]
        return pa.table({
            "_f": got.rows.column("_f"), "_r": got.rows.column("_r"), "id": got.rows.column("id"), "n_bytes": np.diff(offs), "n_removed": np.diff(sums[offs]), "n_spans": np.diff(spans[offs]),
            "kept": pa.array([x.decode("utf-8", "ignore") for x in rest], pa.string()) if as_text else pa.array(rest, pa.binary()),
        })

    made = S.with_replies(rows, replies, finish, f"_f long, _r long, id long, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")
    return made.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def _decoded(kept: pd.Series) -> pd.Series:
    return kept.map(lambda b: b.decode("utf-8", "ignore"))


def kept_text(kept: Column | str) -> Column:
    """Kept bytes as text, without code points that lost some of their bytes."""
    return F.pandas_udf(_decoded, "string")(kept)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of ``suffix_dedup`` over all documents, by strings of 50 bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
