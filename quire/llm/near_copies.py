"""Components of near copies by the true similarity of their sets of word shingles.

Two texts are linked if the Jaccard similarity of their sets of shingles is four fifths or more; a text of
fewer words than a shingle is one shingle. Texts of one set are one member.

Candidates come from SimHash, by the SimHash operator's index. Two sets at 0.8 differ in 15 % of the bits of their
fingerprints, so 64 bits, and few differing ones, would miss most; a fingerprint here has ``BYTES`` positional bytes.
A member is in a list for each of them, and those of a list that have a second byte in common meet: any two
members that share two of the 64 bytes. At 0.8 they share 17 on average, and fewer than two with a chance of about 4e-8
(2e-5 for sets of four and five, where ties matter). Those that meet are verified over all the bits that
travel with the list, and those that are near make up candidate components. These are taken apart again by comparing the
sets themselves, so a link is never a guess. The lists of a few bytes meet first; in the other lists members go by the
component that they have by then, so that a link that is known isn't found again in each list.

Candidate components of up to ``MEMBERS`` members are compared in one place. In a larger one all members are compared
with one of them, spread over tasks; those that aren't linked to it, mostly few, are compared with all members by
tiles, each pair of tiles by itself.

Defined results: texts without words have one (empty) set; ids may be null or repeated; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quire.llm import _bytes as B
from quire.llm import _components as C
from quire.llm import _lists as X
from quire.llm import _spark as S
from quire.llm import simhash as H

WORDS = 5
#: Linked texts share at least this part of their shingles.
LEAST = (4, 5)
#: Positional bytes of a fingerprint, and how many of them, those after a list's own, travel with the list.
BYTES, CARRIED = 64, 32
#: The lists of so many bytes meet first; those of a component that they make needn't be joined again in the others.
FIRST = 8
#: Most differing bits in 64 of the fingerprints of candidates: a pair at 0.8 has 9.7 on average.
APART = 19
#: A list is split where it has more members than so many times those that are compared pair by pair. A sub-list of over
#: ``FEW`` members that are mostly near, or of over ``MOST``, is grown from its members.
LISTS, FEW, MOST = 16, 32, 1024
#: Members, and shingles, of a candidate component that is compared in one place; members of a tile of a larger one.
MEMBERS, SHINGLES, TILE = 1 << 14, 1 << 22, 256
#: Shingles whose texts' fingerprints are made at once, about.
STEP = 1 << 17
_SALTS = np.random.default_rng(0).integers(0, 1 << 63, BYTES // 8, np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Ascending distinct hashes of the shingles of a text."""
    return sets_of(pa.array([text], pa.string()), words)[0]


def sets_of(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Ascending distinct hashes of the shingles of each text."""
    whole, bounds = B.buffer(texts)
    out = []
    for i, j in B.pieces(bounds):
        hashes, text = B.shingles(whole[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], words, H.SEED)
        out += [B.distinct(x) for x in np.split(hashes, np.searchsorted(text, np.arange(1, j - i)))]
    return out


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """The SimHash fingerprints of sets of shingles (none is empty), a row of 64-bit numbers each."""
    hashes, size = np.concatenate(sets), np.array([len(x) for x in sets])
    head = np.cumsum(size) - size
    return np.stack([H.majority(B.mix(hashes ^ salt), head) for salt in _SALTS], axis=1)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64) <= APART * a.shape[-1]


def _grown(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """The first member of the component of each of n; ``near(q, rest)`` tells which of ``rest`` are linked to q."""
    label, rest = np.arange(n), np.arange(n)
    while len(rest):
        head, rest = int(rest[0]), rest[1:]
        todo = [head]
        while todo and len(rest):
            on = near(todo.pop(), rest)
            label[rest[on]] = head
            todo += rest[on].tolist()
            rest = rest[~on]
    return label


def links(keys: np.ndarray, members: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join those of each list (``keys`` ascend) that share a byte of their sketches (rows of 64-bit numbers)
    and are near: member and its component's first. Rows of one member are joined already."""
    n = len(keys)
    group = np.cumsum(np.append(False, keys[1:] != keys[:-1])) << 8
    half = np.ascontiguousarray(sketch[:, : sketch.shape[1] // 2])
    _, first, same = np.unique(members, return_index=True, return_inverse=True)
    root = first[same]

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        # those that are joined already needn't be found again; few get past the first half, where chance weighs more
        out = root[a] != root[b]
        out[out] = np.bitwise_count(half[a[out]] ^ half[b[out]]).sum(axis=-1, dtype=np.int64) <= (APART + 5) * half.shape[1]
        out[out] = _near(sketch[a[out]], sketch[b[out]])
        return out

    def joined(found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        on = np.flatnonzero(root != np.arange(n))
        return C.roots(n, *map(np.concatenate, zip((on, root[on]), *found, strict=True)))

    for byte in sketch.view(np.uint8).T:
        second = group | byte
        order = np.argsort(second)
        second = second[order]
        head = np.flatnonzero(np.append(True, second[1:] != second[:-1])[:n])
        size = np.diff(np.append(head, n))
        apart, found = np.ones(n, bool), []
        for k in np.flatnonzero(size > FEW).tolist():
            at = order[head[k] : head[k] + size[k]]
            if (root[at] == root[at[0]]).all():
                apart[head[k] : head[k] + size[k]] = False
                continue
            # a group of copies is grown from its members; others are compared pair by pair
            if size[k] > MOST or 4 * np.count_nonzero(_near(sketch[at[0]], sketch[at])) > size[k]:
                apart[head[k] : head[k] + size[k]] = False
                label = _grown(len(at), lambda q, rest, at=at: _near(sketch[at[q]], sketch[at[rest]]))
                found.append((at, at[label]))
        at, second = order[apart], second[apart]
        a, d = np.arange(len(at)), 0
        while len(a):
            d += 1
            a = a[a + d < len(at)]
            a = a[second[a] == second[a + d]]
            on = a[near(at[a], at[a + d])]
            found.append((at[on], at[on + d]))
            if sum(len(x) for x, _ in found) > n:
                root, found = joined(found), []
        root = joined(found)
    on = np.flatnonzero(root != np.arange(n))
    return X.few(members, on, root[on])


class _Sets:
    """Sets of shingles with their fingerprints."""

    def __init__(self, sets: list[np.ndarray], sketch: np.ndarray):
        self.size = np.array([len(x) for x in sets])
        self.start = np.cumsum(self.size) - self.size
        every, self.place = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark, self.sketch = np.zeros(len(every), bool), sketch

    def near(self, q: int, rest: np.ndarray) -> np.ndarray:
        """Which of ``rest`` have a similarity of ``LEAST`` to q."""
        part, whole = LEAST
        size, start = self.size, self.start
        out = (part * size[rest] <= whole * size[q]) & (part * size[q] <= whole * size[rest])
        out[out] = _near(self.sketch[q], self.sketch[rest[out]])
        some = rest[out]
        if len(some):
            own = self.place[start[q] : start[q] + size[q]]
            self.mark[own] = True
            n = size[some]
            heads = np.cumsum(n) - n
            shared = np.add.reduceat(self.mark[self.place[np.repeat(start[some] - heads, n) + np.arange(n.sum())]], heads, dtype=np.int64)
            self.mark[own] = False
            out[out] = whole * shared >= part * (n + size[q] - shared)
        return out


def verified(sets: list[np.ndarray], sketch: np.ndarray) -> np.ndarray:
    """The first member of the component of each set (none is empty), by comparing the sets."""
    return _grown(len(sets), _Sets(sets, sketch).near)


def crossed(sets: list[np.ndarray], sketch: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a set among the ``first`` ones and a later one that are linked."""
    held, later = _Sets(sets, sketch), np.arange(first, len(sets))
    found = [later[held.near(q, later)] for q in range(first)]
    return np.repeat(np.arange(first), [len(x) for x in found]), np.concatenate([later[:0], *found])


def _prints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """_f, _r, id, key (of the set of shingles), n (their number) and sketch (its fingerprint; null for the empty set), as a
    written table."""
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = sets_of(batch.column("text"), words)
            key = np.array([xxh64_intdigest(x.tobytes()) for x in sets], np.uint64)
            size = np.array([len(x) for x in sets], np.int64)
            sketch: list[bytes | None] = [None] * len(sets)
            some = np.flatnonzero(size)
            # some texts at a time, as a fingerprint takes several numbers a shingle
            for part in np.split(some, np.flatnonzero(np.diff(np.cumsum(size[some]) // STEP)) + 1) if len(some) else ():
                for k, x in zip(part.tolist(), fingerprints([sets[k] for k in part.tolist()]), strict=True):
                    sketch[k] = x.tobytes()
            own = [batch.column(c) for c in ("_f", "_r", "id")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(key.view(np.int64)), pa.array(size), pa.array(sketch, pa.binary())], names=["_f", "_r", "id", "key", "n", "sketch"])
            B.release()

    rows = S.row_keyed(docs, 1, id=F.col(id_col), text=F.col(text_col)).drop("_b")
    return S.written(rows.mapInArrow(each, f"_f long, _r long, id {kind}, key long, n long, sketch binary"), "prints")


def postings(classes: DataFrame, first: int = 0, end: int = BYTES) -> DataFrame:
    """list, member and sketch (the bytes after the list's own, around the end) of each positional byte, from ``first`` to
    before ``end``, of each of ``classes`` (key, sketch)."""
    each = classes.select("key", "sketch", F.explode(F.sequence(F.lit(first), F.lit(end - 1))).alias("at"))
    own, more = F.expr("substring(sketch, at + 1, 1)"), F.expr(f"substring(concat(sketch, sketch), at + 2, {CARRIED})")
    return each.select(F.xxhash64("at", own).alias("list"), F.col("key").alias("member"), more.alias("sketch"))


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Rows of each value of a column by which the batches are in order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        value = batch.column(column).to_numpy()
        cut = [*(np.flatnonzero(value[1:] != value[:-1]) + 1).tolist(), len(value)]
        a = 0
        for z in cut if len(value) else ():
            if held and held[0].column(column)[0].as_py() != value[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, z - a))
            a = z
    if held:
        yield pa.Table.from_batches(held)


def _linked(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """Sets and sketches of some rows."""
    held = rows.column("set").combine_chunks()
    sets = [x for x in np.split(held.flatten().to_numpy().view(np.uint64), np.cumsum(held.value_lengths().to_numpy())[:-1])]
    return sets, np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(-1, BYTES // 8)


def _roots_of_small(sets: DataFrame, n: int) -> DataFrame:
    """key, root: components of the members of each candidate component, all of them in one place."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "candidate"):
            key = rows.column("key").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(key[verified(*_linked(rows))])], names=["key", "root"])
        B.release()

    return sets.repartition(n, "candidate").sortWithinPartitions("candidate").mapInArrow(compare, "key long, root long")


def _roots_of_large(sets: DataFrame, large: DataFrame, n: int) -> DataFrame:
    """The same, spread over tasks; ``large`` has candidate and members."""
    one = sets.groupBy("candidate").agg(F.min_by(F.struct("key", "set"), "key").alias("hub"))
    both = sets.join(one, "candidate")
    shared = F.size(F.array_intersect("set", "hub.set"))
    part, whole = LEAST
    seen = S.written(both.select("candidate", "key", F.col("hub.key").alias("hub"), (whole * shared >= part * (F.size("set") + F.size("hub.set") - shared)).alias("on")), "hubs")
    rest = seen.filter(~F.col("on")).select("candidate", "key")
    tiles = large.join(rest.groupBy("candidate").agg(F.count("*").alias("rest")), "candidate").select("candidate", F.ceil(F.col("members") / TILE).alias("of"), F.ceil(F.col("rest") / TILE).alias("by"))
    tile = lambda c: F.pmod(F.xxhash64("key"), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = sets.join(rest, ["candidate", "key"]).join(tiles, "candidate").select("candidate", "key", "set", "sketch", F.lit(0).alias("side"), tile("by").alias("i"), every("of").alias("j"))
    right = sets.join(tiles, "candidate").select("candidate", "key", "set", "sketch", F.lit(1).alias("side"), every("by").alias("i"), tile("of").alias("j"))
    met = left.unionByName(right).select(F.xxhash64("candidate", "i", "j").alias("pair"), "side", "key", "set", "sketch")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "pair"):
            key, first = rows.column("key").to_numpy(), int((rows.column("side").to_numpy() == 0).sum())
            if first and first < len(key):
                u, v = X.few(key, *crossed(*_linked(rows), first))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
        B.release()

    found = met.repartition(n, "pair").sortWithinPartitions("pair", "side").mapInArrow(compare, "u long, v long")
    edges = seen.filter("on").select(F.col("key").alias("u"), F.col("hub").alias("v")).unionByName(found)
    return C.components(edges).select(F.col("node").alias("key"), "root")


def candidates(classes: DataFrame) -> DataFrame:
    """Components (node, root) of the members of ``classes`` (key, sketch) that are near. Long lists among the first are
    split at first, so that each member makes at most one link a list, and are compared as a whole with the others."""
    compare = lambda keys, members, data: links(keys, members, np.frombuffer(data, np.uint64).reshape(-1, CARRIED // 8))
    most, first = LISTS * X.LONG, postings(classes, 0, FIRST)
    long = X.long_lists(first, most)
    early = C.components(X.met(first, compare, "sketch", apart=long))
    joined = classes.join(early, F.col("key") == F.col("node"), "left").select(F.coalesce("root", "key").alias("key"), "sketch")
    rest = postings(joined, FIRST, BYTES)
    if long.limit(1).count():
        rest = rest.unionByName(postings(joined, 0, FIRST).join(F.broadcast(long.select("list")), "list", "left_semi"))
    return C.components(early.toDF("u", "v").unionByName(X.met(rest, compare, "sketch", most, repeats=True)))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """_f, _r (the row's place), id and root (the key of the component) of every row."""
    docs = S.stable(docs)
    prints = _prints(docs, id_col, text_col, words)
    n = S.shards(docs.sparkSession)
    first = prints.filter("sketch IS NOT NULL").groupBy("key").agg(F.min(F.struct("_f", "_r")).alias("at")).select("key", "at._f", "at._r")
    classes = S.written(prints.drop("id").join(first, ["key", "_f", "_r"]), "classes")
    found = S.written(candidates(classes), "candidates")
    known = found.unionByName(found.select(F.col("root").alias("node"), "root")).distinct().withColumnsRenamed({"node": "key", "root": "candidate"})
    known = S.written(classes.select("_f", "_r", "key", "n", "sketch").join(known, "key"), "known")
    texts = S.row_keyed(docs, 1, text=F.col(text_col)).drop("_b")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = sets_of(batch.column("text"), words)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("candidate", "key", "sketch")), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], names=["candidate", "key", "sketch", "set"])
            B.release()

    sizes = S.written(known.groupBy("candidate").agg(F.count("*").alias("members"), F.sum("n").alias("shingles")), "sizes")
    is_large = (F.col("members") > MEMBERS) | (F.col("shingles") > SHINGLES)
    close = known.select("_f", "_r", "candidate", "key", "sketch").join(texts, ["_f", "_r"])
    sets = close.join(sizes.filter(~is_large).select("candidate"), "candidate").mapInArrow(each, "candidate long, key long, sketch binary, set array<long>")
    roots = S.written(_roots_of_small(sets, n), "roots")
    large = sizes.filter(is_large).select("candidate", "members")
    if large.limit(1).count():
        sets = S.written(close.join(large.select("candidate"), "candidate").mapInArrow(each, "candidate long, key long, sketch binary, set array<long>"), "sets")
        roots = S.written(roots.unionByName(_roots_of_large(sets, large, n)), "roots")
    return prints.select("_f", "_r", "id", "key").join(roots, "key", "left").select("_f", "_r", "id", F.coalesce("root", "key").alias("root"))
