"""Lists of members that share a key: the links inside them, however long a list is.

Members of a list of at most ``LONG`` meet in one task. A longer list is dealt to tiles by the members' hashes, and
each pair of its tiles makes a list of its own, in which the members of both meet. So no task gathers a list that
grows with the table. Lists come in order of their keys and are worked on a part at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import _bytes as B
from quire.llm import _components as C
from quire.llm import _spark as S

#: Members of a list that are compared with each other in one place, about.
LONG = 4096
#: Members that are worked on at once.
PART = 1 << 17
#: Most keys of long lists that are broadcast.
SMALL = 1_000_000


def pairs(keys: np.ndarray, linked: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the linked pairs within lists; ``keys`` ascend, and ``linked`` tells of pairs of places."""
    group = np.cumsum(np.append(False, keys[1:] != keys[:-1]))
    found = [(np.empty(0, np.int64),) * 2]
    a, d = np.arange(len(keys)), 0
    while len(a):
        d += 1
        a = a[a + d < len(group)]
        a = a[group[a] == group[a + d]]
        on = a[linked(a, a + d)]
        found.append((on, on + d))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def few(members: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (places in ``members``) as few: each member that has a component, and the first of it."""
    every, place = np.unique(members, return_inverse=True)
    root = C.roots(len(every), place[a], place[b])
    on = np.flatnonzero(root != np.arange(len(every)))
    return every[on], every[root[on]]


def long_lists(postings: DataFrame, most: int | None = None) -> DataFrame:
    """list and tiles of the lists of over ``most`` rows, as a written table."""
    most = most or LONG
    sizes = postings.groupBy("list").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    return S.written(sizes.select("list", F.ceil(2 * F.col("n") / most).cast("int").alias("tiles")), "long")


def tiled(postings: DataFrame, long: DataFrame) -> DataFrame:
    """``postings`` with each of its ``long_lists`` split into as many lists as it has tiles, whose members don't meet those
    of others; two members that one such list parts may share a tile of another."""
    if not long.limit(1).count():
        return postings
    more = [c for c in postings.columns if c != "list"]
    own = F.pmod(F.xxhash64("list", "member"), F.col("tiles"))
    return postings.join(F.broadcast(long), "list", "left").select(F.when(F.col("tiles").isNull(), F.col("list")).otherwise(F.xxhash64("list", own)).alias("list"), *more)


def dealt(postings: DataFrame, most: int | None = None, repeats: bool = False) -> DataFrame:
    """``postings`` (list, member, more) with long lists, of over ``most`` members, split: as many lists as a long one
    has pairs of tiles. With ``repeats`` a list may have rows of one member: those that are equal go, others are spread."""
    long = long_lists(postings, most)
    n = long.count()
    if not n:
        return postings
    if n <= SMALL:
        long = F.broadcast(long)
    more = [c for c in postings.columns if c != "list"]
    own = postings.join(long, "list")
    own = (own.distinct() if repeats else own).withColumn("own", F.pmod(F.xxhash64(*more if repeats else ["member"]), F.col("tiles")).cast("int"))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    split = each.select(F.xxhash64("list", F.least("own", "other"), F.greatest("own", "other")).alias("list"), *more)
    return postings.join(long, "list", "left_anti").select("list", *more).unionByName(split)


def met(postings: DataFrame, compare: Callable, data: str | None = None, most: int | None = None, repeats: bool = False, apart: DataFrame | None = None) -> DataFrame:
    """Links (u, v), as few as join the components of each list. ``postings`` has list and member (long) and maybe
    ``data``, a binary column of one width; ``compare(keys, members, data)`` gives the links of some whole lists.
    Lists of over ``most`` members, else ``LONG``, are split; ``repeats`` is as in ``dealt``. With ``apart``, their
    ``long_lists`` (few), tiles of a long list don't meet each other."""
    n = S.shards(postings.sparkSession)

    def part(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        keys, members = (rows.column(c).to_numpy() for c in ("list", "member"))
        u, v = compare(keys, members.view(np.uint64), b"".join(rows.column(data).to_pylist()) if data else b"")
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column("list").to_numpy()
            last = int(np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)]).max(initial=0))
            # rows before the batch's last list end theirs
            held.append(batch.slice(0, last))
            if last and sum(x.num_rows for x in held) >= PART:
                yield part(held)
                held = []
            held.append(batch.slice(last))
        if held:
            yield part(held)
        B.release()

    lists = dealt(postings, most, repeats) if apart is None else tiled(postings, apart)
    return lists.repartition(n, "list").sortWithinPartitions("list").mapInArrow(meet, "u long, v long")
