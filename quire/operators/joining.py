"""Clusters that are each other's nearest by mean distance, joined as far as short lists of near clusters tell.

The driver has the vectors and, for each cluster, a list of near clusters with lower bounds of the mean distance, and how far
the list reaches: no other cluster is nearer. The mean distance of a joined cluster is the weighted mean of its parts', so lists
go on through joints as bounds; what comes first in a list is measured in doubles. Lists that don't tell any more are made anew by
tasks, from products in 32 bits less their error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from quire.operators import tiles as T

#: What rounding to nine digits can do to a comparison.
EDGE = 2e-9
#: Vectors of the clusters that are searched for together, and of those that they are searched among at a time.
ROWS, COLS = 128, 2048
#: Vectors whose lists the driver makes itself.
FEW = 192
#: Pairs of vectors of two clusters from which on these are multiplied as matrices.
LARGE = 256


class Held:
    """Vectors in the order of their clusters: cluster c (of ``names``) has those from start[c] to start[c + 1]."""

    def __init__(self, vecs: np.ndarray, small: np.ndarray, own: np.ndarray):
        self.order = np.argsort(own, kind="stable")
        self.names, start = np.unique(own[self.order], return_index=True)
        self.start, self.vecs, self.small = np.r_[start, len(own)], vecs, small
        self.size = np.diff(self.start)

    def know_middles(self) -> None:
        """The mean of each cluster's vectors, and of their squares."""
        ordered = self.small[self.order]
        self.middle = np.add.reduceat(ordered, self.start[:-1], axis=0) / self.size[:, None].astype(np.float32)
        self.square = np.add.reduceat(np.einsum("ij,ij->i", ordered, ordered), self.start[:-1]) / self.size

    def rows(self, c: np.ndarray) -> np.ndarray:
        """The vectors of some clusters, one cluster after the other."""
        n = self.size[c]
        return self.order[np.repeat(self.start[c] - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def block(self, c: np.ndarray) -> T.Block:
        rows = self.rows(c)
        return T.Block.of(rows, np.repeat(c, self.size[c]), self.vecs[rows].astype(float))

    def parts(self, c: np.ndarray, most: int) -> list[np.ndarray]:
        """Clusters in lots of about ``most`` vectors."""
        lot = (np.cumsum(self.size[c]) - 1) // most
        return np.split(c, np.flatnonzero(np.diff(lot)) + 1) if len(c) else []


def _starts(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


def _by_size(size: np.ndarray, c: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Lots of clusters of one size, of about ``most`` vectors."""
    c = c[np.argsort(size[c], kind="stable")]
    for same in np.split(c, np.flatnonzero(np.diff(size[c])) + 1) if len(c) else []:
        yield from np.array_split(same, -(-len(same) // max(1, most // size[same[0]])))


def near(held: Held, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each cluster asked for the k others with the least bounds (-1 where there are fewer), the bounds, and the least bound of the rest."""
    width, norms = held.small.shape[1], np.einsum("ij,ij->i", held.small, held.small, dtype=float)
    most = norms.max()
    # rows of a lot: the first vectors of its clusters, then the second ones and so on, so that sums are those of whole rows
    rows_of = lambda lot: held.order[(held.start[lot] + np.arange(held.size[lot[0]])[:, None]).ravel()]
    lots = list(_by_size(held.size, np.arange(len(held.names)), COLS))
    places = np.concatenate(lots)
    at = np.empty(len(places), int)
    at[places] = np.arange(len(places))
    every = np.concatenate([rows_of(x) for x in lots])
    right = np.ascontiguousarray(np.column_stack([held.small[every], np.ones(len(every), np.float32), norms[every].astype(np.float32)]).T)
    groups = -(-len(places) // 64)
    space = np.empty((ROWS, groups * 64), np.float32)
    to, low, reach = np.full((len(asked), k), -1, np.int32), np.full((len(asked), k), np.inf), np.full(len(asked), np.inf)
    index = np.empty(len(held.names), int)
    index[asked] = np.arange(len(asked))
    for part in _by_size(held.size, asked, ROWS):
        rows, own = rows_of(part), held.size[part[0]]
        wrong = 2e-7 * (width + 5) * (norms[rows] + most)
        left = np.column_stack([-2 * held.small[rows], norms[rows] - wrong, np.ones(len(rows))]).astype(np.float32)
        s, done, col = space[: len(part)], 0, 0
        s[:, len(places) :] = np.inf
        for lot in lots:
            size, total = held.size[lot[0]], 0
            step = max(1, T.CELLS // len(rows) // len(lot))  # members at a time
            for m in range(0, size, step):
                n = min(step, size - m)
                d = left @ right[:, col : col + n * len(lot)]
                d = np.sqrt(np.maximum(d, 0, out=d), out=d)
                d = d.reshape(own, len(part), -1).sum(0) if own > 1 else d
                total = total + (d.reshape(len(part), n, -1).sum(1) if n > 1 else d)
                col += n * len(lot)
            np.multiply(total, np.float32(1 / (size * own)), out=s[:, done : done + len(lot)])
            done += len(lot)
        s[np.arange(len(part)), at[part]] = np.inf
        tall = s.reshape(len(part), 64, groups)
        least = tall.min(1) if groups > 2 * k else s
        top = np.partition(least, k, axis=1)[:, k] if least.shape[1] > k else np.full(len(part), np.inf, np.float32)
        loose = 1.2e-7 * (held.size.max() + own + 4)  # sums in 32 bits, added one after the other
        for r in range(len(part)):
            if least is not s:
                some = np.flatnonzero(least[r] <= top[r])
                i, j = np.nonzero(tall[r][:, some] <= top[r])
                hit = i * groups + some[j]
            else:
                hit = np.flatnonzero(s[r] <= top[r])
            v = s[r, hit].astype(float)
            hit, v = places[hit[np.isfinite(v)]], v[np.isfinite(v)]
            v *= 1 - 1.2e-7 * (held.size[hit] + own + 4)
            first = np.argsort(v, kind="stable")
            n, x = min(k, len(hit)), index[part[r]]
            to[x, :n], low[x, :n] = hit[first[:n]], v[first[:n]]
            reach[x] = min(float(top[r]) * (1 - loose), v[first[n]] if len(hit) > n else np.inf)
    return to, low, reach


def nearest(held: Held, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each cluster asked for the first of those with the least mean distance, and that distance, in doubles."""
    to, best = np.full(len(asked), -1), np.full(len(asked), np.inf)
    for right in (held.block(p) for p in held.parts(np.arange(len(held.names)), COLS)):
        done = 0
        for part in held.parts(asked, ROWS):
            rows, cols, sums = T._sums(held.block(part), right)
            mean = sums / (held.size[rows][:, None] * held.size[cols][None, :])
            mean[rows[:, None] == cols[None, :]] = np.inf
            at = T.rounded(mean, 9).argmin(1)
            d = mean[np.arange(len(rows)), at]
            here = slice(done, done + len(part))
            less = T.rounded(d, 9) < T.rounded(best[here], 9)
            to[here], best[here] = np.where(less, cols[at], to[here]), np.where(less, d, best[here])
            done += len(part)
    return to, best


def sums(held: Held, asked: np.ndarray) -> np.ndarray:
    """Sums of distances from some clusters in a row to the first of them and all that follow, in doubles."""
    out = np.zeros((len(asked), len(held.names) - asked[0]))
    for right in held.parts(np.arange(asked[0], len(held.names)), COLS):
        block, done = held.block(right), 0
        for part in held.parts(asked, ROWS):
            out[done : done + len(part), right[0] - asked[0] : right[-1] + 1 - asked[0]] = T._sums(held.block(part), block)[2]
            done += len(part)
    return out


class Joining:
    """The clusters, by their first vectors, and their lists (targets, bounds, whether a bound is the distance itself, reach)."""

    def __init__(self, spark: SparkSession, vecs: np.ndarray, own: np.ndarray, listed: int):
        self.spark, self.vecs, self.own, self.listed = spark, vecs, own, listed
        middle = vecs.astype(float) - vecs.mean(0, dtype=float)
        self.scale = float(np.sqrt((middle**2).sum(1).max())) or 1.0
        self.small = (middle / self.scale).astype(np.float32)
        n = len(own)
        self.sent = spark.sparkContext.broadcast((vecs, self.small))
        self.size, self.held = np.bincount(own, minlength=n), Held(vecs, self.small, own)
        self.k, self.slot = self.width(), np.searchsorted(self.held.names, np.arange(n))
        lists = (len(self.held.names), self.k)
        self.to, self.low, self.exact = np.full(lists, -1, np.int32), np.full(lists, np.inf), np.zeros(lists, bool)
        self.reach, self.first, self.changed = np.full(n, -np.inf), np.full(n, -1), self.held.names

    def width(self) -> int:
        return int(max(16, min(256, self.listed // max(1, np.count_nonzero(self.size)))))

    def measure(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Mean distances of pairs of clusters."""
        held, out = self.held, np.zeros(len(a))
        p, q = np.searchsorted(held.names, a), np.searchsorted(held.names, b)
        n = held.size[p] * held.size[q]
        for i in np.flatnonzero(n > LARGE):
            x, y = (self.vecs[held.order[held.start[c] : held.start[c + 1]]].astype(float) for c in (p[i], q[i]))
            norms, others = (x * x).sum(1), (y * y).sum(1)
            most = norms.max() + others.max()
            for part in T._chunks(len(x), len(y)):
                d2 = norms[part, None] + others - 2 * (x[part] @ y.T)
                if d2.min() < 1e-6 * most:
                    r, c = np.nonzero(d2 < 1e-6 * most)
                    d2[r, c] = T.exact(x[part][r], y[c])
                out[i] += np.sqrt(d2, out=d2).sum()
        some = np.flatnonzero(n <= LARGE)
        for lot in np.split(some, np.flatnonzero(np.diff((np.cumsum(n[some]) - 1) >> 14)) + 1) if len(some) else []:
            each = np.repeat(np.arange(len(lot)), n[lot])
            within = np.arange(len(each)) - np.repeat(_starts(n[lot]), n[lot])
            i, j = np.divmod(within, held.size[q[lot]][each])
            left, right = held.order[held.start[p[lot]][each] + i], held.order[held.start[q[lot]][each] + j]
            d = self.vecs[left].astype(float) - self.vecs[right]
            out[lot] = np.add.reduceat(np.sqrt(np.einsum("ij,ij->i", d, d)), _starts(n[lot]))
        return out / n

    def settle(self) -> np.ndarray:
        """Looks up the first of each changed list; returns the clusters whose lists don't tell it.

        Of what may be first, the cluster with the least root of the mean square of distances is measured before the others, as
        it tells whether the list reaches far enough; then those whose bounds are less than that."""
        rows, self.changed = self.changed, np.zeros(0, int)
        if not hasattr(self.held, "middle"):
            self.held.know_middles()
        own, found = self.slot[rows], np.arange(len(rows))
        self.first[rows] = -1
        for turn in range(3):
            low, exact = self.low[own[found]], self.exact[own[found]]
            low = np.where(exact, T.rounded(np.where(exact, low, 0), 9), low - EDGE)
            within = low < self.reach[rows[found], None] - EDGE
            if not turn:
                i, j = np.nonzero(within & ~exact)
                guess = np.where(within, low, np.inf)
                guess[i, j] = self.spread(rows[found[i]], self.to[own[found[i]], j])
                at = guess.argmin(1)
                ask = np.zeros_like(exact)
                ask[np.arange(len(found)), at] = within[np.arange(len(found)), at] & ~exact[np.arange(len(found)), at]
            else:
                least = np.where(exact, low, np.inf).min(1)
                told = least < self.reach[rows[found]] - EDGE
                found, low, exact, least = found[told], low[told], exact[told], least[told]
                ask = (low <= least[:, None]) & ~exact
            i, j = np.nonzero(ask)
            if len(i):
                self.low[own[found[i]], j], self.exact[own[found[i]], j] = self.measure(rows[found[i]], self.to[own[found[i]], j]), True
        equal = exact & (low == least[:, None])
        self.first[rows[found]] = np.where(equal, self.to[own[found]], len(self.own)).min(1)
        return rows[self.first[rows] < 0]

    def spread(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Roots of the mean squares of distances of pairs of clusters, about."""
        held = self.held
        p, q = np.searchsorted(held.names, a), np.searchsorted(held.names, b)
        out = np.zeros(len(p))
        for k in range(0, len(p), 1 << 16):
            x, y = p[k : k + (1 << 16)], q[k : k + (1 << 16)]
            out[k : k + (1 << 16)] = held.square[x] + held.square[y] - 2 * np.einsum("ij,ij->i", held.middle[x], held.middle[y])
        return np.sqrt(np.maximum(out, 0)) * self.scale

    def search(self, names: np.ndarray, exact: bool) -> None:
        """New lists for some clusters; ``exact``: of the first alone, measured among all."""
        held, k = self.held, self.k
        asked = np.searchsorted(held.names, np.sort(names))
        look = nearest if exact else lambda held, asked: near(held, asked, k)
        for part, got in [(asked, look(held, asked))] if held.size[asked].sum() <= FEW else self.by_tasks(asked, look):
            rows, own = held.names[part], self.slot[held.names[part]]
            self.to[own], self.low[own], self.exact[own] = -1, np.inf, False
            if exact:
                self.to[own, 0], self.low[own, 0], self.exact[own, 0] = held.names[got[0]], got[1], True
                self.first[rows], self.reach[rows] = held.names[got[0]], got[1]
            else:
                self.to[own] = np.where(got[0] >= 0, held.names[got[0]], -1)
                # no distance is twice as far as this, and sums of it stay exact enough
                self.low[own], self.reach[rows] = got[1] * self.scale, np.minimum(got[2], 4) * self.scale
        if not exact:
            self.changed = names

    def by_tasks(self, asked: np.ndarray, look: Callable[[Held, np.ndarray], tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """What ``look`` finds for lots of the clusters, each lot in a task."""
        n = self.held.size[asked].sum()
        lots = self.held.parts(asked, max(1, -(-n // max(4 * T.BLOCKS, min(1024, n // 1024)))))
        sent, now = self.sent, self.spark.sparkContext.broadcast((self.own, lots))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, lots = now.value
            held = Held(*sent.value, own)
            for lot in (x for b in batches for x in b.column(0).to_pylist()):
                got = look(held, lots[lot])
                yield pa.RecordBatch.from_pylist([{"lot": lot, "got": [x.tobytes() for x in got], "kind": [x.dtype.str for x in got], "wide": [x.size // max(1, len(x)) if x.ndim > 1 else 0 for x in got]}])

        for r in self.spark.range(0, len(lots), 1, len(lots)).mapInArrow(run, "lot long, got array<binary>, kind array<string>, wide array<long>").collect():
            yield lots[r.lot], [np.frombuffer(x, t).reshape((-1, w) if w else -1) for x, t, w in zip(r.got, r.kind, r.wide, strict=True)]
        now.destroy()

    def sums(self) -> np.ndarray:
        """Sums of distances between all clusters."""
        m = np.zeros((len(self.held.names),) * 2)
        for part, (got,) in self.by_tasks(np.arange(len(m)), lambda held, asked: (sums(held, asked),)):
            a = part[0]
            m[part, a:], m[a:, part] = got, got.T
        return m

    def join(self, low: np.ndarray, high: np.ndarray) -> None:
        """Joins pairs of clusters and carries the lists on."""
        n = len(self.own)
        names = np.arange(n)
        names[high] = low
        alive = self.held.names
        moved = np.zeros(n + 1, bool)  # the last for places without a target
        moved[low] = moved[high] = True
        rows = alive[moved[alive] | moved[self.to[self.slot[alive]]].any(1)]
        own = self.slot[rows]
        size, was = self.size.copy(), self.size
        size[low] += size[high]
        size[high] = 0
        # what a row has of a new target, the rest of it being no nearer than the row reaches
        r, c = np.nonzero(self.to[own] >= 0)
        old, v, e = self.to[own[r], c].astype(int), self.low[own[r], c], self.exact[own[r], c]
        r, t, (w, s, sure) = _grouped(rows[r], names[old], n, was[old], was[old] * v, ~e)
        v = (s + (size[t] - w) * self.reach[r]) / size[t]
        e = (sure == 0) & (w == size[t])
        # what a new row has from its parts
        reach = np.zeros(n)
        np.add.at(reach, names[rows], was[rows] * self.reach[rows])
        g, t, (w, s, short, sure) = _grouped(names[r], t, n, was[r], was[r] * v, was[r] * self.reach[r], ~e)
        reach[alive] /= np.maximum(size[alive], 1)
        v = (s + reach[g] * size[g] - short) / size[g]
        e = (sure == 0) & (w == size[g])
        on = g != t
        g, t, v, e = g[on], t[on], v[on], e[on]
        order = np.lexsort((v, g))
        g, t, v, e = g[order], t[order], v[order], e[order]
        place = np.arange(len(g)) - np.searchsorted(g, g)
        new = np.unique(names[rows])
        self.reach[new] = reach[new]
        over = place >= self.k
        np.minimum.at(self.reach, g[over], v[over])
        g, t, v, e, place = (x[~over] for x in (g, t, v, e, place))
        self.to[own], self.low[own], self.exact[own] = -1, np.inf, False
        g = self.slot[g]
        self.to[g, place], self.low[g, place], self.exact[g, place] = t, v, e
        self.size, self.own = size, names[self.own]
        self.held = Held(self.vecs, self.small, self.own)
        # the others' first stays: joined clusters are no nearer to them than their parts were
        self.changed = np.unique(names[rows[moved[rows] | moved[self.first[rows]]]])
        if (k := self.width()) >= 1.5 * self.k:
            keep, more = self.slot[self.held.names], [(0, 0), (0, k - self.k)]
            self.to, self.low, self.exact = (np.pad(x[keep], more, constant_values=fill) for x, fill in ((self.to, -1), (self.low, np.inf), (self.exact, False)))
            self.k, self.slot[self.held.names] = k, np.arange(len(keep))


def _grouped(r: np.ndarray, t: np.ndarray, n: int, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sums of columns over equal r and t."""
    key = r * n + t
    order = np.argsort(key, kind="stable")
    key = key[order]
    if not len(key):
        return key, key, [np.zeros(0) for _ in columns]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[at] // n, key[at] % n, [np.add.reduceat(x[order].astype(float), at) for x in columns]


def joined(state: Joining, here: int, height: np.ndarray) -> list[tuple[float, int, int]]:
    """Joins down to about ``here`` clusters; the joints: height, first vector of the one and of the other."""
    joints = []
    while len(names := state.held.names) > max(here, 1):
        state.settle()
        to = state.first[names]
        known = to >= 0
        mutual = names[known & (state.first[to] == names) & (names < to)]
        if known.all() and not len(mutual):  # equal but for the ninth digit, as seen from the one and from the other
            mutual = names[T.rounded(state.low[state.slot[names]], 9).min(1).argmin()][None]
        if len(mutual):
            mutual, other = np.minimum(mutual, state.first[mutual]), np.maximum(mutual, state.first[mutual])
            height[mutual] = np.maximum(T.rounded(state.measure(mutual, other), 9), np.maximum(height[mutual], height[other]))
            joints += zip(height[mutual].tolist(), mutual.tolist(), other.tolist(), strict=True)
            state.join(mutual, other)
        else:
            state.search(names[~known], False)
            if len(tied := state.settle()):
                state.search(tied, True)
    return joints
