"""LM scoring: prediction by partial matching over bytes, and a smoothed unigram model of words as base.

The model is a trie of byte contexts of up to ``ORDER`` bytes over all training texts. A coding looks a byte
up in its longest context. There a byte that was seen n times among ``total`` has (n - ``DISCOUNT``) / total,
and the escape has ``DISCOUNT`` * distinct / total; after an escape the bytes that the context has seen are
excluded from the next shorter one. Below the empty context all bytes left are equally likely. Shorter
contexts count a byte once for each different byte before the context (updates are excluded where a longer
context foresees the byte), so what is common in one place only isn't taken for common anywhere.

Codings that start from contexts of each of ``STARTS`` bytes run side by side, and a byte's probability is
their mean. The weights adapt within the text: they follow the roots of the probabilities that the codings
gave the ``RECENT`` bytes before. A text is its bytes and an end, byte 0; contexts reach back to such bytes
before the text.

The trie is never in one place. Each block of texts sends its distinct words, and its distinct strings of
``ORDER`` + 1 bytes, with their counts in training texts, to shards: words by their hash, strings by the
last three bytes of their context. A shard adds up the counts, so it has the whole trie below its three
bytes, and answers each block, in the order of what it sent, with what its words count and what its strings
cost. Only the counts of strings of three bytes, 2**24 at most (some 100 MB at worst, about one on texts in
a few languages), go to all shards.

Defined results: null text is empty and has the end as its only token; a byte 0 inside a text is the same
symbol as the end; a null id is never held out; rows may repeat; without training texts all words are
unknown and all bytes equally likely; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import _bytes as B
from quire.llm import _learn as L
from quire.llm import _repeats as R
from quire.llm import _spark as S

#: Bytes of the longest context, and of those that codings start from.
ORDER = 6
STARTS = (4, 6)
#: What is taken from each count for the escape.
DISCOUNT = 0.25
#: Bytes that the weights of the codings follow.
RECENT = 16
#: Bytes of a context that a shard has in common.
COMMON = 3
#: Rows of a block: large ones share more words and strings.
BLOCK_ROWS = 3072

_SENT = "shard int, kind int, _f long, _b long, part long, keys binary, counts binary"
_TOLD = "_f long, _b long, part long, shard int, kind int, first binary, second binary, total long, distinct long"


def _mask(size: int) -> np.uint64:
    """The bits of a context of so many bytes and the byte after it."""
    return np.uint64((1 << 8 * (size + 1)) - 1)


def strings(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All strings of ORDER + 1 bytes of the texts with their ends, as numbers, and their text numbers; part by part."""
    n = len(offs) - 1
    lens = np.diff(offs)
    wide = lens + ORDER + 1
    starts = np.cumsum(wide) - wide
    # a number is read from eight bytes, the last of which goes
    padded = np.zeros(len(buf) + (ORDER + 1) * n + 8, np.uint8)
    inside = np.ones(len(padded), bool)
    inside[len(padded) - 8 :] = False
    for k in range(ORDER):
        inside[starts + k] = False
    inside[starts + ORDER + lens] = False
    padded[inside] = buf
    # a text's strings start at its first padding byte, one for each byte and one for the end
    inside[:] = True
    for k in range(ORDER):
        inside[starts + lens + 1 + k] = False
    text = np.repeat(np.arange(n, dtype=np.int32), wide)
    for a in range(0, len(text), B.PIECE):
        size = min(B.PIECE, len(text) - a)
        number = np.ndarray(size, ">u8", padded[a : a + size + 8], strides=(1,)).astype(np.uint64)
        number >>= np.uint64(8 * (7 - ORDER))
        real = inside[a : a + size]
        yield number[real], text[a : a + size][real]


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys with the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order].astype(np.uint32, copy=False)
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[head], np.add.reduceat(counts, head, dtype=counts.dtype) if len(head) else counts


def _tallied(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with how often each is in training texts (``learn``)."""
    known, times = np.unique(keys[learn], return_counts=True)
    other = B.distinct(keys[~learn])
    return _counted(np.append(known, other), np.append(times, np.zeros(len(other), np.int64)).astype(np.uint32))


class _Tally:
    """Distinct keys of a block with their counts, added up now and then."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((keys, counts))
        if sum(len(k) for k, _ in self.held[1:]) > max(1 << 20, len(self.held[0][0])):
            self.held = [self.whole()]

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        return _counted(*map(np.concatenate, zip(*self.held, strict=True)))


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word."""
    low = B.lowered(buf)
    starts, ends, text = B.words(low, offs, B.SPACED)
    return B.span_hashes(low, starts, ends), text


def _shard(kind: int, keys: np.ndarray, n: int) -> np.ndarray:
    return B.shard_of(B.mix(keys >> np.uint64(8) & _mask(COMMON - 1)) if kind else keys, n)


class Level:
    """Contexts of one length. ``symbols`` are contexts with a byte that was seen after them, ascending, with one or
    more kinds of counts."""

    def __init__(self, size: int, symbols: np.ndarray, *counts: np.ndarray):
        self.mask, self.symbols, self.counts = _mask(size), symbols, [c.astype(np.float64) for c in counts]
        self.contexts, self.owner = np.unique(symbols >> np.uint64(8), return_inverse=True)
        self.totals = [np.bincount(self.owner, c, len(self.contexts)) for c in self.counts]
        self.distinct = np.bincount(self.owner, minlength=len(self.contexts)).astype(np.float64)

    def below(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of the contexts of ``size`` bytes, one fewer: sums of the last counts here, and numbers of symbols here."""
        keys = self.symbols & _mask(size)
        order = np.argsort(keys)
        keys = keys[order]
        head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        return keys[head], np.add.reduceat(self.counts[-1][order], head) if len(head) else self.counts[-1], np.diff(np.append(head, len(keys)))


def coded(start: int, keys: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 of the probability of the last byte of each string of ``start`` + 1 bytes, from the context of all before
    it. ``levels``, by the length of contexts, have the counts of updates first and the plain ones last."""
    out = np.zeros(len(keys))
    left = np.arange(len(keys))
    above: Level | None = None
    for size in range(start, -1, -1):
        level, plain = levels[size], size == start
        counts, totals = (level.counts[-1], level.totals[-1]) if plain else (level.counts[0], level.totals[0])
        own = keys[left]
        at, known = B.find((own & level.mask) >> np.uint64(8), level.contexts)
        total, distinct = (np.where(known, x[at], 0.0) if len(x) else np.zeros(len(own)) for x in (totals, level.distinct))
        if above is not None and len(above.symbols):
            # what the longer context has seen is excluded here
            gone = np.bincount(above.owner, counts[B.find(above.symbols & level.mask, level.symbols)[0]], len(above.contexts))
            up, longer = B.find((own & above.mask) >> np.uint64(8), above.contexts)
            total, distinct = total - np.where(longer, gone[up], 0.0), distinct - np.where(longer, above.distinct[up], 0.0)
        at, seen = B.find(own & level.mask, level.symbols)
        out[left[seen]] += np.log10((counts[at[seen]] - DISCOUNT) / total[seen])
        escape = ~seen & (distinct > 0)
        out[left[escape]] += np.log10(DISCOUNT * distinct[escape] / total[escape])
        left, above = left[~seen], level
    out[left] -= np.log10(max(1, 256 - len(levels[0].symbols)))
    return out


def costs(keys: np.ndarray, counts: np.ndarray, low: list[Level]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of ``STARTS`` the ascending distinct strings of so many bytes and one more, and what each costs.

    ``keys`` are ascending strings, all that share the last ``COMMON`` bytes of their contexts among them, with
    training ``counts``; ``low`` are the levels of shorter contexts over all texts.
    """
    levels: list[Level] = [Level(ORDER, keys[counts > 0], counts[counts > 0])]
    for size in range(ORDER - 1, COMMON - 1, -1):
        symbols, plain, updates = levels[0].below(size)
        levels.insert(0, Level(size, symbols, updates, plain))
    levels = [*low, *levels]
    out = []
    for start in STARTS:
        own = B.distinct(keys & _mask(start)) if start < ORDER else keys
        out.append((own, coded(start, own, levels)))
    return out


def low_levels(rows: DataFrame) -> list[Level]:
    """Levels of contexts of fewer than ``COMMON`` bytes, from all training texts (``rows`` with learn and text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [np.empty(0, np.uint64)], 0
        for batch in batches:
            whole, bounds = B.buffer(batch.column("text"))
            for i, j in B.pieces(bounds):
                for number, _ in strings(whole[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]):
                    held.append(B.distinct(number & _mask(COMMON)))
                    size += len(held[-1])
                    if size > 1 << 22:
                        held = [B.distinct(np.concatenate(held))]
                        size = len(held[0]) // 2
            B.release()
        yield pa.RecordBatch.from_arrays([pa.array(B.distinct(np.concatenate(held)).astype(np.int64))], names=["string"])

    found = rows.filter("learn").select("text").mapInArrow(each, "string long").distinct()
    symbol = F.col("string").bitwiseAND(F.lit(int(_mask(COMMON - 1)))).alias("symbol")
    got = found.groupBy(symbol).agg(F.count("*").alias("n")).toArrow()
    order = np.argsort(got.column("symbol").to_numpy())
    levels = [Level(COMMON - 1, got.column("symbol").to_numpy()[order].astype(np.uint64), got.column("n").to_numpy()[order])]
    for size in range(COMMON - 2, -1, -1):
        symbols, _, updates = levels[0].below(size)
        levels.insert(0, Level(size, symbols, updates))
    return levels


def blended(cost: np.ndarray, text: np.ndarray) -> np.ndarray:
    """log10 of each byte's probability from the ``cost`` of the two codings (a row each); ``text`` ascends."""
    n = cost.shape[1]
    short, long = cost.astype(np.float64) * np.log(10)
    lead = np.zeros(n + 1)
    np.cumsum(long - short, out=lead[1:])
    head = np.flatnonzero(np.append(True, text[1:] != text[:-1])[:n])
    first = np.repeat(head, np.diff(np.append(head, n)))
    # how much more the longer coding weighs
    weight = np.exp(np.clip((lead[:-1] - lead[np.maximum(np.arange(n) - RECENT, first)]) / 2, -300, 300))
    return np.log10((np.exp(short) + weight * np.exp(long)) / (1 + weight))


def _in_shards(kind: int, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of ascending keys by shard, and how many each shard has."""
    owner = _shard(kind, keys, n)
    return np.argsort(owner, kind="stable"), np.bincount(owner, minlength=n)


def _block_keys(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words and strings of some texts."""
    words, found = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for i, j in B.pieces(offs):
        part, bounds = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        words.append(B.distinct(_words(part, bounds)[0]))
        found += [B.distinct(number) for number, _ in strings(part, bounds)]
    return B.distinct(np.concatenate(words)), B.distinct(np.concatenate(found))


class _Costs:
    """The two costs of strings by a hash table with a quarter of its places taken, at most."""

    def __init__(self, keys: np.ndarray, cost: np.ndarray):
        bits = max(10, (4 * len(keys)).bit_length())
        self.keys, self.both = keys, np.ascontiguousarray(cost.T, np.float32).view(np.uint64).ravel()
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys), dtype=np.int32)
        while len(left):
            at = slot[left]
            free = self.table[at] < 0
            self.table[at[free]] = left[free]
            left = left[self.table[at] != left]
            slot[left] = slot[left] + 1 & self.last

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return (x * np.uint64(B._BASE) >> self.shift).astype(np.int64)

    def of(self, x: np.ndarray) -> np.ndarray:
        """A row for each coding; all strings are among the keys."""
        slot = self._slot(x)
        at = self.table[slot]
        left = np.flatnonzero(self.keys[at] != x)
        while len(left):
            slot[left] = slot[left] + 1 & self.last
            at[left] = self.table[slot[left]]
            left = left[self.keys[at[left]] != x[left]]
        return self.both[at].view(np.float32).reshape(-1, 2).T


def lm_score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    The models learn from the rows that are not held out."""
    n = S.shards(docs.sparkSession)
    kind_of_id = docs.schema[id_col].dataType.simpleString()
    rows = S.row_keyed(docs, BLOCK_ROWS, id=F.col(id_col), text=F.col(text_col), learn=~held_out)
    low = docs.sparkSession.sparkContext.broadcast(low_levels(rows))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, b, part in R.runs(batch):
                # a block may come in several parts, as files are split and rows come in batches
                begin = part.column("_r")[0].as_py()
                whole, bounds = B.buffer(part.column("text"))
                learn = part.column("learn").to_numpy(zero_copy_only=False)
                found = (_Tally(), _Tally())
                for i, j in B.pieces(bounds):
                    buf, offs, own = whole[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], learn[i:j]
                    hashes, text = _words(buf, offs)
                    found[0].add(*_tallied(hashes, own[text]))
                    for number, text in strings(buf, offs):
                        found[1].add(*_tallied(number, own[text]))
                for kind, tally in enumerate(found):
                    keys, counts = tally.whole()
                    order, size = _in_shards(kind, keys, n)
                    cut = np.append(0, np.cumsum(size))
                    keys, counts = keys[order], counts[order].astype(np.uint32, copy=False)
                    some = np.flatnonzero(size)
                    same = lambda x, t: pa.array(np.full(len(some), x), t)  # noqa: B023, E731
                    ends = list(zip(cut[some].tolist(), cut[some + 1].tolist(), strict=True))
                    steps = [B.squeezed(np.diff(keys[a:z], prepend=np.uint64(0))) for a, z in ends]
                    times = [B.squeezed(counts[a:z]) for a, z in ends]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), same(kind, pa.int32()), same(f, pa.int64()), same(b, pa.int64()), same(begin, pa.int64()), pa.array(steps, pa.binary()), pa.array(times, pa.binary())], names=["shard", "kind", "_f", "_b", "part", "keys", "counts"])
                B.release()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        shard = 0
        for x in (x for batch in batches for x in batch.to_pylist()):
            shard = x["shard"]
            held[x["kind"]].append(((x["_f"], x["_b"], x["part"]), np.cumsum(B.spread(x["keys"], np.uint64), dtype=np.uint64), B.spread(x["counts"], np.uint32)))
        for kind, sent in enumerate(held):
            if not sent:
                continue
            keys, counts = _counted(np.concatenate([k for _, k, _ in sent]), np.concatenate([c for *_, c in sent]).astype(np.int64))
            tables = costs(keys, counts, low.value) if kind else [(keys, counts)]
            total, distinct = int(counts.sum()), int((counts > 0).sum())
            for own_part, k, _ in sent:
                if kind:
                    told = [B.squeezed(value[np.searchsorted(own, B.distinct(k & _mask(start)))].astype(np.float32)) for start, (own, value) in zip(STARTS, tables, strict=True)]
                else:
                    told = [B.squeezed(counts[np.searchsorted(keys, k)].astype(np.uint64)), None]
                columns = [*own_part, shard, kind, *told, None if kind else total, None if kind else distinct]
                total = distinct = 0
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=_TOLD.replace(",", "").split()[::2])

    sent = rows.select("_f", "_b", "_r", "text", "learn").mapInArrow(send, _SENT)
    told = S.written(S.by_shard(sent, n, answer, _TOLD), "lm")
    total, distinct, texts = told.agg(F.sum("total"), F.sum("distinct")).crossJoin(rows.filter("learn").agg(F.count("*"))).first()
    tokens = int(total or 0) + texts
    scale = np.log10(tokens + int(distinct or 0) + (texts > 0) + 1)
    schema = f"id {kind_of_id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def ordered(replies: list[dict], kind: int, column: str, keys: np.ndarray, t: type) -> np.ndarray:
        """What the shards have told about ascending keys."""
        parts = [B.spread(x[column], t) for x in sorted((x for x in replies if x["kind"] == kind), key=lambda x: x["shard"])]
        out = np.empty(len(keys), t)
        out[_in_shards(kind, keys, n)[0]] = np.concatenate(parts) if parts else 0
        return out

    def finish(key: tuple, left: pa.Table, replies: pa.Table) -> pa.Table:
        row = left.column("_r").to_numpy()
        left = left.take(pa.array(np.argsort(row)))
        told = replies.to_pylist()
        begins = sorted({x["part"] for x in told})
        cut = [*np.searchsorted(np.sort(row), begins).tolist(), left.num_rows]
        return pa.concat_tables([scores(left.slice(a, z - a), [x for x in told if x["part"] == part]) for part, a, z in zip(begins, cut, cut[1:], strict=False)])

    def scores(left: pa.Table, told: list[dict]) -> pa.Table:
        whole, bounds = B.buffer(left.column("text"))
        words, known = _block_keys(whole, bounds)
        counts = ordered(told, 0, "first", words, np.uint64)
        cost = np.empty((len(STARTS), len(known)), np.float32)
        for k, (start, column) in enumerate(zip(STARTS, ("first", "second"), strict=True)):
            own = known & _mask(start)
            short = B.distinct(own)
            cost[k] = ordered(told, 1, column, short, np.float32)[np.searchsorted(short, own)]
        table = _Costs(known, cost)
        n_words, n_known, base, score = np.diff(bounds) * 0, np.diff(bounds) * 0, np.zeros(left.num_rows), np.zeros(left.num_rows)
        for i, j in B.pieces(bounds):
            buf, offs = whole[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            hashes, text = _words(buf, offs)
            c = counts[np.searchsorted(words, hashes)].astype(np.int64)
            n_words[i:j] = np.bincount(text, minlength=j - i)
            n_known[i:j] = np.bincount(text, c > 0, j - i)
            base[i:j] = np.bincount(text, np.log10(c + 1), j - i)
            before, of = np.empty((len(STARTS), 0), np.float32), np.empty(0, np.int32)
            for number, text in strings(buf, offs):
                now = np.concatenate([before, table.of(number)], axis=1)
                text = np.append(of, text)
                score[i:j] += np.bincount(text[len(of) :], blended(now, text)[len(of) :], j - i)
                before, of = now[:, -RECENT:], text[-RECENT:]
        n_words += 1
        base += np.log10(texts + 1) - n_words * scale
        return pa.table({"id": left.column("id"), "held_out": pa.array(~left.column("learn").to_numpy()), "n_tokens": n_words, "n_known": n_known + (texts > 0), "train_tokens": np.full(left.num_rows, tokens), "base_score": base, "score": score})

    return S.with_replies(rows, told.drop("total", "distinct"), finish, schema).withColumnRenamed("id", id_col)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; a seventh of the ids teach nothing."""
    return lm_score(spark.read.parquet(f"{sf_dir}/documents.parquet"), L.held_out("doc_id", 7, 2))
