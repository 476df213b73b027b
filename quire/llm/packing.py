"""Best-two-fit packing of token sequences.

Texts become token ids and an end id; a text longer than a sequence is cut into full pieces and a rest.
Only pieces' lengths are packed, so neither texts nor ids move: pieces are dealt at random to shards of
about ``SHARD`` pieces, and each shard is packed by itself. A shard leaves about one sequence part full.

Best-two-fit: a sequence starts with the longest piece left and is filled greedily with the longest that
fits. Then its smallest piece gives way to two unpacked pieces, wherever two together fit the widened
gap more tightly than that piece did; the pair that fits best is taken. This repeats while it helps.

Defined results: null text is empty and packs as its end id alone; ids of rows may be null or repeated,
as rows are told apart by their place in the input; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import _bytes as B
from quire.llm import _spark as S

#: Tokens in a sequence.
LENGTH = 4096
#: The id that ends every text.
END = 1
#: Pieces that one shard packs, about.
SHARD = 32768
#: Words whose ids a worker process remembers, about 100 MB; then it starts anew.
REMEMBERED = 600_000
VOCABULARY = "word_bpe_49k.json"

_PIECES = "id {id}, piece int, start long, length long, ids_crc32 long, row long"


def tokenizer_path(name: str = VOCABULARY) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Words whose runs are told by their bytes: ASCII without controls and apostrophes.
_PLAIN = re.compile(rb"[!-&(-~]+")
_WORKERS: dict[str, WordIds] = {}
_ALNUM = ~B.separators((48, 57), (97, 122))
_RUN = re.compile(rb"[A-Za-z]+|[0-9]|[^A-Za-z0-9]+")


class WordIds:
    """Token ids of texts by a tokenizer that lower-cases and drops white space.

    White space always ends a token, so a text's ids are those of its space-separated parts, one after
    another; each distinct part (by a 64-bit hash) is tokenised once and remembered. Lower case, and final
    marks as parts of their own, make fewer distinct parts and change no ids; texts that may hold special
    tokens, whose case counts, are left as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_run = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_run[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self.marks = np.zeros(256, np.uint32)
        for c in ".,":
            self.marks[ord(c)] = self.tokenizer.encode(c, add_special_tokens=False).ids[0]
        self._forget()

    @staticmethod
    def shared(path: str) -> WordIds:
        """One for each worker process, which runs many tasks; ``REMEMBERED`` bounds what it keeps."""
        if path not in _WORKERS:
            _WORKERS[path] = WordIds(path)
        return _WORKERS[path]

    def _forget(self) -> None:
        """Numbers of words by hash; ids of all words one after another, and where each word's begin."""
        self.number: dict[int, int] = {}
        self.ids, self.begin = array("I"), array("q", [0])

    def of(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each with the end id, and where each text's begin."""
        data = buf.tobytes()
        if b"<|" not in data:
            buf = B.lowered(buf)
            data = buf.tobytes()
        starts, ends, text = B.words(buf, offs, B.SPACED)
        # a full stop or comma after a letter or digit is a token of its own
        mark = np.where(ends - starts > 1, self.marks[buf[ends - 1]], 0)
        mark[~_ALNUM[buf[ends - 2]]] = 0
        ends = ends - (mark > 0)
        hashes, first, of = np.unique(B.span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.number) > REMEMBERED:
            self._forget()
        keys = hashes.tolist()
        new = [k for k, x in enumerate(map(self.number.get, keys)) if x is None]
        where = first[new]
        for k, ids in zip(new, self._learn([data[a:z] for a, z in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]), strict=True):
            self.number[keys[k]] = len(self.begin) - 1
            self.ids.frombytes(ids)
            self.begin.append(len(self.ids))
        word = np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys))[of]
        begin = np.frombuffer(self.begin, np.int64)
        size = begin[word + 1] - begin[word]
        both = size + (mark > 0)
        # where nothing else is written, the end id stays
        at = np.cumsum(both) - both + text
        out = np.full(int(both.sum()) + len(offs) - 1, END, np.uint32)
        owner = np.repeat(np.arange(len(word)), size)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        out[at[owner] + nth] = np.frombuffer(self.ids, np.uint32)[begin[word][owner] + nth] if len(self.ids) else 0
        out[(at + size)[mark > 0]] = mark[mark > 0]
        return out, np.append(0, np.cumsum(np.bincount(text, both, len(offs) - 1).astype(np.int64) + 1))

    def _learn(self, new: list[bytes]) -> list[bytes]:
        """Ids of words, many in one line where it is known how many tokens that end a run each has."""
        out: list[bytes] = [b""] * len(new)
        line: list[int] = []
        runs: list[int] = []
        alone: list[int] = []
        for k, w in enumerate(new):
            n = 1 if w.isalpha() else len(_RUN.findall(w)) if _PLAIN.fullmatch(w) and b"<|" not in w else 1 if w.decode().isalpha() else 0
            if n:
                line.append(k)
                runs.append(n)
            else:
                alone.append(k)
        for i in range(0, len(line), 512):
            part, last = line[i : i + 512], np.cumsum(runs[i : i + 512]) - 1
            ids = np.array(self.tokenizer.encode(b" ".join([new[k] for k in part]).decode(), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.ends_run[ids])
            if len(ends) != last[-1] + 1:  # lower case or normal form made other runs of some word
                alone += part
                continue
            data, cut = ids.tobytes(), [0, *(4 * (ends[last] + 1)).tolist()]
            for k, a, z in zip(part, cut, cut[1:], strict=False):
                out[k] = data[a:z]
        for i in range(0, len(alone), 512):
            part = alone[i : i + 512]
            for k, e in zip(part, self.tokenizer.encode_batch_fast([new[k].decode() for k in part], add_special_tokens=False), strict=True):
                out[k] = array("I", e.ids).tobytes()
        return out


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, and row (a random number of the text). Without a
    path every worker takes the public vocabulary that is installed with it."""
    schema = _PIECES.format(id=docs.schema[id_col].dataType.simpleString())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds.shared(path or tokenizer_path())
        for batch in batches:
            whole, bounds = B.buffer(batch.column("text"))
            for i, j in B.pieces(bounds):
                found, at = ids.of(whole[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                sizes = np.diff(at)
                count = -(-sizes // length)
                text = np.repeat(np.arange(j - i), count)
                piece = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * length
                size = np.minimum(length, sizes[text] - start)
                data = found.astype("<u4", copy=False).tobytes()
                crc = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip((at[text] + start).tolist(), (at[text] + start + size).tolist(), strict=True)]
                part = batch.slice(i, j - i)
                where = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(where), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), part.column("row").take(where)],
                    names=["id", "piece", "start", "length", "ids_crc32", "row"],
                )
        B.release()

    rows = S.row_keyed(docs, 1, id=F.col(id_col), text=F.col(text_col))
    return rows.select("id", "text", F.xxhash64("_f", "_r").alias("row")).mapInArrow(cut, schema)


class _Left:
    """Lengths that are still unpacked, with how many pieces have each."""

    def __init__(self, lengths: np.ndarray, size: int):
        self.count = np.bincount(lengths, minlength=size + 1).tolist()
        self.present = np.unique(lengths).tolist()

    def fits(self, x: int) -> int:
        """The longest length left that is at most x; 0 if none."""
        k = bisect_right(self.present, x)
        return self.present[k - 1] if k else 0

    def take(self, x: int) -> None:
        self.count[x] -= 1
        if not self.count[x]:
            del self.present[bisect_left(self.present, x)]

    def put(self, x: int) -> None:
        self.count[x] += 1
        if self.count[x] == 1:
            insort(self.present, x)

    def pair(self, room: int, least: int) -> tuple[int, int] | None:
        """Two pieces that together fill ``room`` best, more than ``least``; the one with the longest piece on ties."""
        best, found = least, None
        for k in range(bisect_left(self.present, room) - 1, -1, -1):
            a = self.present[k]
            if 2 * a <= best:
                break
            b = self.fits(min(a, room - a))
            if b == a and self.count[a] < 2:
                b = self.fits(a - 1)
            if b and a + b > best:
                best, found = a + b, (a, b)
                if best == room:
                    break
        return found


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of every piece; all lengths are 1 to ``size``."""
    left, bins = _Left(lengths, size), []
    while left.present:
        members, gap = [], size
        while x := left.fits(gap):
            left.take(x)
            members.append(x)
            gap -= x
        while gap and (two := left.pair(gap + members[-1], members[-1])):
            small = members.pop()
            for x in two:
                left.take(x)
            left.put(small)
            members = sorted([*members, *two], reverse=True)
            gap += small - sum(two)
        bins.append(members)
    # equal lengths are dealt to their places in the order of the pieces
    flat = np.fromiter((x for m in bins for x in m), np.int64, len(lengths))
    ends = np.cumsum(flat)
    number = np.repeat(np.arange(len(bins)), [len(m) for m in bins])
    base = np.append(0, ends[np.cumsum([len(m) for m in bins]) - 1])[:-1] if bins else np.empty(0, np.int64)
    piece, place = np.argsort(lengths, kind="stable"), np.argsort(flat, kind="stable")
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    sequence[piece] = number[place]
    offset[piece] = (ends - flat - base[number])[place]
    return sequence, offset


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, path: str | None = None) -> DataFrame:
    """One row for each piece of each text: id, piece, start, length, ids_crc32, sequence_id, offset."""
    # written, so that texts are tokenised once, and the shards' number follows the number of pieces
    cut = S.written(pieces(docs, id_col, text_col, path, length), "pieces")
    n = max(1, round(cut.count() / SHARD))
    out = f"{_PIECES.format(id=docs.schema[id_col].dataType.simpleString())}, sequence_id long, offset long"

    def fill(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values(["row", "piece"]).reset_index(drop=True)
        sequence, offset = best_two_fit(got["length"].to_numpy(), length)
        return got.drop(columns="shard").assign(sequence_id=sequence * n + key[0], offset=offset)

    # a long text's pieces go to several shards
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(n)))
    return dealt.groupBy("shard").applyInPandas(fill, out).drop("row").withColumnRenamed("id", id_col)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
