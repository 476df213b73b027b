"""Language ID, words first: known words vote by their frequency in each language, unseen words back off.

Words are runs of letters in lower case. A word that the training texts hold at least ``SEEN`` times
adds its log frequency in each language. An unseen word falls back to its runs of ``LONGEST`` letters
(with marks for its ends), then to ever shorter ones, to the first length of which any run is known, and
adds the mean of their log frequencies. The language with the largest sum wins; ties go to the first in
alphabetical order. The score is that language's share when the sums per word are taken as evidence.

Counts come from at most ``MOST`` labelled texts of each language, so a rare language is learned beside
common ones, and the model grows with the languages but not with the texts; it goes to the executors whole.

Defined results: ``und`` with score 0 if the text is null or has no letter, or nothing could be learned;
null languages teach nothing; repeated rows teach as often as they come; equal texts have equal results;
texts are taken whole, however long; null or repeated ids don't matter; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import _bytes as B
from quire.llm import _learn as L
from quire.llm import _spark as S

#: Labelled texts of a language that counts come from, at most; beyond, a hash of id and place draws them.
MOST = 2_000
#: Longest run of letters that an unseen word falls back to, and least count of what is known.
LONGEST, SEEN = 5, 3
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_SPACE = ord(" ")


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters (as code points) of all words with a space before and after each; starts, ends and text numbers of the words."""
    found = [_LETTERS.findall((t or "").lower()) for t in texts]
    text = np.repeat(np.arange(len(texts)), [len(x) for x in found])
    line = f" {' '.join(w for x in found for w in x)} " if len(text) else ""
    code = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    gaps = np.flatnonzero(code == _SPACE)
    return code, gaps[:-1] + 1, gaps[1:], text


def _runs(code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of every run of n letters or end marks that is more than marks and stays inside a word."""
    hashes = B.window_hashes(B.mix(code.astype(np.uint64)), n)
    mark = np.append(0, np.cumsum(code == _SPACE))
    # a mark may only be the first or the last of a run
    inner = mark[n - 1 : n - 1 + len(hashes)] - mark[1 : 1 + len(hashes)] if n > 2 else np.zeros(len(hashes), np.int64)
    marks = mark[n:] - mark[:-n]
    at = np.flatnonzero((inner == 0) & (marks < n))
    return at, B.mix(hashes[at] ^ np.uint64(n))


def _hashes(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of every word."""
    return B.span_hashes(np.ascontiguousarray(code).view(np.uint8), starts * 4, ends * 4)


@dataclass
class Model:
    """languages; for words (0) and runs of each length: ascending hashes and log frequencies by language."""

    languages: list[str]
    keys: list[np.ndarray]
    logs: list[np.ndarray]

    def known(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        on = B.member(hashes, self.keys[n])
        return on, np.searchsorted(self.keys[n], hashes[on])

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log frequency by language, and number of words, of every text."""
        code, starts, ends, text = _words(texts)
        size = len(self.languages)
        counts = np.bincount(text, minlength=len(texts))
        if not len(text):
            return np.zeros((len(texts), size)), counts
        _, first, of = np.unique(_hashes(code, starts, ends), return_index=True, return_inverse=True)
        value = np.zeros((len(first), size), np.float64)
        starts, ends = starts[first], ends[first]
        on, at = self.known(0, _hashes(code, np.sort(starts), ends[np.argsort(starts)]))
        by = np.argsort(starts)
        value[by[on]] = self.logs[0][at]
        left = np.sort(by[~on])
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            # the words still without a value, each with its end marks
            lens = ends[left] - starts[left] + 2
            owner = np.repeat(np.arange(len(left)), lens)
            place = np.repeat(starts[left] - 1 - (np.cumsum(lens) - lens), lens) + np.arange(len(owner))
            part = code[place]
            where, hashes = _runs(part, n)
            same = owner[where] == owner[np.minimum(where + n - 1, len(owner) - 1)]
            where, hashes = where[same], hashes[same]
            on, at = self.known(n, hashes)
            word = owner[where[on]]
            times = np.bincount(word, minlength=len(left))
            for k in range(size):
                value[left, k] = np.bincount(word, self.logs[n][at, k], len(left)) / np.maximum(times, 1)
            left = left[times == 0]
        out = np.stack([np.bincount(text, value[of, k], len(texts)) for k in range(size)], axis=1)
        return out / np.maximum(counts, 1)[:, None], counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        mean, counts = self.sums(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = mean.argmax(axis=1)
        # evidence grows with the words, but neighbouring words are not independent
        share = np.exp((mean - mean.max(axis=1, keepdims=True)) * np.sqrt(np.maximum(counts, 1))[:, None])
        score = np.where(counts > 0, 1 / share.sum(axis=1), 0.0)
        return [self.languages[b] if c else UNKNOWN for b, c in zip(best.tolist(), counts.tolist(), strict=True)], score


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MOST, learn: Column | None = None) -> Model:
    """Counts words and runs of letters of the labelled texts of ``docs``, or of those that ``learn`` holds for."""
    rows = S.row_keyed(docs, 1, id=F.col(id_col), text=F.col(text_col), lang=F.col(lang_col).cast("string"), learn=F.lit(True) if learn is None else learn).filter("lang IS NOT NULL AND learn")
    rows = L.fetched(rows.select("_f", "_r", "text"), L.sample(rows.select("_f", "_r", "id", "lang"), most, "lang").select("_f", "_r", "lang")).select("lang", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                code, starts, ends, text = _words([t for t, x in zip(texts, langs, strict=True) if x == lang])
                if not len(text):
                    continue
                for n in range(LONGEST + 1):
                    keys, times = np.unique(_runs(code, n)[1] if n else _hashes(code, starts, ends), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(np.full(len(keys), n, np.int32)), pa.array(keys.view(np.int64)), pa.array(times)], names=["lang", "n", "key", "times"])

    counted = rows.mapInArrow(each, "lang string, n int, key long, times long").groupBy("lang", "n", "key").agg(F.sum("times").alias("times"))
    got = counted.filter(F.col("times") >= SEEN).toArrow()
    lang, n, key, times = (got.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "n", "key", "times"))
    languages = sorted(set(lang.tolist()))
    number = np.array([languages.index(x) for x in lang.tolist()], np.int64)
    keys, logs = [], []
    for k in range(LONGEST + 1):
        on = n == k
        every, place = np.unique(key[on].view(np.uint64), return_inverse=True)
        table = np.zeros((len(every), len(languages)))
        np.add.at(table, (place, number[on]), times[on])
        keys.append(every)
        logs.append(np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * len(every) + 1)).astype(np.float32))
    return Model(languages, keys, logs)


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            _, offs = B.buffer(texts)
            found = [held.value.predict(texts.slice(i, j - i).to_pylist()) for i, j in B.pieces(offs)]
            langs = [x for f, _ in found for x in f]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(langs, pa.string()), pa.array(np.concatenate([s for _, s in found] or [np.empty(0)]))], names=["id", "lang_pred", "score"])
            B.release()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(each, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a quarter of the ids teach nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = L.held_out("doc_id", 4, 2)
    model = train(docs, learn=~out)
    return predicted(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
