"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms: lower-cased runs of letters, digits and bytes from 0x80, hashed to
2**``BITS`` buckets. Terms take part that go with the label or against it (chi-square), alone or among the
texts that hold one of the ``ANCHORS`` terms that do most: so a word that says nothing by itself, such as a
group's name, takes part if it matters beside an insult. The machine scores a text by w0 + sum of w_i + sum over pairs
of <v_i, v_j>, so a pair of terms can weigh more or less than the two alone. It is fitted by Adam on all
chosen rows at once, on the driver, from at most ``MOST`` labelled rows; the model is a few thousand terms
at most 2**``BITS``, so it goes to the executors whole.

Defined results: a null or empty text, or one without known terms, has the score of w0; null labels are
left out; a row whose id has several labels has their mean as its label; of rows with one id each counts;
without both labels in the sample the score is (positives + 0.5) / (rows + 2) for all; null ids can't be
labelled and are scored; equal texts have equal scores; texts are taken whole, however long; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import _bytes as B
from quire.llm import _learn as L
from quire.llm import _spark as S

BITS = 20
#: Labelled rows that the machine is fitted on, at most; beyond, a hash of id and place draws them.
MOST = 20_000
FACTORS = 8
ROUNDS = 150
RATE = 0.05
DECAY = 0.1
#: Least chi-square with one degree of freedom of a term that goes with label 1, or against it (most words lean a little
#: against a rare label), and least rows of a term.
CHI, AGAINST, ROWS = 8.0, 20.0, 3
#: The same for a term beside another, where many more are tried; how many of the terms that go most with a label
#: others are tried beside, and how many terms take part for that reason, at most.
BESIDE, BESIDE_ROWS, ANCHORS, PARTNERS = 30.0, 20, 32, 256
_TERM = B.separators((0, 47), (58, 64), (91, 96), (123, 127))


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of each distinct term of each text, in this order."""
    whole, bounds = B.buffer(column)
    out = [np.empty(0, np.int64)]
    for i, j in B.pieces(bounds):
        buf, offs = B.lowered(whole[bounds[i] : bounds[j]]), bounds[i : j + 1] - bounds[i]
        starts, ends, text = B.words(buf, offs, _TERM)
        out.append(B.distinct((text + i) << BITS | (B.span_hashes(buf, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)))
    both = np.concatenate(out)
    return both >> BITS, both & ((1 << BITS) - 1)


@dataclass
class Machine:
    """bias, and for each known bucket (ascending) a weight and a vector."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def scores(self, n: int, text: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Probabilities for n texts."""
        on = B.member(bucket, self.buckets)
        text, at = text[on], np.searchsorted(self.buckets, bucket[on])
        z = self.bias + np.bincount(text, self.weights[at], n)
        for v in self.vectors.T.astype(np.float64):
            x = v[at]
            z += (np.bincount(text, x, n) ** 2 - np.bincount(text, x * x, n)) / 2
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _chi(a: np.ndarray, rows: np.ndarray, n: float, p: float) -> np.ndarray:
    """Chi-square (with Yates' correction) of terms in ``rows`` of n texts, ``a`` of them of the p with label 1."""
    b, c = rows - a, p - a
    d = n - p - b
    return n * np.clip(np.abs(a * d - b * c) - n / 2, 0, None) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1)


def _chosen(text: np.ndarray, bucket: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Buckets whose presence goes with a label, among all texts or among those that hold a term that does."""
    every = 1 << BITS
    rows = np.bincount(bucket, minlength=every).astype(float)
    toxic = np.bincount(bucket, label[text], every)
    chi = _chi(toxic, rows, len(label), label.sum())
    chi[(rows < ROWS) | (chi < np.where(toxic * len(label) > rows * label.sum(), CHI, AGAINST))] = 0
    best = np.zeros(every)
    first = np.searchsorted(text, np.arange(len(label) + 1))
    for k in np.argsort(-chi, kind="stable")[:ANCHORS].tolist():
        own = text[bucket == k] if chi[k] else text[:0]
        size = first[own + 1] - first[own]
        at = np.repeat(first[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        n = np.bincount(bucket[at], minlength=every).astype(float)
        beside = _chi(np.bincount(bucket[at], label[text[at]], every), n, len(own), label[own].sum())
        best = np.where((n >= BESIDE_ROWS) & (n <= len(own) - BESIDE_ROWS), np.maximum(best, beside), best)
    best[(best < BESIDE) | (chi > 0)] = 0
    partners = np.argsort(-best, kind="stable")[:PARTNERS]
    return np.union1d(np.flatnonzero(chi), partners[best[partners] > 0])


def _merged(text: np.ndarray, term: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with the same terms as one: text and term numbers, how many texts each one is, and the sum of their labels."""
    print_ = np.zeros(len(label), np.uint64)
    first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    print_[text[first]] = np.add.reduceat(B.mix(term.astype(np.uint64) + np.uint64(1)), first)
    _, head, of, times = np.unique(print_, return_index=True, return_inverse=True, return_counts=True)
    keep = head[of[text]] == text
    text = of[text[keep]]
    order = np.argsort(text, kind="stable")
    return text[order], term[keep][order], times.astype(float), np.bincount(of, label, len(head))


def fit(text: np.ndarray, bucket: np.ndarray, label: np.ndarray) -> Machine:
    """The machine for labelled texts; ``text`` ascends."""
    n, positive = len(label), float(label.sum())
    share = (positive + 0.5) / (n + 2)
    known = _chosen(text, bucket, label) if 0 < positive < n else np.empty(0, np.int64)
    machine = Machine(float(np.log(share / (1 - share))), known, np.zeros(len(known)), np.random.default_rng(0).normal(0, 0.01, (len(known), FACTORS)))
    on = B.member(bucket, known)
    text, term = text[on], np.searchsorted(known, bucket[on])
    if not len(text):
        return machine
    text, term, times, label = _merged(text, term, label)
    order = np.argsort(term, kind="stable")
    heads, rows = np.searchsorted(term[order], np.arange(len(known))), text[order]
    first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    some = text[first]
    values = [np.array([machine.bias]), machine.weights, machine.vectors]
    means, squares = [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values]
    for t in range(1, ROUNDS + 1):
        bias, w, v = values
        x = v.astype(np.float32)[term]
        sums, own = np.zeros((len(times), FACTORS), np.float32), np.zeros(len(times))
        sums[some] = np.add.reduceat(x, first)
        own[some] = np.add.reduceat(np.einsum("ij,ij->i", x, x), first)
        z = bias + np.bincount(text, w[term], len(times)) + ((sums * sums).sum(1) - own) / 2
        error = times / (1 + np.exp(-np.clip(z, -500, 500))) - label
        of_term = np.add.reduceat(error[rows], heads)
        lean = np.add.reduceat((error.astype(np.float32)[:, None] * sums)[rows], heads)
        slope = [np.array([error.sum()]), of_term + 10 * DECAY * w, lean - v * of_term[:, None] + DECAY * v]
        for value, g, m, s in zip(values, slope, means, squares, strict=True):
            g = g / n
            m *= 0.9
            m += 0.1 * g
            s *= 0.99
            s += 0.01 * g * g
            value -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    machine.bias = float(values[0][0])
    return machine


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST) -> Machine:
    """Fits on the texts of ``docs`` whose id has a label."""
    rows = S.row_keyed(docs, 1, id=F.col(id_col), text=F.col(text_col)).drop("_b")
    labelled = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("_label")).dropna().groupBy("id").agg(F.avg("_label").alias("_label"))
    keys = S.written(rows.select("_f", "_r", "id").join(labelled, "id"), "labelled")
    rows = L.fetched(rows.select("_f", "_r", "text"), L.sample(keys, most).select("_f", "_r", "_label")).select("_label", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, bucket = terms(batch.column("text"))
            cut = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("_label"), pa.ListArray.from_arrays(pa.array(cut), pa.array(bucket.astype(np.int32)))], names=["label", "terms"])
            B.release()

    got = rows.mapInArrow(each, "label double, terms array<int>").toArrow().combine_chunks()
    label, held = got.column("label").to_numpy().astype(float), got.column("terms").combine_chunks()
    return fit(np.repeat(np.arange(len(label), dtype=np.int32), held.value_lengths().to_numpy()), held.flatten().to_numpy(), label)


def scored(docs: DataFrame, machine: Machine, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """All columns of ``docs`` with the score, 0 to 1, beside them; a column that is called like ``out_col`` gives way."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        out = pa.array(model.value.scores(len(text), *terms(text)))
        B.release()
        return out

    return docs.select(*S.every(docs.drop(out_col)), score(F.col(text_col)).alias(out_col))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels of a fifth of the ids are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = L.held_out("doc_id", 5, 0)
    machine = train(docs, labels.filter(~out))
    return scored(docs.select("doc_id", "text"), machine).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
