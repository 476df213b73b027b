"""A corpus pipeline over ``documents``: toxic texts and near copies go, shared passages are cut, contaminated
texts go, and the rest is packed for training.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the
last return the columns of ``documents``. ``docs`` is a table that was written before, so that the places
of its rows are their keys; ids may be null or repeated. Each result is written before the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import _spark as S
from quire.llm.decontamination import decontaminate
from quire.llm.near_copies import near_copies
from quire.llm.packing import pack
from quire.llm.suffix_dedup import suffix_dedup
from quire.llm.toxicity import scored, train

#: Words in a shingle of the near-duplicate stage.
SHINGLE = 5
#: Up to so many rows that go are sent to all tasks, 16 bytes a row, so that texts needn't move; more are joined by a shuffle.
BROADCAST = 1 << 21


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose places (two columns) are in ``gone``."""
    f, r = gone.columns
    gone = S.written(gone, "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST else gone.hint("merge")
    return S.keyed_all(docs, f, r).join(gone, [f, r], "left_anti").select(S.every(docs))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is below one half; the machine learns from all labels of ``sf_dir``. Null and empty texts
    have the machine's bias as their score; without labels of both kinds all rows have one score, so all stay (or,
    with mostly toxic labels, all go); columns of any name come out as they went in; an empty table stays empty."""
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = S.fresh(docs, "score")[0]
    return scored(docs, machine, out_col=score).filter(S.named(score) < 0.5).select(S.every(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (shingle similarity of 0.8 or more) the row with the least id stays (null ids
    last; then by place). All texts without words are copies of each other; null is such a text; columns of any name
    come out as they went in; an empty table stays empty."""
    docs = S.stable(docs)
    f, r = S.fresh(docs, "_f", "_r")
    found = S.written(near_copies(docs, words=SHINGLE), "near")
    place = F.struct(F.isnull("id").alias("none"), "id", "_f", "_r")
    first = found.groupBy("root").agg(F.min(place).alias("first")).select("first._f", "first._r")
    gone = found.select("_f", "_r").join(first, ["_f", "_r"], "left_anti").toDF(f, r)
    return _without(docs, gone)


def suffix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of 50 bytes that a text with a smaller id has, and ``n_chars`` to match; all
    rows stay, null and shorter texts as they are. Rows with one id don't cut each other, and null ids count as
    larger than all; other columns, of any name, come out as they went in; an empty table stays empty."""
    docs = S.stable(docs)
    f, r, new = S.fresh(docs, "_f", "_r", "_text")
    # decoded by the tasks that cut: a function of its own would hold a second Python worker beside each of them
    cut = suffix_dedup(docs, as_text=True).filter("n_removed > 0").select("_f", "_r", "kept").toDF(f, r, new)
    both = S.keyed_all(docs, f, r).join(cut, [f, r], "left")
    value = {c: S.named(c) for c in docs.columns}
    if "n_chars" in value:
        value["n_chars"] = F.when(S.named(new).isNull(), F.col("n_chars")).otherwise(F.char_length(S.named(new)).cast(docs.schema["n_chars"].dataType))
    value["text"] = F.coalesce(S.named(new), F.col("text"))
    return both.select(*[x.alias(c) for c, x in value.items()])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share no window of ten words with the benchmark of ``sf_dir`` (all words of a shorter item). Null and
    empty texts share none; repeated rows stay or go together; columns of any name come out as they went in; an
    empty table stays empty, and an empty benchmark leaves all rows."""
    docs = S.stable(docs)
    f, r = S.fresh(docs, "_f", "_r")
    hit = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated").select("_f", "_r").toDF(f, r)
    return _without(docs, hit)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts in sequences of 4096 tokens: a null or empty text is its end token alone; rows with null
    or repeated ids are packed like others; an empty table gives no pieces; other columns are ignored."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("simhash_near_dedup", near_dedup), ("suffix_dedup", suffix), ("decontamination", decontamination), ("best_fit_packing", packing)]

#: SQL can't express the stages (hashes, a learned model, tokens); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again, and what
    the stage had to write besides goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = S.table_path(spark, name)
        with S.scratch(spark):
            docs = S.written(stage(spark, docs, sf_dir), name, path)
    return STAGES[-1][1](spark, docs, sf_dir)
