"""Spark plumbing shared by the text operators: stable row keys, shared tables, block exchanges.

A *block* is a run of neighbouring rows of one input file. It is named by the file and by
``row_index div BLOCK_ROWS``, so the name is the same whenever and wherever the rows are read
again, whatever the values in the rows are (null or repeated ids included).
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import _bytes as B

_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Folder, below the shared one, that tables of the present run go to.
_RUN: ContextVar[str] = ContextVar("run", default="tables")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, a session in a single
    process gets a temporary one; on a cluster that would be a folder that executors don't see, so it is an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quire-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quire/{_RUN.get()}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions inside go as soon as each action ends, instead of at some later collection."""
    before = spark.conf.get(_FILE_CLEANUP, "false")
    spark.conf.set(_FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_FILE_CLEANUP, before)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or table_path(spark, name)
    with freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession, folder: str = "") -> None:
    """Removes all intermediate tables and archives that operators have left in the shared folder, or those in
    one folder there; results that have not been written yet are lost with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quire{folder and '/'}{folder}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write inside have a folder of their own, which goes at the end: what is to stay must be
    written inside to a path from outside."""
    folder = uuid.uuid4().hex
    token = _RUN.set(folder)
    try:
        yield
    finally:
        _RUN.reset(token)
        cleanup(spark, folder)


def shards(spark: SparkSession) -> int:
    """How many shards an exchange by hash has; it follows ``spark.sql.shuffle.partitions``."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _plain_scan(df: DataFrame) -> bool:
    return df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"


def stable(df: DataFrame) -> DataFrame:
    """``df`` as a file scan, whose rows have places that stay: itself if it is one, else written to the shared folder."""
    return df if _plain_scan(df) else written(df, "rows")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def named(name: str) -> Column:
    """The column of this very name, whatever signs are in it."""
    return F.col(f"`{name.replace('`', '``')}`")


def every(df: DataFrame) -> list[Column]:
    """All columns of ``df``, by their very names."""
    return [named(c) for c in df.columns]


def _place(df: DataFrame) -> tuple[Column, Column]:
    """File and row in it; a column of the table that is called _metadata doesn't hide them."""
    place = df.metadataColumn("_metadata")
    return F.xxhash64(place["file_path"]), place["row_index"]


def keyed_all(df: DataFrame, f: str = "_f", r: str = "_r") -> DataFrame:
    """All columns of a ``stable`` frame with the row's place in two columns more; their names must be ``fresh``."""
    file, row = _place(df)
    return df.select(*every(df), file.alias(f), row.alias(r))


def row_keyed(df: DataFrame, block_rows: int, **columns: Column) -> DataFrame:
    """``columns`` of ``df`` with ``_f`` (file), ``_b`` (block) and ``_r`` (row of the file), all long.

    A plain file scan already has stable row positions. Any other frame is first written to the
    shared folder, as a plan that runs twice may number its rows differently.
    """
    if not _plain_scan(df):
        df = written(df.select(*[c.alias(k) for k, c in columns.items()]), "rows")
        columns = {k: df[k] for k in columns}
    f, r = _place(df)
    return df.select(
        f.alias("_f"),
        F.floor(r / block_rows).cast("long").alias("_b"),
        r.alias("_r"),
        *[c.alias(k) for k, c in columns.items()],
    )


def by_shard(df: DataFrame, n: int, answer: Callable, schema: str) -> DataFrame:
    """``answer`` over the rows of each shard (column ``shard``, 0 to n - 1), a shard a task."""

    def whole(batches: Iterator) -> Iterator:
        yield from answer(batches)
        B.release()

    return df.repartitionById(n, "shard").mapInArrow(whole, schema)


def with_replies(docs: DataFrame, replies: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """``finish(key, rows, replies)`` for each block of ``docs``, with the rows of ``replies`` for that block."""
    keys = ["_f", "_b"]

    def each(key, left, right):
        out = finish(key, left, right)
        B.release()
        return out

    return docs.groupBy(*keys).cogroup(replies.groupBy(*keys)).applyInArrow(each, schema)
