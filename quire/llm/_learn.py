"""Folds and bounded samples for operators that learn from labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import _spark as S


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo ``folds``, is ``fold``; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


#: A sample of so many rows is small enough to broadcast.
SMALL = 1_000_000


def sample(rows: DataFrame, most: int, by: str | None = None) -> DataFrame:
    """All rows (with _f, _r and id) if there are at most ``most``, or ``most`` of each value of ``by``; else so many
    of them, by a hash of id and place, the same each time. The bound holds whatever the ids are, and hardly more
    rows than that meet in one place."""
    space = 1 << 40
    drawn = rows.withColumn("_h", F.pmod(F.xxhash64("id", "_r", F.lit(7)), F.lit(space)))
    part = lambda n: F.lit(space) * F.least(F.lit(1.0), (F.lit(1.1) * most + 100) / n)
    if by is None:
        n = rows.count()
        return rows if n <= most else drawn.filter(F.col("_h") < part(F.lit(n))).orderBy("_h", "_f", "_r").limit(most).drop("_h")
    counts = S.written(rows.groupBy(by).agg(F.count("*").alias("_n")), "counts")
    # rows that aren't drawn stay where they are
    near = drawn.join(F.broadcast(counts) if counts.count() <= SMALL else counts, by).filter(F.col("_h") < part(F.col("_n")))
    place = F.row_number().over(Window.partitionBy(by).orderBy("_h", "_f", "_r"))
    return near.withColumn("_n", place).filter(F.col("_n") <= most).drop("_h", "_n")


def fetched(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``rows`` (with _f, _r) at the places of ``chosen``, with its other columns."""
    chosen = S.written(chosen, "sample")
    return rows.join(F.broadcast(chosen) if chosen.count() <= SMALL else chosen, ["_f", "_r"])
