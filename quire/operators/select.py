"""Choosing among candidates: smallest, closest, undominated, best by several measures. Ties go to the first candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.corpus import written


def image_kind(colours: Column, roughness: Column) -> Column:
    return F.when(colours <= 256, "palette").when(roughness < 5, "smooth").when(roughness < 15, "mixed").otherwise("photo")


def smallest(df: DataFrame, by: list[str], size: str = "size", pos: str = "pos", name: str = "name") -> DataFrame:
    """The candidate of least size; the least position on ties."""
    return df.groupBy(*by).agg(F.min_by(F.struct(name, size), F.struct(size, pos)).alias("_b")).select(*by, "_b.*")


def closest(df: DataFrame, by: list[str], size: str, target: str) -> DataFrame:
    gap = F.abs(F.col(size) - F.col(target))
    return df.groupBy(*by).agg(F.min_by(F.struct("name", size), F.struct(gap, "pos")).alias("_b")).select(*by, "_b.*")


def pareto(df: DataFrame, key: str, less: list[str], more: list[str]) -> DataFrame:
    """Rows that no row dominates: none is as good in all measures and better in one.

    The first measure orders the rows: only rows with a smaller or equal value can dominate, and of these
    only the best by group matter, so a first pass keeps undominated rows of each of many parts, which are
    far fewer, and the second compares those.
    """

    def undominated(x: DataFrame, on: Column | None) -> DataFrame:
        other = x.select(*[F.col(c).alias(f"_{c}") for c in x.columns])
        as_good = [F.col(f"_{c}") <= F.col(c) for c in less] + [F.col(f"_{c}") >= F.col(c) for c in more]
        better = [F.col(f"_{c}") < F.col(c) for c in less] + [F.col(f"_{c}") > F.col(c) for c in more]
        cond = on if on is not None else F.lit(True)
        for c in as_good:
            cond &= c
        some = better[0]
        for c in better[1:]:
            some |= c
        return x.join(other, cond & some, "left_anti")

    parts = df.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(64)))
    first = undominated(parts, F.col("__part") == F.col("_part"))
    return undominated(first.drop("_part"), None)


def balanced(df: DataFrame, by: list[str], axes: dict[str, bool]) -> DataFrame:
    """``score``: the sum of the axes scaled to 0..1 over each ``by``; True where more is better."""
    w = Window.partitionBy(*by)
    total = F.lit(0.0)
    for c, more in axes.items():
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        part = F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.0)
        total = total + (part if more else 1 - part)
    return df.withColumn("score", total)


def strided(df: DataFrame, order: str, k: int) -> DataFrame:
    """k rows at even steps of the order, both ends included: places floor(m * (n - 1) / (k - 1)).

    Rows are numbered within ranges of the order; only the ranges' sizes meet in one place.
    """
    n = df.count()
    spark = df.sparkSession
    places = spark.range(k).select(F.floor(F.col("id") * (n - 1) / max(1, k - 1)).cast("long").alias("place")).distinct()
    # written, as ranges that are worked out twice may differ
    ranged = written(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    return numbered(ranged, order).join(F.broadcast(places), "place").drop("_range")


def numbered(ranged: DataFrame, order: str) -> DataFrame:
    """``place`` from 0 on, of rows dealt to ascending ranges ``_range``."""
    before = ranged.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return ranged.withColumn("_own", own).join(F.broadcast(before.select("_range", "_before")), "_range").withColumn("place", F.col("_own") + F.col("_before")).drop("_own", "_before")
