"""Symbol coding: zigzag run lengths, palettes, text patterns, file kinds, codebooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zigzag(spark, n: int = 8) -> DataFrame:
    """k, i, j: the diagonal scan of an n x n block, by rule: diagonals in turn, each the other way than the last."""
    d = F.col("i") + F.col("j")
    grid = spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j"))
    along = F.when(d % 2 == 0, F.col("j")).otherwise(F.col("i"))
    return F.broadcast(grid.withColumn("k", (F.row_number().over(Window.orderBy(d, along)) - 1).cast("int")).select("k", "i", "j"))


def run_lengths(df: DataFrame, keys: list[str], size: int = 64) -> DataFrame:
    """(run, value) pairs of sequences (keys, k, q) in order of ``ord``: zeroes before each value, (15, 0) for
    sixteen zeroes in a row, (0, 0) at the end if zeroes follow the last value."""
    w = Window.partitionBy(*keys).orderBy("k")
    some = df.filter("q <> 0").withColumn("gap", F.col("k") - F.lag("k", 1, -1).over(w) - 1)
    long = F.transform(F.sequence(F.lit(1), F.floor(F.col("gap") / 16).cast("int")), lambda z: F.struct(F.lit(15).alias("run"), F.lit(0).alias("value")))
    pairs = F.concat(F.when(F.col("gap") >= 16, long).otherwise(F.expr("CAST(array() AS array<struct<run:int,value:int>>)")), F.array(F.struct((F.col("gap") % 16).cast("int").alias("run"), F.col("q").cast("int").alias("value"))))
    values = some.select(*keys, F.col("k").cast("int").alias("k"), F.posexplode(pairs).alias("sub", "_p")).select(*keys, "k", "sub", "_p.*")
    last = df.groupBy(*keys).agg(F.max(F.when(F.col("q") != 0, F.col("k"))).alias("_last")).filter(F.coalesce("_last", F.lit(-1)) < size - 1)
    end = last.select(*keys, F.lit(size).alias("k"), F.lit(0).alias("sub"), F.lit(0).alias("run"), F.lit(0).alias("value"))
    return values.unionByName(end).withColumn("ord", (F.row_number().over(Window.partitionBy(*keys).orderBy("k", "sub")) - 1).cast("int")).drop("k", "sub")


def unrun_lengths(df: DataFrame, keys: list[str], size: int = 64) -> DataFrame:
    """The inverse: keys, k, q for all places."""
    w = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    end = (F.col("run") == 0) & (F.col("value") == 0)
    placed = df.withColumn("k", F.sum(F.when(end, 0).otherwise(F.col("run") + 1)).over(w) - 1).filter(~end & (F.col("value") != 0)).select(*keys, F.col("k").cast("int").alias("k"), F.col("value").alias("q"))
    every = df.select(*keys).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return every.join(placed, [*keys, "k"], "left").withColumn("q", F.coalesce("q", F.lit(0)))


def colours(df: DataFrame, keys: list[str], rgb: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Number of distinct colours of each image, and whether a palette of 256 holds them."""
    return df.groupBy(*keys).agg(F.count_distinct(*rgb).alias("colours")).withColumn("palette", F.col("colours") <= 256)


def palette(df: DataFrame, keys: list[str], rgb: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """idx: the place of each pixel's colour among the image's distinct colours in ascending order.

    Distinct colours are numbered apart and joined back, so an image's pixels aren't sorted in one task.
    """
    table = df.select(*keys, *rgb).distinct().withColumn("idx", (F.row_number().over(Window.partitionBy(*keys).orderBy(*rgb)) - 1).cast("int"))
    return df.join(table, [*keys, *rgb])


def log_template(line: Column) -> tuple[Column, Column]:
    """A line with its digit runs replaced by {}, and its numbers."""
    return F.regexp_replace(line, r"\d+", "{}"), F.regexp_extract_all(line, F.lit(r"\d+\.?\d*"), 0)


def file_kind(data: Column) -> Column:
    """Kind by leading bytes, else by content."""
    head = F.hex(F.substring(data, 1, 8))
    text = F.trim(data.cast("string"))
    return (
        F.when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("504B0304"), "zip").when(head.startswith("1F8B"), "gzip").when(head.startswith("28B52FFD"), "zstd")
        .when(F.lower(F.substring(text, 1, 9)) == "<!doctype", "html").when(text.startswith("[") & text.endswith("]"), "json").when(text.startswith("{") & text.endswith("}"), "json")
        .when(F.length(data) == 0, "empty").otherwise("text")
    )


def nearest(df: DataFrame, centroids: DataFrame, value: str) -> DataFrame:
    """c, d: the nearest of a few centroids (c, at), broadcast; ties to the smaller c."""
    held = F.broadcast(centroids.agg(F.array_sort(F.collect_list(F.struct("c", "at"))).alias("_cents")))
    best = F.array_min(F.transform("_cents", lambda x: F.struct(F.abs(F.col(value) - x.at).alias("d"), x.c.alias("c"))))
    return df.crossJoin(held).withColumn("_best", best).select(*df.columns, F.col("_best.c").alias("c"), F.col("_best.d").alias("d"))
