"""Adapters: the standard tables as signals in long form (see FIXTURES.md for the schemas)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_cells(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, label, n and v (double) of every element."""
    return vectors.select(F.col(id_col), "label", F.posexplode(vec_col).alias("n", "v")).withColumn("v", F.col("v").cast("double"))


def blocks(vectors: DataFrame, side: int = 8) -> DataFrame:
    """Vectors as square blocks: blk, i (row), j (column), v."""
    return vector_cells(vectors).select(F.col("vec_id").alias("blk"), F.floor(F.col("n") / side).cast("int").alias("i"), (F.col("n") % side).alias("j"), "v")


def byte_plane(cells: DataFrame, value: str = "v", by: list[str] | None = None) -> DataFrame:
    """``cells`` with ``u8``: the value scaled from its least and largest (in each ``by``) to 0..255, rounded half to even."""
    ends = cells.groupBy(*(by or [])).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    joined = cells.crossJoin(F.broadcast(ends)) if not by else cells.join(ends, by)
    return joined.withColumn("u8", F.rint((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255).cast("int")).drop("_lo", "_hi")


def line_pixels(lineitem: DataFrame) -> DataFrame:
    """Order lines as RGB pixels: k (order key), n (line), r, g, b in 0..255."""
    return lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.pmod("l_partkey", F.lit(256)).cast("int").alias("r"), F.pmod("l_suppkey", F.lit(256)).cast("int").alias("g"), F.col("l_quantity").cast("int").alias("b"))


def clip_byte(x: Column) -> Column:
    """Rounded half to even and held to 0..255."""
    return F.least(F.greatest(F.rint(x), F.lit(0.0)), F.lit(255.0)).cast("int")
