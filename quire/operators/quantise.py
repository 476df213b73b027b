"""Quantisers, pruning and bit packing. Scales are windows or joins over the tensor (``by``); rounding is half to even."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The JPEG luminance and chrominance tables, row by row.
LUMA_Q = (16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99)
CHROMA_Q = (17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99)


def quality_scale(quality: Column) -> Column:
    """Multiplier of the tables: 0.5 at quality 1, growing by 20 for each unit below."""
    return F.when(quality >= 1, 0.5).otherwise(0.5 + (1 - quality) * 20)


def q_table(spark, chroma: bool = False) -> DataFrame:
    """i, j, q of a JPEG table."""
    table = F.array(*map(F.lit, CHROMA_Q if chroma else LUMA_Q))
    return F.broadcast(spark.range(64).select(F.floor(F.col("id") / 8).cast("int").alias("i"), (F.col("id") % 8).cast("int").alias("j"), F.get(table, F.col("id").cast("int")).alias("q")))


def q_cube(spark, n: int, scale: float) -> DataFrame:
    """z, y, x, q: steps that grow with the sum of the three frequencies."""
    k = F.col("id")
    cube = spark.range(n**3).select(F.floor(k / (n * n)).cast("int").alias("z"), (F.floor(k / n) % n).cast("int").alias("y"), (k % n).cast("int").alias("x"))
    return F.broadcast(cube.withColumn("q", F.greatest(F.lit(1.0), (1 + 2 * (F.col("z") + F.col("y") + F.col("x"))) * scale / 100)))


def quantised(coeff: DataFrame, table: DataFrame, on: list[str], scale: float) -> DataFrame:
    """``q`` = coefficient over max(table value times scale, 1), and ``back``, its reconstruction."""
    step = F.greatest(F.col("_q") * scale, F.lit(1.0))
    joined = coeff.join(table.withColumnRenamed("q", "_q"), on)
    return joined.withColumn("q", F.rint(F.col("v") / step).cast("int")).withColumn("back", F.col("q") * step).drop("_q")


def _top(df: DataFrame, by: list[str]) -> DataFrame:
    return df.join(df.groupBy(*by).agg(F.max(F.abs("w")).alias("_top")), by)


def symmetric(df: DataFrame, by: list[str], levels: int) -> DataFrame:
    """Integers in -levels..levels by the largest absolute weight of each tensor: q, scale, back. A zero tensor has scale 1."""
    scaled = _top(df, by).withColumn("scale", F.when(F.col("_top") > 0, F.col("_top") / levels).otherwise(1.0))
    q = F.least(F.greatest(F.rint(F.col("w") / F.col("scale")), F.lit(float(-levels))), F.lit(float(levels))).cast("int")
    return scaled.withColumn("q", q).withColumn("back", F.col("q") * F.col("scale")).drop("_top")


def minmax(df: DataFrame, by: list[str], bits: int) -> DataFrame:
    """Affine integers in 0..2**bits - 1 between the least and largest weight: q, back."""
    ends = df.groupBy(*by).agg(F.min("w").alias("_lo"), F.max("w").alias("_hi"))
    step = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / (2**bits - 1)).otherwise(1.0)
    return df.join(ends, by).withColumn("q", F.rint((F.col("w") - F.col("_lo")) / step).cast("int")).withColumn("back", F.col("_lo") + F.col("q") * step).drop("_lo", "_hi")


def packed_nibbles(df: DataFrame, keys: list[str], low_first: bool = True) -> DataFrame:
    """Bytes of two 4-bit values each, from q + 8 at neighbouring places n; a missing last one counts as 0."""
    nibble = F.col("q") + 8
    even, odd = F.sum(F.when(F.col("n") % 2 == 0, nibble)), F.coalesce(F.sum(F.when(F.col("n") % 2 == 1, nibble)), F.lit(0))
    lo, hi = (even, odd) if low_first else (odd, even)
    return df.groupBy(*keys, F.floor(F.col("n") / 2).cast("int").alias("pos")).agg(lo.bitwiseOR(F.shiftleft(hi, 4)).cast("int").alias("byte"))


def unpacked_nibbles(df: DataFrame, keys: list[str], low_first: bool = True) -> DataFrame:
    low, high = F.col("byte").bitwiseAND(15) - 8, F.shiftright("byte", 4) - 8
    first, second = (low, high) if low_first else (high, low)
    both = F.array(F.struct((F.col("pos") * 2).alias("n"), first.alias("q")), F.struct((F.col("pos") * 2 + 1).alias("n"), second.alias("q")))
    return df.select(*keys, F.explode(both).alias("_p")).select(*keys, "_p.*")


def coded_bytes(n: Column, bits: int, header: int = 8) -> Column:
    return F.floor((n * bits + 7) / 8).cast("long") + header


def pruned_relative(df: DataFrame, by: list[str], share: float) -> DataFrame:
    return _top(df, by).withColumn("kept", F.when(F.abs("w") < F.col("_top") * share, 0.0).otherwise(F.col("w"))).drop("_top")


def pruned_absolute(df: DataFrame, threshold: float) -> DataFrame:
    return df.withColumn("kept", F.when(F.abs("w") < threshold, 0.0).otherwise(F.col("w")))


def pruned_share(df: DataFrame, by: list[str], sparsity: float) -> DataFrame:
    """Zero below the exact percentile (linear interpolation) of the absolute weights."""
    cut = df.groupBy(*by).agg(F.percentile(F.abs("w"), sparsity).alias("_cut"))
    return df.join(cut, by).withColumn("kept", F.when(F.abs("w") < F.col("_cut"), 0.0).otherwise(F.col("w"))).drop("_cut")


def strongest_rows(df: DataFrame, by: list[str], row: str, k: int) -> DataFrame:
    """The k rows of each tensor with the largest L2 norm (ties: the smaller row), renumbered in order of row."""
    norms = df.groupBy(*by, row).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.round("norm", 9).desc(), row))
    top = norms.withColumn("rank", rank).filter(F.col("rank") <= k)
    return top.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(row)) - 1)


def soft_threshold(x: Column, t: float) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - t, F.lit(0.0))


def ternary(df: DataFrame, by: list[str], t: float) -> DataFrame:
    """0 below t times the largest absolute weight, else the weight's sign times the largest."""
    return _top(df, by).withColumn("kept", F.when(F.abs("w") < F.col("_top") * t, 0.0).otherwise(F.signum("w") * F.col("_top"))).drop("_top")


def phase_byte(phi: Column) -> Column:
    import math

    return F.rint((phi + math.pi) / (2 * math.pi) * 255).cast("int")


def blend(a: str, b: str, share: float) -> Column:
    """a + share * (b - a) of two arrays."""
    return F.zip_with(a, b, lambda x, y: x + share * (y - x))
