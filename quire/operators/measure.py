"""Quality and information measures as built-in aggregates. Spreads are those of whole populations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Constants of nature in SI units.
BOLTZMANN = 1.380649e-23
HBAR = 1.054571817e-34
LIGHT = 299792458.0


def mse(a: str, b: str) -> Column:
    return F.avg(F.pow(F.col(a) - F.col(b), 2))


def psnr(error: Column, peak: float, at_zero: float | None = None, least: float | None = None) -> Column:
    """Decibels of a mean squared error below the peak. A zero error gives ``at_zero`` (null if none is
    given); with ``least`` the error is held up to it instead."""
    if least is not None:
        return 10 * F.log10(peak * peak / F.greatest(error, F.lit(least)))
    return F.when(error == 0, F.lit(at_zero)).otherwise(10 * F.log10(peak * peak / error))


def snr(signal: str, decoded: str) -> Column:
    return 10 * F.log10(F.avg(F.pow(signal, 2)) / (mse(signal, decoded) + 1e-10))


def bit_accuracy(a: str, b: str) -> Column:
    """Share of equal bits of bytes."""
    return 1 - F.sum(F.bit_count(F.col(a).bitwiseXOR(F.col(b)))) / (8 * F.count("*"))


def ssim(a: str, b: str, span: float) -> Column:
    """Structural similarity over all samples at once."""
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    ma, mb = F.avg(a), F.avg(b)
    top = (2 * ma * mb + c1) * (2 * F.covar_pop(a, b) + c2)
    return top / ((ma * ma + mb * mb + c1) * (F.var_pop(a) + F.var_pop(b) + c2))


def windowed_ssim(df: DataFrame, keys: list[str], side: int = 7, span: float = 1.0) -> DataFrame:
    """Mean over all side x side windows inside a block (keys, i, j, a, b), with sample covariances."""
    ends = df.groupBy(*keys).agg(F.max("i").alias("_mi"), F.max("j").alias("_mj"))
    spread = df.join(ends, keys)
    steps = lambda c, top: F.explode(F.sequence(F.greatest(F.lit(0), F.col(c) - side + 1), F.least(F.col(c), F.col(top) - side + 1)))
    spread = spread.filter((F.col("_mi") >= side - 1) & (F.col("_mj") >= side - 1)).withColumn("wi", steps("i", "_mi")).withColumn("wj", steps("j", "_mj"))
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    ma, mb = F.avg("a"), F.avg("b")
    per = spread.groupBy(*keys, "wi", "wj").agg(((2 * ma * mb + c1) * (2 * F.covar_samp("a", "b") + c2) / ((ma * ma + mb * mb + c1) * (F.var_samp("a") + F.var_samp("b") + c2))).alias("s"))
    return per.groupBy(*keys).agg(F.avg("s").alias("ssim"))


def entropy(df: DataFrame, keys: list[str], symbol: str) -> DataFrame:
    """keys, n (symbols), bits (bits a symbol): Shannon entropy of each group's symbols."""
    counts = df.groupBy(*keys, symbol).agg(F.count("*").alias("_c"))
    shares = counts.withColumn("_p", F.col("_c") / F.sum("_c").over(Window.partitionBy(*keys)))
    return shares.groupBy(*keys).agg(F.sum("_c").alias("n"), (-F.sum(F.col("_p") * F.log2("_p"))).alias("bits"))


def text_bytes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, byte, n: how often each byte occurs in each text; counted by UTF-8 bytes of its distinct characters."""
    chars = df.select(id_col, F.explode(F.split(F.col(text_col), "")).alias("_ch")).filter("_ch <> ''").groupBy(id_col, "_ch").agg(F.count("*").alias("_c"))
    hexes = chars.withColumn("_h", F.hex(F.encode("_ch", "UTF-8")))
    pairs = F.transform(F.sequence(F.lit(1), F.length("_h"), F.lit(2)), lambda k: F.conv(F.substr(F.col("_h"), k, F.lit(2)), 16, 10).cast("int"))
    return hexes.select(id_col, "_c", F.explode(pairs).alias("byte")).groupBy(id_col, "byte").agg(F.sum("_c").alias("n"))


def landauer(bits: Column, kelvin: float = 300.0) -> Column:
    """Least energy in joules to erase so many bits."""
    return bits * (BOLTZMANN * kelvin * math.log(2))


def operations_limit(joules: Column) -> Column:
    """Most operations a second of a system of this energy."""
    return 2 * joules / (math.pi * HBAR)


def rate_bound(variance: Column, distortion: Column) -> Column:
    """Bits a sample that a Gaussian source needs at this distortion."""
    return F.when(distortion >= variance, 0.0).otherwise(0.5 * F.log2(variance / distortion))


def leading_zero_bits(digest: Column) -> Column:
    """Zero bits before the first one of a hexadecimal digest."""
    zeros = F.length(F.regexp_extract(digest, "^(0*)", 1))
    digit = F.conv(F.substr(digest, zeros + 1, F.lit(1)), 16, 10).cast("int")
    return 4 * zeros + F.when(digit >= 8, 0).when(digit >= 4, 1).when(digit >= 2, 2).when(digit >= 1, 3).otherwise(0)
