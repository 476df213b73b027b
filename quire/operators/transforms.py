"""Colour, block, wavelet, frame and predictive transforms as joins with small tables, aggregates and windows.

A block is a set of rows (keys..., i, j, v); a table of basis functions has a fixed size and is broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators.signals import clip_byte

# BT.601 full range, as the weights of red, green and blue, and of blue and red differences.
LUMA = (0.299, 0.587, 0.114)
CB = (-0.168736, -0.331264, 0.5)
CR = (0.5, -0.418688, -0.081312)
TO_RED, TO_GREEN, TO_BLUE = 1.402, (-0.344136, -0.714136), 1.772


def ycbcr(df: DataFrame, r: str = "r", g: str = "g", b: str = "b") -> DataFrame:
    mixed = lambda w, add: F.col(r) * w[0] + F.col(g) * w[1] + F.col(b) * w[2] + add
    return df.withColumn("y", mixed(LUMA, 0.0)).withColumn("cb", mixed(CB, 128.0)).withColumn("cr", mixed(CR, 128.0))


def rgb(df: DataFrame) -> DataFrame:
    """The inverse of ``ycbcr``: rr, gg, bb, rounded half to even and held to 0..255."""
    cb, cr = F.col("cb") - 128.0, F.col("cr") - 128.0
    return df.withColumn("rr", clip_byte(F.col("y") + cr * TO_RED)).withColumn("gg", clip_byte(F.col("y") + cb * TO_GREEN[0] + cr * TO_GREEN[1])).withColumn("bb", clip_byte(F.col("y") + cb * TO_BLUE))


def subsample(df: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    """Every second row and column."""
    return df.filter((F.col(i) % 2 == 0) & (F.col(j) % 2 == 0))


def upsample(small: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Values of ``small`` (keys, i, j, v), which holds even rows and columns, for every place of ``grid`` (keys, i, j)."""
    half = small.select(*keys, (F.col("i") / 2).cast("int").alias("_i"), (F.col("j") / 2).cast("int").alias("_j"), "v")
    return grid.withColumn("_i", F.floor(F.col("i") / 2).cast("int")).withColumn("_j", F.floor(F.col("j") / 2).cast("int")).join(half, [*keys, "_i", "_j"]).drop("_i", "_j")


def dct_basis(spark: SparkSession, n: int = 8) -> DataFrame:
    """u, x, w: the orthonormal DCT-II of n points."""
    grid = spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("u"), (F.col("id") % n).cast("int").alias("x"))
    scale = F.when(F.col("u") == 0, math.sqrt(1 / n)).otherwise(math.sqrt(2 / n))
    return F.broadcast(grid.withColumn("w", scale * F.cos((2 * F.col("x") + 1) * F.col("u") * F.lit(math.pi) / (2 * n))))


def _pass(df: DataFrame, basis: DataFrame, keys: list[str], axis: str, inverse: bool) -> DataFrame:
    """One separable pass: ``axis`` runs over samples before and over coefficients after (or the other way)."""
    a, b = ("u", "x") if inverse else ("x", "u")
    joined = df.join(basis.select(F.col(a).alias(axis), F.col(b).alias("_new"), "w"), axis)
    return joined.groupBy(*keys, F.col("_new").alias(axis)).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def dct(df: DataFrame, keys: list[str], axes: tuple[str, ...] = ("i", "j"), n: int = 8, inverse: bool = False) -> DataFrame:
    """The DCT-II (or its inverse) of blocks (keys, axes, v), axis by axis: n products a sample and axis."""
    basis = dct_basis(df.sparkSession, n)
    for axis in axes:
        df = _pass(df, basis, [*keys, *(x for x in axes if x != axis)], axis, inverse)
    return df


def dct_array(v: Column, n: int = 8) -> Column:
    """The 2-D DCT-II of a block held as one array of n * n values: no shuffle, for blocks that are rows already."""
    w = [[(math.sqrt(1 / n) if u == 0 else math.sqrt(2 / n)) * math.cos((2 * x + 1) * u * math.pi / (2 * n)) for x in range(n)] for u in range(n)]
    basis = F.array(*[F.array(*map(F.lit, row)) for row in w])
    dot = lambda row, pick: F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda acc, x: acc + F.get(row, x) * pick(x))
    rows = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.transform(basis, lambda row: dot(row, lambda x: F.get(v, i * n + x)))))
    return F.transform(F.array(rows), lambda r: F.flatten(F.transform(basis, lambda row: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: dot(row, lambda x: F.get(r, x * n + j))))))[0]


def haar(df: DataFrame, keys: list[str], axis: str) -> DataFrame:
    """One orthonormal Haar level along an axis: band 'a' (sums) and 'd' (differences) at half the places."""
    pair = df.groupBy(*keys, F.floor(F.col(axis) / 2).cast("int").alias(axis)).agg(F.sum(F.when(F.col(axis) % 2 == 0, F.col("v"))).alias("even"), F.sum(F.when(F.col(axis) % 2 == 1, F.col("v"))).alias("odd"))
    return pair.select(*keys, axis, ((F.col("even") + F.col("odd")) / math.sqrt(2)).alias("a"), ((F.col("even") - F.col("odd")) / math.sqrt(2)).alias("d"))


def unhaar(df: DataFrame, keys: list[str], axis: str) -> DataFrame:
    both = F.array(F.struct((F.col(axis) * 2).alias(axis), ((F.col("a") + F.col("d")) / math.sqrt(2)).alias("v")), F.struct((F.col(axis) * 2 + 1).alias(axis), ((F.col("a") - F.col("d")) / math.sqrt(2)).alias("v")))
    return df.select(*keys, F.explode(both).alias("_p")).select(*keys, "_p.*")


def integer_haar(df: DataFrame, keys: list[str], axis: str) -> DataFrame:
    """The S-transform: lossless Haar of integers, a = floor((even + odd) / 2), d = even - odd."""
    pair = df.groupBy(*keys, F.floor(F.col(axis) / 2).cast("int").alias(axis)).agg(F.sum(F.when(F.col(axis) % 2 == 0, F.col("v"))).alias("even"), F.sum(F.when(F.col(axis) % 2 == 1, F.col("v"))).alias("odd"))
    return pair.select(*keys, axis, F.floor((F.col("even") + F.col("odd")) / 2).cast("long").alias("a"), (F.col("even") - F.col("odd")).alias("d"))


def integer_unhaar(df: DataFrame, keys: list[str], axis: str) -> DataFrame:
    even = F.col("a") + F.floor((F.col("d") + 1) / 2).cast("long")
    both = F.array(F.struct((F.col(axis) * 2).alias(axis), even.alias("v")), F.struct((F.col(axis) * 2 + 1).alias(axis), (even - F.col("d")).alias("v")))
    return df.select(*keys, F.explode(both).alias("_p")).select(*keys, "_p.*")


def stft(df: DataFrame, keys: list[str], size: int, hop: int) -> DataFrame:
    """Frames of ``size`` samples every ``hop`` under a Hann window: keys, frame, f, re, im. Only whole frames count.

    A sample goes to the few frames that hold it; each frame meets a broadcast Fourier table.
    """
    last = df.groupBy(*keys).agg((F.max("n") + 1).alias("_len"))
    per = df.join(last, keys).withColumn("frame", F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("n") - size + 1) / hop)).cast("int"), F.floor(F.col("n") / hop).cast("int")))).filter(F.col("frame") * hop + size <= F.col("_len"))
    per = per.withColumn("m", F.col("n") - F.col("frame") * hop)
    bins = size // 2 + 1
    table = df.sparkSession.range(bins * size).select(F.floor(F.col("id") / size).cast("int").alias("f"), (F.col("id") % size).cast("int").alias("m"))
    window = 0.5 - 0.5 * F.cos(2 * F.lit(math.pi) * F.col("m") / size)
    angle = -2 * F.lit(math.pi) * F.col("f") * F.col("m") / size
    table = F.broadcast(table.select("f", "m", (window * F.cos(angle)).alias("c"), (window * F.sin(angle)).alias("s")))
    return per.join(table, "m").groupBy(*keys, "frame", "f").agg(F.sum(F.col("v") * F.col("c")).alias("re"), F.sum(F.col("v") * F.col("s")).alias("im"))


def neighbours(df: DataFrame, keys: list[str], i: str = "i", j: str = "j", v: str = "v") -> DataFrame:
    """left, up and upleft of every value; 0 beyond the edge."""
    row, col, diag = Window.partitionBy(*keys, i).orderBy(j), Window.partitionBy(*keys, j).orderBy(i), Window.partitionBy(*keys, F.col(i) - F.col(j)).orderBy(i)
    return df.withColumn("left", F.lag(v, 1, 0).over(row)).withColumn("up", F.lag(v, 1, 0).over(col)).withColumn("upleft", F.lag(v, 1, 0).over(diag))


def paeth(a: Column, b: Column, c: Column) -> Column:
    """Nearest to a + b - c of left, up and upleft; ties in this order."""
    pa, pb, pc = F.abs(b - c), F.abs(a - c), F.abs(a + b - 2 * c)
    return F.when((pa <= pb) & (pa <= pc), a).when(pb <= pc, b).otherwise(c)


FILTERS = ("none", "sub", "up", "avg", "paeth")


def filtered(df: DataFrame, kind: str, keys: list[str], v: str = "v") -> DataFrame:
    """Residual modulo 256 of a PNG-style predictor, as ``f``."""
    if kind not in FILTERS:
        raise ValueError(f"filter is one of {FILTERS}")
    near = neighbours(df, keys, v=v)
    a, b, c = F.col("left"), F.col("up"), F.col("upleft")
    guess = {"none": F.lit(0), "sub": a, "up": b, "avg": F.floor((a + b) / 2), "paeth": paeth(a, b, c)}[kind]
    return near.withColumn("f", F.pmod(F.col(v) - guess, F.lit(256)).cast("int")).drop("left", "up", "upleft")


def unfiltered(df: DataFrame, kind: str, keys: list[str], f: str = "f") -> DataFrame:
    """The inverse of ``filtered`` as ``v``: sums along an axis for none, sub and up; in order, block by block, for the others."""
    if kind == "none":
        return df.withColumn("v", F.col(f))
    if kind in ("sub", "up"):
        over = Window.partitionBy(*keys, "i").orderBy("j") if kind == "sub" else Window.partitionBy(*keys, "j").orderBy("i")
        return df.withColumn("v", F.pmod(F.sum(f).over(over.rowsBetween(Window.unboundedPreceding, 0)), F.lit(256)).cast("int"))
    import numpy as np
    import pandas as pd

    def undo(part: pd.DataFrame) -> pd.DataFrame:
        rows, cols = part["i"].max() + 1, part["j"].max() + 1
        out = np.zeros((rows + 1, cols + 1), np.int64)
        res = np.zeros((rows, cols), np.int64)
        res[part["i"], part["j"]] = part[f]
        for y in range(rows):
            for x in range(cols):
                a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
                if kind == "avg":
                    guess = (a + b) // 2
                else:
                    guess = min(((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c)))[2]
                out[y + 1, x + 1] = (res[y, x] + guess) % 256
        return part.assign(v=out[part["i"] + 1, part["j"] + 1].astype("int32"))

    schema = f"{', '.join(f'`{x.name}` {x.dataType.simpleString()}' for x in df.schema)}, v int"
    return df.groupBy(*keys).applyInPandas(undo, schema)


def block_mean(df: DataFrame, keys: list[str], f: int, side: int) -> DataFrame:
    """Mean of every f x f tile of a side x side block; a remainder at the edge is dropped."""
    whole = side // f * f
    return df.filter((F.col("i") < whole) & (F.col("j") < whole)).groupBy(*keys, F.floor(F.col("i") / f).cast("int").alias("i"), F.floor(F.col("j") / f).cast("int").alias("j")).agg(F.avg("v").alias("v"))


def resized(df: DataFrame, keys: list[str], side: int, to: int) -> DataFrame:
    """Nearest-index resampling to to x to: new place k reads floor(k * (side - 1) / (to - 1))."""
    place = df.sparkSession.range(to).select(F.col("id").cast("int").alias("k"), F.floor(F.col("id") * (side - 1) / max(1, to - 1)).cast("int").alias("at"))
    rows = F.broadcast(place.select(F.col("k").alias("ni"), F.col("at").alias("i")))
    cols = F.broadcast(place.select(F.col("k").alias("nj"), F.col("at").alias("j")))
    return df.join(rows, "i").join(cols, "j").select(*keys, F.col("ni").alias("i"), F.col("nj").alias("j"), "v")


def laplacian_variance(df: DataFrame, keys: list[str]) -> DataFrame:
    """Population variance of the 5-point Laplacian over inner places."""
    row, col = Window.partitionBy(*keys, "i").orderBy("j"), Window.partitionBy(*keys, "j").orderBy("i")
    lap = F.lag("v").over(row) + F.lead("v").over(row) + F.lag("v").over(col) + F.lead("v").over(col) - 4 * F.col("v")
    return df.withColumn("lap", lap).filter("lap IS NOT NULL").groupBy(*keys).agg(F.var_pop("lap").alias("lap_var"))


def edge_weights(df: DataFrame, keys: list[str], low: float = 0.5, high: float = 3.0) -> DataFrame:
    """Sobel magnitude over inner places, scaled from 0..largest to low..high, as ``weight``."""
    near = df.alias("a")
    for di in (-1, 0, 1):
        for dj in (-1, 0, 1):
            other = df.select(*keys, (F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("v").alias(f"v{di + 1}{dj + 1}"))
            near = near.join(other, [*keys, "i", "j"])
    gx = F.expr("(v02 + 2 * v12 + v22) - (v00 + 2 * v10 + v20)")
    gy = F.expr("(v20 + 2 * v21 + v22) - (v00 + 2 * v01 + v02)")
    mag = near.withColumn("mag", F.sqrt(gx * gx + gy * gy))
    top = mag.groupBy(*keys).agg(F.max("mag").alias("_top"))
    return mag.join(top, keys).select(*keys, "i", "j", (low + (high - low) * F.col("mag") / F.greatest(F.col("_top"), F.lit(1e-12))).alias("weight"))


def patch_variance(df: DataFrame, keys: list[str], patch: int, threshold: float) -> DataFrame:
    """Population variance of every patch, and whether it is below the threshold (smooth)."""
    return df.groupBy(*keys, F.floor(F.col("i") / patch).cast("int").alias("pi"), F.floor(F.col("j") / patch).cast("int").alias("pj")).agg(F.var_pop("v").alias("var")).withColumn("smooth", F.col("var") < threshold)


def grid(spark: SparkSession, n: int, lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    """i, j and their coordinates y, x, evenly spaced with both ends."""
    at = lambda k: F.lit(lo) + F.col(k) * ((hi - lo) / (n - 1))
    return spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j")).withColumn("y", at("i")).withColumn("x", at("j"))
