"""Whole encoders and decoders: images in long form to recipes and back.

Images are pixels (img, i, j, r, g, b) with sides that are multiples of 16. A recipe is a row with its payload.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.codecs import compressed, decompressed
from quire.operators import coding as C
from quire.operators import quantise as Q
from quire.operators import transforms as T


def packed_ints(values: Column, kind: str = "<i2") -> Column:
    """An array of integers as bytes."""
    return F.pandas_udf(lambda s: s.map(lambda x: np.asarray(x).astype(kind).tobytes()), "binary")(values)


def unpacked_ints(data: Column, kind: str = "<i2") -> Column:
    def each(s: pd.Series) -> pd.Series:
        return s.map(lambda b: np.frombuffer(b, kind).astype("int32"))

    return F.pandas_udf(each, "array<int>")(data)


def _planes(pixels: DataFrame) -> DataFrame:
    """img, ch (0 luma, 1 and 2 chroma at half the sides), i, j, v."""
    y = T.ycbcr(pixels)
    luma = y.select("img", F.lit(0).alias("ch"), "i", "j", F.col("y").alias("v"))
    for ch, c in ((1, "cb"), (2, "cr")):
        half = T.subsample(y).select("img", F.lit(ch).alias("ch"), F.floor(F.col("i") / 2).cast("int").alias("i"), F.floor(F.col("j") / 2).cast("int").alias("j"), F.col(c).alias("v"))
        luma = luma.unionByName(half)
    return luma


def _tables(spark) -> DataFrame:
    luma = Q.q_table(spark).withColumn("chroma", F.lit(False))
    return F.broadcast(luma.unionByName(Q.q_table(spark, chroma=True).withColumn("chroma", F.lit(True))))


def dct_encode(pixels: DataFrame, quality: float) -> DataFrame:
    """A lossy recipe for each image: img, codec, quality, h, w, payload (16-bit coefficients in zigzag order, compressed)."""
    spark = pixels.sparkSession
    scale = 0.5 if quality >= 1 else 0.5 + (1 - quality) * 20
    sides = pixels.groupBy("img").agg((F.max("i") + 1).alias("h"), (F.max("j") + 1).alias("w"))
    cells = _planes(pixels).select("img", "ch", F.floor(F.col("i") / 8).cast("int").alias("bi"), F.floor(F.col("j") / 8).cast("int").alias("bj"), (F.col("i") % 8).alias("i"), (F.col("j") % 8).alias("j"), (F.col("v") - 128).alias("v"))
    keys = ["img", "ch", "bi", "bj"]
    q = Q.quantised(T.dct(cells, keys).withColumn("chroma", F.col("ch") > 0), _tables(spark), ["chroma", "i", "j"], scale)
    placed = q.join(C.zigzag(spark), ["i", "j"])
    rows = placed.groupBy("img").agg(F.transform(F.array_sort(F.collect_list(F.struct("ch", "bi", "bj", "k", "q"))), lambda x: x.q).alias("qs"))
    return rows.join(sides, "img").select("img", F.lit("dct").alias("codec"), F.lit(quality).alias("quality"), "h", "w", compressed(packed_ints(F.col("qs")), "zlib").alias("payload"))


def dct_decode(recipes: DataFrame) -> DataFrame:
    """Pixels (img, i, j, r, g, b) of recipes of ``dct_encode``."""
    spark = recipes.sparkSession
    at = F.col("at")
    n, half = F.col("h") * F.col("w"), F.floor(F.col("h") / 2) * F.floor(F.col("w") / 2)
    flat = recipes.select("img", "h", "w", "quality", F.posexplode(unpacked_ints(decompressed(F.col("payload"), "zlib"))).alias("at", "q"))
    flat = flat.withColumn("ch", F.when(at < n, 0).when(at < n + half, 1).otherwise(2)).withColumn("off", at - F.when(at < n, 0).when(at < n + half, n).otherwise(n + half))
    across = F.when(F.col("ch") == 0, F.col("w")).otherwise(F.floor(F.col("w") / 2)) / 8
    block = F.floor(F.col("off") / 64)
    flat = flat.withColumn("k", (F.col("off") % 64).cast("int")).withColumn("bi", F.floor(block / across).cast("int")).withColumn("bj", (block - F.floor(block / across) * across).cast("int"))
    scale = F.when(F.col("quality") >= 1, 0.5).otherwise(0.5 + (1 - F.col("quality")) * 20)
    tables = _tables(spark).withColumnRenamed("q", "_step")
    coeff = flat.join(C.zigzag(spark), "k").withColumn("chroma", F.col("ch") > 0).join(tables, ["chroma", "i", "j"]).withColumn("v", F.col("q") * F.greatest(F.col("_step") * scale, F.lit(1.0)))
    keys = ["img", "ch", "bi", "bj"]
    back = T.dct(coeff.select(*keys, "i", "j", "v"), keys, inverse=True)
    plane = back.select("img", "ch", (F.col("bi") * 8 + F.col("i")).alias("i"), (F.col("bj") * 8 + F.col("j")).alias("j"), (F.col("v") + 128).alias("v"))
    grid = plane.filter("ch = 0").select("img", "i", "j", F.col("v").alias("y"))
    for ch, c in ((1, "cb"), (2, "cr")):
        small = plane.filter(F.col("ch") == ch).select("img", F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("v").alias(c))
        grid = grid.withColumn("_i", F.floor(F.col("i") / 2).cast("int")).withColumn("_j", F.floor(F.col("j") / 2).cast("int")).join(small, ["img", "_i", "_j"]).drop("_i", "_j")
    return T.rgb(grid).select("img", "i", "j", F.col("rr").alias("r"), F.col("gg").alias("g"), F.col("bb").alias("b"))


def _pixel_bytes(pixels: DataFrame) -> DataFrame:
    """img, data: the pixels in row-major order as bytes."""
    rows = pixels.groupBy("img").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "r", "g", "b"))), lambda x: F.array(x.r, x.g, x.b))).alias("vs"))
    return rows.select("img", packed_ints(F.col("vs"), "u1").alias("data"))


def palette_encode(pixels: DataFrame) -> DataFrame:
    """A lossless recipe for each image with at most 256 colours: palette and index bytes; others are left out."""
    few = C.colours(pixels, ["img"]).filter("palette").select("img")
    coded = C.palette(pixels.join(few, "img"), ["img"])
    rows = coded.groupBy("img").agg(
        (F.max("i") + 1).alias("h"), (F.max("j") + 1).alias("w"), F.array_sort(F.collect_set(F.struct("idx", "r", "g", "b"))).alias("colours"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "idx"))), lambda x: x.idx).alias("vs"),
    )
    return rows.select("img", F.lit("palette").alias("codec"), "h", "w", "colours", compressed(packed_ints(F.col("vs"), "u1"), "zlib").alias("payload"))


def palette_decode(recipes: DataFrame) -> DataFrame:
    flat = recipes.select("img", "w", "colours", F.posexplode(unpacked_ints(decompressed(F.col("payload"), "zlib"), "u1")).alias("at", "idx"))
    return flat.select("img", F.floor(F.col("at") / F.col("w")).cast("int").alias("i"), (F.col("at") % F.col("w")).cast("int").alias("j"), F.get("colours", F.col("idx")).alias("c")).select("img", "i", "j", "c.r", "c.g", "c.b")


def digests(pixels: DataFrame, name: str) -> DataFrame:
    """img and the digest of its pixels."""
    return _pixel_bytes(pixels).select("img", F.sha2("data", 256).alias(name))


def auto_encode(pixels: DataFrame, lossless: bool, quality: float = 0.9) -> DataFrame:
    """img, codec, size: the palette where it holds all colours, else the lossy transform; with ``lossless`` an image
    that has too many colours is an error, never silently lossy."""
    few = palette_encode(pixels).select("img", "codec", F.octet_length("payload").alias("size"))
    rest = pixels.join(few.select("img"), "img", "left_anti")
    if lossless:
        if rest.limit(1).count():
            raise ValueError("an image has more than 256 colours and no lossless codec was asked for by name")
        return few
    return few.unionByName(dct_encode(rest, quality).select("img", "codec", F.octet_length("payload").alias("size")))


def residual_encode(cells: DataFrame, key: str, steps: int = 60) -> DataFrame:
    """A bit-exact recipe for each block of bytes (key, i, j, v): a fitted sine network's guess and the residual
    modulo 256, compressed. Coder and decoder use the guess of the same stored weights."""
    from quire.operators.models import _fit_sine

    def each(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["i", "j"])
        n = max(1, int(part["i"].max()), int(part["j"].max()))
        scaled = part.assign(y=-1 + 2 * part["i"] / n, x=-1 + 2 * part["j"] / n, v=part["v"] / 127.5 - 1)
        guess, _ = _fit_sine(scaled, 16, steps, 0.02, 7)
        model = np.clip(np.rint((guess + 1) * 127.5), 0, 255).astype(int)
        return pd.DataFrame({key: part[key], "i": part["i"], "j": part["j"], "guess": model, "res": (part["v"].to_numpy() - model) % 256})

    return cells.groupBy(key).applyInPandas(each, f"{key} {cells.schema[key].dataType.simpleString()}, i int, j int, guess int, res int")


def residual_decode(coded: DataFrame) -> DataFrame:
    return coded.withColumn("v", F.pmod(F.col("guess") + F.col("res"), F.lit(256)).cast("int")).drop("guess", "res")


def embedded(v: Column, bit: Column) -> Column:
    """A byte that carries a bit in its lowest place."""
    return v.bitwiseAND(F.lit(254)).bitwiseOR(bit.cast("int"))


def stacked(images: DataFrame) -> DataFrame:
    """Square images (img, side, i, j, v) resampled to the least side of all, by nearest index: img, i, j, v."""
    least = F.broadcast(images.agg(F.min("side").alias("to")))
    place = lambda k: F.floor(F.col(k) * (F.col("side") - 1) / F.greatest(F.lit(1), F.col("to") - 1)).cast("int")
    grid = images.select("img", "side").distinct().crossJoin(least).withColumn("ni", F.explode(F.sequence(F.lit(0), F.col("to") - 1))).withColumn("nj", F.explode(F.sequence(F.lit(0), F.col("to") - 1)))
    grid = grid.withColumn("i", place("ni")).withColumn("j", place("nj"))
    return grid.join(images.select("img", "i", "j", "v"), ["img", "i", "j"]).select("img", F.col("ni").alias("i"), F.col("nj").alias("j"), "v")


def similar_regions(patches: DataFrame, regions: DataFrame, keys: list[str], side: int = 4) -> DataFrame:
    """For each patch (keys, i, j, v) the region (region, i, j, v) of least squared error (nine digits); ties to the smaller region.
    Both are ``side`` x ``side``, and are compared as vectors, by tiles. Where any lacks a place, all are joined by place instead,
    and the error is that of the places that two have in common."""
    from quire.operators import tiles as A
    from quire.operators.corpus import written

    def whole(df: DataFrame, by: list[str]) -> DataFrame:
        cells = F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("i", "j", F.col("v").cast("double").alias("v")))))
        return df.groupBy(*by).agg(cells.alias("cells")).select(*by, F.transform("cells", lambda c: c["v"]).alias("vec"))

    of, these = written(whole(regions, ["region"]), "regions"), written(whole(patches, keys), "patches")
    lacking = F.size("vec") != side * side
    if of.filter(lacking).limit(1).count() or these.filter(lacking).limit(1).count():
        both = patches.join(regions.withColumnRenamed("v", "_w"), ["i", "j"])
        error = both.groupBy(*keys, "region").agg(F.round(F.sum(F.pow(F.col("v") - F.col("_w"), 2)), 9).alias("error"))
        return error.groupBy(*keys).agg(F.min(F.struct("error", "region")).alias("b")).select(*keys, "b.region", "b.error")
    named = written(these.withColumn("patch", F.monotonically_increasing_id()), "named")
    best = A.nearest(A.blocks(named, "patch", "vec"), A.blocks(of, "region", "vec"), 1, root=False).select(F.col("i").alias("patch"), F.col("best")[0].alias("b"))
    return named.join(best, "patch").select(*keys, F.col("b.j").alias("region"), F.col("b.d").alias("error"))


def istft(frames: DataFrame, keys: list[str], size: int, hop: int) -> DataFrame:
    """Samples (keys, n, v) from frames (keys, frame, f, re, im) of ``transforms.stft``, by weighted overlap; places
    that the windows leave at zero are left out."""
    import math

    bins = size // 2 + 1
    table = frames.sparkSession.range(bins * size).select(F.floor(F.col("id") / size).cast("int").alias("f"), (F.col("id") % size).cast("int").alias("m"))
    window = 0.5 - 0.5 * F.cos(2 * F.lit(math.pi) * F.col("m") / size)
    angle = 2 * F.lit(math.pi) * F.col("f") * F.col("m") / size
    twice = F.when((F.col("f") == 0) | (F.col("f") == size // 2), 1.0).otherwise(2.0) / size
    table = F.broadcast(table.select("f", "m", window.alias("w"), (twice * F.cos(angle)).alias("c"), (twice * F.sin(angle)).alias("s")))
    part = frames.join(table, "f").groupBy(*keys, "frame", "m").agg(F.sum(F.col("re") * F.col("c") - F.col("im") * F.col("s")).alias("x"), F.first("w").alias("w"))
    over = part.groupBy(*keys, (F.col("frame") * hop + F.col("m")).alias("n")).agg(F.sum(F.col("x") * F.col("w")).alias("top"), F.sum(F.col("w") * F.col("w")).alias("weight"))
    return over.filter("weight > 1e-9").select(*keys, "n", (F.col("top") / F.col("weight")).alias("v"))
