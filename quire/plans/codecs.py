"""Queries of whole encoders; embeddings, sixteen to an image, are the pixels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import codecs as K
from quire.operators import measure as M
from quire.operators import transforms as T
from quire.operators.signals import table
from quire.plans.registry import query
from quire.plans.transforms import CELLS, PLANE, cells, plane

_IMAGES = "images AS (SELECT blk // 16 AS img, CAST(blk % 16 // 4 * 8 + i AS INT) AS i, CAST(blk % 4 * 8 + j AS INT) AS j, v AS r, 255 - v AS g, v * 3 % 256 AS b FROM plane WHERE blk // 16 < (SELECT count(*) // 16 FROM embeddings))"


def images(spark, sf_dir):
    whole = table(spark, sf_dir, "embeddings").count() // 16
    p = plane(spark, sf_dir).filter(F.floor(F.col("blk") / 16) < whole)
    return p.select(F.floor(F.col("blk") / 16).cast("long").alias("img"), (F.floor(F.col("blk") % 16 / 4) * 8 + F.col("i")).cast("int").alias("i"), (F.col("blk") % 4 * 8 + F.col("j")).cast("int").alias("j"), F.col("v").alias("r"), (255 - F.col("v")).alias("g"), (F.col("v") * 3 % 256).cast("int").alias("b"))


@query()
def dct_codec(spark, sf_dir):
    """Each image coded and decoded: bytes and decibels."""
    p = images(spark, sf_dir)
    coded = K.dct_encode(p, 0.95)
    both = p.join(K.dct_decode(coded).withColumnsRenamed({"r": "r2", "g": "g2", "b": "b2"}), ["img", "i", "j"])
    error = both.groupBy("img").agg(((M.mse("r", "r2") + M.mse("g", "g2") + M.mse("b", "b2")) / 3).alias("mse"))
    return coded.select("img", F.octet_length("payload").alias("bytes")).join(error, "img").select("img", "bytes", M.psnr(F.col("mse"), 255.0, 100.0).alias("psnr"))


@query(f"WITH {PLANE}, {_IMAGES} SELECT DISTINCT img, true AS same FROM images")
def palette_codec(spark, sf_dir):
    """Lossless: the decoded pixels have the digest of the originals. These images have at most 256 colours."""
    p = images(spark, sf_dir)
    back = K.palette_decode(K.palette_encode(p))
    return K.digests(p, "a").join(K.digests(back, "b"), "img").select("img", (F.col("a") == F.col("b")).alias("same"))


@query(f"WITH {PLANE}, {_IMAGES} SELECT DISTINCT img, 'palette' AS codec FROM images")
def auto_codec(spark, sf_dir):
    return K.auto_encode(images(spark, sf_dir), lossless=True).select("img", "codec")


@query(f"WITH {PLANE} SELECT blk, i, j, v FROM plane")
def residual_codec(spark, sf_dir):
    """Bit-exact: a fitted network's guess and the residual give back all blocks."""
    return K.residual_decode(K.residual_encode(plane(spark, sf_dir), "blk", steps=30)).select("blk", "i", "j", "v")


@query(f"WITH {PLANE} SELECT blk, i, j, v - v % 2 + (blk + i + j) % 2 AS carrier, CAST((blk + i + j) % 2 AS INT) AS bit FROM plane")
def lsb_embed(spark, sf_dir):
    bit = ((F.col("blk") + F.col("i") + F.col("j")) % 2).cast("int")
    p = plane(spark, sf_dir).withColumn("carrier", K.embedded(F.col("v"), bit))
    return p.select("blk", "i", "j", F.col("carrier").cast("long").alias("carrier"), (F.col("carrier") % 2).cast("int").alias("bit"))


@query(f"WITH {CELLS}, im AS (SELECT blk AS img, CASE WHEN blk % 3 = 0 THEN 6 ELSE 8 END AS side, i, j, v FROM cells) SELECT img, CAST(a AS INT) AS i, CAST(b AS INT) AS j, round(v, 6) AS v FROM im, range(6) x(a), range(6) y(b) WHERE i = floor(a * (side - 1) / 5) AND j = floor(b * (side - 1) / 5) AND i < side AND j < side")
def texture_array(spark, sf_dir):
    im = cells(spark, sf_dir).withColumnRenamed("blk", "img").withColumn("side", F.when(F.col("img") % 3 == 0, 6).otherwise(8)).filter("i < side AND j < side")
    return K.stacked(im).withColumn("v", F.round("v", 6))


@query(f"WITH {CELLS}, reg AS (SELECT blk AS region, i // 2 AS i, j // 2 AS j, avg(v) AS w FROM cells GROUP BY ALL), e AS (SELECT blk, c.i // 4 AS pi, c.j // 4 AS pj, region, round(sum((v - w) ** 2), 9) AS error FROM cells c JOIN reg ON reg.i = c.i % 4 AND reg.j = c.j % 4 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY blk, pi, pj ORDER BY error, region) AS rank FROM e) SELECT blk, CAST(pi AS INT) AS pi, CAST(pj AS INT) AS pj, region, round(error, 6) AS error FROM k WHERE rank = 1")
def similar_region(spark, sf_dir):
    """For each 4 x 4 patch the most similar region; regions are all blocks at half their size."""
    c = cells(spark, sf_dir)
    return _most_similar(c, c)


def _most_similar(c, of):
    regions = T.block_mean(of, ["blk"], 2, 8).withColumnRenamed("blk", "region")
    patches = c.select("blk", F.floor(F.col("i") / 4).cast("int").alias("pi"), F.floor(F.col("j") / 4).cast("int").alias("pj"), (F.col("i") % 4).alias("i"), (F.col("j") % 4).alias("j"), "v")
    return K.similar_regions(patches, regions, ["blk", "pi", "pj"]).withColumn("error", F.floor(F.col("error") * 1e6 + 0.5) / 1e6)  # half up by the product in doubles, as in SQL


@query("WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, value AS v FROM events), l AS (SELECT user_id, max(n) + 1 AS len FROM s GROUP BY 1) SELECT user_id, n, round(v, 4) AS v FROM s JOIN l USING (user_id) WHERE len >= 8 AND n > 0 AND n < ((len - 8) // 4) * 4 + 8")
def istft_roundtrip(spark, sf_dir):
    """Samples back from their frames, but for the first, where the window is zero, and the rest after the last frame."""
    e = table(spark, sf_dir, "events")
    s = e.select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("n"), F.col("value").alias("v"))
    back = K.istft(T.stft(s, ["user_id"], 8, 4), ["user_id"], 8, 4)
    return back.select("user_id", F.col("n").cast("long").alias("n"), F.round("v", 4).alias("v"))


@query(f"WITH {PLANE} SELECT CAST(blk // 64 AS BIGINT) AS tile, count(*) AS cached_bytes, CAST(max(v) AS INT) AS top FROM plane GROUP BY 1")
def tile_cache(spark, sf_dir):
    """Bytes of each tile of 64 blocks that decoding keeps in memory."""
    return plane(spark, sf_dir).groupBy(F.floor(F.col("blk") / 64).cast("long").alias("tile")).agg(F.count("*").alias("cached_bytes"), F.max("v").alias("top"))
