"""Queries of the transforms: colour, blocks, wavelets, frames, predictors, stencils, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import transforms as T
from quire.operators.signals import blocks, byte_plane, line_pixels, table
from quire.plans.registry import query

#: SQL for the embeddings as 8 x 8 blocks, and as a plane of bytes.
CELLS = "cells AS (SELECT vec_id AS blk, CAST(n // 8 AS INT) AS i, CAST(n % 8 AS INT) AS j, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, unnest(range(64)) AS n, unnest(embedding) AS v FROM embeddings))"
PLANE = CELLS + ", plane AS (SELECT blk, i, j, CAST(round_even((v - lo) / (hi - lo) * 255, 0) AS INT) AS v FROM cells, (SELECT min(v) AS lo, max(v) AS hi FROM cells))"
BASIS = "basis AS (SELECT CAST(u AS INT) AS u, CAST(x AS INT) AS x, (CASE WHEN u = 0 THEN sqrt(1.0 / 8) ELSE sqrt(2.0 / 8) END) * cos((2 * x + 1) * u * pi() / 16) AS w FROM range(8) a(u), range(8) b(x))"
COEFF = "coeff AS (SELECT blk, a.u AS i, b.u AS j, sum(a.w * b.w * v) AS c FROM cells JOIN basis a ON a.x = i JOIN basis b ON b.x = j GROUP BY ALL)"
PIXELS = "pixels AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_partkey % 256 AS INT) AS r, CAST(l_suppkey % 256 AS INT) AS g, CAST(l_quantity AS INT) AS b FROM lineitem)"
YCC = ", ycc AS (SELECT *, 0.299e0 * r + 0.587e0 * g + 0.114e0 * b AS y, -0.168736e0 * r - 0.331264e0 * g + 0.5e0 * b + 128 AS cb, 0.5e0 * r - 0.418688e0 * g - 0.081312e0 * b + 128 AS cr FROM pixels)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(table(spark, sf_dir, "embeddings"))


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_plane(cells(spark, sf_dir)).select("blk", "i", "j", F.col("u8").alias("v"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_pixels(table(spark, sf_dir, "lineitem"))


@query(f"WITH {CELLS}, {BASIS}, {COEFF} SELECT blk, i, j, round(c, 6) AS c FROM coeff")
def dct8_embeddings(spark, sf_dir):
    return T.dct(cells(spark, sf_dir), ["blk"]).select("blk", "i", "j", F.round("v", 6).alias("c"))


@query(f"WITH {CELLS}, {BASIS}, {COEFF} SELECT blk, round(sum(abs(c)), 5) AS energy, max(abs(c)) > 0 AS some FROM coeff GROUP BY blk")
def dct8_in_place(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("blk"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    c = vectors.withColumn("c", T.dct_array(F.col("v")))
    total = F.aggregate("c", F.lit(0.0), lambda acc, x: acc + F.abs(x))
    return c.select("blk", F.round(total, 5).alias("energy"), F.exists("c", lambda x: F.abs(x) > 0).alias("some"))


@query(f"WITH {CELLS} SELECT blk, i, j, round(v, 6) AS v FROM cells")
def idct_roundtrip(spark, sf_dir):
    back = T.dct(T.dct(cells(spark, sf_dir), ["blk"]), ["blk"], inverse=True)
    return back.select("blk", "i", "j", F.round("v", 6).alias("v"))


@query(f"WITH {CELLS}, b4 AS (SELECT CAST(u AS INT) AS u, CAST(x AS INT) AS x, (CASE WHEN u = 0 THEN sqrt(1.0 / 4) ELSE sqrt(2.0 / 4) END) * cos((2 * x + 1) * u * pi() / 8) AS w FROM range(4) a(u), range(4) b(x)), cube AS (SELECT blk, i // 2 AS z, i % 2 * 2 + j // 4 AS y, j % 4 AS x, v FROM cells) SELECT blk, a.u AS z, b.u AS y, c.u AS x, round(sum(a.w * b.w * c.w * v), 6) AS c FROM cube JOIN b4 a ON a.x = z JOIN b4 b ON b.x = y JOIN b4 c ON c.x = cube.x GROUP BY ALL")
def dct3_volume(spark, sf_dir):
    cube = cells(spark, sf_dir).select("blk", F.floor(F.col("i") / 2).cast("int").alias("z"), (F.col("i") % 2 * 2 + F.floor(F.col("j") / 4)).cast("int").alias("y"), (F.col("j") % 4).alias("x"), "v")
    return T.dct(cube, ["blk"], ("z", "y", "x"), 4).select("blk", "z", "y", "x", F.round("v", 6).alias("c"))


@query(f"WITH {CELLS}, cube AS (SELECT blk, i // 2 AS z, i % 2 * 2 + j // 4 AS y, j % 4 AS x, v FROM cells) SELECT blk, CAST(z AS INT) AS z, CAST(y AS INT) AS y, x, round(v, 6) AS v FROM cube")
def idct3_roundtrip(spark, sf_dir):
    cube = cells(spark, sf_dir).select("blk", F.floor(F.col("i") / 2).cast("int").alias("z"), (F.col("i") % 2 * 2 + F.floor(F.col("j") / 4)).cast("int").alias("y"), (F.col("j") % 4).alias("x"), "v")
    axes = ("z", "y", "x")
    return T.dct(T.dct(cube, ["blk"], axes, 4), ["blk"], axes, 4, inverse=True).select("blk", *axes, F.round("v", 6).alias("v"))


@query(f"WITH {BASIS} SELECT u, x, round(w, 9) AS w FROM basis")
def dct_matrix(spark, sf_dir):
    return T.dct_basis(spark).select("u", "x", F.round("w", 9).alias("w"))


@query(f"WITH {PIXELS}{YCC} SELECT k, n, round(y, 6) AS y, round(cb, 6) AS cb, round(cr, 6) AS cr FROM ycc")
def ycbcr_lineitem(spark, sf_dir):
    return T.ycbcr(pixels(spark, sf_dir)).select("k", "n", *(F.round(c, 6).alias(c) for c in ("y", "cb", "cr")))


@query(f"WITH {PIXELS}{YCC} SELECT k, n, CAST(least(greatest(round_even(y + (cr - 128) * 1.402, 0), 0), 255) AS INT) AS rr, CAST(least(greatest(round_even(y - (cb - 128) * 0.344136 - (cr - 128) * 0.714136, 0), 0), 255) AS INT) AS gg, CAST(least(greatest(round_even(y + (cb - 128) * 1.772, 0), 0), 255) AS INT) AS bb FROM ycc")
def rgb_roundtrip(spark, sf_dir):
    return T.rgb(T.ycbcr(pixels(spark, sf_dir))).select("k", "n", "rr", "gg", "bb")


@query(f"WITH {PLANE} SELECT blk, i, j, v FROM plane WHERE i % 2 = 0 AND j % 2 = 0")
def subsample420(spark, sf_dir):
    return T.subsample(plane(spark, sf_dir))


@query(f"WITH {PLANE} SELECT p.blk, p.i, p.j, q.v FROM plane p JOIN plane q ON q.blk = p.blk AND q.i = p.i // 2 * 2 AND q.j = p.j // 2 * 2")
def upsample420(spark, sf_dir):
    p = plane(spark, sf_dir)
    return T.upsample(T.subsample(p), p.select("blk", "i", "j"), ["blk"]).select("blk", "i", "j", "v")


_NEAR = ", near AS (SELECT *, lag(v, 1, 0) OVER (PARTITION BY blk, i ORDER BY j) AS a, lag(v, 1, 0) OVER (PARTITION BY blk, j ORDER BY i) AS b, lag(v, 1, 0) OVER (PARTITION BY blk, i - j ORDER BY i) AS c FROM plane)"


def _filter_sql(guess: str) -> str:
    return f"WITH {PLANE}{_NEAR} SELECT blk, i, j, CAST((v - ({guess}) + 512) % 256 AS INT) AS f FROM near"


@query(_filter_sql("a"))
def filter_sub(spark, sf_dir):
    return T.filtered(plane(spark, sf_dir), "sub", ["blk"]).select("blk", "i", "j", "f")


@query(_filter_sql("b"))
def filter_up(spark, sf_dir):
    return T.filtered(plane(spark, sf_dir), "up", ["blk"]).select("blk", "i", "j", "f")


@query(_filter_sql("(a + b) // 2"))
def filter_avg(spark, sf_dir):
    return T.filtered(plane(spark, sf_dir), "avg", ["blk"]).select("blk", "i", "j", "f")


@query(_filter_sql("CASE WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END"))
def filter_paeth(spark, sf_dir):
    return T.filtered(plane(spark, sf_dir), "paeth", ["blk"]).select("blk", "i", "j", "f")


def _named(name: str, kind: str) -> None:
    def undo(spark, sf_dir):
        return T.unfiltered(T.filtered(plane(spark, sf_dir), kind, ["blk"]).drop("v"), kind, ["blk"]).select("blk", "i", "j", "v")

    undo.__name__ = name
    query(f"WITH {PLANE} SELECT blk, i, j, v FROM plane")(undo)


for _kind in T.FILTERS[1:]:
    _named(f"unfilter_{_kind}", _kind)


@query(f"WITH {PLANE} SELECT a.blk, a.i, a.j, CAST((a.v - b.v + 256) % 256 AS INT) AS res, CAST((b.v + (a.v - b.v + 256) % 256) % 256 AS INT) AS back FROM plane a JOIN plane b ON b.blk = a.blk + 1 AND a.i = b.i AND a.j = b.j")
def mod_residual(spark, sf_dir):
    p = plane(spark, sf_dir)
    q = p.select((F.col("blk") - 1).alias("blk"), "i", "j", F.col("v").alias("w"))
    res = F.pmod(F.col("v") - F.col("w"), F.lit(256))
    return p.join(q, ["blk", "i", "j"]).select("blk", "i", "j", res.cast("int").alias("res"), F.pmod(F.col("w") + res, F.lit(256)).cast("int").alias("back"))


@query(f"WITH {PLANE} SELECT a.blk, a.i, a.j, xor(a.v, b.v) AS res, xor(b.v, xor(a.v, b.v)) AS back FROM plane a JOIN plane b ON b.blk = a.blk + 1 AND a.i = b.i AND a.j = b.j")
def xor_residual(spark, sf_dir):
    p = plane(spark, sf_dir)
    q = p.select((F.col("blk") - 1).alias("blk"), "i", "j", F.col("v").alias("w"))
    res = F.col("v").bitwiseXOR(F.col("w"))
    return p.join(q, ["blk", "i", "j"]).select("blk", "i", "j", res.alias("res"), F.col("w").bitwiseXOR(res).alias("back"))


_PAIR = ", p AS (SELECT blk, i, CAST(j // 2 AS INT) AS j, sum(v) FILTER (j % 2 = 0) AS e, sum(v) FILTER (j % 2 = 1) AS o FROM {t} GROUP BY ALL)"


@query(f"WITH {CELLS}{_PAIR.format(t='cells')} SELECT blk, i, j, round((e + o) / sqrt(2), 6) AS a, round((e - o) / sqrt(2), 6) AS d FROM p")
def haar_1level(spark, sf_dir):
    return T.haar(cells(spark, sf_dir), ["blk", "i"], "j").select("blk", "i", "j", F.round("a", 6).alias("a"), F.round("d", 6).alias("d"))


@query(f"WITH {CELLS} SELECT blk, i, j, round(v, 6) AS v FROM cells")
def haar_roundtrip(spark, sf_dir):
    return T.unhaar(T.haar(cells(spark, sf_dir), ["blk", "i"], "j"), ["blk", "i"], "j").select("blk", "i", "j", F.round("v", 6).alias("v"))


@query(f"WITH {PLANE}{_PAIR.format(t='plane')} SELECT blk, i, j, CAST(floor((e + o) / 2) AS BIGINT) AS a, CAST(e - o AS BIGINT) AS d FROM p")
def integer_haar(spark, sf_dir):
    return T.integer_haar(plane(spark, sf_dir), ["blk", "i"], "j")


@query(f"WITH {PLANE} SELECT blk, i, j, CAST(v AS BIGINT) AS v FROM plane")
def integer_haar_roundtrip(spark, sf_dir):
    return T.integer_unhaar(T.integer_haar(plane(spark, sf_dir), ["blk", "i"], "j"), ["blk", "i"], "j")


@query("""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, value AS v FROM events),
l AS (SELECT user_id, max(n) + 1 AS len FROM s GROUP BY 1),
fr AS (SELECT s.user_id, f.frame, s.n - f.frame * 4 AS m, v FROM s JOIN l USING (user_id), range(0, 100000) f(frame) WHERE f.frame * 4 <= s.n AND s.n < f.frame * 4 + 8 AND f.frame * 4 + 8 <= len)
SELECT user_id, CAST(frame AS INT) AS frame, CAST(f AS INT) AS f, round(sqrt(pow(sum(v * w * cos(a)), 2) + pow(sum(v * w * sin(a)), 2)), 5) AS mag FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * m / 8) AS w, -2 * pi() * f * m / 8 AS a FROM fr, range(5) b(f)) GROUP BY user_id, frame, f""".replace("range(0, 100000)", "(SELECT unnest(range((SELECT max(len) FROM l) // 4 + 1)) AS frame)"))
def stft_events(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    s = e.select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("n"), F.col("value").alias("v"))
    return T.stft(s, ["user_id"], 8, 4).select("user_id", "frame", "f", F.round(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2), 5).alias("mag"))


@query("WITH g AS (SELECT CAST(a AS INT) AS i, CAST(b AS INT) AS j FROM range(16) x(a), range(16) y(b)) SELECT i, j, round(-1 + i * (2.0 / 15), 9) AS y, round(-1 + j * (2.0 / 15), 9) AS x FROM g")
def coordinate_grid(spark, sf_dir):
    return T.grid(spark, 16).select("i", "j", F.round("y", 9).alias("y"), F.round("x", 9).alias("x"))


@query(f"WITH {CELLS} SELECT blk, CAST(i // 3 AS INT) AS i, CAST(j // 3 AS INT) AS j, round(avg(v), 6) AS v FROM cells WHERE i < 6 AND j < 6 GROUP BY ALL")
def block_mean(spark, sf_dir):
    return T.block_mean(cells(spark, sf_dir), ["blk"], 3, 8).withColumn("v", F.round("v", 6))


@query(f"WITH {CELLS}, m AS (SELECT CAST(k AS INT) AS k, CAST(floor(k * 7 / 12) AS INT) AS at FROM range(13) r(k)) SELECT blk, a.k AS i, b.k AS j, round(v, 6) AS v FROM cells JOIN m a ON a.at = i JOIN m b ON b.at = j")
def lod_resample(spark, sf_dir):
    return T.resized(cells(spark, sf_dir), ["blk"], 8, 13).withColumn("v", F.round("v", 6))


@query(f"WITH {CELLS}, l AS (SELECT blk, lag(v) OVER r + lead(v) OVER r + lag(v) OVER c + lead(v) OVER c - 4 * v AS lap FROM cells WINDOW r AS (PARTITION BY blk, i ORDER BY j), c AS (PARTITION BY blk, j ORDER BY i)) SELECT blk, round(var_pop(lap), 6) AS lap_var FROM l WHERE lap IS NOT NULL GROUP BY blk")
def laplacian_var(spark, sf_dir):
    return T.laplacian_variance(cells(spark, sf_dir), ["blk"]).withColumn("lap_var", F.round("lap_var", 6))


@query(f"""WITH {CELLS}, n AS (SELECT a.blk, a.i, a.j, sum(b.v * (b.j - a.j) * (CASE WHEN b.i = a.i THEN 2 ELSE 1 END)) AS gx, sum(b.v * (b.i - a.i) * (CASE WHEN b.j = a.j THEN 2 ELSE 1 END)) AS gy, count(*) AS k FROM cells a JOIN cells b ON a.blk = b.blk AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY ALL),
m AS (SELECT blk, i, j, sqrt(gx * gx + gy * gy) AS mag FROM n WHERE k = 9) SELECT blk, i, j, round(0.5 + 2.5 * mag / greatest(max(mag) OVER (PARTITION BY blk), 1e-12), 6) AS weight FROM m""")
def edge_weights(spark, sf_dir):
    return T.edge_weights(cells(spark, sf_dir), ["blk"]).withColumn("weight", F.round("weight", 6))


@query(f"WITH {CELLS} SELECT blk, CAST(i // 4 AS INT) AS pi, CAST(j // 4 AS INT) AS pj, round(var_pop(v), 6) AS var, var_pop(v) < 0.015 AS smooth FROM cells GROUP BY ALL")
def patch_variance(spark, sf_dir):
    return T.patch_variance(cells(spark, sf_dir), ["blk"], 4, 0.015).withColumn("var", F.round("var", 6))


@query(f"WITH {CELLS}, p AS (SELECT blk, i // 4 AS pi, j // 4 AS pj, var_pop(v) < 0.015 AS smooth, avg(v) AS a, max(v) AS m FROM cells GROUP BY ALL) SELECT blk, CAST(pi AS INT) AS pi, CAST(pj AS INT) AS pj, CASE WHEN smooth THEN 'smooth' ELSE 'detail' END AS route, round(CASE WHEN smooth THEN a ELSE m END, 6) AS kept FROM p")
def split_routing(spark, sf_dir):
    c = cells(spark, sf_dir)
    p = T.patch_variance(c, ["blk"], 4, 0.015)
    q = c.withColumn("pi", F.floor(F.col("i") / 4).cast("int")).withColumn("pj", F.floor(F.col("j") / 4).cast("int")).groupBy("blk", "pi", "pj").agg(F.avg("v").alias("a"), F.max("v").alias("m")).join(p, ["blk", "pi", "pj"])
    smooth = q.filter("smooth").select("blk", "pi", "pj", F.lit("smooth").alias("route"), F.round("a", 6).alias("kept"))
    return smooth.unionByName(q.filter("NOT smooth").select("blk", "pi", "pj", F.lit("detail").alias("route"), F.round("m", 6).alias("kept")))
