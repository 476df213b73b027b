"""Queries of quantisers, pruning and packing; ``embeddings`` are the weights, their label the layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import quantise as Q
from quire.operators import transforms as T
from quire.operators.signals import table, vector_cells
from quire.plans.registry import query
from quire.plans.transforms import BASIS, CELLS, COEFF, PLANE, cells, plane

#: SQL for the embeddings as weights by layer.
WEIGHTS = "weights AS (SELECT label AS layer, vec_id, CAST(n AS INT) AS n, CAST(v AS DOUBLE) AS w FROM (SELECT label, vec_id, unnest(range(64)) AS n, unnest(embedding) AS v FROM embeddings))"
_TOP = ", t AS (SELECT *, max(abs(w)) OVER (PARTITION BY layer) AS top FROM weights)"
_LUMA = f", qt AS (SELECT CAST(k // 8 AS INT) AS i, CAST(k % 8 AS INT) AS j, q FROM (SELECT unnest(range(64)) AS k, unnest({list(Q.LUMA_Q)}) AS q))"


def weights(spark, sf_dir):
    return vector_cells(table(spark, sf_dir, "embeddings")).select(F.col("label").alias("layer"), "vec_id", "n", F.col("v").alias("w"))


def _symmetric(levels: int) -> str:
    return f"WITH {WEIGHTS}{_TOP} SELECT layer, vec_id, n, CAST(least(greatest(round_even(w / (CASE WHEN top > 0 THEN top / {levels} ELSE 1 END), 0), -{levels}), {levels}) AS INT) AS q, round(top / {levels}, 9) AS scale FROM t"


@query(_symmetric(127))
def quant_int8(spark, sf_dir):
    return Q.symmetric(weights(spark, sf_dir), ["layer"], 127).select("layer", "vec_id", "n", "q", F.round("scale", 9).alias("scale"))


@query(_symmetric(7))
def quant_int4(spark, sf_dir):
    return Q.symmetric(weights(spark, sf_dir), ["layer"], 7).select("layer", "vec_id", "n", "q", F.round("scale", 9).alias("scale"))


@query(f"WITH {WEIGHTS}{_TOP} SELECT layer, round(max(abs(w - round_even(w / (top / 127), 0) * (top / 127))), 7) AS worst FROM t GROUP BY layer")
def dequant_error(spark, sf_dir):
    return Q.symmetric(weights(spark, sf_dir), ["layer"], 127).groupBy("layer").agg(F.round(F.max(F.abs(F.col("w") - F.col("back"))), 7).alias("worst"))


_NIBBLES = ", q AS (SELECT *, CAST(round_even(w / (top / 7), 0) AS INT) + 8 AS h FROM t)"


@query(f"WITH {WEIGHTS}{_TOP}{_NIBBLES} SELECT vec_id, CAST(n // 2 AS INT) AS pos, CAST(sum(CASE WHEN n % 2 = 0 THEN h ELSE h * 16 END) AS INT) AS byte FROM q GROUP BY ALL")
def pack_int4_low_first(spark, sf_dir):
    return Q.packed_nibbles(Q.symmetric(weights(spark, sf_dir), ["layer"], 7), ["vec_id"])


@query(f"WITH {WEIGHTS}{_TOP}{_NIBBLES} SELECT vec_id, CAST(n // 2 AS INT) AS pos, CAST(sum(CASE WHEN n % 2 = 1 THEN h ELSE h * 16 END) AS INT) AS byte FROM q GROUP BY ALL")
def pack_int4_high_first(spark, sf_dir):
    return Q.packed_nibbles(Q.symmetric(weights(spark, sf_dir), ["layer"], 7), ["vec_id"], low_first=False)


@query(f"WITH {WEIGHTS}{_TOP}{_NIBBLES} SELECT vec_id, n, h - 8 AS q FROM q")
def unpack_int4(spark, sf_dir):
    return Q.unpacked_nibbles(Q.packed_nibbles(Q.symmetric(weights(spark, sf_dir), ["layer"], 7), ["vec_id"]), ["vec_id"])


@query(f"WITH {WEIGHTS}, e AS (SELECT *, min(w) OVER p AS lo, max(w) OVER p AS hi FROM weights WINDOW p AS (PARTITION BY layer)) SELECT layer, vec_id, n, CAST(round_even((w - lo) / ((hi - lo) / 31), 0) AS INT) AS q FROM e")
def quant_minmax(spark, sf_dir):
    return Q.minmax(weights(spark, sf_dir), ["layer"], 5).select("layer", "vec_id", "n", "q")


@query(f"WITH {WEIGHTS} SELECT layer, CAST((count(*) * 5 + 7) // 8 + 8 AS BIGINT) AS bytes FROM weights GROUP BY layer")
def coded_size(spark, sf_dir):
    return weights(spark, sf_dir).groupBy("layer").agg(Q.coded_bytes(F.count("*"), 5).alias("bytes"))


def _kept(cut: str) -> str:
    return f"SELECT layer, count(*) FILTER (abs(w) < {cut}) AS zeros, round(sum(CASE WHEN abs(w) < {cut} THEN 0 ELSE abs(w) END), 5) AS mass"


def _summary(df):
    return df.groupBy("layer").agg(F.count_if(F.col("kept") == 0).alias("zeros"), F.round(F.sum(F.abs("kept")), 5).alias("mass"))


@query(f"WITH {WEIGHTS}{_TOP} {_kept('top * 0.1')} FROM t GROUP BY layer")
def prune_rel(spark, sf_dir):
    return _summary(Q.pruned_relative(weights(spark, sf_dir), ["layer"], 0.1))


@query(f"WITH {WEIGHTS} {_kept('0.05')} FROM weights GROUP BY layer")
def prune_abs(spark, sf_dir):
    return _summary(Q.pruned_absolute(weights(spark, sf_dir), 0.05))


@query(f"WITH {WEIGHTS}, c AS (SELECT layer, quantile_cont(abs(w), 0.3) AS cut FROM weights GROUP BY layer) {_kept('cut')} FROM weights JOIN c USING (layer) GROUP BY layer")
def prune_pct(spark, sf_dir):
    return _summary(Q.pruned_share(weights(spark, sf_dir), ["layer"], 0.3))


@query(f"WITH {WEIGHTS}{_TOP} SELECT layer, count(*) FILTER (abs(w) >= top * 0.2) AS entries, CAST(count(*) FILTER (abs(w) >= top * 0.2) * 8 AS BIGINT) AS bytes FROM t GROUP BY layer")
def sparse_size(spark, sf_dir):
    kept = Q.pruned_relative(weights(spark, sf_dir), ["layer"], 0.2)
    return kept.groupBy("layer").agg(F.count_if(F.col("kept") != 0).alias("entries"), (F.count_if(F.col("kept") != 0) * 8).alias("bytes"))


@query(f"WITH {WEIGHTS}, r AS (SELECT layer, vec_id, sqrt(sum(w * w)) AS norm FROM weights GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY round(norm, 9) DESC, vec_id) AS rank FROM r) SELECT layer, vec_id, round(norm, 7) AS norm, rank, row_number() OVER (PARTITION BY layer ORDER BY vec_id) - 1 AS place FROM k WHERE rank <= 5")
def topk_neurons(spark, sf_dir):
    return Q.strongest_rows(weights(spark, sf_dir), ["layer"], "vec_id", 5).withColumn("norm", F.round("norm", 7))


@query(f"WITH {WEIGHTS} SELECT vec_id, n, round(sign(w) * greatest(abs(w) - 0.05, 0), 7) AS s FROM weights")
def soft_threshold(spark, sf_dir):
    return weights(spark, sf_dir).select("vec_id", "n", F.round(Q.soft_threshold(F.col("w"), 0.05), 7).alias("s"))


@query(f"WITH {WEIGHTS}{_TOP} SELECT layer, count(*) FILTER (abs(w) < top * 0.3) AS zero, count(*) FILTER (abs(w) >= top * 0.3 AND w > 0) AS plus, count(*) FILTER (abs(w) >= top * 0.3 AND w < 0) AS minus FROM t GROUP BY layer")
def quant_ternary(spark, sf_dir):
    t = Q.ternary(weights(spark, sf_dir), ["layer"], 0.3)
    return t.groupBy("layer").agg(F.count_if(F.col("kept") == 0).alias("zero"), F.count_if(F.col("kept") > 0).alias("plus"), F.count_if(F.col("kept") < 0).alias("minus"))


@query(f"WITH {WEIGHTS} SELECT layer, CAST(ceil(count(*) * log2(3) / 8) AS BIGINT) AS ternary_bytes, CAST(ceil(count(*) * 4 / 8.0) AS BIGINT) AS int4_bytes FROM weights GROUP BY layer")
def effective_seed_size(spark, sf_dir):
    import math

    n = F.count("*")
    return weights(spark, sf_dir).groupBy("layer").agg(F.ceil(n * math.log2(3) / 8).cast("long").alias("ternary_bytes"), F.ceil(n * 4 / 8).cast("long").alias("int4_bytes"))


@query("SELECT o_orderkey, CASE WHEN q >= 1 THEN 0.5e0 ELSE 0.5e0 + (1 - q) * 20 END AS scale FROM (SELECT o_orderkey, (o_orderkey % 10 + 1) / 10e0 AS q FROM orders)")
def quality_scale(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", Q.quality_scale((F.col("o_orderkey") % 10 + 1) / F.lit(10.0)).alias("scale"))


@query(f"WITH {CELLS}, {BASIS}, {COEFF}{_LUMA} SELECT blk, coeff.i, coeff.j, CAST(round_even(c * 1000 / greatest(q * 2.5e0, 1), 0) AS INT) AS q FROM coeff JOIN qt USING (i, j)")
def dct_quantise(spark, sf_dir):
    c = T.dct(cells(spark, sf_dir).withColumn("v", F.col("v") * 1000), ["blk"])
    return Q.quantised(c, Q.q_table(spark), ["i", "j"], 2.5).select("blk", "i", "j", "q")


@query("SELECT CAST(z AS INT) AS z, CAST(y AS INT) AS y, CAST(x AS INT) AS x, greatest(1e0, (1 + 2 * (z + y + x)) * 30 / 100e0) AS q FROM range(8) a(z), range(8) b(y), range(8) c(x)")
def quant_cube(spark, sf_dir):
    return Q.q_cube(spark, 8, 30.0).select("z", "y", "x", "q")


@query(f"WITH {PLANE} SELECT blk, i, j, CAST(round_even((v / 255e0 * 2 * pi() - pi() + pi()) / (2 * pi()) * 255, 0) AS INT) AS p FROM plane")
def phase_8bit(spark, sf_dir):
    import math

    return plane(spark, sf_dir).select("blk", "i", "j", Q.phase_byte(F.col("v") / 255 * 2 * math.pi - math.pi).alias("p"))


@query(f"WITH {CELLS}, p AS (SELECT blk, i, CAST(j // 2 AS INT) AS j, (sum(v) FILTER (j % 2 = 0) + sum(v) FILTER (j % 2 = 1)) / sqrt(2) AS a, (sum(v) FILTER (j % 2 = 0) - sum(v) FILTER (j % 2 = 1)) / sqrt(2) AS d FROM cells GROUP BY ALL), e AS (SELECT min(a) AS lo, max(a) AS hi, quantile_cont(abs(d), 0.95) AS cut FROM p) SELECT blk, i, j, CAST(round_even((a - lo) / (hi - lo) * 255, 0) AS INT) AS ll, CAST(round_even(least(greatest(d, -cut), cut) / cut * 127, 0) AS INT) AS detail FROM p, e")
def wavelet_lossy(spark, sf_dir):
    p = T.haar(cells(spark, sf_dir), ["blk", "i"], "j")
    ends = F.broadcast(p.agg(F.min("a").alias("lo"), F.max("a").alias("hi"), F.percentile(F.abs("d"), 0.95).alias("cut")))
    return p.crossJoin(ends).select("blk", "i", "j", F.rint((F.col("a") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255).cast("int").alias("ll"), F.rint(F.least(F.greatest("d", -F.col("cut")), F.col("cut")) / F.col("cut") * 127).cast("int").alias("detail"))


@query(f"WITH {CELLS}, t AS (SELECT max(abs(v)) / 32767 AS s FROM cells), q AS (SELECT *, round_even(v / s, 0) AS q FROM cells, t), r AS (SELECT *, v - q * s AS e FROM q), u AS (SELECT max(abs(e)) / 127 AS rs FROM r) SELECT blk, i, j, CAST(q AS INT) AS q, CAST(round_even(e / rs, 0) AS INT) AS r FROM r, u")
def wavelet_two_stage(spark, sf_dir):
    c = cells(spark, sf_dir)
    q = c.crossJoin(F.broadcast(c.agg((F.max(F.abs("v")) / 32767).alias("s")))).withColumn("q", F.rint(F.col("v") / F.col("s")))
    e = q.withColumn("e", F.col("v") - F.col("q") * F.col("s"))
    return e.crossJoin(F.broadcast(e.agg((F.max(F.abs("e")) / 127).alias("rs")))).select("blk", "i", "j", F.col("q").cast("int").alias("q"), F.rint(F.col("e") / F.col("rs")).cast("int").alias("r"))


@query("WITH p AS (SELECT a.vec_id, unnest(range(64)) AS n, unnest(a.embedding) AS x, unnest(b.embedding) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, CAST(n AS INT) AS n, round(x::DOUBLE + 0.25e0 * (y::DOUBLE - x), 6) AS v FROM p")
def seed_blend(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return e.join(b, "vec_id").select("vec_id", F.posexplode(Q.blend("a", "b", 0.25)).alias("n", "v")).withColumn("v", F.round("v", 6))


@query(f"WITH {PLANE}, x AS (SELECT *, (blk * 64 + i * 8 + j) % 7 = 0 AS hit FROM plane), y AS (SELECT *, CASE WHEN hit THEN xor(v, 1) ELSE v END AS bad FROM x) SELECT blk, bit_xor(v) AS sum_ok, bit_xor(bad) AS sum_bad, CAST(quantile_cont(v, 0.5) AS DOUBLE) AS median FROM y GROUP BY blk")
def error_correction(spark, sf_dir):
    p = plane(spark, sf_dir).withColumn("bad", F.when((F.col("blk") * 64 + F.col("i") * 8 + F.col("j")) % 7 == 0, F.col("v").bitwiseXOR(F.lit(1))).otherwise(F.col("v")))
    return p.groupBy("blk").agg(F.bit_xor("v").alias("sum_ok"), F.bit_xor("bad").alias("sum_bad"), F.percentile("v", 0.5).alias("median"))


@query(f"WITH {WEIGHTS} SELECT vec_id, n, round(w, 6) AS voted FROM weights")
def repetition_vote(spark, sf_dir):
    """Three copies of every weight, one of them damaged; the median of the three is the weight."""
    w = weights(spark, sf_dir)
    copies = w.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(2))))
    damaged = F.when(F.col("copy") == F.pmod(F.xxhash64("vec_id", "n"), F.lit(3)), F.col("w") + 1).otherwise(F.col("w"))
    return copies.withColumn("x", damaged).groupBy("vec_id", "n").agg(F.round(F.percentile("x", 0.5), 6).alias("voted"))


@query()
def weight_noise(spark, sf_dir):
    """Seeded Gaussian noise and random zeroes; rows only, as generators differ."""
    w = weights(spark, sf_dir)
    return w.select("vec_id", "n", (F.col("w") + 0.01 * F.randn(7)).alias("noisy"), F.when(F.rand(11) < 0.1, 0.0).otherwise(F.col("w")).alias("masked"))
