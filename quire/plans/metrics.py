"""Queries of quality and information measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import measure as M
from quire.operators.signals import table
from quire.plans.quantisation import WEIGHTS, weights
from quire.plans.registry import query
from quire.plans.transforms import CELLS, PLANE, cells, plane

_PAIRS = "pairs AS (SELECT a.blk, a.i, a.j, a.v AS a, b.v AS b FROM {t} a JOIN {t} b ON b.blk = a.blk + 1 AND b.i = a.i AND b.j = a.j)"


def _pairs(df):
    return df.withColumnRenamed("v", "a").join(df.select((F.col("blk") - 1).alias("blk"), "i", "j", F.col("v").alias("b")), ["blk", "i", "j"])


@query(f"WITH {PLANE}, {_PAIRS.format(t='plane')} SELECT blk, round(avg((a - b) ** 2), 6) AS mse, round(CASE WHEN avg((a - b) ** 2) = 0 THEN 100 ELSE 10 * log10(65025 / avg((a - b) ** 2)) END, 6) AS psnr FROM pairs GROUP BY blk")
def psnr(spark, sf_dir):
    e = _pairs(plane(spark, sf_dir)).groupBy("blk").agg(M.mse("a", "b").alias("mse"))
    return e.select("blk", F.round("mse", 6).alias("mse"), F.round(M.psnr(F.col("mse"), 255.0, 100.0), 6).alias("psnr"))


@query(f"WITH {CELLS}, {_PAIRS.format(t='cells')}, e AS (SELECT blk, avg((a - b) ** 2) AS m FROM pairs GROUP BY blk) SELECT blk, round(10 * log10(4 / m), 6) AS unit, round(10 * log10(4 / greatest(m, 1e-10)), 6) AS clamped FROM e")
def psnr_unit(spark, sf_dir):
    e = _pairs(cells(spark, sf_dir)).groupBy("blk").agg(M.mse("a", "b").alias("m"))
    return e.select("blk", F.round(M.psnr(F.col("m"), 2.0, float("inf")), 6).alias("unit"), F.round(M.psnr(F.col("m"), 2.0, least=1e-10), 6).alias("clamped"))


@query(f"WITH {CELLS}, {_PAIRS.format(t='cells')} SELECT blk, round(10 * log10(avg(a * a) / (avg((a - b) ** 2) + 1e-10)), 6) AS snr FROM pairs GROUP BY blk")
def snr(spark, sf_dir):
    return _pairs(cells(spark, sf_dir)).groupBy("blk").agg(F.round(M.snr("a", "b"), 6).alias("snr"))


@query(f"WITH {PLANE}, {_PAIRS.format(t='plane')} SELECT blk, round(1 - sum(bit_count(xor(a, b))) / (8.0 * count(*)), 9)::DOUBLE AS accuracy FROM pairs GROUP BY blk")
def bit_accuracy(spark, sf_dir):
    return _pairs(plane(spark, sf_dir)).groupBy("blk").agg(F.round(M.bit_accuracy("a", "b"), 9).alias("accuracy"))


@query(f"WITH {CELLS}, {_PAIRS.format(t='cells')} SELECT blk, round((2 * avg(a) * avg(b) + 1e-4) * (2 * covar_pop(a, b) + 9e-4) / ((avg(a) ** 2 + avg(b) ** 2 + 1e-4) * (var_pop(a) + var_pop(b) + 9e-4)), 6) AS ssim FROM pairs GROUP BY blk")
def ssim_global(spark, sf_dir):
    return _pairs(cells(spark, sf_dir)).groupBy("blk").agg(F.round(M.ssim("a", "b", 1.0), 6).alias("ssim"))


@query(f"WITH {CELLS}, {_PAIRS.format(t='cells')}, w AS (SELECT blk, wi, wj, (2 * avg(a) * avg(b) + 1e-4) * (2 * covar_samp(a, b) + 9e-4) / ((avg(a) ** 2 + avg(b) ** 2 + 1e-4) * (var_samp(a) + var_samp(b) + 9e-4)) AS s FROM pairs, range(2) x(wi), range(2) y(wj) WHERE i BETWEEN wi AND wi + 6 AND j BETWEEN wj AND wj + 6 GROUP BY ALL) SELECT blk, round(avg(s), 6) AS ssim FROM w GROUP BY blk")
def ssim_windowed(spark, sf_dir):
    return M.windowed_ssim(_pairs(cells(spark, sf_dir)), ["blk"]).withColumn("ssim", F.round("ssim", 6))


@query("SELECT doc_id, sha256(encode(text)) AS sha_original, sha256(encode(reverse(reverse(text)))) AS sha_decoded, true AS same FROM documents")
def sha_roundtrip(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return d.select("doc_id", sha(F.col("text")).alias("sha_original"), sha(F.reverse(F.reverse("text"))).alias("sha_decoded")).withColumn("same", F.col("sha_original") == F.col("sha_decoded"))


@query("WITH c AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS byte FROM documents), n AS (SELECT doc_id, byte, count(*) AS n FROM c GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM n) SELECT doc_id, CAST(sum(n) AS BIGINT) AS bytes, round(-sum(p * log2(p)), 6) AS bits FROM p GROUP BY doc_id")
def byte_entropy(spark, sf_dir):
    from pyspark.sql import Window

    counts = M.text_bytes(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("doc_id")))
    return counts.groupBy("doc_id").agg(F.sum("n").alias("bytes"), F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("bits"))


@query(f"WITH {WEIGHTS}, s AS (SELECT layer, CAST(round_even(w * 20, 0) AS INT) AS q FROM weights), c AS (SELECT layer, q, count(*) AS c FROM s GROUP BY ALL), p AS (SELECT *, c / sum(c) OVER (PARTITION BY layer) AS p FROM c), l AS (SELECT layer, CAST(sum(c) AS BIGINT) AS n, -sum(c * log2(p)) AS bits FROM p GROUP BY layer) SELECT coalesce(CAST(layer AS VARCHAR), '_total') AS layer, CAST(sum(n) AS BIGINT) AS n, round(sum(bits), 4) AS bits, round(1 - sum(bits) / (8 * sum(n)), 6) AS saved FROM l GROUP BY ROLLUP (layer)")
def layer_entropy_rollup(spark, sf_dir):
    s = weights(spark, sf_dir).withColumn("q", F.rint(F.col("w") * 20).cast("int"))
    per = M.entropy(s, ["layer"], "q").withColumn("total", F.col("n") * F.col("bits"))
    up = per.rollup("layer").agg(F.sum("n").alias("n"), F.sum("total").alias("b"))
    return up.select(F.coalesce(F.col("layer").cast("string"), F.lit("_total")).alias("layer"), "n", F.round("b", 4).alias("bits"), F.round(1 - F.col("b") / (8 * F.col("n")), 6).alias("saved"))


@query("WITH s AS (SELECT doc_id, n_chars, octet_length(encode(text)) AS bytes FROM documents) SELECT doc_id, round(8.0 * bytes / n_chars, 6)::DOUBLE AS bpp, round(bytes / n_chars, 6) AS ratio, CASE WHEN bytes > n_chars THEN 'wide' ELSE 'plain' END AS winner FROM s WHERE n_chars > 0")
def bpp_ratio(spark, sf_dir):
    s = table(spark, sf_dir, "documents").filter("n_chars > 0").select("doc_id", "n_chars", F.octet_length("text").alias("bytes"))
    return s.select("doc_id", F.round(8 * F.col("bytes") / F.col("n_chars"), 6).alias("bpp"), F.round(F.col("bytes") / F.col("n_chars"), 6).alias("ratio"), F.when(F.col("bytes") > F.col("n_chars"), "wide").otherwise("plain").alias("winner"))


@query("SELECT o_orderkey, round(b * 1.380649e-23 * 300 * ln(2) * 1e18, 9) AS attojoules, round(log10(2 * (b * 1.380649e-23 * 300 * ln(2)) / (pi() * 1.054571817e-34)), 6) AS log_ops FROM (SELECT o_orderkey, o_totalprice AS b FROM orders)")
def physical_limits(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    e = M.landauer(F.col("o_totalprice"))
    return o.select("o_orderkey", F.round(e * 1e18, 9).alias("attojoules"), F.round(F.log10(M.operations_limit(e)), 6).alias("log_ops"))


@query(f"WITH {WEIGHTS}, v AS (SELECT layer, var_pop(w) AS var FROM weights GROUP BY layer) SELECT layer, d, round(CASE WHEN d >= var THEN 0 ELSE 0.5 * log2(var / d) END, 6) AS bits FROM v, (SELECT unnest([0.0001e0, 0.001e0, 0.01e0, 0.1e0]) AS d)")
def rate_distortion(spark, sf_dir):
    v = weights(spark, sf_dir).groupBy("layer").agg(F.var_pop("w").alias("var"))
    d = v.withColumn("d", F.explode(F.array(*map(F.lit, (0.0001, 0.001, 0.01, 0.1)))))
    return d.select("layer", "d", F.round(M.rate_bound(F.col("var"), F.col("d")), 6).alias("bits"))


@query(f"WITH {WEIGHTS} SELECT layer, round(avg(w), 7) AS mean, round(stddev_pop(w), 7) AS std, round(min(w), 7) AS lo, round(max(w), 7) AS hi, round(avg(abs(w)), 7) AS mean_abs, round(avg(CASE WHEN abs(w) < 0.01 THEN 1 ELSE 0 END), 7) AS sparsity FROM weights GROUP BY layer")
def weight_stats(spark, sf_dir):
    r = lambda c, name: F.round(c, 7).alias(name)
    return weights(spark, sf_dir).groupBy("layer").agg(r(F.avg("w"), "mean"), r(F.stddev_pop("w"), "std"), r(F.min("w"), "lo"), r(F.max("w"), "hi"), r(F.avg(F.abs("w")), "mean_abs"), r(F.avg((F.abs("w") < 0.01).cast("int")), "sparsity"))


@query("WITH h AS (SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders), z AS (SELECT *, length(h) - length(ltrim(h, '0')) AS z, instr('0123456789abcdef', substr(ltrim(h, '0'), 1, 1)) - 1 AS d FROM h) SELECT o_orderkey, CAST(4 * z + CASE WHEN d >= 8 THEN 0 WHEN d >= 4 THEN 1 WHEN d >= 2 THEN 2 WHEN d >= 1 THEN 3 ELSE 0 END AS INT) AS bits, 4 * z + CASE WHEN d >= 8 THEN 0 WHEN d >= 4 THEN 1 WHEN d >= 2 THEN 2 WHEN d >= 1 THEN 3 ELSE 0 END >= 6 AS accepted FROM z")
def proof_of_work(spark, sf_dir):
    h = F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256)
    return table(spark, sf_dir, "orders").select("o_orderkey", M.leading_zero_bits(h).cast("int").alias("bits")).withColumn("accepted", F.col("bits") >= 6)
