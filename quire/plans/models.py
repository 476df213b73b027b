"""Queries of models and spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import models as N
from quire.operators.signals import table
from quire.plans.registry import query
from quire.plans.transforms import CELLS, cells

_W = [[[0.5, -0.25], [1.0, 0.75]], [[0.3, -0.6]]]
_B = [[0.1, -0.2], [0.05]]


@query(f"WITH {CELLS}, g AS (SELECT blk, i, j, -1 + i * 2 / 7e0 AS y, -1 + j * 2 / 7e0 AS x FROM cells) SELECT blk, i, j, round(0.05e0 + 0.3e0 * sin(0.1e0 + 0.5e0 * y - 0.25e0 * x) - 0.6e0 * sin(-0.2e0 + y + 0.75e0 * x), 7) AS v FROM g")
def sine_forward(spark, sf_dir):
    at = lambda c: F.lit(-1.0) + F.col(c) * 2 / F.lit(7.0)
    return cells(spark, sf_dir).select("blk", "i", "j", F.round(N.sine_forward(F.array(at("i"), at("j")), _W, _B)[0], 7).alias("v"))


@query()
def sine_fit(spark, sf_dir):
    """A network for every block; its error after training."""
    c = cells(spark, sf_dir).withColumn("y", -1 + F.col("i") * 2 / F.lit(7.0)).withColumn("x", -1 + F.col("j") * 2 / F.lit(7.0))
    return N.sine_fit(c, "blk", steps=60)


@query("SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS c0, round(regr_slope(l_extendedprice, l_quantity), 4) AS c1 FROM lineitem")
def linear_head(spark, sf_dir):
    c = N.linear_head(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(round(float(c[0]), 4), round(float(c[1]), 4))], "c0 double, c1 double")


@query("WITH c AS (SELECT k, var_pop(v) AS v FROM (SELECT unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY k) SELECT round(sum(v), 5) AS total FROM c")
def pca_total(spark, sf_dir):
    """The eigenvalues add up to the variance."""
    return N.spectrum(table(spark, sf_dir, "embeddings")).agg(F.round(F.sum("eigenvalue"), 5).alias("total"))


@query()
def pca_dims(spark, sf_dir):
    """Components for 95 % of the variance, and the effective rank."""
    s = N.spectrum(table(spark, sf_dir, "embeddings"))
    return s.agg((F.count_if(F.col("running") < 0.95) + 1).alias("dims95"), F.exp(-F.sum(F.when(F.col("share") > 0, F.col("share") * F.ln("share")))).alias("effective_rank"))


@query()
def subspace_error(spark, sf_dir):
    return N.projected(table(spark, sf_dir, "embeddings"), 16)


@query()
def feature_kmeans(spark, sf_dir):
    c = cells(spark, sf_dir).groupBy("blk").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return N.kmeans(c, ["mean", "std", "lo", "hi"], 4).groupBy("cluster").agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT a.vec_id, sum((x - y) ** 2 * (k + 1)) AS q FROM (SELECT vec_id, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings) a JOIN (SELECT vec_id - 1 AS vec_id, unnest(range(64)) AS k2, unnest(embedding)::DOUBLE AS y FROM embeddings) b ON a.vec_id = b.vec_id AND k = k2 GROUP BY 1) SELECT vec_id, round(sqrt(q), 5) AS d FROM p")
def fisher_distance(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    metric = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: k.cast("double"))
    return e.join(b, "vec_id").select("vec_id", F.round(N.fisher_distance("a", "b", metric), 5).alias("d"))


@query()
def sampled_vectors(spark, sf_dir):
    """New vectors from each dimension's mean and sample spread, by a seeded generator."""
    e = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("k", "v"))
    stats = e.groupBy("k").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    return stats.crossJoin(F.broadcast(spark.range(5).select(F.col("id").alias("sample")))).select("sample", "k", (F.col("m") + F.col("s") * F.randn(3)).alias("v"))
