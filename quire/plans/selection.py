"""Queries of candidate selection; brands of parts are the candidates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import select as X
from quire.operators.signals import table
from quire.plans.registry import query
from quire.plans.transforms import PIXELS, pixels

#: SQL for candidates: for each type, brands with a size, a time and a quality.
_CANDS = "cands AS (SELECT p_type AS id, p_brand AS name, CAST(round(sum(p_retailprice)) AS BIGINT) AS size, round(avg(p_size), 6) AS time_ms, round(avg(p_retailprice), 6) AS psnr FROM part GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY name) - 1 AS pos FROM cands)"


def candidates(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("id"), F.col("p_brand").alias("name")).agg(F.round(F.sum("p_retailprice")).cast("long").alias("size"), F.round(F.avg("p_size"), 6).alias("time_ms"), F.round(F.avg("p_retailprice"), 6).alias("psnr"))
    return g.withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy("name")) - 1)


@query(f"WITH {PIXELS}, p AS (SELECT *, k % 50 AS img, lag(b) OVER (PARTITION BY k ORDER BY n, r, g, b) AS before FROM pixels), s AS (SELECT img, count(DISTINCT (r, g, b)) AS colours, avg(abs(b - before)) AS rough, avg((b - before + 256) % 256) AS wrapped FROM p GROUP BY img) SELECT img, colours, CASE WHEN colours <= 256 THEN 'palette' WHEN rough < 5 THEN 'smooth' WHEN rough < 15 THEN 'mixed' ELSE 'photo' END AS kind, round(wrapped, 6) AS wrapped FROM s")
def auto_type(spark, sf_dir):
    p = pixels(spark, sf_dir).withColumn("img", F.col("k") % 50).withColumn("before", F.lag("b").over(Window.partitionBy("k").orderBy("n", "r", "g", "b")))
    s = p.groupBy("img").agg(F.count_distinct("r", "g", "b").alias("colours"), F.avg(F.abs(F.col("b") - F.col("before"))).alias("rough"), F.avg(F.pmod(F.col("b") - F.col("before"), F.lit(256))).alias("wrapped"))
    return s.select("img", "colours", X.image_kind(F.col("colours"), F.col("rough")).alias("kind"), F.round("wrapped", 6).alias("wrapped"))


@query(f"WITH {_CANDS} SELECT id, arg_min(name, (size, pos)) AS name, min(size) AS size FROM c GROUP BY id")
def best_candidate(spark, sf_dir):
    return X.smallest(candidates(spark, sf_dir), ["id"])


@query("WITH p AS (SELECT p_partkey AS id, unnest(range(1, 12)) AS pos, p_retailprice AS x FROM part), s AS (SELECT id, pos, round(abs(sin(x * pos)) * 1000, 3) AS size FROM p) SELECT id, CAST(arg_min(pos, (size, pos)) AS INT) AS name, min(size) AS size FROM s GROUP BY id")
def adaptive_search(spark, sf_dir):
    """Eleven candidates for each row, smallest wins, first on ties."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_retailprice", F.explode(F.sequence(F.lit(1), F.lit(11))).alias("pos"))
    return X.smallest(p.select("id", "pos", F.col("pos").alias("name"), F.round(F.abs(F.sin(F.col("p_retailprice") * F.col("pos"))) * 1000, 3).alias("size")), ["id"])


@query("SELECT p_partkey, CASE WHEN p_size * 20 <= 256 THEN 32 WHEN p_size * 20 <= 512 THEN 64 ELSE 128 END AS hidden, CASE WHEN p_size * 20 <= 256 THEN 2 ELSE 3 END AS layers FROM part")
def auto_tune(spark, sf_dir):
    side = F.col("p_size") * 20
    return table(spark, sf_dir, "part").select("p_partkey", F.when(side <= 256, 32).when(side <= 512, 64).otherwise(128).alias("hidden"), F.when(side <= 256, 2).otherwise(3).alias("layers"))


@query(f"WITH {_CANDS} SELECT id, arg_min(name, (abs(size - 5000), pos)) AS name, arg_min(size, (abs(size - 5000), pos)) AS size FROM c GROUP BY id")
def closest_size(spark, sf_dir):
    return X.closest(candidates(spark, sf_dir).withColumn("target", F.lit(5000)), ["id"], "size", "target")


@query(f"WITH {_CANDS} SELECT id, name, size, time_ms, psnr FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.size <= a.size AND b.time_ms <= a.time_ms AND b.psnr >= a.psnr AND (b.size < a.size OR b.time_ms < a.time_ms OR b.psnr > a.psnr))")
def pareto(spark, sf_dir):
    return X.pareto(candidates(spark, sf_dir).drop("pos"), "name", ["size", "time_ms"], ["psnr"])


@query(f"WITH {_CANDS}, s AS (SELECT id, name, round((CASE WHEN max(psnr) OVER w > min(psnr) OVER w THEN (psnr - min(psnr) OVER w) / (max(psnr) OVER w - min(psnr) OVER w) ELSE 0 END) + 1 - (CASE WHEN max(size) OVER w > min(size) OVER w THEN (size - min(size) OVER w) / (max(size) OVER w - min(size) OVER w) ELSE 0 END), 9) AS score FROM c WINDOW w AS (PARTITION BY id)) SELECT id, arg_max(name, (score, name)) AS best, round(max(score), 6) AS score FROM s GROUP BY id")
def balanced_score(spark, sf_dir):
    s = X.balanced(candidates(spark, sf_dir), ["id"], {"psnr": True, "size": False}).withColumn("score", F.round("score", 9))
    return s.groupBy("id").agg(F.max_by("name", F.struct("score", "name")).alias("best"), F.round(F.max("score"), 6).alias("score"))


@query(f"WITH {_CANDS} SELECT id, arg_min(name, (time_ms, pos)) AS fastest, arg_min(name, (size, pos)) AS smallest, arg_min(name, (-psnr, pos)) AS sharpest, arg_min(name, (size / psnr, pos)) AS best_ratio FROM c GROUP BY id")
def multi_best(spark, sf_dir):
    first = lambda by, name: F.min_by("name", F.struct(by, "pos")).alias(name)
    return candidates(spark, sf_dir).groupBy("id").agg(first(F.col("time_ms"), "fastest"), first(F.col("size"), "smallest"), first(-F.col("psnr"), "sharpest"), first(F.col("size") / F.col("psnr"), "best_ratio"))


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CAST(substr(o_orderpriority, 1, 1) AS INT) DESC, o_orderkey LIMIT 3")
def top_ready(spark, sf_dir):
    rank = F.substring("o_orderpriority", 1, 1).cast("int")
    return table(spark, sf_dir, "orders").orderBy(rank.desc(), "o_orderkey").limit(3).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1")
def maturity_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")).orderBy("status")


@query("SELECT l_returnflag AS mode, count(*) AS files, round(sum(l_extendedprice), 2) AS original, round(sum(l_extendedprice * (1 - l_discount)), 2) AS packed, round(sum(l_extendedprice) / sum(l_extendedprice * (1 - l_discount)), 6) AS ratio, bool_and(l_quantity > 0) AS all_ok FROM lineitem GROUP BY 1")
def batch_totals(spark, sf_dir):
    price, paid = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("mode")).agg(F.count("*").alias("files"), F.round(F.sum(price), 2).alias("original"), F.round(F.sum(paid), 2).alias("packed"), F.round(F.sum(price) / F.sum(paid), 6).alias("ratio"), F.every(F.col("l_quantity") > 0).alias("all_ok"))


@query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders) SELECT o_orderkey, place FROM r WHERE place IN (SELECT CAST(floor(m * (n - 1) / 99) AS BIGINT) FROM range(100) t(m))")
def strided_sample(spark, sf_dir):
    return X.strided(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100)


@query()
def evolve_seeds(spark, sf_dir):
    """Halves of two vectors crossed and mutated by seeded noise; fitness is minus the mean squared error."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    child = e.join(other, "vec_id").withColumn("child", F.zip_with("a", "b", lambda x, y: (x + y) / 2)).withColumn("noise", F.randn(5) * 0.01)
    child = child.withColumn("child", F.transform("child", lambda x: x + F.col("noise")))
    return child.select("vec_id", (-F.aggregate(F.zip_with("a", "child", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / 64).alias("fitness"))
