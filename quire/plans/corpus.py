"""Queries of corpus analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import corpus as A
from quire.operators import tiles as T
from quire.operators.signals import table
from quire.plans.registry import query
from quire.plans.transforms import CELLS, PLANE, cells, plane

#: SQL for the distance of two embeddings, in doubles.
_DIST = "sqrt(list_sum(list_transform(range(1, 65), lambda k: (a.embedding[k]::DOUBLE - b.embedding[k]::DOUBLE) ** 2)))"
_PAIRS = f"pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb, {_DIST} AS d FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"
_BOTH = f"{_PAIRS}, both_ AS (SELECT a AS i, b AS j, la AS li, lb AS lj, round(d, 9) AS d FROM pairs UNION ALL SELECT b, a, lb, la, round(d, 9) FROM pairs), nn AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM both_)"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def labels(spark, sf_dir, name, label):
    return vectors(spark, sf_dir).select(F.col("vec_id").alias(name), F.col("label").alias(label))


@query("SELECT count(*) AS texts, count(DISTINCT sha256(encode(text))) AS distinct_texts, count(*) - count(DISTINCT sha256(encode(text))) AS repeats FROM documents")
def exact_dedup(spark, sf_dir):
    by = table(spark, sf_dir, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(F.count("*").alias("n"))
    return by.agg(F.sum("n").alias("texts"), F.count("*").alias("distinct_texts"), (F.sum("n") - F.count("*")).alias("repeats"))


@query(f"WITH {_PAIRS} SELECT a, b, round(round(d, 9), 6) AS d FROM pairs")
def pairwise_l2(spark, sf_dir):
    return T.pairs(vectors(spark, sf_dir), 6)


@query(f"WITH {_PAIRS} SELECT round(avg(d) FILTER (la = lb), 6) AS same_mean, round(stddev_pop(d) FILTER (la = lb), 6) AS same_std, round(avg(d) FILTER (la <> lb), 6) AS other_mean, round(avg(d) FILTER (la <> lb) / avg(d) FILTER (la = lb), 6) AS separation FROM pairs")
def pair_separation(spark, sf_dir):
    r = lambda c, name: F.round(c, 6).alias(name)
    return T.separation(vectors(spark, sf_dir), "label").select(r("mean", "same_mean"), r("std", "same_std"), r("others_mean", "other_mean"), r(F.col("others_mean") / F.col("mean"), "separation"))


@query(f"WITH {_BOTH} SELECT round(avg(CASE WHEN li = lj THEN 1 ELSE 0 END), 6) AS accuracy, count(*) AS n FROM nn WHERE rank = 1")
def nn_accuracy(spark, sf_dir):
    n = T.neighbours(vectors(spark, sf_dir), 1).join(labels(spark, sf_dir, "i", "li"), "i").join(labels(spark, sf_dir, "j", "lj"), "j")
    return n.agg(F.round(F.avg((F.col("li") == F.col("lj")).cast("int")), 6).alias("accuracy"), F.count("*").alias("n"))


@query(f"WITH {_BOTH} SELECT i, k, round(avg(e.embedding[1]::DOUBLE), 6) AS first, round(avg(e.embedding[64]::DOUBLE), 6) AS last FROM nn JOIN embeddings e ON e.vec_id = j, (SELECT unnest([1, 3, 5]) AS k) WHERE rank <= k GROUP BY ALL")
def knn_mean(spark, sf_dir):
    n = T.neighbours(vectors(spark, sf_dir), 5).withColumn("k", F.explode(F.array(*map(F.lit, (1, 3, 5))))).filter("rank <= k")
    v = vectors(spark, sf_dir).select(F.col("vec_id").alias("j"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(63)).cast("double").alias("y"))
    return n.join(v, "j").groupBy("i", "k").agg(F.round(F.avg("x"), 6).alias("first"), F.round(F.avg("y"), 6).alias("last"))


@query(f"WITH {_BOTH} SELECT round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, round(min(d), 6) AS lo, round(max(d), 6) AS hi, round(quantile_cont(d, 0.5), 6) AS median, round(stddev_pop(d) / avg(d), 6) AS cv FROM nn WHERE rank = 1")
def nn_stats(spark, sf_dir):
    n = T.neighbours(vectors(spark, sf_dir), 1)
    r = lambda c, name: F.round(c, 6).alias(name)
    return n.agg(r(F.avg("d"), "mean"), r(F.stddev_pop("d"), "std"), r(F.min("d"), "lo"), r(F.max("d"), "hi"), r(F.percentile("d", 0.5), "median"), r(F.stddev_pop("d") / F.avg("d"), "cv"))


@query("WITH v AS (SELECT embedding[1]::DOUBLE AS x FROM embeddings), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v), h AS (SELECT least(floor((x - lo) / (hi - lo) * 20), 19) AS bin, count(*) AS n FROM v, e GROUP BY 1) SELECT round(-sum(n / t * log2(n / t)), 6) AS bits FROM h, (SELECT sum(n) AS t FROM h)")
def hist_entropy(spark, sf_dir):
    v = vectors(spark, sf_dir).select(F.get("embedding", F.lit(0)).cast("double").alias("x"))
    return A.histogram_entropy(v, "x", 20).withColumn("bits", F.round("bits", 6))


@query()
def mst(spark, sf_dir):
    """The minimum spanning tree over the distances of all vectors."""
    v = vectors(spark, sf_dir)
    return T.edges_of(v, T.spanning_tree(v)).withColumn("d", F.round("d", 6))


@query()
def ancestry_purity(spark, sf_dir):
    """Share of spanning-tree edges whose ends have one label."""
    v = vectors(spark, sf_dir)
    tree = T.edges_of(v, T.spanning_tree(v))
    both = tree.join(labels(spark, sf_dir, "a", "la"), "a").join(labels(spark, sf_dir, "b", "lb"), "b")
    return both.agg(F.round(F.avg((F.col("la") == F.col("lb")).cast("int")), 6).alias("purity"), F.count("*").alias("edges"))


@query("WITH c AS (SELECT user_id % 7 AS cluster, event_type, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT cluster, max(n) AS top, sum(n) AS n FROM c GROUP BY 1) SELECT round(sum(top) / sum(n), 6) AS purity FROM m")
def purity(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("cluster", F.col("user_id") % 7)
    return A.purity(e, "cluster", "event_type").withColumn("purity", F.round("purity", 6))


@query("WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_shipdate) - 1 AS place, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(least(place * 5 // n, 4) AS INT) AS tile FROM r")
def difficulty_tiles(spark, sf_dir):
    t = A.tiles(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"], 5)
    return t.select("l_orderkey", "l_linenumber", "tile")


_WALK = "walk(blk, node, root) AS (SELECT blk, node, node FROM on_ UNION SELECT o.blk, o.node, w.root FROM walk w JOIN on_ o ON o.blk = w.blk AND ((abs(o.node - w.node) = 8) OR (abs(o.node - w.node) = 1 AND o.node // 8 = w.node // 8))), piece AS (SELECT blk, node, min(root) AS root FROM walk GROUP BY ALL)"


def _pieces(p):
    """Places (blk, i, j) with the root of their 4-connected piece."""
    on = p.select("blk", "i", "j", (F.col("blk") * 64 + F.col("i") * 8 + F.col("j")).alias("node"))
    right = on.select("blk", "i", (F.col("j") - 1).alias("j"), F.col("node").alias("b"))
    down = on.select("blk", (F.col("i") - 1).alias("i"), "j", F.col("node").alias("b"))
    edges = on.join(right, ["blk", "i", "j"]).unionByName(on.join(down, ["blk", "i", "j"])).select(F.col("node").alias("a"), "b")
    return on.join(A.components(edges, on.select("node")), "node")


@query(f"WITH RECURSIVE {PLANE}, on_ AS (SELECT blk, i * 8 + j AS node FROM plane WHERE v >= 140), {_WALK} SELECT blk, count(DISTINCT root) AS pieces FROM piece GROUP BY blk")
def betti0(spark, sf_dir):
    """Pieces of bright places in each block."""
    return _pieces(plane(spark, sf_dir).filter("v >= 140")).groupBy("blk").agg(F.count_distinct("root").alias("pieces"))


@query(f"WITH RECURSIVE {PLANE}, on_ AS (SELECT blk, i * 8 + j AS node FROM plane WHERE v < 140), {_WALK}, e AS (SELECT blk, root, bool_or(node // 8 IN (0, 7) OR node % 8 IN (0, 7)) AS open FROM piece GROUP BY ALL) SELECT blk, count(*) FILTER (NOT open) AS holes FROM e GROUP BY blk")
def betti1(spark, sf_dir):
    """Dark pieces that bright places enclose, so that none of them lies at the edge."""
    edge = F.col("i").isin(0, 7) | F.col("j").isin(0, 7)
    e = _pieces(plane(spark, sf_dir).filter("v < 140")).groupBy("blk", "root").agg(F.some(edge).alias("open"))
    return e.groupBy("blk").agg(F.count_if(~F.col("open")).alias("holes"))


@query()
def vr_components(spark, sf_dir):
    """Components and loops of the graph of all vectors closer than 0.9."""
    v = vectors(spark, sf_dir)
    tree = len(T.spanning_tree(v, below=0.9))
    n = F.col("v") - tree
    return v.agg(F.count("*").alias("v")).crossJoin(F.broadcast(T.count_below(v, 0.9))).select("v", "e", n.alias("components"), (F.col("e") - tree).alias("loops"))


_SCALE = "s AS (SELECT l_orderkey % 40 + 1 AS n, sum(l_extendedprice) / 1000 AS y FROM lineitem WHERE l_orderkey % 40 < l_linenumber * 8 GROUP BY 1)"


@query(f"WITH {_SCALE} SELECT round(regr_slope(y, n), 6) AS linear_slope, round(regr_intercept(y, n), 6) AS linear_intercept, round(regr_r2(y, n), 6) AS linear_r2, round(regr_slope(y, ln(n)), 6) AS log_slope, round(regr_intercept(y, ln(n)), 6) AS log_intercept, round(regr_r2(y, ln(n)), 6) AS log_r2, round(regr_slope(ln(y), ln(n)), 6) AS power_slope, round(regr_intercept(ln(y), ln(n)), 6) AS power_intercept, round(regr_r2(ln(y), ln(n)), 6) AS power_r2, round(regr_intercept(y, n) + regr_slope(y, n) * 100, 4) AS at_100 FROM s")
def scaling_fit(spark, sf_dir):
    n = (F.col("l_orderkey") % 40 + 1).alias("n")
    s = table(spark, sf_dir, "lineitem").filter("l_orderkey % 40 < l_linenumber * 8").groupBy(n).agg((F.sum("l_extendedprice") / 1000).alias("y"))
    y, x = F.col("y"), F.col("n").cast("double")
    return s.agg(*A.line_fit(y, x, "linear"), *A.line_fit(y, F.ln(x), "log"), *A.line_fit(F.ln(y), F.ln(x), "power"), F.round(F.regr_intercept(y, x) + F.regr_slope(y, x) * 100, 4).alias("at_100"))


@query("SELECT round(corr(l_extendedprice, l_quantity), 6) AS price_quantity, round(corr(l_discount, l_tax), 6) AS discount_tax FROM lineitem")
def corr_complexity(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.round(F.corr("l_extendedprice", "l_quantity"), 6).alias("price_quantity"), F.round(F.corr("l_discount", "l_tax"), 6).alias("discount_tax"))


@query("WITH s AS (SELECT event_type, user_id % 5 AS seed, avg(value) AS m FROM events GROUP BY ALL) SELECT event_type, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std, count(*) AS seeds FROM s GROUP BY 1")
def two_level_agg(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 5).alias("seed")).agg(F.avg("value").alias("m"))
    return s.groupBy("event_type").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_pop("m"), 6).alias("std"), F.count("*").alias("seeds"))


@query("SELECT o_orderkey, o_totalprice * 2 AS price, 'new' AS src FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_totalprice, 'old' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0")
def merge_new_wins(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    new = o.filter("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("price"), F.lit("new").alias("src"))
    old = o.filter("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_totalprice").alias("price"), F.lit("old").alias("src"))
    return A.new_wins(old, new, ["o_orderkey"])


_CURVE = "curve AS (SELECT l_returnflag AS flag, l_quantity AS x, avg(l_extendedprice) AS y FROM lineitem WHERE CAST(l_quantity AS INT) % 7 = 0 GROUP BY ALL)"


@query(f"WITH {_CURVE}, p AS (SELECT l_returnflag AS flag, l_quantity AS spot FROM lineitem GROUP BY ALL), b AS (SELECT p.flag, p.spot, max(c.x) FILTER (c.x <= p.spot) AS lx, arg_max(c.y, c.x) FILTER (c.x <= p.spot) AS ly, min(c.x) FILTER (c.x >= p.spot) AS hx, arg_min(c.y, c.x) FILTER (c.x >= p.spot) AS hy FROM p JOIN curve c ON c.flag = p.flag GROUP BY ALL) SELECT flag, spot, round(CASE WHEN lx IS NULL THEN hy WHEN hx IS NULL OR hx = lx THEN ly ELSE ly + (hy - ly) * (spot - lx) / (hx - lx) END, 5) AS y FROM b")
def rd_interp(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    curve = line.filter("CAST(l_quantity AS INT) % 7 = 0").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("x")).agg(F.avg("l_extendedprice").alias("y"))
    points = line.select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("spot")).distinct()
    return A.interpolated(curve, points, ["flag"], "x", "y", "spot").withColumn("y", F.round("y", 5))


@query(f"WITH {_CURVE} SELECT flag, round(arg_min(x, (abs(x - 30), x)), 6) AS x, round(arg_min(y, (abs(x - 30), x)), 5) AS y FROM curve GROUP BY flag")
def nearest_point(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").filter("CAST(l_quantity AS INT) % 7 = 0")
    curve = line.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("x")).agg(F.avg("l_extendedprice").alias("y"))
    gap = F.struct(F.abs(F.col("x") - 30), "x")
    return curve.groupBy("flag").agg(F.round(F.min_by("x", gap), 6).alias("x"), F.round(F.min_by("y", gap), 5).alias("y"))


@query("WITH d AS (SELECT c_nationkey AS dep, count(*) AS indegree FROM customer GROUP BY 1), s AS (SELECT c_nationkey AS dep, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_mktsegment <> 'BUILDING') AS other, round(avg(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END), 6) AS success FROM customer GROUP BY 1) SELECT dep, indegree, building, other, success FROM d JOIN s USING (dep)")
def indegree_pivot(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("dep"), F.when(F.col("c_mktsegment") == "BUILDING", "building").otherwise("other").alias("kind"), "c_acctbal")
    wide = c.groupBy("dep").pivot("kind", ["building", "other"]).count().fillna(0)
    stats = c.groupBy("dep").agg(F.count("*").alias("indegree"), F.round(F.avg((F.col("c_acctbal") > 0).cast("int")), 6).alias("success"))
    return wide.join(stats, "dep").select("dep", "indegree", "building", "other", "success")


@query("WITH RECURSIVE g AS (SELECT 1000000 + c_custkey AS node, 1000 + c_nationkey AS parent FROM customer UNION ALL SELECT 1000 + n_nationkey, n_regionkey FROM nation UNION ALL SELECT r_regionkey, NULL FROM region), w AS (SELECT node, 0 AS depth FROM g WHERE parent IS NULL UNION ALL SELECT g.node, depth + 1 FROM w JOIN g ON g.parent = w.node) SELECT depth, count(*) AS nodes FROM w GROUP BY 1")
def chain_length(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000000).alias("node"), (F.col("c_nationkey") + 1000).cast("long").alias("parent"))
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1000).cast("long").alias("node"), F.col("n_regionkey").cast("long").alias("parent"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("node"), F.lit(None).cast("long").alias("parent"))
    return A.chain_lengths(c.unionByName(n).unionByName(r)).groupBy("depth").agg(F.count("*").alias("nodes"))


@query("WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, abs(value) AS v FROM events) SELECT user_id, round(regr_slope(ln(v + 1e-10), n), 6) AS decay, round(regr_slope(ln(v + 1), ln(n)), 6) AS exponent FROM s WHERE n <= 100 GROUP BY user_id HAVING count(*) > 2")
def loglog_slope(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    s = table(spark, sf_dir, "events").select("user_id", n.alias("n"), F.abs("value").alias("v")).filter("n <= 100")
    fit = s.groupBy("user_id").agg(F.count("*").alias("c"), F.round(F.regr_slope(F.ln(F.col("v") + 1e-10), F.col("n")), 6).alias("decay"), F.round(F.regr_slope(F.ln(F.col("v") + 1), F.ln("n")), 6).alias("exponent"))
    return fit.filter("c > 2").drop("c")


@query("WITH g AS (SELECT p_brand AS name, round(avg(p_retailprice), 6) AS v FROM part GROUP BY 1) SELECT name, v, rank() OVER (ORDER BY v DESC) AS rank, round(max(v) OVER () - min(v) OVER (), 6) AS spread FROM g")
def stability_rank(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.round(F.avg("p_retailprice"), 6).alias("v"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return g.select("name", "v", F.rank().over(Window.orderBy(F.col("v").desc())).cast("long").alias("rank"), F.round(F.max("v").over(every) - F.min("v").over(every), 6).alias("spread"))


@query("SELECT p_brand AS name, n, round(sum(p_retailprice) / n + avg(p_size), 6) AS cost FROM part, (SELECT unnest([10, 50, 100, 1000]) AS n) GROUP BY p_brand, n")
def amortised_cost(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.sum("p_retailprice").alias("s"), F.avg("p_size").alias("a"))
    return g.withColumn("n", F.explode(F.array(*map(F.lit, (10, 50, 100, 1000))))).select("name", "n", F.round(F.col("s") / F.col("n") + F.col("a"), 6).alias("cost"))


@query("WITH s AS (SELECT l_extendedprice AS x FROM lineitem ORDER BY l_orderkey, l_linenumber, l_extendedprice LIMIT 5) SELECT round(avg(x) * (SELECT count(*) FROM lineitem), 4) AS estimate FROM s")
def extrapolated(spark, sf_dir):
    """Mean of the first five, times the number of all."""
    line = table(spark, sf_dir, "lineitem")
    first = line.orderBy("l_orderkey", "l_linenumber", "l_extendedprice").limit(5).agg(F.avg("l_extendedprice").alias("m"))
    return first.crossJoin(F.broadcast(line.agg(F.count("*").alias("n")))).select(F.round(F.col("m") * F.col("n"), 4).alias("estimate"))


@query("SELECT l_returnflag AS method, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice), 2) AS original, round(sum(l_extendedprice * (1 - l_discount)), 2) AS packed FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def method_breakdown(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup(F.col("l_returnflag").alias("method")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("original"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("packed"))


@query("SELECT l_orderkey, l_linenumber, list_sort([{'v': l_quantity / 50, 'm': 'quantity'}, {'v': l_discount * 10, 'm': 'discount'}, {'v': l_tax * 12, 'm': 'tax'}])[1].m AS best FROM lineitem")
def best_method_per_row(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("quantity"), (F.col("l_discount") * 10).alias("discount"), (F.col("l_tax") * 12).alias("tax"))
    long = F.array(*[F.struct(F.col(c).alias("v"), F.lit(c).alias("method")) for c in ("quantity", "discount", "tax")])
    return wide.select("l_orderkey", "l_linenumber", F.array_min(long)["method"].alias("best"))


@query("SELECT p_type AS id, arg_min(p_brand, (p_size, p_partkey)) FILTER (p_retailprice > 950) AS name FROM part GROUP BY 1")
def filtered_argmin(spark, sf_dir):
    fits = F.col("p_retailprice") > 950
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("id")).agg(F.min_by(F.when(fits, F.col("p_brand")), F.when(fits, F.struct("p_size", "p_partkey"))).alias("name"))


@query(f"WITH {CELLS} SELECT blk, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS lo, round(max(v), 6) AS hi, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.75), 6) AS p75 FROM cells GROUP BY blk")
def feature_summary(spark, sf_dir):
    r = lambda c, name: F.round(c, 6).alias(name)
    return cells(spark, sf_dir).groupBy("blk").agg(r(F.avg("v"), "mean"), r(F.stddev_pop("v"), "std"), r(F.min("v"), "lo"), r(F.max("v"), "hi"), r(F.percentile("v", 0.25), "p25"), r(F.percentile("v", 0.75), "p75"))


@query(f"WITH {CELLS}, d AS (SELECT blk, v, v - lag(v) OVER (PARTITION BY blk, i ORDER BY j) AS dx, v - lag(v) OVER (PARTITION BY blk, j ORDER BY i) AS dy FROM cells) SELECT blk, round(avg(abs(dx)), 6) AS across, round(avg(abs(dy)), 6) AS down, round(max(v) - min(v), 6) AS span, round(stddev_pop(v), 6) AS std FROM d GROUP BY blk")
def quality_summary(spark, sf_dir):
    row, col = Window.partitionBy("blk", "i").orderBy("j"), Window.partitionBy("blk", "j").orderBy("i")
    d = cells(spark, sf_dir).withColumn("dx", F.col("v") - F.lag("v").over(row)).withColumn("dy", F.col("v") - F.lag("v").over(col))
    r = lambda c, name: F.round(c, 6).alias(name)
    return d.groupBy("blk").agg(r(F.avg(F.abs("dx")), "across"), r(F.avg(F.abs("dy")), "down"), r(F.max("v") - F.min("v"), "span"), r(F.stddev_pop("v"), "std"))


@query("WITH s AS (SELECT c_custkey, c_acctbal, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer) SELECT CASE WHEN n <= 2 THEN 'single' ELSE 'shared' END AS route, count(*) AS images, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 6) AS mean FROM s GROUP BY 1")
def route_by_group(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    sized = c.join(c.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")), ["c_nationkey", "c_mktsegment"])
    return sized.groupBy(F.when(F.col("n") <= 2, "single").otherwise("shared").alias("route")).agg(F.count("*").alias("images"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.round(F.avg("c_acctbal"), 6).alias("mean"))


@query("SELECT p_brand, p_size % 5 AS threshold, round(avg(p_retailprice), 6) AS mean, round(stddev_pop(p_retailprice), 6) AS std, count(*) AS runs, array_to_string(list_sort(list(DISTINCT p_size)), ',') AS seeds FROM part GROUP BY ALL")
def sweep_summary(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy("p_brand", (F.col("p_size") % 5).alias("threshold"))
    return g.agg(F.round(F.avg("p_retailprice"), 6).alias("mean"), F.round(F.stddev_pop("p_retailprice"), 6).alias("std"), F.count("*").alias("runs"), F.array_join(F.array_sort(F.collect_set("p_size")), ",").alias("seeds"))


@query("WITH b AS (SELECT avg(p_retailprice) / 30 AS q FROM part) SELECT p_partkey, round(p_size * 100 / pow(2, (p_retailprice / 30 - q) / 6), 6) AS equal_size FROM part, b")
def size_at_equal_quality(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    base = p.agg((F.avg("p_retailprice") / 30).alias("q"))
    return p.crossJoin(F.broadcast(base)).select("p_partkey", F.round(F.col("p_size") * 100 / F.pow(F.lit(2.0), (F.col("p_retailprice") / 30 - F.col("q")) / 6), 6).alias("equal_size"))


@query("WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) SELECT o_orderkey, o_custkey, k FROM r WHERE k <= 3 ORDER BY o_custkey, k LIMIT 200")
def source_quota(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", k.alias("k")).filter("k <= 3").orderBy("o_custkey", "k").limit(200)


@query()
def linkage_purity(spark, sf_dir):
    """Average-linkage clusters of all vectors and their purity by label."""
    c = T.linkage(vectors(spark, sf_dir), 8)
    return A.purity(c.join(labels(spark, sf_dir, "node", "label"), "node"), "cluster", "label")
