"""Corpus analytics: distances, neighbours, graphs, fits, summaries.

All-pairs work runs in blocks of vectors (``pair_distances``): each pair of blocks is one row with two
arrays, so pairs are made inside a task and only what is asked for leaves it. Spanning trees and
components are rounds of joins on written tables.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; without one only a session in a single process
    gets a temporary folder, as the executors of a cluster would not see it."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quire-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quire/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: rounds of an iteration start from files, not from a long plan."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def l2(a: str | Column, b: str | Column) -> Column:
    """Euclidean distance of two arrays."""
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def pair_distances(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", size: int = 256) -> DataFrame:
    """a, b, d for all pairs a < b of the vectors, block against block."""
    numbered = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, round(vectors.count() / size)))))
    held = numbered.groupBy("block").agg(F.collect_list(F.struct("id", "vec")).alias("of"))
    left, right = held.select(F.col("block").alias("x"), F.col("of").alias("xs")), held.select(F.col("block").alias("y"), F.col("of").alias("ys"))
    both = left.join(right, F.col("x") <= F.col("y")).repartition("x", "y")
    pairs = both.select("x", "y", F.explode("xs").alias("p"), "ys").select("x", "y", "p", F.explode("ys").alias("q")).filter((F.col("x") < F.col("y")) | (F.col("p.id") < F.col("q.id")))
    d = pairs.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b"), l2("p.vec", "q.vec").alias("d"))
    return d


def neighbours(pairs: DataFrame, k: int) -> DataFrame:
    """i, j, d, rank: the k nearest of every vector, by distance and then id."""
    both = pairs.select(F.col("a").alias("i"), F.col("b").alias("j"), "d").unionByName(pairs.select(F.col("b").alias("i"), F.col("a").alias("j"), "d"))
    best = both.groupBy("i").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "j"))), 1, k).alias("best")) if k > 1 else both.groupBy("i").agg(F.array(F.min(F.struct("d", "j"))).alias("best"))
    return best.select("i", F.posexplode("best").alias("rank", "n")).select("i", F.col("n.j").alias("j"), F.col("n.d").alias("d"), (F.col("rank") + 1).alias("rank"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root: the least node of each one's component. ``edges`` (a, b), ``nodes`` (node).

    Labels move to neighbours and then to the label of their label, so rounds grow with the logarithm of paths.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = written(nodes.select("node", F.col("node").alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        lower = labels.join(near, "node", "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("m", "root")).alias("root"))
        up = lower.select(F.col("node").alias("root"), F.col("root").alias("top"))
        now = written(lower.join(up, "root").select("node", "was", F.least("root", "top").alias("root")), "labels")
        if not now.filter("was <> root").limit(1).count():
            return now.select("node", "root")
        labels = now.select("node", "root")


def spanning_tree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, d: the minimum spanning forest by Boruvka's rounds; equal distances are ordered by a, then b."""
    edges = written(edges.select("a", "b", "d"), "edges")
    root = written(nodes.select("node", F.col("node").alias("root")), "roots")
    tree = None
    while True:
        open_ = edges.join(root.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(root.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").filter("ra <> rb")
        ends = open_.select(F.col("ra").alias("r"), "a", "b", "d").unionByName(open_.select(F.col("rb").alias("r"), "a", "b", "d"))
        best = written(ends.groupBy("r").agg(F.min(F.struct("d", "a", "b")).alias("e")).select("e.*").distinct(), "round")
        if not best.limit(1).count():
            break
        tree = best if tree is None else tree.unionByName(best)
        joined = best.join(root.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(root.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        merged = components(joined.select(F.col("x").alias("a"), F.col("y").alias("b")), root.select(F.col("root").alias("node")).distinct())
        root = written(root.join(merged.select(F.col("node").alias("root"), F.col("root").alias("top")), "root").select("node", F.col("top").alias("root")), "roots")
        edges = written(open_.select("a", "b", "d"), "edges")
    return (tree if tree is not None else edges.limit(0)).select("a", "b", "d")


def purity(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """One row: the share of rows whose label is the commonest of their cluster."""
    counts = df.groupBy(cluster, label).agg(F.count("*").alias("n")).groupBy(cluster).agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return counts.agg((F.sum("top") / F.sum("n")).alias("purity"))


def tiles(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """``tile``: min(place * k div n, k - 1) of each row of its group, in order."""
    w = Window.partitionBy(*by)
    place = F.row_number().over(w.orderBy(*order)) - 1
    return df.withColumn("tile", F.least(F.floor(place * k / F.count("*").over(w)).cast("int"), F.lit(k - 1)))


def line_fit(y: Column, x: Column, name: str) -> list[Column]:
    """Slope, intercept and R squared of the least-squares line."""
    return [F.round(F.regr_slope(y, x), 6).alias(f"{name}_slope"), F.round(F.regr_intercept(y, x), 6).alias(f"{name}_intercept"), F.round(F.regr_r2(y, x), 6).alias(f"{name}_r2")]


def histogram_entropy(df: DataFrame, x: str, bins: int) -> DataFrame:
    """One row: bits of the histogram of equal bins between the least and largest value; the last bin is closed."""
    ends = F.broadcast(df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi")))
    place = F.least(F.floor((F.col(x) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
    counts = df.crossJoin(ends).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return counts.crossJoin(F.broadcast(total)).agg((-F.sum(p * F.log2(p))).alias("bits"))


def interpolated(curve: DataFrame, points: DataFrame, by: list[str], x: str, y: str, at: str) -> DataFrame:
    """``points`` with the curve's y at ``at``: linear between the curve's neighbours, held at its ends.

    An as-of look-up: points and curve are united and sorted together within a group, and the last curve
    point before and the first after come from two running windows; nothing is paired.
    """
    c = curve.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"), F.lit(0).alias("_k"), F.lit(None).cast(points.schema[at].dataType).alias(at), *[F.lit(None).cast(f.dataType).alias(f.name) for f in points.schema if f.name not in (*by, at)])
    p = points.withColumn("_x", F.col(at).cast("double")).withColumn("_y", F.lit(None).cast("double")).withColumn("_k", F.lit(1))
    both = c.unionByName(p)
    curve_point = F.when(F.col("_k") == 0, F.struct("_x", "_y"))
    w = Window.partitionBy(*by).orderBy("_x", "_k")
    lo = F.last(curve_point, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    hi = F.first(curve_point, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    placed = both.withColumn("_lo", lo).withColumn("_hi", hi).filter("_k = 1")
    lerp = F.when(F.col("_lo").isNull(), F.col("_hi._y")).when(F.col("_hi").isNull() | (F.col("_hi._x") == F.col("_lo._x")), F.col("_lo._y"))
    lerp = lerp.otherwise(F.col("_lo._y") + (F.col("_hi._y") - F.col("_lo._y")) * (F.col(at) - F.col("_lo._x")) / (F.col("_hi._x") - F.col("_lo._x")))
    return placed.withColumn(y, lerp).select(*points.columns, y)


def new_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All of ``new``, and what ``old`` has under other keys."""
    return new.unionByName(old.join(new, keys, "left_anti"))


def chain_lengths(parents: DataFrame, most: int = 64) -> DataFrame:
    """node, depth: steps from each node (node, parent) to one without a parent; raises if a chain is longer than ``most``."""
    depth = written(parents.filter("parent IS NULL").select("node", F.lit(0).alias("depth")), "depth")
    rest = parents.filter("parent IS NOT NULL")
    done = depth
    for _ in range(most):
        step = written(rest.join(depth.select(F.col("node").alias("parent"), "depth"), "parent").select("node", (F.col("depth") + 1).alias("depth")), "depth")
        if not step.limit(1).count():
            return done
        done, depth = done.unionByName(step), step
    raise ValueError(f"a chain is longer than {most}")


def average_linkage(pairs: DataFrame, clusters: int, most: int = 500) -> DataFrame:
    """node, cluster: agglomerative clustering by mean distance, cut at so many clusters, for at most ``most`` nodes
    (more are an error: the method needs the whole matrix in one place). Ties go to the smaller nodes."""
    import numpy as np

    spark = pairs.sparkSession
    if pairs.select("a").union(pairs.select("b")).distinct().count() > most:
        raise ValueError(f"more than {most} nodes; use a clustering that scales, such as k-means")
    got = pairs.select("a", "b", "d").toPandas()
    nodes = np.unique(np.concatenate([got["a"], got["b"]]))
    n = len(nodes)
    d = np.full((n, n), np.inf)
    a, b = np.searchsorted(nodes, got["a"]), np.searchsorted(nodes, got["b"])
    d[a, b] = d[b, a] = got["d"]
    size, label, alive = np.ones(n), np.arange(n), n
    while alive > max(1, clusters):
        i, j = sorted(divmod(int(np.argmin(d)), n))
        mean = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = mean, mean
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
        alive -= 1
    return spark.createDataFrame([(int(x), int(nodes[k])) for x, k in zip(nodes, label, strict=True)], "node long, cluster long")
