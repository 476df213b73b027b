"""Queries of symbol coding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import codecs
from quire.operators import coding as C
from quire.operators import quantise as Q
from quire.operators import transforms as T
from quire.operators.signals import table
from quire.plans.quantisation import WEIGHTS, weights
from quire.plans.registry import query
from quire.plans.transforms import PIXELS, PLANE, cells, pixels, plane

_ZIGZAG = "zz AS (SELECT CAST(row_number() OVER (ORDER BY i + j, CASE WHEN (i + j) % 2 = 0 THEN j ELSE i END) - 1 AS INT) AS k, CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM range(8) a(i), range(8) b(j))"
#: A sparse integer block: bytes of the plane, most of them set to zero.
_SPARSE = f"{PLANE}, {_ZIGZAG}, seq AS (SELECT blk, k, CASE WHEN v % 11 = 0 THEN v - 128 ELSE 0 END AS q FROM plane JOIN zz USING (i, j))"


def _sequences(spark, sf_dir):
    p = plane(spark, sf_dir).join(C.zigzag(spark), ["i", "j"])
    return p.select("blk", "k", F.when(F.col("v") % 11 == 0, F.col("v") - 128).otherwise(0).alias("q"))


@query(f"WITH {_ZIGZAG} SELECT * FROM zz")
def zigzag_scan(spark, sf_dir):
    return C.zigzag(spark)


@query(f"""WITH {_SPARSE}, nz AS (SELECT blk, k, q, k - lag(k, 1, -1) OVER (PARTITION BY blk ORDER BY k) - 1 AS gap FROM seq WHERE q <> 0),
p AS (SELECT blk, k, s AS sub, CASE WHEN s < gap // 16 THEN 15 ELSE gap % 16 END AS run, CASE WHEN s < gap // 16 THEN 0 ELSE q END AS value FROM (SELECT *, unnest(range(gap // 16 + 1)) AS s FROM nz)
UNION ALL SELECT blk, 64, 0, 0, 0 FROM (SELECT blk, max(k) FILTER (q <> 0) AS m FROM seq GROUP BY blk) WHERE coalesce(m, -1) < 63)
SELECT blk, CAST(row_number() OVER (PARTITION BY blk ORDER BY k, sub) - 1 AS INT) AS ord, CAST(run AS INT) AS run, CAST(value AS INT) AS value FROM p""")
def zigzag_rle(spark, sf_dir):
    return C.run_lengths(_sequences(spark, sf_dir), ["blk"]).select("blk", "ord", "run", "value")


@query(f"WITH {_SPARSE} SELECT blk, k, CAST(q AS INT) AS q FROM seq")
def unrle_roundtrip(spark, sf_dir):
    return C.unrun_lengths(C.run_lengths(_sequences(spark, sf_dir), ["blk"]), ["blk"])


@query(f"WITH {PIXELS} SELECT k % 50 AS img, count(DISTINCT (r, g, b)) AS colours, count(DISTINCT (r, g, b)) <= 256 AS palette FROM pixels GROUP BY ALL")
def use_palette(spark, sf_dir):
    return C.colours(pixels(spark, sf_dir).withColumn("img", F.col("k") % 50), ["img"])


@query(f"WITH {PIXELS}, p AS (SELECT *, k % 50 AS img FROM pixels) SELECT img, k, n, CAST(dense_rank() OVER (PARTITION BY img ORDER BY r, g, b) - 1 AS INT) AS idx FROM p")
def palette(spark, sf_dir):
    return C.palette(pixels(spark, sf_dir).withColumn("img", F.col("k") % 50), ["img"]).select("img", "k", "n", "idx")


@query(f"WITH {PIXELS} SELECT k, n, r, g, b FROM pixels")
def palette_roundtrip(spark, sf_dir):
    coded = C.palette(pixels(spark, sf_dir).withColumn("img", F.col("k") % 50), ["img"])
    colours = coded.select("img", "idx", "r", "g", "b").distinct()
    return coded.select("img", "k", "n", "idx").join(colours, ["img", "idx"]).select("k", "n", "r", "g", "b")


_LINES = "lines AS (SELECT event_id, event_type || ' user ' || user_id || ' at ' || strftime(ts, '%H:%M') || ' ' || props AS line, event_type FROM events)"


def _lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "event_type", F.concat("event_type", F.lit(" user "), F.col("user_id").cast("string"), F.lit(" at "), F.date_format("ts", "HH:mm"), F.lit(" "), "props").alias("line"))


@query(rf"WITH {_LINES}, t AS (SELECT event_type, regexp_replace(line, '\d+', '{{}}', 'g') AS template, regexp_extract_all(line, '\d+\.?\d*') AS vars FROM lines), g AS (SELECT event_type, template, count(*) AS n, max(len(vars)) AS vars FROM t GROUP BY ALL) SELECT *, count(*) OVER (PARTITION BY event_type) = 1 AS single FROM g")
def log_template(spark, sf_dir):
    template, numbers = C.log_template(F.col("line"))
    t = _lines(spark, sf_dir).withColumn("template", template).withColumn("vars", F.size(numbers))
    g = t.groupBy("event_type", "template").agg(F.count("*").alias("n"), F.max("vars").cast("long").alias("vars"))
    return g.withColumn("single", F.count("*").over(Window.partitionBy("event_type")) == 1)


@query("SELECT event_id, json_keys(props)[1] AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get(F.json_object_keys("props"), F.lit(0)).alias("key"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, min(len(string_split(line, '|'))) AS narrowest, max(len(string_split(line, '|'))) AS widest, min(len(string_split(line, '|'))) = max(len(string_split(line, '|'))) AS regular FROM l GROUP BY doc_id")
def csv_shape(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    width = F.size(F.split("line", r"\|")).cast("long")
    return lines.groupBy("doc_id").agg(F.min(width).alias("narrowest"), F.max(width).alias("widest")).withColumn("regular", F.col("narrowest") == F.col("widest"))


@query("SELECT 'page' AS src, page_id AS id, CASE WHEN lower(substr(trim(html), 1, 9)) = '<!doctype' THEN 'html' WHEN trim(html) LIKE '[%]' OR trim(html) LIKE '{%}' THEN 'json' WHEN html = '' THEN 'empty' ELSE 'text' END AS kind FROM pages UNION ALL SELECT 'event', event_id, CASE WHEN props LIKE '{%}' THEN 'json' ELSE 'text' END FROM events")
def file_type(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("src"), F.col("page_id").alias("id"), F.col("html").cast("binary").alias("data"))
    events = table(spark, sf_dir, "events").select(F.lit("event").alias("src"), F.col("event_id").alias("id"), F.col("props").cast("binary").alias("data"))
    return pages.unionByName(events).select("src", "id", C.file_kind(F.col("data")).alias("kind"))


_CENT = "cents AS (SELECT c, c * 0.06e0 - 0.2e0 AS pos FROM range(8) r(c))"


@query(f"WITH {WEIGHTS}, {_CENT}, d AS (SELECT vec_id, n, c, abs(w - pos) AS d, row_number() OVER (PARTITION BY vec_id, n ORDER BY abs(w - pos), c) AS rk FROM weights, cents) SELECT vec_id, n, CAST(c AS INT) AS c, round(d, 7) AS d FROM d WHERE rk = 1")
def nearest_centroid(spark, sf_dir):
    cents = spark.range(8).select(F.col("id").cast("int").alias("c"), (F.col("id") * F.lit(0.06) - F.lit(0.2)).alias("at"))
    return C.nearest(weights(spark, sf_dir), cents, "w").select("vec_id", "n", "c", F.round("d", 7).alias("d"))


@query(f"WITH {WEIGHTS}, {_CENT}, d AS (SELECT layer, vec_id, n, c, row_number() OVER (PARTITION BY vec_id, n ORDER BY abs(w - pos), c) AS rk FROM weights, cents), h AS (SELECT layer, c, count(*) AS n FROM d WHERE rk = 1 GROUP BY ALL), p AS (SELECT layer, n, n / sum(n) OVER (PARTITION BY layer) AS p FROM h) SELECT layer, CAST(count(*) * 4 AS BIGINT) AS codebook_bytes, round(-sum(n * log2(p)), 4) AS index_bits FROM p GROUP BY layer")
def entropy_code_indices(spark, sf_dir):
    cents = spark.range(8).select(F.col("id").cast("int").alias("c"), (F.col("id") * F.lit(0.06) - F.lit(0.2)).alias("at"))
    h = C.nearest(weights(spark, sf_dir), cents, "w").groupBy("layer", "c").count()
    p = h.withColumn("p", F.col("count") / F.sum("count").over(Window.partitionBy("layer")))
    return p.groupBy("layer").agg((F.count("*") * 4).alias("codebook_bytes"), F.round(-F.sum(F.col("count") * F.log2("p")), 4).alias("index_bits"))


@query("SELECT doc_id, text FROM documents")
def codec_roundtrip(spark, sf_dir):
    """Every text through each codec and back."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    for codec in codecs.CODECS:
        d = d.withColumn("data", codecs.decompressed(codecs.compressed(F.col("data"), codec), codec))
    return d.select("doc_id", F.col("data").cast("string").alias("text"))


@query()
def codec_sizes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    return d.select("doc_id", F.octet_length("data").alias("bytes"), *(F.octet_length(codecs.compressed(F.col("data"), c)).alias(c) for c in (*codecs.CODECS, "auto")))


@query()
def adaptive_filter(spark, sf_dir):
    """For each block the predictor whose residual compresses best; the first on ties."""
    p = plane(spark, sf_dir)
    every = None
    for rank, kind in enumerate(T.FILTERS):
        f = T.filtered(p, kind, ["blk"]).groupBy("blk").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "f"))), lambda x: F.chr(x.f)).alias("s"))
        f = f.select("blk", F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.encode(F.array_join("s", ""), "ISO-8859-1").alias("data"))
        every = f if every is None else every.unionByName(f)
    sized = every.withColumn("size", F.octet_length(codecs.compressed(F.col("data"), "zlib")))
    return sized.groupBy("blk").agg(F.min_by("kind", F.struct("size", "rank")).alias("kind"), F.min("size").alias("size"))


@query(f"WITH {WEIGHTS}, e AS (SELECT *, min(w) OVER p AS lo, max(w) OVER p AS hi FROM weights WINDOW p AS (PARTITION BY layer)) SELECT vec_id, n, CAST(round_even((w - lo) / ((hi - lo) / 15), 0) AS INT) AS q FROM e")
def arithmetic_roundtrip(spark, sf_dir):
    """Weights as 4-bit integers through the arithmetic coder and back, a vector at a time."""
    q = Q.minmax(weights(spark, sf_dir), ["layer"], 4)
    rows = q.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "q"))), lambda x: x.q).alias("qs"))
    coded = rows.select("vec_id", F.size("qs").alias("len"), codecs.arithmetic_coded(F.col("qs"), 16).alias("code"))
    return coded.select("vec_id", F.posexplode(codecs.arithmetic_decoded(F.col("code"), F.col("len"), 16)).alias("n", "q"))


@query()
def arithmetic_sizes(spark, sf_dir):
    q = Q.minmax(weights(spark, sf_dir), ["layer"], 4)
    rows = q.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "q"))), lambda x: x.q).alias("qs"))
    return rows.select("vec_id", F.octet_length(codecs.arithmetic_coded(F.col("qs"), 16)).alias("bytes"))


@query(f"WITH {WEIGHTS}, d AS (SELECT a.vec_id, a.n, b.w - a.w AS d FROM weights a JOIN weights b ON b.vec_id = a.vec_id + 1 AND a.n = b.n), s AS (SELECT *, max(abs(d)) OVER (PARTITION BY vec_id) AS top FROM d) SELECT vec_id, n, CAST(round_even(d / (top / 32767), 0) AS INT) AS q FROM s")
def weight_delta(spark, sf_dir):
    w = weights(spark, sf_dir)
    older = w.select((F.col("vec_id")).alias("vec_id"), "n", F.col("w").alias("a"))
    newer = w.select((F.col("vec_id") - 1).alias("vec_id"), "n", F.col("w").alias("b"))
    d = older.join(newer, ["vec_id", "n"]).select("vec_id", "n", (F.col("b") - F.col("a")).alias("w"))
    return Q.symmetric(d, ["vec_id"], 32767).select("vec_id", "n", "q")


@query()
def program_or_bytes(spark, sf_dir):
    """For each event line the smaller of its template's variables and its compressed bytes; the first on ties."""
    template, numbers = C.log_template(F.col("line"))
    d = _lines(spark, sf_dir).select("event_id", F.octet_length(F.array_join(numbers, ",")).alias("program"), F.octet_length(codecs.compressed(F.col("line").cast("binary"), "zlib")).alias("zlib"))
    return d.select("event_id", F.when(F.col("program") <= F.col("zlib"), "program").otherwise("zlib").alias("method"), F.least("program", "zlib").alias("size"))


@query()
def float16_store(spark, sf_dir):
    return cells(spark, sf_dir).select("blk", "i", "j", codecs.half_precision(F.col("v")).alias("v16"))
