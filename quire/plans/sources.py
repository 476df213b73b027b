"""Queries of sources, recipes and catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators.signals import table
from quire.plans.registry import query
from quire.sources import files as S


@query("SELECT page_id, regexp_extract(lower(url), '\\.([^./]+)$', 1) AS suffix, regexp_extract(lower(url), '\\.([^./]+)$', 1) IN ('png', 'jpg', 'jpeg', 'bmp', 'pgm', 'ppm', 'tif', 'tiff') AS image FROM pages")
def image_suffix(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.suffix(F.col("url")).alias("suffix"), S.is_image(F.col("url")).alias("image"))


@query("SELECT page_id, '/out/' || page_id || '.dct' AS place FROM pages")
def output_paths(spark, sf_dir):
    path = F.concat(F.lit("/in/"), F.col("page_id").cast("string"), F.lit(".png"))
    return table(spark, sf_dir, "pages").select("page_id", S.output_path(path, "/in", "/out", "dct").alias("place"))


@query("WITH b AS (SELECT event_id, unnest(regexp_extract_all(hex(encode(props)), '..')) AS h FROM events) SELECT event_id, count(*) AS bytes, sum(('0x' || h)::INT)::BIGINT AS total FROM b GROUP BY 1")
def byte_explode(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("props").cast("binary").alias("data"))
    return S.byte_rows(e, "event_id", "data").groupBy("event_id").agg(F.count("*").alias("bytes"), F.sum("byte").alias("total"))


@query("SELECT 'text' AS codec, 1 AS version, doc_id, lang, octet_length(encode(text)) AS size, sha256(encode(text)) AS sha, true AS ok FROM documents")
def recipe_roundtrip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("data", F.col("text").cast("binary"))
    return S.checked(S.recipe(d, "text", 1, "data", ["doc_id", "lang"])).drop("payload")


@query("SELECT codec, count(*) AS recipes, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT CASE WHEN length(text) > 2000 THEN 'long' ELSE 'short' END AS codec, octet_length(encode(text)) AS size FROM documents) GROUP BY 1")
def archive_stats(spark, sf_dir):
    """Recipes by codec; only header columns are read."""
    d = table(spark, sf_dir, "documents").select(F.when(F.length("text") > 2000, "long").otherwise("short").alias("codec"), F.octet_length("text").cast("long").alias("size"))
    return d.groupBy("codec").agg(F.count("*").alias("recipes"), F.sum("size").alias("bytes"))


@query("SELECT event_id, octet_length(encode(props)) + 8 AS size, true AS ok, props FROM events")
def message_roundtrip(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "props", S.message(F.col("props").cast("binary")).alias("framed"))
    payload, ok = S.unmessage(F.col("framed"))
    return e.select("event_id", F.octet_length("framed").cast("long").alias("size"), ok.alias("ok"), payload.cast("string").alias("props"))


@query("SELECT CAST(s AS INT) AS series_id, CAST(n AS INT) AS n, CAST(round_even(8000 * sin(2 * pi() * (s + 1) * n / 64) + 4000 * sin(2 * pi() * 3 * (s + 1) * n / 64), 0) AS INT) AS v FROM range(5) a(s), range(64) b(n)")
def synthetic_waves(spark, sf_dir):
    return S.waves(spark, 5, 64)


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS queued, CAST(sum(least(octet_length(encode(props)), 50000)) AS BIGINT) AS bytes, min(event_id) AS head FROM events GROUP BY 1")
def queue_summary(spark, sf_dir):
    """What a first-in first-out queue with a cap of 50,000 bytes a task holds for each user."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("queued"), F.sum(F.least(F.octet_length("props"), F.lit(50000))).cast("long").alias("bytes"), F.min("event_id").alias("head"))


@query("SELECT event_id, user_id, value FROM events")
def stream_append(spark, sf_dir):
    """Events streamed into an atlas and read back."""
    from quire.operators.corpus import shared_path
    from quire.streaming import appends

    events = table(spark, sf_dir, "events")
    inbox, atlas = shared_path(spark, "inbox"), shared_path(spark, "atlas")
    events.select("event_id", "user_id", "value").write.parquet(inbox)
    stream = appends.records(spark, inbox, spark.read.parquet(inbox).schema)
    appends.append_atlas(stream, atlas, shared_path(spark, "progress"), "event_id").awaitTermination()
    return S.Atlas(spark, atlas).all().drop("bucket")


@query("SELECT event_id, user_id, value FROM events WHERE event_id % 97 = 0")
def stream_read_many(spark, sf_dir):
    """Records of some ids of an atlas that two appends made."""
    from quire.operators.corpus import shared_path

    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    atlas = S.Atlas(spark, shared_path(spark, "atlas"))
    atlas.append(events.filter("event_id % 2 = 0"), "event_id")
    atlas.append(events.filter("event_id % 2 = 1"), "event_id")
    return atlas.read_many(events.filter("event_id % 97 = 0").select("event_id"), "event_id")


@query("SELECT strftime(ts, '%Y-%m-%d %H:00') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_windows(spark, sf_dir):
    """Event-time windows of one hour, as a batch of the streaming operator's aggregation."""
    e = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd HH:00").alias("start"), "event_type", "n", "total")
