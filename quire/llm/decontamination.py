"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is ``SIZE`` consecutive words of a benchmark item (all words of a shorter item). Of the hashes
of the ``GRAM``-word grams in a window the least is its fingerprint, so equal windows have equal
fingerprints: every shared span of a window's length is found, whatever surrounds it. Neighbouring
windows of a text mostly share their fingerprint and are carried as one run. Runs whose fingerprint a
benchmark window has are extended: their windows are compared with the benchmark's, word by word.

Fingerprints and windows of the benchmark are broadcast only if there are at most ``BROADCAST`` of them;
beyond, the same joins shuffle. Texts never move: only their word counts and hits do. Which items a text
shares is worked out once for each distinct set of windows, not for each text.

Words: A-Z in lower case, then runs of ASCII digits and letters and of anything from U+0080.

Defined results: null and empty texts have no words and aren't contaminated; items without words have no
windows; null item ids are left out of the list of items, their windows still hit; repeated rows give
repeated results; an empty benchmark hits nothing; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import _spark as S

#: Words in a window, and in a gram.
SIZE, GRAM = 10, 5
#: Most fingerprints, or windows, that are broadcast: some tens of MB.
BROADCAST = 250_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts of the benchmark's fingerprints; one is looked for in its part only.
PARTS = 4096


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), ""), F.array().cast("array<string>"))


# Arrays that are costly to make are exploded with explode_outer: for a plain explode the optimizer adds a
# filter on the array's size, which it moves below the projections, where it makes the array once more.


def _places(array: str, at: str, n: int) -> str:
    """n elements of an array from place ``at`` (from 0) on; unlike slice(), it doesn't read the whole array."""
    return ", ".join(f"{array}[{at} + {k}]" for k in range(n))


def _windows(rows: DataFrame, length: int) -> DataFrame:
    """``rows`` (with words and n) and ``least``: the fingerprint of each window of ``length`` words."""
    gram = min(GRAM, length)
    wide = length - gram + 1
    # grams is named more than once, so that the optimizer keeps it as a column and doesn't work it out in each step
    rows = rows.withColumn("grams", F.expr(f"IF(n >= {length}, transform(sequence(0, n - {gram}), i -> xxhash64({_places('words', 'i', gram)})), array())"))
    most = f"least({_places('grams', 's', wide)})" if wide > 1 else "grams[s]"
    return rows.withColumn("least", F.expr(f"IF(size(grams) >= {wide}, transform(sequence(0, size(grams) - {wide}), s -> {most}), array())")).drop("grams")


def _benchmark(items: DataFrame, size: int) -> DataFrame:
    """length, fp, win (words joined by a space), win_id and item of every window of every item."""
    rows = items.withColumn("n", F.size("words")).filter("n > 0").withColumn("length", F.least("n", F.lit(size)))
    out = None
    for length in range(1, size + 1):
        part = _windows(rows.filter(F.col("length") == length), length)
        part = part.select("length", "item", "words", F.posexplode_outer("least").alias("at", "fp")).filter("fp is not null")
        part = part.select("length", "fp", "item", F.expr(f"concat_ws(' ', {_places('words', 'at', length)})").alias("win"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("win_id", F.xxhash64("length", "win"))


def _parts(keys: DataFrame) -> DataFrame:
    """One row, one column: the fingerprints as an array of ``PARTS`` arrays."""
    part = keys.groupBy(F.pmod("fp", F.lit(PARTS)).alias("k")).agg(F.collect_set("fp").alias("of"))
    every = keys.sparkSession.range(PARTS).select(F.col("id").alias("k")).join(F.broadcast(part), "k", "left")
    return every.agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("of", F.array().cast("array<bigint>")).alias("of")))).alias("all")).select(F.col("all.of"))


def _near(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` (with words and ``runs``), ``near``: those runs whose fingerprint is among ``keys``."""
    if keys.count() <= BROADCAST:
        # the fingerprints are one value of the whole query; used once, it is read in place and never copied into rows
        known = F.filter("runs", lambda r: F.array_contains(F.get("_keys", F.pmod(r.fp, F.lit(PARTS)).cast("int")), r.fp))
        return rows.withColumn("_keys", _parts(keys).scalar()).select("_f", "_r", "id", "n", "words", known.alias("near"))
    each = rows.select("_f", "_r", F.explode_outer("runs").alias("run")).withColumn("fp", F.col("run.fp")).join(keys, "fp", "left_semi")
    found = each.groupBy("_f", "_r").agg(F.collect_list("run").alias("near"))
    return rows.select("_f", "_r", "id", "n", "words").join(found, ["_f", "_r"], "left")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", size: int = SIZE) -> DataFrame:
    """_f, _r (the row's place), id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs``."""
    items = benchmark.select(F.col(item_col).alias("item"), words(F.col("text")).alias("words"))
    told = S.written(_benchmark(items, size), "benchmark")
    wins = told.select("length", "win", "win_id").distinct()
    lengths = sorted(x[0] for x in told.select("length").distinct().collect())

    rows = S.row_keyed(docs, 1, id=F.col(id_col), words=words(F.col(text_col).cast("string"))).drop("_b").withColumn("n", F.size("words"))
    runs = rows.withColumn("runs", F.expr("CAST(array() AS array<struct<length:int,a:int,z:int,fp:bigint>>)"))
    for length in lengths:
        runs = _windows(runs, length).withColumn("starts", F.expr("filter(transform(least, (x, i) -> struct(i AS a, x AS fp)), r -> r.a = 0 OR r.fp <> least[r.a - 1])"))
        mine = f"transform(starts, (r, i) -> struct({length} AS length, r.a AS a, coalesce(get(starts, i + 1).a, size(least)) - 1 AS z, r.fp AS fp))"
        runs = runs.withColumn("runs", F.expr(f"concat(runs, {mine})")).drop("least", "starts")
    near = _near(runs, told.select("fp").distinct())
    # each run takes its own words along; the row's own run, without words, keeps its word count
    spread = "transform(near, r -> struct(r.length AS length, r.a AS a, slice(words, r.a + 1, r.z - r.a + r.length) AS words))"
    own = "array(struct(0 AS length, 0 AS a, CAST(array() AS array<string>) AS words))"
    near = near.select("_f", "_r", "id", "n", F.expr(f"explode_outer(concat({own}, coalesce({spread}, array())))").alias("run")).select("_f", "_r", "id", "n", "run.*")
    near = near.withColumn("k", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.size("words") - F.col("length"), F.lit(0)))))
    window = F.lit(None).cast("string")
    for length in lengths:
        window = F.when(F.col("length") == length, F.expr(f"concat_ws(' ', {_places('words', 'k', length)})")).otherwise(window)
    near = near.select("_f", "_r", "id", "n", "length", (F.col("a") + F.col("k")).alias("at"), window.alias("win"))
    hits = near.join(F.broadcast(wins) if wins.count() <= BROADCAST else wins, ["length", "win"], "left")
    span = F.when(F.col("win_id").isNotNull(), F.struct(F.col("at").alias("a"), (F.col("at") + F.col("length")).alias("z")))
    per = hits.groupBy("_f", "_r").agg(F.first("id").alias("id"), F.max("n").cast("long").alias("n_words"), F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.collect_set("win_id")).alias("wins"))
    union = "aggregate(spans, struct(0L AS upto, 0L AS n), (u, s) -> struct(greatest(u.upto, CAST(s.z AS BIGINT)) AS upto, u.n + greatest(0L, s.z - greatest(u.upto, CAST(s.a AS BIGINT))) AS n), u -> u.n)"
    per = S.written(per.select("_f", "_r", "id", "n_words", F.expr(union).alias("n_hit"), F.when(F.size("wins") > 0, F.sha2(F.array_join("wins", ",").cast("binary"), 256)).alias("set"), "wins"), "hits")

    sets = per.filter("set is not null").groupBy("set").agg(F.first("wins").alias("wins"))
    shared = sets.select("set", F.explode("wins").alias("win_id")).join(told.select("win_id", "item").distinct(), "win_id").groupBy("set").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    digest = shared.select("set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    # texts without hits, mostly all, have no set and stay out of the join
    clean = per.filter("set is null").select("_f", "_r", "id", "n_words", "n_hit", F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit("").cast("binary"), 256).alias("items_sha256"))
    hit = per.filter("set is not null").join(digest, "set", "left")
    hit = hit.select("_f", "_r", "id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"))
    return clean.unionByName(hit).withColumn("contaminated", F.col("n_hit") > 0)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in any window of ten words of a benchmark item."""
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, benchmark).drop("_f", "_r").withColumnRenamed("id", "doc_id")
