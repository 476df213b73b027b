"""I-Match document fingerprints over randomised lexicon subsets, in DataFrame functions only.

Terms are lower-cased words. The lexicon holds the terms of at least two texts whose share of texts lies
in a band, ``RARE`` to ``COMMON``; so it has at most (mean distinct terms of a text) / ``RARE`` terms,
whatever the number of texts, and goes to all tasks as one value. A text's lexicon terms, distinct and in order, are
hashed for each of ``SUBSETS`` subsets at each of ``LEVELS`` levels: a subset of level l holds a random
1 / (``SUBSETS`` * 4**l) of the lexicon (dealt by bits of the terms' hashes), so short texts are told by the first
level and long ones by the last. All subsets of a level are made in one pass: terms are sorted by subset, with a mark
before each subset, and the line of them is cut at the marks; a hash is over the terms between two marks, in order. A fingerprint is 4 hexadecimal digits for each of these
hashes ("----" where the text has no term of the subset), and 16 for the text itself, which tells texts apart that
have no lexicon terms.

Likeness of two fingerprints: 1 if they are equal; else, for each level, the share of equal hashes among
the subsets that either text has terms of, taken of ``LEAST`` subsets at least; the best level counts.

The next text comes by one exchange: rows are dealt to ranges of (id, place) with about equal numbers of rows, as
many as the table's bytes ask for, so an id that many rows share is split like any others.

Defined results: null text is empty; equal texts have equal fingerprints; rows with null ids come last;
rows are in descending order of id and, within an id, of the place in the input; an only row is its own next;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import _spark as S

#: Share of texts that a lexicon term is in.
RARE, COMMON = 0.001, 0.2
SUBSETS, LEVELS, LEAST = 16, 4, 4
#: Bytes of text in a range, about; there are at least four ranges for each shuffle partition.
RANGE = 1 << 26
#: Bounds of ranges that are searched at once.
STEP = 64
#: Parts of the lexicon; a term is looked for in its part only.
PARTS = 32768
_NONE = "----"
#: Low bits of a term's hash that subsets are hashed from; the bits that deal it to a subset of each level begin at 12.
_LOW = (1 << 56) - 1


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased words: runs of letters, digits and anything from U+0080."""
    found = F.array_remove(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    return F.array_distinct(F.transform(found, lambda w: F.xxhash64(w)))


def lexicon(texts: DataFrame) -> DataFrame:
    """``term``: the hashes of the terms of ``texts`` (a column ``text``) in the band, as a written table."""
    n = texts.count()
    # explode() would add a filter on the array's size, which makes the array twice
    each = texts.select(F.explode_outer(terms(F.col("text"))).alias("term")).filter("term is not null").groupBy("term").agg(F.count("*").alias("n"))
    return S.written(each.filter((F.col("n") >= max(2, RARE * n)) & (F.col("n") <= COMMON * n)).select("term"), "lexicon")


def _parts(words: DataFrame) -> DataFrame:
    """One row, one column: an array of ``PARTS`` arrays of terms."""
    part = words.groupBy(F.pmod("term", F.lit(PARTS)).alias("k")).agg(F.collect_list("term").alias("of"))
    every = words.sparkSession.range(PARTS).select(F.col("id").alias("k")).join(F.broadcast(part), "k", "left")
    return every.agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("of", F.array().cast("array<bigint>")).alias("of")))).alias("all")).select(F.col("all.of"))


def _codes(found: Column, level: int) -> Column:
    """The hashes of a text's lexicon terms for the subsets of a level, 4 hexadecimal digits each."""
    # the levels take 4, 6, 8 and 10 bits
    shift, wide = 12 + level * (level + 3), SUBSETS * 4**level - 1
    subset = lambda t: F.shiftrightunsigned(t, shift).bitwiseAND(F.lit(wide))
    own = F.filter(found, lambda t: subset(t) < SUBSETS) if level else found
    dealt = F.transform(own, lambda t: F.shiftleft(subset(t), 56).bitwiseOR(t.bitwiseAND(F.lit(_LOW))))
    marks = F.array(*[F.lit(k << 56).cast("long") for k in range(SUBSETS + 1)])

    def at_marks(line: Column) -> Column:
        return F.transform(marks, lambda m: F.array_position(line, m).cast("int"))

    def code(line: Column, a: Column, z: Column) -> Column:
        digits = F.substring(F.hex(F.xxhash64(F.slice(line, a + 1, z - a - 1)).bitwiseAND(F.lit(0xFFFF)) + 0x10000), 2, 4)
        return F.when(z - a == 1, _NONE).otherwise(F.lower(digits))

    def cut(line: Column) -> Column:
        each = lambda at: F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda k: code(line, F.get(at, k), F.get(at, k + 1)))
        return _once(at_marks(line), each)

    return _once(F.sort_array(F.concat(dealt, marks)), cut)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _fingerprint(rows: DataFrame, text: str, words: DataFrame, out: str) -> DataFrame:
    """``rows`` with the codes of a text column (not null) as ``out``, the last one for the text itself."""
    # the lexicon is one value of the whole query; used once, it is read in place and never copied into rows
    known = F.filter("_terms", lambda t: F.array_contains(F.get("_lexicon", F.pmod(t, F.lit(PARTS)).cast("int")), t))
    rows = rows.withColumn("_terms", terms(F.col(text)))
    rows = rows.withColumn("_lexicon", _parts(words).scalar()).select(*rows.drop("_terms").columns, known.alias("_found"))
    whole = F.array(F.substring(F.sha2(F.col(text).cast("binary"), 256), 1, 16))
    return rows.withColumn(out, F.concat(*[_codes(F.col("_found"), k) for k in range(LEVELS)], whole)).drop("_found")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for the codes of two texts."""
    best = []
    for level in range(LEVELS):
        part = lambda x: F.slice(x, SUBSETS * level + 1, SUBSETS)  # noqa: B023, E731
        # equal hashes count a thousand and one, others that either has count a thousand
        held = F.zip_with(part(a), part(b), lambda x, y: F.when(x != y, 1000).when(x == _NONE, 0).otherwise(1001))
        total = F.aggregate(held, F.lit(0), lambda n, x: n + x)
        best.append((total % 1000) / F.greatest(F.floor(total / 1000), F.lit(LEAST)))
    return F.when(a == b, 1.0).otherwise(F.greatest(*best))


def _in_order(rows: DataFrame, ranges: int) -> DataFrame:
    """``rows`` (_f, _r, id, text) with ``range`` and ``extra``: ranges of about as many rows each, and, for each range,
    one extra row that follows its last: the first of the next range, or of the first one. Larger ranges come first."""
    key = F.struct(F.col("id").isNotNull().alias("some"), "id", "_f", "_r")
    # written, as ranges that are worked out twice may differ
    dealt = S.written(rows.select("id", "_f", "_r").repartitionByRange(ranges, "id", "_f", "_r").select(key.alias("key"), F.spark_partition_id().alias("part")), "ranges")
    heads = S.written(dealt.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high")).select("low", "high"), "heads")
    lows = heads.agg(F.array_sort(F.collect_list("low")).alias("all")).select(F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / STEP).cast("int")), lambda k: F.slice("all", k * STEP + 1, F.lit(STEP))))
    below = lambda of: F.size(F.filter(of, lambda b: b <= F.col("_key")))
    ranged = rows.withColumn("_key", key).withColumn("_lows", lows.scalar()).withColumn("_top", F.size(F.filter("_lows", lambda p: F.get(p, F.lit(0)) <= F.col("_key"))) - 1)
    ranged = ranged.withColumn("range", F.col("_top") * STEP + below(F.get("_lows", F.col("_top")))).drop("_key", "_lows", "_top")
    # one row for each range
    up = Window.orderBy("low")
    follow = heads.select(F.row_number().over(up).alias("range"), F.coalesce(F.lag("high").over(up), F.max("high").over(Window.partitionBy())).alias("head")).select("range", "head._f", "head._r")
    extra = rows.join(F.broadcast(follow), ["_f", "_r"]).withColumn("extra", F.lit(True))
    return ranged.withColumn("extra", F.lit(False)).unionByName(extra)


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited (the text with its last third taken from the next one's beginning), the fingerprints
    of both, and the likeness of the text's fingerprint to the edited text's and to the next text's."""
    rows = S.row_keyed(docs, 1, id=F.col(id_col), text=F.coalesce(F.col(text_col), F.lit(""))).drop("_b")
    words = lexicon(rows.select("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = _fingerprint(_in_order(rows, max(4 * S.shards(docs.sparkSession), round(size / RANGE))), "text", words, "codes")
    order = Window.partitionBy("range").orderBy("extra", F.col("id").desc_nulls_last(), F.col("_f").desc(), F.col("_r").desc())
    rows = rows.withColumn("next", F.lead("text").over(order)).withColumn("next_codes", F.lead("codes").over(order)).filter(~F.col("extra"))
    n = F.char_length("text").cast("long")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("n_chars", n).withColumn("edited", F.concat(F.substring("text", F.lit(1), (n - third).cast("int")), F.substring("next", F.lit(1), third)))
    rows = _fingerprint(rows, "edited", words, "edited_codes")
    print_ = lambda codes: F.array_join(codes, "")
    own = F.col("codes")
    return rows.select(F.col("id").alias(id_col), "n_chars", "edited", print_("codes").alias("fingerprint"), print_("edited_codes").alias("edited_fingerprint"), likeness(own, F.col("edited_codes")).alias("near_edited"), likeness(own, F.col("next_codes")).alias("near_next"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    found = compared(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
