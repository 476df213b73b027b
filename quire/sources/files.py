"""Files as rows: listing, kinds, decoding to pixels, recipes, archives and append-only atlases.

An image is a row (path, h, w, c, data) or long pixels; a recipe is a row with typed header columns and its
payload, so header queries never read payloads. Parquet folders take the place of container files.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes that count as images.
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "bmp", "pgm", "ppm", "tif", "tiff")
MODES = {"dct": "dct", "fast": "fast", "palette": "pal", "photo": "photo", "wavelet": "wav"}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_image(path: Column) -> Column:
    return suffix(path).isin(*IMAGE_SUFFIXES)


def listed(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (), recursive: bool = True) -> DataFrame:
    """path, length, modified of all files, each path once, sorted; only these suffixes (in any case) if given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    found = files.select("path", "length", F.col("modificationTime").alias("modified")).dropDuplicates(["path"])
    if suffixes:
        found = found.filter(suffix(F.col("path")).isin(*suffixes))
    return found.orderBy("path")


def output_path(path: Column, source: str, target: str, mode: str) -> Column:
    """The place of a result: the tree of ``source`` under ``target``, with the suffix of the mode."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {sorted(MODES)}")
    moved = F.concat(F.lit(target.rstrip("/")), F.substr(path, F.lit(len(source.rstrip("/")) + 1)))
    return F.regexp_replace(moved, r"\.[^./]+$", f".{MODES[mode]}")


def byte_rows(df: DataFrame, id_col: str, data: str) -> DataFrame:
    """id, pos, byte: the bytes of a binary column."""
    pos = F.sequence(F.lit(1), F.octet_length(data))
    some = df.filter(F.octet_length(data) > 0).select(id_col, F.explode(pos).alias("pos"), F.col(data).alias("_d"))
    return some.select(id_col, (F.col("pos") - 1).alias("pos"), F.conv(F.hex(F.substring(F.col("_d"), F.col("pos"), F.lit(1))), 16, 10).cast("int").alias("byte"))


def netpbm(df: DataFrame, data: str = "content") -> DataFrame:
    """h, w, c and pixels (an array of bytes as ints) of binary PGM and PPM files; null for other bytes."""
    def read(raw: bytes) -> tuple:
        parts = raw[:64].split(None, 4)
        if len(parts) < 4 or parts[0] not in (b"P5", b"P6"):
            return None, None, None, None
        w, h, c = int(parts[1]), int(parts[2]), 1 if parts[0] == b"P5" else 3
        at = raw.index(parts[3], raw.index(parts[2], raw.index(parts[1], 2) + len(parts[1])) + len(parts[2])) + len(parts[3]) + 1
        body = np.frombuffer(raw, np.uint8, count=min(h * w * c, len(raw) - at), offset=at)
        return (h, w, c, body.astype("int32")) if len(body) == h * w * c else (None, None, None, None)

    def each(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(bytes(x)) for x in s], columns=["h", "w", "c", "pixels"]).astype({"h": "Int32", "w": "Int32", "c": "Int32"})

    out = F.pandas_udf(each, "h int, w int, c int, pixels array<int>")(F.col(data))
    return df.withColumn("_i", out).select("*", "_i.*").drop("_i")


def recipe(df: DataFrame, codec: str, version: int, payload: str, header: list[str]) -> DataFrame:
    """Rows with codec, version, header columns, payload, size and the digest of the payload."""
    return df.select(F.lit(codec).alias("codec"), F.lit(version).alias("version"), *header, F.octet_length(payload).cast("long").alias("size"), F.sha2(F.col(payload), 256).alias("sha"), F.col(payload).alias("payload"))


def checked(recipes: DataFrame) -> DataFrame:
    """``ok``: whether a recipe's payload still has its digest and its codec is known."""
    return recipes.withColumn("ok", (F.sha2("payload", 256) == F.col("sha")) & F.col("codec").isNotNull())


def message(payload: Column) -> Column:
    """A framed message: a 4-byte length, the payload, and the first 4 bytes of its digest."""
    length = F.unhex(F.lpad(F.hex(F.octet_length(payload)), 8, "0"))
    return F.concat(length, payload, F.unhex(F.substring(F.sha2(payload, 256), 1, 8)))


def unmessage(framed: Column) -> tuple[Column, Column]:
    """Payload of a framed message, and whether its length and digest hold."""
    n = F.conv(F.hex(F.substring(framed, 1, 4)), 16, 10).cast("int")
    payload = F.substring(framed, F.lit(5), n)
    return payload, (F.octet_length(framed) == n + 8) & (F.hex(F.substring(framed, F.octet_length(framed) - 3, F.lit(4))) == F.upper(F.substring(F.sha2(payload, 256), 1, 8)))


def waves(spark: SparkSession, series: int, length: int) -> DataFrame:
    """Synthetic signals: a sum of two sines for each series, as 16-bit integers."""
    k = spark.range(series * length).select(F.floor(F.col("id") / length).cast("int").alias("series_id"), (F.col("id") % length).cast("int").alias("n"))
    t = F.col("n") / length
    return k.withColumn("v", F.rint(8000 * F.sin(6.283185307179586 * (F.col("series_id") + 1) * t) + 4000 * F.sin(6.283185307179586 * 3 * (F.col("series_id") + 1) * t)).cast("int"))


class Atlas:
    """Append-only records in a Parquet folder, partitioned by a bucket of the id; reads by id touch one bucket.

    Every append, and every micro-batch of a stream, has a folder of its own (``appended``), so batch and streamed
    records lie side by side, and an append that is done again under its name takes its own place.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path, buckets

    def append(self, records: DataFrame, id_col: str = "id", name: str | None = None) -> None:
        out = records.withColumn("bucket", F.pmod(F.xxhash64(id_col), F.lit(self.buckets)).cast("int"))
        out.write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/appended=a-{name or uuid.uuid4().hex}")

    def all(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("appended")

    def read(self, key: int, id_col: str = "id") -> DataFrame:
        """The records of one id; an id that isn't there is an IndexError."""
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(key).cast("long")), F.lit(self.buckets))).first()[0]
        found = self.all().filter((F.col("bucket") == bucket) & (F.col(id_col) == key))
        if not found.limit(1).count():
            raise IndexError(key)
        return found.drop("bucket")

    def read_many(self, keys: DataFrame, id_col: str = "id") -> DataFrame:
        return self.all().drop("bucket").join(keys, id_col, "left_semi")
