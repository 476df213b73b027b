"""Structured Streaming: append-only ingestion of records, a queue of tasks, and event-time windows.

Sources are folders of Parquet files. Every stream has a checkpoint folder, so a stopped run goes on where
it was. Each micro-batch is written to a place of its own that follows from the checkpoint and the batch's number,
so a record is appended once even where a batch is done again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quire.sources.files import Atlas


def records(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(folder)


def _name(checkpoint: str, number: int) -> str:
    """The name of a micro-batch of the stream that has this checkpoint: the same if the batch is done again."""
    return f"{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}-{number}"


def append_atlas(stream: DataFrame, path: str, checkpoint: str, id_col: str, buckets: int = 16) -> StreamingQuery:
    """Appends all that is there to an atlas, then stops. A micro-batch that is done again replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        Atlas(batch.sparkSession, path, buckets).append(batch, id_col, _name(checkpoint, number))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, id_col: str, time_col: str, late: str = "1 hour") -> DataFrame:
    """Records without repeats of an id whose times are within the watermark; state older than it is dropped."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark([id_col])


def drain(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, most_bytes: int, payload: str) -> StreamingQuery:
    """A first-in first-out queue of tasks: each micro-batch is worked on and appended; payloads over
    ``most_bytes`` are kept as rows with an error instead of a result. Results lie in a folder for each
    micro-batch, ``batch``, so one that is done again replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        fits = F.octet_length(payload) <= most_bytes
        done = work(batch.filter(fits)).withColumn("error", F.lit(None).cast("string"))
        too_long = batch.filter(~fits).withColumn("error", F.lit(f"payload over {most_bytes} bytes"))
        done.unionByName(too_long, allowMissingColumns=True).write.mode("overwrite").parquet(f"{path}/batch={_name(checkpoint, number)}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, time_col: str, key: str, value: str, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by key and event-time window (tumbling, or sliding with ``slide``); beyond what batch parity needs."""
    window = F.window(time_col, length, slide) if slide else F.window(time_col, length)
    return stream.withWatermark(time_col, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")
