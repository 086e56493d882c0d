"""Structured Streaming: payloads and rows upserted in micro-batches, and windowed counts with late data."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscan.operators.incremental import Swap
from folioscan.operators.ranking import keep_last
from folioscan.sources.sinks import read_json


MERGE_PARTS = 16  # batches between two mergers of a table's parts


def _state(spark: SparkSession, table: str) -> dict:
    return read_json(spark, f"{table}/CURRENT", {"batch": -1, "parts": []})


def read_upserted(spark: SparkSession, table: str, key: str, order: str) -> DataFrame:
    """The table: of all parts the last row of each key."""
    parts = [spark.read.parquet(f"{table}/{p}") for p in _state(spark, table)["parts"]]
    return keep_last(reduce(DataFrame.unionByName, parts), key, F.struct(F.col(order).isNotNull(), F.col(order)))


def upsert_batches(stream: DataFrame, key: str, order: str, table: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Keep in ``table`` the last row of each key by ``order``, batch by batch.

    A batch writes only its own rows, as a part, and is made current together
    with its number: a batch that is run again after a failure finds its number
    there and does nothing. Every ``MERGE_PARTS`` batches the parts are merged
    into one and the old ones removed, except those of the state before, which
    readers may still have open.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        current = _state(spark, table)
        if current["batch"] >= number:
            return
        rows = keep_last(transform(batch) if transform else batch, key, F.struct(F.col(order).isNotNull(), F.col(order)))
        name, parts, stale = f"batch-{number}", current["parts"], current.get("stale", [])
        rows.write.mode("overwrite").parquet(f"{table}/{name}")
        swap = Swap(spark, table)
        if len(parts) >= MERGE_PARTS:
            merged = f"merged-{number}"
            read_upserted(spark, table, key, order).write.mode("overwrite").parquet(f"{table}/{merged}")
            for old in stale:
                swap.files.delete(swap.path(f"{table}/{old}"), True)
            parts, stale = [merged], parts
        swap.put(json.dumps({"batch": number, "parts": [*parts, name], "stale": stale}), f"{table}/CURRENT")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_table_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def _timed(events: DataFrame, time: str) -> DataFrame:
    """Watermarks need a timestamp with zone; one without is taken in the session's."""
    return events.withColumn(time, F.col(time).cast("timestamp"))


def windowed_counts(events: DataFrame, time: str = "ts", size: str = "1 hour", slide: str | None = None, late: str = "30 minutes", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums per window and group; events later than ``late`` behind the greatest seen are dropped."""
    at = F.window(time, size, slide) if slide else F.window(time, size)
    return _timed(events, time).withWatermark(time, late).groupBy(at, *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, time: str = "ts", gap: str = "30 minutes", late: str = "1 hour", by: str = "user_id") -> DataFrame:
    """Sessions of each ``by``: events with at most ``gap`` between them."""
    return _timed(events, time).withWatermark(time, late).groupBy(F.session_window(time, gap), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


__all__ = ["upsert_batches", "read_upserted", "windowed_counts", "sessions", "read_table_stream"]
