"""Annotations of sessions and channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def defaulted(records: DataFrame) -> DataFrame:
    """Type Note unless given, times as longs, absent columns as nulls."""
    kinds = {"channel": "string", "type": "string", "time": "long", "text": "string", "duration": "long"}
    have = {c: F.col(c) if c in records.columns else F.lit(None) for c in kinds}
    out = {c: (F.round(x) if c in ("time", "duration") else x).cast(kinds[c]).alias(c) for c, x in have.items()}
    return records.select(*out.values()).withColumn("type", F.coalesce("type", F.lit("Note")))


def in_order(records: DataFrame) -> DataFrame:
    """By time, then by the order given (column position)."""
    return records.orderBy("time", "position")


def at_level(records: DataFrame, channel: str | None) -> DataFrame:
    """A channel's records, or with None the session's own."""
    return records.where(F.col("channel").eqNullSafe(F.lit(channel)))


def on_disk(records: DataFrame, offsets: DataFrame) -> DataFrame:
    """Adds disk_time, by the channel's recording-time offset; session records use none. offsets: channel, rto."""
    joined = records.join(offsets, "channel", "left")
    return joined.withColumn("disk_time", F.coalesce("rto", F.lit(0)) - F.col("time")).drop("rto")


def extents(records: DataFrame) -> DataFrame:
    """Per level: number of records, longest text in bytes, first and last time."""
    return records.groupBy("channel").agg(
        F.count("*").alias("n_records"), F.coalesce(F.max(F.octet_length("text")), F.lit(0)).alias("longest"), F.min("time").alias("earliest"), F.max("time").alias("latest")
    )
