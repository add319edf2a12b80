"""Micro-batches appended to a store, channel by channel, with the checks of any append.

An extension: late data are refused, as an append that starts before its segment's
end is; they are returned to the caller, not dropped in silence.

A batch that is tried again is not appended twice. A log beside the store's tables
notes each (stream, batch, channel) with the channel's number of samples before its
append. An append is one write that is committed whole, so on a repeated batch more
samples than noted mean that it has been done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import timegrid as tg
from tidegrid.model import WriteConflictError
from tidegrid.sources.store import Store


_LOG = "stream string, batch long, channel string, before long"


def appender(store: Store, fs: float, precision: int, on_conflict: Callable[[str, DataFrame, WriteConflictError], None] | None = None, stream: str = "") -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch over (channel, t, value). Channels of a batch are few; their samples stay distributed. stream tells the streams of one store apart."""
    spark, log = store.spark, f"{store.path}/batches"

    def stored() -> dict[str, int]:
        return {r["channel"]: r["n"] for r in store.segments().groupBy("channel").agg(F.sum("number_of_samples").alias("n")).collect()}

    def batch(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        try:
            noted: dict[str, int] = {}
            if store._exists("batches"):
                own = spark.read.schema(_LOG).parquet(log).where((F.col("stream") == stream) & (F.col("batch") == batch_id))
                noted = {r["channel"]: r["before"] for r in own.groupBy("channel").agg(F.min("before").alias("before")).collect()}
            now = stored()
            found = rows.groupBy("channel").agg(F.min("t").alias("t0")).orderBy("channel").collect()
            fresh = [(stream, batch_id, r["channel"], now.get(r["channel"], 0)) for r in found if r["channel"] not in noted]
            if fresh:
                spark.createDataFrame(fresh, _LOG).coalesce(1).write.mode("append").parquet(log)
            for r in found:
                name = r["channel"]
                if name in noted and now.get(name, 0) > noted[name]:
                    continue
                own = rows.where(F.col("channel") == name)
                placed = own.select(tg.grid_index("t", F.lit(r["t0"]), F.lit(fs)).alias("pos"), "value").groupBy("pos").agg(F.max("value").alias("value"))
                try:
                    store.append(name, placed, r["t0"], fs, precision)
                except WriteConflictError as e:
                    if on_conflict is None:
                        raise
                    on_conflict(name, own, e)
        finally:
            rows.unpersist()

    return batch
