"""The engine's own store: blocks as Parquet, partitioned by channel, sorted by time.

A store is a folder with blocks, channels and records tables. Metadata queries read
no samples (column pruning), time windows reach row-group statistics through
start_uutc and end_uutc, and appends are checked against the channel's last segment.
One writer per channel at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import timegrid as tg
from tidegrid.model import BLOCKS, CHANNELS, RECORDS, SessionIOError, WriteConflictError
from tidegrid.operators import catalog, ingest, read, records


class Store:
    def __init__(self, spark: SparkSession, path: str, overwrite: bool = False):
        self.spark, self.path = spark, str(path).rstrip("/")
        if overwrite:
            fs_path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
            fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(fs_path, True)

    def _exists(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _table(self, name: str, schema) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def blocks(self) -> DataFrame:
        return self._table("blocks", BLOCKS)

    def channels(self) -> DataFrame:
        return self._table("channels", CHANNELS)

    def records(self, channel: str | None = None) -> DataFrame:
        return records.at_level(self._table("records", RECORDS), channel).orderBy("time")

    def segments(self) -> DataFrame:
        return catalog.segment_map(self.blocks())

    def toc(self, channel: str) -> DataFrame:
        return catalog.toc(self.blocks().where(F.col("channel") == channel))

    def info(self) -> DataFrame:
        """One row per channel: its stored attributes and the roll-up of its segments."""
        figures = catalog.channel_info(self.segments()).withColumnRenamed("channel", "name")
        stored = self.channels().drop("n_segments", "start_time", "end_time", "number_of_samples")
        return stored.join(figures, "name").select(*CHANNELS.names)

    def _last(self, channel: str) -> dict | None:
        row = self.segments().where(F.col("channel") == channel).agg(
            F.max("segment").alias("segment"), F.max_by("end_time", "segment").alias("end"), F.sum("number_of_samples").alias("samples"), F.max("end_time").alias("latest")
        ).first()
        return row.asDict() if row["segment"] is not None else None

    def append(self, channel: str, samples: DataFrame, start_uutc: int, fs: float, precision: int | None = None, new_segment: bool = False, block_length: int | None = None, units: str = "uV", attributes: dict | None = None) -> DataFrame:
        """samples (pos, value), gaps null or NaN, or (pos, count, valid) with a known factor as precision. Returns the write's summary.

        Within a segment the rate, the factor and the time must fit; a new segment is not checked in time.
        """
        last = self._last(channel)
        known = self.channels().where(F.col("name") == channel).select("sampling_frequency", "units_conversion_factor").first()
        rows = samples.withColumn("channel", F.lit(channel))
        if precision is None:
            if known is not None and not new_segment:
                precision = int(self.spark.range(1).select(tg.precision_of(F.lit(known[1]))).first()[0])
            else:
                precision = int(ingest.infer_precision(rows).first()["precision"])
        ufact = 10.0 ** -precision
        if "count" not in rows.columns:
            rows = rows.withColumns({"count": tg.quantize("value", precision), "valid": tg.is_valid("value")})
        segment = 0 if last is None else last["segment"] + bool(new_segment)
        first = rows.where("valid").agg(F.min("pos")).first()[0]
        if first is None:
            return self.spark.createDataFrame([(channel, 0, 0, 0, segment)], "channel string, samples_written long, blocks long, gaps_skipped long, segment int")
        begin = self.spark.range(1).select(tg.block_start(F.lit(start_uutc), F.lit(first), F.lit(float(fs)))).first()[0]
        if last is not None and not new_segment:
            flags = self.spark.range(1).select(
                catalog.same_rate(F.lit(known[0]), F.lit(float(fs))), catalog.same_factor(F.lit(known[1]), F.lit(ufact)), catalog.late_enough(F.lit(begin), F.lit(last["end"]), F.lit(float(fs)))
            ).first()
            for ok, what in zip(flags, ("sampling rate", "conversion factor", "start time"), strict=True):
                if not ok:
                    raise WriteConflictError(f"{channel}: the append's {what} does not fit the segment")
        total = last["samples"] if last else 0
        blocks = ingest.tile(rows.select("channel", "pos", "count", "valid"), start_uutc, float(fs), block_length, total)
        before = self.blocks().where((F.col("channel") == channel) & (F.col("segment") == segment)).count() if last else 0
        blocks = blocks.withColumns({"session": F.lit(self.path.rsplit("/", 1)[-1]), "segment": F.lit(segment), "block_no": (F.col("block_no") + before).cast("int"), "number_of_samples": F.col("number_of_samples").cast("long")})
        blocks = blocks.select(*BLOCKS.names).sortWithinPartitions("channel", "start_uutc")
        if known is None:  # before the blocks, so that none is ever without its channel
            row = {"session": self.path.rsplit("/", 1)[-1], "name": channel, "sampling_frequency": float(fs), "units_conversion_factor": ufact, "units_description": units, "recording_time_offset": 0, "section3_available": True} | (attributes or {})
            self.spark.createDataFrame([tuple(row.get(n) for n in CHANNELS.names)], CHANNELS).write.mode("append").parquet(f"{self.path}/channels")
        blocks.write.mode("append").partitionBy("channel").parquet(f"{self.path}/blocks")
        written = self.blocks().where((F.col("channel") == channel) & (F.col("segment") == segment) & (F.col("block_no") >= before))
        return ingest.write_summary(written, segment)

    def write_records(self, rows: DataFrame, channel: str | None = None) -> None:
        """Replaces a level's records; none leaves it as it is."""
        new = records.defaulted(rows).withColumn("channel", F.lit(channel).cast("string"))
        if new.isEmpty():
            return
        full = new.withColumns({c: F.lit(None).cast(f.dataType) for c, f in zip(RECORDS.names, RECORDS.fields, strict=True) if c not in new.columns}).select(*RECORDS.names)
        level = "session" if channel is None else f"channel={channel}"
        full.orderBy("time").write.mode("overwrite").parquet(f"{self.path}/records/level={level.replace('=', '-')}")

    def read_raw(self, channel: str, t0: int | None = None, t1: int | None = None) -> DataFrame:
        """idx, count, valid on the channel's grid over [t0, t1); its own start and end by default."""
        row = self.info().where(F.col("name") == channel).select("start_time", "end_time", "sampling_frequency").first()
        if row is None:
            raise IndexError(f"no channel {channel!r}")
        t0, t1 = row[0] if t0 is None else t0, row[1] if t1 is None else t1
        blocks = self.blocks().where(F.col("channel") == channel)
        return read.read_raw(blocks, t0, t1, row[2]).orderBy("idx")

    def read(self, channel: str, t0: int | None = None, t1: int | None = None) -> DataFrame:
        """idx, value in units, null in gaps."""
        return read.scaled(self.read_raw(channel, t0, t1), self.channels()).select("idx", "value").orderBy("idx")

    def runs(self, channel: str) -> DataFrame:
        return read.runs(self.blocks().where(F.col("channel") == channel))


def import_session(spark: SparkSession, session_path: str, store: Store, password: str = "") -> None:
    """A native session's tables copied into an empty store; blocks are decoded by tasks, byte range by byte range."""
    from tidegrid.sources.datasource import load

    if store._exists("blocks"):
        raise SessionIOError("the store already has blocks")
    table = lambda mode: load(spark, session_path, mode, password)
    table("blocks").repartition("channel", "segment").sortWithinPartitions("channel", "start_uutc").write.partitionBy("channel").parquet(f"{store.path}/blocks")
    table("channels").write.parquet(f"{store.path}/channels")
    table("records").write.parquet(f"{store.path}/records")


def export_session(store: Store, session_path: str, password1: str = "", password2: str = "") -> DataFrame:
    """A store as a native session on a path that all executors share; one task per segment, blocks streamed in order. Returns channel, segment, samples."""
    from tidegrid.sources import export

    return export.write_session(store, session_path, password1, password2)
