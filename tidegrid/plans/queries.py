"""The query catalogue: every query as a plan over the operators, with the SQL that says the same."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.functions import codec, crypto
from tidegrid.functions import timegrid as tg
from tidegrid.operators import catalog, ingest, metadata, read, records
from tidegrid.plans import signals as sig

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_E = "e AS (SELECT event_type AS channel, epoch_us(ts) AS t, value, event_id FROM events)"
_L = """l AS (SELECT l_returnflag AS channel, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS BIGINT) AS pos,
  CASE WHEN l_discount <> 0 THEN l_extendedprice END AS value, l_discount <> 0 AS valid, l_orderkey, l_linenumber, l_quantity, l_tax, l_discount AS disc,
  CASE WHEN l_discount <> 0 THEN CAST(round(l_extendedprice * 100) AS INTEGER) END AS count FROM lineitem)"""
_RUNS = f"""{_L}, v AS (SELECT *, pos - row_number() OVER (PARTITION BY channel ORDER BY pos) AS g, row_number() OVER (PARTITION BY channel ORDER BY pos) - 1 AS stored FROM l WHERE valid),
r AS (SELECT channel, min(pos) AS run_begin, max(pos) + 1 AS run_end, count(*) AS n FROM v GROUP BY channel, g)"""
_TIME = "CAST({s} + round(CAST(pos AS DOUBLE) / 256.0 * 1e6) AS BIGINT)".format(s=sig.START)
_BLOCKS = f"""{_RUNS}, w AS (SELECT v.*, min(pos) OVER (PARTITION BY channel, g) AS rb FROM v),
b0 AS (SELECT channel, rb, (pos - rb) // 64 AS tile, min(pos) AS pos, CAST(min(stored) AS BIGINT) AS start_sample, count(*) AS number_of_samples, max(count) AS maximum_sample_value, min(count) AS minimum_sample_value, CAST(sum(count) AS BIGINT) AS total FROM w GROUP BY ALL),
b AS (SELECT channel, CAST(row_number() OVER (PARTITION BY channel ORDER BY pos) - 1 AS INTEGER) AS block_no, {_TIME} AS start_uutc, {_TIME} + CAST(round(number_of_samples * 1e6 / 256.0) AS BIGINT) AS end_uutc,
  start_sample, number_of_samples, maximum_sample_value, minimum_sample_value, total, tile = 0 AS discontinuity, 0 AS segment FROM b0)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _stored(df: DataFrame) -> DataFrame:
    """df written once in the shared folder and read back, as a store's blocks are."""
    spark = df.sparkSession
    path = f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='tidegrid-')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _grid_window(samples: DataFrame) -> DataFrame:
    """Each channel's window from its first sample to one microsecond past its last, an hour a position."""
    return samples.groupBy("channel").agg(F.min("t").alias("t0"), (F.max("t") + 1).alias("t1")).withColumn("fs", F.lit(sig.HOUR_FS))


_FS = "(1.0::DOUBLE / 3600)"
_GRID = f"""{_E}, w AS (SELECT channel, min(t) AS t0, max(t) + 1 AS t1 FROM e GROUP BY channel),
p AS (SELECT channel, CAST(round(CAST(t - t0 AS DOUBLE) * {_FS} / 1e6) AS BIGINT) AS idx, arg_max(value, {{'t': t, 'v': value}}) AS value FROM e JOIN w USING (channel) GROUP BY ALL),
n AS (SELECT channel, t0, CAST(greatest(round(CAST(t1 - t0 AS DOUBLE) * {_FS} / 1e6), 0) AS BIGINT) AS n FROM w),
gr AS (SELECT channel, t0, unnest(range(n)) AS idx FROM n)"""


@query("grid_read", f"WITH {_GRID} SELECT channel, idx, CAST(t0 + round(CAST(idx AS DOUBLE) / {_FS} * 1e6) AS BIGINT) AS t, value, value IS NOT NULL AS valid FROM gr LEFT JOIN p USING (channel, idx)")
def grid_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sig.events(spark, sf_dir).select("channel", "t", "value")
    return read.on_grid(e, _grid_window(e), ["channel"])




@query(
    "grid_read_window",
    f"""WITH {_E}, c AS (SELECT DISTINCT channel FROM e), m AS (SELECT min(t) + 432000000000 AS t0, min(t) + 1036800000000 AS t1 FROM e),
p AS (SELECT channel, CAST(round(CAST(t - t0 AS DOUBLE) * {_FS} / 1e6) AS BIGINT) AS idx, arg_max(value, {{'t': t, 'v': value}}) AS value FROM e, m WHERE round(CAST(t - t0 AS DOUBLE) * {_FS} / 1e6) BETWEEN 0 AND 167 GROUP BY ALL)
SELECT channel, idx, CAST(t0 + round(CAST(idx AS DOUBLE) / {_FS} * 1e6) AS BIGINT) AS t, value, value IS NOT NULL AS valid FROM (SELECT channel, t0, unnest(range(168)) AS idx FROM c, m) LEFT JOIN p USING (channel, idx)""",
)
def grid_read_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sig.events(spark, sf_dir).select("channel", "t", "value")
    first = e.agg(F.min("t")).first()[0]
    w = e.select("channel").distinct().select("channel", F.lit(first + 432_000_000_000).alias("t0"), F.lit(first + 1_036_800_000_000).alias("t1"), F.lit(sig.HOUR_FS).alias("fs"))
    return read.on_grid(e, w, ["channel"])


@query("read_raw_mask", f"WITH {_L} SELECT channel, pos AS idx, count, valid FROM l WHERE pos < (SELECT max(pos) + 1 FROM l m WHERE m.channel = l.channel AND valid) AND pos BETWEEN 100 AND 1099")
def read_raw_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _stored(ingest.tile(sig.counts(spark, sf_dir), sig.START, sig.FS, sig.BLOCK).withColumn("segment", F.lit(0)))
    t0, t1 = (sig.START + round(p / sig.FS * 1e6) for p in (100, 1100))
    raw = read.read_raw(blocks, t0, t1, sig.FS)
    return raw.select("channel", (F.col("idx") + 100).alias("idx"), "count", "valid")


@query("grid_length", f"WITH {_E} SELECT channel, CAST(greatest(round(CAST(max(t) + 1 - min(t) AS DOUBLE) * {_FS} / 1e6), 0) AS BIGINT) AS n FROM e GROUP BY channel")
def grid_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid_window(sig.events(spark, sf_dir)).select("channel", tg.grid_length("t0", "t1", "fs").alias("n"))


@query("inverted_window", f"WITH {_GRID.replace('min(t) AS t0, max(t) + 1 AS t1', 'max(t) + 1 AS t0, min(t) AS t1')} SELECT channel, idx, value FROM gr LEFT JOIN p USING (channel, idx)")
def inverted_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sig.events(spark, sf_dir).select("channel", "t", "value")
    w = _grid_window(e).select("channel", F.col("t1").alias("t0"), F.col("t0").alias("t1"), "fs")
    return read.on_grid(e, w, ["channel"]).select("channel", "idx", "value")


@query("quantize_counts", f"WITH {_L} SELECT channel, pos, count FROM l")
def quantize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.counts(spark, sf_dir).select("channel", "pos", "count")


@query("dequantize_roundtrip", f"WITH {_L} SELECT channel, pos, CAST(count AS DOUBLE) * pow(10.0, -2.0) AS back, abs(CAST(count AS DOUBLE) * pow(10.0, -2.0) - value) <= 0.006 AS close FROM l WHERE valid")
def dequantize_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = tg.scale("count", tg.factor(2))
    return sig.counts(spark, sf_dir).where("valid").select("channel", "pos", back.alias("back"), (F.abs(back - F.col("value")) <= 0.006).alias("close"))


@query("valid_mask", f"WITH {_L} SELECT channel, pos, value IS NOT NULL AND NOT isnan(value) AS valid FROM l")
def valid_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.lines(spark, sf_dir).select("channel", "pos", tg.is_valid("value").alias("valid"))


def _precision_sql(column: str) -> str:
    return f"""SELECT '{column}' AS source, channel, CAST(least(k, (SELECT max(j) FROM range(0, 40) t(j) WHERE j <= k AND (j = 0 OR NOT (lo * pow(10.0, j) < -2147483648 AND hi * pow(10.0, j) > 2147483647)))) AS INTEGER) AS precision
FROM (SELECT channel, lo, hi, (SELECT count(*) FROM range(0, 40) t(i) WHERE m <> 0 AND m * pow(10.0, i) < 1000) AS k
  FROM (SELECT channel, coalesce(avg(abs(value - before)), 0) AS m, min(value) AS lo, max(value) AS hi
    FROM (SELECT channel, value, lag(value) OVER (PARTITION BY channel ORDER BY pos) AS before FROM (SELECT channel, pos, CASE WHEN valid THEN {column} END AS value FROM x)) GROUP BY channel))"""


@query("infer_precision", f"WITH {_L}, x AS (SELECT channel, pos, valid, disc AS l_discount, l_tax, value AS l_extendedprice, l_quantity FROM l) " + " UNION ALL ".join(map(_precision_sql, ("l_discount", "l_tax", "l_extendedprice", "l_quantity"))))
def infer_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = ("l_discount", "l_tax", "l_extendedprice", "l_quantity")
    rows = sig.lines(spark, sf_dir, *sources).unpivot(["channel", "pos"], list(sources), "source", "value")
    rows = rows.select(F.concat_ws("/", "source", "channel").alias("channel"), "pos", "value")
    part = F.split("channel", "/")
    return ingest.infer_precision(rows).select(part[0].alias("source"), part[1].alias("channel"), F.col("precision").cast("int").alias("precision"))


@query("gap_islands", f"WITH {_RUNS} SELECT channel, run_begin, run_end, n FROM r")
def gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.islands(sig.lines(spark, sf_dir).select("channel", "pos", "valid"))


@query("gap_count", f"WITH {_RUNS} SELECT channel, greatest(count(*) - 1, 0) AS gaps_skipped FROM r GROUP BY channel")
def gap_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.gap_count(ingest.islands(sig.lines(spark, sf_dir).select("channel", "pos", "valid")))


def _blocks(spark: SparkSession, sf_dir: str, collect: bool = False) -> DataFrame:
    samples = sig.counts(spark, sf_dir).select("channel", "pos", "count", "valid")
    return ingest.tile(samples, sig.START, sig.FS, sig.BLOCK, collect=collect).withColumn("segment", F.lit(0))


@query("write_summary", f"WITH {_BLOCKS} SELECT channel, CAST(sum(number_of_samples) AS BIGINT) AS samples_written, count(*) AS blocks, count(*) FILTER (discontinuity) - 1 AS gaps_skipped, 0 AS segment FROM b GROUP BY channel")
def write_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.write_summary(_blocks(spark, sf_dir), 0)


@query("block_tiling", f"WITH {_BLOCKS} SELECT channel, block_no, start_uutc, start_sample, number_of_samples, maximum_sample_value, minimum_sample_value, total, discontinuity FROM b")
def block_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).drop("segment", "end_uutc")


for _name, _column in (("block_start_sample", "start_sample"), ("block_start_time", "start_uutc"), ("block_discontinuity", "discontinuity")):
    query(_name, f"WITH {_BLOCKS} SELECT channel, block_no, {_column} FROM b")(lambda spark, sf_dir, c=_column: _blocks(spark, sf_dir).select("channel", "block_no", c))


@query("block_samples", f"WITH {_BLOCKS}, s AS (SELECT channel, rb, (pos - rb) // 64 AS tile, min(pos) AS pos, list(count ORDER BY pos) AS c FROM w GROUP BY ALL) SELECT channel, CAST(row_number() OVER (PARTITION BY channel ORDER BY pos) - 1 AS INTEGER) AS block_no, array_to_string(c, ',') AS samples FROM s")
def block_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir, True).select("channel", "block_no", F.array_join("samples", ",").alias("samples"))


@query("toc", f"WITH {_BLOCKS} SELECT channel, segment, block_no, start_uutc, end_uutc, start_sample, number_of_samples, maximum_sample_value, minimum_sample_value, discontinuity FROM b")
def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.toc(_blocks(spark, sf_dir)).drop("total")


@query("block_extrema", f"WITH {_BLOCKS} SELECT channel, block_no, maximum_sample_value AS hi, minimum_sample_value AS lo FROM b")
def block_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir, True).select("channel", "block_no", F.array_max("samples").alias("hi"), F.array_min("samples").alias("lo"))


@query("block_prune_overlap", f"WITH {_BLOCKS} SELECT channel, block_no FROM b WHERE end_uutc > {sig.START + 2_000_000} AND start_uutc < {sig.START + 5_000_000}")
def block_prune_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.within(_blocks(spark, sf_dir), sig.START + 2_000_000, sig.START + 5_000_000).select("channel", "block_no")


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks cut into four segments by position in the channel's blocks."""
    blocks = _blocks(spark, sf_dir)
    quarter = F.ntile(4).over(Window.partitionBy("channel").orderBy("block_no")) - 1
    return blocks.withColumn("segment", quarter)


_SEGMENTED = f"{_BLOCKS}, s AS (SELECT * REPLACE (CAST(ntile(4) OVER (PARTITION BY channel ORDER BY block_no) - 1 AS INTEGER) AS segment) FROM b)"
_MAP = f"{_SEGMENTED}, m AS (SELECT channel, segment, min(start_uutc) AS start_time, max(end_uutc) AS end_time, min(start_sample) AS start_sample, CAST(sum(number_of_samples) AS BIGINT) AS number_of_samples, count(*) AS number_of_blocks FROM s GROUP BY ALL)"


@query("segment_map", f"WITH {_MAP} SELECT * FROM m")
def segment_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.segment_map(_segmented(spark, sf_dir))


@query("segment_boundaries", f"WITH {_MAP} SELECT channel, segment, lag(end_time) OVER o AS previous_end, start_time - lag(end_time) OVER o AS gap_us FROM m WINDOW o AS (PARTITION BY channel ORDER BY segment)")
def segment_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.boundary_gaps(catalog.segment_map(_segmented(spark, sf_dir))).select("channel", "segment", "previous_end", "gap_us")


@query("channel_info", f"WITH {_MAP} SELECT channel, CAST(count(*) AS INTEGER) AS n_segments, min(start_time) AS start_time, max(end_time) AS end_time, CAST(sum(number_of_samples) AS BIGINT) AS number_of_samples, arg_min(number_of_blocks, segment) AS first_blocks FROM m GROUP BY channel")
def channel_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = catalog.segment_map(_segmented(spark, sf_dir)).withColumnRenamed("number_of_blocks", "first_blocks")
    return catalog.channel_info(segments, ["first_blocks"])


@query("channel_list", f"WITH {_L} SELECT DISTINCT channel FROM l")
def channel_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("channel")).distinct().orderBy("channel")


_STATS = """channel, segment, CAST(sum(number_of_samples) AS BIGINT) AS number_of_samples, count(*) AS number_of_blocks, max(number_of_samples) AS maximum_block_samples, greatest(count(*) FILTER (discontinuity), 1) AS number_of_discontinuities,
max(maximum_sample_value) AS maximum_sample_value, min(minimum_sample_value) AS minimum_sample_value, min(start_uutc) AS start_time, max(end_uutc) AS end_time"""


@query("segment_stats", f"WITH {_SEGMENTED}, t AS (SELECT {_STATS} FROM s GROUP BY channel, segment) SELECT *, end_time - start_time AS recording_duration, CAST(round(maximum_block_samples * 1e6 / 256.0) AS BIGINT) AS block_interval FROM t")
def segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.with_duration(catalog.segment_stats(_segmented(spark, sf_dir)), sig.FS)


@query("append_merge_stats", f"WITH {_BLOCKS} SELECT {_STATS} FROM b GROUP BY channel, segment")
def append_merge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four parts merged: equal to the statistics of the whole, if every part has a discontinuity."""
    parts = catalog.segment_stats(_segmented(spark, sf_dir))
    return catalog.merged_stats(parts.withColumn("segment", F.lit(0)))


@query("run_stitch", f"WITH {_RUNS} SELECT r.channel, CAST(row_number() OVER (PARTITION BY r.channel ORDER BY run_begin) - 1 AS BIGINT) AS run, {_TIME.replace('pos', 'run_begin')} AS start_uutc, CAST(sum(n) OVER (PARTITION BY r.channel ORDER BY run_begin) - n AS BIGINT) AS start_sample, n AS number_of_samples, (n + 63) // 64 AS blocks FROM r")
def run_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.runs(_blocks(spark, sf_dir))


@query(
    "append_conflict_flags",
    f"""WITH {_MAP}, a AS (SELECT channel, segment, start_time, lag(end_time) OVER (PARTITION BY channel ORDER BY segment) + (segment - 2) * 4000 AS old_end, CASE WHEN segment = 2 THEN 512.0 ELSE 256.0 END::DOUBLE AS fs, 256.0::DOUBLE AS old_fs, CASE WHEN channel = 'A' THEN 0.5 ELSE 0.01 END::DOUBLE AS ufact, 0.01::DOUBLE AS old_ufact FROM m)
SELECT channel, segment, NOT (abs(old_fs - fs) <= 1e-9 * greatest(1.0, abs(old_fs))) AS rate_conflict, NOT (abs(old_ufact - ufact) <= 1e-12 * greatest(1.0, abs(old_ufact))) AS factor_conflict, NOT (start_time >= old_end - CAST(round(0.5e6 / fs) AS BIGINT)) AS time_conflict FROM a""",
)
def append_conflict_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = catalog.boundary_gaps(catalog.segment_map(_segmented(spark, sf_dir)))
    a = m.withColumns({"old_end": F.col("previous_end") + (F.col("segment") - 2) * 4000, "fs": F.when(F.col("segment") == 2, 512.0).otherwise(256.0), "old_fs": F.lit(256.0), "ufact": F.when(F.col("channel") == "A", 0.5).otherwise(0.01), "old_ufact": F.lit(0.01)})
    return catalog.append_conflicts(a).select("channel", "segment", "rate_conflict", "factor_conflict", "time_conflict")


@query(
    "multi_window_read",
    f"""WITH {_BLOCKS}, w2 AS (SELECT o_orderkey AS window_id, CASE o_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS channel, {sig.START} + (o_orderkey % 90000) * 1000 AS t0, {sig.START} + (o_orderkey % 90000) * 1000 + 700000 AS t1 FROM orders)
SELECT window_id, b.channel, count(*) AS blocks, CAST(sum(number_of_samples) AS BIGINT) AS samples, max(maximum_sample_value) AS hi FROM b JOIN w2 ON b.channel = w2.channel AND b.end_uutc > w2.t0 AND b.start_uutc < w2.t1 GROUP BY ALL""",
)
def multi_window_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousands of windows of 0.7 s, one per order, on the channel its customer picks."""
    names = F.array(*map(F.lit, ("A", "N", "R")))
    t0 = F.lit(sig.START) + (F.col("o_orderkey") % 90000) * 1000
    windows = sig.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("window_id"), F.get(names, (F.col("o_custkey") % 3).cast("int")).alias("channel"), t0.alias("t0"), (t0 + 700_000).alias("t1"))
    met = read.windows_over(_blocks(spark, sf_dir), windows, 1_000_000)
    return met.groupBy("window_id", "channel").agg(F.count("*").alias("blocks"), F.sum("number_of_samples").alias("samples"), F.max("maximum_sample_value").alias("hi"))


@query("overlap_last_wins", f"WITH {_E}, w AS (SELECT channel, min(t) AS t0 FROM e GROUP BY channel) SELECT channel, CAST(round(CAST(t - t0 AS DOUBLE) * {_FS} / 24 / 1e6) AS BIGINT) AS idx, arg_max(value, event_id) AS value, count(*) AS met FROM e JOIN w USING (channel) GROUP BY ALL")
def overlap_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sig.events(spark, sf_dir)
    idx = tg.grid_index("t", "t0", F.lit(sig.HOUR_FS) / 24)
    first = e.groupBy("channel").agg(F.min("t").alias("t0"))
    return e.join(first, "channel").groupBy("channel", idx.alias("idx")).agg(F.max_by("value", "event_id").alias("value"), F.count("*").alias("met"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sig.table(spark, sf_dir, "events").where("event_type = 'error'")
    kind = F.when(F.col("event_id") % 3 == 0, F.lit("SyLg"))
    return r.select(F.when(F.col("user_id") % 2 == 0, F.lit("even")).alias("channel"), kind.alias("type"), sig.micros("ts").alias("time"), F.col("props").alias("text"), F.when(F.col("event_id") % 5 == 0, F.col("event_id")).alias("duration"), F.col("event_id").alias("position"))


_R = "r AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'even' END AS channel, CASE WHEN event_id % 3 = 0 THEN 'SyLg' END AS type, epoch_us(ts) AS time, props AS text, CASE WHEN event_id % 5 = 0 THEN event_id END AS duration, event_id AS position FROM events WHERE event_type = 'error')"


@query("records_sorted", f"WITH {_R} SELECT channel, time, text, position, row_number() OVER (PARTITION BY channel ORDER BY time, position) AS place FROM r")
def records_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("channel").orderBy("time", "position")).cast("long")
    return records.in_order(_records(spark, sf_dir)).withColumn("place", place).select("channel", "time", "text", "position", "place")


@query("records_defaulted", f"WITH {_R} SELECT channel, coalesce(type, 'Note') AS type, time, text, duration FROM r")
def records_defaulted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.defaulted(_records(spark, sf_dir))


@query("records_level", f"WITH {_R} SELECT time, text FROM r WHERE channel IS NULL")
def records_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.at_level(_records(spark, sf_dir), None).select("time", "text")


@query("records_extents", f"WITH {_R} SELECT channel, count(*) AS n_records, CAST(coalesce(max(strlen(text)), 0) AS INTEGER) AS longest, min(time) AS earliest, max(time) AS latest FROM r GROUP BY channel")
def records_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.extents(_records(spark, sf_dir))


@query("records_on_disk", f"WITH {_R} SELECT channel, position, CASE WHEN channel = 'even' THEN 1700000000000000 ELSE 0 END - time AS disk_time FROM r")
def records_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    offsets = spark.createDataFrame([("even", 1_700_000_000_000_000)], "channel string, rto long")
    return records.on_disk(_records(spark, sf_dir), offsets).select("channel", "position", "disk_time")


@query("scale_by_channel", f"WITH {_L} SELECT channel, pos AS idx, CAST(count AS DOUBLE) * CASE channel WHEN 'A' THEN 0.5 WHEN 'N' THEN 0.25 ELSE 2.0 END::DOUBLE AS value FROM l WHERE valid")
def scale_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    factors = spark.createDataFrame([("A", 0.5), ("N", 0.25), ("R", 2.0)], "name string, units_conversion_factor double")
    raw = sig.counts(spark, sf_dir).where("valid").select("channel", F.col("pos").alias("idx"), "count", "valid")
    return read.scaled(raw, factors).select("channel", "idx", "value")


_D = f"{_L}, d AS (SELECT channel, pos, count, CAST(count AS BIGINT) - lag(count) OVER (PARTITION BY channel, pos // 1024 ORDER BY pos) AS delta FROM l WHERE valid)"


def _by_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid counts in blocks of 1024 positions, each a difference stream of its own."""
    return sig.counts(spark, sf_dir).where("valid").select("channel", F.expr("pos div 1024").alias("block"), "pos", "count")


@query("delta_encode", f"WITH {_D} SELECT channel, pos, delta, delta IS NULL OR abs(delta) > 127 AS keyed FROM d")
def delta_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.deltas(_by_block(spark, sf_dir), ["channel", "block"], "pos").select("channel", "pos", "delta", "keyed")


@query("delta_decode", f"WITH {_L} SELECT channel, pos, count FROM l WHERE valid")
def delta_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ingest.deltas(_by_block(spark, sf_dir), ["channel", "block"], "pos").withColumn("key", F.when(F.col("keyed"), F.col("count"))).drop("count")
    return ingest.undelta(d, ["channel", "block"], "pos").select("channel", "pos", "count")


@query(
    "symbol_histogram",
    f"""WITH {_D}, f AS (SELECT channel, pos // 1024 AS block, pos, delta, unnest(CASE WHEN delta IS NULL THEN [0, 1, 2, 3] WHEN abs(delta) > 127 THEN [-1, 0, 1, 2, 3] ELSE [9] END) AS part, CAST(count AS BIGINT) & 4294967295 AS u FROM d),
h AS (SELECT channel, block, CAST(CASE part WHEN -1 THEN 128 WHEN 9 THEN delta & 255 ELSE (u >> (8 * part)) & 255 END AS INTEGER) AS symbol, count(*) AS n FROM f GROUP BY ALL),
k AS (SELECT *, max(n) OVER (PARTITION BY channel, block) AS most FROM h)
SELECT channel, block, symbol, n, CAST(CASE WHEN most > 255 THEN ceil(n * (254.999999999::DOUBLE / most)) ELSE n END AS BIGINT) AS scaled FROM k""",
)
def symbol_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.symbol_histogram(_by_block(spark, sf_dir), ["channel", "block"], "pos")


_RTO = 1_600_000_000_000_000


@query("abs_time_from_disk", f"WITH {_E} SELECT event_id, {_RTO} - t AS stored, CASE WHEN {_RTO} - t >= 0 THEN {_RTO} - t ELSE -({_RTO} - t) + {_RTO} END AS back FROM e")
def abs_time_from_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sig.events(spark, sf_dir).withColumn("stored", tg.disk_time("t", _RTO))
    return e.select("event_id", "stored", tg.absolute_time("stored", _RTO).alias("back"))


_C = "c AS (SELECT c_custkey AS k, c_name AS subject_name_1, n_name AS recording_location, c_custkey % 3 = 0 AS section3_available, CAST(c_nationkey AS INTEGER) AS gmt_offset, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN c_mktsegment END AS session_description, c_acctbal AS low FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sig.table(spark, sf_dir, "customer").join(sig.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.when(F.col("c_custkey") % 4 == 0, F.lit("")).when(F.col("c_custkey") % 4 == 1, F.col("c_mktsegment"))
    return c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("subject_name_1"), F.col("n_name").alias("recording_location"), (F.col("c_custkey") % 3 == 0).alias("section3_available"), F.col("c_nationkey").cast("int").alias("gmt_offset"), text.alias("session_description"), F.col("c_acctbal").alias("low"))


@query("masked_subject", f"WITH {_C} SELECT k, section3_available, CASE WHEN section3_available THEN subject_name_1 END AS subject_name_1, CASE WHEN section3_available THEN recording_location END AS recording_location, CASE WHEN section3_available THEN gmt_offset END AS gmt_offset FROM c")
def masked_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.masked(_subjects(spark, sf_dir)).select("k", "section3_available", "subject_name_1", "recording_location", "gmt_offset")


@query("metadata_defaults", f"WITH {_C} SELECT k, coalesce(nullif(session_description, ''), subject_name_1) AS session_description, coalesce(CASE WHEN low > 0 THEN low END, -1.0) AS low_frequency_filter, coalesce(CASE WHEN section3_available THEN gmt_offset END, 0) AS gmt_offset FROM c")
def metadata_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = metadata.described(metadata.masked(_subjects(spark, sf_dir)).withColumns({"channel_description": F.lit(""), "low_frequency_filter": F.when(F.col("low") > 0, F.col("low"))}).withColumn("name", F.lit(None).cast("string")), "name", "name")
    c = c.drop("session_description").join(_subjects(spark, sf_dir).select("k", "session_description", F.col("subject_name_1").alias("who")), "k")
    c = c.withColumn("session_description", tg.described("session_description", "who"))
    missing = {n: F.lit(None) for n in (*metadata.ACQUISITION, *metadata.SUBJECT_COLUMNS.values()) if n not in c.columns}
    return metadata.flattened(metadata.nested(c.withColumns(missing)).select("k", "acquisition", "subject")).select("k", "session_description", "low_frequency_filter", "gmt_offset")


@query("legacy_property_names", "SELECT property, count(*) AS given FROM (SELECT unnest(['acquisition_channel_number', 'session_description', 'subject_id', 'subject_name_1']) AS property, unnest([c_nationkey IS NOT NULL, c_mktsegment <> 'BUILDING', c_custkey IS NOT NULL, c_acctbal > 0]) AS given FROM customer) WHERE given GROUP BY property")
def legacy_property_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many rows each property of older names is given, under its current name."""
    c = sig.table(spark, sf_dir, "customer")
    older = c.select(
        F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("subject_name_1"), F.col("c_custkey").cast("string").alias("subject_ID"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("session_description"),
        F.col("c_nationkey").cast("string").alias("acquisition_channel_number"), F.col("c_acctbal").alias("unknown"),
    )
    named = metadata.renamed(older)
    return named.unpivot([], metadata.property_names(named), "property", "value").where("value is not null").groupBy("property").agg(F.count("*").alias("given"))


@query("fingerprint_diff", "WITH a AS (SELECT p_partkey AS path, p_size AS size FROM part), b AS (SELECT p_partkey AS path, CASE WHEN p_partkey % 50 = 0 THEN p_size + 1 ELSE p_size END AS size FROM part WHERE p_partkey % 70 <> 0) SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def fingerprint_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = sig.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("size"))
    b = a.where("path % 70 <> 0").withColumn("size", F.when(F.col("path") % 50 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return catalog.fingerprint_diff(a, b)


@query("password_sha", "SELECT c_custkey, sha256(c_name) AS digest, substr(sha256(c_name), 1, 32) AS field FROM customer")
def password_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.col("c_name").cast("binary"), 256)
    return sig.table(spark, sf_dir, "customer").select("c_custkey", digest.alias("digest"), F.substring(digest, 1, 32).alias("field"))


@query("segment_names", "SELECT o_orderkey, format('{}-{:06d}', o_orderpriority, o_orderkey % 1000) AS name, CAST(o_orderkey % 1000 AS INTEGER) AS number FROM orders")
def segment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = sig.table(spark, sf_dir, "orders").select("o_orderkey", tg.segment_name("o_orderpriority", F.col("o_orderkey") % 1000).alias("name"))
    return named.withColumn("number", tg.segment_number("name"))


@query("channel_counts", f"WITH {_MAP} SELECT channel, count(*) AS n_segments, CAST(sum(number_of_blocks) AS BIGINT) AS n_blocks FROM m GROUP BY channel")
def channel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.segment_map(_segmented(spark, sf_dir)).groupBy("channel").agg(F.count("*").alias("n_segments"), F.sum("number_of_blocks").alias("n_blocks"))


@query("block_lengths", "SELECT s_suppkey, CAST(CASE WHEN s_acctbal >= 5000 THEN floor(s_acctbal) ELSE floor(s_acctbal * 10) END AS BIGINT) AS n, CAST(round(-log10(pow(10.0, -(s_suppkey % 8)))) AS INTEGER) AS precision FROM supplier")
def block_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.table(spark, sf_dir, "supplier").select("s_suppkey", tg.block_length("s_acctbal").alias("n"), tg.precision_of(tg.factor(F.col("s_suppkey") % 8)).alias("precision"))


@query("linear_retrend", f"WITH {_L} SELECT channel, pos, CAST(greatest(least(round(count * 1.5 + 0.25 * (pos + 1) - 3.0), 2147483647.0), -2147483647.0) AS INTEGER) AS count FROM l WHERE valid")
def linear_retrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    trend = F.col("count") * F.lit(1.5) + F.lit(0.25) * (F.col("pos") + 1) - F.lit(3.0)
    return sig.counts(spark, sf_dir).where("valid").select("channel", "pos", tg.round_to_int(trend).alias("count"))


@query("codec_roundtrip", ORACLE["block_samples"])
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block coded and decoded again: what comes back is what went in."""
    back = codec.decoded(codec.encoded(_blocks(spark, sf_dir, True)))
    return back.select("channel", "block_no", F.array_join("samples", ",").alias("samples"))


@query("codec_flags", f"WITH {_BLOCKS} SELECT channel, block_no, start_uutc, discontinuity FROM b")
def codec_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start times and flags through the codec, with encrypted statistics."""
    keys = crypto.access("two", *crypto.validation_fields("one", "two"))
    back = codec.decoded(codec.encoded(_blocks(spark, sf_dir, True), 1, keys), keys)
    return back.select("channel", "block_no", "start_uutc", "discontinuity")


@query("cipher_roundtrip", "SELECT c_custkey, c_name FROM customer")
def cipher_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names padded to 32 bytes, encrypted block by block and decrypted."""
    key = crypto.password_bytes("key")
    c = sig.table(spark, sf_dir, "customer").select("c_custkey", F.rpad("c_name", 32, " ").cast("binary").alias("plain"))
    locked = c.select("c_custkey", crypto.aes_ecb_column(key, True)(F.col("plain")).alias("locked"))
    opened = locked.select("c_custkey", crypto.aes_ecb_column(key, False)(F.col("locked")).cast("string").alias("c_name"))
    return opened.withColumn("c_name", F.rtrim("c_name"))


@query("checksums")
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checksum of each customer's name; its polynomial is beyond SQL, tests hold it against a bitwise one."""
    return sig.table(spark, sf_dir, "customer").select("c_custkey", crypto.crc32k(F.col("c_name").cast("binary")).alias("crc"))


@query("flag_test", "SELECT event_id, event_id & 1 <> 0 AS discontinuity, event_id & 2 <> 0 AS level_1, event_id & 4 <> 0 AS level_2 FROM events")
def flag_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {n: tg.has_flag("event_id", m).alias(n) for n, m in (("discontinuity", 1), ("level_1", 2), ("level_2", 4))}
    return sig.table(spark, sf_dir, "events").select("event_id", *flags.values())


@query("member_names", "SELECT p_partkey, trim(regexp_replace('./' || p_brand || '/' || p_name || '/', '^(\\./)+', ''), '/') AS name FROM part")
def member_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("./"), "p_brand", F.lit("/"), "p_name", F.lit("/"))
    return sig.table(spark, sf_dir, "part").select("p_partkey", tg.member_name(raw).alias("name"))


_FILES = "f AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'A.timd/A-000001.segd/A-000001.tmet' WHEN 1 THEN 'A.timd/A-000001.segd/A-000001.tidx' WHEN 2 THEN 'v.vidd/x.segd/x.tmet' WHEN 3 THEN 'B.timd/B.rdat' ELSE 'A.timd/A-000001.segd/A-000001.tdat' END AS path, o_custkey % 50 AS session FROM orders)"


@query("complete_segments", f"WITH {_FILES} SELECT session, split_part(path, '/', 1) AS channel, split_part(path, '/', 2) AS segment FROM f WHERE path LIKE '%.timd/%.segd/%' AND regexp_matches(path, '[.](tmet|tidx|tdat)$') GROUP BY ALL HAVING count(DISTINCT right(path, 4)) = 3")
def complete_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that have all three of their files, from a file listing."""
    kinds = ["A.timd/A-000001.segd/A-000001.tmet", "A.timd/A-000001.segd/A-000001.tidx", "v.vidd/x.segd/x.tmet", "B.timd/B.rdat", "A.timd/A-000001.segd/A-000001.tdat"]
    path = F.get(F.array(*map(F.lit, kinds)), (F.col("o_orderkey") % 5).cast("int"))
    files = sig.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("session"), path.alias("path"))
    return catalog.complete_segments(files)


@query("concat_segments", f"WITH {_SEGMENTED} SELECT channel, block_no, CAST(sum(number_of_samples) OVER (PARTITION BY channel ORDER BY segment, block_no) AS BIGINT) AS so_far FROM s WHERE segment <> 2")
def concat_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments end to end, one left out."""
    s = _segmented(spark, sf_dir)
    parts = s.where("segment = 0").unionByName(s.where("segment = 1")).unionByName(s.where("segment = 3"))
    return parts.select("channel", "block_no", F.sum("number_of_samples").over(Window.partitionBy("channel").orderBy("segment", "block_no")).alias("so_far"))


@query("pick_channels", f"WITH {_MAP} SELECT channel, CAST(sum(number_of_samples) AS BIGINT) AS n FROM m WHERE channel IN ('R', 'A') GROUP BY channel")
def pick_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = catalog.channel_info(catalog.segment_map(_segmented(spark, sf_dir)))
    return metadata.picked(info, "channel", ["R", "A", "missing", "R"]).select("channel", F.col("number_of_samples").alias("n"))


@query("renamed_keys", "SELECT c_name AS subject_name_1, c_custkey AS subject_id, c_mktsegment AS session_description FROM customer")
def renamed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    older = sig.table(spark, sf_dir, "customer").select(F.col("c_name").alias("subject_name_1"), F.col("c_custkey").alias("subject_ID"), F.col("c_mktsegment").alias("session_description"), F.col("c_acctbal").alias("unknown"))
    return metadata.renamed(older)


@query("fixed_width_text", "SELECT p_partkey, substr(p_name, 1, 7) AS field FROM part")
def fixed_width_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.table(spark, sf_dir, "part").select("p_partkey", tg.fixed_text("p_name", 7).alias("field"))


@query("count_guard", "SELECT o_orderkey, abs(o_totalprice * 100000) <= 2147483647 AS fits, CASE WHEN abs(o_totalprice * 100000) <= 2147483647 THEN CAST(round(o_totalprice * 100000) AS INTEGER) END AS count FROM orders")
def count_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which values fit 32-bit counts at five decimals; quantize() raises for the others."""
    o = sig.table(spark, sf_dir, "orders")
    fits = F.abs(F.col("o_totalprice") * 100000) <= tg.INT_MAX
    return o.select("o_orderkey", fits.alias("fits"), tg.quantize(F.when(fits, F.col("o_totalprice")), 5).alias("count"))


@query("aligned_channels", f"WITH {_GRID} SELECT idx, max(value) FILTER (channel = 'click') AS click, max(value) FILTER (channel = 'error') AS error, count(value) AS present FROM gr LEFT JOIN p USING (channel, idx) GROUP BY idx")
def aligned_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels side by side on their grids, a row per position."""
    g = grid_read(spark, sf_dir)
    pick = {c: F.max(F.when(F.col("channel") == c, F.col("value"))).alias(c) for c in ("click", "error")}
    return g.groupBy("idx").agg(*pick.values(), F.count("value").alias("present"))
