"""Reading time windows back onto sampling grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions import timegrid as tg

_CHUNK = 1 << 16  # grid rows one task makes from one row
_SPAN = 1 << 26  # grid positions whose blocks one task orders
_BLOCKS = 1 << 16  # blocks that one task orders


def grid(windows: DataFrame) -> DataFrame:
    """windows (keys..., t0, t1, fs) as one row per grid position: keys..., t0, fs, idx, t.

    Positions are made in two steps, chunks first and then each chunk's positions,
    with the chunks dealt to all tasks, so one huge window is no huge row.
    """
    keys = [c for c in windows.columns if c not in ("t0", "t1", "fs")]
    n = tg.grid_length("t0", "t1", "fs")
    sized = windows.withColumn("__n", n).where("__n > 0")
    chunks = sized.select(*keys, "t0", "fs", "__n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(_CHUNK).cast("long"))).alias("__b"))
    last = F.least(F.col("__b") + _CHUNK, F.col("__n")) - 1
    return chunks.select(*keys, "t0", "fs", F.explode(F.sequence(F.col("__b"), last)).alias("idx")).withColumn("t", tg.block_start("t0", "idx", "fs"))


def on_grid(samples: DataFrame, windows: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """samples (keys..., t, value) placed on the grids of windows (keys..., t0, t1, fs), gaps null: keys..., idx, t, value, valid.

    Where several samples meet in a position the last by order (by default time) stays.
    """
    fit = samples.join(windows, keys).withColumn("idx", tg.grid_index("t", "t0", "fs"))
    fit = fit.where((F.col("idx") >= 0) & (F.col("idx") < tg.grid_length("t0", "t1", "fs")))
    last = F.struct(*(order or [F.col("t"), F.col("value")]))
    placed = fit.groupBy(*keys, "idx").agg(F.max_by("value", last).alias("value"))
    out = grid(windows).select(*keys, "idx", "t").join(placed, [*keys, "idx"], "left")
    return out.withColumn("valid", F.col("value").isNotNull())


def within(blocks: DataFrame, t0: int | None, t1: int | None) -> DataFrame:
    """Blocks that overlap [t0, t1), by stored start and end, so both sides reach the Parquet scan; invalid entries go."""
    kept = blocks.where("number_of_samples > 0")
    if t0 is not None:
        kept = kept.where(F.col("end_uutc") > t0)
    return kept if t1 is None else kept.where(F.col("start_uutc") < t1)


def samples_of(blocks: DataFrame, t0, fs) -> DataFrame:
    """One row per stored sample: channel, segment, block_no, idx, count. The position is rounded once a block."""
    base = blocks.withColumn("__i", tg.grid_index("start_uutc", t0, fs))
    return base.select("channel", "segment", "block_no", "__i", F.posexplode("samples").alias("__k", "count")).select(
        "channel", "segment", "block_no", (F.col("__i") + F.col("__k")).alias("idx"), "count"
    )


def read_raw(blocks: DataFrame, t0: int, t1: int, fs: float) -> DataFrame:
    """channel, idx, count, valid for [t0, t1) of each channel in blocks; overlaps go to the later (segment, block).

    Samples are exploded from their blocks and only gaps are generated, from block
    ends, so nothing is joined or shuffled sample by sample. Blocks that overlap
    in time are found at block level; only then are positions grouped.
    """
    n = max(0, int(abs((t1 - t0) * fs / 1e6) + 0.5)) if t1 > t0 else 0
    hits = within(blocks, t0, t1)
    spans = hits.select("channel", "segment", "block_no", tg.grid_index("start_uutc", F.lit(t0), F.lit(fs)).alias("b"), "number_of_samples")
    spans = spans.withColumn("e", F.col("b") + F.col("number_of_samples"))
    spans = _reached(spans)
    rows = samples_of(hits, F.lit(t0), F.lit(fs)).where(F.col("idx").between(0, n - 1))
    if spans.where("b < reach").isEmpty():
        rows = rows.select("channel", "idx", "count")
    else:
        rows = rows.groupBy("channel", "idx").agg(F.max_by("count", F.struct("segment", "block_no")).alias("count"))
    zero, end = F.lit(0).cast("long"), F.lit(n).cast("long")
    gaps = spans.select("channel", F.greatest(F.coalesce("reach", zero), zero).alias("b"), F.least("b", end).alias("e"))
    tails = spans.groupBy("channel").agg(F.greatest(F.max("e"), zero).alias("b")).withColumn("e", end)
    none = blocks.select("channel").distinct().join(spans.select("channel").distinct(), "channel", "left_anti").select("channel", zero.alias("b"), end.alias("e"))
    holes = gaps.unionByName(tails).unionByName(none).where("b < e")
    holes = holes.select("channel", "e", F.explode(F.sequence(F.col("b"), F.col("e") - 1, F.lit(_CHUNK).cast("long"))).alias("b"))
    holes = holes.select("channel", F.explode(F.sequence(F.col("b"), F.least(F.col("b") + _CHUNK, F.col("e")) - 1)).alias("idx"))
    return rows.withColumn("valid", F.lit(True)).unionByName(holes.withColumns({"count": F.lit(None).cast("int"), "valid": F.lit(False)}))


def _reached(spans: DataFrame, span: int = _SPAN) -> DataFrame:
    """spans (channel, b, e) with reach, the farthest end of the channel's spans before it: by stretches of positions, with what earlier stretches reach joined on."""
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.withColumn("__c", F.expr(f"b div {span}"))
    far = rows.groupBy("channel", "__c").agg(F.max("e").alias("far"))
    far = far.select("channel", "__c", F.max("far").over(ahead(Window.partitionBy("channel").orderBy("__c"))).alias("__far"))
    inside = F.max("e").over(ahead(Window.partitionBy("channel", "__c").orderBy("b", "e")))
    return rows.withColumn("__in", inside).join(far, ["channel", "__c"]).withColumn("reach", F.greatest("__in", "__far")).drop("__c", "__in", "__far")


def scaled(raw: DataFrame, channels: DataFrame) -> DataFrame:
    """raw with value in physical units, by each channel's own factor."""
    return raw.join(channels.select(F.col("name").alias("channel"), "units_conversion_factor"), "channel").withColumn("value", tg.scale("count", "units_conversion_factor", "valid")).drop("units_conversion_factor")


def windows_over(blocks: DataFrame, windows: DataFrame, bucket_us: int) -> DataFrame:
    """Each window's overlapping blocks: an equi-join on (channel, time bucket), then the exact test.

    Both sides take the buckets they touch; a pair that meets in several counts in
    the first of them, so no distinct is needed.
    """
    buckets = lambda a, b: F.explode(F.sequence(F.expr(f"{a} div {bucket_us}"), F.expr(f"({b} - 1) div {bucket_us}")))
    b = blocks.where("number_of_samples > 0").withColumn("__bucket", buckets("start_uutc", "greatest(end_uutc, start_uutc + 1)"))
    w = windows.where("t1 > t0").withColumn("__bucket", buckets("t0", "t1"))
    met = b.join(w, ["channel", "__bucket"]).where(tg.overlaps("start_uutc", "end_uutc", "t0", "t1"))
    return met.where(F.col("__bucket") == F.expr(f"greatest(start_uutc, t0) div {bucket_us}")).drop("__bucket")


def runs(blocks: DataFrame, size: int = _BLOCKS) -> DataFrame:
    """Maximal contiguous runs of blocks: channel, run, start_uutc, start_sample, number_of_samples, blocks.

    A run starts at a discontinuity or where start_sample is not what the block before led to.
    Blocks are ordered by groups of size numbers; only what a group begins and ends with meets in a window per channel.
    """
    rows = blocks.withColumns({"__c": F.expr(f"block_no div {size}"), "__due": F.col("start_sample") + F.col("number_of_samples")})
    inner, outer = Window.partitionBy("channel", "segment", "__c").orderBy("block_no"), Window.partitionBy("channel").orderBy("segment", "__c")
    starts = lambda due: (F.col("discontinuity") | due.isNull() | (due != F.col("start_sample"))).cast("int")
    rows = rows.withColumns({"__place": F.row_number().over(inner), "__new": starts(F.lag("__due").over(inner))})
    groups = rows.groupBy("channel", "segment", "__c").agg(
        F.max_by("__due", "block_no").alias("__due"), F.min_by("discontinuity", "block_no").alias("discontinuity"), F.min_by("start_sample", "block_no").alias("start_sample"), F.sum("__new").alias("__n")
    )
    groups = groups.withColumn("__first", starts(F.lag("__due").over(outer)))
    ahead = F.sum(F.col("__n") - 1 + F.col("__first")).over(outer.rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.select("channel", "segment", "__c", "__first", F.coalesce(ahead, F.lit(0)).alias("__ahead"))
    marked = rows.join(groups, ["channel", "segment", "__c"]).withColumn("__new", F.when(F.col("__place") == 1, F.col("__first")).otherwise(F.col("__new")))
    marked = marked.withColumn("run", F.col("__ahead") + F.sum("__new").over(inner) - 1)
    first = F.struct("segment", "block_no")
    return marked.groupBy("channel", "run").agg(
        F.min_by("start_uutc", first).alias("start_uutc"), F.min_by("start_sample", first).alias("start_sample"), F.sum("number_of_samples").alias("number_of_samples"), F.count("*").alias("blocks")
    )
