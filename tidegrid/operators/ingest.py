"""From samples to blocks.

Order-dependent steps work on chunks of positions first, so one giant channel
is many tasks, and only a few rows per chunk meet in a window per channel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions import timegrid as tg

CHUNK = 1 << 20
_INT_MIN, _INT_MAX = float(-(1 << 31)), float((1 << 31) - 1)


def _chunk(size: int) -> Column:
    return F.expr(f"pos div {size}")


def pieces(samples: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """samples (channel, pos, valid). The valid rows with island (positions of one run share it, inside a chunk), stored (running number of valid rows in the channel)."""
    valid = samples.where("valid").withColumn("chunk", _chunk(chunk))
    totals = valid.groupBy("channel", "chunk").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("channel").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.withColumn("ahead", F.coalesce(ahead, F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("channel", "chunk").orderBy("pos"))
    out = valid.withColumn("rn", within).join(totals, ["channel", "chunk"])
    return out.withColumns({"island": F.col("pos") - F.col("rn"), "stored": F.col("ahead") + F.col("rn") - 1}).drop("rn", "ahead")


def islands(samples: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Maximal runs of valid positions: channel, run_begin, run_end (exclusive), n."""
    parts = pieces(samples, chunk).groupBy("channel", "chunk", "island").agg(F.min("pos").alias("b"), F.max("pos").alias("l"))
    return _stitched(parts, chunk).groupBy("channel", "run_begin").agg((F.max("l") + 1).alias("run_end"), F.sum(F.col("l") - F.col("b") + 1).alias("n"))


def _stitched(parts: DataFrame, chunk: int) -> DataFrame:
    """parts with run_begin. Only those at a chunk's edge can continue one another; they are two per chunk at most."""
    edge = (F.col("b") % chunk == 0) | (F.col("l") % chunk == chunk - 1)
    order = Window.partitionBy("channel").orderBy("b")
    edges = parts.where(edge).withColumn("new", (F.col("b") != F.coalesce(F.lag("l").over(order), F.lit(-2)) + 1).cast("int"))
    edges = edges.withColumn("g", F.sum("new").over(order))
    edges = edges.withColumn("run_begin", F.min("b").over(Window.partitionBy("channel", "g"))).drop("new", "g")
    return parts.where(~edge).withColumn("run_begin", F.col("b")).unionByName(edges)


def _numbered(parts: DataFrame, chunk: int, length: int) -> DataFrame:
    """parts of _stitched() with first_block, the number of the run's first block in the channel: counted by run and summed up by chunk, before any sample is touched."""
    runs = parts.groupBy("channel", "run_begin").agg(F.sum(F.col("l") - F.col("b") + 1).alias("n"))
    runs = runs.withColumns({"blocks": F.ceil(F.col("n") / length), "__c": F.expr(f"run_begin div {chunk}")})
    totals = runs.groupBy("channel", "__c").agg(F.sum("blocks").alias("all"))
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("channel", "__c", F.coalesce(F.sum("all").over(before(["channel"], "__c")), F.lit(0)).alias("ahead"))
    within = F.coalesce(F.sum("blocks").over(before(["channel", "__c"], "run_begin")), F.lit(0))
    runs = runs.withColumn("within", within).join(totals, ["channel", "__c"]).select("channel", "run_begin", (F.col("ahead") + F.col("within")).alias("first_block"))
    return parts.join(runs, ["channel", "run_begin"]).select("channel", "chunk", "island", "run_begin", "first_block")


def tile(samples: DataFrame, start_uutc: int, fs: float, block_len: int | None = None, first_sample: int = 0, chunk: int = CHUNK, collect: bool = True) -> DataFrame:
    """samples (channel, pos, count, valid) as blocks: channel, block_no, start_uutc, end_uutc, start_sample, number_of_samples, extrema, discontinuity, total, samples.

    Blocks tile each run; a run's first block is a discontinuity. total is the sum
    of counts; samples is left out unless collect.
    """
    length = block_len or (int(fs) if fs >= 5000 else int(fs * 10))
    rows = pieces(samples, chunk)
    parts = rows.groupBy("channel", "chunk", "island").agg(F.min("pos").alias("b"), F.max("pos").alias("l"))
    rows = rows.join(_numbered(_stitched(parts, chunk), chunk, length), ["channel", "chunk", "island"])
    rows = rows.withColumn("tile", F.expr(f"(pos - run_begin) div {length}"))
    listed = {"samples": F.transform(F.array_sort(F.collect_list(F.struct("pos", "count"))), lambda x: x["count"])} if collect else {}
    blocks = rows.groupBy("channel", "run_begin", "first_block", "tile").agg(
        F.min("pos").alias("pos"), F.min("stored").alias("start_sample"), F.count("*").alias("number_of_samples"), F.max("count").alias("maximum_sample_value"),
        F.min("count").alias("minimum_sample_value"), F.sum("count").alias("total"), *(c.alias(n) for n, c in listed.items()),
    )
    block_no = (F.col("first_block") + F.col("tile")).cast("int")
    begin = tg.block_start(F.lit(start_uutc), "pos", F.lit(fs))
    blocks = blocks.withColumns({"block_no": block_no, "start_uutc": begin, "start_sample": F.col("start_sample") + first_sample, "discontinuity": F.col("tile") == 0})
    blocks = blocks.withColumn("end_uutc", tg.block_end("start_uutc", "number_of_samples", F.lit(fs)))
    return blocks.drop("run_begin", "first_block", "tile", "pos")


def gap_count(runs: DataFrame) -> DataFrame:
    """Interior gaps by channel."""
    return runs.groupBy("channel").agg(F.greatest(F.count("*") - 1, F.lit(0)).alias("gaps_skipped"))


def write_summary(blocks: DataFrame, segment: int) -> DataFrame:
    """channel, samples_written, blocks, gaps_skipped, segment of one write."""
    agg = blocks.groupBy("channel").agg(F.sum("number_of_samples").alias("samples_written"), F.count("*").alias("blocks"), (F.count_if("discontinuity") - 1).alias("gaps_skipped"))
    return agg.withColumn("segment", F.lit(segment))


def infer_precision(samples: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """samples (channel, pos, value), positions dense. channel, precision: decimals that bring the mean step to a thousand counts.

    Steps next to a gap do not count. Precision backs off while both extrema leave 32 bits; all gaps give 0.
    """
    rows = samples.withColumns({"chunk": _chunk(chunk), "value": F.when(tg.is_valid("value"), F.col("value"))})
    before = F.lag("value").over(Window.partitionBy("channel", "chunk").orderBy("pos"))
    inner = rows.withColumn("step", F.abs(F.col("value") - before)).groupBy("channel").agg(F.sum("step").alias("s"), F.count("step").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    # Steps over chunk borders: the last row of a chunk against the first of the next.
    ends = rows.groupBy("channel", "chunk").agg(F.min_by(F.struct("pos", "value"), "pos").alias("f"), F.max_by(F.struct("pos", "value"), "pos").alias("l"))
    last = F.lag("l").over(Window.partitionBy("channel").orderBy("chunk"))
    over = ends.withColumn("p", last).withColumn("step", F.when(F.col("p.pos") + 1 == F.col("f.pos"), F.abs(F.col("f.value") - F.col("p.value"))))
    over = over.groupBy("channel").agg(F.sum("step").alias("s2"), F.count("step").alias("n2"))
    total = inner.join(over, "channel")
    mean = (F.coalesce("s", F.lit(0.0)) + F.coalesce("s2", F.lit(0.0))) / (F.col("n") + F.col("n2"))
    total = total.withColumn("mean", F.coalesce(F.when(F.col("n") + F.col("n2") > 0, mean), F.lit(0.0)))
    steps = F.size(F.filter(F.sequence(F.lit(0), F.lit(60)), lambda k: (F.col("mean") != 0) & (F.col("mean") * F.pow(F.lit(10.0), k) < 1000)))
    fits = lambda k: ~((F.col("lo") * F.pow(F.lit(10.0), k) < _INT_MIN) & (F.col("hi") * F.pow(F.lit(10.0), k) > _INT_MAX))
    backed = F.array_max(F.filter(F.sequence(F.lit(0), steps), lambda k: (k == 0) | fits(k)))
    return total.select("channel", F.when(F.col("hi").isNull(), 0).otherwise(backed).alias("precision"))


def deltas(samples: DataFrame, partition: list[str], order: str) -> DataFrame:
    """Adds delta to the count before in order, and keyed: the first, and where the step leaves -127..127."""
    step = F.col("count").cast("long") - F.lag("count").over(Window.partitionBy(*partition).orderBy(order)).cast("long")
    return samples.withColumn("delta", step).withColumn("keyed", F.col("delta").isNull() | (F.abs("delta") > 127))


def undelta(encoded: DataFrame, partition: list[str], order: str) -> DataFrame:
    """The counts of deltas(): a running sum that restarts at keyed rows (which carry key, the full count)."""
    by = Window.partitionBy(*partition).orderBy(order)
    grouped = encoded.withColumn("__g", F.sum(F.col("keyed").cast("int")).over(by))
    add = F.when(F.col("keyed"), F.col("key")).otherwise(F.col("delta"))
    return grouped.withColumn("count", F.sum(add).over(Window.partitionBy(*partition, "__g").orderBy(order)).cast("int")).drop("__g")


def symbol_histogram(samples: DataFrame, partition: list[str], order: str) -> DataFrame:
    """Byte frequencies of the difference stream by partition: partition..., symbol, n, scaled (at most 255).

    A step is its own byte; a keyed sample is the byte 128 (not for the first) and four bytes of its count.
    """
    rows = deltas(samples, partition, order)
    byte = lambda k: F.shiftrightunsigned("count", 8 * k).bitwiseAND(255)
    four = F.array(*(byte(k) for k in range(4)))
    symbols = F.when(F.col("delta").isNull(), four).when(F.col("keyed"), F.concat(F.array(F.lit(128)), four)).otherwise(F.array(F.col("delta").cast("int").bitwiseAND(255)))
    counts = rows.select(*partition, F.explode(symbols).alias("symbol")).groupBy(*partition, "symbol").agg(F.count("*").alias("n"))
    most = F.max("n").over(Window.partitionBy(*partition))
    return counts.withColumn("scaled", F.when(most > 255, F.ceil(F.col("n") * (F.lit(254.999999999) / most))).otherwise(F.col("n")).cast("long"))
