"""Roll-ups of blocks to segments and channels, and the checks of an append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions import timegrid as tg


def toc(blocks: DataFrame) -> DataFrame:
    """The block table without samples, in file order; invalid entries left out."""
    return blocks.drop("samples").where("number_of_samples > 0").orderBy("channel", "segment", "block_no")


def segment_map(blocks: DataFrame) -> DataFrame:
    """channel, segment, start_time, end_time, start_sample, number_of_samples, number_of_blocks; from metadata columns only."""
    return blocks.groupBy("channel", "segment").agg(
        F.min("start_uutc").alias("start_time"), F.max("end_uutc").alias("end_time"), F.min("start_sample").alias("start_sample"),
        F.sum("number_of_samples").alias("number_of_samples"), F.count("*").alias("number_of_blocks"),
    )


def channel_info(segments: DataFrame, attributes: list[str] = ()) -> DataFrame:
    """Roll-up of segments by channel; attributes come from the first segment."""
    first = [F.min_by(a, "segment").alias(a) for a in attributes]
    return segments.groupBy("channel").agg(
        F.count("*").cast("int").alias("n_segments"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.sum("number_of_samples").alias("number_of_samples"), *first
    )


def segment_stats(blocks: DataFrame) -> DataFrame:
    """Statistics a segment carries. All are sums, extrema or first and last values, so parts merge: see merged_stats()."""
    return blocks.groupBy("channel", "segment").agg(
        F.sum("number_of_samples").alias("number_of_samples"), F.count("*").alias("number_of_blocks"), F.max("number_of_samples").alias("maximum_block_samples"),
        F.greatest(F.count_if("discontinuity"), F.lit(1)).alias("number_of_discontinuities"), F.max("maximum_sample_value").alias("maximum_sample_value"),
        F.min("minimum_sample_value").alias("minimum_sample_value"), F.min("start_uutc").alias("start_time"), F.max("end_uutc").alias("end_time"),
    )


def merged_stats(parts: DataFrame) -> DataFrame:
    """segment_stats() of a whole from those of its parts, as an append does."""
    return parts.groupBy("channel", "segment").agg(
        F.sum("number_of_samples").alias("number_of_samples"), F.sum("number_of_blocks").alias("number_of_blocks"), F.max("maximum_block_samples").alias("maximum_block_samples"),
        F.sum("number_of_discontinuities").alias("number_of_discontinuities"), F.max("maximum_sample_value").alias("maximum_sample_value"),
        F.min("minimum_sample_value").alias("minimum_sample_value"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"),
    )


def with_duration(stats: DataFrame, fs) -> DataFrame:
    """Adds recording_duration and block_interval (what the longest block spans)."""
    return stats.withColumns({"recording_duration": F.col("end_time") - F.col("start_time"), "block_interval": tg.span("maximum_block_samples", fs)})


def same_rate(a, b) -> Column:
    return F.abs(tg.col(a) - tg.col(b)) <= F.lit(1e-9) * F.greatest(F.lit(1.0), F.abs(tg.col(a)))


def same_factor(a, b) -> Column:
    return F.abs(tg.col(a) - tg.col(b)) <= F.lit(1e-12) * F.greatest(F.lit(1.0), F.abs(tg.col(a)))


def late_enough(start, old_end, fs) -> Column:
    """Half a sample of overlap is tolerated."""
    return tg.col(start) >= tg.col(old_end) - tg.llround(F.lit(0.5e6) / tg.col(fs))


def append_conflicts(appends: DataFrame) -> DataFrame:
    """appends (..., fs, ufact, start_time, old_fs, old_ufact, old_end). Adds a flag per check, true where it refuses."""
    return appends.withColumns(
        {"rate_conflict": ~same_rate("old_fs", "fs"), "factor_conflict": ~same_factor("old_ufact", "ufact"), "time_conflict": ~late_enough("start_time", "old_end", "fs")}
    )


def boundary_gaps(segments: DataFrame) -> DataFrame:
    """Adds previous_end and gap_us to the next segment of each channel."""
    before = F.lag("end_time").over(Window.partitionBy("channel").orderBy("segment"))
    return segments.withColumn("previous_end", before).withColumn("gap_us", F.col("start_time") - F.col("previous_end"))


def fingerprint_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one listing that the other lacks, with side; none means nothing changed."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def complete_segments(files: DataFrame) -> DataFrame:
    """files (session, path inside it): session, channel, segment of the segments whose metadata, index and data are all there."""
    parts = F.split("path", "/")
    suffix = F.regexp_extract("path", r"\.(tmet|tidx|tdat)$", 1)
    rows = files.where(F.col("path").like("%.timd/%.segd/%") & (suffix != ""))
    rows = rows.select("session", parts[0].alias("channel"), parts[1].alias("segment"), suffix.alias("suffix"))
    return rows.groupBy("session", "channel", "segment").agg(F.count_distinct("suffix").alias("kinds")).where("kinds = 3").drop("kinds")
