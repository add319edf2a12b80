"""Signals made from business tables, to query the engine with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START, FS, BLOCK = 1_577_836_800_000_000, 256.0, 64
_ORDERS = 16_384  # order numbers a range
HOUR_FS = 1 / 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel = event_type, t, value, event_id."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), micros("ts").alias("t"), "value", "event_id")


def lines(spark: SparkSession, sf_dir: str, *values: str) -> DataFrame:
    """channel = l_returnflag, dense positions, value (the price, or by name the columns in values); a gap where there is no discount."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    # Rows are numbered within ranges of orders; only a row per range meets in a window per channel.
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", *dict.fromkeys([*keys, "l_discount", *values])).withColumn("range", F.expr(f"l_orderkey div {_ORDERS}"))
    sizes = rows.groupBy(F.col("l_returnflag").alias("flag"), F.col("range").alias("at")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("flag").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("flag", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("l_returnflag", "range").orderBy(*keys)) - 1)
    rows = rows.join(firsts, F.col("l_returnflag").eqNullSafe(F.col("flag")) & F.col("range").eqNullSafe(F.col("at")))
    pos = F.col("first") + F.col("place")
    valid = F.col("l_discount") != 0
    named = {v: v for v in values} or {"value": "l_extendedprice"}
    return rows.select(F.col("l_returnflag").alias("channel"), pos.cast("long").alias("pos"), valid.alias("valid"), *(F.when(valid, F.col(c)).alias(n) for n, c in named.items()))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines() with count, the value in hundredths."""
    from tidegrid.functions import timegrid as tg

    return lines(spark, sf_dir).withColumn("count", tg.quantize("value", 2))
