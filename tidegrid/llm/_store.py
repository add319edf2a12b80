"""Shared-folder tables that cut lineage, and checks of inputs common to the operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_folders: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    root = tempfile.mkdtemp(prefix="tidegrid-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write df once as Parquet under the shared folder and read it back.

    Lost executors cost a re-read, never a recomputation, and two readers of the
    result see the same rows. The folder goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _folders:
        atexit.register(_clean)
    _folders.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table of a result of settle() that no later plan reads."""
    item = (df.sparkSession, df._settled)
    _remove(*item)
    _folders.remove(item)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _folders:
        try:
            _remove(spark, path)
        except Exception:  # the application may already be gone; its folder is then the cluster's to clear
            return


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the columns in more; a null text becomes the empty string."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
