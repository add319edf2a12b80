"""Queries over native sessions: written from line items, read back through the data source, archives and readers.

A session is written once for each table folder and kind, by tasks, from a store.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid import api, cache
from tidegrid.operators import catalog, read
from tidegrid.plans import signals as sig
from tidegrid.plans.queries import _BLOCKS, _L, query
from tidegrid.sources.bytesource import archive_session, extract_session
from tidegrid.sources.datasource import load
from tidegrid.sources.store import Store, export_session

CHANNELS, HALF, SECRET = ("A", "N", "R"), 1024, ("first", "second")
_made: dict[tuple, str] = {}


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    return f"{base}/sessions-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix="tidegrid-sessions-")


def _session(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """kind: plain, locked (two passwords), grown (a second append in the segment) or split (one in a new segment)."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _made or not os.path.isdir(_made[key]):
        folder = _folder(spark)
        store = Store(spark, f"{folder}/store")
        for c in CHANNELS:
            rows = sig.counts(spark, sf_dir).where(F.col("channel") == c).select("pos", "count", "valid")
            parts = [rows] if kind in ("plain", "locked") else [rows.where(F.col("pos") < HALF), rows.where(F.col("pos") >= HALF)]
            for i, part in enumerate(parts):
                store.append(c, part, sig.START, sig.FS, 2, new_segment=i > 0 and kind == "split", block_length=sig.BLOCK)
        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/lines.mefd"
        export_session(store, path, *(SECRET if kind == "locked" else ("", ""))).collect()
        _made[key] = path
    return _made[key]


def _samples(blocks: DataFrame) -> DataFrame:
    return read.samples_of(blocks, F.lit(sig.START), F.lit(sig.FS)).select("channel", "idx", "count")


_SAMPLES = f"WITH {_L} SELECT channel, pos AS idx, count FROM l WHERE valid"
_TOC = "channel, segment, block_no, start_uutc, end_uutc, start_sample, number_of_samples, maximum_sample_value, minimum_sample_value, discontinuity"


@query("native_samples", _SAMPLES)
def native_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(load(spark, _session(spark, sf_dir, "plain"), "blocks"))


@query("native_toc", f"WITH {_BLOCKS} SELECT {_TOC} FROM b")
def native_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, _session(spark, sf_dir, "plain"), "toc").select(*_TOC.split(", "))


_LOW, _HIGH = sig.START + 1_000_000, sig.START + 3_000_000


@query("native_pushdown", f"WITH {_BLOCKS} SELECT {_TOC} FROM b WHERE channel = 'A' AND end_uutc > {_LOW} AND start_uutc < {_HIGH}")
def native_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = load(spark, _session(spark, sf_dir, "plain"), "blocks")
    return blocks.where((F.col("channel") == "A") & (F.col("end_uutc") > _LOW) & (F.col("start_uutc") < _HIGH)).select(*_TOC.split(", "))


@query("native_info", f"WITH {_BLOCKS} SELECT channel AS name, 256.0::DOUBLE AS sampling_frequency, 0.01::DOUBLE AS units_conversion_factor, 'uV' AS units_description, min(start_uutc) AS start_time, max(end_uutc) AS end_time, CAST(sum(number_of_samples) AS BIGINT) AS number_of_samples, true AS section3_available FROM b GROUP BY channel")
def native_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, _session(spark, sf_dir, "plain"), "channels").select("name", "sampling_frequency", "units_conversion_factor", "units_description", "start_time", "end_time", "number_of_samples", "section3_available")


@query("native_archive", _SAMPLES)
def native_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read in place from one tar."""
    path = _session(spark, sf_dir, "plain")
    return _samples(load(spark, archive_session(path, f"{path}.tar", overwrite=True), "blocks"))


@query("native_extract", _SAMPLES)
def native_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _session(spark, sf_dir, "plain")
    tar = archive_session(path, f"{os.path.dirname(path)}/packed.mefd.tar", overwrite=True)
    return _samples(load(spark, extract_session(tar, f"{os.path.dirname(path)}/out.mefd", overwrite=True), "blocks"))


@query("native_locked", _SAMPLES)
def native_locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written under two passwords, read by the one of the higher level."""
    return _samples(load(spark, _session(spark, sf_dir, "locked"), "blocks", SECRET[1]))


@query("native_access", "SELECT name, password, password = 'second' AS section3_available FROM (SELECT unnest(['A', 'N', 'R']) AS name), (SELECT unnest(['first', 'second']) AS password)")
def native_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject section opens by the higher password only."""
    path = _session(spark, sf_dir, "locked")
    one, two = (load(spark, path, "channels", p).select("name", F.lit(p).alias("password"), "section3_available") for p in SECRET)
    return one.unionByName(two)


@query("native_append", _SAMPLES)
def native_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends in one segment."""
    return _samples(load(spark, _session(spark, sf_dir, "grown"), "blocks"))


@query("native_split", f"WITH {_L} SELECT channel, CAST(pos >= {HALF} AS INTEGER) AS segment, count(*) AS number_of_samples, CAST(sum(count) AS BIGINT) AS total FROM l WHERE valid GROUP BY ALL")
def native_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second segment; each one's samples."""
    blocks = load(spark, _session(spark, sf_dir, "split"), "blocks")
    rows = read.samples_of(blocks, F.lit(sig.START), F.lit(sig.FS))
    return rows.groupBy("channel", "segment").agg(F.count("*").alias("number_of_samples"), F.sum("count").alias("total"))


@query("native_segments", f"WITH {_BLOCKS} SELECT channel, 0 AS segment, min(start_uutc) AS start_time, max(end_uutc) AS end_time, min(start_sample) AS start_sample, CAST(sum(number_of_samples) AS BIGINT) AS number_of_samples, count(*) AS number_of_blocks FROM b GROUP BY channel")
def native_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, _session(spark, sf_dir, "plain"), "segments").select("channel", "segment", "start_time", "end_time", "start_sample", "number_of_samples", "number_of_blocks")


@query("native_window", f"WITH {_L} SELECT CAST(pos - 100 AS BIGINT) AS idx, coalesce(count, 0) AS count, valid FROM l WHERE channel = 'N' AND pos >= 100 AND pos < 1100")
def native_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of 1000 positions as arrays on the driver, times given as floats."""
    t0, t1 = (float(sig.START + round(p / sig.FS * 1e6)) for p in (100, 1100))
    raw = api.Reader(_session(spark, sf_dir, "plain")).read_raw("N", t0, t1)
    rows = [(i, int(c), bool(v)) for i, (c, v) in enumerate(zip(raw["samples"], raw["valid"], strict=True))]
    return spark.createDataFrame(rows, "idx long, count int, valid boolean")


@query("native_cached", f"WITH {_BLOCKS} SELECT channel, CAST(sum(number_of_samples) AS BIGINT) AS number_of_samples, true AS warm FROM b GROUP BY channel")
def native_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel metadata from a snapshot, without opening the session."""
    path = _session(spark, sf_dir, "plain")
    where = f"{os.path.dirname(path)}/snapshot.json"
    api.Reader(path, cache=where)
    warm = api.Reader(path, cache=where)
    rows = [(c, warm.info(c)["number_of_samples"], warm._session is None and cache.load(cache.place(path, where), path) is not None) for c in warm.channels]
    return spark.createDataFrame(rows, "channel string, number_of_samples long, warm boolean")


@query("native_records", f"SELECT 'Note' AS type, CAST({sig.START} + n_nationkey * 1000000 AS BIGINT) AS time, n_name AS text FROM nation")
def native_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of a session of its own, written and read back."""
    path = f"{_folder(spark)}/notes.mefd"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    nations = sig.table(spark, sf_dir, "nation").collect()  # a fixed table
    with api.Writer(path) as w:
        w.write("c", [1.0, 2.0], sig.START, sig.FS, 2)
        w.write_annotations([{"time": sig.START + r["n_nationkey"] * 1_000_000, "text": r["n_name"]} for r in nations])
    return load(spark, path, "records").select("type", "time", "text")


@query("native_import", f"WITH {_BLOCKS} SELECT channel, count(*) AS blocks, CAST(sum(total) AS BIGINT) AS total FROM b GROUP BY channel")
def native_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's blocks in a store."""
    from tidegrid.sources.store import import_session

    store = Store(spark, f"{_folder(spark)}/imported")
    import_session(spark, _session(spark, sf_dir, "plain"), store)
    rows = catalog.toc(store.blocks()).select("channel", "segment", "block_no").join(store.blocks().select("channel", "segment", "block_no", "samples"), ["channel", "segment", "block_no"])
    return rows.groupBy("channel").agg(F.count("*").alias("blocks"), F.sum(F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))
