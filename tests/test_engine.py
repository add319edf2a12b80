"""Operators, store, data source and stream on Spark."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegrid import Reader, Writer
from tidegrid.functions import crypto
from tidegrid.functions import timegrid as tg
from tidegrid.model import FormatError, WriteConflictError
from tidegrid.operators import catalog, ingest, read
from tidegrid.sources.native import half_up
from tidegrid.sources.store import Store, export_session, import_session
from tidegrid.streaming.append import appender

T0, FS = 1_577_836_800_000_000, 256.0


def frame(spark, values, channel="c"):
    return spark.createDataFrame([(channel, i, None if np.isnan(v) else float(v)) for i, v in enumerate(values)], "channel string, pos long, value double")


def signal(n, seed=3):
    return np.random.default_rng(seed).normal(0, 40, n)


def test_rounding(spark):
    row = spark.range(1).select(
        tg.llround(F.lit(2.5)), tg.llround(F.lit(-2.5)), tg.llround(F.lit(0.49999999999999994)), tg.round_to_int(F.lit(1e12)), tg.round_to_int(F.lit(-1e12)),
        tg.grid_length(F.lit(10), F.lit(0), F.lit(1e6)), tg.segment_number(F.lit("a-000012")), tg.segment_number(F.lit("a-x")), tg.fixed_text(F.lit("ab\0cd"), 8), tg.fixed_text(F.lit("éé"), 2),
    ).first()
    assert tuple(row) == (3, -3, 0, 2**31 - 1, -(2**31) + 1, 0, 12, 0, "ab", "é")


def test_overflow_raises(spark):
    with pytest.raises(Exception, match="OVERFLOW"):
        spark.createDataFrame([(3e9,)], "v double").select(tg.quantize("v", 0)).collect()


@pytest.mark.parametrize("chunk", [7, 64, 1 << 20])
def test_tiling_does_not_depend_on_chunks(spark, chunk):
    x = signal(1000)
    x[[0, 1, 63, 64, 65, 200, 999]] = np.nan
    x[300:450] = np.nan
    rows = frame(spark, x).withColumns({"count": tg.quantize("value", 2), "valid": tg.is_valid("value")})
    got = ingest.tile(rows, T0, FS, 50, chunk=chunk).orderBy("block_no").collect()
    want, at, stored = [], 0, 0
    valid = ~np.isnan(x)
    while at < 1000:
        if not valid[at]:
            at += 1
            continue
        begin = at
        while at < 1000 and valid[at]:
            at += 1
        for s in range(begin, at, 50):
            e = min(s + 50, at)
            c = [int(np.trunc(v * 100 + np.copysign(0.5, v))) for v in x[s:e]]
            want.append((T0 + half_up(s / FS * 1e6), stored, e - s, s == begin, c, max(c), min(c)))
            stored += e - s
    assert [(r.start_uutc, r.start_sample, r.number_of_samples, r.discontinuity, r.samples, r.maximum_sample_value, r.minimum_sample_value) for r in got] == want
    runs = ingest.islands(rows.select("channel", "pos", "valid"), chunk)
    assert runs.count() == sum(d for _, _, _, d, *_ in want) and ingest.gap_count(runs).first()["gaps_skipped"] == runs.count() - 1


@pytest.mark.parametrize("chunk", [5, 1 << 20])
def test_precision(spark, chunk):
    from tidegrid.api import infer_precision

    for x in (signal(300) / 1000, np.array([1.0, np.nan, 2.0]), np.full(4, np.nan), np.array([3.0, 3.0])):
        assert ingest.infer_precision(frame(spark, x), chunk).first()["precision"] == infer_precision(x)


def test_overlaps_last_wins(spark):
    rows = [("c", 0, 0, T0, T0 + 4_000_000, [1, 1, 1, 1]), ("c", 0, 1, T0 + 2_000_000, T0 + 5_000_000, [2, 2, 2]), ("c", 1, 0, T0 + 8_000_000, T0 + 9_000_000, [3])]
    blocks = spark.createDataFrame(rows, "channel string, segment int, block_no int, start_uutc long, end_uutc long, samples array<int>").withColumn("number_of_samples", F.size("samples").cast("long"))
    got = read.read_raw(blocks, T0, T0 + 10_000_000, 1.0).orderBy("idx").collect()
    assert [(r.idx, r["count"]) for r in got] == list(enumerate([1, 1, 2, 2, 2, None, None, None, 3, None]))
    assert [r.valid for r in got] == [r["count"] is not None for r in got]
    away = read.read_raw(blocks, T0 + 20_000_000, T0 + 22_000_000, 1.0).collect()
    assert sorted((r.idx, r.valid) for r in away) == [(0, False), (1, False)]
    assert read.read_raw(blocks, T0 + 5, T0, 1.0).count() == 0


def test_windows_join_is_an_equi_join(spark):
    rng = np.random.default_rng(0)
    b = [("c", i, int(s), int(s) + int(n), 1) for i, (s, n) in enumerate(zip(rng.integers(0, 10_000, 200), rng.integers(1, 900, 200)))]
    w = [("c", i, int(s), int(s) + int(n)) for i, (s, n) in enumerate(zip(rng.integers(-500, 10_000, 100), rng.integers(0, 1500, 100)))]
    blocks = spark.createDataFrame(b, "channel string, block_no int, start_uutc long, end_uutc long, number_of_samples long")
    windows = spark.createDataFrame(w, "channel string, w int, t0 long, t1 long")
    got = read.windows_over(blocks, windows, 250)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    want = sorted((i, k) for _, i, s, e, _ in b for _, k, t0, t1 in w if e > t0 and s < t1 and t1 > t0)
    assert sorted((r.block_no, r.w) for r in got.collect()) == want


def test_metadata_reads_no_samples(spark, tmp_path):
    store = Store(spark, str(tmp_path / "st"))
    store.append("c", frame(spark, signal(600)).drop("channel"), T0, FS, 2)
    plan = store.segments()._jdf.queryExecution().executedPlan().toString()
    assert "samples:array" not in plan
    hit = read.within(store.blocks().where("channel = 'c'"), T0, T0 + 10)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(end_uutc" in hit and "LessThan(start_uutc" in hit and "PartitionFilters: [isnotnull(channel" in hit


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "st"))
    x = signal(3000)
    x[100:200] = np.nan
    one = store.append("c", frame(spark, x).drop("channel"), T0, FS, 2, attributes={"subject_id": "S"}).first()
    assert (one.samples_written, one.gaps_skipped, one.segment) == (2900, 1, 0)
    end = store.info().first()["end_time"]
    assert end == T0 + round(3000 / FS * 1e6)
    for bad in (dict(start_uutc=end - 50_000, fs=FS), dict(start_uutc=end, fs=100.0), dict(start_uutc=end, fs=FS, precision=0)):
        with pytest.raises(WriteConflictError):
            store.append("c", frame(spark, x[:50]).drop("channel"), **bad)
    assert store.append("c", frame(spark, x[:100]).drop("channel"), end, FS).first().segment == 0
    assert store.append("c", frame(spark, x[:100]).drop("channel"), T0 + 60_000_000, FS, 2, new_segment=True).first().segment == 1
    assert store.append("c", frame(spark, [np.nan] * 5).drop("channel"), T0 + 90_000_000, FS).first().samples_written == 0
    info = store.info().first()
    assert (info.number_of_samples, info.n_segments, info.subject_id) == (3100, 2, "S")
    got = store.read("c", T0, T0 + 11_718_750).toPandas()
    assert len(got) == 3000 and np.allclose(got["value"], x, atol=0.006, equal_nan=True)
    assert store.runs("c").count() == 4 and [r.segment for r in store.segments().orderBy("segment").collect()] == [0, 1]
    store.write_records(spark.createDataFrame([(T0 + 5, "b"), (T0, "a")], "time long, text string"))
    store.write_records(spark.createDataFrame([(T0, "own")], "time long, text string"), "c")
    store.write_records(spark.createDataFrame([], "time long, text string"))
    assert [r.text for r in store.records().collect()] == ["a", "b"] and [r.text for r in store.records("c").collect()] == ["own"]

    export_session(store, str(tmp_path / "out.mefd"), "p", "q")
    r = Reader(tmp_path / "out.mefd", "q")
    assert np.allclose(r.read("c", T0, T0 + 11_718_750), x, atol=0.006, equal_nan=True) and r.info("c")["subject_id"] == "S" and [x["text"] for x in r.records()] == ["a", "b"]
    back = Store(spark, str(tmp_path / "back"))
    import_session(spark, str(tmp_path / "out.mefd"), back, "q")
    same = lambda s: s.blocks().drop("session").orderBy("segment", "block_no").collect()
    assert same(back) == same(store) and [x.text for x in back.records("c").collect()] == ["own"]


def test_data_source(spark, tmp_path):
    path = str(tmp_path / "s.mefd")
    w = Writer(path, block_length=64)
    x = signal(1000)
    x[500:600] = np.nan
    w.write("a", x, T0, FS, 2)
    w.write("b", x[::-1], T0, FS, 2)
    w.write_annotations([{"time": T0, "text": "n"}], "a")
    r = Reader(path, spark=spark)
    assert {m: r.frame(m).count() for m in ("channels", "segments", "toc", "records", "blocks")} == {"channels": 2, "segments": 2, "toc": 30, "records": 1, "blocks": 30}
    hit = r.frame("blocks").where((F.col("channel") == "a") & (F.col("end_uutc") > T0 + 1_000_000) & (F.col("start_uutc") < T0 + 1_500_000))
    assert [x.block_no for x in hit.orderBy("block_no").collect()] == [4, 5]
    raw = r.raw_frame("a", T0, T0 + 3_906_250).orderBy("idx").toPandas()
    want = r.read_raw("a", T0, T0 + 3_906_250)
    assert np.array_equal(raw["valid"], want["valid"] != 0) and np.array_equal(raw["count"].fillna(0).astype(int), want["samples"])


def test_data_source_reads_no_index_on_the_driver(spark, tmp_path, monkeypatch):
    from tidegrid.sources import datasource, native

    path = str(tmp_path / "s.mefd")
    Writer(path, block_length=64).write("a", signal(40_000), T0, FS, 2)
    reader = datasource.SessionReader({"path": path, "mode": "blocks", "blocksPerTask": "100"})
    monkeypatch.setattr(native.Session, "index", None)
    monkeypatch.setattr(native.Session, "entries", None)
    assert [(p.low, p.high) for p in reader.partitions()] == [(i, i + 100) for i in range(0, 625, 100)]


def test_one_channel_is_many_tasks(spark):
    """Small groups give the blocks, runs and overlaps that large ones do."""
    from tidegrid.operators import read

    rows = spark.range(4000).select(F.lit("a").alias("channel"), F.col("id").alias("pos"), (F.col("id") % 97).cast("int").alias("count"), (F.col("id") % 61 > 3).alias("valid"))
    tiles = [ingest.tile(rows, T0, FS, 16, chunk=c).drop("samples") for c in (1 << 20, 100)]
    small, large = (sorted(map(tuple, t.collect())) for t in tiles)
    assert small == large and len(small) > 200
    blocks = tiles[0].withColumn("segment", (F.col("block_no") >= 100).cast("int"))
    assert sorted(map(tuple, read.runs(blocks).collect())) == sorted(map(tuple, read.runs(blocks, 7).collect()))
    spans = spark.range(300).select(F.lit("a").alias("channel"), F.col("id"), (F.col("id") * 7).alias("b")).withColumn("e", F.col("b") + F.when(F.col("id") % 40 == 0, 100).otherwise(5))
    assert sorted(read._reached(spans).collect()) == sorted(read._reached(spans, 50).collect())


def test_checksum_and_cipher_columns(spark):
    df = spark.createDataFrame([(bytes(range(32)),), (None,)], "d binary")
    key = bytes(16)
    locked = df.select(crypto.crc32k("d").alias("c"), crypto.aes_ecb_column(key, True)(F.col("d")).alias("e"))
    got = locked.select("c", crypto.aes_ecb_column(key, False)(F.col("e")).alias("d")).collect()
    assert (got[0].c, bytes(got[0].d)) == (crypto.crc(bytes(range(32))), bytes(range(32))) and got[1].c is None and got[1].d is None


def test_ciphers_run_over_whole_batches(monkeypatch):
    calls, key, one = [], bytes(range(16)), crypto.aes_ecb
    monkeypatch.setattr(crypto, "aes_ecb", lambda data, *rest: calls.append(len(data)) or one(data, *rest))
    plain = pa.array([None if i % 7 == 3 else bytes([i % 256]) * 16 * (i % 4) for i in range(1000)], pa.binary())
    locked = crypto.aes_ecb_column(key, True).func(plain)
    assert locked.to_pylist() == [None if x is None else one(x, key, True) for x in plain.to_pylist()]
    assert crypto.aes_ecb_column(key, False).func(locked).equals(plain) and len(calls) <= 2
    with pytest.raises(FormatError):  # two halves are no block
        crypto.aes_ecb_column(key, True).func(pa.array([b"8 bytes.", b"8 bytes."]))


def test_stream(spark, tmp_path):
    store, late = Store(spark, str(tmp_path / "st")), []
    source = tmp_path / "in"
    schema = "channel string, t long, value double"
    q = None
    for start in (0, 1000, 500):
        spark.createDataFrame([(c, T0 + (start + i) * 3_906_250 // 1000, float(i)) for c in "ab" for i in range(100)], schema).coalesce(1).write.mode("append").parquet(str(source))
        q = spark.readStream.schema(schema).parquet(str(source)).writeStream.foreachBatch(appender(store, FS, 1, lambda c, rows, e: late.append((c, rows.count())))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(late) == [("a", 100), ("b", 100)]
    # A batch that is tried again changes nothing; after a crash between the note and the append it is appended.
    again = spark.createDataFrame([("c", T0 + i * 3_906_250 // 1000, float(i)) for i in range(50)], schema)
    spark.createDataFrame([("s", 9, "c", 0)], "stream string, batch long, channel string, before long").write.mode("append").parquet(str(tmp_path / "st" / "batches"))
    for _ in range(2):
        appender(store, FS, 1, stream="s")(again, 9)
    assert store.segments().where("channel = 'c'").first()["number_of_samples"] == 50
    store = Store(spark, str(tmp_path / "st"))
    assert {r.channel: r.n for r in catalog.channel_info(store.segments()).select("channel", F.col("number_of_samples").alias("n")).collect()} == {"a": 200, "b": 200, "c": 50}


def test_signals_number_lines_alike_in_any_ranges(spark, sf_dir, monkeypatch):
    from tidegrid.plans import signals

    read = lambda: sorted(map(tuple, signals.lines(spark, sf_dir, "l_quantity").collect()), key=str)
    whole = read()
    monkeypatch.setattr(signals, "_ORDERS", 37)
    assert read() == whole
    for channel in {r[0] for r in whole}:
        places = sorted(r[1] for r in whole if r[0] == channel)
        assert places == list(range(len(places)))
