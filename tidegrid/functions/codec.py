"""The block codec over DataFrames: batches of blocks are coded side by side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidegrid.functions.crypto import Access
from tidegrid.sources import blocks as codec

_KEYS = ("channel", "segment", "block_no")
_TOGETHER = 1024


def encoded(blocks: DataFrame, level: int = 0, keys: Access = Access()) -> DataFrame:
    """channel, segment, block_no, raw: each block in its stored form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _TOGETHER):
                b = whole.slice(at, _TOGETHER)
                rows = zip(b.column("samples"), b.column("start_uutc").to_pylist(), b.column("discontinuity").to_pylist(), strict=True)
                raw = codec.encode([codec.Block(s.values.to_numpy(zero_copy_only=False).astype(np.int32), -t, d) for s, t, d in rows], level, keys)
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in _KEYS), pa.array(raw, pa.binary())], [*_KEYS, "raw"])

    return blocks.select(*_KEYS, "start_uutc", "discontinuity", "samples").mapInArrow(run, "channel string, segment int, block_no int, raw binary")


def decoded(raw: DataFrame, keys: Access = Access()) -> DataFrame:
    """channel, segment, block_no, start_uutc, discontinuity, samples of blocks in stored form; damage raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _TOGETHER):
                b = whole.slice(at, _TOGETHER)
                found = codec.decode(b.column("raw").to_pylist(), keys)
                columns = [pa.array([-x.start_time for x in found], pa.int64()), pa.array([x.discontinuity for x in found]), pa.array([x.samples for x in found], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in _KEYS), *columns], [*_KEYS, "start_uutc", "discontinuity", "samples"])

    return raw.mapInArrow(run, "channel string, segment int, block_no int, start_uutc long, discontinuity boolean, samples array<int>")
