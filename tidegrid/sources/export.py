"""Stores as native sessions: a task writes a segment's files as its sorted blocks stream by."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.crypto import CRC_START, crc
from tidegrid.sources import blocks as codec
from tidegrid.sources import layout as lay
from tidegrid.sources import native
from tidegrid.sources.native import Run, Write

_GROUP = 1024


class _Segment:
    """One segment being written: the data file grows and is sealed at the end; only the index is held."""

    def __init__(self, path: str, number: int, w: Write):
        self.w, self.number = w, number
        self.directory = os.path.join(path, f"{w.channel}.timd", f"{w.channel}-{number:06d}.segd")
        os.makedirs(self.directory, exist_ok=True)
        self.data = os.path.join(self.directory, f"{w.channel}-{number:06d}.tdat")
        self.file = open(f"{self.data}.body", "wb")
        self.size, self.sum, self.index, self.ends = lay.HEADER.itemsize, CRC_START, [], []
        self.held: list[tuple[np.ndarray, int, int, bool]] = []

    def add(self, samples: np.ndarray, start: int, first: int, discontinuity: bool) -> None:
        self.held.append((samples, start, first, discontinuity))
        if len(self.held) >= _GROUP:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        parts = codec.encode([codec.Block(s, -t, d) for s, t, _, d in self.held])
        index = np.repeat(lay.blank(lay.INDEX), len(parts))
        lengths = np.array([len(p) for p in parts])
        index["file_offset"] = self.size + np.cumsum(lengths) - lengths
        index["start_time"], index["start_sample"] = [-t for _, t, _, _ in self.held], [f for _, _, f, _ in self.held]
        index["samples"], index["block_bytes"] = [len(s) for s, *_ in self.held], lengths
        index["minimum"], index["maximum"] = zip(*(codec.extrema(s) for s, *_ in self.held), strict=True)
        index["flags"] = [codec.DISCONTINUITY if d else 0 for *_, d in self.held]
        body = b"".join(parts)
        self.file.write(body)
        self.size, self.sum = self.size + len(body), crc(body, self.sum)
        self.index.append(index)
        self.held = []

    def close(self) -> int:
        self.flush()
        self.file.close()
        index = lay.joined(lay.INDEX, self.index)
        start = -int(index["start_time"][0])
        end = -int(index["start_time"][-1]) + native.span(int(index["samples"][-1]), self.w.fs)
        native.write_segment(self.directory, self.w, self.number, Run(index, b"", start, end))
        head = native._header(self.w, "tdat", self.number, -start, -end, len(index), int(index["block_bytes"].max()))
        with open(f"{self.data}.part", "wb") as out, open(f"{self.data}.body", "rb") as body:
            out.write(lay.sealed(head, b"", self.sum))
            while chunk := body.read(1 << 22):
                out.write(chunk)
        os.replace(f"{self.data}.part", self.data)
        os.remove(f"{self.data}.body")
        return int(index["samples"].sum())


def _writing(path: str, specs: dict[str, Write]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, segment, done = None, None, []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("channel", "segment", "start_uutc", "start_sample", "discontinuity")), batch.column("samples"), strict=True):
                if at != r[:2]:
                    if segment:
                        done.append((*at, segment.close()))
                    at, segment = r[:2], _Segment(path, r[1], specs[r[0]])
                segment.add(r[5].values.to_numpy(zero_copy_only=False).astype(np.int32), r[2], r[3], r[4])
        if segment:
            done.append((*at, segment.close()))
        columns = list(zip(*done, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64()), strict=True)], ["channel", "segment", "samples"])

    return run


def write_session(store, session_path: str, password1: str, password2: str) -> DataFrame:
    native.check_passwords(password1, password2)
    path = native.open_for_writing(session_path, False)
    name = os.path.basename(path)[: -len(native.SUFFIX)]
    specs = {}
    for c in store.channels().collect():  # one row per channel
        meta = {k: c[k] for k in (*native.FILTERS, *native.SUBJECTS, "session_description", "channel_description", "reference_description", "acquisition_channel_number", "gmt_offset")}
        specs[c["name"]] = Write(name, c["name"], c["sampling_frequency"], c["units_conversion_factor"], c["units_description"], password1, password2, meta)
    blocks = store.blocks().repartition("channel", "segment").sortWithinPartitions("channel", "segment", "block_no")
    done = blocks.select("channel", "segment", "start_uutc", "start_sample", "discontinuity", "samples").mapInArrow(_writing(path, specs), "channel string, segment int, samples long")
    out = store.spark.createDataFrame(done.collect(), done.schema)  # one row per segment; runs the writing once
    for channel in (None, *specs):
        rows = [r.asDict() for r in store.records(channel).collect()]
        native.write_records(path, specs.get(channel) or Write(name, "", 0.0, 1.0, password1=password1, password2=password2), channel, rows)
    return out.orderBy(F.col("channel"), F.col("segment"))
