"""The native format as a Spark data source.

    load(spark, path, "blocks")

mode is channels, segments, toc, records or blocks. Only blocks reads and decodes
samples: a task takes a range of a segment's index, reads those entries only and
decodes one byte range, as Arrow batches; the driver reads no index. Filters on
channel and time are pushed down, to segments on the driver and to blocks in the
tasks, so blocks outside them are never decoded; Spark applies them once more.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidegrid import model
from tidegrid.model import FormatError
from tidegrid.sources.native import Session

TOC = StructType([f for f in model.BLOCKS.fields if f.name != "samples"])
_SCHEMAS = {"channels": model.CHANNELS, "segments": model.SEGMENTS, "toc": TOC, "records": model.RECORDS, "blocks": model.BLOCKS}
_PER_TASK = 256  # blocks


@dataclass
class Rows(InputPartition):
    channel: str | None
    segment: int | None = None
    low: int = 0  # numbers of index entries
    high: int = 0


class SessionDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidegrid"

    def schema(self) -> StructType:
        mode = self.options.get("mode", "blocks")
        if mode not in _SCHEMAS:
            raise FormatError(f"mode is one of {', '.join(_SCHEMAS)}")
        return _SCHEMAS[mode]

    def reader(self, schema: StructType) -> "SessionReader":
        return SessionReader(self.options)


class SessionReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.password = options["path"], options.get("password", "")
        self.mode, self.per_task = options.get("mode", "blocks"), int(options.get("blocksPerTask", _PER_TASK))
        self.names: set[str] | None = None
        self.low: int | None = None  # blocks end after it
        self.high: int | None = None  # blocks start before it

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("channel",) and isinstance(f, (EqualTo, In)):
                names = set(value) if isinstance(f, In) else {value}
                self.names = names if self.names is None else self.names & names
            elif column == ("end_uutc",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                low = value if isinstance(f, GreaterThan) else value - 1
                self.low = low if self.low is None else max(self.low, low)
            elif column == ("start_uutc",) and isinstance(f, (LessThan, LessThanOrEqual)):
                high = value if isinstance(f, LessThan) else value + 1
                self.high = high if self.high is None else min(self.high, high)
            yield f

    def partitions(self) -> list[InputPartition]:
        session = Session(self.path, self.password)
        channels = [c for c in session.channels if self.names is None or c in self.names]
        if self.mode == "records":
            return [Rows(None), *(Rows(c) for c in channels)]
        if self.mode != "blocks":
            return [Rows(c) for c in channels]
        out = []
        for c in channels:
            for x in session.of(c):
                if (self.low is None or x.end > self.low) and (self.high is None or x.start < self.high):
                    n = int(x.technical["number_of_blocks"])
                    out += [Rows(c, x.number, i, i + self.per_task) for i in range(0, n, self.per_task)]
        return out

    def read(self, part: Rows) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        session = Session(self.path, self.password, part.channel)
        if self.mode == "blocks":
            yield from self._blocks(session, part)
            return
        if self.mode == "records":
            found = session.records(part.channel)
        else:
            found = {"channels": lambda: [session.info(part.channel)], "segments": lambda: session.segment_rows(part.channel), "toc": lambda: session.toc(part.channel)}[self.mode]()
        names = [f.name for f in _SCHEMAS[self.mode].fields]
        for r in found:
            yield tuple(r.get(n) for n in names)

    def _blocks(self, session: Session, part: Rows) -> Iterator[pa.RecordBatch]:
        segment = next(s for s in session.of(part.channel) if s.number == part.segment)
        index = session.entries(segment, part.low, part.high)
        rows = session.listed(segment, index, part.low)
        rows = [r for r in rows if (self.low is None or r["end_uutc"] > self.low) and (self.high is None or r["start_uutc"] < self.high)]
        if not rows:
            return
        blocks = session.decoded(segment, index[[r["block_no"] - part.low for r in rows]])
        ends = np.cumsum([0, *(len(b.samples) for b in blocks)])
        samples = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([b.samples for b in blocks]).astype(np.int32)))
        schema = to_arrow_schema(model.BLOCKS)
        columns = [samples.cast(f.type) if f.name == "samples" else pa.array([r.get(f.name) for r in rows], f.type) for f in schema]
        yield pa.RecordBatch.from_arrays(columns, names=schema.names)


def load(spark: SparkSession, path: str, mode: str, password: str = "") -> DataFrame:
    """A table of a session, with push-down switched on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SessionDataSource)
    return spark.read.format("tidegrid").options(path=path, mode=mode, password=password).load()
