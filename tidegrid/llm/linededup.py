"""Line dedup by range-partitioned line hashes.

Every line of at least ``min_chars`` code points becomes a (key hash, document,
position) row. The rows are range-partitioned and sorted by key, then by
document from the largest down, then by position, so a task streams over each
key's documents holding one document's positions at most. The range covers the
document too, hence a key that a third of all lines share is split over many
tasks; what a task cannot decide alone are its first and last key, and for
these (two per task at most) it sends one summary row each.
The result is a bitmap per document, never text.

Edge cases: a null text is one empty line; rows with a null doc_id take no part
and lose nothing; rows that repeat a doc_id count as one document, and each
row's own lines are judged; an empty table gives an empty result; other columns
of ``docs`` are ignored by :func:`keep_bitmaps` and passed on by
:func:`apply_bitmaps`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidegrid.llm._store import settle, texts
from tidegrid.llm._text import SPACE

MIN_CHARS, MIN_DOCS = 20, 3
_DROP, _EDGE, _SUMMARY = 0, 1, 2
_STREAM = "kind byte, doc_id long, place long, h1 long, h2 long, n long"
_LONG = 20_000


def _line_rows(min_chars: int):
    """(doc_id, place, h1, h2) of each line that counts; place: 31 bits of the text's hash, then the line's position."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places, digests, size = [], [], [], 0
            columns = batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), batch.column("text").cast(pa.large_binary())
            for doc_id, tag, text in zip(*columns, strict=True):
                raw = text.as_py()
                for at, line in enumerate(raw.lower().split(b"\n"), tag << 32):
                    key = line.strip(SPACE)
                    if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                        ids.append(doc_id)
                        places.append(at)
                        digests.append(xxhash.xxh3_128_digest(key))
                size += len(raw)
                if size > 1 << 22:
                    yield _hashed(ids, places, digests)
                    ids, places, digests, size = [], [], [], 0
            yield _hashed(ids, places, digests)

    return rows


def _hashed(ids: list[int], places: list[int], digests: list[bytes]) -> pa.RecordBatch:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    columns = [pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "place", "h1", "h2"])


def _emit(kind: int, rows: np.ndarray, n: np.ndarray | None = None) -> pa.RecordBatch:
    m = len(rows)
    columns = [np.full(m, kind, np.int8), rows[:, 2], rows[:, 3], rows[:, 0], rows[:, 1], np.zeros(m, np.int64) if n is None else n]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["kind", "doc_id", "place", "h1", "h2", "n"])


def _differs(rows: np.ndarray, row: np.ndarray) -> np.ndarray:
    return (rows[:, 0] != row[0]) | (rows[:, 1] != row[1])


def _judged(rows: np.ndarray, min_docs: int, edge: bool) -> Iterator[pa.RecordBatch]:
    """rows (h1, h2, doc, place) are whole groups in order; at an edge the group may go on in another task."""
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
    new_doc = new.copy()
    new_doc[1:] |= rows[1:, 2] != rows[:-1, 2]
    starts = np.flatnonzero(new)
    docs = np.add.reduceat(new_doc.astype(np.int64), starts)
    if edge:
        yield _emit(_EDGE, rows)
        yield _emit(_SUMMARY, rows[starts], docs)
        return
    group = np.cumsum(new) - 1
    lost = (docs[group] >= min_docs) & (rows[:, 2] != rows[starts, 2][group])
    if lost.any():
        yield _emit(_DROP, rows[lost])


def _stream(min_docs: int):
    """One pass over a sorted partition, holding a batch and one key's first rows.

    Groups inside a batch are decided by array arithmetic. A group longer than
    _LONG rows is opened: its rows leave as they come, as edge rows if it is the
    partition's first, else decided, since its largest document has been seen.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = np.zeros((0, 4), np.int64)
        opened, first = None, True

        def passed(part: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield _emit(_EDGE, part) if opened["edge"] else _emit(_DROP, part[part[:, 2] != opened["top"][2]])

        def summary() -> pa.RecordBatch:
            return _emit(_SUMMARY, opened["top"][None], np.array([opened["docs"]], np.int64))

        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "doc_id", "place")])
            if opened and len(rows):
                ends = np.flatnonzero(_differs(rows, opened["top"]))
                part, rows = (rows[: ends[0]], rows[ends[0] :]) if len(ends) else (rows, rows[:0])
                if len(part):
                    yield from passed(part)
                    opened["docs"] += int((np.diff(part[:, 2], prepend=opened["last"]) != 0).sum())
                    opened["last"] = part[-1, 2]
                if len(rows):
                    if opened["edge"]:
                        yield summary()
                    opened, first = None, False
            if not len(rows):
                continue
            rows = np.concatenate([carry, rows])
            ends = np.flatnonzero(_differs(rows, rows[-1]))
            cut = int(ends[-1]) + 1 if len(ends) else 0
            done, carry = rows[:cut], rows[cut:]
            if len(done) and first:
                ends = np.flatnonzero(_differs(done, done[0]))
                cut = int(ends[0]) if len(ends) else len(done)
                yield from _judged(done[:cut], min_docs, True)
                done, first = done[cut:], False
            if len(done):
                yield from _judged(done, min_docs, False)
            docs = 1 + int((np.diff(carry[:, 2]) != 0).sum())
            if len(carry) > _LONG and (first or docs >= min_docs):
                opened = {"edge": first, "top": carry[0].copy(), "last": carry[-1, 2], "docs": docs}
                yield from passed(carry)
                carry = carry[:0]
        if opened:
            yield summary()
        elif len(carry):
            yield from _judged(carry, min_docs, True)

    return stream


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps, counts = [], []
        for places in batch.column("places"):
            at = np.asarray(places.values.to_numpy(zero_copy_only=False))
            keep = np.ones((int(at.max()) // 8 + 1) * 8, bool)  # whole bytes
            keep[at] = False
            counts.append(int((~keep).sum()))
            maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
        columns = [batch.column("doc_id"), batch.column("tag"), pa.array(counts, pa.int64()), pa.array(maps, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "n_dropped", "keep"])


def _with_tag(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("tag", F.xxhash64("text").bitwiseAND(0x7FFFFFFF))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, tag (31 bits of the text's hash), n_dropped, keep for each document that loses lines.

    keep: zlib over bits, the first line in the lowest bit of the first byte, up
    to the last lost line; what follows stays, as do documents without a row.
    Keys found in at least min_docs documents stay in the largest doc_id only.
    """
    lines = _with_tag(docs).where("doc_id is not null").mapInArrow(_line_rows(min_chars), "doc_id long, place long, h1 long, h2 long")
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc()]
    sorted_lines = lines.repartitionByRange(*order).sortWithinPartitions(*order, "place")
    found = settle(sorted_lines.mapInArrow(_stream(min_docs), _STREAM), "lines")
    # Two rows per task at most, so the broadcast is bounded by the number of partitions.
    spanning = found.where(F.col("kind") == _SUMMARY).groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.max("doc_id").alias("keeper"))
    spanning = F.broadcast(spanning.where(F.col("docs") >= min_docs).select("h1", "h2", "keeper"))
    lost = (
        found.where(F.col("kind") == _DROP).select("doc_id", "place")
        .unionByName(found.where(F.col("kind") == _EDGE).join(spanning, ["h1", "h2"]).where("doc_id <> keeper").select("doc_id", "place"))
    )
    lost = lost.select("doc_id", F.shiftright("place", 32).alias("tag"), F.col("place").bitwiseAND(0x7FFFFFFF).cast("int").alias("at"))
    places = lost.groupBy("doc_id", "tag").agg(F.collect_list("at").alias("places"))
    return places.mapInArrow(_bitmaps, "doc_id long, tag long, n_dropped long, keep binary")


@F.arrow_udf(StringType())
def _kept_text(text: pa.Array, keep: pa.Array) -> pa.Array:
    out = []
    for t, k in zip(text, keep, strict=True):
        if not k.is_valid:
            out.append(None)
            continue
        lines = t.as_py().split("\n")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(k.as_py()), np.uint8), bitorder="little")
        stay = [x for x, b in zip(lines, bits, strict=False) if b]
        out.append("\n".join(stay + lines[len(bits) :]))
    return pa.array(out, pa.string())


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """docs with text cut down to its kept lines, and two columns counting lines before and lines dropped (columns of these names are replaced)."""
    columns = [c for c in docs.columns if c not in (n_lines, n_dropped)]
    marks = bitmaps.select(*(F.col(c).alias(f"__{c}") for c in ("doc_id", "tag", "n_dropped", "keep")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = docs.withColumn("text", text).withColumn("__t", F.xxhash64("text").bitwiseAND(0x7FFFFFFF))
    joined = joined.join(marks, (F.col("doc_id") == F.col("__doc_id")) & (F.col("__t") == F.col("__tag")), "left")
    cut = _kept_text(F.when(F.col("__keep").isNotNull(), F.col("text")), F.col("__keep"))
    lines = (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long")
    joined = joined.withColumns({"__lines": lines, "__cut": cut})
    out = {"text": F.coalesce("__cut", "text"), n_lines: F.col("__lines"), n_dropped: F.coalesce("__n_dropped", F.lit(0)).cast("long")}
    return joined.withColumns(out).select(*columns, n_lines, n_dropped)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs, each text without its repeated lines, with n_lines and n_dropped."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
