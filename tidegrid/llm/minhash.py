"""Near-duplicate documents by one-permutation MinHash.

One hash per shingle fills 256 bins (the first value in each); empty bins borrow
from a filled one picked by a per-bin order (optimal densification). 42 bands of
6 bins make 42 bucket keys per document: a pair at similarity 0.85 misses all of
them with probability 2e-9. Documents with equal shingle sets are one class, and
only its smallest id goes on. In a bucket every class is paired with one hub (a
star), the member that meets most others over all its buckets, so pairs never
exceed bucket rows; pairs are confirmed on full shingle sets.

A star can miss a link between two spokes. So in each bucket whose spokes are in
several components, all spokes of different components are compared after it, in
two passes over cells (pairs of salted blocks of bounded size) that emit no pairs.
The first compares signatures, a byte a bin, and returns a forest of the pairs
that agree in enough bins; a linking pair fails that with a probability of some
1e-9. The trees are families, in all buckets at once. The second holds the full
sets of a family's two blocks and returns a forest of the links it confirms. The
members of the largest component of a bucket or family are not compared with one
another. So no pair that shares a bucket is left out, no set is sent more often
than its family has blocks, and the work left is the comparing itself.

Edge cases: null, empty or blank texts have no shingles and link with nothing;
texts of fewer words than a shingle count as one shingle; very long texts are
handled whole; rows with a null doc_id stay alone with a null component; rows
repeating a doc_id with equal texts count as one document, with other texts each
row goes by its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm._store import discard, settle, texts
from tidegrid.llm._text import chunks, mix, shingles, words
from tidegrid.llm.components import Forest, components

K, BINS, ROWS, PERCENT = 5, 256, 6, 85
_SPOKES = 256  # pairs that share one copy of a hub's shingle set
_CELL = 2048  # rows of a block of signatures
_BYTES, _ROW_BYTES = 4 << 20, 2048  # shingles of a block of sets, and what a set counts besides them
_FEW = 64  # cells of so many rows are compared together


@cache
def _borrow(bins: int) -> np.ndarray:
    """[i, j]: how late bin i would borrow from bin j; each row is a permutation of its own."""
    rng = np.random.Generator(np.random.PCG64(bins))
    return np.argsort(rng.random((bins, bins)), axis=1).astype(np.uint16)


def signature(grams: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Densified one-permutation signature of sorted distinct 64-bit hashes; bins is a power of two."""
    shift = np.uint64(64 - bins.bit_length() + 1)
    of = (grams >> shift).astype(np.int64)
    first = np.flatnonzero(np.diff(of, prepend=-1))
    filled = of[first]
    out = np.zeros(bins, np.uint64)
    out[filled] = grams[first]
    if len(filled) < bins:
        empty = np.setdiff1d(np.arange(bins), filled, assume_unique=True)
        late = _borrow(bins)[empty[:, None], filled[None, :]]
        out[empty] = grams[first][np.argmin(late, axis=1)]
    return out


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n = len(sig) // rows
    parts = sig[: n * rows].reshape(n, rows)
    h = np.arange(1, n + 1, dtype=np.uint64)
    for j in range(rows):
        h = mix(h ^ parts[:, j]) + np.uint64(j)
    return h.view(np.int64)


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in chunks(column):
        yield from shingles(*words(data, offsets), k)


def _sign(k: int, bins: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, bands, sigs = [], [], [], []
            for grams in _sets(batch.column("text"), k):
                n.append(len(grams))
                digests.append(xxhash.xxh3_128_digest(grams.tobytes()))
                sig = signature(grams, bins) if len(grams) else None
                bands.append(np.zeros(0, np.int64) if sig is None else band_keys(sig, rows))
                sigs.append(None if sig is None else sig.astype(np.uint8).tobytes())
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, bands)]).astype(np.int32), np.concatenate([np.zeros(0, np.int64), *bands]))
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), lists, pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "d1", "d2", "bands", "sig"])

    return sign


def signatures(docs: DataFrame, k: int = K, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """doc_id, n (distinct shingles), d1 and d2 (digest of the set), bands (bucket keys), sig (the low byte of each bin)."""
    return texts(docs).mapInArrow(_sign(k, bins, rows), "doc_id long, n long, d1 long, d2 long, bands array<long>, sig binary")


def _gram_sets(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for first, end, data, offsets in chunks(batch.column("text")):
                grams = [g.tobytes() for g in shingles(*words(data, offsets), k)]
                ids = batch.column("doc_id").slice(first, end - first)
                yield pa.RecordBatch.from_arrays([ids, pa.array(grams, pa.binary())], ["id", "grams"])
                at = end
            assert at == batch.num_rows

    return sets


def _confirm(percent: int):
    """Streams rows sorted by hub and salt, the hub's own set first; only that one is held."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, []
        for batch in batches:
            a, b = [], []
            for h, i, raw in zip(batch.column("hub").to_pylist(), batch.column("id").to_pylist(), batch.column("grams"), strict=True):
                grams = np.frombuffer(raw.as_buffer(), np.uint64)
                if h != hub:
                    hub, own = h, []
                if i == h:
                    own.append(grams.copy())
                    continue
                for x in own:
                    low, high = sorted((len(grams), len(x)))
                    if 100 * low < percent * high:
                        continue
                    place = np.minimum(np.searchsorted(x, grams), len(x) - 1)
                    common = int((x[place] == grams).sum())
                    if 100 * common >= percent * (len(x) + len(grams) - common):
                        a.append(i)
                        b.append(h)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return confirm


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (id, hub), distinct; sets (id, grams). Returns the links (a, b). A hub's set is sent once to every _SPOKES spokes."""
    # A table of its own, so that the join below can be split where a hub has many spokes.
    salts = settle(pairs.groupBy("hub").agg(F.ceil(F.count("*") / _SPOKES).cast("int").alias("salts")), "salts")
    spokes = pairs.join(salts, "hub").select("id", "hub", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    hubs = salts.select(F.col("hub").alias("id"), "hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    rows = spokes.withColumn("side", F.lit(1)).unionByName(hubs.withColumn("side", F.lit(0))).join(sets, "id")
    rows = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "side")
    return rows.select("hub", "id", "grams").mapInArrow(_confirm(percent), "a long, b long")


def least_agreement(bins: int, percent: int) -> int:
    """Equal bins below which a pair is not looked at: were only half the bins drawn independently, a pair at the threshold would have fewer with a probability of 1e-9."""
    n, p, tail = bins // 2, percent / 100, 0.0
    for c in range(n):
        tail += comb(n, c) * p**c * (1 - p) ** (n - c)
        if tail > 1e-9:
            return 2 * c
    return 2 * n


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal bytes along the last axis."""
    equal = a == b
    if equal.shape[-1] % 8:
        return equal.sum(axis=-1)
    return equal.view(np.uint64).sum(axis=-1)[..., None].view(np.uint8).sum(axis=-1, dtype=np.int64) if equal.shape[-1] < 2040 else equal.sum(axis=-1)


def _fits(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _cells(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole cells of a stream sorted by keys, with where they begin and end; what is carried on is one cell's rows."""
    held, last = [], None

    def whole() -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        k = np.column_stack([t.column(c).to_numpy() for c in keys])
        return t, np.array([0, *(np.flatnonzero((np.diff(k, axis=0) != 0).any(axis=1)) + 1), len(k)])

    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.column_stack([batch.column(c).to_numpy() for c in keys])
        cuts = np.flatnonzero((np.diff(k, axis=0) != 0).any(axis=1)) + 1
        if len(cuts) or (held and (k[0] != last).any()):
            at = int(cuts[-1]) if len(cuts) else 0
            held.append(batch.slice(0, at))
            yield whole()
            held = [batch.slice(at)]
        else:
            held.append(batch)
        last = k[-1]
    if held:
        yield whole()


def _halves(side: np.ndarray, diagonal: bool) -> tuple[np.ndarray, np.ndarray]:
    left = np.flatnonzero(side == 0)
    return left, left if diagonal else np.flatnonzero(side == 1)


def _plausible(bins: int, percent: int):
    """A forest of the rows of each cell whose signatures agree well enough, of other components and of fitting sizes."""
    least = least_agreement(bins, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in _cells(batches, ["key", "x", "y"]):
            rep, root, n, side, x, y = (t.column(c).to_numpy() for c in ("rep", "root", "n", "side", "x", "y"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(rep), bins)
            forest = Forest(len(rep))
            size = np.diff(cuts)
            small = np.repeat((size <= _FEW) & (x == y)[cuts[:-1]], size)
            after = np.where(small, np.repeat(cuts[1:], size) - 1 - np.arange(len(rep)), 0)
            step = np.searchsorted(np.cumsum(after), np.arange(0, int(after.sum()) + 1, 1 << 15))
            for b, e in zip(step, [*step[1:], len(rep)], strict=True):
                a = np.repeat(np.arange(b, e), after[b:e])
                ends = np.cumsum(after[b:e])
                other = a + 1 + np.arange(len(a)) - np.repeat(ends - after[b:e], after[b:e])
                go = (root[a] != root[other]) & _fits(n[a], n[other], percent)
                a, other = a[go], other[go]
                go = _agreement(sig[a], sig[other]) >= least
                forest.join(a[go], other[go])
            for b, e in zip(cuts[:-1], cuts[1:], strict=True):
                if small[b]:
                    continue
                left, right = _halves(side[b:e], x[b] == y[b])
                left, right = left + b, right + b
                wide = max(1, (16 << 20) // (bins * max(1, len(right))))
                for at in range(0, len(left), wide):
                    part = left[at : at + wide]
                    go = (root[part][:, None] != root[right]) & _fits(n[part][:, None], n[right], percent)
                    go &= _agreement(sig[part][:, None, :], sig[right][None]) >= least
                    i, j = np.nonzero(go)
                    forest.join(part[i], right[j])
            i, j = forest.edges()
            yield pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[j])], ["a", "b"])

    return run


def _links(bins: int, percent: int):
    """Of the components that the sets of each cell link, each with the least of those it comes together with."""
    least = least_agreement(bins, percent)

    def cell(root: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, of = np.unique(root, return_inverse=True)
        label = of.copy()
        sizes = np.array([len(s) for s in sets])
        known = np.unique(np.concatenate([sets[i] for i in left]))
        grams = np.concatenate([sets[j] for j in right])
        place = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        place[known[place] != grams] = len(known)
        begins = np.cumsum([0, *sizes[right]])
        sig = np.stack([signature(s, bins).astype(np.uint8) for s in sets])
        mark = np.zeros(len(known) + 1, np.int32)
        wide = max(1, (16 << 20) // (bins * len(right)))
        for at in range(0, len(left), wide):
            part = left[at : at + wide]
            near = _fits(sizes[part][:, None], sizes[right], percent) & (_agreement(sig[part][:, None, :], sig[right][None]) >= least)
            for i, row in zip(part, near, strict=True):
                some = np.flatnonzero(row & (label[right] != label[i]))
                if left is right:
                    some = some[right[some] > i]
                if not len(some):
                    continue
                own = np.searchsorted(known, sets[i])
                mark[own] = 1
                length = sizes[right[some]]
                first = np.cumsum(length) - length
                take = np.arange(int(length.sum())) + np.repeat(begins[some] - first, length)
                common = np.add.reduceat(mark[place[take]], first)
                mark[own] = 0
                for j in right[some[100 * common >= percent * (sizes[i] + length - common)]]:
                    low, high = sorted((label[i], label[j]))
                    label[label == high] = low
        both = np.unique(np.column_stack([of, label])[of != label], axis=0)
        return names[both[:, 0]], names[both[:, 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in _cells(batches, ["family", "x", "y"]):
            root, side, x, y = (t.column(c).to_numpy() for c in ("root", "side", "x", "y"))
            found = [(root[:0], root[:0])]
            for b, e in zip(cuts[:-1], cuts[1:], strict=True):
                left, right = _halves(side[b:e], x[b] == y[b])
                if len(left) and len(right):
                    sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in t.column("grams").slice(b, e - b)]
                    found.append(cell(root[b:e], sets, left, right))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f)) for f in zip(*found, strict=True)], ["a", "b"])

    return run


def _dealt(rows: DataFrame, others: Column, mains: Column, main: Column) -> DataFrame:
    """rows in blocks, each row once for every cell (x, y) of two blocks it takes part in, in the left (side 0) or right one.

    others and mains are the numbers of blocks, the latter of the rows for which main
    holds, which meet the others only; without any mains all rows are dealt to the others.
    """
    salt = F.xxhash64(F.lit("block"), "rep")
    df = rows.withColumns({"__o": others.cast("int"), "__m": mains.cast("int")}).withColumn("__is", main & (F.col("__m") > 0))
    df = df.withColumn("__g", F.when(F.col("__is"), F.col("__o") + F.pmod(salt, F.col("__m"))).otherwise(F.pmod(salt, F.col("__o"))).cast("int"))
    upto = F.when(F.col("__is"), F.col("__o") - 1).otherwise(F.col("__o") + F.col("__m") - 1)
    df = df.withColumn("__j", F.explode(F.sequence(F.lit(0), upto)))
    x, y, side = F.least("__g", "__j"), F.greatest("__g", "__j"), (F.col("__j") < F.col("__g")).cast("int")
    return df.withColumns({"x": x, "y": y, "side": side}).drop("__o", "__m", "__is", "__g", "__j")


def _rest(spokes: DataFrame, sigs: DataFrame, sets: DataFrame, bins: int, percent: int) -> DataFrame | None:
    """spokes: key, rep, root, n of all bucket members but the hubs. Returns pairs (a, b) of roots that are linked, if any spokes may be."""
    by_root = spokes.groupBy("key", "root").agg(F.count("*").alias("c"))
    open_ = by_root.groupBy("key").agg(F.max(F.struct("c", "root")).alias("main"), F.sum("c").alias("c"), F.count("*").alias("roots")).where("roots > 1")
    one = F.col("c") <= _CELL
    blocks = lambda c: F.ceil(c / _CELL)
    open_ = open_.select("key", F.col("main.root").alias("main"), F.when(one, 1).otherwise(blocks(F.col("c") - F.col("main.c"))).alias("o"), F.when(one, 0).otherwise(blocks(F.col("main.c"))).alias("m"))
    rows = _dealt(spokes.join(open_, "key"), F.col("o"), F.col("m"), F.col("root") == F.col("main")).join(sigs, "rep")
    rows = rows.select("key", "x", "y", "side", "rep", "root", "n", "sig").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side")
    edges = settle(rows.mapInArrow(_plausible(bins, percent), "a long, b long"), "plausible")
    if edges.isEmpty():
        return None
    families = components(edges).select(F.col("node").alias("rep"), F.col("root").alias("family"))
    members = settle(families.join(spokes.select("rep", "root", "n").distinct(), "rep"), "families")
    weight = F.sum(F.col("n") * 8 + _ROW_BYTES)
    by_root = members.groupBy("family", "root").agg(weight.alias("c"))
    sizes = by_root.groupBy("family").agg(F.max(F.struct("c", "root")).alias("main"), F.sum("c").alias("c"))
    one = F.col("c") <= _BYTES
    blocks = lambda c: F.ceil(c / _BYTES)
    sizes = sizes.select("family", F.col("main.root").alias("main"), F.when(one, 1).otherwise(blocks(F.col("c") - F.col("main.c"))).alias("o"), F.when(one, 0).otherwise(blocks(F.col("main.c"))).alias("m"))
    rows = _dealt(members.join(sizes, "family").where(F.col("o") > 0), F.col("o"), F.col("m"), F.col("root") == F.col("main"))
    rows = rows.join(sets.withColumnRenamed("id", "rep"), "rep").select("family", "x", "y", "side", "root", "grams")
    rows = rows.repartition("family", "x", "y").sortWithinPartitions("family", "x", "y", "side")
    return settle(rows.mapInArrow(_links(bins, percent), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, k: int = K, percent: int = PERCENT, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable by links of at least percent / 100 Jaccard), kept (doc_id is that id)."""
    signed = settle(signatures(docs, k, bins, rows), "signatures")
    linkable = signed.where("n > 0 and doc_id is not null")
    classes = settle(linkable.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    keyed = classes.withColumn("doc_id", F.col("rep"))  # joined on the id as well, so a large class is no hot key
    reps = linkable.join(keyed.hint("merge"), ["doc_id", "d1", "d2"]).dropDuplicates(["doc_id", "d1", "d2"]).select("rep", "n", "bands", "sig")
    reps = settle(reps, "representatives")
    rows_ = reps.select("rep", "n", F.explode("bands").alias("key"))
    crowded = rows_.groupBy("key").agg(F.count("*").alias("crowd")).where("crowd > 1")
    rows_ = settle(rows_.join(crowded, "key"), "rows")
    # A text in the midst of its near copies meets the most of them, and so makes the best hub.
    met = rows_.groupBy("rep").agg(F.sum("crowd").alias("met"))
    buckets = settle(rows_.join(met, "rep").select("key", "rep", "n", "met"), "buckets")
    discard(rows_)
    needed = buckets.select(F.col("rep").alias("doc_id")).distinct()
    sets = settle(texts(docs).join(needed.hint("merge"), "doc_id", "left_semi").mapInArrow(_gram_sets(k), "id long, grams binary"), "sets")

    hubs = buckets.groupBy("key").agg(F.max(F.struct("met", "rep", "n")).alias("hub"))
    fits = 100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")
    pair = [F.greatest("rep", "hub.rep").alias("id"), F.least("rep", "hub.rep").alias("hub")]
    pairs = settle(buckets.join(hubs, "key").where("rep <> hub.rep").where(fits).select(*pair).distinct(), "pairs")
    links = settle(_confirmed(pairs, sets, percent), "links")
    roots = settle(components(links), "roots")
    of = roots.withColumnRenamed("node", "rep")
    spokes = buckets.join(hubs.select("key", F.col("hub.rep").alias("rep")), ["key", "rep"], "left_anti")
    spokes = settle(spokes.join(of, "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root"), "n"), "spokes")
    discard(buckets)
    discard(pairs)
    more = _rest(spokes, reps.select("rep", "sig"), sets, bins, percent)
    rooted = classes.join(of, "rep", "left").select("d1", "d2", F.coalesce("root", "rep").alias("root"))
    if more is not None:
        rooted = rooted.join(components(more).select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
        rooted = rooted.select("d1", "d2", F.coalesce("top", "root").alias("root"))
    rooted = settle(rooted, "rooted")  # so that the join below can be split where a class is large
    for done in (sets, reps, spokes):
        discard(done)
    out = signed.select("doc_id", "n", "d1", "d2").join(rooted, ["d1", "d2"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("root")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
