"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one class, and one vector of each class goes on. Classes are
dealt to shards by hash; a task builds its shard's graph and then takes the
vectors of all shards as queries, in batches. Searches run as array arithmetic
over a batch: a beam per query, a few of its best unexpanded entries opened at a
time. A beam whose worst entry is still a link is widened until it is not. Before
the search some AUDIT queries a shard, chosen by hash, are compared with brute
force: each has the share of its own links found, itself left out, and while the
mean of these shares is below RECALL all beams double (at the shard's size a beam
is brute force). A hot group's many links so count no more than a lone pair's, and
the audits' work grows with the vectors. What they found is logged. Links are
confirmed by cosine in double precision.

A task never emits pairs: it returns each query's number of links and one linked
node, and each node's root under a union over all links it has seen, which is
enough for the components.

SHARD bounds a shard's rows, hence a task's memory, and MIN_SHARDS gives small
tables parallel tasks. Edge cases: vectors that are null, empty, zero or hold null
or non-finite components link with nothing; vectors of different lengths never
link; rows with a null vec_id stay alone with a null component; rows repeating a
vec_id are one node; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm._store import settle
from tidegrid.llm.components import Forest, components

THRESHOLD, RECALL = 0.9, 0.99
SHARD, MIN_SHARDS = 65_536, 12
M, EF_BUILD, EF_SEARCH = 12, 24, 16
AUDIT = 2048
_OPEN, _BLOCK = 4, 512
_NODES, _AUDITED, _QUERIES = 0, 1, 2
_log = logging.getLogger(__name__)


def units(flat: np.ndarray, dim: int) -> np.ndarray:
    """Rows scaled to length 1, in double precision, safe from overflow."""
    v = flat.astype(np.float64).reshape(-1, dim)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class Graph:
    """HNSW over unit vectors. layers[0] holds every node; a layer is its member ids and, by node, its neighbours (-1: none)."""

    def __init__(self, vectors: np.ndarray, seed: int = 7):
        self.exact = vectors
        self.v = vectors.astype(np.float32)
        n = len(vectors)
        rng = np.random.Generator(np.random.PCG64(seed))
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(M)).astype(int), 6)
        level[0] = max(1, level.max(initial=0)) if n else 0
        self.level = level
        self.links = [np.full((n, 2 * M if k == 0 else M), -1, np.int32) for k in range(int(level.max(initial=0)) + 1)]
        done = 1
        while done < n:  # batches no larger than the graph they are searched in
            end = min(n, done + min(done, _BLOCK))
            self._insert(np.arange(done, end))
            done = end

    def _insert(self, new: np.ndarray) -> None:
        q = self.v[new]
        entry = np.zeros((len(new), 1), np.int32)
        near = q @ q.T
        for k in range(len(self.links) - 1, -1, -1):
            here = self.level[new] >= k
            ids, sims = self.beam(q, entry, EF_BUILD if here.any() else 1, k)
            if here.any():
                # The batch's own members are candidates of one another too.
                own = np.where(here[None, :] & (np.arange(len(new))[:, None] > np.arange(len(new))[None, :]), near, -2)
                m = min(EF_BUILD, len(new))
                best = np.argpartition(-own, m - 1, axis=1)[:, :m]
                own_sims = np.take_along_axis(own, best, axis=1)
                all_ids = np.concatenate([ids, np.where(own_sims > -2, new[best], -1).astype(np.int32)], axis=1)
                all_sims = np.concatenate([sims, own_sims], axis=1)
                self._connect(k, new[here], *self._diverse(all_ids[here], all_sims[here], self.links[k].shape[1] // 2 if k == 0 else M))
            entry = ids[:, : min(4, ids.shape[1])]

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The candidates nearer to the node than to any one chosen before, then the nearest others as room is left."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        v = self.v[np.maximum(ids, 0)]
        among = np.matmul(v, v.transpose(0, 2, 1))
        chosen = np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            clash = (chosen & (among[:, j, :] > sims[:, j, None])).any(axis=1)
            chosen[:, j] = ~clash & (ids[:, j] >= 0) & (chosen.sum(axis=1) < most)
        first = np.argsort(np.where(chosen, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
        return np.take_along_axis(ids, first, 1), np.take_along_axis(sims, first, 1)

    def _connect(self, k: int, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        table = self.links[k]
        table[nodes, : ids.shape[1]] = ids
        width = table.shape[1]
        real = ids >= 0
        target, source, sim = ids[real], np.repeat(nodes, real.sum(axis=1)).astype(np.int32), sims[real]
        if not len(target):
            return
        order = np.lexsort((-sim, target))
        target, source, sim = target[order], source[order], sim[order]
        first = np.flatnonzero(np.diff(target, prepend=-1))
        rank = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
        keep = rank < width
        target, source, sim, rank = target[keep], source[keep], sim[keep], rank[keep]
        touched, row = np.unique(target, return_inverse=True)
        grown = np.full((len(touched), width), -1, np.int32)
        grown_sims = np.full((len(touched), width), -2, np.float32)
        grown[row, rank], grown_sims[row, rank] = source, sim
        old = table[touched]
        old_sims = np.where(old >= 0, np.einsum("bd,bmd->bm", self.v[touched], self.v[np.maximum(old, 0)]), -2)
        again = (grown[:, :, None] == old[:, None, :]).any(axis=2)  # mutual choices inside a batch
        grown[again], grown_sims[again] = -1, -2
        all_ids, all_sims = np.concatenate([old, grown], axis=1), np.concatenate([old_sims, grown_sims], axis=1)
        full = (all_ids >= 0).sum(axis=1) > width
        some = np.argsort(all_ids < 0, axis=1, kind="stable")[:, :width]
        new = np.take_along_axis(all_ids, some, 1)
        if full.any():
            new[full] = self._diverse(all_ids[full], all_sims[full], width)[0]
        table[touched] = new

    def beam(self, q: np.ndarray, entry: np.ndarray, ef: int, k: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of up to ef nodes near each query in layer k, best first (-1, -2: none)."""
        n, table = len(q), self.links[k]
        ids = np.full((n, ef), -1, np.int32)
        sims = np.full((n, ef), -2, np.float32)
        m = min(ef, entry.shape[1])
        ids[:, :m] = entry[:, :m]
        sims[:, :m] = np.where(entry[:, :m] >= 0, np.einsum("bd,bmd->bm", q, self.v[np.maximum(entry[:, :m], 0)]), -2)
        opened = ids < 0
        live = np.arange(n)
        while len(live):
            wait = np.where(opened[live], -3, sims[live])
            pick = np.argsort(-wait, axis=1, kind="stable")[:, : min(_OPEN, ef)]
            fresh = np.take_along_axis(wait, pick, 1) > -3
            go = fresh.any(axis=1)
            live, pick, fresh = live[go], pick[go], fresh[go]
            if not len(live):
                break
            at = np.where(fresh, ids[live[:, None], pick], -1)
            opened[live[:, None], pick] = True
            near = np.where((at >= 0)[:, :, None], table[np.maximum(at, 0)], -1).reshape(len(live), -1)
            # Known or repeated ids drop out: sort by id, the beam's own entries first among equals.
            both = np.concatenate([ids[live], near], axis=1)
            order = np.argsort(both, axis=1, kind="stable")
            by_id = np.take_along_axis(both, order, 1)
            repeat = np.zeros(both.shape, bool)
            np.put_along_axis(repeat, order[:, 1:], by_id[:, 1:] == by_id[:, :-1], 1)
            near = np.where(repeat[:, ef:], -1, near)
            r, c = np.nonzero(near >= 0)
            near_sims = np.full(near.shape, -2, np.float32)
            near_sims[r, c] = np.einsum("pd,pd->p", q[live[r]], self.v[near[r, c]])
            all_ids, all_sims = np.concatenate([ids[live], near], axis=1), np.concatenate([sims[live], near_sims], axis=1)
            all_opened = np.concatenate([opened[live], near < 0], axis=1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :ef]
            ids[live], sims[live] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
            opened[live] = np.take_along_axis(all_opened, best, 1)
        return ids, sims

    def entries(self, q: np.ndarray) -> np.ndarray:
        """Entry points of the lowest layer, by way down from the top."""
        entry = np.zeros((len(q), 1), np.int32)
        for k in range(len(self.links) - 1, 0, -1):
            entry = self.beam(q, entry, 2, k)[0]
        return entry

    def linked(self, q: np.ndarray, threshold: float, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all found pairs with cosine >= threshold; q in double precision."""
        loose = np.float32(threshold - 1e-4)
        single = q.astype(np.float32)
        n = len(self.v)
        todo, entry, out = np.arange(len(q)), self.entries(single), []
        while len(todo):
            ef = min(ef, n)
            step = max(1, min(len(todo), (1 << 21) // ((ef + _OPEN * 2 * M) * 4)))
            wider = []
            for b in range(0, len(todo), step):
                part = todo[b : b + step]
                if ef == n:
                    ids, sims = None, single[part] @ self.v.T
                    r, c = np.nonzero(sims >= loose)
                    out.append((part[r], c))
                    continue
                ids, sims = self.beam(single[part], entry[part], ef)
                more = sims[:, -1] >= loose
                wider.append(part[more])
                r, c = np.nonzero((sims >= loose) & ~more[:, None])
                out.append((part[r], ids[r, c]))
            todo = np.concatenate(wider) if wider else todo[:0]
            ef *= 4
        a = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.int64)
        b = np.concatenate([x for _, x in out]).astype(np.int64) if out else a
        sure = np.einsum("pd,pd->p", q[a], self.exact[b]) >= threshold
        return a[sure], b[sure]


def _audit(graph: Graph, q: np.ndarray, itself: np.ndarray, threshold: float, recall: float) -> tuple[int, int, int]:
    """The beam that finds, of the links that brute force finds from each query but to itself, at least that share on the mean; links there are, links found."""
    ef, n = EF_SEARCH, len(graph.v)
    true = np.zeros(len(q), np.int64)
    for b in range(0, len(q), 256):
        true[b : b + 256] = (q[b : b + 256] @ graph.exact.T >= threshold).sum(axis=1)
    true -= itself >= 0
    some = np.flatnonzero(true)
    while True:
        a, x = graph.linked(q[some], threshold, ef)
        found = np.bincount(a[x != itself[some[a]]], minlength=len(some))
        if ef >= n or not len(some) or np.mean(np.minimum(1, found / true[some])) >= recall:
            return ef, int(true.sum()), int(found.sum())
        ef *= 2


def _search(threshold: float, recall: float):
    """Streams shards one after another: a shard's nodes first, then the audited queries, then all queries in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, kept, graph, ef = None, {}, None, EF_SEARCH

        def built() -> Graph:
            kept["ids"], kept["sizes"] = np.concatenate(kept["ids"]), np.concatenate(kept["sizes"])
            kept["place"] = np.argsort(kept["ids"])
            made = Graph(np.concatenate(kept.pop("vectors")))
            kept["forest"] = Forest(len(kept["ids"]))
            return made

        def placed(rep: np.ndarray) -> np.ndarray:
            """Where each query itself is among the nodes, -1: nowhere."""
            ids, order = kept["ids"], kept["place"]
            at = order[np.minimum(np.searchsorted(ids, rep, sorter=order), len(ids) - 1)]
            return np.where(ids[at] == rep, at, -1)

        def audited() -> Iterator[pa.RecordBatch]:
            nonlocal ef
            if kept.get("audit"):
                rep, q = (np.concatenate(c) for c in zip(*kept.pop("audit"), strict=True))
                ef, true, found = _audit(graph, q, placed(rep), threshold, recall)
                yield _rows(None, [true], [found])

        def finish() -> Iterator[pa.RecordBatch]:
            if graph is not None:
                nodes, least = kept["forest"].edges()
                yield _rows(kept["ids"][nodes], np.zeros(len(nodes), np.int64), kept["ids"][least])

        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "shard", "side")])
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
            for b, e in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if b == e:
                    continue
                dim, side = int(keys[b, 0]), keys[b, 2]
                part = batch.slice(b, e - b)
                rep = part.column("rep").to_numpy()
                q = units(part.column("embedding").flatten().to_numpy(zero_copy_only=False), dim)
                if shard != tuple(keys[b, :2]):
                    yield from finish()
                    shard, kept, graph, ef = tuple(keys[b, :2]), {"ids": [], "sizes": [], "vectors": [], "audit": []}, None, EF_SEARCH
                if side == _NODES:
                    kept["ids"].append(rep)
                    kept["sizes"].append(part.column("size").to_numpy())
                    kept["vectors"].append(q)
                    continue
                if graph is None and not len(kept["ids"]):
                    continue  # no node of this length fell to this shard
                if graph is None:
                    graph = built()
                if side == _AUDITED:
                    kept["audit"].append((rep, q))
                    continue
                yield from audited()
                for at in range(0, len(q), 4096):
                    block, own = q[at : at + 4096], rep[at : at + 4096]
                    a, x = graph.linked(block, threshold, ef)
                    first = np.full(len(block), -1)
                    first[a[::-1]] = x[::-1]
                    kept["forest"].join(x, first[a])
                    other = kept["ids"][x] != own[a]
                    n = np.bincount(a[other], kept["sizes"][x[other]], len(block)).astype(np.int64)
                    some = np.flatnonzero(first >= 0)
                    yield _rows(own[some], n[some], kept["ids"][first[some]])
        yield from finish()

    return run


def _rows(rep: np.ndarray | None, n: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    """Without rep: an audit's links there are (n) and links found (near)."""
    return pa.RecordBatch.from_arrays([pa.array([None] * len(n) if rep is None else rep, pa.int64()), pa.array(n, pa.int64()), pa.array(near, pa.int64())], ["rep", "n", "near"])


def sound(vector: Column) -> Column:
    """Whether a vector can link: no null, NaN or infinity, and not all zero."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, lambda x: F.coalesce(odd(x), F.lit(True))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, shard_rows: int = SHARD, min_shards: int = MIN_SHARDS) -> DataFrame:
    """vectors: vec_id, embedding. Returns vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("sound", sound(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = rows.withColumns({"h1": F.xxhash64("embedding"), "h2": F.hash("embedding")})
    classes = rows.where("sound").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))
    keyed = classes.withColumn("vec_id", F.col("rep"))  # joined on the id as well, so a large class is no hot key
    reps = rows.where("sound").join(keyed, ["vec_id", "h1", "h2"]).dropDuplicates(["vec_id", "h1", "h2"])
    reps = settle(reps.select("rep", "h1", "h2", "size", F.size("embedding").alias("dim"), "embedding"), "vectors")
    count = reps.count()
    shards = max(min_shards, -(-count // shard_rows))
    rows_of = lambda df, side: df.withColumn("side", F.lit(side)).select("dim", "shard", "side", "rep", "size", "embedding")
    everywhere = reps.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    chosen = F.pmod(F.xxhash64(F.lit("audit"), "rep"), F.lit(max(1, count))) < AUDIT
    work = rows_of(reps.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int")), _NODES)
    work = work.unionByName(rows_of(everywhere.where(chosen), _AUDITED)).unionByName(rows_of(everywhere, _QUERIES))
    work = work.repartitionByRange("dim", "shard").sortWithinPartitions("dim", "shard", "side", "rep")
    found = settle(work.mapInArrow(_search(threshold, recall), "rep long, n long, near long"), "links")
    true, hit = found.where("rep is null").agg(F.sum("n"), F.sum("near")).first()
    _log.info("audits found %s of %s links", hit, true)
    found = found.where("rep is not null")
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("near").alias("b")))
    known = reps.select("rep", "h1", "h2", "size").join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("h1", "h2", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("root", "rep").alias("root"))
    known = settle(known, "known")  # so that the join below can be split where a class is large
    sure = rows.where("sound").select("vec_id", "h1", "h2").join(known, ["h1", "h2"], "left").select("vec_id", "n", F.col("root").alias("component_id"))
    rest = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("component_id"))
    out = sure.unionByName(rest).select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
