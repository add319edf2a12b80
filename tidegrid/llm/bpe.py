"""Byte-level BPE by speculation and verification.

Words come from the vocabulary's own pre-tokenizing pattern. For each new word
of a batch, greedy longest match proposes tokens. A sequence is what merging
would give exactly when each token encodes to itself and no merge crosses any
adjacent pair, so all distinct adjacent pairs of the batch are tested at once by
array arithmetic over the merge table. Only words with a failing token or pair
are merged exactly. Results are kept per word in a bounded cache.

Edge cases: a null text is the empty text and gives no ids; texts are handled
whole, in groups of about a megabyte; strings of added tokens become their ids,
as the file asks; other columns pass through; an empty table gives an empty
result.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

#: Fixed value: the pre-tokenizing pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NEVER = np.int64(1 << 40)
_NONE = 1 << 40
_CACHE, _CACHED_BYTES = 1 << 18, 64
_GROUP = 1 << 20


@cache
def _byte_of_char() -> dict[str, int]:
    """Printable Latin-1 characters stand for themselves, the other bytes for code points from 256 up, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {chr(b if b in plain else next(rest)): b for b in range(256)}


def _check(spec: dict) -> None:
    """Raises where a file asks for steps that are not done here, rather than give other ids."""
    model, first, last = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    asked = {
        "a model other than BPE": model.get("type", "BPE") != "BPE",
        "a normalizer": spec.get("normalizer") is not None,
        "another pre-tokenizer": first.get("type") != "ByteLevel" or first.get("add_prefix_space") or not first.get("use_regex", True),
        "another decoder": last.get("type") != "ByteLevel",
        "stripping or whole-word added tokens": any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")),
    } | {k: bool(model.get(k)) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")}
    if wrong := [k for k, v in asked.items() if v]:
        raise ValueError(f"this vocabulary asks for {', '.join(wrong)}")


class Codec:
    """Encoder and decoder of one file of byte-level BPE; a file of another kind raises."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check(spec)
        at = _byte_of_char()
        vocab = spec["model"]["vocab"]
        raw = {i: bytes(at[c] for c in s) for s, i in vocab.items()}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = max([*raw, *self.added.values()]) + 1
        self.bytes = [raw.get(i, b"") for i in range(self.size)]
        for s, i in self.added.items():
            self.bytes[i] = s.encode()
        self.id = {b: i for i, b in raw.items()}
        self.byte_ids = [self.id[bytes([b])] for b in range(256)]
        self.rank = np.full(self.size, -1, np.int64)
        self.left, self.right = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        self.merge: dict[int, int] = {}  # rank by pair
        self.whole: list[int] = []  # token by rank
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            i, j, whole = vocab[a], vocab[b], vocab[a + b]
            self.merge.setdefault(i * self.size + j, k)
            self.whole.append(whole)
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = k, i, j
        self.pair_keys = np.array(sorted(self.merge), np.int64)
        self.pair_ranks = np.array([self.merge[x] for x in self.pair_keys.tolist()], np.int64)
        self.itself: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.trie: dict = {}  # by byte; a token's id is under -1
        for b, i in self.id.items():
            node = self.trie
            for x in b:
                node = node.setdefault(x, {})
            node[-1] = i
        self.words: dict[str, bytes] = {}  # words met lately
        self.older: dict[str, bytes] = {}  # those met before them
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in self.added) + ")") if self.added else None
        self.find = regex.compile(PATTERN).findall

    def _greedy(self, word: bytes) -> list[int]:
        out, at, n, trie = [], 0, len(word), self.trie
        while at < n:
            node, k = trie, at
            while k < n and (node := node.get(word[k])) is not None:
                k += 1
                if -1 in node:
                    best, end = node[-1], k
            out.append(best)
            at = end
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merge the lowest rank first, the leftmost among equals."""
        ids = [self.byte_ids[b] for b in word]
        n, size, rank_of, whole = len(ids), self.size, self.merge.get, self.whole
        if n <= 48:  # a plain scan is quicker than a heap
            ranks = [rank_of(a * size + b, _NONE) for a, b in zip(ids, ids[1:], strict=False)]
            while ranks and (r := min(ranks)) < _NONE:
                i = ranks.index(r)
                ids[i] = whole[r]
                del ids[i + 1], ranks[i]
                if i:
                    ranks[i - 1] = rank_of(ids[i - 1] * size + ids[i], _NONE)
                if i < len(ranks):
                    ranks[i] = rank_of(ids[i] * size + ids[i + 1], _NONE)
            return ids
        prev, next_ = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_of(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = next_[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = whole[r], False
            next_[i] = next_[j]
            if next_[i] < n:
                prev[next_[i]] = i
            for x in (prev[i], i):
                y = next_[x] if x >= 0 else n
                if y < n and (r := rank_of(ids[x] * size + ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [x for x, a in zip(ids, alive, strict=True) if a]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge would cross from token a to token b.

        Walks both tokens' derivations back in time: a's right edge and b's left
        edge at each moment. A crossing merge happens iff it outranks the merges
        that use up either edge; the left one goes first among equals.
        """
        x, y = a.copy(), b.copy()
        until_x, until_y = np.full(len(a), _NEVER), np.full(len(a), _NEVER)
        fine = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            key = x[live] * self.size + y[live]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            crossing = np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NEVER)
            fine[live] &= ~((crossing < until_x[live]) & (crossing <= until_y[live]) & (crossing < _NEVER))
            rx, ry = self.rank[x[live]], self.rank[y[live]]
            go = fine[live] & ((rx >= 0) | (ry >= 0))
            live, rx, ry = live[go], rx[go], ry[go]
            left = rx > ry
            i, j = live[left], live[~left]
            until_x[i], x[i] = rx[left], self.right[x[i]]
            until_y[j], y[j] = ry[~left], self.left[y[j]]
        return fine

    def _settle(self, new: Iterable[str]) -> dict[str, bytes]:
        """The ids of words, as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in new]
        guesses = [self._greedy(w) for w in raw]
        flat = np.fromiter((i for g in guesses for i in g), np.int64)
        if not len(flat):
            return {}
        for i in set(flat.tolist()) - self.itself.keys():
            self.itself[i] = self.exact(self.bytes[i]) == [i]
        of = np.repeat(np.arange(len(guesses)), [len(g) for g in guesses])
        within = np.flatnonzero(of[1:] == of[:-1])
        keys = flat[within] * self.size + flat[within + 1]
        distinct, back = np.unique(keys, return_inverse=True)
        fine = np.array([self.pairs.get(k, 2) for k in distinct.tolist()], np.int64)
        ask = fine == 2
        if ask.any():
            fine[ask] = self.compatible(distinct[ask] // self.size, distinct[ask] % self.size)
            if len(self.pairs) > _CACHE:
                self.pairs.clear()
            self.pairs.update(zip(distinct[ask].tolist(), fine[ask].tolist(), strict=True))
        bad = np.zeros(len(guesses), bool)
        bad[of[within][fine[back] == 0]] = True
        bad[of[~np.fromiter((self.itself[i] for i in flat.tolist()), bool)]] = True
        return {w: np.array(self.exact(r) if x else g, "<u4").tobytes() for w, r, g, x in zip(new, raw, guesses, bad.tolist(), strict=True)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit integers."""
        pieces = [self.split.split(t) if self.split and any(s in t for s in self.added) else [t] for t in texts]
        parts = [[w for k, p in enumerate(ps) for w in ([p] if k % 2 else self.find(p))] for ps in pieces]
        special = {s: np.array([i], "<u4").tobytes() for s, i in self.added.items()}
        known = self.words
        unmet = {w for p in parts for w in p} - known.keys() - special.keys()
        again = unmet & self.older.keys()
        known.update((w, self.older[w]) for w in again)
        new = list(unmet - again)
        known.update(self._settle(new))
        out = []
        for ps, words in zip(pieces, parts, strict=True):
            if len(ps) == 1:
                out.append(b"".join(map(known.__getitem__, words)))
            else:
                out.append(b"".join(special[p] if k % 2 else b"".join(map(known.__getitem__, self.find(p))) for k, p in enumerate(ps)))
        for w in new:
            if len(w) > _CACHED_BYTES:
                del known[w]
        if len(known) > _CACHE:  # words met since the last turn stay
            self.older, self.words = known, {}
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec per Python worker and vocabulary."""
    return Codec(path)


def _grouped(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size > _GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


def _round_trip(path: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            at = 0
            for group in _grouped(batch.column("text").to_pylist()):
                ids = c.encode(group)
                part = batch.slice(at, len(group))
                at += len(group)
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary()), pa.array(map(c.decode, ids), pa.string())], names)

    return run


def round_trip(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns of docs but text, then ids (little-endian unsigned 32-bit integers) and the text decoded from them, in one pass."""
    others = [c for c in docs.columns if c not in ("text", ids, decoded)]
    rows = docs.select(*others, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = StructType([*rows.schema.fields[:-1], StructField(ids, BinaryType()), StructField(decoded, StringType())])
    return rows.mapInArrow(_round_trip(path, schema.names), schema)


def encode(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """docs with a binary column of ids (null texts as empty ones)."""

    @F.arrow_udf(BinaryType())
    def run(text: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([x for g in _grouped(text.to_pylist()) for x in c.encode(g)], pa.binary())

    return docs.withColumn(ids, run(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """encoded with a column text decoded from ids (null ids as none)."""

    @F.arrow_udf(StringType())
    def run(column: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([c.decode(x) for x in column.to_pylist()], pa.string())

    return encoded.withColumn(text, run(F.coalesce(F.col(ids), F.lit(b""))))
