"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic rows are the positives; the unlabelled sample is drawn from the
judged rows with labels hidden, as one from the whole table rejects more clean texts
where positives are few. Rows held out are in neither. A linear model over hashed distinct words is fitted by proximal gradient steps on the
class-prior-corrected risk

    prior * E_pos[loss(f)] + max(0, E_unl[loss(-f)] - prior * E_pos[loss(-f)])

and whenever the second term would turn negative the step goes back up on it
instead, which is what keeps the estimator from fitting the positives by heart.
Both samples are bounded (``max_positive``, ``max_unlabelled`` ids, taken by hash);
the prior is counted over all judged ids, and scoring reads every whole text, in
groups of about a megabyte.

Edge cases: null and empty texts get the score of the bias alone; labels that are
null count as neither class; rows with a null doc_id are scored and never learnt
from; without any positive the model gives every text the score 0; rows that repeat
a doc_id are each scored, and one of them, of the least bytes of word hashes, is
learnt from; an id judged both ways is toxic; an empty table gives an empty result;
other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidegrid.llm._text import PUNCTUATED, chunks, words

BITS, MAX_POSITIVE, MAX_UNLABELLED = 18, 4_000, 12_000
_SPARE = 8  # candidates by hash for each place in a sample


@dataclass
class Model:
    bias: float
    weights: np.ndarray  # one for each of 2 ** bits buckets of words


def _features(column: pa.Array, bits: int):
    """For each chunk: number of texts, then text index and bucket of each distinct (text, bucket)."""
    for first, end, data, offsets in chunks(column):
        hashes, begins = words(data, offsets, PUNCTUATED)
        of = np.repeat(np.arange(end - first, dtype=np.int64), np.diff(begins))
        key = np.unique(of << bits | (hashes >> np.uint64(64 - bits)).astype(np.int64))
        yield end - first, key >> bits, key & ((1 << bits) - 1)


def _buckets(bits: int):
    def run(batches):
        for batch in batches:
            out = []
            for n, of, bucket in _features(batch.column("text"), bits):
                at = np.searchsorted(of, np.arange(n + 1))
                out += [bucket[b:e].astype("<i4").tobytes() for b, e in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("positive"), pa.array(out, pa.binary())], ["doc_id", "positive", "buckets"])

    return run


def _descend(of: np.ndarray, column: np.ndarray, n: int, n_pos: int, prior: float, shrink: float, steps: int, rate: float) -> tuple[np.ndarray, float]:
    """Proximal Adam steps on the non-negative risk with logistic loss; rows below n_pos are the positives."""
    size, n_unl = int(column.max(initial=-1)) + 1, n - n_pos
    is_pos = np.arange(n) < n_pos
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    m1, m2, c1, c2 = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        f = b + np.bincount(of, w[column], n)
        up = 1 / (1 + np.exp(-np.clip(f, -60, 60)))  # slope of loss(-f)
        loss = np.logaddexp(0, f)
        rest = loss[~is_pos].mean() - prior * loss[is_pos].mean()
        slope = np.where(is_pos, -prior * up / n_pos, up / n_unl)
        slope = -slope if rest < 0 else slope + np.where(is_pos, -prior * (1 - up) / n_pos, 0)
        g, gb = np.bincount(column, slope[of], size), slope.sum()
        m1, m2, c1, c2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g, 0.9 * c1 + 0.1 * gb, 0.999 * c2 + 0.001 * gb * gb
        pace = rate / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-4)
        w = w - pace * m1 / (1 - 0.9**t)
        w = np.sign(w) * np.maximum(0, np.abs(w) - pace * shrink)
        b -= rate / (np.sqrt(c2 / (1 - 0.999**t)) + 1e-4) * c1 / (1 - 0.9**t)
    return w, b


def fit_risk(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, size: int, steps: int = 150, rate: float = 0.1, choosy: float = 0.1) -> Model:
    """Two descents: one with an L1 term in proportion to the sampling error of word frequencies
    chooses the words, one without it refits the chosen words, whose weights the term had held down."""
    n_pos, n = len(positive), len(positive) + len(unlabelled)
    if not n_pos or n_pos == n or not 0 < prior < 1:
        return Model(-np.inf if not n_pos else np.inf, np.zeros(size, np.float32))
    rows = [*positive, *unlabelled]
    seen, column, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    often = count[column] > 1
    of, column = np.repeat(np.arange(n), [len(r) for r in rows])[often], column[often]
    w, _ = _descend(of, column, n, n_pos, prior, choosy * prior / np.sqrt(n_pos), steps, rate)
    chosen = np.flatnonzero(w)
    place = np.full(len(seen), -1)
    place[chosen] = np.arange(len(chosen))
    stay = place[column] >= 0 if len(column) else np.zeros(0, bool)
    refit, b = _descend(of[stay], place[column[stay]], n, n_pos, prior, 0.0, 2 * steps, rate)
    weights = np.zeros(size, np.float32)
    weights[seen[chosen[: len(refit)]]] = refit
    return Model(b, weights)


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learnt from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sample(ids: DataFrame, n: int, most: int) -> DataFrame:
    """At most most of about n ids, in an order by hash; hashes too high to be chosen go before the sort."""
    turn = F.xxhash64(F.lit("sample"), "doc_id")
    low = F.pmod(turn, F.lit(1 << 32)) < int((1 << 32) * min(1, _SPARE * most / max(1, n)))
    return ids.where(low).orderBy(turn, "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """labels: doc_id, toxic (0 or 1, 1 confirmed toxic). At most max_positive + max_unlabelled rows of hashed words reach the driver."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic") == 1).alias("toxic"))
    total, toxic = known.agg(F.count("*"), F.count_if("toxic")).first()
    if not toxic:
        return Model(-np.inf, np.zeros(1 << bits, np.float32))
    sample = _sample(known.where("toxic").select("doc_id"), toxic, max_positive).withColumn("positive", F.lit(True))
    hidden = _sample(known.select("doc_id"), total, max_unlabelled)
    sample = sample.unionByName(hidden.select("doc_id", F.lit(False).alias("positive")))
    # The sample's size is a parameter, so the broadcast is bounded.
    chosen = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    hashed = chosen.select(F.col("doc_id").cast("string"), "positive", "text").mapInArrow(_buckets(bits), "doc_id string, positive boolean, buckets binary")
    got = hashed.groupBy("doc_id", "positive").agg(F.min("buckets").alias("buckets")).orderBy("positive", "doc_id").toArrow()  # one row an id
    sides = {True: [], False: []}
    for positive, raw in zip(got.column("positive").to_pylist(), got.column("buckets").to_pylist(), strict=True):
        sides[positive].append(np.frombuffer(raw, "<i4"))
    return fit_risk(sides[True], sides[False], toxic / total, 1 << bits)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column between 0 and 1, higher where toxic is likelier; a column of that name is replaced."""
    bits = len(model.weights).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    @F.arrow_udf(DoubleType())
    def run(text: pa.Array) -> pa.Array:
        bias, weights = shared.value
        out = [np.zeros(0)]
        for n, of, bucket in _features(text, bits):
            f = bias + np.bincount(of, weights[bucket], n)
            out.append(1 / (1 + np.exp(-np.clip(f, -500, 500))) if np.isfinite(bias) else np.full(n, float(bias > 0)))
        return pa.array(np.concatenate(out))

    return docs.withColumn(name, run(F.coalesce(F.col("text").cast("string"), F.lit(""))))
