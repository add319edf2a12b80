"""Winnowing fingerprints, by DataFrame functions only.

Tokens are maximal runs of letters and digits, lower-cased. K-gram hashes roll up by
doubling (hashes of 1, 2, 4 tokens), and so do window minima (1, 2, 4, ... hashes),
each step one zip of an array with its own shift. A hash shares a long with its
position counted from the far end, so the smallest long of a window is the
smallest hash and, among equals, the rightmost. Two texts sharing a run of
WINDOW + K - 1 tokens share a fingerprint hash.

Edge cases: a text of fewer tokens than K is one k-gram of all it has; a text
without tokens has the hash of the text itself; fewer k-grams than a window are
one window; a null text is the empty one; equal texts have equal fingerprints;
other columns pass through, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WINDOW = 4, 8  # powers of two
_FAR = (1 << 31) - 1
_PER_BUCKET, _MOST_BUCKETS = 512, 50_000


def _zipped(array: str, shift: int, f) -> Column:
    """f over array[i], array[i + shift], for each i with both."""
    return F.zip_with(F.slice(array, 1, F.greatest(F.size(array) - shift, F.lit(0))), F.slice(array, shift + 1, F.greatest(F.size(array) - shift, F.lit(0))), f)


def winnowed(df: DataFrame, text: str, out: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """df with an array of longs, each hash (32 bits) << 31 | 2**31 - 1 - position, by position."""
    t, h = f"__{out}_t", f"__{out}_h"
    columns = df.columns
    df = df.withColumn(t, F.split(F.lower(text), r"[^\p{L}\p{N}]+"))
    df = df.withColumn(t, F.filter(t, lambda x: x != ""))
    df = df.withColumn(h, F.transform(t, lambda x: F.xxhash64(x)))
    step = 1
    while step < k:  # an array too short for the whole k keeps the longest grams it has, joined below
        df = df.withColumn(h, F.when(F.size(h) > step, _zipped(h, step, lambda a, b: F.xxhash64(a, b))).otherwise(F.array(F.xxhash64(F.col(h)))))
        step *= 2
    df = df.withColumn(h, F.when(F.size(t) == 0, F.array(F.xxhash64(text))).otherwise(F.col(h)))
    df = df.withColumn(h, F.transform(h, lambda x, i: F.shiftleft(x.bitwiseAND(0xFFFFFFFF), 31).bitwiseOR(F.lit(_FAR) - i.cast("long"))))
    step = 1
    while step < window:
        df = df.withColumn(h, F.when(F.size(h) > step, _zipped(h, step, lambda a, b: F.least(a, b))).otherwise(F.array(F.array_min(h))))
        step *= 2
    return df.select(*columns, F.array_distinct(h).alias(out))


def hashes(prints: str) -> Column:
    """The distinct hashes of a fingerprint, without positions."""
    return F.array_distinct(F.transform(prints, lambda x: F.shiftright(x, 31)))


def rendered(prints: str) -> Column:
    """hash:position pairs in order, as text."""
    return F.array_join(F.transform(prints, lambda x: F.concat(F.hex(F.shiftright(x, 31)), F.lit(":"), (F.lit(_FAR) - x.bitwiseAND(_FAR)).cast("string"))), " ")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two arrays of hashes, 0 with a null."""
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(common / (F.size(a) + F.size(b) - common), F.lit(0.0))


def deal(docs: DataFrame, per_bucket: int = _PER_BUCKET) -> DataFrame:
    """docs dealt so that follow() can pair each row with the next by (doc_id, text), the last with the first.

    Rows are dealt to ranges of ids whose first ids are known (quantiles, so ranges
    are even), and each range's first row is also sent to the range before as a
    guest; no window spans the table. Rows with a null doc_id have no next row.
    """
    ids = docs.where("doc_id is not null")
    n, least = ids.agg(F.count("*"), F.min("doc_id")).first()
    m = max(1, min(_MOST_BUCKETS, n // per_bucket))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / m for i in range(1, m)], 10 * m)).first()[0] if m > 1 else []
    starts = sorted({least, *cuts}) if n else [0]
    last = len(starts) - 1
    first_ids = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>")
    columns = docs.columns
    dealt = docs.withColumn("__b", F.lit(0))
    for step in (1 << i for i in reversed(range(last.bit_length()))):  # binary search, a codegen step each
        ahead = F.col("__b") + step
        dealt = dealt.withColumn("__b", F.when((ahead <= last) & (F.get(first_ids, ahead) <= F.col("doc_id")), ahead).otherwise(F.col("__b")))
    place = lambda b, guest: F.struct(F.lit(b).cast("int").alias("b"), F.lit(guest).alias("guest"))
    head = F.get(first_ids, F.col("__b")) == F.col("doc_id")
    places = (
        F.when(F.col("doc_id").isNull(), F.array(place(-1 - F.pmod(F.xxhash64("text"), 4096), 0)))
        .when(head & (F.col("__b") == 0), F.array(place(F.col("__b"), 0), place(last, 2)))
        .when(head, F.array(place(F.col("__b"), 0), place(F.col("__b") - 1, 1)))
        .otherwise(F.array(place(F.col("__b"), 0)))
    )
    dealt = dealt.select(*columns, F.explode(places).alias("__p")).select(*columns, F.col("__p.b").alias("__b"), F.col("__p.guest").alias("__guest"))
    return dealt.repartition("__b")


def follow(dealt: DataFrame, carried: list[str]) -> DataFrame:
    """The second half of the pairing: next_<c> for each c in carried, guests gone."""
    order = Window.partitionBy("__b").orderBy("__guest", "doc_id", "text")
    out = dealt.withColumns({f"next_{c}": F.when(F.col("doc_id").isNotNull(), F.lead(c).over(order)) for c in carried})
    return out.where("__guest = 0").drop("__b", "__guest")
