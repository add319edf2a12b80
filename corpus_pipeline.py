"""From documents to token ids: five stages over what each stage before kept.

Every stage is written as Parquet in the shared folder and reread, so a lost
executor costs one stage's tasks at most. Rows with a null doc_id pass the
filters as other rows do; rows that repeat a doc_id are each judged by their own
text, but near-dedup and mixing take all rows of a doc_id out if they take one out;
very long texts are handled whole; an empty table passes through as an
empty table; columns beyond those of documents pass through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import bpe, linededup, minhash, mixing, queries, toxicity
from tidegrid.llm._store import settle, table

MIX_PERCENT = 90
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under one half stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = "score" + "_" * max(map(len, docs.columns))  # no name of the table's own
    return toxicity.score(docs, model, score).where(F.col(score) < 0.5).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, n_chars follows the text."""
    out = linededup.dedup_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest id; links are those of at least NEAR_PERCENT / 100 Jaccard."""
    gone = minhash.near_duplicates(docs, percent=NEAR_PERCENT).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A share of MIX_PERCENT of all tokens, by weights; each document once at most. The one that a leaf's budget ends in stays whole, so a leaf's long first document never empties it."""
    weighed = settle(mixing.weigh(docs, queries.source_domain()), "weighed")
    mixed = mixing.mix(weighed, percent=MIX_PERCENT, max_epochs=1, weights=queries.MIX_WEIGHTS)
    # Documents without tokens use no budget and stay.
    gone = mixed.where("copies = 0 and cut_tokens = 0 and n_tokens > 0 and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, lang, source, ids (little-endian unsigned 32-bit integers), n_tokens, and whether decoding gave the text back."""
    out = bpe.round_trip(docs.select("doc_id", "lang", "source", "text", F.xxhash64("text").alias("__h")), path or queries.vocabulary())
    same = F.xxhash64("decoded") == F.coalesce("__h", F.xxhash64(F.lit("")))
    return out.select("doc_id", "lang", "source", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), same.alias("restored"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("BPE", encode),
]

#: A trained classifier, MinHash components and BPE are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
