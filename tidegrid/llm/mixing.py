"""Mixing sources to target weights by hierarchical budgets.

A token budget runs down a tree domain - language - source. At each node it is
split by the children's weights, no child beyond what its leaves can give
(their tokens times max_epochs); what a full child cannot take goes to its
siblings, and only what all children of a node cannot take is left to the
node's own siblings, because the node's capacity already bounds its share.
A leaf's budget is whole epochs of its documents plus a token prefix of one more,
in an order seeded per epoch.

The prefix is found without sorting a leaf: tokens are summed per leaf and hash
bucket (65,536 of them), a running sum names the one bucket in which the budget
ends, and only that bucket's rows are ordered.

All amounts are integers, so sums are exact: the children's shares are
differences of rounded running totals and add up to the budget.

Edge cases: null domain, language or source count as the empty string; a null
text has no tokens; rows with a null doc_id are ordered by the empty id; equal
ids by their number of tokens; an empty table gives an empty result; weights
must be positive integers; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm._store import settle

LEVELS = ("domain", "lang", "source")
_BROADCAST_LEAVES = 20_000
_WORD = r"[^\x20\x09-\x0D]+"


def _weight(name: str, weights: Mapping[str, int], default: int) -> Column:
    if any(w < 1 for w in (*weights.values(), default)):
        raise ValueError("weights are positive integers")
    if not weights:
        return F.lit(default)
    chosen = None
    for key, w in weights.items():
        chosen = (F if chosen is None else chosen).when(F.col(name) == key, F.lit(w))
    return chosen.otherwise(F.lit(default))


def weigh(docs: DataFrame, domain: Column) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens (runs without white space)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(LEVELS, (domain, F.col("lang"), F.col("source")), strict=True)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *named, F.regexp_count(text, F.lit(_WORD)).cast("long").alias("n_tokens"))


def shares(children: DataFrame, parents: list[str], name: str, weight: Column) -> DataFrame:
    """children: parents, name, cap, total (the parent's budget, at most the sum of caps). Adds share and drops total.

    Children are full in the order of cap / weight; the rest split what is left by weight.
    """
    whole = lambda c: c.cast("decimal(38,0)")
    key = [*parents] or [F.lit(0)]
    order = Window.partitionBy(*key).orderBy(F.col("cap") / F.col("w"), name)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(*key)
    df = children.withColumn("w", weight.cast("long"))
    df = df.withColumns({"taken": F.coalesce(F.sum("cap").over(before), F.lit(0)), "open_w": F.sum("w").over(after)})
    df = df.withColumn("full", whole(F.col("cap")) * F.col("open_w") <= whole(F.col("total") - F.col("taken")) * F.col("w"))
    df = df.withColumns({"left": F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0)), "part": F.when(F.col("full"), F.lit(0)).otherwise(F.col("w"))})
    df = df.withColumns({"run": F.sum("part").over(order.rowsBetween(Window.unboundedPreceding, 0)), "all_w": F.sum("part").over(every)})
    cut = lambda w: F.expr(f"cast(left as decimal(28,0)) * cast({w} as decimal(10,0)) div all_w")
    return df.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(cut("run") - cut("(run - part)")).cast("long")).select(*parents, name, "cap", "share")


def leaf_budgets(leaves: DataFrame, budget: int, max_epochs: int, weights: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """leaves: domain, lang, source, tokens. Adds share, the leaf's budget in tokens; budget is cut to what all leaves can give."""
    capped = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    top = capped.agg(F.sum("cap")).first()[0] or 0
    done, parents = None, []
    for level in LEVELS:
        here = capped.groupBy(*parents, level).agg(F.sum("cap").alias("cap"))
        here = here.withColumn("total", F.lit(min(budget, top)).cast("long")) if done is None else here.join(done, parents)
        split = shares(here, parents, level, _weight(level, weights.get(level, {}), 1))
        parents = [*parents, level]
        done = split.select(*parents, F.col("share").alias("total"))
    return leaves.join(done.withColumnRenamed("total", "share"), list(LEVELS))


def mix(weighed: DataFrame, budget: int | None = None, percent: int = 100, max_epochs: int = 4, seed: int = 0, weights: Mapping[str, Mapping[str, int]] | None = None) -> DataFrame:
    """weighed as of weigh(), settled; budget in tokens, or else that percentage of all tokens.

    Adds copies (whole copies taken: full epochs and, within the prefix, one more) and
    cut_tokens (tokens of one further copy that the budget's end cuts short).
    """
    leaves = weighed.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    leaves = settle(leaves, "leaves")
    if budget is None:
        budget = (leaves.agg(F.sum("tokens")).first()[0] or 0) * percent // 100
    budgets = leaf_budgets(leaves, budget, max_epochs, weights or {})
    per = F.greatest("tokens", F.lit(1))
    budgets = settle(budgets.select(*LEVELS, F.floor(F.col("share") / per).alias("epochs"), (F.col("share") % per).alias("rest")), "budgets")
    small = budgets.count() <= _BROADCAST_LEAVES
    bounded = F.broadcast if small else (lambda df: df)
    turn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = weighed.join(bounded(budgets), list(LEVELS)).withColumn("turn", turn)
    rows = rows.withColumn("bucket", F.conv(F.substring("turn", 1, 4), 16, 10).cast("int"))
    sums = rows.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("sum"), F.first("rest").alias("rest"))
    run = Window.partitionBy(*LEVELS).orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("sum").over(run)).withColumn("upto_before", F.col("upto") - F.col("sum"))
    ends = sums.where("upto_before <= rest and rest < upto").select(*LEVELS, F.col("bucket").alias("end"), "upto_before")
    marked = rows.join(bounded(ends), list(LEVELS), "left")
    inner = Window.partitionBy(*LEVELS).orderBy("turn", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    inside = marked.where("bucket = end").withColumn("ahead", F.col("upto_before") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    inside = inside.withColumn("whole", (F.col("rest") > 0) & (F.col("ahead") + F.col("n_tokens") <= F.col("rest")))
    inside = inside.withColumn("cut_tokens", F.when(F.col("whole"), 0).otherwise(F.greatest(F.col("rest") - F.col("ahead"), F.lit(0))))
    outside = marked.where("end is null or bucket <> end").withColumn("whole", F.coalesce((F.col("rest") > 0) & (F.col("bucket") < F.col("end")), F.lit(False)))
    both = inside.drop("ahead").unionByName(outside.withColumn("cut_tokens", F.lit(0).cast("long")))
    copies = (F.col("epochs") + F.col("whole").cast("int")).cast("long")
    return both.select("doc_id", *LEVELS, "n_tokens", copies.alias("copies"), F.col("cut_tokens").cast("long").alias("cut_tokens"))
