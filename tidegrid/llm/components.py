"""Connected components by alternating large and small stars over shared-folder tables.

Each round only moves edges (never neighbourhoods): a node's smallest neighbour is
a partial aggregate, and the join back is one Catalyst splits when a hub is hot.
Nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm._store import discard, settle


class Forest:
    """Components of n nodes of one task under the links seen so far; of: each node's least node."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.of[a], self.of[b]
            if (x == y).all():
                return
            low = np.minimum(x, y)
            np.minimum.at(self.of, x, low)
            np.minimum.at(self.of, y, low)
            while (self.of != (up := self.of[self.of])).any():
                self.of = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Each node that is not the least of its component, and that one."""
        moved = np.flatnonzero(self.of != np.arange(len(self.of)))
        return moved, self.of[moved]


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v. Large: a node's greater neighbours move to its smallest neighbour; small: its lesser ones and itself do."""
    pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:  # hubs are hot here: joined as a table of its own, their edges can be split among tasks
        least = settle(least, "least")
    joined = pairs.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) in any order and direction, self links and nulls ignored; returns node, root for each linked node, root the least reachable id, itself included."""
    stars = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars = settle(stars, "edges")
    state = _state(stars)
    while state[0]:
        new = settle(_star(_star(stars, True), False), "edges")
        discard(stars)
        stars, before = new, state
        state = _state(stars)
        if state == before:
            break
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
