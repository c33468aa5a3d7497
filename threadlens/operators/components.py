"""Connected components of an edge table by alternating large-star and small-star rounds.

In a large-star round every node hands its larger neighbours to the smallest node that it knows, in a
small-star round its smaller ones. Both hook whole stars at once, so long chains fold up in a few rounds
whatever the order of their ids. The loop ends when a round changes nothing; there is no cap. A star table of
at most ``small`` rows, at the start or after some rounds, is finished by one task of bounded memory, as
rounds over few rows cost their fixed price only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.session import write_shared


def _print(edges: DataFrame) -> tuple:
    """(rows, sum of row hashes): tells whether a round changed anything."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _finished(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(u, v) with v the smallest node that u is connected to, for all u of a bounded table."""
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist()):
            u, v = root(u), root(v)
            parent[max(u, v)] = min(u, v)
    nodes = [u for u in parent if root(u) != u]
    yield pd.DataFrame({"u": nodes, "v": [root(u) for u in nodes]})


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", small: int = 1 << 18) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Rows with a null end are ignored; an edge from a node to itself makes it a node. Each round is two
    aggregations with partial sums per task and two joins; every round is written to the shared folder, so
    plans stay small and lost executors cost one round.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    ends = write_shared(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    stars, before = ends.where("u > v"), None
    while (now := _print(stars)) != before and now[0]:
        if now[0] <= small:
            stars = write_shared(stars.coalesce(1).mapInPandas(_finished, stars.schema), "components")
            break
        before = now
        both = stars.union(stars.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = write_shared(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = write_shared(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    alone = ends.where("u = v").select("u").join(stars.select("u"), "u", "left_anti")
    roots = stars.select(F.col("v").alias("u")).union(alone).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select(F.col("u").alias("node"), F.col("u").alias("component")))
