"""Clusters from pair lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.session import Scratch


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an edge list; the component is its smallest node.

    Alternating large-star and small-star steps: each node hands its neighbours on to the smallest node it
    knows of, so the edge count never grows and stars are reached in a logarithmic number of rounds.  All
    steps are joins and partial aggregates; each round is written to the shared folder.  Loops and nulls
    are ignored, so a node without a partner is not in the result.
    """
    work = Scratch(edges.sparkSession, "components")
    cur = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    cur = work.save(cur.distinct(), "edges0")
    seen = None
    for k in range(1, max_rounds + 1):
        both = cur.select("u", "v").unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), "m")
        nxt = small.where("u <> m").select("u", F.col("m").alias("v")).distinct()
        cur, old = work.save(nxt, f"edges{k}"), f"edges{k - 1}"
        mark = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        work.drop(old)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("the components have not settled")
    lows = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(lows)
