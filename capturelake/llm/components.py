"""Connected components of a graph given by its edges, in joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import attach
from ..session import durable, release

#: A hub has over one of so many edges, and at least so many of its own.
HUB_SHARE, HUB_EDGES = 10_000, 50
#: Up to so many edges, a round's minima (one row a node) are broadcast and its rows lie in few partitions.
FEW_EDGES, FEW_PARTS = 200_000, 8


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _round(now: DataFrame, count: int, few: int) -> DataFrame:
    """The edges (a, b), a > b, after one star step over larger and one over smaller neighbours.

    Of few edges the minima are broadcast and every step reads few partitions, so a round
    costs a few tasks however many partitions a shuffle has.
    """
    small = count <= few
    # At most 2 * HUB_SHARE nodes have that many edges.
    hub = max(HUB_EDGES, count // HUB_SHARE)

    def held(df: DataFrame) -> DataFrame:
        return df.coalesce(FEW_PARTS) if small else df

    def back(rows: DataFrame, least: DataFrame) -> DataFrame:
        if small:
            return rows.join(F.broadcast(least.drop("n")), "a")
        return attach(rows, least, ["a"], F.col("n"), hub)

    def least(rows: DataFrame) -> DataFrame:
        return held(rows.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))

    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    first = least(now.select(F.inline(ends)))
    down = now.select(F.col("b").alias("a"), F.col("a").alias("v"))
    upper = held(back(down, first.select("a", F.least("a", "m").alias("m"), "n")).select(
        F.col("v").alias("a"), F.col("m").alias("b")).distinct())
    lowest = least(upper)
    lower = back(upper, lowest).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return held(lower.union(lowest.select("a", F.col("m").alias("b"))).distinct())


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """Rows (node, root) for every node that has an edge; root is the smallest node it reaches.

    ``edges`` has two columns of one ordered type; direction, loops, nulls and
    repeated rows do not matter. Stars are rebuilt towards the smallest
    neighbour, first over larger and then over smaller neighbours, until
    nothing changes. Neighbour lists are never gathered: each step is a
    minimum per node (pre-aggregated) that returns to the node's edges; the
    edges of a hub are spread for that. Every round is checkpointed.
    """
    a, b = edges.columns
    now = durable(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .filter(F.col("a") > F.col("b")).distinct()
    )
    before, state = None, _state(now)
    while state[0] and state != before:
        now, earlier = durable(_round(now, state[0], few)), now
        before, state = state, _state(now)
        release(earlier)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
