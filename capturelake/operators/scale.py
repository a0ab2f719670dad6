"""Building blocks that stay distributed when one group holds most of the rows.

A plain ``Window.partitionBy(key)`` or ``percentile`` puts a whole group into
one task. These helpers first measure the groups (a count that reads only the
key columns); ordinary groups take the plain form, and where a group is larger
than ``hot_rows`` the same exact result comes from a range-partitioned form
whose pieces are bounded. The same measurement says whether one row per group
is small enough to be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

HOT_ROWS = 5_000_000
FEW_GROUPS = 50_000


@dataclass(frozen=True)
class Shape:
    """Number of groups, rows of the largest one, and all rows where they were counted."""

    groups: int
    largest: int
    rows: int = 0

    def hot(self, hot_rows: int) -> bool:
        return self.largest > hot_rows

    @property
    def few(self) -> bool:
        return self.groups <= FEW_GROUPS


ALL_HOT = Shape(FEW_GROUPS + 1, 1 << 62)


def group_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))


def measure(df: DataFrame, keys: Sequence[str]) -> Shape:
    row = group_sizes(df, keys).agg(F.count(F.lit(1)), F.max("_rows"), F.sum("_rows")).first()
    return Shape(*(n or 0 for n in row))


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    col: str = "idx",
    weight: Column | None = None,
    hot_rows: int = HOT_ROWS,
    shape: Shape | None = None,
) -> DataFrame:
    """Add the sum of the weights of all earlier rows of the group.

    Without a weight this is the row's 0-based position. ``order`` has to be
    unique within a group.
    """

    def before(window) -> Column:
        if weight is None:
            return (F.row_number().over(window) - 1).cast("bigint")
        earlier = F.sum(weight).over(window.rowsBetween(Window.unboundedPreceding, -1))
        return F.coalesce(earlier, F.lit(0)).cast("bigint")

    if not (shape or measure(df, keys)).hot(hot_rows):
        return df.withColumn(col, before(Window.partitionBy(*keys).orderBy(*order)))

    # Range partitions split a hot group; the checkpoint fixes which row lies
    # where, so that both branches below and any retry see the same pieces.
    spread = durable(
        df.repartitionByRange(*[F.col(k) for k in keys], *order)
        .withColumn("_piece", F.spark_partition_id())
    )
    per_piece = spread.groupBy(*keys, "_piece").agg(
        F.sum(F.lit(1) if weight is None else weight).cast("bigint").alias("_sum")
    )
    offsets = per_piece.select(
        *keys, "_piece",
        F.coalesce(
            F.sum("_sum").over(
                Window.partitionBy(*keys).orderBy("_piece")
                .rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_offset"),
    )
    local = before(Window.partitionBy(*keys, "_piece").orderBy(*order))
    return (
        spread.withColumn("_local", local)
        .join(offsets, [*keys, "_piece"])
        .withColumn(col, F.col("_offset") + F.col("_local"))
        .drop("_piece", "_local", "_offset")
    )


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    outputs: dict[str, tuple[Column, int]],
    hot_rows: int = HOT_ROWS,
    shape: Shape | None = None,
) -> DataFrame:
    """Add values of the row before (-1) or after (+1) in the group's order."""

    def shifted(window) -> list[Column]:
        return [
            (F.lead(value) if step > 0 else F.lag(value)).over(window).alias(name)
            for name, (value, step) in outputs.items()
        ]

    if not (shape or measure(df, keys)).hot(hot_rows):
        return df.select("*", *shifted(Window.partitionBy(*keys).orderBy(*order)))

    # Chunks of the order, each with a copy of the row on either side.
    placed = running_total(df, keys, order, "_idx", hot_rows=hot_rows, shape=ALL_HOT)
    size = max(2, hot_rows)
    chunk = F.floor(F.col("_idx") / size)
    at = F.col("_idx") % size
    homes = F.array_compact(F.array(
        chunk,
        F.when((at == 0) & (chunk > 0), chunk - 1),
        F.when(at == size - 1, chunk + 1),
    ))
    copied = placed.withColumn("_home", chunk).withColumn("_chunk", F.explode(homes))
    return (
        copied.select("*", *shifted(Window.partitionBy(*keys, "_chunk").orderBy("_idx")))
        .filter(F.col("_chunk") == F.col("_home"))
        .drop("_idx", "_home", "_chunk")
    )


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    outputs: dict[str, tuple[Column, float]],
    hot_rows: int = HOT_ROWS,
    shape: Shape | None = None,
) -> DataFrame:
    """Linear-interpolated percentiles per group: name -> (value, share)."""
    if not (shape or measure(df, keys)).hot(hot_rows):
        return df.groupBy(*keys).agg(
            *[F.percentile(value.cast("double"), p).alias(name) for name, (value, p) in outputs.items()])
    parts = [_spread_percentile(df, keys, name, value, p, hot_rows) for name, (value, p) in outputs.items()]
    groups = group_sizes(df, keys).drop("_rows")
    return reduce(lambda left, right: left.join(right, list(keys), "left"), parts, groups)


def _spread_percentile(df: DataFrame, keys: Sequence[str], name: str, value: Column, p: float,
                       hot_rows: int) -> DataFrame:
    """One percentile from the global order, without gathering a group.

    Equal values are merged first, so that no single value can be hot.
    """
    counted = (
        df.select(*keys, value.cast("double").alias("_v")).filter(F.col("_v").isNotNull())
        .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    )
    ranked = running_total(counted, keys, [F.col("_v")], "_start", F.col("_c"), hot_rows, shape=ALL_HOT)
    totals = counted.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_distinct"))
    joined = attach(ranked, totals, keys, F.col("_distinct"), hot_rows)
    rank = F.lit(float(p)) * (F.col("_n") - 1)

    def at(place: Column) -> Column:
        inside = (F.col("_start") <= place) & (place < F.col("_start") + F.col("_c"))
        return F.max(F.when(inside, F.col("_v")))

    bounds = joined.groupBy(*keys).agg(
        at(F.floor(rank)).alias("_lo"), at(F.ceil(rank)).alias("_hi"), F.max(rank - F.floor(rank)).alias("_f"))
    return bounds.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias(name))


def attach(
    df: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    rows: Column,
    hot_rows: int = HOT_ROWS,
    shape: Shape | None = None,
) -> DataFrame:
    """Left-join one row of per-group values back onto the rows of the group.

    A measured ``shape`` with few groups lets all values be broadcast, so the
    rows are not shuffled at all.
    ``rows`` is the group's row count within ``stats``. There are at most
    total / hot_rows groups above ``hot_rows``; their values are broadcast and
    their rows are spread over the shuffle by a salt, so a hot group never
    lands in one task. The other groups join as usual.
    """
    if shape is not None and shape.few:
        return df.join(F.broadcast(stats), list(keys), "left")
    if shape is not None and not shape.hot(hot_rows):
        return df.join(stats, list(keys), "left")
    values = [c for c in stats.columns if c not in keys]
    counted = stats.withColumn("_size", rows)
    large = counted.filter(F.col("_size") > hot_rows).select(
        *keys, *[F.col(c).alias(f"_hot_{c}") for c in values], F.lit(True).alias("_hot")
    )
    # Dealt anew by all join keys: a side that already lies by some of them would have the join ignore the salt.
    plain = counted.filter(F.col("_size") <= hot_rows).select(
        *keys, *values, F.lit(0).cast("bigint").alias("_salt")
    ).repartition(*keys, "_salt")
    names = df.columns
    marked = df.join(F.broadcast(large), list(keys), "left").withColumn(
        "_salt",
        F.when(F.col("_hot"), F.xxhash64(*[F.col(c) for c in names]).bitwiseOR(F.lit(1)))
        .otherwise(F.lit(0).cast("bigint")),
    )
    joined = marked.join(plain, [*keys, "_salt"], "left")
    return joined.select(
        *names, *[F.when(F.col("_hot"), F.col(f"_hot_{c}")).otherwise(F.col(c)).alias(c) for c in values]
    )


def first_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank: str | None = None,
    salts: int = 64,
) -> DataFrame:
    """The first ``n`` rows of every group in the given order, with their rank.

    Each of ``salts`` pieces of a group is cut to ``n`` before they meet, so
    the last step sees at most ``salts * n`` rows of a group.
    """
    out = rank or "_rank"
    piece = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts))
    cut = (
        df.withColumn("_salt", piece)
        .withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)))
        .filter(F.col("_r") <= n).drop("_r", "_salt")
    )
    top = cut.withColumn(
        out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ).filter(F.col(out) <= n)
    return top if rank else top.drop(out)
