"""Exact nearest point per vertex, along a space-filling curve.

Points and vertices are dealt together by their place on a Morton curve through
their cloud, so most vertices find their nearest point in their own partition,
by a tree of boxes over the points' order on the curve. A vertex whose best
distance reaches into the box of another partition's points is sent there as
well. No step joins by the cloud alone: the only table of the driver holds the
boxes of clouds that lie in several partitions, two for each partition at most.

Vertices and points with a null coordinate take no part; vertices of clouds
without points drop out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ..session import durable
from .scale import HOT_ROWS, Shape, attach

AXES = ("x", "y", "z")
KEY = ["cloud_id"]
#: Bits of the curve for each axis.
BITS = 21
LEAF, FAN = 16, 8
#: Points, and vertices, of a cloud that one group may hold.
WHOLE = 500_000
#: Vertices that are answered at once, and sent vertices that share one copy of a partition's points.
BLOCK, SENT = 2_048, 200_000


#: Fixed masks of the usual doubling steps.
_STEPS = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def _spread(v: Column) -> Column:
    """The bits of a number with two zeros between each."""
    for shift, mask in _STEPS:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return v


def _curve() -> Column:
    """Place on the Morton curve through the cube of the cloud's points; places outside count as the cube's nearest."""
    side = float(1 << BITS)
    at = [F.greatest(F.least(F.floor((F.col(a) - F.col(f"_o{a}")) / F.col("_ext") * side), F.lit((1 << BITS) - 1)), F.lit(0)).cast("bigint") for a in AXES]
    x, y, z = (_spread(v) for v in at)
    return x.bitwiseOR(F.shiftleft(y, 1)).bitwiseOR(F.shiftleft(z, 2))


def _codes(places: np.ndarray, low: np.ndarray, extent: float) -> np.ndarray:
    """``_curve`` of places, in a cube from ``low`` of the given extent."""
    cells = np.clip(np.floor((places - low) / extent * float(1 << BITS)), 0, (1 << BITS) - 1).astype(np.int64)
    for shift, mask in _STEPS:
        cells = (cells | cells << shift) & mask
    return cells[:, 0] | cells[:, 1] << 1 | cells[:, 2] << 2


class Boxes:
    """A tree of boxes over boxes in a given order."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.levels = [(low, high)]
        while len(self.levels[-1][0]) > FAN:
            low, high = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def reached(self, places: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place, box) with a squared distance of at most the place's best."""
        v = np.repeat(np.arange(len(places)), len(self.levels[-1][0]))
        box = np.tile(np.arange(len(self.levels[-1][0])), len(places))
        for depth in range(len(self.levels) - 1, -1, -1):
            low, high = self.levels[depth]
            near = gap(places[v], low[box], high[box]) <= best[v]
            v, box = v[near], box[near]
            if depth:
                below = box[:, None] * FAN + np.arange(FAN)
                inside = below < len(self.levels[depth - 1][0])
                v, box = np.repeat(v, FAN)[inside.ravel()], below[inside]
        return v, box


def gap(places: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance from places to the closest of their boxes' points."""
    d = np.maximum(np.maximum(low - places, places - high), 0.0)
    return d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]


class Points:
    """Points in the order of the curve, in leaves of some each."""

    def __init__(self, code: np.ndarray, idx: np.ndarray, places: np.ndarray):
        self.rows = np.argsort(code, kind="stable")
        self.code, self.idx, self.places = code[self.rows], idx[self.rows], places[self.rows]
        self.starts = np.arange(0, len(code), LEAF)
        self.boxes = Boxes(np.minimum.reduceat(self.places, self.starts), np.maximum.reduceat(self.places, self.starts))

    def _compare(self, v: np.ndarray, leaf: np.ndarray, places: np.ndarray, best: np.ndarray, which: np.ndarray) -> None:
        """Take the closest points of the leaves into ``best`` and ``which``; of equal ones that of the lowest idx."""
        at = self.starts[leaf][:, None] + np.arange(LEAF)
        inside = at < len(self.idx)
        at = np.where(inside, at, 0)
        d = places[v][:, None, :] - self.places[at]
        d2 = np.where(inside, d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2], np.inf)
        least = d2.min(1)
        first = np.where(d2 == least[:, None], self.idx[at], np.iinfo(np.int64).max)
        row = at[np.arange(len(v)), first.argmin(1)]
        order = np.lexsort((self.idx[row], least, v))
        v, least, row = v[order], least[order], row[order]
        keep = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.empty(0, bool)
        v, least, row = v[keep], least[keep], row[keep]
        known = which[v]
        better = (least < best[v]) | ((least == best[v]) & ((known < 0) | (self.idx[row] < self.idx[known])))
        best[v[better]], which[v[better]] = least[better], row[better]

    def nearest(self, code: np.ndarray, places: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distance and row of the nearest point of each place; row -1 where none is within ``best``."""
        best, which = best.copy(), np.full(len(code), -1)
        for i in range(0, len(code), BLOCK):
            part = slice(i, i + BLOCK)
            here, near, found = places[part], best[part], which[part]
            home = np.minimum(np.searchsorted(self.code, code[part]), len(self.code) - 1) // LEAF
            self._compare(np.arange(len(here)), home, here, near, found)
            self._compare(*self.boxes.reached(here, near), here, near, found)
        return best, np.where(which < 0, -1, self.rows[which])


@dataclass
class Pieces:
    """Boxes of the points of clouds that lie in several partitions."""

    clouds: dict[object, tuple[np.ndarray, Boxes]]

    @classmethod
    def of(cls, rows: list) -> Pieces:
        grouped: dict[object, list] = {}
        for r in rows:
            grouped.setdefault(r["cloud_id"], []).append(r)
        made = {}
        for cloud, own in grouped.items():
            own.sort(key=lambda r: r["_part"])
            bounds = np.array([[[r[f"_lo{a}"] for a in AXES], [r[f"_hi{a}"] for a in AXES]] for r in own])
            made[cloud] = np.array([r["_part"] for r in own]), Boxes(bounds[:, 0], bounds[:, 1])
        return cls(made)


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """The runs of rows with equal leading columns, batch by batch."""
    now, parts = None, []
    for batch in batches:
        values = list(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True))
        cuts = [0, *(i for i in range(1, len(values)) if values[i] != values[i - 1]), len(values)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            if values[i] != now and parts:
                yield now, parts
                parts = []
            now = values[i]
            parts.append(batch.slice(i, j - i))
    if parts:
        yield now, parts


def _numbers(batch: pa.RecordBatch | pa.Table, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(n).to_numpy() for n in names]


def _answers(batches: Iterator[pa.RecordBatch], schema: StructType, attributes: Sequence[str], pieces: Pieces | None, sent: bool) -> Iterator[pa.RecordBatch]:
    """The nearest points of vertices among the points of their partition.

    Rows are sorted by group, points first. With ``pieces``, a row also names
    the other partitions that may hold a closer point.
    """
    names = schema.names
    for key, parts in _grouped(batches, 3 if sent else 2):
        table = pa.Table.from_batches(parts)
        cloud, own = key[-1], key[0]
        is_point = table.column("_kind").to_numpy() == 0
        count = int(is_point.sum())
        points, vertices = table.slice(0, count), table.slice(count)
        if not len(vertices):
            continue
        code, v_idx, x, y, z, best = _numbers(vertices, "_code", "_idx", *AXES, "_best")
        places, row = np.stack([x, y, z], 1), np.full(len(vertices), -1)
        if count:
            p_code, idx, px, py, pz = _numbers(points, "_code", "_idx", *AXES)
            best, row = Points(p_code, idx, np.stack([px, py, pz], 1)).nearest(code, places, best)
        targets = [None] * len(vertices)
        if pieces and cloud in pieces.clouds:
            parts_, boxes = pieces.clouds[cloud]
            low, high = boxes.levels[0]
            # No box is empty: its farthest corner bounds the nearest distance where the partition has no point.
            if not count:
                for lo, hi in zip(low, high, strict=True):
                    far = np.maximum(np.abs(places - lo), np.abs(hi - places))
                    best = np.minimum(best, (far * far).sum(1) * (1 + 1e-12))
            for i in range(0, len(places), BLOCK):
                v, box = boxes.reached(places[i:i + BLOCK], best[i:i + BLOCK])
                other = parts_[box] != own
                for a, b in zip((v[other] + i).tolist(), parts_[box[other]].tolist(), strict=True):
                    targets[a] = [*(targets[a] or ()), b]
        taken = points.select(["_idx", *attributes]).take(pa.array(np.where(row < 0, None, row), pa.int64()))
        columns = [vertices.column(c) for c in ("cloud_id", "_idx", "_code", *AXES)]
        columns += [pa.chunked_array([pa.array(best)]), *taken.columns, pa.chunked_array([pa.array(targets, pa.list_(pa.int32()))])]
        out = pa.Table.from_arrays(columns, names=names)
        yield from out.combine_chunks().to_batches(max_chunksize=65_536)


def _within(points: pa.Table, vertices: pa.Table, schema: pa.Schema, attributes: Sequence[str]) -> pa.Table:
    """The nearest points of a cloud's vertices."""
    if not len(points) or not len(vertices):
        return schema.empty_table()
    places, wanted = (np.stack(_numbers(t, *AXES), 1) for t in (points, vertices))
    idx, = _numbers(points, "idx")
    # Of points in one place that of the lowest idx.
    order = np.lexsort((idx, *places.T))
    sorted_ = places[order]
    first = order[np.concatenate([[True], (sorted_[1:] != sorted_[:-1]).any(1)])]
    low = places.min(0)
    cube = low, max((places.max(0) - low).max(), 1e-9)
    best, row = Points(_codes(places[first], *cube), idx[first], places[first]).nearest(_codes(wanted, *cube), wanted, np.full(len(wanted), np.inf))
    found = row >= 0
    taken, kept = points.take(pa.array(first[row[found]])), vertices.filter(pa.array(found))
    columns = [kept["cloud_id"], kept["v_idx"], pa.array(np.sqrt(best[found])), *[taken[n] for n in ("idx", *attributes)]]
    return pa.Table.from_arrays([pa.chunked_array([x]) if isinstance(x, pa.Array) else x for x in columns], names=schema.names).cast(schema)


def _by_cloud(vertices: DataFrame, points: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """The nearest points in clouds that are small enough for one group each."""
    place, whole = [F.col(a).cast("double").alias(a) for a in AXES], " AND ".join(f"{n} IS NOT NULL" for n in (*KEY, *AXES))
    held = points.select(*KEY, F.col("idx").cast("bigint").alias("idx"), *place, *attributes).filter(whole)
    asked = vertices.select(*KEY, F.col("v_idx").cast("bigint").alias("v_idx"), *place).filter(whole)
    schema = StructType([held.schema[KEY[0]], asked.schema["v_idx"], StructField("distance", DoubleType()), *[held.schema[n] for n in ("idx", *attributes)]])
    arrow = to_arrow_schema(schema)
    return held.groupBy(*KEY).cogroup(asked.groupBy(*KEY)).applyInArrow(lambda p, v: _within(p, v, arrow, attributes), schema)


def nearest_attribute(vertices: DataFrame, points: DataFrame, attributes: Sequence[str], hot_rows: int = HOT_ROWS, shape: Shape | None = None) -> DataFrame:
    """Distance, index and attributes of the nearest point (lowest idx on ties) for every vertex.

    ``shape`` is that of the clouds' points and that of their vertices, if
    measured: clouds of at most ``WHOLE`` rows meet their vertices whole, with
    no shuffle where both tables already lie by cloud.
    """
    if shape is not None and shape.largest <= min(WHOLE, hot_rows):
        return _by_cloud(vertices, points, attributes)
    c, place = F.col, [F.col(a).cast("double").alias(a) for a in AXES]
    whole = c("x").isNotNull() & c("y").isNotNull() & c("z").isNotNull()
    first = points.filter(whole).groupBy(*KEY, *place).agg(F.min(F.struct("idx", *attributes)).alias("_p"))
    kinds = {f.name: f.dataType for f in points.schema.fields}
    # It is read for the cubes, for the bounds of the ranges and to be dealt.
    both = durable(first.select(*KEY, F.lit(0).alias("_kind"), c("_p.idx").cast("bigint").alias("_idx"), *AXES, *[c(f"_p.`{a}`").alias(a) for a in attributes]).union(
        vertices.filter(whole).select(*KEY, F.lit(1), c("v_idx").cast("bigint"), *place, *[F.lit(None).cast(kinds[a]) for a in attributes])))

    def of_points(x: Column) -> Column:
        return F.when(c("_kind") == 0, x)

    cubes = durable(both.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("_n"), *[F.min(of_points(c(a))).alias(f"_o{a}") for a in AXES],
        F.greatest(*[F.max(of_points(c(a))) - F.min(of_points(c(a))) for a in AXES], F.lit(1e-9)).alias("_ext")).filter(c("_ox").isNotNull()))
    shape = Shape(*(n or 0 for n in cubes.agg(F.count(F.lit(1)), F.max("_n")).first()))
    coded = attach(both, cubes, KEY, c("_n"), hot_rows, shape).filter(c("_n").isNotNull()).select(
        *KEY, "_kind", _curve().alias("_code"), "_idx", *AXES, *attributes, F.lit(float("inf")).alias("_best"))
    dealt = durable(coded.repartitionByRange(*KEY, "_code", "_kind", "_idx").select(F.spark_partition_id().alias("_part"), "*"))

    held = dealt.groupBy(*KEY, "_part").agg(
        F.count_if(c("_kind") == 0).alias("_points"), *[f(of_points(c(a))).alias(f"_{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))])
    # A partition's range can share a cloud with its neighbours only at its two ends.
    several = held.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_parts")).filter(c("_parts") > 1).select(*KEY)
    pieces = Pieces.of(held.join(several, KEY).filter(c("_points") > 0).collect())

    schema = StructType([
        *[dealt.schema[k] for k in KEY], StructField("_idx", LongType()), StructField("_code", LongType()), *[StructField(a, DoubleType()) for a in AXES],
        StructField("_best", DoubleType()), StructField("idx", LongType()), *[StructField(a, kinds[a]) for a in attributes],
        StructField("_others", ArrayType(IntegerType()))])
    columns = ["_kind", "_code", "_idx", *AXES, *attributes, "_best"]
    at_home = durable(dealt.select("_part", *KEY, *columns).sortWithinPartitions("_part", *KEY, "_kind").mapInArrow(
        lambda batches: _answers(batches, schema, attributes, pieces, False), schema))

    result = at_home.drop("_others", "_code", *AXES)
    routed = at_home.filter(c("_others").isNotNull()).select(F.explode("_others").alias("_part"), "*")
    counts = routed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).collect()
    if counts:
        # Copies of a partition's points for every SENT vertices that come to it; there are as many counts as partitions.
        shares = dealt.sparkSession.createDataFrame([(r["_part"], -(-r["_n"] // SENT)) for r in counts], "_part int, _copies int")
        sent = routed.join(F.broadcast(shares), "_part").select(
            "_part", F.pmod(F.xxhash64("_idx"), "_copies").cast("int").alias("_copy"), *KEY, F.lit(1).alias("_kind"), "_code", "_idx", *AXES,
            *[F.lit(None).cast(kinds[a]).alias(a) for a in attributes], "_best")
        met = dealt.filter(c("_kind") == 0).join(F.broadcast(shares), "_part").select(
            "_part", F.explode(F.sequence(F.lit(0), c("_copies") - 1)).alias("_copy"), *KEY, *columns)
        again = met.union(sent).repartition("_part", "_copy").sortWithinPartitions("_part", "_copy", *KEY, "_kind").mapInArrow(
            lambda batches: _answers(batches, schema, attributes, None, True), schema)
        # Only vertices that were sent have several answers.
        left = ["_others", "_code", *AXES]
        answers = at_home.filter(c("_others").isNotNull()).union(again).filter(c("idx").isNotNull()).drop(*left)
        met_again = answers.groupBy(*KEY, "_idx").agg(F.min(F.struct("_best", "idx", *attributes)).alias("_h")).select(*KEY, "_idx", "_h.*")
        result = at_home.filter(c("_others").isNull()).drop(*left).select(*met_again.columns).union(met_again)
    return result.select(*KEY, c("_idx").alias("v_idx"), F.sqrt("_best").alias("distance"), "idx", *attributes)
