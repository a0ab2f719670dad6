"""Hard negatives of labelled vectors, by length buckets with sorted coordinate lists.

Vectors are put into buckets of similar length, longest first (``buckets``);
a bucket also holds, for each coordinate, the order of its vectors by that
coordinate of their direction. A search for inner products of at least some
bound skips buckets whose longest vector is too short. In the others, the
bound limits the angle between a hit and the anchor, and so the range of the
hit's coordinates: on the anchor's few largest coordinates (focus), the sorted
lists give the vectors inside the range, and only those inside every range are
verified exactly. Bounds rise while a block of anchors meets its buckets.

Anchors are a given set of queries (ids divisible by ``anchor_every``), in
blocks; positives are searched among the rows of one label, negatives among
all. A block meets the buckets slice by slice, and no task holds more than one
block and one bucket.

Rows with a null label, a null vector, or a null or non-finite component take
no part, nor do rows without an id, which could not be named. Exact repeats of
a row count once; rows of one id that differ are rows of their own. Equal
scores are ranked by id. Vectors of unequal size are compared as if the
shorter one ended in zeros. Scores are exact as long as they fit 64 bits.
Other columns are never read, so clashing names are harmless; an empty table
gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

#: Every row whose id is divisible by this is an anchor.
ANCHOR_EVERY = 50
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is at least LOW and at most HIGH percent of its positive's.
LOW, HIGH = 50, 95
#: Components are whole numbers: floor(SCALE * x).
SCALE = 256
#: Vectors of a bucket, anchors of a block, buckets that one task takes for a block, focus coordinates.
BUCKET, BLOCK, SLICE, FOCUS = 4_096, 4_096, 64, 4
#: Buckets that a task of a block takes at least, and anchors of a block whose crowded candidates are scored together.
LEAST_SLICE, TOGETHER = 4, 128
#: Candidates are crowded if they are more than one in so many of their bucket's vectors.
CROWDED = 4
#: Angles are widened by this, so that no rounding loses a hit.
SLACK = 1e-6
#: Products below this are exact in doubles.
_EXACT = float(1 << 52)

_BUCKET = ("grp bigint, bucket bigint, dim int, rows array<bigint>, ids array<bigint>, labels array<bigint>, vectors array<double>, "
           "lists array<int>")
_HELD = ["dim", "rows", "ids", "labels", "vectors", "lists"]
_JOBS = "array<struct<place:bigint,tag:bigint,least:bigint,most:bigint>>"


def prepared(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """Rows (row, id, label, vector, length) that take part, each once under a number of its own; components are whole numbers."""
    x = F.col(f"`{vector}`")

    def usable(v):
        v = v.cast("double")
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))

    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{label}`").cast("bigint").alias("label"), x.alias("raw"))
    most = float(np.finfo(np.float64).max)

    def whole(v):
        y = F.greatest(F.lit(-most), F.least(F.lit(most), F.lit(float(scale)) * v.cast("double")))
        # Doubles of 2**53 and more are whole numbers.
        return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)

    fit = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("raw").isNotNull() & F.forall("raw", usable))
    return durable(fit.select("id", "label", F.transform("raw", whole).alias("vector")).distinct().select(
        F.monotonically_increasing_id().alias("row"), "*", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)).alias("length")))


def _matrix(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of several sizes as a matrix, filled up with zeros."""
    dim = int(sizes.max()) if len(sizes) else 0
    if len(flat) == dim * len(sizes):
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zero stays zero) and lengths."""
    largest = np.abs(vectors).max(1, initial=0)
    scaled = vectors / np.where(largest > 0, largest, 1)[:, None]
    length = np.sqrt((scaled * scaled).sum(1))
    return scaled / np.where(length > 0, length, 1)[:, None], length * largest


def _built(batches: Iterator[pa.RecordBatch], size: int, listed: bool) -> Iterator[pa.RecordBatch]:
    """Bucket rows from rows (grp, part, row, id, label, vector) sorted by group and falling length."""

    def bucket(rows: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        grp, part, numbers, ids, labels, vectors = (table.column(i).combine_chunks() for i in range(6))
        matrix = _matrix(vectors.flatten().to_numpy(zero_copy_only=False), vectors.value_lengths().to_numpy(zero_copy_only=False))
        lists = np.argsort(directions(matrix)[0], axis=0, kind="stable").T.astype(np.int32) if listed else np.empty(0, np.int32)

        def one(values: np.ndarray, kind: pa.DataType) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, values.size], pa.int32()), pa.array(values.ravel(), kind))

        return pa.RecordBatch.from_arrays([
            grp.slice(0, 1), pa.array([part[0].as_py() << 32 | number], pa.int64()), pa.array([matrix.shape[1]], pa.int32()),
            one(numbers.to_numpy(), pa.int64()), one(ids.to_numpy(), pa.int64()), one(labels.to_numpy(), pa.int64()), one(matrix, pa.float64()), one(lists, pa.int32())],
            names=["grp", "bucket", *_HELD])

    held: list[pa.RecordBatch] = []
    rows, now, number = 0, None, 0
    for batch in batches:
        grp = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(grp[1:] != grp[:-1]) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            while i < j:
                if held and (grp[i] != now or rows == size):
                    yield bucket(held, number)
                    held, rows, number = [], 0, number + 1
                now, take = grp[i], min(j - i, size - rows)
                held.append(batch.slice(i, take))
                rows, i = rows + take, i + take
    if held:
        yield bucket(held, number)


def buckets(rows: DataFrame, size: int, listed: bool = True) -> DataFrame:
    """Rows (grp, row, id, label, vector, length) as buckets of at most ``size`` vectors of one group and similar length."""
    dealt = rows.repartitionByRange("grp", F.desc("length"), "id").sortWithinPartitions("grp", F.desc("length"), "id").select(
        "grp", F.spark_partition_id().cast("bigint").alias("part"), "row", "id", "label", "vector")
    return durable(dealt.mapInArrow(lambda batches: _built(batches, size, listed), _BUCKET))


class Bucket:
    """The vectors of a bucket, their lengths, and its sorted coordinate lists."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, lists: np.ndarray | None):
        self.rows, self.ids, self.labels, self.vectors, self.lists = rows, ids, labels, vectors, lists
        self.directions, self.lengths = directions(vectors)
        self.longest = float(self.lengths.max(initial=0))
        self.sorted: dict[int, np.ndarray] = {}
        self.columns: dict[int, np.ndarray] = {}
        self.compared = 0

    def candidates(self, direction: np.ndarray, length: float, least: float, focus: int = FOCUS) -> np.ndarray | None:
        """Places of the vectors that may have an inner product of at least ``least`` with the anchor; None for all."""
        if not least > 0:
            return None
        reach = length * self.longest
        if reach * (1 + 1e-12) < least:
            return np.empty(0, np.int64)
        angle = math.acos(min(1.0, least / reach)) + SLACK
        chosen = np.argsort(-np.abs(direction))[:focus]
        ranges = []
        for f in chosen.tolist():
            own = math.acos(min(1.0, max(-1.0, direction[f])))
            low, high = math.cos(min(math.pi, own + angle)), math.cos(max(0.0, own - angle))
            if f not in self.sorted:
                self.sorted[f] = self.directions[self.lists[f], f]
            ranges.append((f, np.searchsorted(self.sorted[f], low - SLACK), np.searchsorted(self.sorted[f], high + SLACK, "right"), low - SLACK, high + SLACK))
        f, i, j, *_ = min(ranges, key=lambda r: r[2] - r[1])
        if CROWDED * (j - i) > len(self.ids):
            # Long ranges are intersected along the vectors, not through their lists.
            inside = np.ones(len(self.ids), bool)
            for f, _, _, low, high in ranges:
                if f not in self.columns:
                    self.columns[f] = self.directions[:, f].copy()
                inside &= self.columns[f] >= low
                inside &= self.columns[f] <= high
            return np.flatnonzero(inside)
        found = self.lists[f][i:j]
        for other, _, _, low, high in ranges:
            if other != f and len(found):
                x = self.directions[found, other]
                found = found[(x >= low) & (x <= high)]
        return found

    def scores(self, anchor: np.ndarray, length: float, places: np.ndarray | None) -> np.ndarray:
        """Exact inner products with the anchor."""
        vectors = self.vectors if places is None else self.vectors[places]
        self.compared += len(vectors)
        dim = min(len(anchor), vectors.shape[1])
        if length * self.longest < _EXACT:
            return (vectors[:, :dim] @ anchor[:dim]).astype(np.int64)
        whole = [sum(int(a) * int(b) for a, b in zip(row, anchor[:dim].tolist(), strict=True)) for row in vectors[:, :dim].tolist()]
        return np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in whole], np.int64)


    def all_scores(self, anchors: np.ndarray, lengths: np.ndarray, found: list[np.ndarray]) -> list[np.ndarray]:
        """Exact inner products of each anchor with its candidates; those of anchors with crowded ones come from one matrix product."""
        crowded = [n for n, places in enumerate(found) if CROWDED * len(places) > len(self.ids) and lengths[n] * self.longest < _EXACT]
        dim = min(anchors.shape[1], self.vectors.shape[1])
        products = dict(zip(crowded, anchors[crowded, :dim] @ self.vectors[:, :dim].T, strict=True))
        self.compared += sum(len(found[n]) for n in crowded)
        return [products[n][places].astype(np.int64) if n in products else self.scores(anchors[n], float(lengths[n]), places)
                for n, places in enumerate(found)]


class Best:
    """The first ``k`` hits of one search, and the score that a further one needs."""

    def __init__(self, k: int, least: int | None = None, most: int | None = None):
        self.k, self.least, self.most = k, least, most
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fit = np.ones(len(scores), bool)
        if self.least is not None:
            fit &= scores >= self.least
        if self.most is not None:
            fit &= scores <= self.most
        if not fit.any():
            return
        scores, ids = scores[fit], ids[fit]
        if len(scores) > self.k:
            # Ties of the k-th score stay until their ids decide.
            near = scores >= np.partition(scores, -self.k)[-self.k]
            scores, ids = scores[near], ids[near]
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        first = np.lexsort((ids, -scores))[:self.k]
        self.scores, self.ids = scores[first], ids[first]
        if len(first) == self.k:
            self.least = int(self.scores[-1]) if self.least is None else max(self.least, int(self.scores[-1]))


def _parsed(row: pa.RecordBatch, listed: bool) -> tuple:
    dim = row.column("dim")[0].as_py()
    numbers, ids, labels, vectors = (row.column(c)[0].values.to_numpy(zero_copy_only=False) for c in ("rows", "ids", "labels", "vectors"))
    lists = row.column("lists")[0].values.to_numpy(zero_copy_only=False).reshape(dim, len(ids)) if listed else None
    return numbers, ids, labels, vectors.reshape(len(ids), dim), lists


class Block:
    """A block of anchors, and its searches by anchor."""

    def __init__(self, row: pa.RecordBatch, k: int):
        self.same = row.column("same")[0].as_py()
        self.rows, self.ids, self.labels, self.vectors, _ = _parsed(row, False)
        self.directions, self.lengths = directions(self.vectors)
        jobs = row.column("jobs")[0]
        if jobs.is_valid:
            places, tags, least, most = (jobs.values.field(i) for i in range(4))
            self.places, self.tags = (x.to_numpy(zero_copy_only=False) for x in (places, tags))
            self.best = [Best(k, a, b) for a, b in zip(least.to_pylist(), most.to_pylist(), strict=True)]
        else:
            self.places, self.tags, self.best = np.arange(len(self.ids)), np.zeros(len(self.ids), np.int64), [Best(k) for _ in self.ids]
        order = np.argsort(self.places, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(self.places[order])) + 1)
        self.by_anchor = [(int(self.places[g[0]]), [self.best[j] for j in g.tolist()]) for g in parts if len(g)]

    def meet(self, bucket: Bucket, focus: int) -> None:
        for first in range(0, len(self.by_anchor), TOGETHER):
            group = self.by_anchor[first:first + TOGETHER]
            anchors = [place for place, _ in group]
            bounds = [None if any(b.least is None for b in best) else min(b.least for b in best) for _, best in group]
            found = [self._candidates(bucket, place, least, focus) for place, least in zip(anchors, bounds, strict=True)]
            scored = bucket.all_scores(self.vectors[anchors], self.lengths[anchors], found)
            for (place, best), least, places, scores in zip(group, bounds, found, scored, strict=True):
                if least is not None:
                    enough = np.flatnonzero(scores >= least)
                    places, scores = places[enough], scores[enough]
                wanted = (bucket.labels[places] == self.labels[place]) == self.same
                wanted &= bucket.rows[places] != self.rows[place]
                if wanted.any():
                    scores, ids = scores[wanted], bucket.ids[places[wanted]]
                    for b in best:
                        b.add(scores, ids)

    def _candidates(self, bucket: Bucket, place: int, least: int | None, focus: int) -> np.ndarray:
        found = bucket.candidates(self.directions[place], float(self.lengths[place]), least or 0, focus)
        return np.arange(len(bucket.ids)) if found is None else found

    def hits(self) -> pa.RecordBatch:
        many = [len(b.ids) for b in self.best]

        def joined(values: list[np.ndarray]) -> pa.Array:
            return pa.array(np.concatenate([np.empty(0, np.int64), *values]), pa.int64())

        return pa.RecordBatch.from_arrays([
            pa.array(np.repeat(self.rows[self.places], many), pa.int64()), pa.array(np.repeat(self.ids[self.places], many), pa.int64()),
            pa.array(np.repeat(self.tags, many), pa.int64()), joined([b.ids for b in self.best]), joined([b.scores for b in self.best])],
            names=["row", "anchor", "tag", "id", "score"])


def _searched(batches: Iterator[pa.RecordBatch], k: int, focus: int) -> Iterator[pa.RecordBatch]:
    """The first hits (row, anchor, tag, id, score) of each block over each slice.

    Rows are sorted by block, slice and bucket, the block's own row first.
    """
    block = None
    for batch in batches:
        for n in range(batch.num_rows):
            row = batch.slice(n, 1)
            if row.column("bucket")[0].as_py() is None:
                if block:
                    yield block.hits()
                block = Block(row, k)
            else:
                block.meet(Bucket(*_parsed(row, True)), focus)
    if block:
        yield block.hits()


def search(blocks: DataFrame, index: DataFrame, k: int, same: bool, slice_: int = SLICE, focus: int = FOCUS) -> DataFrame:
    """The first ``k`` hits (row, anchor, tag, rank, id, score) of each block's searches among the buckets of its group.

    ``same`` asks for rows of the anchor's label, else for those of others. A
    null in ``jobs`` is one search for each anchor, without bounds. A task
    takes at most ``slice_`` buckets, and fewer where the session's tasks would
    else wait.
    """
    numbered = index.select("grp", "bucket").withColumn("_n", F.row_number().over(Window.partitionBy("grp").orderBy("bucket")) - 1)
    pairs = durable(blocks.select("grp", F.col("bucket").alias("block")).join(numbered, "grp"))
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    taken = min(slice_, max(LEAST_SLICE, -(-pairs.count() // tasks)))
    meets = pairs.select("block", "bucket", F.floor(F.col("_n") / taken).alias("slice"))
    heads = blocks.drop("grp").withColumnRenamed("bucket", "block").join(meets.select("block", "slice").distinct(), "block").select(
        "block", "slice", F.lit(None).cast("bigint").alias("bucket"), *_HELD, "jobs", F.lit(same).alias("same"))
    bodies = index.join(meets.select("block", "slice", "bucket"), "bucket").select(
        "block", "slice", "bucket", *_HELD, F.lit(None).cast(_JOBS).alias("jobs"), F.lit(same).alias("same"))
    dealt = heads.union(bodies).repartition("block", "slice").sortWithinPartitions("block", "slice", F.col("bucket").asc_nulls_first())
    hits = dealt.mapInArrow(lambda batches: _searched(batches, k, focus), "row bigint, anchor bigint, tag bigint, id bigint, score bigint")
    first = Window.partitionBy("row", "tag").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, anchor_every: int = ANCHOR_EVERY,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, bucket: int = BUCKET, block: int = BLOCK,
    slice_: int = SLICE, focus: int = FOCUS,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A positive is one of the first ``positives`` other rows of the anchor's
    label; its negatives are the first rows of other labels that score between
    ``low`` and ``high`` percent of it.
    """
    rows = prepared(df, key, vector, label, scale)
    anchors = rows.filter(F.col("id") % anchor_every == 0)
    by_label, all_ = F.col("label").alias("grp"), F.lit(0).cast("bigint").alias("grp")

    blocks = buckets(anchors.select(by_label, "*"), block, listed=False).withColumn("jobs", F.lit(None).cast(_JOBS))
    found = durable(search(blocks, buckets(rows.select(by_label, "*"), bucket), positives, True, slice_, focus).select(
        "row", F.col("anchor").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    # One search for each score: equal positives have the same negatives, and below zero no score is between the bounds.
    def percent(share: int, more: int):
        return F.expr(f"CAST((CAST(positive_score AS DECIMAL(20, 0)) * {share} + {more}) div 100 AS BIGINT)")

    bounded = found.filter("positive_score >= 0").select(
        "row", F.col("positive_score").alias("tag"), percent(low, 99).alias("least"), percent(high, 0).alias("most")).distinct()
    blocks = buckets(anchors.select(all_, "*"), block, listed=False)
    jobs = blocks.select("bucket", F.posexplode("rows").alias("place", "row")).join(bounded, "row").groupBy("bucket").agg(
        F.collect_list(F.struct(F.col("place").cast("bigint").alias("place"), "tag", "least", "most")).alias("jobs"))
    hard = search(blocks.join(jobs, "bucket"), buckets(rows.select(all_, "*"), bucket), negatives, False, slice_, focus)
    return found.join(
        hard.select("row", F.col("tag").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")),
        ["row", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
