"""Hash similarity: exact radius joins, nearest distances, greedy de-duplication.

Equal hashes are merged before anything is compared, so a group of copies
costs one row. Radius joins meet through hash bands (any two hashes within the
radius agree on some combination of bands); crowded buckets and large radii
are compared tile against tile, each tile of bounded size.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions.geometry import hamming
from ..session import durable
from .scale import HOT_ROWS, Shape, attach, measure, running_total

TILE_ROWS = 32_768
BUCKET_ROWS = 4_096
#: Tiles of a group up to which comparing them costs less than wider bands, and tasks that pairs of tiles are dealt to at most.
FEW_TILES, MOST_TASKS = 7, 20_000
#: Hashes of so many bits are short: a group of them is bounded.
SHORT_BITS = 24
LOCAL_EDGES = 1_000_000
#: Two shared bands are the key up to this radius, three up to the wide one; beyond it groups go through tiles.
BAND_RADIUS, WIDE_RADIUS = 3, 10
#: Radii in which hashes without a near neighbour are searched for in turn.
GROWING = (6, 10)
#: Distances that are computed at once.
_CHUNK = 524_288
#: Images of a tile with their pixels, and pairs whose pixels are compared at once.
JUDGED_ROWS, _JUDGED = 8_192, 16_384


def distinct_hashes(df: DataFrame, keys: Sequence[str], hash_col: str) -> DataFrame:
    """One row per group and hash value, with the number of rows that share it."""
    return df.filter(F.col(hash_col).isNotNull()).groupBy(*keys, F.col(hash_col).alias("hash")).agg(
        F.count(F.lit(1)).alias("copies"))


def _tiles(nodes: DataFrame, keys: Sequence[str], tile_rows: int) -> tuple[DataFrame, bool]:
    """Hashes of every group in arrays of about ``tile_rows``; whether groups need several."""
    keys = list(keys)
    shape = measure(nodes, keys)
    if shape.largest <= tile_rows:
        one = nodes.groupBy(*keys).agg(F.collect_list("hash").alias("hs"))
        return one.select(*keys, F.lit(1).cast("bigint").alias("_tiles"), F.lit(0).cast("bigint").alias("_tile"), "hs"), False
    sizes = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_tiles", F.ceil(F.col("_n") / tile_rows))
    placed = attach(nodes.select(*keys, "hash"), sizes, keys, F.col("_n"), shape=shape).withColumn(
        "_tile", F.pmod(F.xxhash64("hash"), F.col("_tiles")))
    return placed.groupBy(*keys, "_tiles", "_tile").agg(F.collect_list("hash").alias("hs")), True


def _tile_pairs(nodes: DataFrame, keys: Sequence[str], tile_rows: int) -> DataFrame:
    """(hs, others, same) per unordered pair of tiles of a group."""
    tiles, several = _tiles(nodes, keys, tile_rows)
    keys = list(keys)
    if not several:
        return _spread(tiles.select(*keys, "hs", F.col("hs").alias("others"), F.lit(True).alias("same")), tiles)
    left = tiles.select(*keys, "_tile", "hs", F.explode(F.sequence("_tile", F.col("_tiles") - 1)).alias("_other"))
    right = tiles.select(*keys, F.col("_tile").alias("_other"), F.col("hs").alias("others"))
    return _spread(left.join(right, [*keys, "_other"]).select(
        *keys, "hs", "others", (F.col("_tile") == F.col("_other")).alias("same")), left.select("_other"))


def _spread(met: DataFrame, counted: DataFrame) -> DataFrame:
    """Rows that each take long, dealt to tasks of their own; ``counted`` has as many rows and is cheaper to count."""
    return met.repartition(max(1, min(counted.count(), MOST_TASKS)))


def _distances(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Distances of all pairs, for some of ``a`` at a time."""
    rows = max(1, _CHUNK // max(1, len(b)))
    for at in range(0, len(a), rows):
        yield slice(at, at + rows), np.bitwise_count(a[at:at + rows, None] ^ b[None, :])


def nearest_hamming(df: DataFrame, keys: Sequence[str], hash_col: str = "dhash", bits: int = 64,
                    tile_rows: int = TILE_ROWS) -> DataFrame:
    """Distance from every hash to the closest other row of its group.

    One row per distinct hash with its number of copies; copies are at
    distance 0 from each other, a lone hash has NULL. Neighbours within
    ``BAND_RADIUS`` bits come from the radius join, if hashes are long. In
    groups of more than ``FEW_TILES`` tiles, hashes that have none search
    growing radii (``GROWING``), each only as long as it has found nothing. What is left is compared with the
    tiles of its group; where every hash has a neighbour, no tile is formed.
    """
    keys = list(keys)
    nodes = durable(distinct_hashes(df, keys, hash_col))
    def nearest(pairs: DataFrame) -> DataFrame:
        both = pairs.select(*keys, F.col("a").alias("hash"), "distance").union(pairs.select(*keys, F.col("b").alias("hash"), "distance"))
        return both.groupBy(*keys, "hash").agg(F.min("distance").alias("_near"))

    found = nodes.withColumn("_d", F.when(F.col("copies") > 1, 0))
    if _bands_pay(BAND_RADIUS, bits):
        pairs = _band_pairs(nodes.select(*keys, "hash"), keys, BAND_RADIUS, bits, tile_rows)
        found = durable(found.join(nearest(pairs), [*keys, "hash"], "left").withColumn("_d", F.coalesce("_d", "_near")).drop("_near"))
    lone = found.filter(F.col("_d").isNull()).select(*keys, "hash")
    for radius in GROWING:
        if not _bands_pay(radius, bits) or lone.isEmpty() or measure(nodes, keys).largest <= tile_rows * FEW_TILES:
            break
        wider = _band_pairs(nodes.select(*keys, "hash"), keys, radius, bits, tile_rows, probe=lone)
        found = durable(found.join(nearest(wider), [*keys, "hash"], "left").withColumn("_d", F.coalesce("_d", "_near")).drop("_near"))
        lone = found.filter(F.col("_d").isNull()).select(*keys, "hash")
    if lone.isEmpty():
        return found.select(*keys, "hash", "copies", F.col("_d").alias("nearest"))

    @F.pandas_udf("array<int>")
    def closest(hs: pd.Series, others: pd.Series) -> pd.Series:
        out = []
        for mine, theirs in zip(hs, others):
            a = np.asarray(mine, dtype=np.int64).view(np.uint64)
            b = np.asarray(theirs, dtype=np.int64).view(np.uint64)
            best = np.empty(len(a), dtype=np.int32)
            for part, d in _distances(a, b):
                # A hash in its own tile is not its neighbour; any other is at least one bit away.
                d[d == 0] = 255
                best[part] = d.min(axis=1)
            out.append(best)
        return pd.Series(out)

    mine = durable(_tiles(lone, keys, tile_rows)[0].drop("_tiles", "_tile"))
    tiles = durable(_tiles(nodes, keys, tile_rows)[0].select(*keys, "_tile", F.col("hs").alias("others")))
    met = mine.join(tiles.select(*keys, "_tile"), keys).join(tiles, [*keys, "_tile"])
    per_tile = _spread(met, mine.select(*keys).join(tiles.select(*keys), keys)).select(*keys, "hs", closest("hs", "others").alias("ds"))
    far = per_tile.select(*keys, F.explode(F.arrays_zip("hs", "ds")).alias("_p")).groupBy(
        *keys, F.col("_p.hs").alias("hash")).agg(F.min("_p.ds").alias("_f"))
    return found.join(far, [*keys, "hash"], "left").select(
        *keys, "hash", "copies", F.coalesce("_d", F.when(F.col("_f") < 255, F.col("_f"))).alias("nearest"))


def _tile_join(nodes: DataFrame, keys: Sequence[str], radius: int, tile_rows: int) -> DataFrame:
    """All hash pairs within the radius, by comparing tiles."""
    keys = list(keys)
    fields = [f for f in nodes.schema.fields if f.name in keys]
    schema = StructType([*sorted(fields, key=lambda f: keys.index(f.name)), StructField("a", LongType()),
                         StructField("b", LongType()), StructField("distance", IntegerType())])

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                a = np.asarray(row.hs, dtype=np.int64)
                b = np.asarray(row.others, dtype=np.int64)
                for part, d in _distances(a.view(np.uint64), b.view(np.uint64)):
                    i, j = np.nonzero(d <= radius)
                    left, right = a[part][i], b[j]
                    # Inside one tile each pair shows up twice; keep the ordered one.
                    keep = left < right if row.same else left != right
                    if keep.any():
                        left, right, near = left[keep], right[keep], d[i, j][keep]
                        values = {k: getattr(row, k) for k in keys}
                        yield pd.DataFrame({**{k: [v] * len(left) for k, v in values.items()},
                                            "a": np.minimum(left, right), "b": np.maximum(left, right),
                                            "distance": near.astype(np.int32)})

    return _tile_pairs(nodes, keys, tile_rows).mapInPandas(find, schema)


def _band_layout(bits: int, count: int) -> list[tuple[int, int]]:
    """(shift, width) of nearly equal bands."""
    edges = [round(i * bits / count) for i in range(count + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def _band(value: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def hamming_join(df: DataFrame, keys: Sequence[str], hash_col: str, radius: int, bits: int = 64,
                 tile_rows: int = TILE_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pairs of different hashes of a group within ``radius`` bits: (a < b, distance).

    ``radius + k`` bands are cut, so two hashes within the radius share at
    least ``k`` of them (two, or three for wide radii). Each ``k`` bands are a
    bucket key; a pair of hashes is reported only for the first bands it
    shares, so nothing is found twice. Buckets above ``bucket_rows`` go
    through tiles instead of the join, as do radii above ``WIDE_RADIUS`` and
    hashes of at most ``SHORT_BITS`` bits whose buckets are large.
    """
    return _radius_pairs(durable(distinct_hashes(df, keys, hash_col).select(*keys, "hash")), keys, radius, bits,
                         tile_rows, bucket_rows)


def _bands_pay(radius: int, bits: int) -> bool:
    """Whether buckets of shared bands leave a small part of all pairs, by keys and their length.

    Short hashes bound their groups; there the part has to be so small that
    comparing all pairs in tiles, far cheaper for each, would cost more.
    """
    shared = 2 if radius <= BAND_RADIUS else 3
    if radius + shared > bits or radius > WIDE_RADIUS:
        return False
    cheaper = 50 if bits <= SHORT_BITS else 8
    return comb(radius + shared, shared) * cheaper <= 1 << shared * (bits // (radius + shared))


def _radius_pairs(nodes: DataFrame, keys: Sequence[str], radius: int, bits: int, tile_rows: int = TILE_ROWS,
                  bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The radius join over distinct hashes that are already stored."""
    if not _bands_pay(radius, bits):
        return _tile_join(nodes, keys, radius, tile_rows)
    return _band_pairs(nodes, keys, radius, bits, tile_rows, bucket_rows)


def _band_pairs(nodes: DataFrame, keys: Sequence[str], radius: int, bits: int, tile_rows: int = TILE_ROWS,
                bucket_rows: int = BUCKET_ROWS, probe: DataFrame | None = None) -> DataFrame:
    """The radius join by buckets of shared bands.

    With ``probe`` (some of the hashes) their pairs are enough; a pair of two
    of them may then be given in both orders.
    """
    keys = list(keys)
    shared = 2 if radius <= BAND_RADIUS else 3
    layout = _band_layout(bits, radius + shared)

    # A combination is one row of numbers: its bands as a bit set, and a mask of their bits.
    combos = [(sum(1 << i for i in bands), sum(((1 << w) - 1) << s for s, w in (layout[i] for i in bands)))
              for bands in combinations(range(len(layout)), shared)]
    listed = F.from_json(F.lit(json.dumps([{"combo": c, "mask": m - (1 << 64) if m >> 63 else m} for c, m in combos])), "array<struct<combo:int,mask:bigint>>")
    placed = nodes.select(*keys, "hash", F.inline(listed)).select(
        *keys, "hash", "combo", F.col("hash").bitwiseAND(F.col("mask")).alias("bucket"))
    cell = [*keys, "combo", "bucket"]

    def first_shared(pairs: DataFrame) -> DataFrame:
        differing = F.col("a").bitwiseXOR(F.col("b"))
        rows = pairs.withColumn("_left", reduce(lambda p, q: p + q, [
            F.when(_band(differing, *band) == 0, 1 << i).otherwise(0) for i, band in enumerate(layout)]))
        # The lowest bits of the set of shared bands, taken one by one, are the combination that reports.
        first = F.lit(0)
        for _ in range(shared):
            rows = rows.withColumn("_low", F.col("_left").bitwiseAND(-F.col("_left")))
            rows = rows.withColumn("_first", first + F.col("_low")).withColumn("_left", F.col("_left") - F.col("_low"))
            first = F.col("_first")
        return rows.filter("_first = combo").select(*keys, "a", "b", "distance")

    def equi(rows: DataFrame) -> DataFrame:
        left = (rows if probe is None else rows.join(probe, [*keys, "hash"], "left_semi")).withColumnRenamed("hash", "a")
        right = rows.withColumnRenamed("hash", "b")
        near = hamming(F.col("a"), F.col("b"))
        once = F.col("a") < F.col("b") if probe is None else F.col("a") != F.col("b")
        return first_shared(left.join(right, cell).filter(once & (near <= radius)).withColumn("distance", near))

    if measure(placed, cell).largest <= bucket_rows:
        return equi(placed)
    crowded = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > bucket_rows).drop("_n")
    rest = placed.join(crowded, cell, "left_anti")
    tiled = _tile_join(placed.join(crowded, cell, "left_semi"), cell, radius, tile_rows)
    return equi(rest).unionByName(first_shared(tiled))


def similar_pairs(df: DataFrame, keys: Sequence[str], hash_col: str, radius: int, id_col: str = "image_id",
                  bits: int = 64) -> DataFrame:
    """Image pairs within the radius, smaller id first: the similarity join itself."""
    keys = list(keys)
    hashes = hamming_join(df, keys, hash_col, radius, bits)
    rows = df.filter(F.col(hash_col).isNotNull()).select(*keys, F.col(hash_col).alias("_h"), F.col(id_col).alias("_id"))
    left = rows.select(*keys, F.col("_h").alias("a"), F.col("_id").alias("_x"))
    right = rows.select(*keys, F.col("_h").alias("b"), F.col("_id").alias("_y"))
    apart = hashes.join(left, [*keys, "a"]).join(right, [*keys, "b"]).select(*keys, "_x", "_y", "distance")
    equal = left.join(right.withColumnRenamed("b", "a"), [*keys, "a"]).filter(F.col("_x") < F.col("_y")).select(
        *keys, "_x", "_y", F.lit(0).alias("distance"))
    return apart.unionByName(equal).select(
        *keys, F.least("_x", "_y").alias("left_id"), F.greatest("_x", "_y").alias("right_id"), "distance")


def judged_pairs(df: DataFrame, keys: Sequence[str], radius: int, tolerance: int, id_col: str = "image_id", pixels: str = "px",
                 near: str = "phash", other: str = "dhash", tile_rows: int = JUDGED_ROWS) -> DataFrame:
    """Image pairs (left_id < right_id) of a group within ``radius`` bits of the ``near`` hash, judged where they are found.

    Each comes with its ``distance``, that of the ``other`` hash and the number of pixels that
    differ by at most ``tolerance``. A group is dealt into tiles and every pair of tiles is a task's row, so
    pairs are neither shuffled nor joined with what judges them. Pixel lists have one length; rows with a null take no part.
    """
    keys, c = list(keys), F.col
    kind = dict(df.dtypes)
    rows = df.select(*keys, c(id_col).cast("bigint").alias("_id"), c(near).cast("bigint").alias("_near"), c(other).cast("bigint").alias("_other"),
                     c(pixels).cast("array<int>").alias("_px")).dropna()
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("_tiles"))
    shape = Shape(*(n or 0 for n in sizes.agg(F.count(F.lit(1)), F.max("_tiles")).first()))
    placed = rows.join(F.broadcast(sizes) if shape.few else sizes, keys).withColumn("_tile", F.pmod(F.xxhash64("_id"), "_tiles").cast("int"))
    tiles = durable(placed.groupBy(*keys, "_tiles", "_tile").agg(F.collect_list(F.struct("_id", "_near", "_other", "_px")).alias("_r")).select(
        *keys, "_tiles", "_tile", *[c(f"_r.{n}").alias(n) for n in ("_id", "_near", "_other")], F.flatten("_r._px").alias("_px")))
    values = ["_id", "_near", "_other", "_px"]
    left = tiles.select(*keys, "_tile", *values, F.explode(F.sequence("_tile", c("_tiles") - 1)).alias("_to"))
    met = left.join(tiles.select(*keys, c("_tile").alias("_to"), *[c(v).alias(f"{v}2") for v in values]), [*keys, "_to"]).select(
        *keys, (c("_tile") == c("_to")).alias("_same"), *values, *[f"{v}2" for v in values])
    schema = ", ".join([*(f"`{k}` {kind[k]}" for k in keys), "left_id bigint", "right_id bigint", "distance int", "other_distance int", "alike int"])
    names = [*keys, "left_id", "right_id", "distance", "other_distance", "alike"]

    def plain(x: pa.Array) -> np.ndarray:
        return x.flatten().to_numpy(zero_copy_only=False)

    def small(x: np.ndarray, kind: type) -> np.ndarray:
        """In the smaller type, if it holds all values, none of them negative."""
        return x.astype(kind) if 0 <= x.min() and x.max() <= np.iinfo(kind).max else x

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                columns = batch.slice(k, 1).columns
                group, same = columns[:len(keys)], columns[len(keys)]
                ids, ha, oa, xa, others, hb, ob, xb = map(plain, columns[len(keys) + 1:])
                hashes = small(np.concatenate([ha, hb]), np.uint16)
                hashes = hashes if hashes.dtype == np.uint16 else hashes.view(np.uint64)
                px = small(np.concatenate([xa, xb]), np.int16).reshape(len(ids) + len(others), -1)
                px = px if px.dtype == np.int16 else px.astype(np.int64)
                oa, ob, inside = oa.view(np.uint64), ob.view(np.uint64), same[0].as_py()
                for part, d in _distances(hashes[:len(ids)], hashes[len(ids):]):
                    i, j = np.nonzero(d <= radius)
                    dist = d[i, j]
                    i += part.start
                    # Inside one tile each pair shows up twice.
                    keep = ids[i] < others[j] if inside else ids[i] != others[j]
                    i, j, dist = i[keep], j[keep], dist[keep]
                    for at in range(0, len(i), _JUDGED):
                        u, v = i[at:at + _JUDGED], j[at:at + _JUDGED]
                        alike = (np.abs(px[u] - px[len(ids) + v]) <= tolerance).sum(1, dtype=np.int32)
                        yield pa.RecordBatch.from_arrays([
                            *(pa.repeat(g[0], len(u)) for g in group), pa.array(np.minimum(ids[u], others[v])), pa.array(np.maximum(ids[u], others[v])),
                            pa.array(dist[at:at + _JUDGED].astype(np.int32)), pa.array(np.bitwise_count(oa[u] ^ ob[v]).astype(np.int32)),
                            pa.array(alike)], names=names)

    found = _spread(met, left.select("_to")).mapInArrow(find, schema)
    return found.select(*keys, *[c(n).cast(kind[id_col]).alias(n) for n in ("left_id", "right_id")], "distance", "other_distance", "alike")


def similar_pair_counts(df: DataFrame, keys: Sequence[str], hash_col: str, radius: int, bits: int = 64) -> DataFrame:
    """Number of similar image pairs per group, from copies per hash, without listing them."""
    keys = list(keys)
    nodes = distinct_hashes(df, keys, hash_col)
    own = nodes.select(*keys, (F.col("copies") * (F.col("copies") - 1) / 2).cast("bigint").alias("_p"))
    a = nodes.select(*keys, F.col("hash").alias("a"), F.col("copies").alias("_na"))
    b = nodes.select(*keys, F.col("hash").alias("b"), F.col("copies").alias("_nb"))
    cross = hamming_join(df, keys, hash_col, radius, bits).join(a, [*keys, "a"]).join(b, [*keys, "b"]).select(
        *keys, (F.col("_na") * F.col("_nb")).alias("_p"))
    images = nodes.groupBy(*keys).agg(F.sum("copies").alias("images"))
    pairs = own.unionByName(cross).groupBy(*keys).agg(F.sum("_p").alias("similar_pairs"))
    return images.join(pairs, keys)


def hybrid_duplicate(dhash_distance: Column, phash_distance: Column, match_ratio: Column, limit: int = 6) -> Column:
    """Both hashes close and features half alike, or one close and features mostly alike."""
    close = (dhash_distance <= limit) & (phash_distance <= max(limit + 2, 8))
    either = (dhash_distance <= limit) | (phash_distance <= limit + 4)
    return (close & (match_ratio >= 0.45)) | (either & (match_ratio >= 0.72))


# -- greedy de-duplication ---------------------------------------------------------------

def _rejected_nodes(edges: DataFrame, keys: Sequence[str], local_edges: int) -> DataFrame | None:
    """Nodes that an earlier kept node excludes, for edges (src, dst) with src before dst.

    Each round settles the earliest positions of every group: those whose
    edges to later nodes are ``local_edges`` at most (or the first position
    alone) are swept in one task, in order. All edges that end at such a
    position begin at an earlier one, so the sweep decides it for good; nodes
    that it excludes further on take their edges with them. A group takes about
    edges / ``local_edges`` rounds, however long its chains are.
    """
    keys = list(keys)
    done: list[DataFrame] = []
    schema = StructType([*[edges.schema[k] for k in keys], StructField("node", LongType())])

    def sweep(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("dst", kind="stable")
        gone: set[int] = set()
        for src, dst in zip(frame["src"].to_numpy(), frame["dst"].to_numpy()):
            if src not in gone:
                gone.add(dst)
        first = {k: [frame[k].iloc[0]] * len(gone) for k in keys}
        return pd.DataFrame({**first, "node": list(gone)})

    while True:
        shape = measure(edges, keys)
        if shape.groups == 0:
            break
        if shape.largest <= local_edges:
            done.append(edges.groupBy(*keys).applyInPandas(sweep, schema))
            break
        counts = edges.groupBy(*keys, "src").agg(F.count(F.lit(1)).alias("_n"))
        placed = running_total(counts, keys, [F.col("src")], "_before", F.col("_n"))
        ends = placed.filter((F.col("_before") + F.col("_n") <= local_edges) | (F.col("_before") == 0)).groupBy(*keys).agg(
            F.max("src").alias("_end"))
        marked = durable(edges.join(ends, keys))
        gone = durable(marked.filter("src <= _end").select(*keys, "src", "dst").groupBy(*keys).applyInPandas(sweep, schema))
        done.append(gone)
        edges = durable(
            marked.filter("src > _end").drop("_end").join(gone.withColumnRenamed("node", "dst"), [*keys, "dst"], "left_anti")
            .join(gone.withColumnRenamed("node", "src"), [*keys, "src"], "left_anti"))
    return reduce(DataFrame.unionByName, done) if done else None


def dedupe_images(df: DataFrame, keys: Sequence[str], order: Sequence[Column], hash_col: str = "dhash",
                  radius: int = 2, warn_radius: int | None = None, digest_col: str | None = None,
                  id_col: str = "image_id", bits: int = 64, local_edges: int = LOCAL_EDGES,
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keep the first image of every run of near-duplicates, in the given order.

    An image goes when an earlier kept one is within ``radius`` bits; adds
    ``kept``, ``duplicate_of``, ``duplicate_distance`` and ``duplicate_kind``
    (exact digest, near, or a similar view of a kept image within
    ``warn_radius``). Images with the same digest must have the same hash;
    images without a hash are kept. ``order`` must be unique in a group.
    """
    keys = list(keys)
    c = F.col
    own = df.columns
    placed = df.withColumn("_ord", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    hashed = placed.filter(c(hash_col).isNotNull())
    digest = c(digest_col) if digest_col else F.lit(None).cast("string")
    # Only the first image of each hash can be kept, so hashes are the nodes.
    nodes = hashed.groupBy(*keys, c(hash_col).alias("_h")).agg(
        F.min(F.struct("_ord", c(id_col).alias("id"), digest.alias("digest"))).alias("_rep")
    ).select(*keys, "_h", c("_rep._ord").alias("_first"), c("_rep.id").alias("_rep_id"),
             c("_rep.digest").alias("_rep_digest"))
    nodes = durable(running_total(nodes, keys, [c("_first")], "_pos", hot_rows=hot_rows))
    pairs = durable(_radius_pairs(nodes.select(*keys, c("_h").alias("hash")), keys, radius, bits))
    side = nodes.select(*keys, "_h", "_pos")
    located = pairs.join(side.select(*keys, c("_h").alias("a"), c("_pos").alias("_pa")), [*keys, "a"]).join(
        side.select(*keys, c("_h").alias("b"), c("_pos").alias("_pb")), [*keys, "b"])
    edges = durable(located.select(*keys, F.least("_pa", "_pb").alias("src"), F.greatest("_pa", "_pb").alias("dst"), "distance"))
    gone = _rejected_nodes(edges.select(*keys, "src", "dst"), keys, local_edges)
    if gone is None:
        nodes = nodes.withColumn("_kept", F.lit(True))
    else:
        marks = gone.withColumnRenamed("node", "_pos").withColumn("_gone", F.lit(True))
        nodes = durable(nodes.join(marks, [*keys, "_pos"], "left").withColumn("_kept", c("_gone").isNull()).drop("_gone"))

    kept = nodes.filter("_kept").select(*keys, c("_pos").alias("_kpos"), c("_first").alias("_kord"), c("_rep_id").alias("_kid"))
    # Kept hashes near a dropped one lie more than ``radius`` apart from each other, so the list is short.
    both = edges.select(*keys, c("src").alias("_kpos"), c("dst").alias("_pos"), "distance").unionByName(
        edges.select(*keys, c("dst").alias("_kpos"), c("src").alias("_pos"), "distance"))
    near = both.join(kept, [*keys, "_kpos"]).groupBy(*keys, "_pos").agg(
        F.collect_list(F.struct(c("distance").alias("d"), c("_kord").alias("o"), c("_kid").alias("id"))).alias("_near"))
    facts = nodes.join(near, [*keys, "_pos"], "left")
    if warn_radius is not None and warn_radius > radius:
        views = _similar_views(nodes.filter("_kept"), keys, warn_radius, bits)
        facts = facts.join(views, [*keys, "_pos"], "left")
    else:
        facts = facts.withColumn("_view", F.lit(None).cast("struct<d:int,pos:bigint,id:bigint>"))
    facts = facts.withColumnRenamed("_h", hash_col)

    rows = placed.join(facts, [*keys, hash_col], "left")
    first = c(hash_col).isNull() | (c("_kept") & (c("_ord") == c("_first")))
    earlier = F.array_min(F.filter("_near", lambda n: n["o"] < c("_ord")))
    same_hash = c("_kept") & ~first
    exact = same_hash & F.coalesce(digest == c("_rep_digest"), F.lit(False))
    return rows.withColumns({
        "kept": first,
        "duplicate_of": F.when(first, c("_view.id")).when(same_hash, c("_rep_id")).otherwise(earlier["id"]),
        "duplicate_distance": F.when(first, c("_view.d")).when(same_hash, 0).otherwise(earlier["d"]),
        "duplicate_kind": F.when(first & c("_view").isNotNull(), "similar_view").when(first, F.lit(None)).when(
            exact, "duplicate_exact").otherwise("duplicate_near"),
    }).select(*own, "kept", "duplicate_of", "duplicate_distance", "duplicate_kind")


def _similar_views(kept: DataFrame, keys: Sequence[str], radius: int, bits: int) -> DataFrame:
    """Closest earlier kept hash within the radius, for every kept hash that has one."""
    keys = list(keys)
    pairs = _radius_pairs(kept.select(*keys, F.col("_h").alias("hash")), keys, radius, bits)
    side = kept.select(*keys, "_h", "_pos", "_rep_id")
    at = pairs.join(side.select(*keys, F.col("_h").alias("a"), F.col("_pos").alias("_pa"), F.col("_rep_id").alias("_ia")),
                    [*keys, "a"]).join(
        side.select(*keys, F.col("_h").alias("b"), F.col("_pos").alias("_pb"), F.col("_rep_id").alias("_ib")), [*keys, "b"])
    first = F.col("_pa") < F.col("_pb")
    return at.select(
        *keys, F.greatest("_pa", "_pb").alias("_pos"),
        F.struct(F.col("distance").alias("d"), F.least("_pa", "_pb").alias("pos"),
                 F.when(first, F.col("_ia")).otherwise(F.col("_ib")).alias("id")).alias("_v"),
    ).groupBy(*keys, "_pos").agg(F.min("_v").alias("_view"))


def apply_duplicates(df: DataFrame) -> DataFrame:
    """Fold the outcome of ``dedupe_images`` into reasons and status."""
    from .images import with_status

    bad = ~F.col("kept")
    view = F.coalesce(F.col("duplicate_kind") == "similar_view", F.lit(False))
    return with_status(df.withColumns({
        "rejected_reasons": F.when(bad, F.array_append("rejected_reasons", F.col("duplicate_kind"))).otherwise(
            F.col("rejected_reasons")),
        "warning_reasons": F.when(view, F.array_append("warning_reasons", F.lit("similar_view"))).otherwise(
            F.col("warning_reasons")),
    }))
