"""One document of each group of near copies, by the Jaccard similarity of their five-word shingles.

Copies of similarity 0.8 differ in about ten bits of a fingerprint of their
shingles, far beyond what a trie walk can afford. So the first candidates come
from fingerprints of the documents' distinct words, which lightly edited copies
leave within four bits: ``SEEDS`` independent ones, each joined whole by its
trie (``simhash.linked_fingerprints``). Checking these joins most copies cheaply.

What that leaves apart (texts cut short or extended, above all) meets by the
least hashes of its shingles: ``BANDS`` bands of ``ROWS`` of them, whatever the
kind of edit. Of texts that agree in a band, those of different classes are
compared by all their least hashes, and pairs that come near (``LEAST_EQUAL``)
by their shingles. A pair of similarity 0.8 agrees in a band with a chance of
0.9998 and comes near with one of 0.9997; links are exact.

Null and empty texts are equal texts without words. Rows are told apart by id
and text: exact repeats of a row count once, rows with one id and different
texts are different documents, and a null id is an id. Very long texts are
hashed in blocks. Equally good pairs are taken in the order of their digests.
Other columns pass unchanged, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField

from ..operators.scale import attach
from ..session import durable, release, sweep
from .arrow import map_texts
from .components import components
from .simhash import MAX_BITS, _link, fingerprint, linked_fingerprints, shingle_hashes, word_hashes

SEEDS, WORDS, SIMILARITY = 4, 5, 0.8
#: Texts of a candidate group that are compared with each other in one task.
TILE = 256
#: Rows (ids and digests) that may be broadcast.
BROADCAST_ROWS = 200_000
_COLUMNS = 16_384
#: Least hashes of a text, in bands of so many, and how many of them near copies share at least.
BANDS, ROWS, LEAST_EQUAL = 16, 4, 40
#: Texts of one band whose least hashes are compared in one task.
PIECE = 1_024
#: Shingles of a tile whose texts are verified against another's.
PIECE_SHINGLES = 4_000_000
#: Pairs compared at once when no nearest pair joins classes any more.
PAIRS_AT_ONCE = 65_536


def _mixed(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Other hashes of the same words (a public 64-bit finalizer)."""
    h = hashes ^ np.uint64(0x9E3779B97F4A7C15 * (seed + 1) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_fingerprints(text: bytes | None, seeds: int = SEEDS) -> list[int]:
    """Fingerprints of the distinct words, one for each seed, as signed numbers."""
    words = word_hashes(text)
    return [int(np.uint64(fingerprint(_mixed(words, s))).astype(np.int64)) for s in range(seeds)]


_TURNS = np.array([_mixed(np.array([k], np.uint64), 77)[0] for k in range(2 * BANDS * ROWS)])
_FLIPS, _FACTORS = _TURNS[:BANDS * ROWS], _TURNS[BANDS * ROWS:] | np.uint64(1)


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least of the hashes under each of 64 hash functions, 32 bits of it; of no hashes, the largest number."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 512):
        least = np.minimum(least, ((hashes[i:i + 512, None] ^ _FLIPS) * _FACTORS).min(0))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def similar(shingles: list[np.ndarray], least: float = SIMILARITY) -> np.ndarray:
    """Which pairs of sets (sorted arrays) have a Jaccard similarity of ``least`` or more; empty sets equal each other."""
    sizes = np.array([len(s) for s in shingles])
    values, place = np.unique(np.concatenate(shingles), return_inverse=True)
    owner = np.repeat(np.arange(len(shingles)), sizes)
    # Shingles of one set alone meet nothing; the others are counted in blocks of columns.
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    shared = np.bincount(place, minlength=len(values))[place] > 1
    place, owner = np.unique(place[shared], return_inverse=True)[1], owner[shared]
    common = np.zeros((len(shingles),) * 2, np.float32)
    for first in range(0, int(place[-1]) + 1 if len(place) else 0, _COLUMNS):
        i, j = np.searchsorted(place, [first, first + _COLUMNS])
        held = np.zeros((len(shingles), _COLUMNS), np.float32)
        held[owner[i:j], place[i:j] - first] = 1
        common += held @ held.T
    np.fill_diagonal(common, sizes)
    either = sizes[:, None] + sizes[None, :] - common
    return common >= least * either


def _checked(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links of the texts of each tile, from rows (whole, tile, digest, shingles) sorted by whole and tile.

    Every text is linked to the one with the most similar texts of its class,
    which stands for the class when tiles meet.
    """

    def tile(rows: list[tuple[bytes, np.ndarray]]) -> pa.RecordBatch:
        near = similar([s for _, s in rows], least)
        x, y = np.nonzero(near)
        label = _link(np.arange(len(rows)), x, y)
        degree = near.sum(1)
        heads = {}
        for i in np.argsort(-degree, kind="stable").tolist():
            heads.setdefault(int(label[i]), i)
        return pa.RecordBatch.from_arrays([
            pa.array([d for d, _ in rows], pa.binary()), pa.array([rows[heads[int(k)]][0] for k in label], pa.binary())],
            names=["digest", "head"])

    now, rows = None, []
    for batch in batches:
        whole, number, digest = (batch.column(i).to_pylist() for i in range(3))
        lists = batch.column(3)
        flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        for n, key in enumerate(zip(whole, number, strict=True)):
            if key != now and rows:
                yield tile(rows)
                rows = []
            now = key
            rows.append((digest[n], flat[ends[n - 1] if n else 0:ends[n]]))
    if rows:
        yield tile(rows)


def candidate_groups(texts: DataFrame, seeds: int = SEEDS, budget: int = MAX_BITS) -> DataFrame:
    """Rows (digest, whole) of texts (digest, f) that reach each other over near fingerprints; single texts are left out."""
    spread = texts.select("digest", F.posexplode("f").alias("seed", "fp"))
    crowd = durable(spread.groupBy("seed", "fp").agg(F.count(F.lit(1)).alias("n")))
    links = durable(linked_fingerprints(crowd.select("seed", "fp"), budget))
    # The walk's shuffles are the largest of all; they go before the next ones come.
    sweep(links.sparkSession)

    def node(fp: str):
        return F.concat(F.unhex(F.lpad(F.hex("seed"), 2, "0")), F.unhex(F.lpad(F.hex(fp), 16, "0")))

    busy = (
        links.select("seed", F.explode(F.array("a", "b")).alias("fp"))
        .union(crowd.filter("n > 1").select("seed", "fp")).distinct()
    )
    edges = links.select(node("a").alias("a"), node("b").alias("b")).union(
        spread.join(busy, ["seed", "fp"]).select(F.col("digest").alias("a"), node("fp").alias("b")))
    roots = components(edges)
    release(crowd, links)
    return roots.filter(F.octet_length("node") == 32).select(F.col("node").alias("digest"), F.col("root").alias("whole"))


def _shingles(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    return [np.unique(shingle_hashes(t, words)) for t in texts]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.view(np.int64) for a in arrays], pa.list_(pa.int64()))


def _with_shingles(docs: DataFrame, groups: DataFrame, text: str, words: int) -> DataFrame:
    """Rows (digest, whole, size, shingles) of groups of two texts and more."""
    sizes = groups.groupBy("whole").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    chosen = durable(groups.join(sizes, "whole"))
    side = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    wanted = docs.join(side, "digest").select("digest", "whole", "size", text)
    shingled = map_texts(wanted, text, ["digest", "whole", "size"], [StructField("shingles", ArrayType(LongType()))],
                         lambda found: [_lists(_shingles(found, words))])
    # Copies of one text are in docs as often as they occur.
    return durable(shingled.dropDuplicates(["digest"]))


def _links_by_heads(active: DataFrame, least: float, tile: int) -> DataFrame:
    """Links (digest, head) inside random tiles of each group, whose heads meet in turn as long as that leaves fewer."""
    links, held = None, active.count()
    while True:
        number = F.pmod(F.xxhash64("digest", F.lit(held)), F.ceil(F.col("size") / tile))
        dealt = active.select("whole", number.alias("tile"), "digest", "shingles").repartition("whole", "tile").sortWithinPartitions(
            "whole", "tile")
        found = durable(dealt.mapInArrow(lambda batches: _checked(batches, least), "digest binary, head binary"))
        links = found if links is None else links.union(found)
        heads = found.filter("digest = head").select("digest")
        open_ = active.filter(F.col("size") > tile).join(heads, "digest")
        counts = open_.groupBy("whole").agg(F.count(F.lit(1)).alias("size"))
        active = durable(open_.drop("size").join(counts, "whole").select("digest", "whole", "size", "shingles"))
        before, held = held, active.count()
        if not held or held > 0.9 * before:
            return links


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each run of equal values of the first ``keys`` columns (numbers)."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        turns = np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in values])) + 1
        cuts = [0, *turns.tolist(), batch.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(v[i] for v in values)
            if held and key != now:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _near_pairs(run: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (x, y) of rows of one (band, key, piece) that come near, how many least hashes they share, and the class number of each row.

    A pair is reported by the first band that its texts agree in, and by the
    one piece that belongs to its two tiles.
    """
    band, piece = run.column("band")[0].as_py(), run.column("piece")[0].as_py()
    own, number = run.column("own").to_numpy(), run.column("class").combine_chunks().dictionary_encode().indices.to_numpy()
    sigs = run.column("sig").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS * ROWS)
    left, right = (np.flatnonzero(own == t) for t in divmod(piece, 1 << 31))
    equal, apart = np.zeros((len(left), len(right)), np.int16), number[left][:, None] != number[right][None, :]
    if piece >> 31 == piece % (1 << 31):
        apart &= left[:, None] < right[None, :]
    if apart.any():
        a, b = sigs[left].T.copy(), sigs[right].T.copy()
        for k in range(BANDS):
            same = np.zeros(equal.shape, np.int8)
            for c in range(k * ROWS, (k + 1) * ROWS):
                same += a[c][:, None] == b[c][None, :]
            equal += same
            if k < band:
                apart &= same < ROWS
    i, j = np.nonzero(apart & (equal >= LEAST_EQUAL))
    return left[i], right[j], equal[i, j], number


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (band, key, piece), those whose text comes near one of another class there, each once."""
    for run in _runs(batches, 3):
        x, y, _, _ = _near_pairs(run)
        if len(x):
            yield from run.take(pa.array(np.unique(np.concatenate([x, y])))).combine_chunks().to_batches()


def _meetings(contacts: DataFrame, classes: DataFrame, piece: int = PIECE) -> DataFrame:
    """Rows (band, key, piece, own, digest, class, sig) of the contacts (band, key, digest, sig) that come near one of another class.

    ``classes`` is (digest, root) so far. A band is dealt into tiles (``own``),
    and every pair of tiles is a piece, as is every tile with itself. In a crowded band
    the largest class is dealt into tiles that meet those of the rest, but not each other.
    """
    marked = contacts.join(classes, "digest", "left").withColumn("class", F.coalesce("root", "digest")).drop("root")
    sizes = marked.groupBy("band", "key", "class").agg(F.count(F.lit(1)).alias("n")).groupBy("band", "key").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "class")).alias("most")).filter(F.col("most.n") < F.col("n"))
    crowd = sizes.select("band", "key", "n", F.col("most.class").alias("large"), F.col("most.n").alias("m")).select(
        "band", "key", "n", F.when(F.col("n") > 2 * piece, F.col("large")).alias("large"),
        F.when(F.col("n") > 2 * piece, F.ceil((F.col("n") - F.col("m")) / piece)).otherwise(1).cast("int").alias("small_tiles"),
        F.when(F.col("n") > 2 * piece, F.ceil(F.col("m") / piece)).otherwise(0).cast("int").alias("large_tiles"))
    joined = attach(marked, crowd, ["band", "key"], F.col("n"), max(1_000, contacts.count() // 1_000)).filter("n IS NOT NULL")
    big = F.col("large").isNotNull() & (F.col("large") == F.col("class"))
    code = F.xxhash64("digest")
    own = F.when(big, F.col("small_tiles") + F.pmod(code, "large_tiles")).otherwise(F.pmod(code, "small_tiles")).cast("int")
    last = F.when(big, F.col("small_tiles")).otherwise(F.col("small_tiles") + F.col("large_tiles")) - 1
    placed = joined.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    dealt = placed.select("band", "key", _pair_code("own", "other").alias("piece"), "own", "digest", "class", "sig").repartition(
        "band", "key", "piece").sortWithinPartitions("band", "key", "piece")
    return durable(dealt.mapInArrow(_met, "band int, key bigint, piece bigint, own int, digest binary, class binary, sig array<int>"))


def _pair_code(a: str, b: str) -> Column:
    return F.least(a, b).cast("bigint") * F.lit(1 << 31) + F.greatest(a, b)


def _coded(shingles: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The sets with small numbers for their members, and how many of them there are."""
    values, codes = np.unique(np.concatenate(shingles), return_inverse=True)
    return np.split(codes, np.cumsum([len(s) for s in shingles])[:-1]), len(values)


def _similar_coded(own: list[np.ndarray], members: int, x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    sizes = np.array([len(s) for s in own], np.int64)
    mark, fit = np.zeros(members, bool), np.zeros(len(x), bool)
    order = np.argsort(x, kind="stable")
    cuts = np.flatnonzero(np.diff(x[order])) + 1
    for places in np.split(order, cuts) if len(order) else []:
        one = own[x[places[0]]]
        mark[one] = True
        for i in range(0, len(places), 256):
            some = places[i:i + 256]
            others = y[some]
            met = mark[np.concatenate([own[k] for k in others])]
            common = np.bincount(np.repeat(np.arange(len(some)), sizes[others]), weights=met, minlength=len(some))
            fit[some] = common >= least * (len(one) + sizes[others] - common)
        mark[one] = False
    return fit


def similar_pairs(shingles: list[np.ndarray], x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """Which of the pairs (x, y) of sets are similar; each x is marked once and its partners look their shingles up there."""
    return _similar_coded(*_coded(shingles), x, y, least)


def joining_pairs(shingles: list[np.ndarray], x: np.ndarray, y: np.ndarray, equal: np.ndarray, number: np.ndarray,
                  least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Similar pairs among (x, y) that join all classes (``number``) which any of the pairs joins.

    While classes join, each one's nearest pair (most ``equal``) is compared alone; then
    all pairs that are left between classes are. So at most one pair fewer than classes comes out.
    """
    sizes = np.array([len(s) for s in shingles])
    # Sets of too different sizes cannot be similar.
    order = np.argsort(-equal, kind="stable")
    x, y = x[order], y[order]
    fits = np.minimum(sizes[x], sizes[y]) >= least * np.maximum(sizes[x], sizes[y])
    x, y = x[fits], y[fits]
    label, out, joins = np.arange(int(number.max()) + 1), [], True
    own, members = _coded(shingles) if len(x) else ([], 0)
    while len(x):
        p, q = label[number[x]], label[number[y]]
        some = np.arange(min(len(x), PAIRS_AT_ONCE))
        if joins:
            some = np.unique(np.concatenate([np.unique(c, return_index=True)[1] for c in (p, q)]))
        fit = some[_similar_coded(own, members, x[some], y[some], least)]
        joins = len(fit) > 0
        # A forest of the new links: each class that is joined keeps one.
        for k in fit.tolist():
            a, b = label[number[x[k]]], label[number[y[k]]]
            if a != b:
                out.append((x[k], y[k]))
                label[label == max(a, b)] = min(a, b)
        rest = np.ones(len(x), bool)
        rest[some] = False
        rest &= label[number[x]] != label[number[y]]
        x, y = x[rest], y[rest]
    return tuple(np.array(c, np.int64) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 2


def _verified(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between classes, from rows (band, key, piece, part, share, own, digest, class, sig, shingles) sorted by part."""
    for run in _runs(batches, 4):
        x, y, equal, number = _near_pairs(run)
        low, high = divmod(run.column("part")[0].as_py(), 1 << 31)
        share = run.column("share").to_numpy()
        here = (low == high) | (share[x] != share[y])
        if not here.any():
            continue
        lists = run.column("shingles").combine_chunks()
        flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        shingles = np.split(flat, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))[:-1])
        x, y = joining_pairs(shingles, x[here], y[here], equal[here], number, least)
        digests = run.column("digest")
        yield pa.RecordBatch.from_arrays([digests.take(pa.array(i)).combine_chunks() for i in (x, y)], names=["a", "b"])


def _linked(near: DataFrame, held: DataFrame, least: float, piece: int = PIECE) -> DataFrame:
    """Links (a, b) that join the classes of near texts (``_meetings``) whose shingles are similar, ``held`` being (digest, shingles).

    Pairs are found and compared inside a piece's task, which returns fewer
    links than it has classes. Pieces of more than ``PIECE_SHINGLES`` from each side are cut into parts.
    """
    parts, size = F.lit(1), F.size("shingles")
    if (held.agg(F.max(size)).first()[0] or 0) * 2 * piece > 2 * PIECE_SHINGLES:
        long = near.select("band", "key", "piece", "digest").join(held.select("digest", size.alias("size")), "digest").groupBy(
            "band", "key", "piece").agg(F.ceil(F.sum("size") / PIECE_SHINGLES).cast("int").alias("parts")).filter("parts > 2")
        # There are few, since each has so many shingles.
        near, parts = near.join(F.broadcast(long), ["band", "key", "piece"], "left"), F.coalesce("parts", F.lit(1))
    # Not the hash that deals the tiles: a tile's texts go to all parts.
    shared = near.withColumn("share", F.pmod(F.xxhash64("digest", F.lit(1)), parts).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), parts - 1)))
    full = shared.join(held, "digest").select(
        "band", "key", "piece", _pair_code("share", "other").alias("part"), "share", "own", "digest", "class", "sig", "shingles")
    dealt = full.repartition("band", "key", "piece", "part").sortWithinPartitions("band", "key", "piece", "part")
    return durable(dealt.mapInArrow(lambda batches: _verified(batches, least), "a binary, b binary"))


def linked_by_bands(docs: DataFrame, sigs: DataFrame, classes: DataFrame, text: str, least: float = SIMILARITY, words: int = WORDS,
                    piece: int = PIECE) -> DataFrame:
    """Classes (digest, root) joined further by similar texts that share a band, ``sigs`` being (digest, sig).

    Near texts of different classes meet in tiles of their band; there their
    pairs are found, compared exactly, and only links that join classes leave the task.
    """
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(*[F.element_at("sig", b * ROWS + i + 1) for i in range(ROWS)]).alias("key"))
                      for b in range(BANDS)])
    marked = sigs.join(classes, "digest", "left").select("digest", F.xxhash64(F.coalesce("root", "digest")).alias("class"), "sig")
    spread = marked.select("digest", "class", F.inline(bands))
    met = durable(spread.groupBy("band", "key").agg(F.min("class").alias("one"), F.max("class").alias("other"), F.count(F.lit(1)).alias("n")).filter(
        "one <> other").select("band", "key", "n"))
    rows = met.count()
    if rows <= BROADCAST_ROWS:
        there = spread.join(F.broadcast(met), ["band", "key"])
    else:
        there = attach(spread, met, ["band", "key"], F.col("n"), max(1_000, rows // 1_000)).filter("n IS NOT NULL")
    contacts = durable(there.select("band", "key", "digest").join(sigs, "digest"))
    # Few of those that share a band come near; only they go on.
    near = _meetings(contacts, classes, piece)
    release(contacts, met)
    open_ = durable(near.select("digest").distinct())
    side = F.broadcast(open_) if open_.count() <= BROADCAST_ROWS else open_
    shingled = map_texts(docs.join(side, "digest").select("digest", text), text, ["digest"], [StructField("shingles", ArrayType(LongType()))],
                         lambda found: [_lists(_shingles(found, words))])
    held = durable(shingled.dropDuplicates(["digest"]))
    found = _linked(near, held, least, piece)
    release(near, held, open_)
    if not found.count():
        return classes
    return durable(components(classes.union(found)).select(F.col("node").alias("digest"), "root"))


def near_copy_classes(docs: DataFrame, texts: DataFrame, text: str, least: float = SIMILARITY, words: int = WORDS,
                      tile: int = TILE, piece: int = PIECE) -> DataFrame:
    """Rows (digest, root) of the texts that are similar to another, root being one of their class.

    ``docs`` has digest and the text, ``texts`` one row (digest, f, sig) for
    each different text. Of groups of near fingerprints larger than ``tile``,
    only heads of classes meet across tiles, which joins crowds cheaply;
    ``linked_by_bands`` joins what that leaves apart.
    """
    links = _links_by_heads(_with_shingles(docs, candidate_groups(texts.select("digest", "f")), text, words), least, tile)
    classes = durable(components(links).select(F.col("node").alias("digest"), "root"))
    return linked_by_bands(docs, texts.select("digest", "sig"), classes, text, least, words, piece)


def marks(text: bytes | None, seeds: int = SEEDS, words: int = WORDS) -> tuple[list[int], np.ndarray]:
    """A text's word fingerprints and its least hashes."""
    return word_fingerprints(text, seeds), least_hashes(np.unique(shingle_hashes(text, words)))


def drop_near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The documents, same columns, less all but one (the smallest id) of each class of exact and near copies."""
    digest = F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), 256))
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{key}`").alias("id"),
                    F.col(f"`{text}`").cast("string").alias("words"), digest.alias("digest"))

    def make(found: list[bytes | None]) -> list[pa.Array]:
        made = [marks(t) for t in found]
        return [pa.array([f for f, _ in made], pa.list_(pa.int64())), pa.array([m for _, m in made], pa.list_(pa.int32()))]

    marked = durable(map_texts(row, "words", ["id", "digest"], [
        StructField("f", ArrayType(LongType())), StructField("sig", ArrayType(IntegerType()))], make))
    texts = durable(marked.groupBy("digest").agg(F.min("id").alias("id"), F.first("f").alias("f"), F.first("sig").alias("sig")))
    first = row.select("digest", "id", "words")
    classes = near_copy_classes(first, texts.select("digest", "f", "sig"), "words", least)
    # The class of a text, and the smallest (id, digest) of the class; nulls come last.
    named = texts.select("digest", "id").join(classes, "digest")
    best = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "digest")).alias("best"))
    stays = texts.select("digest", "id").join(
        named.join(best, "root").select("digest", F.col("best.id").alias("best_id"), F.col("best.digest").alias("best_digest")), "digest", "left")
    rows = marked.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("n"))
    # A text of a class stays if it is the class's best; of its rows those with the smallest id.
    judged = rows.join(stays.withColumnRenamed("id", "least_id"), "digest").select(
        "digest", "id", "n",
        (F.coalesce(F.col("best_digest") == F.col("digest"), F.lit(True)) & F.col("id").eqNullSafe(F.col("least_id"))).alias("stays"))
    dropped = durable(judged.filter(~F.col("stays")).select("digest", "id"))
    again = durable(judged.filter(F.col("stays") & (F.col("n") > 1)).select("digest", "id"))

    def bounded(x: DataFrame) -> DataFrame:
        return F.broadcast(x) if x.count() <= BROADCAST_ROWS else x

    def same(x: DataFrame):
        return (row["digest"] == x["digest"]) & row["id"].eqNullSafe(x["id"])

    kept = row.join(bounded(dropped), same(dropped), "left_anti")
    if again.count():
        repeats = bounded(again)
        kept = kept.join(repeats, same(again), "left_anti").union(
            kept.join(repeats, same(again), "left_semi").dropDuplicates(["digest", "id"]))
    return kept.select("row.*")
