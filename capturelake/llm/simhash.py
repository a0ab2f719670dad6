"""SimHash near-duplicates: fingerprints linked by a self-join of their binary trie.

Null and empty texts have no words and the fingerprint zero, which is linked
like any other. Repeated rows are separate rows of one group. A row without an
id takes part in the links; it only cannot name a group. Other columns are
never read, so clashing names are harmless; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from ..operators.scale import attach
from ..session import durable
from .arrow import map_texts
from .components import components

#: Widths of the blocks of a fingerprint, from its highest bit.
BLOCKS = (11, 11, 11, 11, 10, 10)
SHIFTS = tuple(64 - sum(BLOCKS[: i + 1]) for i in range(len(BLOCKS)))
#: With at most four differing bits, two of six blocks agree; each pair of blocks leads one ordering of the bits.
MAX_BITS = 4
LEADS = tuple(combinations(range(len(BLOCKS)), len(BLOCKS) - MAX_BITS))
ORDERS = tuple((*lead, *(k for k in range(len(BLOCKS)) if k not in lead)) for lead in LEADS)
LEAD_BITS = tuple(sum(BLOCKS[k] for k in lead) for lead in LEADS)
#: A subtree with more fingerprints is cut into tiles of about this many, and tile pairs are walked apart.
TILE = 16_384
#: A fingerprint is frequent if it has over one of so many rows.
HOT_SHARE = 10_000
#: Fingerprints and node pairs walked at once in a task.
ROWS, PAIRS = 200_000, 200_000


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``words`` words of the text, A-Z lower-cased."""
    # bytes.lower() and bytes.split() know only A-Z and the six ASCII white spaces.
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    count = max(1, len(found) - words + 1)
    last = ends[min(words, len(found)) - 1:] - 1
    shingles = map(joined.__getitem__, map(slice, starts[:count].tolist(), last.tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, count)


def word_hashes(text: bytes | None) -> np.ndarray:
    """The different ``shingle_hashes`` of single words, sorted; each word is hashed once."""
    found = set((text or b"").lower().split())
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(42)), np.uint64, len(found)))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set where over half of the hashes have it."""
    votes = np.zeros(64, np.int64)
    # So many votes fit 16 bits.
    for i in range(0, len(hashes), 65_535):
        part = np.ascontiguousarray(hashes[i:i + 65_535])
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprint(df: DataFrame, text: str, keep: list[str], out: str = "fp", words: int = 4) -> DataFrame:
    """The ``keep`` columns and the signed 64-bit fingerprint of the whole text."""

    def make(texts: list[bytes | None]) -> list[pa.Array]:
        found = np.fromiter((fingerprint(shingle_hashes(t, words)) for t in texts), np.uint64, len(texts))
        return [pa.array(found.view(np.int64))]

    return map_texts(df, text, keep, [StructField(out, LongType())], make)


def _ordered(fp: Column, order: tuple[int, ...]) -> Column:
    """The fingerprint with its blocks in another order."""
    out, at = F.lit(0).cast("bigint"), 64
    for k in order:
        at -= BLOCKS[k]
        block = F.shiftrightunsigned(fp, SHIFTS[k]).bitwiseAND(F.lit((1 << BLOCKS[k]) - 1).cast("bigint"))
        out = out.bitwiseOR(F.shiftleft(block, at))
    return out


def _restored(values: np.ndarray, order: tuple[int, ...]) -> np.ndarray:
    out, at = np.zeros_like(values), 64
    for k in order:
        at -= BLOCKS[k]
        out |= ((values >> np.uint64(at)) & np.uint64((1 << BLOCKS[k]) - 1)) << np.uint64(SHIFTS[k])
    return out


def _link(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Merge the classes of x and y; label holds the smallest member of each class."""
    while True:
        rx, ry = label[x], label[y]
        open_ = rx != ry
        if not open_.any():
            return label
        x, y, rx, ry = x[open_], y[open_], rx[open_], ry[open_]
        np.minimum.at(label, np.maximum(rx, ry), np.minimum(rx, ry))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def trie_classes(values: np.ndarray, starts: np.ndarray, depth: int, budget: int) -> np.ndarray:
    """Class (position of its first member) of each value, linked at ``budget`` or fewer differing bits.

    ``values`` are distinct and ascending within the groups between
    ``starts``; the values of a group share their first ``depth`` bits, so each
    group is a subtree of the binary trie. Pairs of nodes (ranges of values)
    are walked downwards together: each step takes one more bit, adds one to
    the differing bits of crossing children, and drops pairs over the budget.
    Pairs whose values are all in one class already are not walked further, so
    a crowd of close values costs little more than its links.
    """
    n = len(values)
    label, ones = np.arange(n), {}
    lo, hi = starts[:-1], starts[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(depth, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    linked = False
    while stack:
        bit, *pair = stack.pop()
        if len(pair[0]) > PAIRS:
            stack += [(bit, *(x[i:i + PAIRS] for x in pair)) for i in range(0, len(pair[0]), PAIRS)]
            continue
        if linked:
            al, ah, bl, bh, _ = pair
            turns = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
            settled = (turns[ah - 1] == turns[al]) & (turns[bh - 1] == turns[bl]) & (label[al] == label[bl])
            pair = [x[~settled] for x in pair]
        al, ah, bl, bh, _ = pair
        single = (ah - al == 1) & (bh - bl == 1)
        x, y = al[single], bl[single]
        near = (x != y) & (np.bitwise_count(values[x] ^ values[y]) <= budget)
        if near.any():
            label, linked = _link(label, x[near], y[near]), True
        al, ah, bl, bh, off = (x[~single] for x in pair)
        if not len(al):
            continue
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((values >> np.uint64(63 - bit)) & np.uint64(1), dtype=np.int64)])
        c = ones[bit]
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
        apart = al != bl
        sides = [(al, am, bl, bm, off), (am, ah, bm, bh, off), (al, am, bm, bh, off + 1),
                 tuple(x[apart] for x in (am, ah, bl, bm, off + 1))]
        below = [np.concatenate(x) for x in zip(*sides, strict=True)]
        alive = (below[1] > below[0]) & (below[3] > below[2]) & (below[4] <= budget)
        stack.append((bit + 1, *(x[alive] for x in below)))
    return label


def _walk(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Links of a partition sorted by (lead, pair, value), one star for each class of a subtree."""
    rest = np.array([64 - b for b in LEAD_BITS], np.uint64)

    def links(lead, pair, value) -> Iterator[pa.RecordBatch]:
        key = value >> rest[lead % len(LEADS)]
        cut = np.flatnonzero((lead[1:] != lead[:-1]) | (pair[1:] != pair[:-1]) | (key[1:] != key[:-1])) + 1
        starts = np.concatenate([[0], cut, [len(value)]])
        for k in np.unique(lead).tolist():
            i, j = np.searchsorted(lead, [k, k + 1])
            own = starts[(starts >= i) & (starts <= j)] - i
            values = value[i:j]
            seed, k = divmod(k, len(LEADS))
            label = trie_classes(values, own, LEAD_BITS[k], budget)
            moved = np.flatnonzero(label != np.arange(len(label)))
            plain = _restored(values, ORDERS[k])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(moved), seed, np.int32)), pa.array(plain[moved].view(np.int64)),
                pa.array(plain[label[moved]].view(np.int64))], names=["seed", "a", "b"])

    held, rows = [], 0
    for batch in batches:
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        rows += batch.num_rows
        if rows < ROWS:
            continue
        lead, pair, value = (np.concatenate(x) for x in zip(*held, strict=True))
        shift = rest[lead[-1] % len(LEADS)]
        whole = value.view(np.uint64)
        open_ = (lead == lead[-1]) & (pair == pair[-1]) & (whole >> shift == whole[-1] >> shift)
        cut = len(lead) - int(open_.sum())
        if cut:
            yield from links(lead[:cut], pair[:cut], whole[:cut])
        held = [[x[cut:] for x in (lead, pair, value)]]
        rows = len(lead) - cut
    if rows:
        lead, pair, value = (np.concatenate(x) for x in zip(*held, strict=True))
        yield from links(lead, pair, value.view(np.uint64))


def linked_fingerprints(distinct: DataFrame, budget: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """Links (seed, a, b) that connect all distinct fingerprints (seed, fp) of one seed differing in ``budget`` or fewer bits.

    At most four bits. Each fingerprint enters one trie for each ordering of
    its blocks, and each subtree under an agreeing lead is walked by itself. A
    crowded subtree is cut into tiles; every pair of its tiles is a task, so
    that no link is lost and no task holds more than two tiles.
    """
    if budget > MAX_BITS:
        raise ValueError(f"the orderings find at most {MAX_BITS} differing bits")
    rest = " ".join(f"WHEN {i} THEN {64 - b}" for i, b in enumerate(LEAD_BITS))
    spread = distinct.select(
        "seed", "fp", F.posexplode(F.array(*[_ordered(F.col("fp"), o) for o in ORDERS])).alias("k", "v")
    ).select((F.col("seed") * len(LEADS) + F.col("k")).alias("lead"), "fp", "v",
             F.expr(f"shiftrightunsigned(v, CASE k {rest} END)").alias("key"))
    crowded = (
        spread.groupBy("lead", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tile)
        .select("lead", "key", F.ceil(F.col("n") / tile).cast("bigint").alias("tiles"))
    )
    own = F.pmod(F.xxhash64("fp"), F.col("tiles"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("tiles", F.lit(1).cast("bigint")) - 1))
    placed = spread.join(crowded, ["lead", "key"], "left").select("lead", "key", "v", "tiles", own.alias("own"), other.alias("other"))
    pair = F.when(F.col("tiles").isNull(), 0).otherwise(
        F.least("own", "other") * F.lit(1 << 31) + F.greatest("own", "other")).cast("bigint").alias("pair")
    dealt = placed.select("lead", "key", pair, "v").repartition("lead", "key", "pair").sortWithinPartitions(
        "lead", "pair", "key", "v").select("lead", "pair", "v")
    return dealt.mapInArrow(lambda batches: _walk(batches, budget), "seed int, a bigint, b bigint")


def near_duplicates(fingerprints: DataFrame, budget: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """Rows (fp, n, component_id) for each distinct ``fp`` of (id, fp): its rows, and the smallest id reachable over links."""
    key, fp = fingerprints.columns
    first = durable(fingerprints.groupBy(F.col(fp).alias("fp")).agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n")))
    links = linked_fingerprints(first.select(F.lit(0).alias("seed"), "fp"), budget, tile)
    roots = components(links.select("a", "b"))
    named = roots.join(first, roots["node"] == first["fp"]).select("node", "root", "least")
    by_root = named.groupBy("root").agg(F.min("least").alias("whole"))
    moved = named.join(by_root, "root").select(F.col("node").alias("fp"), "whole")
    return first.join(moved, "fp", "left").select("fp", "n", F.coalesce("whole", "least").alias("component_id"))


def simhash_components(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, budget: int = MAX_BITS,
                       tile: int = TILE) -> DataFrame:
    """Per row: ``key``, its fingerprint in hexadecimal, and the smallest ``key`` of its component."""
    marked = durable(with_fingerprint(df, text, [key], "fp", words).withColumnRenamed(key, "__llm_id"))
    classes = near_duplicates(marked, budget, tile)
    # At most HOT_SHARE fingerprints are that frequent; they are broadcast, and their many rows stay where they are.
    hot_rows = max(1, marked.count() // HOT_SHARE)
    joined = attach(marked, classes, ["fp"], F.col("n"), hot_rows)
    return joined.select(
        F.col("__llm_id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
