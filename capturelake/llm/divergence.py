"""How far the sources of a language differ in their words, by a frequent-pattern tree of term rows.

A kept term's row lists the sources that use it, in order, each with its
smoothed probability. Rows enter a prefix tree (``tree_corrections``); a node
holds how many terms share its path, so what two sources differ by in those
terms is added once for each pair of a node and one of its ancestors. Sources
that don't use a term all have one probability for it, hence terms that one or
none of two sources use need no tree: they come from the sources' histograms.
All sums are integers, so the result does not depend on how rows are dealt.

Null texts have no terms; null languages and sources are the empty string.
Repeated rows are documents of their own. A group without terms takes part
with the probabilities of zero counts; a language without kept terms has pairs
of value 0 and no terms. Equal values are ranked by their item. Long texts are
cut into words at once, and counts leave a task whenever they are many. Other
columns are never read, so clashing names are harmless; an empty table gives
an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scale import attach
from ..session import durable

#: A term is kept in a language if so many of its documents hold it; added to each count; terms reported for each source.
LEAST_DOCS, SMOOTHING, TOP = 30, 5, 50
#: Probabilities are parts of this many.
PARTS = 1_000_000_000
#: Different terms that a task holds before it hands their counts on, and sources that are compared with one at once.
HELD, BLOCK = 400_000, 2_048
#: Groups that may be broadcast by their own number of terms (the others are at most as many as this).
HOT_SHARE = 10_000
#: Every byte that is no part of a term becomes a blank, A-Z become a-z.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8: runs of letters A-Z, lower-cased, and of all characters beyond ASCII."""
    return (text or b"").translate(_WORDS).split()


def _counts(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, n, docs), and one with a null term for each group of the partition."""
    groups: dict[tuple, tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            size = len(n) + 1
            yield pa.RecordBatch.from_arrays([
                pa.repeat(pa.scalar(lang, pa.string()), size), pa.repeat(pa.scalar(source, pa.string()), size),
                pa.array([None, *n], pa.binary()), pa.array([0, *n.values()], pa.int64()),
                pa.array([0, *map(docs.__getitem__, n)], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        groups.clear()

    seen = 0
    for batch in batches:
        for row in range(batch.num_rows):
            lang, source, text = (batch.column(i)[row].as_py() for i in range(3))
            found = terms(text)
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            n.update(found)
            docs.update(set(found))
            seen += len(n) - before
            if seen > held:
                yield from flush()
                seen = 0
    yield from flush()


def term_counts(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", held: int = HELD) -> DataFrame:
    """Rows (lang, source, term, n, docs): a term's places and documents in each group; a null term stands for the group."""

    def plain(c: str) -> Column:
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))

    read = df.select(plain(lang).alias("lang"), plain(source).alias("source"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    found = read.mapInArrow(lambda batches: _counts(batches, held), "lang string, source string, term binary, n bigint, docs bigint")
    # The tasks have summed up already; dealt by language and term, a term's sources lie together as well.
    return found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).select(
        "lang", "source", F.col("term").cast("string").alias("term"), "n", "docs")


def _share(count: str, total: str, smoothing: int) -> Column:
    """1 + floor(PARTS * (count + smoothing) / total), exactly; null without a total."""
    return F.expr(f"1 + (CAST({count} + {smoothing} AS DECIMAL(20, 0)) * CAST({PARTS} AS DECIMAL(10, 0))) div CAST(nullif({total}, 0) AS DECIMAL(20, 0))")


def tree_corrections(batches: Iterator[pa.RecordBatch], held: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Rows (lang, a, b, value) from rows (lang, n, path) sorted by language and path.

    A path is a list of (source, p, z) in the order of sources: its share of
    the term and its share of a term that it doesn't use. The branch of the
    tree that leads to the last row is all that is held. When a node is left,
    every term below it is known: their number times the difference that both
    sources' use makes, beyond what either alone makes, goes to the pair of
    the node's source and each ancestor's.
    """
    names: list[str] = []
    codes: dict[str, int] = {}
    keys: list[np.ndarray] = []
    values: list[np.ndarray] = []
    lang, size = None, 0
    branch = np.empty((0, 3), np.int64)
    below = np.empty(0, np.int64)

    def leave(depth: int) -> None:
        """Leave the nodes of the branch from ``depth`` on."""
        nonlocal size
        low = len(branch)
        if low <= depth:
            return
        # Terms that end at a node count for all nodes above it.
        below[depth:] = np.cumsum(below[depth:][::-1])[::-1]
        if depth:
            below[depth - 1] += below[depth]
        node, above = np.nonzero(np.tri(low, low, -1, dtype=bool)[depth:])
        node += depth
        (s, p, z), (t, q, y) = branch[node].T, branch[above].T
        keys.append(t << 32 | s)
        values.append(below[node] * (np.abs(p - q) - np.abs(p - y) - np.abs(q - z) + np.abs(z - y)))
        size += len(node)

    def merged() -> None:
        nonlocal size
        if keys:
            key, place = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, place, np.concatenate(values))
            keys[:], values[:], size = [key], [total], len(key)

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal size
        leave(0)
        merged()
        if size:
            word = pa.array(names, pa.string())
            yield pa.RecordBatch.from_arrays([
                pa.repeat(pa.scalar(lang, pa.string()), size), word.take(pa.array(keys[0] >> 32)), word.take(pa.array(keys[0] & 0xFFFFFFFF)),
                pa.array(values[0])], names=["lang", "a", "b", "value"])
        keys.clear(), values.clear(), names.clear(), codes.clear()
        size = 0

    for batch in batches:
        flat = batch.column(2).flatten()
        encoded = flat.field(0).dictionary_encode()
        words, at = encoded.dictionary.to_pylist(), encoded.indices.to_numpy(zero_copy_only=False)
        p, z = (flat.field(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        ends = np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
        own = None
        for row, (now, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if now != lang:
                yield from flush()
                branch, below, lang, own = branch[:0], below[:0], now, None
            if own is None:
                for w in words:
                    if codes.setdefault(w, len(names)) == len(names):
                        names.append(w)
                own = np.array([codes[w] for w in words], np.int64)
            part = slice(ends[row - 1] if row else 0, ends[row])
            path = np.stack([own[at[part]], p[part], z[part]], 1)
            most = min(len(path), len(branch))
            same = (path[:most] == branch[:most]).all(1)
            shared = most if same.all() else int(same.argmin())
            leave(shared)
            branch, below = path, np.concatenate([below[:shared], np.zeros(len(path) - shared, np.int64)])
            below[-1] += n
            if size > held:
                merged()
                if size > held // 2:
                    yield from _handed(lang, names, keys, values)
                    keys.clear(), values.clear()
                    size = 0
    yield from flush()


def _handed(lang: str, names: list[str], keys: list[np.ndarray], values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    word = pa.array(names, pa.string())
    yield pa.RecordBatch.from_arrays([
        pa.repeat(pa.scalar(lang, pa.string()), len(keys[0])), word.take(pa.array(keys[0] >> 32)), word.take(pa.array(keys[0] & 0xFFFFFFFF)),
        pa.array(values[0])], names=["lang", "a", "b", "value"])


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, a, b, value): what the terms of source a make against each source b of a block, b using none of them.

    Each pair's difference of zero shares, for all kept terms, is added by the source that is first.
    """
    for batch in batches:
        for row in batch.to_pylist():
            p = np.array([x["p"] for x in row["used"] or ()], np.int64)
            n = np.array([x["n"] for x in row["used"] or ()], np.int64)
            order = np.argsort(p)
            p, n = p[order], n[order]
            others = [x for x in row["others"] if x["source"] != row["source"]]
            z = np.array([x["z"] or 0 for x in others], np.int64)
            # The sum of |p - z| from the sums below and above z.
            i = np.searchsorted(p, z)
            many, sums = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * p)])
            total = (2 * many[i] - many[-1]) * z + sums[-1] - 2 * sums[i]
            apart = np.abs((row["z"] or 0) - z)
            first = np.array([row["source"].encode() < x["source"].encode() for x in others], bool)
            value = total - many[-1] * apart + np.where(first, (row["kept"] or 0) * apart, 0)
            yield pa.RecordBatch.from_arrays([
                pa.repeat(pa.scalar(row["lang"], pa.string()), len(others)), pa.repeat(pa.scalar(row["source"], pa.string()), len(others)),
                pa.array([x["source"] for x in others], pa.string()), pa.array(value, pa.int64())], names=["lang", "a", "b", "value"])


_PAIRS = "lang string, a string, b string, value bigint"


def audit_sources(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS,
                  smoothing: int = SMOOTHING, top: int = TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for every source of every language.

    Part ``pair``: the sum of the differences of both sources' term shares, for
    every other source. Part ``term``: the ``top`` terms whose share in the
    source exceeds the language's most. A term's row holds at most one entry
    for each source of its language, fewer than the pairs that are reported.
    """
    rows = durable(
        term_counts(df, text, lang, source).groupBy("lang", "term").agg(
            F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("uses"))
        .filter(F.col("term").isNull() | (F.col("docs") >= least_docs)).select("lang", "term", "total", "uses"))
    kept = rows.filter("term IS NOT NULL")
    uses = kept.select("lang", "term", "total", F.inline("uses"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_n"))
    own = uses.groupBy("lang", "source").agg(F.sum("n").alias("own_n"), F.count(F.lit(1)).alias("used"))
    named = rows.filter("term IS NULL").select("lang", F.explode("uses.source").alias("source"))
    groups = durable(
        named.join(langs, "lang", "left").join(own, ["lang", "source"], "left").select(
            "lang", "source", "kept", F.coalesce("used", F.lit(0)).alias("used"), (F.col("lang_n") + smoothing * F.col("kept")).alias("lang_size"),
            (F.coalesce("own_n", F.lit(0)) + smoothing * F.col("kept")).alias("size"))
        .withColumn("z", _share("0", "size", smoothing)))
    entries = groups.agg(F.sum("used")).first()[0] or 0
    shared = attach(uses, groups, ["lang", "source"], F.col("used"), max(1_000, entries // HOT_SHARE)).select(
        "lang", "term", "source", _share("n", "size", smoothing).alias("p"), "z", _share("total", "lang_size", smoothing).alias("q"))

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    more = shared.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = more.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)

    paths = durable(
        shared.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "z"))).alias("path"))
        .groupBy("lang", "path").agg(F.count(F.lit(1)).alias("n")).select("lang", "n", "path"))
    both = paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path").mapInArrow(tree_corrections, _PAIRS)

    blocks = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    others = groups.join(blocks, "lang").groupBy("lang", F.pmod(F.xxhash64("source"), "blocks").cast("int").alias("block")).agg(
        F.collect_list(F.struct("source", "z")).alias("others"))
    used = shared.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n")).groupBy("lang", "source").agg(
        F.collect_list(F.struct("p", "n")).alias("used"))
    against = groups.select("lang", "source", "z", "kept").join(used, ["lang", "source"], "left").join(blocks, "lang").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(others, ["lang", "block"])
    alone = against.select("lang", "source", "z", "kept", "used", "others").mapInArrow(_alone, _PAIRS)

    half = durable(alone.union(both))
    pairs = half.union(half.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")).groupBy("lang", "a", "b").agg(
        F.sum("value").alias("value"))
    paired = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value").withColumn(
        "rank", F.row_number().over(by_value))
    return paired.union(ranked)
