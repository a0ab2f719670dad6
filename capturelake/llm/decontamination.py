"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Words are runs of letters, digits and underscores, lower-cased. Null and empty
texts hold no words and are clean; items without words match nothing; very long
texts are searched whole. Of equally good places the first is told. Rows that
share an id (a null id too) are judged together; repeated rows and items do no
harm; empty tables give an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

#: Word offsets that each fixed mask keeps; the others within its span may differ.
MASKS = ((0, 1, 3, 6, 8, 10), (0, 2, 4, 5, 9, 10), (0, 3, 4, 7, 8, 9))
SPAN = 11
#: Items of so many words up to the span get masks of their own, each without every third word, so that any one word may
#: differ (two where they fall on words that one mask leaves out); items of fewer words are found word for word only (one word in five is too much of them).
TOLERANT = 6
#: A passage overlaps an item if this share of the item's words agrees in place, or so many of a window of words.
ITEM_SHARE, WINDOW, WINDOW_WORDS = 0.7, 13, 11
#: Benchmark seeds (a hash, two numbers, and the item's word hashes joined once more) that may be broadcast.
BROADCAST_ROWS = 200_000
#: Flagged document ids that may be broadcast.
BROADCAST_IDS = 500_000


def word_hashes(text: Column) -> Column:
    """Hashes of the words in order."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(df: DataFrame, masks: Sequence[Sequence[int]]) -> DataFrame:
    """The columns of ``df`` with each place of its ``hashes`` (at), mask (its number) and seed, the hash of the words kept there.

    Places are rows before their seeds are hashed: that runs as compiled code,
    where functions over whole arrays are interpreted.
    """
    seeds = F.array(*[
        F.xxhash64(F.lit(n), *[F.get("hashes", F.col("at") + F.lit(o)) for o in mask]) for n, mask in enumerate(masks)])
    places = df.select(*df.columns, F.posexplode_outer("hashes").alias("at", "_"))
    return places.select(*df.columns, "at", F.posexplode_outer(seeds).alias("mask", "seed"))


# Places are exploded with posexplode_outer: for the plain form the optimizer adds a filter on the array's size, moves it
# to the scan, and there splits and hashes the whole text anew for every single word.


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks of an item of ``n`` words, no more than the span."""
    if n < TOLERANT:
        return [tuple(range(n))]
    return [tuple(i for i in range(n) if i % 3 != left_out) for left_out in range(3)]


def benchmark_seeds(items: DataFrame) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """Seeds (seed, item, item_at, n) of items (item, hashes) of n words, and all masks.

    An item no longer than the masks' span gets masks of its own length.
    """
    sized = items.withColumn("n", F.size("hashes")).filter("n > 0")
    # At most SPAN different lengths.
    short = sorted(r[0] for r in sized.filter(F.col("n") <= SPAN).select("n").distinct().collect())
    own_masks = [(n, m) for n in short for m in short_masks(n)]
    masks = [*MASKS, *(m for _, m in own_masks)]
    spans = F.array(*[F.lit(SPAN)] * len(MASKS), *[F.lit(n) for n, _ in own_masks])
    at = (
        _seeds(sized.select("item", "n", "hashes"), masks)
        .select("item", "n", "seed", F.col("at").alias("item_at"), F.get(spans, F.col("mask")).alias("span"))
    )
    own = F.when(F.col("n") <= SPAN, F.col("span") == F.col("n")).otherwise(F.col("span") == SPAN)
    return at.filter(own & (F.col("item_at") + F.col("span") <= F.col("n"))).select("seed", "item", "item_at", "n").distinct(), masks


def _beside(shift: Column) -> list[Column]:
    """Columns (doc, item, shift, part) of hits: part holds the document's words beside those of its item."""
    first = F.greatest(shift, F.lit(0))
    return [F.col("doc"), F.col("item"), shift.alias("shift"),
            F.slice("hashes", first + 1, F.least(F.size("hashes") - first, F.col("n") - (first - shift))).alias("part")]


def _verified(hits: DataFrame, share: float, window: int, window_words: int) -> DataFrame:
    """Hits (doc, item, shift, part, item_hashes) whose words agree in place often enough."""
    first, item_first = F.greatest("shift", F.lit(0)), F.greatest(-F.col("shift"), F.lit(0))
    equal = F.zip_with("part", F.slice("item_hashes", item_first + 1, F.size("part")), lambda a, b: F.when(a == b, 1).otherwise(0))
    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda s, x: s + x)

    best = F.array_max(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("equal") - window + 1, F.lit(1))), lambda i: total(F.slice("equal", i, window))))
    agreed = hits.withColumn("equal", equal).select(
        "doc", "item", first.alias("first_word"), F.size("item_hashes").alias("item_words"), total(F.col("equal")).alias("matched"),
        best.alias("window_matched"))
    return agreed.filter((F.col("matched") >= share * F.col("item_words")) | (F.col("window_matched") >= window_words))


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
             item_text: str = "text", share: float = ITEM_SHARE, window: int = WINDOW, window_words: int = WINDOW_WORDS,
             broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document and item that overlap: the place and word counts of the best overlap, and their number.

    Seeds of all documents are joined with those of the items. While the
    items' seeds are few, they are broadcast, and of a hit only the words
    beside the item's go on, once for all seeds that found them: no task holds
    a document once for each of its hits. Beyond that, seeds are joined by
    shuffle, and the places found fetch their documents' words.
    """
    items = benchmark.select(F.col(f"`{item}`").alias("item"), word_hashes(F.col(f"`{item_text}`")).alias("hashes")).distinct()
    words = items.select("item", F.col("hashes").alias("item_hashes"))
    seeds, masks = benchmark_seeds(items)
    seeds = durable(seeds)
    source = docs.select(F.col(f"`{key}`").alias("doc"), word_hashes(F.col(f"`{text}`")).alias("hashes"))
    every, shift = _seeds(source, masks), F.col("at") - F.col("item_at")
    if seeds.count() <= broadcast_rows:
        hits = every.join(F.broadcast(seeds), "seed").select(*_beside(shift)).distinct().join(F.broadcast(words), "item")
    else:
        places = every.select("doc", "at", "seed").join(seeds, "seed").select("doc", "item", shift.alias("shift"), "n").distinct()
        hits = places.join(source, places["doc"].eqNullSafe(source["doc"])).drop(source["doc"]).select(*_beside(F.col("shift"))).distinct().join(words, "item")
    found = _verified(hits, share, window, window_words)
    best = F.max(F.struct("matched", "window_matched", -F.col("first_word"), "item_words"))
    return found.groupBy("doc", "item").agg(best.alias("b"), F.count_distinct("first_word").alias("places")).select(
        F.col("doc").alias(key), F.col("item").alias(item), (-F.col("b")["col3"]).alias("first_word"),
        F.col("b.matched").alias("matched"), F.col("b.window_matched").alias("window_matched"),
        F.col("b.item_words").alias("item_words"), "places")


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without any overlap, unchanged."""
    flagged = durable(overlaps(docs, benchmark, key, text, **options).select(F.col(key).alias("__llm_id")).distinct())
    side = F.broadcast(flagged) if flagged.count() <= BROADCAST_IDS else flagged
    return docs.join(side, docs[key].eqNullSafe(side["__llm_id"]), "left_anti")
