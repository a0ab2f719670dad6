"""Quality- and diversity-balanced choice of images per batch."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions.geometry import hamming
from ..session import durable
from .images import target_count
from .scale import attach, first_rows, group_sizes, measure, running_total
from .similarity import dedupe_images

# Default selection settings and penalties.
SELECTION = {
    "min_images": 6, "keep_ratio": 0.75, "min_quality": 0.35,
    "quality_weight": 0.65, "diversity_weight": 0.35, "near_duplicate": 3, "apart": 8,
}
CLOSE_PENALTY, WEAK_PENALTY = 0.08, 0.12
LOCAL_ROWS = 20_000


def _leftover_reason(quality: Column, gap: Column, p: dict) -> Column:
    return F.when(quality < p["min_quality"], "quality_below_threshold").when(
        gap < p["apart"], "low_diversity_lower_priority").otherwise("selection_limit_reached")


def _choose_local(frame: pd.DataFrame, p: dict) -> pd.DataFrame:
    """Greedy choice within one batch of bounded size; rows come with their position."""
    frame = frame.sort_values("_pos")
    q = frame["quality_score"].to_numpy(dtype=float)
    known = frame["_h"].notna().to_numpy()
    h = frame["_h"].fillna(0).to_numpy(dtype=np.int64).view(np.uint64)
    n, target = len(frame), int(frame["_target"].iloc[0])
    gap = np.full(n, 64, dtype=np.int64)
    rank = np.zeros(n, dtype=np.int64)
    reason = np.full(n, None, dtype=object)

    def take(i: int, why: str) -> None:
        rank[i], reason[i] = rank.max() + 1, why
        if known[i]:
            near = np.bitwise_count(h ^ h[i]).astype(np.int64)
            gap[known] = np.minimum(gap, near)[known]

    if target > 0 and n:
        take(0, "best_quality_seed")
    while 0 < rank.max(initial=0) < target and (rank == 0).any():
        score = p["quality_weight"] * q + p["diversity_weight"] * (gap / 64.0)
        score = np.where(gap < p["apart"], score - CLOSE_PENALTY, score)
        score = np.where(q < p["min_quality"], score - WEAK_PENALTY, score)
        best = int(np.argmax(np.where(rank == 0, score, -np.inf)))
        if q[best] < p["min_quality"] and rank.max() >= p["min_images"]:
            break
        take(best, f"quality_diversity_balance:min_hamming={gap[best]}")
    for i in range(n):
        if rank.max(initial=0) >= p["min_images"]:
            break
        if rank[i] == 0:
            take(i, "selected_to_meet_minimum")
    return frame.assign(_gap=gap.astype(float), selected_rank=rank, reason=reason)


def _choose_rounds(rows: DataFrame, keys: Sequence[str], p: dict) -> DataFrame:
    """The same choice for batches too large for one task.

    Every round is one aggregate that finds the best candidate per batch and
    one join that brings it back to update the gaps; at most ``max_images``
    rounds are needed.
    """
    keys = list(keys)
    c = F.col
    score = c("quality_score") * p["quality_weight"] + (c("_gap") / 64.0) * p["diversity_weight"]
    score = F.when(c("_gap") < p["apart"], score - CLOSE_PENALTY).otherwise(score)
    score = F.when(c("quality_score") < p["min_quality"], score - WEAK_PENALTY).otherwise(score)
    shape = measure(rows, keys)
    state = durable(rows.withColumns({
        "_gap": F.lit(64.0), "selected_rank": F.lit(0).cast("bigint"), "reason": F.lit(None).cast("string")}))

    def mark(state: DataFrame, picks: DataFrame) -> DataFrame:
        """``picks``: one row per batch with its size, _ppos, _ph, _prank, _pwhy."""
        hit = c("_ppos") == c("_pos")
        near = F.when(c("_h").isNotNull() & c("_ph").isNotNull(), hamming(c("_h"), c("_ph")).cast("double"))
        return durable(attach(state, picks, keys, c("_n"), shape=shape).select(
            *keys, "image_id", "quality_score", "_h", "_pos", "_target",
            F.coalesce(F.least(c("_gap"), near), c("_gap")).alias("_gap"),
            F.when(hit, c("_prank")).otherwise(c("selected_rank")).alias("selected_rank"),
            F.when(hit, c("_pwhy")).otherwise(c("reason")).alias("reason")))

    sizes = group_sizes(state, keys).withColumnRenamed("_rows", "_n")
    seed = state.filter((c("_pos") == 0) & (c("_target") > 0)).join(sizes, keys).select(
        *keys, "_n", c("_pos").alias("_ppos"), c("_h").alias("_ph"), F.lit(1).cast("bigint").alias("_prank"),
        F.lit("best_quality_seed").alias("_pwhy"))
    state = mark(state, seed)
    for step in range(2, p["max_images"] + 1):
        # Batches that stopped have a best rank below step - 1 and drop out here.
        best = state.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"), F.max("selected_rank").alias("_top"), F.max("_target").alias("_t"),
            F.max(F.when(c("selected_rank") == 0, F.struct(
                score.alias("s"), (-c("_pos")).alias("np"), c("_h").alias("h"), c("_gap").alias("g"),
                c("quality_score").alias("q")))).alias("_b"))
        go = best.filter(
            (c("_top") == step - 1) & (c("_top") < c("_t")) & c("_b").isNotNull()
            & ~((c("_b.q") < p["min_quality"]) & (c("_top") >= p["min_images"])))
        picks = durable(go.select(
            *keys, "_n", (-c("_b.np")).alias("_ppos"), c("_b.h").alias("_ph"), F.lit(step).cast("bigint").alias("_prank"),
            F.format_string("quality_diversity_balance:min_hamming=%d", c("_b.g").cast("int")).alias("_pwhy")))
        if picks.isEmpty():
            break
        state = mark(state, picks)

    counts = state.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(c("selected_rank") > 0).alias("_k"))
    spare = first_rows(state.filter(c("selected_rank") == 0), keys, [c("_pos")], p["min_images"], rank="_r")
    extra = durable(spare.join(counts, keys).filter(c("_k") + c("_r") <= p["min_images"]).select(
        *keys, "_n", c("_pos").alias("_ppos"), c("_h").alias("_ph"), (c("_k") + c("_r")).alias("_prank"),
        F.lit("selected_to_meet_minimum").alias("_pwhy")))
    for r in range(1, p["min_images"] + 1):
        picks = extra.filter(c("_prank") == r)
        if not picks.isEmpty():
            state = mark(state, picks)
    return state


def select_images(df: DataFrame, keys: Sequence[str] = ("project_id",), hash_col: str = "dhash", bits: int = 64,
                  local_rows: int = LOCAL_ROWS, *, max_images: int, **overrides) -> DataFrame:
    """Selection state, rank and reason for every candidate image.

    Input: keys, image_id, name, quality_score and a hash. Near-duplicates go
    first (in quality order), then images are taken one by one by weighted
    quality and distance to those taken before, up to ``max_images`` of a batch.
    """
    p = {**SELECTION, **overrides, "max_images": max_images}
    keys = list(keys)
    c = F.col
    order = [-c("quality_score"), F.lower("name"), c("name"), c("image_id")]
    unique = durable(dedupe_images(df, keys, order, hash_col, p["near_duplicate"], bits=bits))
    totals = unique.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_total"), F.count_if("kept").alias("_available")).select(
        *keys, target_count(c("_total"), c("_available"), p["keep_ratio"], p["min_images"], p["max_images"]).alias("_target"))
    kept = unique.filter("kept").select(*keys, "image_id", "name", "quality_score", c(hash_col).alias("_h"))
    ranked = running_total(kept, keys, order, "_pos").drop("name").join(totals, keys)

    schema = StructType([*[ranked.schema[k] for k in keys], ranked.schema["image_id"],
                         StructField("quality_score", DoubleType()), StructField("_h", LongType()),
                         StructField("_pos", LongType()), ranked.schema["_target"], StructField("_gap", DoubleType()),
                         StructField("selected_rank", LongType()), StructField("reason", StringType())])
    names = schema.fieldNames()

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        return _choose_local(frame, p)[names]

    if measure(ranked, keys).largest <= local_rows:
        chosen = ranked.groupBy(*keys).applyInPandas(choose, schema)
    else:
        ranked = durable(ranked)
        sizes = group_sizes(ranked, keys)
        small = ranked.join(sizes.filter(c("_rows") <= local_rows).select(*keys), keys, "left_semi")
        large = ranked.join(sizes.filter(c("_rows") > local_rows).select(*keys), keys, "left_semi")
        parts = [small.groupBy(*keys).applyInPandas(choose, schema), _choose_rounds(large, keys, p).select(*names)]
        chosen = reduce(DataFrame.unionByName, parts)

    picked = chosen.select(
        *keys, "image_id", F.when(c("selected_rank") > 0, c("selected_rank")).alias("selected_rank"),
        F.coalesce("reason", _leftover_reason(c("quality_score"), c("_gap"), p)).alias("_reason"))
    names_of = unique.select(*keys, c("image_id").alias("duplicate_of"), c("name").alias("_dup_name"))
    out = unique.join(picked, [*keys, "image_id"], "left").join(names_of, [*keys, "duplicate_of"], "left")
    return out.select(
        *keys, "image_id", "name", "quality_score",
        F.when(c("selected_rank").isNotNull(), "selected").otherwise("discarded").alias("selection_state"),
        "selected_rank",
        F.when(~c("kept"), F.concat(F.lit("near_duplicate_of:"), "_dup_name")).otherwise(c("_reason")).alias(
            "selection_reason"))
