import random

import pytest
from pyspark.sql import functions as F

from capturelake.operators import selection as Sel
from capturelake.operators import similarity as S


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def batch(n, seed, bits=64, groups=2):
    """Random hashes with planted near-duplicates and copies."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.6:
            base = rnd.choice(rows)[2] & ((1 << bits) - 1)
            for _ in range(rnd.randrange(0, 5)):
                base ^= 1 << rnd.randrange(bits)
        else:
            base = rnd.getrandbits(bits)
        name = f"{rnd.choice('ABab')}{rnd.randrange(1000):03d}_{i}.png"
        rows.append((rnd.randrange(groups), i, base, name, f"sha{base % 97}-{base}"))
    return [(k, i, signed(h) if bits == 64 else h, name, sha) for k, i, h, name, sha in rows]


SCHEMA = "project_id long, image_id long, dhash long, name string, sha string"


def distance(a, b):
    return bin((a ^ b) & ((1 << 64) - 1)).count("1")


def brute_pairs(rows, radius):
    nodes = {(k, h) for k, _, h, _, _ in rows}
    return sorted((k, a, b, distance(a, b)) for k, a in nodes for j, b in nodes
                  if j == k and a < b and distance(a, b) <= radius)


@pytest.mark.parametrize("radius", [1, 2, 3, 6])
def test_radius_join_equals_brute_force(spark, radius):
    rows = batch(150, radius)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute_pairs(rows, radius)
    got = S.hamming_join(df, ["project_id"], "dhash", radius)
    assert sorted(tuple(r) for r in got.collect()) == want and want
    crowded = S.hamming_join(df, ["project_id"], "dhash", radius, tile_rows=16, bucket_rows=1)
    assert sorted(tuple(r) for r in crowded.collect()) == want


@pytest.mark.parametrize("radius", [4, 6, 8])
def test_wide_radius_forms_no_tile(spark, monkeypatch, radius):
    rows = batch(150, radius + 20)
    want = brute_pairs(rows, radius)
    monkeypatch.setattr(S, "_tile_join", lambda *a: pytest.fail("a tile was formed"))
    got = S.hamming_join(spark.createDataFrame(rows, SCHEMA), ["project_id"], "dhash", radius)
    assert sorted(tuple(r) for r in got.collect()) == want and any(d > 3 for *_, d in want)


@pytest.mark.parametrize(("radius", "bits"), [(2, 16), (4, 16), (8, 16), (12, 64), (3, 4), (4, 4)])
def test_radius_join_over_short_hashes(spark, radius, bits):
    rows = batch(60, radius, bits)
    got = S.hamming_join(spark.createDataFrame(rows, SCHEMA), ["project_id"], "dhash", radius, bits)
    assert sorted(tuple(r) for r in got.collect()) == brute_pairs(rows, radius)


def test_growing_radius_spares_tiles(spark, monkeypatch):
    """Hashes five to nine bits from their nearest one find it in a crowded group without any tile."""
    rnd = random.Random(5)
    rows = []
    for _ in range(40):
        base, other = rnd.getrandbits(64), 0
        for bit in rnd.sample(range(64), rnd.randrange(5, 10)):
            other |= 1 << bit
        rows += [(1, len(rows) + n, signed(h), "", "") for n, h in enumerate((base, base ^ other))]
    want = {h: min(distance(h, g) for _, m, g, _, _ in rows if m != i) for _, i, h, _, _ in rows}
    monkeypatch.setattr(S, "_tiles", lambda *a: pytest.fail("a tile was formed"))
    got = S.nearest_hamming(spark.createDataFrame(rows, SCHEMA), ["project_id"], "dhash", tile_rows=10).collect()
    assert {r.hash: r.nearest for r in got} == want


def test_nearest_over_tiles(spark):
    rows = batch(120, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for k, i, h, _, _ in rows:
        others = [distance(h, g) for j, m, g, _, _ in rows if j == k and m != i]
        want[(k, h)] = min(others) if others else None
    for size in (S.TILE_ROWS, 10):
        got = S.nearest_hamming(df, ["project_id"], "dhash", tile_rows=size).collect()
        assert {(r.project_id, r.hash): r.nearest for r in got} == want


def test_no_tile_where_bands_resolve_all(spark, monkeypatch):
    rows = [(1, i, v, f"{i}.png", "") for i, v in enumerate([0, 1, 7, 1 << 40, 1 << 40 | 3, 5, 5])]
    monkeypatch.setattr(S, "_tiles", lambda *a: pytest.fail("a tile was formed"))
    got = {r.hash: r.nearest for r in S.nearest_hamming(spark.createDataFrame(rows, SCHEMA), ["project_id"], "dhash").collect()}
    assert got == {0: 1, 1: 1, 7: 1, 1 << 40: 1, 1 << 40 | 3: 2, 5: 0}


def test_long_chain_settles_in_few_rounds(spark, monkeypatch):
    edges = spark.range(10_000).selectExpr("1L AS project_id", "id AS src", "id + 1 AS dst")
    rounds = []
    measured = S.measure
    monkeypatch.setattr(S, "measure", lambda *a: rounds.append(1) or measured(*a))
    gone = {r.node for r in S._rejected_nodes(edges, ["project_id"], 2_500).collect()}
    assert gone == set(range(1, 10_001, 2)) and len(rounds) <= 5


def test_pair_counts_from_copies(spark):
    rows = batch(100, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    listed = S.similar_pairs(df, ["project_id"], "dhash", 2).groupBy("project_id").count()
    counted = S.similar_pair_counts(df, ["project_id"], "dhash", 2)
    assert {r[0]: r[1] for r in listed.collect()} == {r.project_id: r.similar_pairs for r in counted.collect()}


def greedy(rows, radius, warn):
    """One image after the other, as a person would sort them."""
    out = {}
    for k in {r[0] for r in rows}:
        kept, digests = [], {}
        for _, i, h, name, sha in sorted((r for r in rows if r[0] == k), key=lambda r: (r[3].lower(), r[3], r[1])):
            if sha in digests:
                out[i] = (False, digests[sha], "duplicate_exact")
                continue
            near = min(((distance(h, g), n) for n, (_, g) in enumerate(kept)), default=None)
            if near and near[0] <= radius:
                out[i] = (False, kept[near[1]][0], "duplicate_near")
                continue
            view = near and near[0] <= warn
            out[i] = (True, kept[near[1]][0] if view else None, "similar_view" if view else None)
            kept.append((i, h))
            digests[sha] = i
    return out


@pytest.mark.parametrize("local_edges", [10**6, 3])
def test_dedupe_equals_sequential_greedy(spark, local_edges):
    for seed in (1, 2):
        rows = batch(140, seed)
        df = spark.createDataFrame(rows, SCHEMA)
        got = S.dedupe_images(df, ["project_id"], [F.lower("name"), F.col("name"), F.col("image_id")], "dhash", 2, 6,
                              "sha", local_edges=local_edges)
        found = {r.image_id: (r.kept, r.duplicate_of, r.duplicate_kind) for r in got.collect()}
        assert found == greedy(rows, 2, 6)


def choose(rows, p):
    """Reference answer for the selection of one batch; rows are (id, name, quality, hash)."""
    order = sorted(rows, key=lambda r: (-r[2], r[1].lower(), r[1], r[0]))
    kept, out = [], {}
    for r in order:
        near = min(((distance(r[3], o[3]), n) for n, o in enumerate(kept)), default=None)
        if near and near[0] <= p["near_duplicate"]:
            out[r[0]] = ("discarded", None, f"near_duplicate_of:{kept[near[1]][1]}")
        else:
            kept.append(r)
    target = min(max(p["min_images"], max(1, round(len(rows) * p["keep_ratio"]))), p["max_images"], len(kept))
    taken, left = [], list(kept)

    def gap(r):
        return min((distance(r[3], o[3]) for o in taken), default=64)

    def take(r, why):
        taken.append(r)
        left.remove(r)
        out[r[0]] = ("selected", len(taken), why)

    if target:
        take(left[0], "best_quality_seed")
    while left and len(taken) < target:
        def value(r):
            v = p["quality_weight"] * r[2] + p["diversity_weight"] * (gap(r) / 64.0)
            return v - 0.08 * (gap(r) < p["apart"]) - 0.12 * (r[2] < p["min_quality"])
        best = max(left, key=value)
        if best[2] < p["min_quality"] and len(taken) >= p["min_images"]:
            break
        take(best, f"quality_diversity_balance:min_hamming={gap(best)}")
    while left and len(taken) < p["min_images"]:
        take(left[0], "selected_to_meet_minimum")
    for r in left:
        out[r[0]] = ("discarded", None, "quality_below_threshold" if r[2] < p["min_quality"] else
                     "low_diversity_lower_priority" if gap(r) < p["apart"] else "selection_limit_reached")
    return out


@pytest.mark.parametrize("local_rows", [20_000, 5])
def test_selection_equals_stepwise_choice(spark, local_rows):
    rnd = random.Random(5)
    p = {**Sel.SELECTION, "max_images": 9, "min_images": 4}
    rows = [(k, i, h, name, round(rnd.random(), 3)) for k, i, h, name, _ in batch(60, 11)]
    df = spark.createDataFrame(rows, "project_id long, image_id long, dhash long, name string, quality_score double")
    got = Sel.select_images(df, local_rows=local_rows, max_images=9, min_images=4).collect()
    want = {}
    for k in {r[0] for r in rows}:
        want |= choose([(i, n, q, h) for g, i, h, n, q in rows if g == k], p)
    assert {r.image_id: (r.selection_state, r.selected_rank, r.selection_reason) for r in got} == want


def test_selection_keeps_one_of_two_copies(spark):
    rows = [(1, 1, "a.jpg", 0.494, 5), (1, 2, "a_copy.jpg", 0.494, 5), (1, 3, "b.jpg", 0.494, 1 << 40 | 0xFFFF),
            (1, 4, "c.jpg", 0.494, 0xFF << 48)]
    df = spark.createDataFrame(rows, "project_id long, image_id long, name string, quality_score double, dhash long")
    got = {r.name: r for r in Sel.select_images(
        df, min_images=2, max_images=3, keep_ratio=0.6, min_quality=0.0).collect()}
    assert got["a_copy.jpg"].selection_reason == "near_duplicate_of:a.jpg"
    assert 2 <= sum(r.selection_state == "selected" for r in got.values()) < 4


def test_pairs_of_tiles_are_tasks_of_their_own(spark, monkeypatch):
    """A group of some tiles is compared in as many tasks as there are pairs of tiles, without wider bands."""
    rows = batch(60, 9)
    seen = []
    spread = S._spread
    monkeypatch.setattr(S, "_spread", lambda met, counted: seen.append((counted.count(), spread(met, counted).rdd.getNumPartitions())) or spread(met, counted))
    radii = []
    bands = S._band_pairs
    monkeypatch.setattr(S, "_band_pairs", lambda nodes, keys, radius, *a, **k: radii.append(radius) or bands(nodes, keys, radius, *a, **k))
    S.nearest_hamming(spark.createDataFrame(rows, SCHEMA), ["project_id"], "dhash", tile_rows=20).collect()
    assert seen and all(n == tasks and n > 2 for n, tasks in seen) and radii == [S.BAND_RADIUS]


@pytest.mark.parametrize("radius", [2, 3])
def test_short_hashes_meet_in_tiles(spark, monkeypatch, radius):
    """Buckets of 16-bit hashes hold so much of a group that all pairs of it are cheaper."""
    monkeypatch.setattr(S, "_band_pairs", lambda *a, **k: pytest.fail("a bucket was formed"))
    rows = batch(80, 3, 16)
    got = S.hamming_join(spark.createDataFrame(rows, SCHEMA), ["project_id"], "dhash", radius, 16)
    assert sorted(tuple(r) for r in got.collect()) == brute_pairs(rows, radius)


@pytest.mark.parametrize(("bits", "tile_rows"), [(16, 8_192), (16, 40), (64, 40)])
def test_judged_pairs_against_all_pairs(spark, bits, tile_rows):
    """Pairs of several tiles, with copies, are found and judged like one by one, and without shuffling them."""
    rnd = random.Random(bits)
    rows = [(k, i, h, rnd.getrandbits(56), [rnd.randrange(300) for _ in range(64)]) for k, i, h, _, _ in batch(150, 3, bits)]
    df = spark.createDataFrame(rows, "project_id int, image_id long, phash long, dhash long, px array<int>")
    expected = sorted(
        (a[0], min(a[1], b[1]), max(a[1], b[1]), distance(a[2], b[2]), distance(a[3], b[3]),
         sum(abs(x - y) <= 24 for x, y in zip(a[4], b[4], strict=True)))
        for n, a in enumerate(rows) for b in rows[:n] if a[0] == b[0] and distance(a[2], b[2]) <= 3)
    got = S.judged_pairs(df, ["project_id"], 3, 24, tile_rows=tile_rows)
    assert sorted(tuple(r) for r in got.collect()) == expected and len(expected) > 30
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert S.judged_pairs(df.limit(0), ["project_id"], 3, 24).count() == 0
