"""SimHash components and near-copy groups against brute force."""

import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql.classic.dataframe import DataFrame

from capturelake.llm import components as components_module
from capturelake.llm import near_copies, simhash
from capturelake.llm.components import components

RNG = random.Random(7)
VOCABULARY = ["".join(RNG.choices("abcdefghij", k=RNG.randint(2, 9))) for _ in range(400)]


def prose(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


def edited(words, changes):
    out = list(words)
    for i in RNG.sample(range(len(out)), changes):
        out[i] = RNG.choice(VOCABULARY)
    return out


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace(
        "\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(n, linked):
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if label[i] != label[j] and linked(i, j):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def corpus():
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (3, "One"), (None, "one"), (4, "a b c"), (5, "É a b A")]
    for _ in range(12):
        base = prose(RNG.randint(30, 300))
        for _ in range(RNG.randint(1, 5)):
            rows.append((len(rows), " ".join(edited(base, RNG.choice([0, 0, 1, 2, 5])))))
    rows.append((len(rows), " ".join(prose(30_000))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr(
        "*", "'x' AS fp", "1 AS digest", "2 AS id", "'y' AS words", "3 AS row")


def test_components_equal_brute_force(spark):
    rows = corpus()
    expected = [plain_fingerprint(t) for _, t in rows]
    label = joined(len(rows), lambda i, j: bin(expected[i] ^ expected[j]).count("1") <= 4)
    ids = {k: min((rows[i][0] for i in range(len(rows)) if label[i] == k and rows[i][0] is not None), default=None) for k in label}
    want = sorted(((str(d), f"{f:016x}", ids[k]) for (d, _), f, k in zip(rows, expected, label, strict=True)), key=str)
    for tile in (simhash.TILE, 3):
        got = simhash.simhash_components(frame(spark, rows), tile=tile).collect()
        assert sorted(((str(r[0]), r[1], r[2]) for r in got), key=str) == want


def test_empty_table(spark):
    assert simhash.simhash_components(frame(spark, [])).count() == 0
    assert near_copies.drop_near_copies(frame(spark, [])).count() == 0


def test_trie_walk_in_a_crowd():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    ball = centre ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 44, (600, 3), dtype=np.uint64), axis=1)
    values = np.unique(np.concatenate([ball, (centre >> np.uint64(44) << np.uint64(44)) | rng.integers(0, 1 << 44, 600, dtype=np.uint64)]))
    got = simhash.trie_classes(values, np.array([0, len(values)]), 20, 4)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    assert got.tolist() == simhash._link(np.arange(len(values)), *np.nonzero(near)).tolist()
    saved, simhash.PAIRS = simhash.PAIRS, 50
    try:
        assert simhash.trie_classes(values, np.array([0, len(values)]), 20, 4).tolist() == got.tolist()
    finally:
        simhash.PAIRS = saved


def test_orderings_cover_four_bits():
    rng = np.random.default_rng(5)
    for _ in range(300):
        bits = rng.choice(64, 4, replace=False)
        hit = {next(k for k, s in enumerate(simhash.SHIFTS) if b >= s) for b in bits.tolist()}
        assert any(not hit & set(lead) for lead in simhash.LEADS)


def jaccard(a, b):
    x, y = (set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_one_of_each_group_stays(spark):
    rows = [(0, None), (1, ""), (2, None), (None, "alone here in the text of mine"), (None, "alone here in the text of mine"),
            (7, "same id but another text altogether"), (7, "and this one is the other text of it"), (7, "and this one is the other text of it")]
    for _ in range(10):
        base = prose(200)
        for k in range(RNG.randint(1, 4)):
            rows.append((100 + len(rows), " ".join(edited(base, min(k, 1)))))
    label = joined(len(rows), lambda i, j: jaccard(rows[i][1], rows[j][1]) >= 0.8)
    kept = near_copies.drop_near_copies(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "fp", "digest", "id", "words", "row"]
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(got) == len(set(label))
    groups = {}
    for (d, t), k in zip(rows, label, strict=True):
        groups.setdefault(k, []).append((d, t))
    for members in groups.values():
        inside = [g for g in got if g in members]
        assert len(inside) == 1
        assert inside[0][0] == min((d for d, _ in members if d is not None), default=None)


def marked(spark, docs):
    rows = [(bytearray(r["digest"]), *near_copies.marks(r["words"].encode())) for r in docs.collect()]
    return spark.createDataFrame([(d, f, m.tolist()) for d, f, m in rows], "digest binary, f array<bigint>, sig array<int>")


def test_group_over_many_tiles(spark):
    base = prose(300)
    rows = [(i, " ".join(edited(base, 1))) for i in range(40)] + [(99, " ".join(prose(300)))]
    docs = frame(spark, rows).selectExpr("unhex(sha2(text, 256)) AS digest", "text AS words")
    texts = marked(spark, docs)
    got = near_copies.near_copy_classes(docs, texts, "words", tile=6, piece=5).collect()
    assert len(got) == 40 and len({bytes(r["root"]) for r in got}) == 1


def classes_of(spark, texts, tile):
    docs = frame(spark, list(enumerate(texts))).selectExpr("unhex(sha2(text, 256)) AS digest", "text AS words")
    found = near_copies.near_copy_classes(docs, marked(spark, docs), "words", tile=tile, piece=tile).collect()
    roots = {bytes(r["digest"]): bytes(r["root"]) for r in found}
    named = [roots.get(hashlib.sha256(t.encode()).digest(), i) for i, t in enumerate(texts)]
    return [named.index(x) for x in named]


def test_star_and_disjoint_pairs_over_tiles(spark):
    base = prose(300)
    star = [" ".join(base)] + [" ".join(base[:at] + prose(26) + base[at + 26:]) for at in RNG.choices(range(274), k=70)]
    pairs = []
    for _ in range(40):
        own = base[:180] + prose(120)
        pairs += [" ".join(own), " ".join(edited(own, 3))]
    for texts in (star, pairs):
        want = joined(len(texts), lambda i, j: jaccard(texts[i], texts[j]) >= 0.8)
        assert classes_of(spark, texts, 4) == want


def test_least_hashes_estimate_similarity():
    rng = np.random.default_rng(9)
    near = []
    for _ in range(400):
        both = rng.integers(0, 1 << 63, 240, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, 30, dtype=np.uint64)])) for _ in range(2))
        x, y = near_copies.least_hashes(a), near_copies.least_hashes(b)
        bands = (x == y).reshape(near_copies.BANDS, near_copies.ROWS).all(1)
        near.append((bands.any(), (x == y).sum()))
    # Of similarity 0.8: one in 5000 shares no band.
    assert sum(found for found, _ in near) >= 398 and sum(n >= near_copies.LEAST_EQUAL for _, n in near) >= 398
    assert abs(np.mean([n for _, n in near]) / 64 - 0.8) < 0.01
    long = rng.integers(0, 1 << 63, 9_000, dtype=np.uint64)
    assert near_copies.least_hashes(long).tolist() == np.minimum.reduce([
        near_copies.least_hashes(p).view(np.uint32) for p in (long[:4_000], long[4_000:])]).view(np.int32).tolist()
    assert len(set(near_copies.least_hashes(np.empty(0, np.uint64)).tolist())) == 1


def test_every_kind_of_edit_is_found(spark):
    kinds = {
        "swap": lambda w: edited(w, len(w) // 60),
        "truncate": lambda w: w[:len(w) - len(w) * 18 // 100],
        "append": lambda w: w + prose(len(w) * 20 // 100),
        "insert": lambda w: w[:len(w) // 2] + prose(len(w) * 18 // 100) + w[len(w) // 2:],
    }
    rows, of = [], {}
    for kind, edit in kinds.items():
        for _ in range(25):
            base = prose(RNG.randint(300, 500))
            of[len(rows) + 1] = kind
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(edit(base)))]
    assert all(jaccard(rows[i - 1][1], rows[i][1]) >= 0.8 for i in of)
    kept = {r["doc_id"] for r in near_copies.drop_near_copies(frame(spark, rows)).collect()}
    missed = [of[i] for i in sorted(of) if i in kept]
    assert not missed and len(kept) == 100


def test_similar_sets():
    sets = [np.array(s, np.uint64) for s in ([], [], [1], [1, 2, 3, 4], [1, 2, 3, 4, 5], [9])]
    near = near_copies.similar(sets)
    want = [[(len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b))) for b in map(list, sets)] for a in map(list, sets)]
    assert near.tolist() == want


def test_pairs_of_tiles_equal_the_matrix():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, n)).astype(np.uint64) for n in (0, 0, 1, *rng.integers(1, 90, 40))]
    x, y = np.triu_indices(len(sets), 1)
    for least in (0.3, 0.8, 1.0):
        assert near_copies.similar_pairs(sets, x, y, least).tolist() == near_copies.similar(sets, least)[x, y].tolist()
    assert near_copies.similar_pairs(sets, x[:0], y[:0]).tolist() == []


def test_components_of_hubs_and_chains(spark):
    rng = random.Random(11)
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000), (None, 5), (3000, 1030)]
    edges += [(rng.randrange(4000, 4100), rng.randrange(4000, 4100)) for _ in range(80)] + [(399, 9000), (9000, 9001)]
    names = sorted({x for e in edges for x in e if x is not None and None not in e and e[0] != e[1]})
    place = {x: i for i, x in enumerate(names)}
    label = np.arange(len(names))
    pairs = [(place[a], place[b]) for a, b in edges if a is not None and b is not None and a != b]
    label = simhash._link(label, np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "x bigint, y bigint")).collect()}
    assert got == {x: names[label[place[x]]] for x in names}
    assert components(spark.createDataFrame([], "x bigint, y bigint")).count() == 0


def test_a_round_over_few_edges_takes_few_tasks(spark):
    rng = random.Random(5)
    edges = [(k, k // 2) for k in range(1, 400)] + [(1_000, 1_000 + k) for k in range(1, 300)] + [
        (rng.randrange(2_000, 2_400), rng.randrange(2_000, 2_400)) for _ in range(150)]
    frame_ = spark.createDataFrame(edges, "a bigint, b bigint")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        now = components_module._round(frame_.filter("a > b"), len(edges), len(edges))
        assert now.rdd.getNumPartitions() <= components_module.FEW_PARTS
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    small = {tuple(r) for r in components(frame_).collect()}
    assert small == {tuple(r) for r in components(frame_, few=0).collect()}
    assert {(399, 0), (1_299, 1_000)} <= small


def test_near_texts_make_rows_by_texts_not_by_pairs(spark, monkeypatch):
    base, n = prose(300), 130
    texts = [" ".join(base[:at] + prose(22) + base[at + 22:]) for at in (RNG.randrange(278) for _ in range(n))]
    want = joined(n, lambda i, j: jaccard(texts[i], texts[j]) >= 0.8)
    made, plain = [], DataFrame.mapInArrow

    def counted(df, func, schema, *args, **kwargs):
        rows = spark.sparkContext.accumulator(0)
        made.append(rows)

        def run(batches):
            for batch in func(batches):
                rows.add(batch.num_rows)
                yield batch

        return plain(df, run, schema, *args, **kwargs)

    monkeypatch.setattr(DataFrame, "mapInArrow", counted)
    docs = frame(spark, list(enumerate(texts))).selectExpr("unhex(sha2(text, 256)) AS digest", "text AS words")
    sigs, none = marked(spark, docs).select("digest", "sig"), spark.createDataFrame([], "digest binary, root binary")

    def found(piece):
        rows = near_copies.linked_by_bands(docs, sigs, none, "words", piece=piece).collect()
        roots = {bytes(r["digest"]): bytes(r["root"]) for r in rows}
        named = [roots.get(hashlib.sha256(t.encode()).digest(), i) for i, t in enumerate(texts)]
        return [named.index(x) for x in named]

    # Most of the 8 385 pairs agree in 40 of 64 least hashes; a text may come once for each of its bands.
    assert found(256) == want
    assert max(rows.value for rows in made) <= near_copies.BANDS * n
    # Parts of a piece, by its shingles, give the same classes.
    monkeypatch.setattr(near_copies, "PIECE_SHINGLES", 2_000)
    for piece in (256, 20):
        assert found(piece) == want
