"""Source divergence, byte-level BPE and hard negatives against plain versions."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from capturelake.llm import bpe, divergence
from capturelake.llm import hard_negatives as H

RNG = random.Random(5)


# -- source divergence ---------------------------------------------------------

def plain_audit(docs, least, top=50):
    groups, df = {}, Counter()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        lower = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        groups.setdefault((lang, source), Counter()).update(words)
        df.update((lang, w) for w in set(words))
    out = set()
    for lang in {k for k, _ in groups}:
        kept = sorted(w for (k, w), n in df.items() if k == lang and n >= least)
        own = {s: {w: c[w] for w in kept} for (k, s), c in groups.items() if k == lang}

        def shares(counts, kept=kept):
            total = sum(counts.values()) + 5 * len(kept)
            return {w: 1 + 10**9 * (counts[w] + 5) // total for w in kept}

        q = shares({w: sum(c[w] for c in own.values()) for w in kept})
        p = {s: shares(c) for s, c in own.items()}
        for s in own:
            pairs = [(sum(abs(p[s][w] - p[t][w]) for w in kept), t) for t in own if t != s]
            more = [(p[s][w] - q[w], w) for w in kept if own[s][w] > 0 and p[s][w] > q[w]]
            for part, rows, most in (("pair", pairs, None), ("term", more, top)):
                for rank, (v, item) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, v, rank))
    return out


def audited(spark, docs, **limits):
    df = spark.createDataFrame([(*d, i) for i, d in enumerate(docs)], "lang string, source string, text string, n long")
    rows = divergence.audit_sources(df, **limits).collect()
    got = {tuple(r) for r in rows}
    assert len(got) == len(rows)
    return got


def test_divergence_equals_brute_force(spark):
    words = ["alpha", "Beta", "gamma", "naïve", "日本", "Ünder", "zeta", "eta-theta", "x1y", "ß"]
    docs = []
    for _ in range(400):
        source = RNG.choice(["s1", "s1", "s1", "s2", "s3", "S3", "é", None])
        own = words[:4] if source == "s1" else words
        docs.append((RNG.choice(["en", "en", "de", None]), source, " ".join(RNG.choices(own, k=RNG.randint(0, 12)))))
    docs += [("en", "quiet", None), ("en", "hush", "12 34"), ("xx", "a", "rare"), ("xx", "b", ""), ("only", "one", "word")] + docs[:5]
    for limits in ({"least_docs": 30}, {"least_docs": 1, "top": 2}, {"least_docs": 1000}):
        assert audited(spark, docs, **limits) == plain_audit(docs, limits["least_docs"], limits.get("top", 50))
    assert audited(spark, []) == set()


def test_divergence_of_a_long_text(spark):
    long = " ".join(f"w{''.join(RNG.choices('abcdef', k=5))}" for _ in range(60_000))
    docs = [("en", "a", long), ("en", "b", long[:1000]), ("en", "a", "short")]
    assert audited(spark, docs, least_docs=1) == plain_audit(docs, 1)


def test_tree_hands_on_before_it_is_full():
    import pyarrow as pa

    kind = pa.list_(pa.struct([("source", pa.string()), ("p", pa.int64()), ("z", pa.int64())]))
    rows = sorted([[("s%d" % s, RNG.randint(5, 9), 4) for s in range(9) if RNG.random() < 0.6] or [("s0", 5, 4)] for _ in range(60)])
    paths = pa.array([[dict(zip(("source", "p", "z"), x, strict=True)) for x in row] for row in rows], kind)
    whole = pa.RecordBatch.from_arrays([pa.array(["l"] * 60), pa.array([2] * 60, pa.int64()), paths], names=["lang", "n", "path"])
    found = []
    for held, size in ((1_000_000, 60), (10, 7)):
        total = Counter()
        for out in divergence.tree_corrections(iter([whole.slice(i, size) for i in range(0, 60, size)]), held):
            for r in out.to_pylist():
                total[r["a"], r["b"]] += r["value"]
        found.append(total)
    want = Counter()
    for row in rows:
        for j, (s, p, z) in enumerate(row):
            for t, q, y in row[:j]:
                want[t, s] += 2 * (abs(p - q) - abs(p - y) - abs(q - z) + abs(z - y))
    assert {k: v for k, v in want.items() if v} == {k: v for k, v in found[0].items() if v} == {k: v for k, v in found[1].items() if v}


# -- byte-level BPE --------------------------------------------------------------

@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer(ranks):
    return bpe.Tokenizer(ranks, public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60))
def test_any_text_encodes_as_tiktoken_does(tokenizer, reference, text):
    assert tokenizer.encode(text).tolist() == reference.encode_ordinary(text)


def test_joined_tokens_and_long_words(tokenizer, reference, ranks):
    keys = list(ranks)
    for _ in range(1_500):
        text = b"".join(RNG.choices(keys, k=RNG.randint(1, 7))).decode("utf-8", "ignore")
        assert tokenizer.encode(text).tolist() == reference.encode_ordinary(text)
    for text in ("a" * 5_000, "".join(RNG.choices("abcdefgh", k=20_000)), "é日" * 3_000, ""):
        assert tokenizer.encode(text).tolist() == reference.encode_ordinary(text)
    assert tokenizer.encoder.lookahead < 16


def test_forgotten_states_change_nothing(ranks, reference):
    small = bpe.Tokenizer(ranks, public_tokenizers.PATTERN, states=40, pieces=20)
    for _ in range(60):
        text = " ".join("".join(RNG.choices("aeinrst", k=RNG.randint(1, 90))) for _ in range(10))
        assert small.encode(text).tolist() == reference.encode_ordinary(text)
    assert len(small.encoder.guesses) < 200


def test_small_vocabulary_against_the_merges():
    for seed in range(25):
        rng = random.Random(seed)
        ranks = {bytes([b]): b for b in range(256)}
        while len(ranks) < 256 + 30:
            a, b = rng.choice([k for k in ranks if k[0] in b"abc"]), rng.choice([k for k in ranks if k[0] in b"abc"])
            if set(a + b) <= set(b"abc") and len(a + b) < 9:
                ranks.setdefault(a + b, len(ranks))
        merges = bpe.Merges(ranks)
        encoder = bpe.Encoder(merges)
        for _ in range(200):
            piece = bytes(rng.choices(b"abcd", k=rng.randint(0, 25)))
            assert encoder.encode(piece) == list(encoder.tokens(piece)) == merges.merged(piece)


def test_streamed_decoding(ranks):
    vocabulary = bpe.Vocabulary(ranks)
    by_byte = [ranks[bytes([b])] for b in range(256)]
    cases = ["aé日🙂z", "", "ࠀ퟿\U00010000\U0010ffff"]
    for text in cases:
        ids = np.array([by_byte[b] for b in text.encode()], np.uint32)
        decoder = bpe.Decoder(vocabulary)
        parts = [decoder.feed(ids[i:i + 1]) for i in range(len(ids))] + [decoder.finish()]
        assert b"".join(parts) == text.encode() and decoder.well_formed
        assert all(p.decode() is not None for p in parts)
    for _ in range(300):
        data = bytes(RNG.choices([0x41, 0x80, 0xBF, 0xC0, 0xC3, 0xE0, 0xE2, 0xED, 0xF0, 0xF4, 0xF5, 0xA9], k=RNG.randint(0, 12)))
        ids = np.array([by_byte[b] for b in data], np.uint32)
        decoder = bpe.Decoder(vocabulary)
        parts = []
        while len(ids):
            n = RNG.randint(1, 3)
            parts.append(decoder.feed(ids[:n]))
            ids = ids[n:]
        assert b"".join([*parts, decoder.finish()]) == data
        try:
            data.decode()
            fine = True
        except UnicodeDecodeError:
            fine = False
        assert decoder.well_formed == fine


def test_texts_through_spark(spark, reference):
    texts = [None, "", "Grüße, world!  \n", "x" * 200_000, "same", "same", "naïve 日本 🙂"]
    df = spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens long")
    ids = bpe.encode_texts(df, ["doc_id"])
    assert {r["doc_id"]: r["ids"] for r in ids.collect()} == {i: reference.encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = {r["doc_id"]: (r["text"], r["well_formed"]) for r in bpe.decode_ids(ids, ["doc_id"]).collect()}
    assert back == {i: (t or "", True) for i, t in enumerate(texts)}
    rows = {r["doc_id"]: r for r in bpe.round_trip(df, ["doc_id"]).collect()}
    import hashlib
    for i, t in enumerate(texts):
        want = np.array(reference.encode_ordinary(t or ""), "<u4")
        assert rows[i]["n_tokens"] == len(want) and rows[i]["ids_sha256"] == hashlib.sha256(want.tobytes()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(df.limit(0), ["doc_id"]).count() == 0


# -- hard negatives ----------------------------------------------------------------

def plain_hard(rows, every=50, k=5, m=3):
    fit = []
    for id_, vector, label in rows:
        if id_ is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        row = (id_, label, tuple(int(np.floor(256 * x)) for x in vector))
        if row not in fit:
            fit.append(row)
    out = []
    for a in fit:
        if a[0] % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[2], b[2], strict=False)), b[0], b[1]) for b in fit if b is not a))
        for score, pid, _ in [r for r in scored if r[2] == a[1]][:k]:
            near = [r for r in scored if r[2] != a[1] and 50 * -score <= 100 * -r[0] <= 95 * -score][:m]
            out += [(a[0], pid, rank, r[1], -score, -r[0]) for rank, r in enumerate(near, 1)]
    return sorted(out)


def mined(spark, rows, **sizes):
    df = spark.createDataFrame([(i, v, lab, 1) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, row int")
    return sorted(tuple(r) for r in H.hard_negatives(df, **sizes).collect())


def test_hard_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        label = int(rng.integers(0, 4)) if i % 3 else 0
        vector = (rng.normal(size=6) * rng.choice([0.2, 1, 5]) + (label == 0)).astype(np.float32).tolist()
        rows.append((i, vector, label))
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 1), (350, [0.0] * 6, 0), (351, None, 0), (400, [1.0] * 6, None), (401, [None, 1.0], 0),
             (402, [float("nan")] * 6, 0), (403, [float("inf")] + [0.0] * 5, 1), (None, [1.0] * 6, 0), (404, [1.0, 2.0], 0), (405, [], 0),
             (0, rows[0][1], 0), (50, [9.0] * 6, 2), (450, [-3.0] * 6, 3)]
    want = plain_hard(rows, every=10)
    assert want
    for sizes in ({}, {"bucket": 16, "block": 4, "slice_": 2, "focus": 2}):
        assert mined(spark, rows, anchor_every=10, **sizes) == want
    assert mined(spark, rows[:1]) == [] and mined(spark, []) == []


def test_large_components_stay_exact(spark):
    rows = [(i, [float(x) for x in RNG.choices([4e6, -3e6, 1.1e6, 17.25], k=4)], i % 2) for i in range(60)]
    assert mined(spark, rows, anchor_every=10) == plain_hard(rows, every=10)


def test_buckets_prune():
    rng = np.random.default_rng(2)
    vectors = np.floor(rng.normal(size=(4_000, 16)) * np.exp(rng.normal(size=16)) * 100)
    lists = np.argsort(H.directions(vectors)[0], axis=0, kind="stable").T.astype(np.int32)
    ids = np.arange(4_000)
    bucket = H.Bucket(ids, ids, ids, vectors, lists)
    own, lengths = H.directions(vectors)
    met = 0
    for a in range(0, 4_000, 100):
        scores = (vectors @ vectors[a]).astype(np.int64)
        least = int(0.85 * lengths[a] * bucket.longest)
        found = bucket.candidates(own[a], float(lengths[a]), least)
        assert set(np.flatnonzero(scores >= least)) <= set(found.tolist())
        met += len(found)
    assert met < 40 * 4_000 / 4
    assert len(bucket.candidates(own[0], float(lengths[0]), int(2 * lengths[0] * bucket.longest))) == 0


def test_crowded_candidates_are_scored_together(monkeypatch):
    """Vectors that no range tells apart: candidates and scores are the same, whether lists or whole columns find them."""
    rng = np.random.default_rng(6)
    vectors = rng.integers(-90, 90, (600, 32)).astype(float)
    lists = np.argsort(H.directions(vectors)[0], axis=0, kind="stable").T.astype(np.int32)
    ids = np.arange(600)
    own, lengths = H.directions(vectors)
    bucket, single = (H.Bucket(ids, ids, ids, vectors, lists) for _ in range(2))
    bounds = [int(share * lengths[a] * bucket.longest) for a, share in enumerate(rng.uniform(0.05, 0.999, 200))]
    found = [bucket.candidates(own[a], float(lengths[a]), least) for a, least in enumerate(bounds)]
    scores = bucket.all_scores(vectors[:200], lengths[:200], found)
    assert max(map(len, found)) > 150 > min(map(len, found)) and bucket.columns
    monkeypatch.setattr(H, "CROWDED", 0)
    for a, least in enumerate(bounds):
        assert sorted(single.candidates(own[a], float(lengths[a]), least).tolist()) == sorted(found[a].tolist())
        assert scores[a].tolist() == single.scores(vectors[a], float(lengths[a]), found[a]).tolist()
    assert not single.columns and bucket.compared == single.compared


def test_few_buckets_are_dealt_to_several_tasks(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist(), i % 2) for i in range(300)], "vec_id long, embedding array<double>, label long")
    rows = H.prepared(df).select(F.lit(0).cast("bigint").alias("grp"), "*")
    blocks = H.buckets(rows.filter("id % 50 = 0"), 100, listed=False).withColumn("jobs", F.lit(None).cast(H._JOBS))
    index = H.buckets(rows, 10)
    few, all_ = (H.search(blocks, index, 5, False, slice_) for slice_ in (3, 64))
    taken = [int(re.search(r"FLOOR\(\(cast\(_n#\w+ as double\) / (\d+)", h._jdf.queryExecution().optimizedPlan().toString())[1]) for h in (few, all_)]
    pairs = blocks.count() * index.count()
    assert taken == [3, max(H.LEAST_SLICE, -(-pairs // int(spark.conf.get("spark.sql.shuffle.partitions"))))] and taken[1] < index.count()
    assert sorted(map(tuple, few.drop("tag").collect())) == sorted(map(tuple, all_.drop("tag").collect()))
