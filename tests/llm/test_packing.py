"""Packing: an exact round trip, near-equal windows and no padding."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from capturelake.llm import packing

PLAIN = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def plain_ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [2]


def test_forms_give_the_ids_of_whole_texts():
    rng = random.Random(1)
    marks = ["a", "B", "é", "É", "ß", "İ", "Σ", "ς", ".", ",", "!", "'s", "'S", "'re", " ", "\n", " ", "1", "23", "<|endoftext|>",
             "<|ENDOFTEXT|>", "<|", "é", "$", "%%", "…", "»", "中", "\x00", "\x1f", "😀", "_", "ÿ", "ﬁ", "²", "word", "Tion,"]
    encoder = packing.Encoder(None)
    for _ in range(4000):
        text = "".join(rng.choice(marks) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(next(encoder.ids([text.encode()])), "<u4").tolist() + [2] == plain_ids(text), text


@pytest.mark.parametrize("cut", [True, False])
def test_round_trip(spark, cut):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghé", k=rng.randint(1, 9))) for _ in range(300)]
    rows = [(0, None), (1, ""), (2, "x" * 70_000), (3, " ".join(rng.choices(words, k=60_000)))]
    rows += [(i, " ".join(rng.choices(words, k=rng.randint(1, 900))) + ".") for i in range(4, 120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS start", "2 AS offset").repartition(2)
    got = packing.pack(docs, capacity=512, windows=8, cut=cut).collect()
    ids = {d: np.array(plain_ids(t), "<u4") for d, t in rows}
    at = dict.fromkeys(ids, 0)
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(ids[r["doc_id"]]) and len(part) == r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(part.tobytes())
        at[r["doc_id"]] += r["length"]
    assert at == {d: len(x) for d, x in ids.items()}
    sizes = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sizes.get(r["sequence_id"], 0)
        sizes[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(sizes.values()) <= 512
    if cut:
        assert all(n & (n - 1) == 0 for n in sizes.values())
    else:
        assert sum(sizes.values()) > 0.8 * 512 * len(sizes)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b"), (5, "a b"), (5, "a b")], "doc_id bigint, text string")
    assert packing.pack(docs).count() >= 3
    assert {r["doc_tokens"] for r in packing.pack(docs).collect()} == {3}
    assert packing.pack(docs.limit(0)).count() == 0


def test_differencing_deals_every_item_nearly_equally():
    rng = random.Random(4)
    sizes = [rng.randint(1, 500) for _ in range(300)]
    parts = packing.differencing(sizes, 10)
    assert sorted(i for p in parts for i in p) == list(range(300))
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) - min(sums) <= 2
    assert packing.differencing([], 3) == [] and packing.differencing([4], 3) == [[0]]


def test_windows_rise_where_nothing_may_be_cut():
    pieces = [packing.Piece(i, 0, 60) for i in range(10)]
    whole = packing.fill(pieces, 100, cut=False)
    assert len(whole) == 10 and all(len(w) == 1 for w in whole)
    cut = packing.fill(pieces, 100, cut=True)
    assert len(cut) == 6 and all(sum(p.length for p in w) == 100 for w in cut)


def test_windows_rise_before_anything_is_cut(monkeypatch):
    counts = []
    deal = packing.differencing
    monkeypatch.setattr(packing, "differencing", lambda sizes, n: counts.append(n) or deal(sizes, n))
    rng = random.Random(6)
    for largest in (40, 400, 3000, 4095):
        counts.clear()
        pieces = [packing.Piece(i, 0, rng.randint(largest // 2, largest)) for i in range(300)]
        windows = packing.fill(pieces, 4096, cut=True)
        tokens = sum(p.length for p in pieces)
        # No more windows than the tokens need, all but one full; the count rose until nothing exceeded the capacity.
        assert len(windows) == -(-tokens // 4096) and max(sum(p.length for p in w) for w in windows) <= 4096
        assert counts == sorted(set(counts)) and counts[0] * 4096 >= tokens
        spread = deal([p.length for p in pieces], counts[-1])
        assert max(sum(pieces[i].length for i in part) for part in spread) <= 4096
        assert len(counts) == 1 or max(sum(pieces[i].length for i in part) for part in deal([p.length for p in pieces], counts[-2])) > 4096
        by_doc = {}
        for p in (p for w in windows for p in w):
            by_doc.setdefault(p.doc, []).append((p.start, p.start + p.length))
        for doc, spans in by_doc.items():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] == pieces[doc].length
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
