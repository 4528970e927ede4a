"""Packing: exact round trips, gapless sequences, few of them."""

import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docmerge.llm import packing

DOCS = "doc_id long, text string, length int"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=60))
def test_ids_are_those_of_the_tokenizer(tokenizer, text):
    assert packing.token_ids(text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "", "it's 12\n\n  x", " " * 5000, "x" * 5000, "\U0001f600é́", "<|endoftext|>", "a\r\n\tb   "])
def test_special_texts(tokenizer, text):
    assert packing.token_ids(text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def check(rows, tokens, documents=10**9, attention=10**18):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= tokens and len(held) <= documents and sum(n * n for _, n in held) <= attention
    return len(bins)


def test_pieces_round_trip(spark, tokenizer):
    texts = [None, "", "short", "word " * 3000, "ünï " * 900, "x" * 1023, None]
    docs = spark.createDataFrame([(i if i < 6 else None, t, 9) for i, t in enumerate(texts)] + [(2, "short", 9)], DOCS)
    rows = packing.token_pieces(docs, with_ids=True).collect()
    for i, text in enumerate(texts[:6]):
        own = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in rows if r["doc_id"] == i})
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert [t for *_, part in own for t in part] == ids
        assert [s for _, s, *_ in own] == list(np.cumsum([0, *(n for _, _, n, *_ in own)])[:-1])
        assert all(n == 1024 for _, _, n, *_ in own[1:]) and all(zlib.crc32(np.array(p, "<u4").tobytes()) == c for *_, c, p in own)
    packed = packing.pack(packing.token_pieces(docs)).collect()
    assert len(packed) == len(rows) and sum(r["doc_id"] == 2 for r in packed) == 2
    assert check(packed, 1024) <= math.ceil(sum(r["length"] for r in rows) / 1024) + 1
    assert packing.pack(packing.token_pieces(docs.limit(0))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), min_size=1, max_size=40), st.sampled_from(["norm", "dot"]), st.sampled_from([(64, 10**6, 10**6), (64, 3, 4096), (64, 64, 4096 + 100), (64, 5, 4500)]))
def test_plan_holds_every_capacity(counts, score, limits):
    capacity = packing.Capacity(*limits[:2], max(limits[2], 4096), score=score)
    made = packing.plan(counts, capacity)
    lengths = np.concatenate([np.full(n, k) for k, n in counts.items()])
    ranks = np.concatenate([np.arange(n) for n in counts.values()])
    sequence, offset = made.place(lengths, ranks)
    rows = [{"sequence_id": s, "offset": o, "length": n} for s, o, n in zip(sequence.tolist(), offset.tolist(), lengths.tolist())]
    assert check(rows, *limits[:2], max(limits[2], 4096)) == made.sequences


def greedy(lengths, size):
    """Plain best-fit decreasing."""
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [(f, i) for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits)[1]] -= n
        else:
            free.append(size - n)
    return len(free)


def test_plan_is_as_tight_as_best_fit():
    rng = np.random.default_rng(7)
    for shape in (rng.integers(1, 1024, 800), np.clip(rng.lognormal(5, 1, 1500), 1, 1024).astype(int), rng.integers(300, 600, 500), np.full(100, 341)):
        counts = dict(zip(*(x.tolist() for x in np.unique(shape, return_counts=True))))
        made = packing.plan(counts)
        assert made.sequences <= max(greedy(shape.tolist(), 1024), math.ceil(shape.sum() / 1024)) * 1.01 + 1


def test_a_piece_too_long_is_an_error():
    with pytest.raises(ValueError):
        packing.plan({10: 1}, packing.Capacity(tokens=8))
