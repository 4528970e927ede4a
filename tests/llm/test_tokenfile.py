"""Directly addressable codes: round trips, random access, and files against the tokenizer."""

import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docmerge.llm import queries, tokenfile

IDS = st.lists(st.one_of(st.integers(0, 255), st.integers(0, 50_256), st.integers(0, 2**32 - 1)), max_size=80)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), IDS), max_size=8))
def test_round_trip_and_random_access(documents):
    content = tokenfile.encode([i for i, _ in documents], [np.array(d, dtype="<u4") for _, d in documents])
    held = tokenfile.TokenFile.of(content)
    every = [t for _, d in documents for t in d]
    ids, starts = held.documents()
    assert ids == [i for i, _ in documents] and starts.tolist() == np.cumsum([0, *(len(d) for _, d in documents)]).tolist()
    assert [held.token(i) for i in range(len(every))] == every and held.tokens(0, len(every)).tolist() == every
    for start in range(0, len(every), 7):
        assert held.tokens(start, min(start + 11, len(every))).tolist() == every[start : start + 11]
    with pytest.raises(IndexError):
        held.token(len(every))


def test_long_files_read_few_bytes_for_a_token():
    rng = np.random.default_rng(3)
    every = rng.choice([5, 300, 70_000, 2**31], size=200_000).astype("<u4")
    content, asked = tokenfile.encode([1], [every]), []
    held = tokenfile.TokenFile(lambda at, size: asked.append(size) or content[at : at + size])
    assert struct.calcsize(tokenfile.HEADER) + 8 * 4 < 1000
    for at in rng.integers(0, len(every), 300).tolist():
        asked.clear()
        assert held.token(at) == every[at] and sum(asked) <= 4 * (2 + 8 + tokenfile.STRIDE // 8)
    for at in rng.integers(0, len(every) - 5000, 20).tolist():
        asked.clear()
        assert held.tokens(at, at + 5000).tolist() == every[at : at + 5000].tolist() and sum(asked) < 25_000
    assert len(content) < 4 * len(every)


def test_no_other_file_is_read():
    with pytest.raises(ValueError):
        tokenfile.TokenFile.of(b"x" * 100)


def expected(rows):
    """(doc_id, start, n_tokens, crc) by the tokenizers library, in ascending order of doc_id."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        found.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return found


@pytest.mark.parametrize("file_tokens", [1, 1000, 1 << 22])
def test_files_against_the_tokenizer(spark, file_tokens):
    rows = [(7, "words and more words"), (2**62, None), (None, "no id"), (3, ""), (-5, "é <|endoftext|> ü"), (1, "long " * 30_000), (8, "x" * 3000 + " " * 3000)]
    docs = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, text string, start string, path int").repartition(3)
    got = tokenfile.round_trip(docs, file_tokens)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == expected(rows)


def test_ties_repeated_rows_and_an_empty_table(spark):
    rows = [(1, "a")] * 40 + [(1, "b b b")] * 5 + [(None, None)] * 3 + [(0, "zero")]
    got = sorted(map(tuple, tokenfile.round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 7).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None] * 3 + [0] + [1] * 45
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in expected(rows))
    assert tokenfile.round_trip(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_an_existing_folder_is_refused(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        tokenfile.write_tokens(docs, str(tmp_path))


def test_the_query_over_the_whole_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op12_token_files(spark, sf).collect()), key=lambda r: r[1])
    assert got == expected(rows)
