"""Spelling variants against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docmerge.llm import queries, variants


def one_edit(word, letters):
    """All texts one inserted, deleted or replaced code point away."""
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return ({a + b[1:] for a, b in cut if b} | {a + c + b[1:] for a, b in cut if b for c in letters} | {a + c + b for a, b in cut for c in letters}) - {word}


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 6:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def brute(rows):
    counts = brute_words(rows)
    letters = {c for w in counts for c in w}
    near = {w: sorted(one_edit(w, letters) & counts.keys(), key=lambda o: (-counts[o], o)) for w in counts}
    form = {w: o[0] if o and counts[o[0]] >= 5 * counts[w] else None for w, o in near.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def rows_of(frame):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()}


@settings(max_examples=400, deadline=None)
@given(st.text("abmny", max_size=9), st.text("abmny", max_size=9))
def test_near_is_one_edit(a, b):
    assert variants.is_near(a, b) == (b in one_edit(a, "abmny"))


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text("abmnyé", min_size=1, max_size=7), max_size=25))
def test_the_trie_meets_each_near_pair_once(words):
    trie = variants.Trie()
    for word in sorted(words):
        trie.add(word, 1)
    found = [(a, b) for a in words for b, _ in trie.search(a)]
    assert Counter(frozenset(p) for p in found) == Counter({frozenset((a, b)) for a in words for b in words if b in one_edit(a, "abmnyé")})


@settings(max_examples=200, deadline=None)
@given(st.text("abmnyé", min_size=1, max_size=7), st.text("abmnyé", min_size=1, max_size=7), st.integers(1, variants.GROUPS))
def test_a_pair_meets_in_one_cell(a, b, depth):
    if variants.is_near(a, b):
        one, two = variants.vector(a)[:depth], variants.vector(b)[:depth]
        cells = lambda path: [cell for cell, _, _ in variants.reached(path)]
        assert one == two or (variants.cell_name(two) in cells(one)) + (variants.cell_name(one) in cells(two)) == 1


def sample(seed=5):
    rng = np.random.default_rng(seed)
    stems = ["colour", "organise", "Mexiko", "straße", "analyse", "ÀÉcole", "aaaaaa", "aaaaaaa"]
    rows = []
    for i in range(400):
        words = []
        for _ in range(30):
            word = str(rng.choice(stems))
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                at = rng.integers(len(word))
                word = [word[:at] + word[at + 1 :], word[:at] + "xyé"[rng.integers(3)] + word[at:], word[:at] + "e" + word[at + 1 :]][rng.integers(3)]
            words.append(word)
        rows.append((i if i % 7 else None, " ".join(words) + " d'été 12a"))
    return [*rows, (1, None), (1, ""), (5, "colour " * 20_000), (5, "colour " * 20_000), (6, "b" * 5000 + " " + ("b" * 4999 + " ") * 6 + ("b" * 5000 + " ") * 6)]


@pytest.mark.parametrize("cell_words", [variants.CELL_WORDS, 60, 5])
def test_variants_against_brute_force(spark, cell_words):
    rows = sample()
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, word string, n int").repartition(5)
    got = variants.variants(docs, cell_words)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(rows)
    assert rows_of(got) == want
    assert any(r != f for f, r, *_ in want.values() if f)  # chains of forms


def test_words_that_share_one_cell(spark):
    """Anagrams fill a cell beyond its size at full depth; blocks give the same pairs."""
    rng = np.random.default_rng(1)
    words = {"".join(rng.permutation(list("abmnyz"))) for _ in range(400)}
    words |= {w[:3] + "n" + w[3:] for w in list(words)[:50]}
    frame = spark.createDataFrame([(w, 9) for w in words], "word string, n long")
    pairs = [frozenset((r["a"], r["b"])) for r in variants.near_pairs(frame, 7).collect()]
    assert Counter(pairs) == Counter({frozenset((a, b)) for a in words for b in one_edit(a, "abmnyz") & words})


def test_an_empty_table(spark):
    assert variants.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_the_query_over_the_whole_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(queries.op13_spelling_variants(spark, sf)) == brute(rows)
