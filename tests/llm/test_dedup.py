"""Near-duplicates of vectors and texts, and connected components, against brute force."""

import random

import numpy as np
import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from docmerge.llm import near, simhash
from docmerge.llm.components import components
from docmerge.llm.unions import find, unite

DOCS = "doc_id long, text string, lang string"


def brute_components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(100, i) for i in range(60)],
    [(i, (i * 7 + 3) % 97) for i in range(97)], [(5, 3), (3, 5), (5, 3), (9, 8)], [(2 * i, 2 * i + 3) for i in range(30)],
])
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    kept = [e for e in edges if e[0] != e[1]]
    assert got == brute_components({n for e in kept for n in e}, kept)


def test_unions():
    parent = np.arange(10)
    unite(parent, np.array([9, 3, 5]), np.array([3, 1, 5]))
    assert find(parent, np.array([9, 3, 1, 5])).tolist() == [1, 1, 1, 5]


def brute_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbÄ \n\u00a0\u2003\x1c", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text) % 2**64 == brute_fingerprint(text)


def brute_groups(rows):
    prints = {i: brute_fingerprint(t) for i, t in rows}
    edges = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    return brute_components(prints, edges)


def test_simhash_groups(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (6, "one two")]
    for group in range(12):
        text = rng.choices(words, k=400)
        for copy in range(rng.randint(1, 6)):
            near_text = list(text)
            for _ in range(copy % 3):
                near_text[rng.randrange(400)] = rng.choice(words)
            rows.append((100 * group + 10 + copy, " ".join(near_text)))
    rows.append((7000, "long " * 120_000))
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOCS)
    want = brute_groups(rows)
    for leaf in (4, 4096):
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, leaf=leaf).collect()}
        assert got == want
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10_000))
def test_trees_lose_no_link(spark, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(-(2**63), 2**63 - 1, 300)
    dense = [int(base[0]) ^ sum(1 << int(b) for b in rng.choice(63, 5, replace=False)) for _ in range(300)]  # one ball
    flipped = [int(v) ^ sum(1 << int(b) for b in rng.choice(63, k, replace=False)) for v in base[:150] for k in (1, 3, 4)]
    values = sorted({*map(int, base), *dense, *flipped})
    edges = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) % 2**64).bit_count() <= 3]
    got = components(simhash.near_links(spark.createDataFrame([(v,) for v in values], "fingerprint long"), leaf=16))
    want = {n: c for n, c in brute_components(values, edges).items() if any(n in e for e in edges)}
    assert {r["node"]: r["component"] for r in got.collect()} == want


def test_simhash_edges(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    docs = spark.createDataFrame([(None, "a b c", "x", 1), (3, "a b c", "x", 2), (3, "a b c", "x", 2), (2, "a b c", "x", 3), (None, "zz", "x", 4)], DOCS + ", fingerprint int")
    found = simhash.near_duplicates(docs)
    assert {(r["doc_id"], r["component_id"]) for r in found.collect()} == {(None, 2), (3, 2), (2, 2), (None, None)}
    assert sorted((r["doc_id"] or 0) for r in simhash.keep_first(docs).collect()) == [0, 0, 2]
    twice = spark.createDataFrame([(1, "t u v", "x"), (1, "t u v", "x"), (1, "t u v", "y")], DOCS)
    assert simhash.keep_first(twice).count() == 1


def test_rows_of_one_id_with_different_texts(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    a, b, c = (" ".join(rng.choices(words, k=400)) for _ in range(3))
    near_b = next(t for t in (b.replace(f" {w} ", " other ", 1) for w in b.split()) if t != b and 0 < (brute_fingerprint(t) ^ brute_fingerprint(b)).bit_count() <= 3)

    def kept(rows):
        return sorted((r["doc_id"], r["text"], r["lang"]) for r in simhash.keep_first(spark.createDataFrame(rows, DOCS)).collect())

    assert kept([(1, a, "x"), (1, b, "x"), (2, b, "x"), (7, c, "x")]) == sorted([(1, a, "x"), (1, b, "x"), (7, c, "x")])  # two groups of one id
    assert kept([(3, near_b, "x"), (5, a, "x"), (5, b, "x")]) == sorted([(3, near_b, "x"), (5, a, "x")])  # (5, b) belongs to the group that keeps 3
    ties = [(4, a, lang) for lang in "zyx"]
    assert len(kept(ties)) == 1 and kept(ties) == kept(ties[::-1])


def brute_vectors(rows, least=0.95):
    ok = {k: np.array(v, float) for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    pairs = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= least]
    places = brute_components(range(len(rows)), pairs)
    return [sum(k in p for p in pairs) for k in range(len(rows))], places


def test_vectors(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(40):
        center = rng.standard_normal(16)
        for spread in (0.0, 0.0, 0.1, 0.2, 0.3):
            rows.append((len(rows), [float(np.float32(x)) for x in center + spread * rng.standard_normal(16)]))
    rows += [(len(rows) + k, v) for k, v in enumerate([None, [], [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 1.0]])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int")
    links, places = brute_vectors(rows)
    for block in (3, 4096):
        got = {r["vec_id"]: r for r in near.near_duplicates(frame, block=block).collect()}
        assert [got[k]["n_links"] for k in range(len(rows))] == links
        assert [got[k]["component_id"] for k in range(len(rows))] == [places[k] for k in range(len(rows))]
        assert all(got[k]["kept"] == (places[k] == k) for k in range(len(rows)))


def test_vector_edges(spark):
    schema = "vec_id long, embedding array<double>, links int, id int"
    assert near.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0, 0.0], 1, 1), (1, [1.0, 0.0], 1, 1), (2, [1.0, 0.01], 1, 1), (None, [1.0, 0.0], 1, 1), (9, [0.0, 1.0], 1, 1)]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in near.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 0, None, False), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (9, 0, 9, True)]


def test_table_sizes_keep_recall():
    for n in (10, 10_000, 10**9):
        bits, tables = near.table_sizes(n, 0.95, 1e-4)
        assert (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables <= 1e-4
