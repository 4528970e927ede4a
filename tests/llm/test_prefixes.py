"""The prefix trie against a version that builds every rebuilt conversation."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from docmerge.llm import prefixes, queries


def digest(role, text):
    return hashlib.sha256(f"0:{len(role)}:{role}:{text}".encode()).hexdigest()[:32]


def brute(rows):
    """(conv_id, depth) -> the other numbers, from whole prefixes of whole rebuilt conversations."""
    stored = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            stored[conv_id].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    stored = {c: [t[3:] for t in sorted(turns)] for c, turns in stored.items()}
    rebuilt = {}
    for c, turns in stored.items():
        base, h = c - int(np.fmod(c, 20)), zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(turns if base == c else stored.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = {}
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        leaves = [m for m in below if not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in below)]
        saved = sum((len(members[m]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) for m in below if m)
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(rebuilt[c]) == len(node)))
        children = sum(len(m) == len(node) + 1 for m in below)
        out[min(convs), len(node)] = (min(members[node[:-1]]) if node else None, len(convs), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def found(frame):
    rows = frame.collect()
    got = {(r["conv_id"], r["depth"]): tuple(r)[2:8] for r in rows}
    assert len(got) == len(rows)
    return got


def sample(seed=2, n=90):
    rng = np.random.default_rng(seed)
    rows = []
    for c in [*range(n), -3, -20, -25, 4000, 4001, 2**40, 2**40 + 1]:
        for turn in range(rng.integers(0, 7)):
            text = ["hello there", "ok", "", None, "a b\tc"][rng.integers(5)] if rng.random() < 0.8 else f"own {c} {turn}"
            rows.append((c, turn if turn or c % 3 else None, ["user", "assistant", None][turn % 2 if c % 5 else 2], text))
    rows += [(7, 1, "user", "tie"), (7, 1, "user", "tie"), (7, 1, "user", "other"), (8, None, None, None), (8, None, None, None), (None, 0, "user", "lost")]
    rows += [(c, 0, "user", "same") for c in range(200, 260)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, depth string, f0 int, len string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)


def test_trie_against_brute_force(spark):
    rows = sample()
    got = prefixes.prefix_trie(frame(spark, rows))
    assert got.columns[:8] == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert found(got) == brute(rows)


def test_references_lead_to_the_last_turn(spark):
    rows = [(c, t, "user", f"text {t if c % 2 else c}") for c in range(50) for t in range(4)]
    for r in prefixes.prefix_trie(frame(spark, rows)).where("depth > 0").collect():
        c, d = r["conv_id"], r["depth"]
        base, h = c - c % 20, zlib.crc32(str(c).encode()) % 4
        source = base if d <= h else c
        assert f"text {r['ref_pos'] if source % 2 else source}" == f"text {r['ref_pos'] if r['ref_conv_id'] % 2 else r['ref_conv_id']}" and r["ref_pos"] == d - 1


def test_colliding_schemes_are_left(spark):
    rows, tried = sample(n=40), []

    def schemes():
        for scheme in (prefixes.Scheme("0", (3, 3, 3, 3), 2), prefixes.Scheme("0", prefixes.Scheme.numbered(0).factors, digits=1), prefixes.Scheme.numbered(0)):
            tried.append(scheme)
            yield scheme

    assert found(prefixes.prefix_trie(frame(spark, rows), schemes())) == brute(rows)
    assert len(tried) == 3
    with pytest.raises(ValueError):
        prefixes.prefix_trie(frame(spark, rows), iter([prefixes.Scheme("0", (3, 3, 3, 3), 2)]))


def test_long_conversations_and_many_ends(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "BLOCK_BITS", 3)
    rows = [(20, t, "user", "word " * (t % 3)) for t in range(150)] + [(c, t, "user", "word " * (t % 3)) for c in (21, 22, 23) for t in range(100)] + [(c, 0, "user", "same") for c in range(40, 120)]
    assert found(prefixes.prefix_trie(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(5, 0, "user", "x")], [(1, 0, None, None), (21, 0, None, None)], [(3, None, None, None)] * 3 + [(0, None, None, None)]])
def test_small_tables(spark, rows):
    assert found(prefixes.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == brute(rows)


def test_the_query_over_the_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op11_prefix_trie(spark, sf)) == brute(rows)


def test_powers():
    at = np.array([0, 1, 2, 31, 2**33 + 5])
    assert prefixes._powers(123_456_789, at, 2**31 - 1).tolist() == [pow(123_456_789, int(e), 2**31 - 1) for e in at]
