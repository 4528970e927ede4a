"""SimHash near-duplicates by vantage-point trees.

A fingerprint is compared in two halves of 32 bits: of ``bits`` differing bits at most ``bits // 2`` lie in one of the
halves, so pairs are searched in one vantage-point tree per half with that radius. The upper levels of a tree are
built from a bounded sample and only deal out shards: a fingerprint lives in one leaf, and visits every leaf that the
triangle bounds cannot exclude. A shard goes on splitting by vantage points of its own, compares what is left over
all 64 bits, and hands on only a tree of links (its local components), never all pairs. Copies share one fingerprint
before the search; a leaf that would be too large is cut into blocks which meet pairwise.

Nulls: a null text is empty (fingerprint 0, linked like any other), a document without id gets a fingerprint and its group's id, and ``keep_first`` keeps it. Repeated
rows and ties: rows of one fingerprint are one group; the group's id is its smallest id, null if it has none. Rows
may share an id and differ in text: groups are told apart by their smallest fingerprint, never by their id.
An empty table gives no rows; other columns are ignored. Texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmerge.llm.components import components
from docmerge.llm.unions import find, unite
from docmerge.session import checkpointed

#: Seed of the shingle hash, words in a shingle, and bits that linked fingerprints may differ in (fixed by the contract).
SEED, SHINGLE, BITS = 42, 3, 3
HALVES = 2
#: Fingerprints that live in a leaf of the sharding tree; sampled fingerprints per leaf, and leaves, at most.
LEAF, SAMPLE_PER_LEAF, MOST_LEVELS = 4096, 64, 13
#: Cells of a distance table that is computed at once.
TABLE = 1 << 20

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACES = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str | None) -> int:
    """The signed 64-bit fingerprint of a text."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and exactly the ASCII white space
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    places = (hashes.view(np.uint8).reshape(-1, 8) + _PLACES).ravel()
    counts = np.bincount(places, minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int(np.packbits(counts.ravel() * 2 > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def _marked(text: Column) -> Column:
    return F.pandas_udf(_fingerprints, "long")(text.cast("string"))


def _half(fingerprints: np.ndarray, half: int) -> np.ndarray:
    return ((fingerprints.view(np.uint64) >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def _vantage(points: np.ndarray, candidates: int = 8) -> tuple[int, int]:
    """Of some points, the one that sees the others at the widest range of distances, and the median distance."""
    tried = points[np.linspace(0, len(points) - 1, min(candidates, len(points))).astype(int)]
    best = max(tried, key=lambda v: float(np.std(_distance(points, v))))
    return int(best), int(np.median(_distance(points, best)))


@dataclass(frozen=True)
class Shards:
    """The upper levels of one tree: vantage points and radii in heap order, and blocks per leaf."""

    half: int
    levels: int
    points: np.ndarray
    radii: np.ndarray
    homes: np.ndarray
    guests: np.ndarray

    def route(self, fingerprints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, at home) for every leaf that a row lives in or visits."""
        part = _half(fingerprints, self.half)
        row, node, home = np.arange(len(part)), np.zeros(len(part), np.int64), np.ones(len(part), bool)
        for _ in range(self.levels):
            far = _distance(part[row], self.points[node])
            inner = far <= self.radii[node]
            left, right = far - radius <= self.radii[node], far + radius > self.radii[node]
            row = np.concatenate([row[left], row[right]])
            home = np.concatenate([(home & inner)[left], (home & ~inner)[right]])
            node = np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        return row, node - (2**self.levels - 1), home


def build_shards(sample: np.ndarray, total: int, half: int, radius: int, leaf: int = LEAF) -> Shards:
    """A tree of about ``total / leaf`` leaves; a leaf gets blocks by the rows that the sample lets expect in it."""
    levels = int(np.clip(np.ceil(np.log2(max(1.0, total / leaf))), 0, MOST_LEVELS))
    part = _half(sample, half)
    points, radii = np.zeros(2**levels - 1, np.uint32), np.zeros(2**levels - 1, np.int16)
    held = {0: part}
    for node in range(2**levels - 1):
        own = held.pop(node)
        if len(own):
            points[node], radii[node] = _vantage(own)
        far = _distance(own, points[node])
        held[2 * node + 1], held[2 * node + 2] = own[far <= radii[node]], own[far > radii[node]]
    shards = Shards(half, levels, points, radii, np.ones(2**levels, int), np.ones(2**levels, int))
    _, leaves, home = shards.route(sample, radius)
    scale = total / max(1, len(sample)) / (4 * leaf)
    blocks = [np.maximum(1, np.ceil(np.bincount(leaves[x], minlength=2**levels) * scale)).astype(int) for x in (home, home | True)]
    return Shards(half, levels, points, radii, *blocks)


def _deal(batches: Iterator[pd.DataFrame], trees: list[Shards], radius: int) -> Iterator[pd.DataFrame]:
    """Rows (half, leaf, home block, guest block, fingerprint, lives, visits)."""
    for batch in batches:
        values = batch["fingerprint"].to_numpy(np.int64)
        for tree in trees:
            row, leaf, home = tree.route(values, radius)
            own = values[row]
            homes, guests = tree.homes[leaf], tree.guests[leaf]
            mixed = (own.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            at, by = (mixed % homes.astype(np.uint64)).astype(int), (mixed % guests.astype(np.uint64)).astype(int)
            whole = (homes == 1) & (guests == 1)
            parts = [(leaf[whole], at[whole], by[whole], own[whole], home[whole], np.ones(whole.sum(), bool))]
            cut = np.flatnonzero(~whole)
            live = cut[home[cut]]
            for rows, lives, n in ((live, True, guests), (cut, False, homes)):
                again = np.repeat(rows, n[rows])
                other = np.arange(len(again)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])
                pair = (at[again], other) if lives else (other, by[again])
                parts.append((leaf[again], *pair, own[again], np.full(len(again), lives), np.full(len(again), not lives)))
            leaf, at, by, own, lives, visits = (np.concatenate(x) for x in zip(*parts))
            yield pd.DataFrame({"half": np.int32(tree.half), "leaf": leaf.astype(np.int32), "at": at.astype(np.int32), "by": by.astype(np.int32), "fingerprint": own, "lives": lives, "visits": visits})


def _compare(values: np.ndarray, part: np.ndarray, homes: np.ndarray, guests: np.ndarray, radius: int, bits: int, parent: np.ndarray) -> None:
    """Unite every home with every guest within ``bits``, if they are within ``radius`` in the tree's half."""
    tasks = [(homes, guests)]
    while tasks:
        homes, guests = tasks.pop()
        if not len(homes) or not len(guests):
            continue
        if len(homes) * len(guests) > TABLE and len(homes) > 32:
            point, median = _vantage(part[homes])
            near, far = _distance(part[homes], np.uint32(point)), _distance(part[guests], np.uint32(point))
            inner = near <= median
            sides = [(homes[inner], guests[far - radius <= median]), (homes[~inner], guests[far + radius > median])]
            if sum(len(h) * len(g) for h, g in sides) < 0.9 * len(homes) * len(guests):
                tasks += sides
                continue
        step, own = max(1, TABLE // len(guests)), values.view(np.uint64)
        for start in range(0, len(homes), step):
            rows = homes[start : start + step]
            a, b = np.nonzero(np.bitwise_count(own[rows][:, None] ^ own[guests][None, :]) <= bits)
            unite(parent, rows[a], guests[b])


def _link(shard: pd.DataFrame, bits: int) -> pd.DataFrame:
    values = shard["fingerprint"].to_numpy(np.int64)
    values, first = np.unique(values, return_inverse=True)
    lives, visits = np.zeros(len(values), bool), np.zeros(len(values), bool)
    np.logical_or.at(lives, first, shard["lives"].to_numpy(bool))
    np.logical_or.at(visits, first, shard["visits"].to_numpy(bool))
    parent = np.arange(len(values))
    half = int(shard["half"].iloc[0])
    _compare(values, _half(values, half), np.flatnonzero(lives), np.flatnonzero(visits), bits // HALVES, bits, parent)
    roots = find(parent, np.arange(len(values)))
    linked = roots != np.arange(len(values))
    return pd.DataFrame({"a": values[linked], "b": values[roots[linked]]})


def near_links(fingerprints: DataFrame, bits: int = BITS, leaf: int = LEAF) -> DataFrame:
    """Links (a, b) that connect all of the distinct ``fingerprint`` values which differ in at most ``bits`` bits."""
    total = fingerprints.count()
    most = SAMPLE_PER_LEAF << int(np.clip(np.ceil(np.log2(max(1.0, total / leaf))), 0, MOST_LEVELS))
    share = max(1, total // max(1024, most))  # the values are distinct, so their hashes choose about `most` of them
    chosen = fingerprints.select("fingerprint").where(F.pmod(F.xxhash64("fingerprint"), F.lit(share)) == 0)
    sample = np.array([r[0] for r in chosen.collect()], dtype=np.int64)
    radius = bits // HALVES
    trees = [build_shards(sample, total, half, radius, leaf) for half in range(HALVES)]
    dealt = fingerprints.select("fingerprint").mapInPandas(lambda batches: _deal(batches, trees, radius), "half int, leaf int, at int, by int, fingerprint long, lives boolean, visits boolean")
    return dealt.groupBy("half", "leaf", "at", "by").applyInPandas(lambda shard: _link(shard, bits), "a long, b long")


def _labelled(documents: DataFrame, bits: int, leaf: int) -> tuple[DataFrame, DataFrame]:
    """Per document ``doc_id`` and ``fingerprint``; per fingerprint its smallest id ``first_id`` and its ``component`` (smallest fingerprint)."""
    marked = checkpointed(documents.select("doc_id", _marked(F.col("text")).alias("fingerprint")))
    groups = checkpointed(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    joined = components(near_links(groups, bits, leaf))
    return marked, groups.join(joined, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("component"))


def near_duplicates(documents: DataFrame, bits: int = BITS, leaf: int = LEAF) -> DataFrame:
    """Per document: ``doc_id``, ``fingerprint`` (long), ``component_id`` (smallest id that links reach)."""
    marked, labels = _labelled(documents, bits, leaf)
    ids = labels.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = labels.join(ids, "component").select("fingerprint", "component_id")
    return marked.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_first(documents: DataFrame, bits: int = BITS) -> DataFrame:
    """``documents`` with one row of each group of near-duplicates: that of the smallest id, of these the smallest fingerprint, once.

    Ids are looked up in narrow rows; only rows whose id occurs twice are marked and meet in a shuffle of whole rows: there the
    fingerprint tells the group's row, and of rows alike in both that of the smallest hash is taken.
    """
    marked, labels = _labelled(documents, bits, LEAF)
    least = labels.where("first_id is not null").groupBy("component").agg(F.min(F.struct(F.col("first_id").alias("doc_id"), "fingerprint")).alias("least"))
    kept = checkpointed(least.select("least.*"))
    ids = marked.groupBy("doc_id").agg(F.count("*").alias("times")).join(kept.select("doc_id"), "doc_id", "left_semi")
    rows = documents.select("doc_id", F.struct("*").alias("row"))  # whole rows in one column: no name can clash
    single = rows.join(ids, "doc_id")
    again = single.where("times > 1").select("doc_id", _marked(F.col("row.text")).alias("fingerprint"), "row").join(kept, ["doc_id", "fingerprint"])
    again = again.groupBy("doc_id", "fingerprint").agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row"))
    return single.where("times = 1").select("row").unionByName(again.select("row")).unionByName(rows.where("doc_id is null").select("row")).select("row.*")
