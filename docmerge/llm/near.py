"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosines, connected components.

A table's code is the signs of a vector on its hyperplanes; vectors that share a code in some table are compared in double
precision. The number of tables is such that a pair at the very limit is missed with probability ``miss``. A pair that
shares codes in several tables counts in the first of them only, so tasks hand on counts per vector and a tree of links,
never the pairs. Equal vectors are one, with a count; a bucket above ``block`` vectors is cut into blocks that
meet pairwise in tasks of their own.

Nulls: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; a null id is its
own component (null, not kept). Ties and repeated rows: rows of equal vectors link with each other, also under one id.
Vectors of different length never link. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmerge.llm.common import per_process
from docmerge.llm.components import components
from docmerge.llm.unions import find, unite
from docmerge.session import checkpointed

SEED = 20_11
#: Random vectors in a bucket, on average; vectors of a bucket that meet in one task, at most.
BUCKET, BLOCK = 64, 4096
#: Rows of a block that are compared at once.
ROWS = 256


def table_sizes(vectors: int, least: float, miss: float) -> tuple[int, int]:
    """(bits of a code, tables): codes grow with the number of vectors, tables keep the chance to miss a pair at the limit."""
    bits = int(np.clip(math.ceil(math.log2(max(1, vectors) / BUCKET)), 4, 30))
    agree = (1 - math.acos(least) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


def _planes(dimension: int, number: int) -> np.ndarray:
    return per_process(("planes", dimension, number), lambda: np.random.default_rng(SEED).standard_normal((dimension, number)))


def sign_codes(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables) codes."""
    signs = (vectors @ _planes(vectors.shape[1], bits * tables) > 0).reshape(len(vectors), tables, bits)
    return signs @ (1 << np.arange(bits))


def _coded(vectors: pd.Series, bits: int, tables: int) -> pd.Series:
    out = pd.Series([None] * len(vectors), index=vectors.index, dtype=object)
    lengths = vectors.map(len)
    for length, same in vectors.groupby(lengths):
        codes = sign_codes(np.stack(same.to_list()).astype(float), bits, tables)
        for at, code in zip(same.index, codes):
            out.at[at] = code.tolist()
    return out


def _bucket_links(bucket: pa.Table, least: float) -> pa.Table:
    """Per vector of a bucket (or pair of blocks): how many rows it newly links with, and the root of its local component."""
    table, first, second = (bucket[name][0].as_py() for name in ("table", "one", "two"))
    ids, times, block = (bucket[name].to_numpy() for name in ("id", "times", "block"))
    unit, codes = (bucket[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) for name in ("vector", "codes"))
    order = np.argsort(ids, kind="stable")  # a root is the smallest id
    ids, times, block, unit, codes = ids[order], times[order], block[order], unit[order].astype(float), codes[order]
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    rows, columns = np.flatnonzero(block == first), np.flatnonzero(block == second)
    links, parent = np.zeros(len(ids)), np.arange(len(ids))
    for start in range(0, len(rows), ROWS):
        part = rows[start : start + ROWS]
        i, j = np.nonzero(unit[part] @ unit[columns].T >= least)
        i, j = part[i], columns[j]
        new = i < j if first == second else np.ones(len(i), bool)
        i, j = i[new], j[new]
        for earlier in range(table):
            new = codes[i, earlier] != codes[j, earlier]
            i, j = i[new], j[new]
        unite(parent, i, j)  # pairs of earlier tables are united there
        links += np.bincount(i, times[j], len(ids)) + np.bincount(j, times[i], len(ids))
    root = ids[find(parent, np.arange(len(ids)))]
    told = (links > 0) | (root != ids)
    return pa.table({"id": ids[told], "links": links[told].astype(np.int64), "root": root[told]})


def near_duplicates(embeddings: DataFrame, least: float = 0.95, miss: float = 1e-4, block: int = BLOCK, vector: str = "embedding") -> DataFrame:
    """Per row: ``vec_id``, ``n_links`` (rows linked directly), ``component_id`` (smallest id that links reach), ``kept``."""
    value = F.col(vector).cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(finite & F.exists(value, lambda x: x != 0), F.lit(False))
    positive = F.transform(vector, lambda x: x + F.lit(0).cast("float"))  # no negative zeros: equal vectors hash alike
    rows = checkpointed(embeddings.select("vec_id", F.when(usable & F.col("vec_id").isNotNull(), positive).alias("vector")))
    groups = rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("times"))
    groups = checkpointed(groups)
    bits, tables = table_sizes(groups.count(), least, miss)
    coded = F.pandas_udf(lambda v: _coded(v, bits, tables), "array<int>")
    # Two groups may share their smallest id if an id occurs twice; a hash of the vector keeps them apart.
    groups = checkpointed(groups.select(F.xxhash64("vector").alias("group"), "id", "times", "vector", coded(F.col("vector")).alias("codes")))
    spread = groups.select(F.posexplode("codes").alias("table", "code"), F.size("vector").alias("length"), F.col("group").alias("id"), "times", "vector", "codes")
    sizes = groups.select(F.posexplode("codes").alias("table", "code"), F.size("vector").alias("length")).groupBy("table", "code", "length").agg(F.count("*").alias("n"))
    spread = spread.join(sizes.where("n > 1"), ["table", "code", "length"])
    blocks = F.ceil(F.col("n") / block).cast("int")
    spread = spread.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("long"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("other")
    met = spread.select("*", other).withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
    met = met.select("table", "code", "length", "one", "two", "block", "id", "times", "vector", "codes")
    found = checkpointed(met.groupBy("table", "code", "length", "one", "two").applyInArrow(lambda b: _bucket_links(b, least), "id long, links long, root long"))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    by_group = groups.select(F.col("group"), F.col("id").alias("first_id"), "times")
    labels = by_group.join(joined, F.col("group") == F.col("node"), "left").join(counts, F.col("group") == F.col("id"), "left")
    labels = labels.select("group", "first_id", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "group").alias("component"))
    smallest = labels.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labels = labels.join(smallest, "component").select("group", "n_links", "component_id")
    keyed = rows.select("vec_id", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")).alias("group"))
    named = keyed.join(labels, "group", "left")
    component = F.coalesce("component_id", "vec_id")
    return named.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
