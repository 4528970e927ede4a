"""Prefix trie of rebuilt conversations, by composable fingerprints.

A rebuilt conversation is the head of its base conversation and its own turns after as many. No rebuilt text is made: a sequence of turns
has the fingerprint (sum of e_i * R^i, R^length) modulo a prime, in four lanes, where e_i comes from the turn's digest. These
multiply like strings concatenate: (s, p) * (t, q) = (s + p * t, p * q). Prefix sums of every stored conversation therefore give the fingerprint of each rebuilt prefix: the
head's is the base's own prefix sum, and the suffix after h turns is the difference of two of the conversation's
own, shifted by the lengths of what comes before it.

Members of one depth and fingerprint are a node. A node's members must agree in their parent's fingerprint and in the digest of their last turn, which
by induction makes their whole prefixes equal; turns with equal digests must have equal texts. If any check
fails, all is done again with other multipliers and digests. Nodes keep a reference to a stored turn (conversation, position) in place of texts.

Sums over subtrees need no walk up the trie: nodes are ascribed to their smallest member, a conversation is the smallest member of all nodes on its
path from some depth on, and so a subtree's sum is the sum of its members' totals less what the smallest member has above the subtree's top.

Nulls: a null role or text is empty, a null turn number comes first, rows without a conversation id belong to no conversation and are left
out. Ties: equal turn numbers go by the digest of role and text; repeated rows are turns of their own. An empty table gives no nodes. Other columns are ignored, whatever their names.
The base of a negative id is rounded towards zero. Conversations of any length are cut into blocks; a list of ends is hashed as one stream, in blocks of ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmerge.llm.common import SPACE, text_of
from docmerge.operators.ordering import scan_totals
from docmerge.session import checkpointed

#: Fixed by the contract: conversations of one base, and the hash's modulus (heads have fewer turns).
BASE_SIZE, HEADS = 20, 4
LANES = 4
#: Positions, or ids, in one block.
BLOCK_BITS = 12


@dataclass(frozen=True)
class Scheme:
    """Multipliers of the lanes, their prime, and what distinguishes the digests."""

    salt: str
    factors: tuple[int, ...]
    prime: int = 2**31 - 1
    digits: int = 32

    @classmethod
    def numbered(cls, number: int) -> Scheme:
        made = hashlib.sha256(f"prefix trie {number}".encode()).digest()
        return cls(str(number), tuple(int.from_bytes(made[4 * i : 4 * i + 4], "little") % (2**31 - 10**6) + 10**5 for i in range(LANES)))


def _powers(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """base ** exponents modulo prime (below 2^31), by squaring."""
    found = np.ones(len(exponents), dtype=np.uint64)
    square, left = np.uint64(base % prime), exponents.astype(np.uint64)
    while left.any():
        found = np.where(left & np.uint64(1), found * square % np.uint64(prime), found)
        square, left = square * square % np.uint64(prime), left >> np.uint64(1)
    return found


def _terms(scheme: Scheme):
    """Per turn e * R^position in each lane."""

    @F.pandas_udf(", ".join(f"t{i} long" for i in range(LANES)))
    def terms(digest: pd.Series, pos: pd.Series) -> pd.DataFrame:
        digests = np.array([bytes.fromhex(d) for d in digest], dtype="S16")
        lanes = np.frombuffer(digests.tobytes(), dtype=">u4").reshape(-1, LANES).astype(np.uint64)
        at = pos.to_numpy(np.int64)
        columns = {}
        for i, factor in enumerate(scheme.factors):
            element = lanes[:, i] % np.uint64(scheme.prime)
            columns[f"t{i}"] = (element * _powers(factor, at, scheme.prime) % np.uint64(scheme.prime)).astype(np.int64)
        return pd.DataFrame(columns)

    return terms


def running(rows: DataFrame, key: str, at: str, sums: dict[str, str]) -> DataFrame:
    """Add sums over the rows of a key with smaller ``at`` (from 0, unique in the key); a long key is cut into blocks of places."""
    blocked = rows.withColumn("_block", F.shiftright(at, BLOCK_BITS))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(key, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    starts = blocked.groupBy(key, "_block").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    starts = starts.select(key, "_block", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    local = blocked.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    return local.join(starts, [key, "_block"]).select(*rows.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


def _turns(conversations: DataFrame, scheme: Scheme) -> DataFrame:
    """(conv_id, pos, digest, n_words) and per lane the term ``t`` and the sum ``s`` of the terms before it."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), text_of()
    key = F.concat_ws(":", F.lit(scheme.salt), F.length(role), role, text)
    read = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.rpad(F.substring(F.sha2(key, 256), 1, scheme.digits), 32, "0").alias("digest"),
        F.size(F.array_remove(F.split(text, SPACE), "")).cast("long").alias("n_words"), F.monotonically_increasing_id().alias("row"),
    )
    placed = scan_totals(read, ["conv_id"], ["turn", "digest", "row"], out="pos")
    termed = placed.withColumn("t", _terms(scheme)("digest", "pos")).select("conv_id", "pos", "digest", "n_words", "t.*")
    return checkpointed(running(termed, "conv_id", "pos", {f"s{i}": f"t{i}" for i in range(LANES)}))


def _equal_digests(conversations: DataFrame, scheme: Scheme) -> bool:
    """Whether turns of one digest have one role and text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), text_of()
    digest = F.substring(F.sha2(F.concat_ws(":", F.lit(scheme.salt), F.length(role), role, text), 256), 1, scheme.digits)
    distinct = conversations.where(F.col("conv_id").isNotNull()).select(digest.alias("digest"), role.alias("role"), text.alias("text")).distinct()
    return distinct.groupBy("digest").count().where("count > 1").isEmpty()


def _plans(turns: DataFrame, scheme: Scheme) -> DataFrame:
    """Per conversation: base, turns ``h`` that it gives up, turns ``hh`` of its head, length, and lane sums of the head and of its own first h turns."""
    sums = [F.sum(F.when(F.col("pos") < k, F.col(f"t{i}")).otherwise(0)).alias(f"p{k}_{i}") for k in range(1, HEADS) for i in range(LANES)]
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"), *sums)
    base = F.col("conv_id") - F.col("conv_id") % BASE_SIZE
    h = F.when(base == F.col("conv_id"), 0).otherwise((F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int"))
    own = own.withColumns({"base": base, "h": h})
    bases = own.where("conv_id = base").select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), *[F.col(f"p{k}_{i}").alias(f"b{k}_{i}") for k in range(1, HEADS) for i in range(LANES)])
    both = own.join(bases, "base", "left").withColumn("hh", F.least("h", F.coalesce("base_n", F.lit(0)).cast("int")))

    def chosen(prefix: str, at: str, lane: int) -> Column:
        found = F.lit(0).cast("long")
        for k in range(1, HEADS):
            found = F.when(F.col(at) == k, F.col(f"{prefix}{k}_{lane}")).otherwise(found)
        return found

    return both.select(
        "conv_id", "base", "h", "hh", (F.col("hh") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"),
        *[chosen("b", "hh", i).alias(f"head{i}") for i in range(LANES)], *[chosen("p", "h", i).alias(f"gone{i}") for i in range(LANES)],
    )


def _packed(lanes: Sequence[Column], names: tuple[str, str]) -> list[Column]:
    return [(F.shiftleft(lanes[2 * k], 31) + lanes[2 * k + 1]).alias(name) for k, name in enumerate(names)]


def _members(turns: DataFrame, plans: DataFrame, scheme: Scheme) -> DataFrame:
    """Per rebuilt conversation and depth: fingerprints of the prefix (f) and of its parent (g), and the last turn's place, digest and words."""
    prime = F.lit(scheme.prime).cast("long")
    common = [F.col("digest"), F.col("n_words"), F.col("src").alias("ref_conv_id"), F.col("pos").alias("ref_pos")]
    after, upto = [F.pmod(F.col(f"s{i}") + F.col(f"t{i}"), prime) for i in range(LANES)], [F.pmod(F.col(f"s{i}"), prime) for i in range(LANES)]
    heads = turns.where(F.col("pos") < HEADS - 1).withColumnRenamed("conv_id", "src")
    followers = plans.where("hh > 0").select("conv_id", F.col("base").alias("src"), "hh", "len")
    head_rows = heads.join(followers, "src").where("pos < hh").select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "len", *_packed(after, ("f0", "f1")), *_packed(upto, ("g0", "g1")), *common
    )
    # R^(hh - h), as hh <= h: the suffix moves from its old place behind the head.
    shift = [F.element_at(F.array(*[F.lit(pow(r, -k, scheme.prime)).cast("long") for k in range(HEADS)]), F.col("h") - F.col("hh") + 1) for r in scheme.factors]
    moved = [lambda total, i=i: F.pmod(F.col(f"head{i}") + F.pmod(total - F.col(f"gone{i}"), prime) * shift[i], prime) for i in range(LANES)]
    own_rows = turns.join(plans, "conv_id").where("pos >= h").withColumn("src", F.col("conv_id")).select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("hh") + 1).alias("depth"), "len",
        *_packed([moved[i](F.col(f"s{i}") + F.col(f"t{i}")) for i in range(LANES)], ("f0", "f1")), *_packed([moved[i](F.col(f"s{i}")) for i in range(LANES)], ("g0", "g1")), *common,
    )
    return head_rows.unionByName(own_rows)


def _digest_parts() -> list[Column]:
    return [F.conv(F.substring("digest", 16 * k + 1, 16), 16, -10).cast("long").alias(f"d{k}") for k in range(2)]


def _nodes(members: DataFrame) -> DataFrame:
    """Nodes from depth 1 on, and whether a node's members agree in parent and last turn."""
    checked = ("g0", "g1", "d0", "d1")
    agree = F.lit(True)
    for c in checked:
        agree &= F.min(c) == F.max(c)
    return members.groupBy("depth", "f0", "f1").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(F.col("depth") == F.col("len")).alias("n_ends"), F.min("g0").alias("g0"), F.min("g1").alias("g1"),
        F.max("n_words").alias("n_words"), F.min_by("ref_conv_id", "conv_id").alias("ref_conv_id"), F.min_by("ref_pos", "conv_id").alias("ref_pos"), agree.alias("agree"),
    )


def _hash_streams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's ids; its blocks come one after the other."""
    node, state = None, None
    for batch in batches:
        done = []
        for depth, f0, f1, ids in zip(batch["depth"], batch["f0"], batch["f1"], batch["ids"]):
            if node == (depth, f0, f1):
                state.update(b"," + ids.encode())
                continue
            if node is not None:
                done.append((*node, state.hexdigest()))
            node, state = (depth, f0, f1), hashlib.sha256(ids.encode())
        yield pd.DataFrame(done, columns=["depth", "f0", "f1", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, state.hexdigest())], columns=["depth", "f0", "f1", "ends_sha256"])


def _ends(ends: DataFrame) -> DataFrame:
    """(depth, f0, f1, ends_sha256) of the ids that end at a node, in ascending order, joined by commas."""
    key = ["depth", "f0", "f1"]
    blocks = ends.groupBy(*key, F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return blocks.repartition(*key).sortWithinPartitions(*key, "block").mapInPandas(_hash_streams, "depth long, f0 long, f1 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, schemes: Iterator[Scheme] | None = None) -> DataFrame:
    """Per node: ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``,
    and ``ref_conv_id``, ``ref_pos``: a stored turn that is its last one."""
    schemes = schemes if schemes is not None else (Scheme.numbered(n) for n in range(100))
    for scheme in schemes:
        if not _equal_digests(conversations, scheme):
            continue
        turns = _turns(conversations, scheme)
        plans = checkpointed(_plans(turns, scheme))
        members = checkpointed(_members(turns, plans, scheme).select("*", *_digest_parts()).drop("digest"))
        nodes = checkpointed(_nodes(members))
        if nodes.where(~F.col("agree")).isEmpty():
            return _trie(plans, members, nodes.drop("agree"))
    raise ValueError("fingerprints of different prefixes met under every scheme")


def _trie(plans: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    key = ["depth", "f0", "f1"]
    zero, nothing = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = plans.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(F.col("len") == 0).alias("n_ends")).where("n_convs > 0")
    root_id = (root.first() or [None])[0]
    root = root.select(*[zero.alias(c) for c in key], "conv_id", "n_convs", "n_ends", *[nothing.alias(c) for c in ("g0", "g1")], zero.alias("n_words"), *[nothing.alias(c) for c in ("ref_conv_id", "ref_pos")])
    nodes = nodes.unionByName(root).withColumns({"saved": (F.col("n_convs") - 1) * F.col("n_words"), "leaf": (F.col("n_ends") == F.col("n_convs")).cast("long")})
    nodes = checkpointed(running(nodes, "conv_id", "depth", {"above": "saved"}))

    # What the nodes of a smallest member add up to, and from that the sums over subtrees.
    totals = checkpointed(nodes.groupBy("conv_id").agg(F.sum("saved").alias("total"), F.sum("leaf").alias("leaves")))
    sums = members.join(totals, "conv_id").groupBy(*key).agg(F.sum("total").alias("total"), F.sum("leaves").alias("leaves"))
    sums = sums.unionByName(totals.agg(F.sum("total").alias("total"), F.sum("leaves").alias("leaves")).select(*[zero.alias(c) for c in key], "total", "leaves"))

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("g0").alias("f0"), F.col("g1").alias("f1")).agg(F.count("*").alias("n_children"))
    ended = members.where("depth = len").select(*key, "conv_id").unionByName(plans.where("len = 0").select(*[zero.alias(c) for c in key], "conv_id"))
    above = nodes.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("f0").alias("g0"), F.col("f1").alias("g1"), F.col("conv_id").alias("above_id"))
    parents = nodes.where("depth > 1").select(*key, "g0", "g1").join(above, ["depth", "g0", "g1"]).select(*key, "above_id")  # the root is no join partner
    joined = nodes.join(children, key, "left").join(sums, key, "left").join(_ends(ended), key, "left").join(parents, key, "left")
    return joined.select(
        "conv_id", "depth", F.when(F.col("depth") == 1, F.lit(root_id).cast("long")).otherwise(F.col("above_id")).alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", zero).alias("n_children"), F.coalesce("leaves", zero).alias("n_leaves"), (F.coalesce("total", zero) - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "ref_conv_id", "ref_pos",
    )
