"""Best-fit packing of token pieces into sequences under several capacities.

A piece uses tokens, one document place, and attention cost (its length squared). The pieces are counted by length, of which there
are at most ``tokens`` whatever the corpus; the plan is made on these counts: lengths go from the longest to
the shortest, and all pieces of a length at once fill the bins whose residual vector suits best (smallest
residual norm or largest weighted dot product) among those with room in every capacity. Pieces then find their place by their rank among the
pieces of their length.

Nulls: a null text is empty and packs its end token only; null ids are kept. Ties: pieces of one length are interchangeable and
go in the order of a hash of id and piece. Repeated rows are packed one by one. An empty table gives no rows. Other columns are ignored. Whole
texts are tokenised; only a document longer than a sequence is cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmerge.llm.common import id_number, id_text, per_process, ranked
from docmerge.session import checkpointed

#: Token added after every document (fixed by the contract).
END = 2
VOCABULARY = "byte_bpe_50k"
#: Rows whose pieces are made before they go back to Spark.
ROWS_AT_ONCE = 500


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds: ``tokens``, pieces, and the sum of squared lengths; weights of the three in the score."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1)
    score: str = "norm"


@dataclass
class Plan:
    """Segments of pieces: of one length, ranks from ``first`` on go ``times`` per sequence into ``sequence``, ``sequence`` + 1, ... at ``offset``."""

    length: np.ndarray
    first: np.ndarray
    times: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces; segments are in the order of length and rank."""
        key = self.length << 42 | self.first
        at = np.searchsorted(key, length << 42 | rank, side="right") - 1
        past = rank - self.first[at]
        return self.sequence[at] + past // self.times[at], self.offset[at] + past % self.times[at] * length


def plan(counts: Mapping[int, int], capacity: Capacity = Capacity()) -> Plan:
    """Place counted lengths. Bins of equal content are one entry: a residual vector and how many bins there are."""
    size = np.array([capacity.tokens, capacity.documents, capacity.attention], dtype=float)
    weights = np.array(capacity.weights)
    left = np.zeros((0, 3), dtype=np.int64)
    number: list[int] = []
    content: list[tuple | None] = []  # (content before, length, times)
    closed: list[tuple[int, tuple]] = []
    for length in sorted(counts, reverse=True):
        item = np.array([length, 1, length * length], dtype=np.int64)
        todo = counts[length]
        while todo > 0:
            fits = np.flatnonzero((left >= item).all(axis=1))
            if len(fits):
                residual = left[fits] / size
                if capacity.score == "dot":
                    score = -(residual * (item / size)) @ weights
                else:
                    score = (((left[fits] - item) / size) ** 2) @ weights
                at = int(fits[np.argmin(score)])
                bins, times = min(number[at], todo), 1
                if number[at] <= todo:  # copies go in one by one; where all bins can take several, take them together
                    most = int(min((left[at] // item).min(), todo // number[at]))
                    times = max(1, most) if capacity.score == "norm" else 1
                before, room = content[at], left[at].copy()
                number[at] -= bins
                if number[at] == 0:
                    left[at], content[at] = -1, None
            else:
                times = int(min((size // item).min(), todo))
                if times < 1:
                    raise ValueError(f"a piece of {length} tokens does not fit an empty sequence")
                bins, before, room = todo // times, None, size.astype(np.int64)
            todo -= bins * times
            free, held = room - item * times, (before, length, times)
            if free.min() <= 0:
                closed.append((bins, held))
            else:
                left, number, content = np.vstack([left, free[None]]), [*number, bins], [*content, held]
        gone = left[:, 0] < 0
        if gone.sum() > 256:
            keep = np.flatnonzero(~gone)
            left, number, content = left[keep], [number[i] for i in keep], [content[i] for i in keep]
    return _segments([*closed, *((n, c) for n, c in zip(number, content) if n and c)])


def _segments(bins: list[tuple[int, tuple]]) -> Plan:
    rows, ranks, sequence = [], {}, 0
    for number, held in bins:
        items = []
        while held:
            held, length, times = held
            items.append((length, times))
        offset = 0
        for length, times in reversed(items):
            first = ranks.get(length, 0)
            rows.append((length, first, times, sequence, offset))
            ranks[length] = first + number * times
            offset += length * times
        sequence += number
    rows.sort()
    return Plan(*np.array(rows, dtype=np.int64).reshape(-1, 5).T, sequence)


def _encoders(folder: str | None):
    """A fast encoder with the vocabulary's ranks, and the tokenizer itself."""
    import base64
    import os

    import tiktoken
    from tokenizers import Tokenizer

    if folder is None:
        import public_tokenizers

        folder = os.path.dirname(public_tokenizers.__file__)
    with open(os.path.join(folder, f"{VOCABULARY}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: the vocabulary's word pattern
    tokenizer = Tokenizer.from_file(os.path.join(folder, f"{VOCABULARY}.json"))
    special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
    return tiktoken.Encoding(VOCABULARY, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), tokenizer, special


def token_ids(text: str | None, folder: str | None = None) -> np.ndarray:
    """Ids of a text by the byte-level vocabulary, and the end token; the same ids as ``tokenizers`` gives for its JSON file.

    The rank encoder is some four times as fast; texts with special tokens in them, or that it refuses, go to the tokenizer.
    """
    fast, tokenizer, special = per_process(("encoders", folder), lambda: _encoders(folder))
    text = text or ""
    if not any(s in text for s in special):
        try:
            return np.append(fast.encode_to_numpy(text, disallowed_special=()), END).astype("<u4")
        except ValueError:  # the pattern's backtracking limit on huge runs of white space
            pass
    return np.append(np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4"), END).astype("<u4")


def _pieces(batches: Iterator[pa.RecordBatch], tokens: int, folder: str | None, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Pieces of a few hundred rows at a time, straight from Arrow: a worker holds the texts of a batch once, and no second form of them."""
    names, types = zip(*((f.name, f.type) for f in _piece_schema(with_ids)))
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            few, rows = batch.slice(at, ROWS_AT_ONCE), []
            for doc_id, text in zip(few.column("doc_id"), few.column("text")):
                ids = token_ids(text.as_py(), folder)
                end = len(ids) % tokens or min(tokens, len(ids))  # the first piece takes what is over
                start = piece = 0
                while start < len(ids):
                    own = ids[start:end]
                    rows.append((doc_id.as_py(), piece, start, len(own), zlib.crc32(own.tobytes()), *([own.astype(np.int64)] if with_ids else [])))
                    start, end, piece = end, end + tokens, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), types)], names=list(names))


def _piece_schema(with_ids: bool) -> pa.Schema:
    fields = [("doc_id", pa.string()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    return pa.schema([*fields, *([("ids", pa.list_(pa.int64()))] if with_ids else [])])


def token_pieces(documents: DataFrame, tokens: int = 1024, folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per piece of a document: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids``."""
    schema = "doc_id string, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    source = documents.select(id_text("doc_id"), F.col("text").cast("string"))
    return source.mapInArrow(lambda batches: _pieces(batches, tokens, folder, with_ids), schema).withColumn("doc_id", id_number("doc_id"))


def pack(pieces: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with ``sequence_id`` and ``offset``."""
    pieces = checkpointed(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `tokens` rows
    made = plan(counts, capacity)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = made.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    by_rank = ranked(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "rank", total=sum(counts.values()))
    placed = by_rank.select(id_text("doc_id"), "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    return placed.withColumn("doc_id", id_number("doc_id"))
