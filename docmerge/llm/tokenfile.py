"""Token ids in files of directly addressable codes.

An id is cut into chunks of 8 bits, lowest first. The first chunks of all ids form level 0; an id that has more chunks sets its bit
in the level's continuation bitmap, and its next chunk lies in the next level, at the number of set bits before its own. A rank
directory holds that number for every 512th bit, so any id is read with one chunk, at most 64 bytes of bitmap and one
directory entry per level; nothing else is decoded.

File (little endian): magic, format of the header (``HEADER``), and for each level its count of chunks; then per document its id, a null
flag and its first place (one more place at the end); then per level chunks, bitmap (64-bit words) and directory. All parts are aligned to 8 bytes, and where they
begin follows from the header alone. A file's name holds the place of its first token among the tokens of all files: ``tokens-<place>.dac``.

Files are in ascending order of doc_id. Nulls: a null text is empty (its end token only); null ids come first. Ties: rows of
one id go by a hash of their text, repeated rows of a text are written one by one. An empty table
writes no file. Other columns are ignored, whatever their names. Whole texts are encoded; a document is never split
between files, so a file holds ``file_tokens`` ids and the rest of one document at most. A hot id is cut by its texts and rows.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from docmerge.llm.common import id_number
from docmerge.llm.packing import token_ids
from docmerge.session import ensure_checkpoint_dir

MAGIC = b"DACTOK01"
#: ids, documents, levels.
HEADER = "<8sQQQ"
CHUNK_BITS = 8
#: Bits of a bitmap between two entries of its rank directory.
STRIDE = 512
_NAME = re.compile(r"tokens-(\d+)\.dac$")


def _aligned(size: int) -> int:
    return -size % 8 + size


def _layout(documents: int, levels: list[int]) -> tuple[list[int], list[tuple[int, int, int]], int]:
    """Offsets of the documents' three parts, of each level's three parts, and the size of the file."""
    at = struct.calcsize(HEADER) + 8 * len(levels)
    parts = [at, at + 8 * documents, at + 8 * documents + _aligned(documents)]
    at = parts[2] + 8 * (documents + 1)
    places = []
    for count in levels:
        words = -(-count // 64)
        places.append((at, at + _aligned(count), at + _aligned(count) + 8 * words))
        at = places[-1][2] + 8 * (-(-count // STRIDE))
    return parts, places, at


def encode(doc_ids: list[int | None], documents: list[np.ndarray]) -> bytes:
    """A file of documents, each given by its ids (unsigned 32-bit)."""
    starts = np.zeros(len(documents) + 1, dtype="<u8")
    np.cumsum([len(d) for d in documents], out=starts[1:])
    rest = np.concatenate([*documents, np.zeros(0, dtype="<u4")]).astype(np.uint32)
    total, levels = len(rest), []
    while len(rest):
        chunks = (rest & (2**CHUNK_BITS - 1)).astype(np.uint8)
        more = rest >> CHUNK_BITS != 0
        bits = np.packbits(more, bitorder="little")
        words = np.zeros(-(-len(rest) // 64) * 8, dtype=np.uint8)
        words[: len(bits)] = bits
        set_bits = np.add.reduceat(more, np.arange(0, len(more), STRIDE), dtype=np.uint64)
        directory = np.concatenate([[0], np.cumsum(set_bits)[:-1]]).astype("<u8")
        levels.append((chunks, words, directory))
        rest = rest[more] >> CHUNK_BITS
    counts = [len(c) for c, _, _ in levels]
    parts, places, size = _layout(len(documents), counts)
    out = bytearray(size)

    def put(at: int, data: bytes) -> None:
        out[at : at + len(data)] = data

    put(0, struct.pack(HEADER, MAGIC, total, len(documents), len(levels)) + np.array(counts, dtype="<u8").tobytes())
    put(parts[0], np.array([i or 0 for i in doc_ids], dtype="<i8").tobytes())
    put(parts[1], np.array([i is None for i in doc_ids], dtype=np.uint8).tobytes())
    put(parts[2], starts.tobytes())
    for (at_chunks, at_words, at_directory), (chunks, words, directory) in zip(places, levels):
        put(at_chunks, chunks.tobytes())
        put(at_words, words.tobytes())
        put(at_directory, directory.tobytes())
    return bytes(out)


class TokenFile:
    """A file read by ``read(offset, size)``, which is asked only for the bytes that an answer needs."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        magic, self.n_tokens, self.n_documents, levels = struct.unpack(HEADER, read(0, struct.calcsize(HEADER)))
        if magic != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.counts = [int(c) for c in self._numbers(struct.calcsize(HEADER), "<u8", levels)]
        self.parts, self.places, _ = _layout(self.n_documents, self.counts)

    @classmethod
    def of(cls, content: bytes) -> TokenFile:
        view = memoryview(content)
        return cls(lambda at, size: view[at : at + size])

    def _numbers(self, at: int, kind: str, count: int) -> np.ndarray:
        return np.frombuffer(self.read(at, np.dtype(kind).itemsize * count), dtype=kind)

    def _rank(self, level: int, at: int) -> int:
        """Set bits of the level's bitmap before ``at``."""
        _, words, directory = self.places[level]
        block = at // STRIDE
        if at == self.counts[level]:
            block = max(0, (at - 1) // STRIDE)
        before = int(self._numbers(directory + 8 * block, "<u8", 1)[0])
        first = block * STRIDE // 8
        tail = int.from_bytes(self.read(words + first, -(-(at - block * STRIDE) // 8)), "little")
        return before + (tail & ((1 << (at - block * STRIDE)) - 1)).bit_count()

    def token(self, at: int) -> int:
        """The id at a place, level by level, without reading its neighbours."""
        if not 0 <= at < self.n_tokens:
            raise IndexError(at)
        value, level = 0, 0
        while True:
            chunks, words, _ = self.places[level]
            value |= self.read(chunks + at, 1)[0] << (CHUNK_BITS * level)
            if not self.read(words + at // 8, 1)[0] >> (at % 8) & 1:
                return value
            at, level = self._rank(level, at), level + 1

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The ids of a range: of each level only the chunks and bits that belong to it are read."""
        if not 0 <= start <= stop <= self.n_tokens:
            raise IndexError((start, stop))
        return self._range(0, start, stop) if stop > start else np.zeros(0, dtype="<u4")

    def _range(self, level: int, start: int, stop: int) -> np.ndarray:
        chunks, words, _ = self.places[level]
        found = self._numbers(chunks + start, "u1", stop - start).astype("<u4")
        first = start // 8
        bits = np.unpackbits(self._numbers(words + first, "u1", -(-stop // 8) - first), bitorder="little")
        more = np.flatnonzero(bits[start - 8 * first : stop - 8 * first])
        if len(more):
            at = self._rank(level, start)
            found[more] |= self._range(level + 1, at, at + len(more)) << np.uint32(CHUNK_BITS)
        return found

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Ids of the documents and their first places, with the end of the last one."""
        ids, nulls = self._numbers(self.parts[0], "<i8", self.n_documents), self._numbers(self.parts[1], "u1", self.n_documents)
        return [None if gone else int(i) for i, gone in zip(ids, nulls)], self._numbers(self.parts[2], "<u8", self.n_documents + 1).astype(np.int64)


@dataclass
class Written(WriterCommitMessage):
    partition: int
    files: list[tuple[str, int]]


class TokenWriter(DataSourceArrowWriter):
    """Encodes the texts of a partition, in their order, into files beside the target; commit names them by their first place."""

    def __init__(self, path: str, folder: str | None, file_tokens: int):
        self.path, self.folder, self.file_tokens = path, folder, file_tokens
        self.stage = f"_stage-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(f"{root}/{self.stage}", recursive=True)
        context = TaskContext.get()
        files: list[tuple[str, int]] = []
        ids: list[int | None] = []
        documents: list[np.ndarray] = []
        held = 0

        def flush() -> None:
            name = f"{context.partitionId()}-{context.taskAttemptId()}-{len(files)}"
            with store.open_output_stream(f"{root}/{self.stage}/{name}") as sink:
                sink.write(encode(ids, documents))
            files.append((name, held))

        for batch in iterator:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                own = token_ids(text.as_py(), self.folder)
                if documents and held + len(own) > self.file_tokens:
                    flush()
                    ids, documents, held = [], [], 0
                ids.append(doc_id.as_py())
                documents.append(own)
                held += len(own)
        if documents:
            flush()
        return Written(context.partitionId(), files)

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        place = 0
        for message in sorted((m for m in messages if m), key=lambda m: m.partition):
            for name, tokens in message.files:
                store.move(f"{root}/{self.stage}/{name}", f"{root}/tokens-{place:018d}.dac")
                place += tokens
        self.abort(messages)

    def abort(self, messages) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        try:
            store.delete_dir(f"{root}/{self.stage}")
        except FileNotFoundError:
            pass


class TokenSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tokendac"

    def writer(self, schema: StructType, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options["path"], self.options.get("folder"), int(self.options["filetokens"]))


def write_tokens(documents: DataFrame, path: str, folder: str | None = None, file_tokens: int = 1 << 22) -> None:
    """Write the ids of all texts, each with the end token, to new ``.dac`` files under ``path``.

    ``path`` is a URI of a store that all executors share, and must not exist. ``folder`` holds the vocabulary (the installed one by default).
    """
    spark = documents.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(place):
        raise ValueError(f"{path} exists")
    spark.dataSource.register(TokenSink)
    rows = documents.select(
        id_number("doc_id"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("_hash"), F.monotonically_increasing_id().alias("_row")
    )
    order = ["doc_id", "_hash", "_row"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    uri = store.makeQualified(place).toString()
    out = ordered.write.format("tokendac").mode("append").option("filetokens", file_tokens)
    (out.option("folder", folder) if folder else out).save("file://" + uri.removeprefix("file:") if re.match("file:/(?!/)", uri) else uri)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            place, held = int(_NAME.search(path).group(1)), TokenFile.of(content)
            ids, starts = held.documents()
            rows = []
            for doc_id, start, stop in zip(ids, starts[:-1].tolist(), starts[1:].tolist()):
                own = held.tokens(start, stop)
                rows.append((None if doc_id is None else str(doc_id), place + start, len(own), zlib.crc32(own.tobytes())))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document in the files under ``path``: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(path).select("path", "content")
    found = files.mapInPandas(_read, "doc_id string, start long, n_tokens long, ids_crc32 long")
    return found.withColumn("doc_id", id_number("doc_id"))


def round_trip(documents: DataFrame, file_tokens: int = 1 << 22) -> DataFrame:
    """Write the documents to a new folder of the shared checkpoint folder and read them back."""
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tokens-{uuid.uuid4().hex}"
    write_tokens(documents, path, file_tokens=file_tokens)
    return read_documents(spark, path)
