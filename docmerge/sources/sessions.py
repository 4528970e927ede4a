"""Session folders as they lie in a store: ``_meta.json`` and ``_groups.json``, which Spark's file sources hide.

A Python data source lists the folders once and reads some of them in each partition. Folders without one of the files, or
with one that cannot be read, are kept with nulls.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docmerge.sinks.files import place, write_files
from docmerge.sinks.xlsx import qualified

SCHEMA = "session_id string, created_at timestamp, file_total bigint, group_id string, group_key string, file_count bigint, file_ids array<string>"
FOLDERS_PER_PARTITION = 64
#: A partition starts a Python reader, so beyond this many of them they hold more folders instead; one folder is read at a time.
PARTITIONS = 256


@dataclass
class Folders(InputPartition):
    names: list[str]


def _json(store, path: str):
    try:
        with store.open_input_stream(path) as stream:
            return json.loads(stream.read())
    except (OSError, ValueError):
        return None


def session_rows(name: str, meta, groups) -> Iterator[tuple]:
    """One row per group of a session, or one without a group."""
    meta = meta if isinstance(meta, dict) else {}
    began, total = meta.get("createdAt"), meta.get("fileCount")
    created = datetime.fromtimestamp(began / 1000, timezone.utc) if isinstance(began, (int, float)) and not isinstance(began, bool) else None
    head = (name, created, total if isinstance(total, int) else None)
    listed = [g for g in groups if isinstance(g, dict) and g.get("groupId") is not None] if isinstance(groups, list) else []
    for g in listed:
        ids = [str(i) for i in g.get("fileIds") or []]
        yield (*head, str(g["groupId"]), g.get("groupKey"), int(g.get("fileCount", len(ids))), ids)
    if not listed:
        yield (*head, None, None, None, None)


class SessionReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Folders]:
        from pyarrow import fs

        store, root = place(self.path)
        names = sorted(i.base_name for i in store.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory)
        size = max(self.size, -(-len(names) // PARTITIONS))
        return [Folders(names[i : i + size]) for i in range(0, len(names), size)] or [Folders([])]

    def read(self, partition: Folders) -> Iterator[tuple]:
        store, root = place(self.path)
        for name in partition.names:
            yield from session_rows(name, _json(store, f"{root}/{name}/_meta.json"), _json(store, f"{root}/{name}/_groups.json"))


class SessionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sessionfolders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SessionReader:
        return SessionReader(self.options["path"], int(self.options.get("folders", FOLDERS_PER_PARTITION)))


def read_sessions(spark: SparkSession, path: str, shared: bool = False) -> DataFrame:
    """Groups of all sessions below ``path``, one row each; a session without groups is one row with a null group.

    ``shared`` says that a local-looking path is mounted on all executors.
    """
    spark.dataSource.register(SessionSource)
    return spark.read.format("sessionfolders").load(qualified(spark, path, shared))


def session_members(sessions: DataFrame) -> DataFrame:
    """Manifest members of the sessions, as ``group_members`` gives them."""
    listed = sessions.where("group_id IS NOT NULL")
    return listed.select("session_id", "group_id", "group_key", F.posexplode("file_ids").alias("file_seq", "file_id")).withColumn("file_seq", F.col("file_seq").cast("bigint"))


def write_sessions(sessions: DataFrame, path: str, shared: bool = False) -> int:
    """Write ``_meta.json`` and ``_groups.json`` of sessions (session_id, meta_json, groups_json), a folder each; returns the number of files."""
    names = (("_meta.json", "meta_json"), ("_groups.json", "groups_json"))
    files = F.array(*[F.struct(F.concat("session_id", F.lit(f"/{file}")).alias("name"), F.col(column).cast("binary").alias("content")) for file, column in names])
    return write_files(sessions.select(F.inline(files)).where("content IS NOT NULL"), path, shared)
