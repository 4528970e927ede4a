"""Groups of files that belong to one subject, found by file name.

The manifest is kept long, one row per member: a group has no size limit, so its
member ids never form one array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmerge.functions.names import group_key
from docmerge.operators.ordering import group_struct, scan_totals

UNKNOWN_GROUP = "group-unknown"


def with_group(files: DataFrame, name: str = "file_name") -> DataFrame:
    """Add ``group_id`` and ``group_key``; no shuffle."""
    return files.withColumn("group_key", group_key(name)).withColumn("group_id", F.col("group_key"))


def group_files(files: DataFrame) -> DataFrame:
    """Groups with their file count; ``group_seq`` is the order of first sight."""
    return (
        with_group(files)
        .groupBy("group_id", "group_key")
        .agg(F.count(F.lit(1)).alias("file_count"), F.min("file_seq").alias("group_seq"))
    )


def group_members(files: DataFrame) -> DataFrame:
    """The manifest: one row per group and member file."""
    return with_group(files).select("group_id", "group_key", "file_id", "file_seq")


def merge_groups_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Members of both manifests; earlier batches come first (``batch_seq``)."""
    return old.withColumn("batch_seq", F.lit(0)).unionByName(new.withColumn("batch_seq", F.lit(1)))


def manifest_counts(members: DataFrame, distinct: bool = True) -> DataFrame:
    """Groups of a manifest with their counts.

    A file that was listed by several batches counts once, unless ``distinct=False``.
    """
    rows = members
    if distinct:
        rows = members.groupBy("group_id", "file_id").agg(
            F.min("group_key").alias("group_key"), F.min("file_seq").alias("file_seq")
        )
    return rows.groupBy("group_id").agg(
        F.min("group_key").alias("group_key"),
        F.count(F.lit(1)).alias("file_count"),
        F.min("file_seq").alias("group_seq"),
    )


def accumulate_group_counts(batches: DataFrame) -> DataFrame:
    """Sum of ``file_count`` per group over batches of counts (``batch_seq``, ``group_seq`` order)."""
    return batches.groupBy("group_id").agg(
        F.min_by("group_key", F.struct("batch_seq", "group_seq")).alias("group_key"),
        F.sum("file_count").alias("file_count"),
        F.min("group_seq").alias("group_seq"),
    )


def assign_group(files: DataFrame, members: DataFrame) -> DataFrame:
    """Group of each file by the manifest; files of no group get a fixed id."""
    listed = members.groupBy("file_id").agg(F.min_by("group_id", "file_seq").alias("group_id"))
    return files.drop("group_id").join(listed, "file_id", "left").withColumn(
        "group_id", F.coalesce("group_id", F.lit(UNKNOWN_GROUP))
    )


def fallback_groups(results: DataFrame) -> DataFrame:
    """Groups rebuilt from results alone; the last file seen gives the label."""
    return results.groupBy("group_id").agg(
        F.max_by(F.split_part("file_name", F.lit("."), F.lit(1)), "file_seq").alias("group_key"),
        F.lit(1).cast("bigint").alias("file_count"),
        F.min("file_seq").alias("group_seq"),
    )


def filter_groups(groups: DataFrame, wanted: DataFrame | list[str]) -> DataFrame:
    """Groups to work on again, given as a list of ids or as a table of ids."""
    if isinstance(wanted, DataFrame):
        return groups.join(wanted.select("group_id").distinct(), "group_id", "left_semi")
    return groups.where(F.col("group_id").isin(*wanted)) if wanted else groups


def batch_size(n_files: int) -> int:
    """Files per batch: 5 up to 100 files, 8 up to 200, then 10."""
    return 5 if n_files <= 100 else 8 if n_files <= 200 else 10


def batch_numbers(files: DataFrame, session: str = "session_id") -> DataFrame:
    """Batch number of each file in its session, by the size rule of ``batch_size``; files without a session are one.

    Files are numbered by (file_seq, file_id) on these columns alone; ``file_seq`` may be of any scale.
    """
    key = [session, "file_seq", *[c for c in ("file_id",) if c in files.columns]]
    placed = scan_totals(files.select(*key), [session], key[1:], out="__pos").withColumn("__group", group_struct([session]))
    totals = files.groupBy(group_struct([session]).alias("__group")).agg(F.count(F.lit(1)).alias("__n"))
    size = F.when(F.col("__n") <= 100, 5).when(F.col("__n") <= 200, 8).otherwise(10)
    numbered = placed.join(totals, "__group").withColumn("batch_no", F.floor(F.col("__pos") / size).cast("bigint"))
    if set(files.columns) == set(key):
        return numbered.select(*files.columns, "batch_no")
    numbers = numbered.select(group_struct(key).alias("__key"), "batch_no").dropDuplicates(["__key"])
    return files.withColumn("__key", group_struct(key)).join(numbers, "__key").drop("__key")
