"""Helpers that the operators of this package share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space between words, as a Java pattern (fixed by the operators' contracts).
SPACE = r"[\x20\x09-\x0D]+"

#: Rows of one group that are ranked in one window, at most about.
ROWS_PER_BUCKET = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_text(name: str) -> Column:
    """An id on its way through pandas, which would turn whole numbers beside nulls into floats."""
    return F.col(name).cast("long").cast("string").alias(name)


def id_number(name: str) -> Column:
    return F.col(name).cast("long").alias(name)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, also where ``body`` uses it inside of other lambdas."""
    return F.transform(F.array(value), body)[0]


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str, cells: DataFrame | None = None, total: int = 0) -> DataFrame:
    """Add each row's 0-based rank in its group of ``keys`` (not null) as ``name``, and the columns of ``cells`` by ``keys``.

    A group may hold any share of the ``total`` rows: it is cut into buckets by a hash of ``order``, the buckets are
    counted with map-side partial sums, and one task meets one bucket only. Rows alike in ``order`` are interchangeable.
    """
    buckets = max(256, total // ROWS_PER_BUCKET)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    starts = starts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    if cells is not None:
        starts = starts.join(cells, keys)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        rows.withColumn("_local", F.row_number().over(inside) - 1)
        .join(starts, [*keys, "_bucket"])
        .withColumn(name, F.col("_start") + F.col("_local"))
        .drop("_bucket", "_start", "_local")
    )


def per_process(key: Any, build: Callable[[], Any]) -> Any:
    """What ``build`` makes, once in each Python worker: functions travel by value, so module globals end with a task."""
    held = sys.modules.setdefault("_docmerge_held", types.ModuleType("_docmerge_held")).__dict__
    if key not in held:
        held[key] = build()
    return held[key]
