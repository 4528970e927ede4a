"""CSV that spreadsheets open safely, and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmerge.functions.values import csv_field

BOM = "﻿"


def csv_line(columns: list[str], guard_numbers: bool = True) -> Column:
    return F.concat_ws(",", *[csv_field(F.col(f"`{c}`"), guard_numbers) for c in columns])


def write_csv_safe(df: DataFrame, path: str, mode: str = "errorifexists", guard_numbers: bool = True) -> None:
    """CRLF lines with formula guard; every part file starts with a BOM and the header line, also that of an empty table.

    The first row of a partition is known by its row number, so the header needs no
    extra pass and rows stay in the JVM.
    """
    header = F.concat_ws(",", *[csv_field(F.lit(c), guard_numbers) for c in df.columns])
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    line = csv_line(df.columns, guard_numbers)
    with_header = F.concat(F.lit(BOM), header, F.lit("\r\n"), line)
    text = df.select(line.alias("line"), with_header.alias("top"), first.alias("first"))
    text = text.select(F.when(F.col("first"), F.col("top")).otherwise(F.col("line")).alias("value"))
    if df.isEmpty():
        text = df.sparkSession.range(1, numPartitions=1).select(F.concat(F.lit(BOM), header).alias("value"))
    text.write.mode(mode).option(
        "lineSep", "\r\n"
    ).option("maxRecordsPerFile", 0).text(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line with its nested values and nulls kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
