"""Choice of rows and columns for previews and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_export_columns(rows: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Fields of the ``data`` map as columns in the given order; a missing key gives null."""
    return rows.select(*keep, *[F.try_element_at(F.col("data"), F.lit(c)).alias(c) for c in columns])


def select_rows(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows whose ``row_id`` is in a table of chosen ids."""
    return rows.join(chosen.select("row_id").distinct(), "row_id", "left_semi")


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """User names for columns; the display label is not exported."""
    return df.drop("_label").withColumnsRenamed(names)


def export_headers(found: list[str], column_order: list[str] | None = None) -> list[str]:
    """Given columns first, then the others as found; without an order alphabetical."""
    if column_order is None:
        return sorted(found)
    return [*column_order, *[c for c in dict.fromkeys(found) if c not in column_order]]


def preview(rows: DataFrame, n: int = 5) -> DataFrame:
    """First rows in group order (top-k, no full sort); 5 for long, 3 for wide previews."""
    order = [c for c in ("group_seq", "entry_idx") if c in rows.columns]
    return rows.orderBy(*order).limit(n)
