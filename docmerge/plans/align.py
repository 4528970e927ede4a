"""Results to rows, and rows to files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from docmerge.operators.grouping import filter_groups
from docmerge.operators.merge import merge_flat, merge_nested, replace_group_rows
from docmerge.operators.select import select_export_columns
from docmerge.operators.state import has_header
from docmerge.schemas import Template
from docmerge.sinks.text import write_csv_safe, write_json
from docmerge.sinks.xlsx import write_xlsx


def merge_results(
    results: DataFrame,
    entries: DataFrame | None = None,
    template: Template | None = None,
    groups: DataFrame | None = None,
    strict: bool = False,
) -> DataFrame:
    """Nested merge if the template has repeating columns, else one row per group.

    ``strict`` also asks for a header in at least one result of the whole run.
    """
    nested = any(c.repeating for c in template or [])
    if nested and strict:
        nested = has_header(results)
    merge = merge_nested if nested else merge_flat
    return merge(results, entries, template, groups, strict)


def retry_groups(rows: DataFrame, results: DataFrame, wanted: DataFrame | list[str], **options) -> DataFrame:
    """Merge the wanted groups again and put their rows in place of the old ones."""
    ids = filter_groups(results.select("group_id").distinct(), wanted)
    again = merge_results(results.join(ids, "group_id", "left_semi"), **options)
    return replace_group_rows(rows, again, ids)


def export_rows(rows: DataFrame, columns: list[str], path: str, fmt: str, mode: str = "errorifexists") -> None:
    """Write chosen columns of merged rows as csv, json or xlsx."""
    table = select_export_columns(rows, columns)
    if fmt == "xlsx":
        write_xlsx(table, path, "overwrite" if mode == "overwrite" else "append")
    elif fmt in ("csv", "json"):
        (write_csv_safe if fmt == "csv" else write_json)(table, path, mode)
    else:
        raise ValueError(f"unknown export format: {fmt}")
