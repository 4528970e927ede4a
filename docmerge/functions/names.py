"""File names, group keys and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmerge.functions.text import SPACE, as_col

_LINE = r"[^\n\r\u2028\u2029]"  # what "." means in the label rules


def group_key(c: Column | str) -> Column:
    """File name without extension, running number, "copy" and separators at its end."""
    name = as_col(c)
    # Patterns of what a group key leaves out.
    steps = (
        r"\.[^.]+$",
        rf"[{SPACE}\-_.]*[\[(]?[0-9]+[\])]?[{SPACE}]*$",
        rf"(?i)[{SPACE}\-_.]*copy[{SPACE}]*$",
        rf"[{SPACE}\-_]+$",
    )
    key = name
    for pattern in steps:
        key = F.regexp_replace(key, pattern, "")
    return F.when(key == "", name).otherwise(key)


def file_ext(c: Column | str) -> Column:
    return F.lower(F.element_at(F.split(as_col(c), r"\.", -1), -1))


def repair_filename(c: Column | str) -> Column:
    """Undo UTF-8 bytes that were read as Latin-1, when this brings CJK text back."""
    name = as_col(c)
    cjk = r"[\u4E00-\u9FFF]"
    latin = name.rlike(r"[^\x00-\x7F]") & name.rlike(r"^[\x00-\xFF]*$")
    raw = F.encode(name, "ISO-8859-1")
    fixed = F.when(latin & F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    return F.when(fixed.rlike(cjk), fixed).otherwise(name)


def strip_row_suffix(c: Column | str) -> Column:
    """Label without its row counter (" #3")."""
    return F.regexp_replace(as_col(c), r" #[0-9]+$", "")


def group_id_of_row(c: Column | str) -> Column:
    """Group id read from a row id; tables that carry ``group_id`` do not need it."""
    c = as_col(c)
    found = F.regexp_extract(c, rf"^({_LINE}+)-([0-9]+)$", 1)
    return F.when(found == "", c).otherwise(found)


def pivot_name(prefix: Column, pivot: Column, value_column: str) -> Column:
    """Wide column name: prefix_pivot_value, with "(empty)" for an empty pivot value."""
    prefix, pivot = F.coalesce(prefix, F.lit("")), F.coalesce(pivot, F.lit(""))
    return F.concat(
        F.when(prefix == "", "").otherwise(F.concat(prefix, F.lit("_"))),
        F.when(pivot == "", "(empty)").otherwise(pivot),
        F.lit("_" + value_column),
    )
