"""White space, and expressions written as SQL text.

Java regexes treat ``\\s`` as ASCII only, so every pattern spells out the
Unicode white space that counts as blank in a document field.

The larger expressions are put together as SQL text: builders take and return
SQL fragments, and ``apply_sql`` turns one into a column in a single step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Inside of a character class: white space and line terminators.
SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pattern(regex: str) -> str:
    """A regex as a raw SQL literal."""
    return "r'" + regex.replace("'", r"\x27") + "'"


def quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.split("."))


def bind(value: str, name: str, body: str) -> str:
    """SQL in which ``name`` stands for ``value``, evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def apply_sql(c: Column | str, builder: Callable[[str], str]) -> Column:
    """Column of a SQL builder; names stay plain references, other expressions are bound once."""
    if isinstance(c, str):
        return F.expr(builder(quoted(c)))
    return F.get(F.call_function("transform", F.array(c), F.expr(f"it -> {builder('it')}")), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, {pattern(f'^[{SPACE}]+|[{SPACE}]+$')}, '')"


def trim(c: Column | str) -> Column:
    """Trim Unicode white space on both ends."""
    return F.regexp_replace(as_col(c), f"^[{SPACE}]+|[{SPACE}]+$", "")


def is_blank(c: Column | str) -> Column:
    c = as_col(c)
    return c.isNull() | (trim(c) == "")
