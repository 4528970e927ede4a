"""Values of fields as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmerge.functions.jsontext import depth_sql, items_sql, pairs_sql
from docmerge.functions.text import apply_sql, as_col, bind, trim_sql

# Words read as yes/no.
BOOLEAN_WORDS = ("true", "false", "yes", "no", "是", "否")
_FORMULA_START = r"^[=+\-@\t\r]"


def _printed_sql(pair: str) -> str:
    """How a value inside a measurement prints."""
    return f"if({pair}.kind = 'object', '[object Object]', {pair}.text)"


def _measurement_sql(text: str) -> str:
    """ "value unit" of an object with these two keys, else null."""
    pick = "named_struct('value', get(filter(mp, q -> q.key = 'value'), 0), 'unit', get(filter(mp, q -> q.key = 'unit'), 0))"
    both = f"""if(vu.value IS NOT NULL AND vu.unit IS NOT NULL,
        concat({_printed_sql("vu.value")}, ' ', {_printed_sql("vu.unit")}), NULL)"""
    return bind(pairs_sql(text), "mp", bind(pick, "vu", both))


def _leaf_sql(pair: str) -> str:
    """Text of a value that is no array."""
    return f"""CASE WHEN {pair}.kind IN ('plain', 'string', 'number', 'boolean') THEN {pair}.text
        WHEN {pair}.kind = 'null' THEN ''
        WHEN {pair}.kind = 'object' THEN coalesce({trim_sql(_measurement_sql(pair + ".text"))}, {pair}.text) ELSE {pair}.text END"""


def _leaves_sql(text: str) -> str:
    """Items of a JSON array with the arrays among them opened, at any depth; each step opens one level."""
    opened = f"flatten(transform(la, y -> if(y.kind = 'array', {items_sql('y.text')}, array(y))))"
    step = f"if(exists(la, y -> y.kind = 'array'), {opened}, la)"
    return f"aggregate(sequence(1, greatest({depth_sql(text)}, 1)), {items_sql(text)}, (la, lk) -> {step})"


def normalize_value_sql(pair: str) -> str:
    joined = f"array_join(filter(transform({_leaves_sql(pair + '.text')}, i -> {_leaf_sql('i')}), s -> s <> ''), '; ')"
    return f"CASE WHEN {pair}.kind = 'array' THEN {joined} ELSE {_leaf_sql(pair)} END"


def normalize_value(pair: Column | str) -> Column:
    """Text of a ``{kind, text}`` value: "value unit" for measurements, "a; b" for arrays of any depth."""
    return apply_sql(pair, normalize_value_sql)


def render_value(pair: Column | str) -> Column:
    """Display text: a dash for null, "a, b" for arrays."""
    return apply_sql(
        pair,
        lambda p: f"""CASE WHEN {p}.kind IS NULL OR {p}.kind = 'null' THEN '—'
        WHEN {p}.kind = 'array' THEN array_join(transform({items_sql(p + ".text")},
            j -> if(j.kind = 'object', '[object Object]', j.text)), ', ')
        WHEN {p}.kind = 'object' THEN coalesce({_measurement_sql(p + ".text")}, '[object Object]')
        ELSE {p}.text END""",
    )


def infer_type(c: Column | str) -> Column:
    """boolean, number or string, judged from one example value."""
    c = as_col(c)
    return (
        F.when(c.rlike(rf"(?i)^({'|'.join(BOOLEAN_WORDS)})$"), "boolean")
        .when(c.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), "number")
        .otherwise("string")
    )


def csv_field(c: Column | str, guard_numbers: bool = True) -> Column:
    """One CSV field: formula guard, quotes only where needed, null as empty.

    ``guard_numbers=False`` leaves plain negative or signed numbers unguarded.
    """
    c = F.coalesce(as_col(c).cast("string"), F.lit(""))
    risky = c.rlike(_FORMULA_START)
    if not guard_numbers:
        risky = risky & ~c.rlike(r"^[+\-]?[0-9]+(\.[0-9]+)?$")
    safe = F.when(risky, F.concat(F.lit("'"), c)).otherwise(c)
    quoted = F.concat(F.lit('"'), F.regexp_replace(safe, '"', '""'), F.lit('"'))
    return F.when(safe.rlike('[,"\n\r]'), quoted).otherwise(safe)
