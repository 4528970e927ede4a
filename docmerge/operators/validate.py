"""Checks of extracted JSON, in column expressions: nothing is shuffled.

Each check adds ``reject_reason`` (null if the row is good) beside its output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmerge.functions.flatten import flat_pairs
from docmerge.functions.jsontext import items_sql, json_items, pairs_sql, pairs_to_json
from docmerge.functions.keys import is_valid_key_sql, normalize_key_sql
from docmerge.functions.text import SPACE, bind, pattern, trim_sql
from docmerge.operators.template import candidates_by_key, non_repeating_columns, repeating_columns, resolve_sql, sql_string, with_norm_sql
from docmerge.schemas import Template

MIN_FIELDS = 2
MAX_KEY_PARTS = 5


def _unique_sql(pairs: str) -> str:
    last = "transform(uk, k -> element_at(filter(up, q -> q.key = k), -1))"
    return bind(pairs, "up", bind("array_distinct(up.key)", "uk", f"if(size(uk) = size(up), up, {last})"))


def clean_pairs_sql(pairs: str) -> str:
    """Pairs with clean, valid keys; a later spelling of a key wins."""
    named = f"transform({pairs}, p -> named_struct('key', {normalize_key_sql('p.key')}, 'kind', p.kind, 'text', p.text))"
    return _unique_sql(f"filter({named}, c -> {is_valid_key_sql('c.key')})")


def clean_result_keys(column: str) -> Column:
    """JSON object text with clean and valid keys only."""
    return pairs_to_json(F.expr(clean_pairs_sql(pairs_sql(f"`{column}`"))))


def validate_flat(df: DataFrame, column: str = "json") -> DataFrame:
    """Flat mode: adds ``data_json`` and ``reject_reason`` for a column of JSON values.

    Other values than objects become the field ``result``; nesting beyond one level and
    a single wrapping key are flattened; too few fields and joined table headers are refused.
    """
    step = df.withColumn("__flat", flat_pairs(column, "answer"))
    punct = pattern(rf"^[{SPACE}:;|，、\-]+")
    named = f"transform(__flat, p -> named_struct('key', {trim_sql(f'regexp_replace(p.key, {punct}, {chr(39) * 2})')}, 'kind', p.kind, 'text', p.text))"
    step = step.withColumn("__named", F.expr(_unique_sql(f"filter({named}, p -> p.key <> '')")))
    joined = f"exists(__named, p -> size(split(p.key, '-', -1)) > {MAX_KEY_PARTS})"
    reason = (
        F.when(F.col(column).isNull(), "no_json")
        .when(F.size("__flat") == 0, "empty")
        .when(F.size("__flat") < MIN_FIELDS, "too_few_fields")
        .when(F.expr(joined), "joined_header_keys")
    )
    return (
        step.withColumn("reject_reason", reason)
        .withColumn("data_json", F.when(F.col("reject_reason").isNull(), pairs_to_json(F.expr(clean_pairs_sql("__named")))))
        .select(*df.columns, "data_json", "reject_reason")
    )


def split_header_entries(df: DataFrame, template: Template, column: str = "json") -> DataFrame:
    """``header`` pairs (clean keys, without repeating columns) and ``entries`` (object texts)."""
    spark = df.sparkSession
    norms = [c[0] for k, c in candidates_by_key(spark, template).items() if k in set(repeating_columns(template))]
    repeated = ", ".join(sql_string(n) for n in norms)
    other = f"filter({with_norm_sql(pairs_sql(f'`{column}`'))}, p -> p.key <> 'entries'" + (
        f" AND p.norm NOT IN ({repeated}))" if norms else ")"
    )
    header = _unique_sql(f"transform({other}, p -> named_struct('key', p.norm, 'norm', p.norm, 'kind', p.kind, 'text', p.text))")
    items = json_items(F.get_json_object(column, "$.entries"))
    return df.withColumns(
        {
            "header": F.coalesce(F.expr(header), F.expr("cast(array() AS array<struct<key:string,norm:string,kind:string,text:string>>)")),
            "entries": F.coalesce(
                F.transform(F.filter(items, lambda i: i["kind"] == "object"), lambda i: i["text"]),
                F.array().cast("array<string>"),
            ),
        }
    )


def _restrict_sql(pairs: str, keys: list[str], candidates: dict[str, list[str]]) -> str:
    """Template columns filled from pairs with ``norm``; null where nothing fits."""
    cells = [
        bind(
            resolve_sql("np", k, candidates[k]),
            "hit",
            f"named_struct('key', {sql_string(k)}, 'kind', coalesce(hit.kind, 'null'), 'text', coalesce(hit.text, 'null'))",
        )
        for k in keys
    ]
    return bind(pairs, "np", f"array({', '.join(cells)})")


def validate_schema_guided(df: DataFrame, template: Template, column: str = "json") -> DataFrame:
    """Template mode: adds ``header_json``, ``entries_json`` and ``reject_reason``."""
    candidates = candidates_by_key(df.sparkSession, template)
    single, repeated = non_repeating_columns(template), repeating_columns(template)
    step = split_header_entries(df, template, column)
    drop_norm = "transform(header, p -> named_struct('key', p.key, 'kind', p.kind, 'text', p.text))"
    header = _restrict_sql("header", single, candidates) if single else drop_norm
    rows = f"transform(entries, t -> {_restrict_sql(with_norm_sql(pairs_sql('t')), repeated or [c.key for c in template], candidates)})"
    step = step.withColumns({"__header": F.expr(header), "__rows": F.expr(rows)})
    given = "exists(__header, p -> p.kind <> 'null') OR exists(__rows, r -> exists(r, p -> p.kind <> 'null'))"
    reason = (
        F.when(F.col(column).isNull(), "no_json")
        .when(F.size("__rows") == 0, "no_entries")
        .when(~F.expr(given), "all_null")
    )
    step = step.withColumn("reject_reason", reason).withColumns(
        {
            "__header": F.expr(clean_pairs_sql("__header")),
            "__rows": F.expr(f"filter(transform(__rows, r -> {clean_pairs_sql('r')}), r -> size(r) > 0)"),
        }
    )
    good = F.col("reject_reason").isNull()
    return step.withColumns(
        {
            "header_json": F.when(good & (F.size("__header") > 0), pairs_to_json(F.col("__header"))),
            "entries_json": F.when(good, F.transform("__rows", pairs_to_json)),
        }
    ).select(*df.columns, "header_json", "entries_json", "reject_reason")


def entries_from_response(df: DataFrame, column: str = "json") -> DataFrame:
    """Merge response: adds ``entries`` (object texts) and ``conflicts`` (field, values).

    Entries are the ``entries`` array, else the ``merged`` object, else the object itself
    unless it only reports conflicts.
    """
    x = f"`{column}`"
    pick = lambda key: f"get(filter(rp, p -> p.key = '{key}'), 0)"
    listed = f"transform(filter({items_sql('en.text')}, i -> i.kind = 'object'), i -> i.text)"
    rest = f"""CASE WHEN me.kind = 'object' THEN array(me.text)
        WHEN me.kind = 'array' THEN array(me.text)
        WHEN NOT exists(rp, p -> p.key = 'conflicts') THEN array({x})
        ELSE cast(array() AS array<string>) END"""
    entries = bind(
        pairs_sql(x), "rp",
        bind(pick("entries"), "en", bind(pick("merged"), "me", f"if(en.kind = 'array', {listed}, {rest})")),
    )
    values = "transform(cv, v -> v.text)"
    one = bind(
        pairs_sql("c.text"), "cp",
        bind(
            f"named_struct('field', get(filter(cp, p -> p.key = 'field'), 0), 'vals', get(filter(cp, p -> p.key = 'values'), 0))",
            "fv",
            f"""if(fv.field IS NOT NULL AND fv.field.text NOT IN ('', 'null', '0', 'false') AND fv.vals.kind = 'array',
            named_struct('field_name', fv.field.text, 'values', {bind(items_sql("fv.vals.text"), "cv", values)}), NULL)""",
        ),
    )
    conflicts = f"filter(transform({items_sql(f'get_json_object({x}, {chr(39)}$.conflicts{chr(39)})')}, c -> {one}), c -> c IS NOT NULL)"
    none = "cast(array() AS array<struct<field_name:string,values:array<string>>>)"
    return df.withColumns(
        {
            "entries": F.coalesce(F.expr(entries), F.array().cast("array<string>")),
            "conflicts": F.coalesce(F.expr(conflicts), F.expr(none)),
        }
    )
