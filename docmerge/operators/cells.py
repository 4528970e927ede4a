"""The cell table: one row per (file, object, key) of the extraction results.

cells(group_id, file_id, file_name, file_seq, origin, entry_idx, key_pos,
      raw_key, key, kind, value)

``origin`` is header, entry or data; ``key`` is the cleaned name, ``value`` the
text form.  Merging, conflicts, key counts and unions are aggregates over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmerge.functions.jsontext import SETTLED_OBJECT, flat_map_sql, given_sql, pairs_sql
from docmerge.functions.keys import is_structure_key, is_valid_key, is_valid_key_sql, normalize_key, normalize_key_sql
from docmerge.functions.text import apply_sql, bind, pattern
from docmerge.functions.values import normalize_value, normalize_value_sql
from docmerge.operators.identity import ID, id_columns, join_on

_ID = ("group_id", *ID, "file_name", "file_seq")


def strip_common_prefix_sql(pairs: str) -> str:
    """Drop the part up to the first dash that all keys of one object begin with."""
    prefix = """CASE WHEN size(op) > 1 AND contains(op[0].key, '-')
        AND forall(op, q -> startswith(q.key, concat(split_part(op[0].key, '-', 1), '-')))
        THEN length(split_part(op[0].key, '-', 1)) + 1 ELSE 0 END"""
    cut = "transform(op, q -> named_struct('key', substring(q.key, cutn + 1), 'kind', q.kind, 'text', q.text))"
    return bind(pairs, "op", bind(prefix, "cutn", f"if(cutn = 0, op, {cut})"))


def _objects(results: DataFrame, entries: DataFrame | None, origins: tuple[str, ...]) -> DataFrame:
    """One row per JSON object: identity columns, origin, entry_idx, object text."""
    ids = [c for c in _ID if c in results.columns]
    parts = []
    for origin, column in (("header", "header_json"), ("data", "data_json")):
        if origin in origins and column in results.columns:
            parts.append(
                results.where(F.col(column).isNotNull()).select(
                    *ids, F.lit(origin).alias("origin"), F.lit(0).cast("bigint").alias("entry_idx"),
                    F.col(column).alias("object"),
                )
            )
    if "entry" in origins:
        parts.append(
            entry_objects(results, entries).select(
                *ids, F.lit("entry").alias("origin"), "entry_idx", F.col("entry_json").alias("object")
            )
        )
    if not parts:
        return results.select(
            *ids, F.lit("data").alias("origin"), F.lit(0).cast("bigint").alias("entry_idx"),
            F.lit(None).cast("string").alias("object"),
        ).where("false")
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def entry_objects(results: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Entries of the results, one row each, from the array column or from a long entry table."""
    ids = [c for c in _ID if c in results.columns]
    if entries is not None:
        key = id_columns(results, entries)
        return join_on(results.select(*ids), entries.select(*key, "entry_idx", "entry_json"), key)
    if "entries_json" not in results.columns:
        results = results.withColumn("entries_json", F.lit(None).cast("array<string>"))
    return results.select(*ids, F.posexplode("entries_json").alias("entry_idx", "entry_json")).withColumn(
        "entry_idx", F.col("entry_idx").cast("bigint")
    )


def to_cells(
    results: DataFrame,
    entries: DataFrame | None = None,
    origins: tuple[str, ...] = ("header", "entry", "data"),
    strip_prefix: bool = False,
) -> DataFrame:
    """Explode results into cells; narrow work, except for a join with a long entry table.

    Flat objects of plain values are opened as the map that they are; only others are made into pairs, value by value.
    """
    objects = _objects(results, entries, origins)
    pairs = pairs_sql("object", loose=True)
    if strip_prefix:
        pairs = strip_common_prefix_sql(pairs)
    ids = [c for c in objects.columns if c != "object"]
    settled = F.expr(f"object RLIKE {pattern(SETTLED_OBJECT)}")  # also its keys are clean
    flat = objects.select(*ids, "object", settled.alias("settled"))
    flat = flat.select(*ids, "settled", "object", F.expr(flat_map_sql("object", "settled")).alias("flat"))
    known = "size(array_distinct(map_keys(flat))) = size(flat)"
    if strip_prefix:
        known += " AND NOT coalesce(contains(get(map_keys(flat), 0), '-'), false)"
    opened = flat.select(*ids, "settled", "object", F.expr(f"CASE WHEN {known} THEN flat END").alias("flat"))
    opened = opened.select(*ids, "settled", "flat", F.expr(f"CASE WHEN flat IS NULL THEN {pairs} END").alias("pairs"))
    texts = F.coalesce("flat", F.map_from_arrays("pairs.key", "pairs.text"))
    opened = opened.select(*ids, "settled", F.col("pairs.kind").alias("kinds"), F.posexplode(texts).alias("key_pos", "raw_key", "text"))
    plain = F.col("kinds").isNull()
    kind = F.when(plain, F.when(F.col("text").isNull(), "null").otherwise("plain")).otherwise(F.get("kinds", "key_pos"))
    pair = F.struct(F.get("kinds", "key_pos").alias("kind"), F.col("text").alias("text"))
    return opened.select(
        *ids,
        "key_pos",
        "raw_key",
        F.when(F.col("settled"), F.col("raw_key")).otherwise(normalize_key("raw_key")).alias("key"),
        kind.alias("kind"),
        F.when(plain, F.coalesce("text", F.lit(""))).otherwise(normalize_value(pair)).alias("value"),
    )


def to_keys(
    results: DataFrame,
    entries: DataFrame | None = None,
    origins: tuple[str, ...] = ("header", "entry", "data"),
) -> DataFrame:
    """The cell table without values: only the keys of each object are read."""
    objects = _objects(results, entries, origins)
    ids = [c for c in objects.columns if c != "object"]
    keys = F.array_distinct(F.json_object_keys("object"))
    return objects.select(*ids, F.posexplode(keys).alias("key_pos", "raw_key")).withColumn(
        "key", normalize_key("raw_key")
    )


def drop_empty(cells: DataFrame) -> DataFrame:
    """Drop cells whose raw value is null or the empty string."""
    return cells.where((F.col("kind") != "null") & ~(F.col("kind").isin("string", "plain") & (F.col("value") == "")))


def drop_invalid_keys(cells: DataFrame) -> DataFrame:
    return cells.where(is_valid_key("key"))


def drop_structure_keys(cells: DataFrame) -> DataFrame:
    """Drop keys that a model invents for structure (``entries``, ``_meta`` ...)."""
    return cells.where(~is_structure_key("raw_key"))


def drop_hidden_keys(cells: DataFrame) -> DataFrame:
    return cells.where(~F.col("raw_key").startswith("_"))


def mergeable(cells: DataFrame) -> DataFrame:
    """Cells that take part in a merge."""
    return drop_invalid_keys(drop_empty(cells))


def clean_map(json_text: str, strip_prefix: bool = False) -> Column:
    """One object as map(clean key -> text) in key order; a later spelling of a key wins."""

    def build(x: str) -> str:
        pairs = pairs_sql(x, loose=True)
        if strip_prefix:
            pairs = strip_common_prefix_sql(pairs)
        named = f"""transform(filter({pairs}, p -> {given_sql("p")}),
            p -> named_struct('key', {normalize_key_sql("p.key")}, 'value', {normalize_value_sql("p")}))"""
        valid = f"filter({named}, c -> {is_valid_key_sql('c.key')})"
        last = "transform(ck, k -> element_at(filter(cs, q -> q.key = k), -1).value)"
        as_map = f"map_from_arrays(ck, if(size(ck) = size(cs), cs.value, {last}))"
        general = bind(valid, "cs", bind("array_distinct(cs.key)", "ck", as_map))
        keys = f"json_object_keys({x})"
        settled = f"{x} RLIKE {pattern(SETTLED_OBJECT)} AND size(array_distinct({keys})) = size({keys})"
        plain = f"map_filter(from_json({x}, 'map<string,string>'), (k, v) -> v <> '')"
        return f"CASE WHEN {settled} THEN {plain} ELSE {general} END"

    return apply_sql(json_text, build)


def header_union(cells: DataFrame) -> DataFrame:
    """Distinct valid keys of a run (of cells or keys); ``first_*`` columns give the order of first sight."""
    rank = F.when(F.col("origin") == "header", 0).when(F.col("origin") == "entry", 1).otherwise(2)
    seen = F.struct(
        F.col("file_seq"), rank.alias("origin_rank"), F.col("entry_idx"), F.col("key_pos")
    )
    return (
        drop_invalid_keys(cells)
        .groupBy("key")
        .agg(F.min(seen).alias("first"))
        .select("key", F.col("first.file_seq").alias("first_file_seq"), "first")
    )


def key_counts(cells: DataFrame, key: str = "raw_key") -> DataFrame:
    """Occurrences of each key over data and entries; order by count descending, key."""
    return cells.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("count"))


def keys_by_count(cells: DataFrame, key: str = "raw_key") -> DataFrame:
    """``key_counts``, most frequent first, then by key."""
    return key_counts(cells, key).orderBy(F.desc("count"), "key")


def first_n_samples(cells: DataFrame, n: int = 3) -> DataFrame:
    """First ``n`` non-null values per key (each map task keeps its own first ``n`` only)."""
    order = Window.partitionBy("raw_key").orderBy("file_seq", "file_id", "entry_idx", "key_pos")
    ranked = cells.where(F.col("kind") != "null").withColumn("sample_no", F.row_number().over(order))
    return ranked.where(F.col("sample_no") <= n)


def field_samples(cells: DataFrame, n: int = 3, width: int = 80) -> DataFrame:
    """Up to ``n`` sample values per key, each cut to ``width`` characters."""
    return (
        first_n_samples(cells, n)
        .groupBy(F.col("raw_key").alias("key"))
        .agg(
            F.array_sort(
                F.collect_list(F.struct("sample_no", F.substring("value", 1, width).alias("value")))
            ).alias("s")
        )
        .select("key", F.col("s.value").alias("samples"))
    )


def value_preview(cells: DataFrame, keys: DataFrame) -> DataFrame:
    """Values found under each template key: one row per key and file. ``keys`` is a template, so it goes to the cells; they stay where they are."""
    names = F.broadcast(keys.select(F.col("key").alias("raw_key"), "pos"))
    return cells.join(names, "raw_key").select(
        "pos", F.col("raw_key").alias("key"), F.coalesce("file_name", "file_id").alias("file_name"), "file_seq", "value"
    )


def preview_file_count(results: DataFrame) -> DataFrame:
    return results.agg(F.count_distinct(F.coalesce("file_id", "file_name")).alias("file_count"))
