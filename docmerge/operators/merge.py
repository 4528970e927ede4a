"""Merging all results of a group by rule: the first given value wins, others are conflicts.

Order is explicit everywhere: (file_seq, file_id, origin, entry_idx, key_pos).  Per-group
work is aggregation with map-side partial results, so a group that holds a large
part of all files costs one partial row per task and key.  Things that grow with
the number of files of a group (source names, conflict values) stay long.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmerge.functions.text import bind, let
from docmerge.operators.cells import clean_map, entry_objects, mergeable, to_cells
from docmerge.operators.grouping import UNKNOWN_GROUP
from docmerge.operators.identity import ID, id_columns, join_on
from docmerge.operators.ordering import scan_totals
from docmerge.operators.template import normalized_keys, sql_string
from docmerge.schemas import Template

METHOD = "programmatic"


# Decimal places of an order key: 20 digits of the file's order, one of the origin, then these.
_ENTRY_DIGITS, _KEY_DIGITS = 10, 6
_INNER = 10 ** (1 + _ENTRY_DIGITS + _KEY_DIGITS)


def _decimal(number: int) -> Column:
    return F.lit(str(number)).cast("decimal(20,0)")


def seen_order() -> Column:
    """Order in which the cells of a group are read, as one number of fixed width: (file_seq, origin, entry_idx, key_pos).

    Aggregates of such numbers are hashed; a struct, or one that held the file's id, would have every cell sorted.
    """
    rank = F.when(F.col("origin") == "header", 0).when(F.col("origin") == "entry", 1).otherwise(2).cast("bigint")
    inner = rank * 10 ** (_ENTRY_DIGITS + _KEY_DIGITS) + F.coalesce("entry_idx", F.lit(0)) * 10**_KEY_DIGITS + F.least("key_pos", F.lit(10**_KEY_DIGITS - 1))
    file = F.coalesce(F.col("file_seq").cast("decimal(20,0)") + _decimal(2**63 + 1), _decimal(0)).cast("decimal(20,0)")
    return (file * F.lit(_INNER).cast("decimal(18,0)") + inner.cast("decimal(18,0)")).cast("decimal(38,0)")


def seen_parts(seen: str) -> dict[str, Column]:
    """``seen_file_seq``, ``seen_entry_idx`` and ``seen_key_pos`` of an order number."""
    inner = F.col(seen) % F.lit(_INNER).cast("decimal(38,0)")
    file = ((F.col(seen) - inner) / F.lit(_INNER).cast("decimal(18,0)")).cast("decimal(20,0)")
    number = inner.cast("bigint")
    return {
        "seen_file_seq": F.when(file != 0, (file - _decimal(2**63 + 1)).cast("bigint")),
        "seen_entry_idx": F.floor(number % 10 ** (_ENTRY_DIGITS + _KEY_DIGITS) / 10**_KEY_DIGITS).cast("bigint"),
        "seen_key_pos": (number % 10**_KEY_DIGITS).cast("int"),
    }


def first_seen(cells: DataFrame) -> DataFrame:
    """Distinct values of each (group, key) with the order number of their first cell; no cell is sorted for it."""
    return named_groups(cells).groupBy("group_id", "key", "value").agg(F.min(seen_order()).alias("seen"))


def merge_header(cells: DataFrame) -> DataFrame:
    """First value per (group, key), and whether all values agree; where two files have one place, the smaller value is first.

    A map task keeps one row of a (group, key), however many values it has: the first value, and the least and the greatest, which are one if all agree.
    """
    value = F.col("value")
    merged = named_groups(cells).groupBy("group_id", "key").agg(
        F.min(F.struct(seen_order().alias("seen"), value)).alias("first"), F.min(value).alias("least"), F.max(value).alias("most"), F.bool_or(value.isNull()).alias("gaps"),
    )
    agree = F.col("least").eqNullSafe(F.col("most")) & (~F.col("gaps") | F.col("least").isNull())
    return merged.select("group_id", "key", "first.value", "first.seen", agree.alias("consistent"))


def detect_conflicts(cells: DataFrame) -> DataFrame:
    """Distinct values of (group, key) pairs that have more than one.

    One row per value; ``seen_*`` order them, the first row is the value that won.
    """
    values = first_seen(cells)
    split = values.groupBy("group_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group_id", "key")
    return values.join(split, ["group_id", "key"], "left_semi").withColumns(seen_parts("seen")).drop("seen")


def named_groups(rows: DataFrame) -> DataFrame:
    """Rows without a group belong to the group of unknown files."""
    return rows.withColumn("group_id", F.coalesce("group_id", F.lit(UNKNOWN_GROUP)))


def grouped(results: DataFrame) -> DataFrame:
    """Successful results; those without a group form the group of unknown files."""
    return named_groups(results.where("success"))


def source_files(results: DataFrame) -> DataFrame:
    """Distinct file names of each group's successful results, in order of first sight."""
    return grouped(results).groupBy("group_id", "file_name").agg(F.min("file_seq").alias("seen_file_seq"))


def merge_start(results: DataFrame) -> DataFrame:
    """Files and successful files per group."""
    return named_groups(results).groupBy("group_id").agg(
        F.count(F.lit(1)).alias("file_count"), F.count_if("success").alias("success_count")
    )


def group_maps(firsts: DataFrame) -> DataFrame:
    """Merged key/value pairs as one map per group, keys in order of first sight."""
    pairs = F.array_sort(F.collect_list(F.struct("seen", "key", "value", "consistent")))

    def to_maps(p: Column) -> Column:
        return F.struct(
            F.map_from_arrays(p["key"], p["value"]).alias("data"),
            F.map_from_arrays(p["key"], p["consistent"]).alias("consistency"),
        )

    return firsts.groupBy("group_id").agg(pairs.alias("p")).select("group_id", let(F.col("p"), to_maps).alias("m")).select(
        "group_id", "m.*"
    )


def override(header: str, entry: str) -> Column:
    """Header fields with the entry's values on equal keys, then the entry's own keys."""
    general = f"""map_concat(transform_values({header}, (k, v) -> coalesce(try_element_at({entry}, k), v)),
        map_filter({entry}, (k, v) -> NOT map_contains_key({header}, k)))"""
    apart = f"exists(map_keys({entry}), k -> map_contains_key({header}, k))"
    return F.expr(f"if({apart}, {general}, map_concat({header}, {entry}))")


def moved(data: str, template_norm: dict[str, str], strict: bool) -> str:
    """Keys in the clean form of a template key moved to the template's spelling, unless ``strict``.

    Merged keys are clean, so a spelling that is not clean is never there already; data and consistency move alike.
    """
    names = {n: k for k, n in template_norm.items() if n != k}
    if not names or strict:
        return data
    spelled = f"map({', '.join(f'{sql_string(n)}, {sql_string(k)}' for n, k in names.items())})"
    target = f"coalesce(try_element_at({spelled}, k), k)"
    return bind(data, "md", f"transform_keys(md, (k, v) -> if(map_contains_key(md, {target}), k, {target}))")


def pad(data: str, template_norm: dict[str, str], strict: bool) -> Column:
    """Add a null for each template column that the row lacks, after keys have moved."""
    data = moved(data, template_norm, strict)
    slots = ", ".join(f"named_struct('key', {sql_string(k)}, 'norm', {sql_string(n)})" for k, n in template_norm.items())
    present = "map_contains_key(pd, s.key)" + (" OR map_contains_key(pd, s.norm)" if strict else "")
    absent = f"transform(filter(array({slots}), s -> NOT ({present})), s -> s.key)"
    nulls = "map_from_arrays(ab, transform(ab, a -> CAST(NULL AS string)))"
    return F.expr(bind(data, "pd", bind(absent, "ab", f"if(size(ab) = 0, pd, map_concat(pd, {nulls}))")))


def row_id(n_rows: Column, idx: Column) -> Column:
    return F.when(n_rows > 1, F.concat_ws("-", "group_id", idx.cast("string"))).otherwise(F.col("group_id"))


def row_label(n_rows: Column, idx: Column) -> Column:
    return F.when(n_rows > 1, F.concat(F.col("group_key"), F.lit(" #"), (idx + 1).cast("string"))).otherwise(
        F.col("group_key")
    )


def number_rows(rows: DataFrame, order: Sequence[str] = ("file_seq", "entry_idx")) -> DataFrame:
    """Row ids and labels: the group's own if it has one row, else with a counter."""
    rows = named_groups(rows)
    if "group_key" in rows.columns:
        rows = rows.withColumn("group_key", F.coalesce("group_key", "group_id"))
    # Rows of equal places go to one range and are told apart there: the rows are read and moved once, counts come with the numbers.
    numbered = scan_totals(rows, ["group_id"], list(order), out="row_no", total="n_rows")
    n, i = F.col("n_rows"), F.col("row_no")
    return numbered.withColumns({"row_id": row_id(n, i), "label": row_label(n, i)})


def _with_group_key(df: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Labels come from the group table; without one the id is the label."""
    if groups is None:
        return df.withColumn("group_key", F.col("group_id"))
    return df.join(groups.select("group_id", "group_key"), "group_id")


def count_entries(entries: DataFrame) -> DataFrame:
    return entries.groupBy(*id_columns(entries)).agg(F.count(F.lit(1)).alias("n_entries"))


def _entry_counts(ok: DataFrame, entries: DataFrame | None, counts: DataFrame | None = None) -> DataFrame:
    if entries is None:
        size = F.coalesce(F.size("entries_json"), F.lit(0)) if "entries_json" in ok.columns else F.lit(0)
        return ok.withColumn("n_entries", size.cast("bigint"))
    counts = count_entries(entries) if counts is None else counts
    key = id_columns(ok, counts)
    return join_on(ok, counts.select(*key, "n_entries"), key, "left").withColumn("n_entries", F.coalesce("n_entries", F.lit(0)))


ROW_COLUMNS = (
    "row_id", "group_id", "group_seq", "entry_idx", "label", "data", "n_sources", "is_merged", "field_consistency",
    "merge_method",
)


def merge_nested(
    results: DataFrame,
    entries: DataFrame | None = None,
    template: Template | None = None,
    groups: DataFrame | None = None,
    strict: bool = False,
    entry_counts: DataFrame | None = None,
) -> DataFrame:
    """One row per entry of a group, each with the group's merged header fields.

    ``entries`` may be a long table (file_id, entry_idx 0..n-1, entry_json) in place of the
    array column, with ``entry_counts`` (file_id, n_entries) if they are known.  Entries move once, to meet their file; everything per group is
    computed on narrow columns.
    """
    ok = grouped(results)
    origins = ("header",) if strict else ("header", "data")
    headers = group_maps(merge_header(mergeable(to_cells(ok, origins=origins))))

    slim = [c for c in ("group_id", *ID, "file_name", "file_seq", "entries_json") if c in ok.columns]
    files = _entry_counts(ok.select(*slim), entries, entry_counts).drop("entries_json")
    stats = files.groupBy("group_id").agg(
        F.count_distinct("file_name").alias("n_sources"),
        F.count(F.lit(1)).alias("n_files"),
        F.sum("n_entries").alias("n_rows"),
        F.min("file_seq").alias("group_seq"),
    )
    empty = F.create_map().cast("map<string,string>")
    group_info = _with_group_key(stats.join(headers, "group_id", "left"), groups).withColumns(
        {
            "header": F.coalesce("data", empty),
            "header_consistency": F.coalesce("consistency", F.create_map().cast("map<string,boolean>")),
        }
    ).drop("data", "consistency")

    own = id_columns(ok)
    placed = scan_totals(
        files.where("n_entries > 0").select("group_id", *own, "file_seq", "n_entries"),
        ["group_id"], ["file_seq", "file_id", *[c for c in own if c != "file_id"]], weight=F.col("n_entries"), out="row_base",
    )
    objects = entry_objects(ok.select(*own, *[c for c in ("entries_json",) if c in ok.columns])) if entries is None else entries
    key = id_columns(ok, objects)
    context = placed.select("group_id", *key, "row_base").join(group_info, "group_id")
    parsed = objects.select(*key, "entry_idx", F.coalesce(clean_map("entry_json"), empty).alias("entry"))
    entry_rows = join_on(parsed, context, key).select(
        *group_info.columns,
        (F.col("row_base") + F.col("entry_idx")).alias("entry_idx"),
        override("header", "entry").alias("data"),
    )
    header_rows = group_info.where("n_rows = 0").select(
        *group_info.columns, F.lit(0).cast("bigint").alias("entry_idx"), F.col("header").alias("data")
    )
    rows = entry_rows.unionByName(header_rows)

    if template:
        norm = normalized_keys(results.sparkSession, [c.key for c in template])
        checked = F.expr(moved("header_consistency", norm, strict))
        rows = rows.withColumns({"data": pad("data", norm, strict), "header_consistency": checked})
    consistency = F.map_from_arrays(
        F.map_keys("data"),
        F.transform(
            F.map_keys("data"), lambda k: F.coalesce(F.try_element_at(F.col("header_consistency"), k), F.lit(True))
        ),
    )
    n, i = F.col("n_rows"), F.col("entry_idx")
    return rows.withColumns(
        {
            "row_id": row_id(n, i),
            "label": row_label(n, i),
            "is_merged": (F.col("n_files") > 1) | (n > 1),
            "field_consistency": consistency,
            "merge_method": F.lit(METHOD),
        }
    ).select(*ROW_COLUMNS)


def flat_cells(
    results: DataFrame, entries: DataFrame | None = None, strict: bool = False, entry_counts: DataFrame | None = None
) -> DataFrame:
    """Cells of the flat form: a file's entries if it has some, else its data object.

    The header counts as a further source ahead of both, unless ``strict``.
    """
    ok = grouped(results)
    counted = _entry_counts(ok, entries, entry_counts)
    with_entries = counted.where("n_entries > 0")
    parts = [
        to_cells(with_entries, entries, origins=("entry",), strip_prefix=True),
        to_cells(counted.where("n_entries = 0"), origins=("data",), strip_prefix=True),
    ]
    if not strict:
        parts.append(to_cells(ok, origins=("header",), strip_prefix=True))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return mergeable(union)


def merge_flat(
    results: DataFrame,
    entries: DataFrame | None = None,
    template: Template | None = None,
    groups: DataFrame | None = None,
    strict: bool = False,
    entry_counts: DataFrame | None = None,
) -> DataFrame:
    """One row per group: every object of the group folded together, first given value first.

    ``n_sources`` is the number of distinct file names, as in ``source_files``.
    """
    ok = grouped(results)
    own = F.when(F.col("n_entries") > 0, F.col("n_entries")).otherwise(
        F.col("data_json").isNotNull().cast("bigint") if "data_json" in ok.columns else F.lit(0).cast("bigint")
    )
    if not strict and "header_json" in ok.columns:
        own = F.greatest(own, F.col("header_json").isNotNull().cast("bigint"))
    stats = (
        _entry_counts(ok, entries, entry_counts)
        .withColumn("n_objects", own)
        .where("n_objects > 0")
        .groupBy("group_id")
        .agg(
            F.sum("n_objects").alias("n_objects"),
            F.count_distinct("file_name").alias("n_sources"),
            F.min("file_seq").alias("group_seq"),
        )
    )
    maps = group_maps(merge_header(flat_cells(results, entries, strict, entry_counts)))
    norm = normalized_keys(results.sparkSession, [c.key for c in template]) if template else {}
    data = pad("coalesce(data, cast(map() AS map<string,string>))", norm, strict) if template else F.expr("coalesce(data, cast(map() AS map<string,string>))")
    checked = F.expr(moved("coalesce(consistency, cast(map() AS map<string,boolean>))", norm, strict))
    return (
        _with_group_key(stats.join(maps, "group_id", "left"), groups)
        .withColumns(
            {
                "row_id": F.col("group_id"),
                "entry_idx": F.lit(0).cast("bigint"),
                "label": F.col("group_key"),
                "data": data,
                "is_merged": F.col("n_objects") > 1,
                "field_consistency": checked,
                "merge_method": F.lit(METHOD),
            }
        )
        .select(*ROW_COLUMNS)
    )


def replace_group_rows(rows: DataFrame, new: DataFrame, group_ids: DataFrame | None = None) -> DataFrame:
    """Rows with those of retried groups replaced; an emptied group disappears."""
    retried = (new if group_ids is None else group_ids).select("group_id").distinct()
    return rows.join(retried, "group_id", "left_anti").unionByName(new, allowMissingColumns=True)
