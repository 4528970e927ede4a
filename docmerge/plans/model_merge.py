"""Merging and aligning by a model, for groups that rules cannot settle.

A prompt holds at most ``max_files`` files or, if asked for, ``max_bytes`` of them.  A larger group is put in several parts along its file order; the answers
of the parts go into prompts of their own in the next round, until every group is one answer.  A group with a refused
part comes out as one row with ``merge_method`` "error" and the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmerge.functions.jsontext import pairs_sql, quote_json
from docmerge.functions.keys import is_structure_key
from docmerge.functions.values import normalize_value_sql
from docmerge.operators.grouping import UNKNOWN_GROUP
from docmerge.operators.identity import id_columns
from docmerge.operators.ordering import scan_totals, with_position
from docmerge.operators.template import candidates_by_key, normalized_keys, resolve_sql, sql_string, template_mismatch, with_norm_sql
from docmerge.operators.validate import entries_from_response
from docmerge.plans.extract import parsed
from docmerge.plans.prompts import ALIGN_SYSTEM, LONG_FORM_COLUMNS, LONG_FORM_NOTE, MERGE_SYSTEM, MIXED_RECORDS_NOTE
from docmerge.plans.rounds import Model, run_rounds
from docmerge.schemas import Template
from docmerge.session import checkpointed

KEYS = ["group_id"]
PARTS = ["group_id", "part"]
#: Files in one prompt of a merge; larger groups take further rounds.
MAX_FILES = 500
_CONFLICTS = "array<struct<field_name:string,values:array<string>>>"
_MAP = "map<string,string>"


def _usable(results: DataFrame) -> DataFrame:
    return results.where("success AND data_json IS NOT NULL").withColumn("group_id", F.coalesce("group_id", F.lit(UNKNOWN_GROUP)))


def _items(results: DataFrame) -> DataFrame:
    """What a prompt lists: successful results with their place in the group, and the number of the group's results."""
    ok = _usable(results)
    tie = id_columns(ok)[::-1]
    slim = ok.select("group_id", "file_seq", *tie, F.coalesce("file_name", F.lit("")).alias("file_name"), "data_json")
    return with_position(slim, KEYS, tie=tie, total="n").select("group_id", "pos", "file_name", "data_json", "n")


def _listed(items: DataFrame, max_files: int | None, max_bytes: int | None) -> DataFrame:
    """The items as texts with the part of their group that they go to.

    By bytes, and then whatever their number is, a group is cut at every half of the bound along a running sum of lengths, and behind every item of more than half of
    it: what lies between two cuts stays within the bound, unless it is one item.
    """
    one = F.concat(
        F.lit('{"file_name":'), quote_json(F.col("file_name")), F.lit(',"extracted_data":'), F.col("data_json"), F.lit("}")
    )
    if not max_bytes:
        part = F.floor(F.col("pos") / max_files) if max_files else F.lit(0)
        return items.select("group_id", part.cast("bigint").alias("part"), F.struct("pos", one.alias("one")).alias("item"))
    texts = items.select("group_id", "pos", one.alias("one"), (F.octet_length(one) + 2).cast("bigint").alias("bytes"))
    sums = scan_totals(texts.select("group_id", "pos", "bytes"), KEYS, ["pos"], weight=F.col("bytes"), out="start")
    half = max_bytes // 2
    part = F.floor(F.col("start") / half) * 2 + (F.col("bytes") > half).cast("bigint")
    cut = sums.select("group_id", "pos", part.cast("bigint").alias("part"))
    return texts.join(cut, ["group_id", "pos"]).select("group_id", "part", F.struct("pos", "one").alias("item"))


def _prompts(items: DataFrame, max_files: int | None, max_bytes: int | None = None) -> DataFrame:
    listed = _listed(items, max_files, max_bytes)
    return listed.groupBy(*PARTS).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.array_join(F.transform(F.array_sort(F.collect_list("item")), lambda s: s["one"]), ",\n").alias("__files"),
    ).select(
        *PARTS,
        "n_files",
        F.lit(MERGE_SYSTEM).alias("system_prompt"),
        F.concat(F.lit("Group "), quote_json(F.col("group_id")), F.lit(":\n[\n"), F.col("__files"), F.lit("\n]")).alias("user_prompt"),
    )


def merge_prompt(results: DataFrame, max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Per group (and part, if a number of files or bytes is given): the prompt text and the number of files in it.

    ``max_bytes`` bounds the listed files of one prompt, unless a single file is longer.
    """
    items = _items(results)
    return _prompts(checkpointed(items) if max_bytes else items, max_files, max_bytes)


def input_keys(results: DataFrame) -> DataFrame:
    """Union of the data keys of each group."""
    keys = _usable(results).select("group_id", F.explode(F.json_object_keys("data_json")).alias("key")).distinct()
    return keys.groupBy("group_id").agg(F.array_sort(F.collect_list("key")).alias("input_keys"))


def missing_keys(entry_keys: Column, input_keys_col: Column) -> Column:
    """Input keys that a merged record lost."""
    return F.array_except(input_keys_col, entry_keys)


def _entry_map(column: str) -> Column:
    pairs = f"filter({pairs_sql(f'`{column}`', loose=True)}, p -> NOT p.key RLIKE '(?i)^(system_prompt|instructions|task|_meta|merged|entries|conflicts)$')"
    return F.expr(f"map_from_arrays(transform({pairs}, p -> p.key), transform({pairs}, p -> {normalize_value_sql('p')}))")


def merged_records(answers: DataFrame, keys: DataFrame) -> DataFrame:
    """Records of merge answers: structure keys dropped, lost keys as null and reported."""
    rows = entries_from_response(answers, "json").join(keys, KEYS, "left")
    one = F.when(F.size("entries") == 0, F.array(F.lit("{}"))).otherwise(F.col("entries"))
    rows = rows.select(*KEYS, "conflicts", "input_keys", F.posexplode(one).alias("entry_idx", "entry"))
    rows = rows.withColumn("data", _entry_map("entry"))
    lost = missing_keys(F.map_keys("data"), F.coalesce("input_keys", F.array().cast("array<string>")))
    rows = rows.withColumn("lost", lost)
    nulls = F.map_from_arrays("lost", F.transform("lost", lambda _: F.lit(None).cast("string")))
    note = F.array(F.struct(F.lit("_missing_keys").alias("field_name"), F.col("lost").alias("values"))).cast(_CONFLICTS)
    return rows.select(
        *KEYS,
        F.col("entry_idx").cast("bigint").alias("entry_idx"),
        F.map_concat("data", nulls).alias("data"),
        F.when(F.size("lost") > 0, F.concat("conflicts", note)).otherwise(F.col("conflicts")).alias("conflicts"),
        F.lit("ai").alias("merge_method"),
    )


def _judge(answers: DataFrame) -> DataFrame:
    return parsed(answers).withColumn("reject_reason", F.coalesce("call_error", "parse_error")).drop("parse_error")


def _error_rows(refused: DataFrame, columns: list[str]) -> DataFrame:
    """One row per group whose answers were refused."""
    rows = refused.groupBy("group_id").agg(F.min(F.coalesce("reject_reason", "call_error")).alias("error")).select(
        "group_id",
        F.lit(0).cast("bigint").alias("entry_idx"),
        F.create_map().cast(_MAP).alias("data"),
        F.array().cast(_CONFLICTS).alias("conflicts"),
        F.lit("error").alias("merge_method"),
        "error",
        *[F.lit(None).cast("int").alias(c) for c in columns if c == "attempt"],
    )
    return rows.select(columns)


def merge_groups_with_model(results: DataFrame, model: Model, max_files: int = MAX_FILES, max_attempts: int = 1, max_bytes: int | None = None) -> DataFrame:
    """Groups of several successful files merged by the model; single files pass through, refused groups are error rows.

    ``max_bytes`` bounds the files of a prompt by their length instead of their number; a group whose answers are so long
    that each of them needs a prompt of its own is an error row too.
    """
    if max_files < 2:
        raise ValueError("a prompt has to hold two files to merge them")
    placed = _items(results)
    items = placed.where("n > 1")
    items = checkpointed(items) if max_bytes else items
    merged = failed = None
    while True:
        prompts = checkpointed(_prompts(items, max_files, max_bytes))
        cuts = checkpointed(prompts.groupBy("group_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("n_files").alias("files")))
        stuck = cuts.where("parts > 1 AND parts = files").select("group_id")
        answers, refused = run_rounds(prompts.join(stuck, "group_id", "left_anti"), model, _judge, PARTS, max_attempts)
        bad = checkpointed(refused.select("group_id", F.coalesce("reject_reason", "call_error").alias("reject_reason"), F.lit(None).cast("string").alias("call_error")))
        bad = bad.unionByName(stuck.select("group_id", F.lit("the prompt's bound holds no two answers").alias("reject_reason"), F.lit(None).cast("string").alias("call_error")))
        failed = bad if failed is None else failed.unionByName(bad)
        good = answers.join(bad.select("group_id").distinct(), "group_id", "left_anti")
        good = checkpointed(good.join(cuts.select("group_id", (F.col("parts") > 1).alias("several")), "group_id").select(*PARTS, "several", "json"))
        whole = good.where("NOT several").select("group_id", "json")
        merged = whole if merged is None else merged.unionByName(whole)
        rest = good.where("several")
        if rest.isEmpty():
            break
        name = F.concat(F.lit("merged part "), (F.col("part") + 1).cast("string"))
        items = checkpointed(rest.select("group_id", F.col("part").alias("pos"), name.alias("file_name"), F.col("json").alias("data_json")))
    records = merged_records(merged, input_keys(results)).withColumn("error", F.lit(None).cast("string"))
    passed = placed.where("n = 1").select(
        "group_id",
        F.lit(0).cast("bigint").alias("entry_idx"),
        _entry_map("data_json").alias("data"),
        F.array().cast(_CONFLICTS).alias("conflicts"),
        F.lit("single").alias("merge_method"),
        F.lit(None).cast("string").alias("error"),
    )
    return records.unionByName(passed).unionByName(_error_rows(failed, records.columns))


def align_prompt(merged: DataFrame, template: Template) -> DataFrame:
    """Per group: merged records and the columns to map them to."""
    lines = "\n".join(f"- {c.key}" + (f" ({c.description})" if c.description else "") for c in template)
    long_form = any(c.key in LONG_FORM_COLUMNS for c in template)
    note = LONG_FORM_NOTE if long_form else ""
    hint = MIXED_RECORDS_NOTE
    grouped = merged.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("entry_idx", F.to_json("data", {"ignoreNullFields": "false"}).alias("j")))).alias("rs"),
        (F.count_distinct(F.array_join(F.array_sort(F.map_keys("data")), ",")) > 1).alias("mixed"),
    )
    return grouped.select(
        *KEYS,
        F.lit(ALIGN_SYSTEM).alias("system_prompt"),
        F.concat(
            F.lit("Group "), quote_json(F.col("group_id")), F.lit(":\n["),
            F.array_join(F.transform("rs", lambda r: r["j"]), ",\n"), F.lit(f"]\n\nColumns:\n{lines}{note}"),
            F.when(F.col("mixed"), hint).otherwise(""),
        ).alias("user_prompt"),
    )


def align_with_model(merged: DataFrame, template: Template, model: Model, max_attempts: int = 3) -> DataFrame:
    """Records mapped to the template; mismatches go back to the model, then the rest is enforced.

    Groups that came with an error keep it; a group without readable JSON becomes an error row.
    """
    broken = merged.where("merge_method = 'error'")
    merged = merged.where("merge_method <> 'error'")
    norm = normalized_keys(merged.sparkSession, [c.key for c in template])
    candidates = candidates_by_key(merged.sparkSession, template)

    def check(answers: DataFrame) -> DataFrame:
        rows = entries_from_response(_judge(answers), "json")
        bad = F.filter(
            F.transform("entries", lambda e: template_mismatch(F.filter(F.json_object_keys(e), lambda k: ~is_structure_key(k)), norm)),
            lambda m: ~m["matched"],
        )
        first = F.get(bad, F.lit(0))
        text = F.concat(
            F.lit("keys outside of the template: "), F.array_join(first["extra"], ", "),
            F.lit("; missing columns: "), F.array_join(first["missing"], ", "),
        )
        return rows.withColumn("reject_reason", F.coalesce("reject_reason", F.when(F.size(bad) > 0, text)))

    good, last = run_rounds(align_prompt(merged, template), model, check, KEYS, max_attempts)
    rows = good.unionByName(last.where("json IS NOT NULL"))
    unread = last.where("json IS NULL")
    one = F.when(F.size("entries") == 0, F.array(F.lit("{}"))).otherwise(F.col("entries"))
    pairs = with_norm_sql(pairs_sql("entry", loose=True))
    cells = ", ".join(
        f"{sql_string(k)}, coalesce(transform(array({resolve_sql('np', k, c)}), p -> {normalize_value_sql('p')})[0], '')"
        for k, c in candidates.items()
    )
    data = F.expr(f"get(transform(array({pairs}), np -> map({cells})), 0)")
    aligned = rows.select(*KEYS, "conflicts", "attempt", F.posexplode(one).alias("entry_idx", "entry")).select(
        *KEYS, F.col("entry_idx").cast("bigint").alias("entry_idx"), data.alias("data"), "conflicts", "attempt",
        F.lit("ai").alias("merge_method"), F.lit(None).cast("string").alias("error"),
    )
    kept = broken.select(*[F.lit(None).cast("int").alias(c) if c == "attempt" else F.col(c) for c in aligned.columns])
    return aligned.unionByName(_error_rows(unread, aligned.columns)).unionByName(kept)
