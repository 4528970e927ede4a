"""The declared output columns and how extracted keys meet them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmerge.functions.keys import normalize_key, normalize_key_sql
from docmerge.functions.jsontext import pairs_sql
from docmerge.functions.text import bind, is_blank, pattern, quoted
from docmerge.functions.values import infer_type, normalize_value
from docmerge.schemas import Template, TemplateColumn

_SETTLED = re.compile(r"[A-Za-z_一-鿿]+")
TYPES = ("string", "number", "boolean")

def normalized_keys(spark: SparkSession, keys: list[str]) -> dict[str, str]:
    """Clean form of each template key; keys that are plain words need no job."""
    known = {k: k for k in keys if _SETTLED.fullmatch(k)}
    open_keys = [k for k in dict.fromkeys(keys) if k not in known]
    if open_keys:
        df = spark.createDataFrame([(k,) for k in open_keys], "key string")
        known |= {r.key: r.norm for r in df.select("key", normalize_key("key").alias("norm")).collect()}
    return known

def repeating_columns(template: Template) -> list[str]:
    return [c.key for c in template if c.repeating]

def non_repeating_columns(template: Template) -> list[str]:
    return [c.key for c in template if not c.repeating]

def valid_template(columns: DataFrame) -> DataFrame:
    """Usable template rows: named, known type, described; the first of equal keys stays."""
    good = columns.where(~is_blank("key") & F.col("type").isin(*TYPES) & F.col("description").isNotNull())
    return good.groupBy("key").agg(F.min_by(F.struct(*[c for c in columns.columns if c != "key"]), "pos").alias("c")).select(
        "key", "c.*"
    )

def template_from_answers(answers: DataFrame, column: str = "json") -> DataFrame:
    """Usable template rows of answers to ``template_prompt`` (a JSON object with ``columns``).

    Of equal keys the first counts, by ``file_seq`` if the answers have it, then by place.
    """
    schema = "columns array<struct<key:string,type:string,description:string,example:string,repeating:boolean>>"
    seq = [c for c in ("file_seq",) if c in answers.columns]
    columns = answers.select(*seq, F.posexplode(F.from_json(column, schema)["columns"]).alias("at", "c"))
    return valid_template(columns.select(F.struct(*seq, "at").alias("pos"), "c.*"))

def template_candidates(spark: SparkSession, template: Template) -> list[tuple[int, str, str, int]]:
    """(pos, key, clean candidate, priority): the whole key first, then the parts of a/b/c keys."""
    names = [[c.key, *(c.key.split("/") if "/" in c.key else [])] for c in template]
    norm = normalized_keys(spark, [n for group in names for n in group])
    return [
        (pos, group[0], norm[name], prio) for pos, group in enumerate(names) for prio, name in enumerate(group)
    ]

_HITS = "array<struct<pos:int,column:string,prio:int>>"


def _hits(names: dict[str, list[tuple[int, str, int]]], name: str) -> Column:
    """Template columns (pos, column, prio) that the name in a column of cells can fill."""
    entries = [
        e for k, hits in names.items()
        for e in (F.lit(k), F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(c).alias("column"), F.lit(q).alias("prio")) for p, c, q in hits]))
    ]
    return F.try_element_at(F.create_map(*entries).cast(f"map<string,{_HITS}>"), F.col(name))


def resolve_template(
    cells: DataFrame, template: Template, object_cols: tuple[str, ...] = ("file_id", "origin", "entry_idx")
) -> DataFrame:
    """Value of each template column for each object: one row per object and found column.

    The exact key wins, then its clean form, then the parts of an ``a/b/c`` key from
    left to right; of several keys with one clean form the last counts.
    """
    exact, clean = {}, {}
    for pos, c in enumerate(template):
        exact.setdefault(c.key, []).append((pos, c.key, -1))
    for pos, column, key, prio in template_candidates(cells.sparkSession, template):
        clean.setdefault(key, []).append((pos, column, prio))
    # A template is small: its names stand in the expression, so cells that no column asks for are dropped where they are read.
    direct = F.when(F.col("kind") != "null", _hits(exact, "raw_key"))
    fuzzy = F.filter(_hits(clean, "key"), lambda h: ~F.exists(F.coalesce(direct, F.array().cast(_HITS)), lambda d: d["pos"] == h["pos"]))
    hits = F.concat(F.coalesce(direct, F.array().cast(_HITS)), F.coalesce(fuzzy, F.array().cast(_HITS)))
    found = cells.select(*object_cols, "key_pos", F.struct("kind", "value").alias("v"), F.inline(hits))
    best = found.groupBy(*object_cols, "pos", "column").agg(F.min_by("v", F.struct("prio", -F.col("key_pos"))).alias("v"))
    return best.where(F.col("v.kind") != "null").select(
        *object_cols, "pos", F.col("column").alias("key"), F.col("v.value").alias("value")
    )

def sql_string(text: str) -> str:
    return pattern(text) if "\\" not in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def with_norm_sql(pairs: str) -> str:
    """Pairs with the clean form of their key as ``norm``."""
    return f"transform({pairs}, p -> named_struct('key', p.key, 'norm', {normalize_key_sql('p.key')}, 'kind', p.kind, 'text', p.text))"


def resolve_sql(pairs: str, key: str, candidates: list[str]) -> str:
    """The pair that fills one template column, found among pairs with ``norm``."""
    exact = f"try_element_at(filter({pairs}, p -> p.key = {sql_string(key)} AND p.kind <> 'null'), -1)"
    fuzzy = [f"try_element_at(filter({pairs}, p -> p.norm = {sql_string(c)}), -1)" for c in candidates]
    return f"coalesce({', '.join([exact, *fuzzy])})"


def candidates_by_key(spark: SparkSession, template: Template) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for _, key, candidate, _ in template_candidates(spark, template):
        found.setdefault(key, []).append(candidate)
    return found


def resolve_template_json(df: DataFrame, column: str, template: Template, nulls: bool = False) -> DataFrame:
    """As ``resolve_template`` for a column of JSON objects; nothing is shuffled.

    With ``nulls`` a column that is not found is a row too, with a null value.
    """
    cells = [
        f"named_struct('pos', {pos}, 'key', {sql_string(key)}, 'hit', {resolve_sql('np', key, names)})"
        for pos, (key, names) in enumerate(candidates_by_key(df.sparkSession, template).items())
    ]
    found = bind(with_norm_sql(pairs_sql(quoted(column), loose=True)), "np", f"array({', '.join(cells)})")
    hits = df.withColumn("__hits", F.expr(found if nulls else f"filter({found}, c -> c.hit.kind <> 'null')"))
    value = F.when(F.col("hit.kind") != "null", normalize_value("hit"))
    return hits.select(*df.columns, F.inline("__hits").alias("pos", "key", "hit")).withColumn("value", value).drop("hit")


def template_mismatch(entry_keys: Column, template_norm: dict[str, str]) -> Column:
    """Keys of one entry outside of the template, and template keys it lacks."""
    norms = F.array(*[F.lit(n) for n in template_norm.values()])
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(n).alias("norm")) for k, n in template_norm.items()])
    have = F.transform(entry_keys, normalize_key)
    extra = F.filter(entry_keys, lambda k: ~F.array_contains(norms, normalize_key(k)))
    missing = F.transform(F.filter(pairs, lambda p: ~F.array_contains(have, p["norm"])), lambda p: p["key"])
    return F.struct(
        extra.alias("extra"),
        missing.alias("missing"),
        ((F.size(extra) == 0) & (F.size(missing) == 0)).alias("matched"),
    )

def infer_template(df: DataFrame, order: str | None = None) -> DataFrame:
    """Template of a table: per column its first non-blank example and the type it suggests.

    Rows are ranked by ``order``, else as they are read; each map task keeps one
    candidate per column and no row is moved.
    """
    rank = F.col(order) if order else F.monotonically_increasing_id()
    columns = [c for c in df.columns if c != order]
    named = df.select(rank.alias("__row"), *[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    firsts = named.agg(*[F.min_by(f"`{c}`", F.when(~is_blank(f"`{c}`"), F.col("__row"))).alias(c) for c in columns])
    found = F.array(
        *[
            F.struct(F.lit(i).alias("pos"), F.lit(c).alias("key"), F.coalesce(F.col(f"`{c}`"), F.lit("")).alias("example"))
            for i, c in enumerate(columns)
        ]
    )
    return firsts.select(F.inline(found)).select(
        "pos",
        "key",
        infer_type("example").alias("type"),
        F.col("key").alias("description"),
        "example",
        F.lit(False).alias("repeating"),
    )

def infer_type_of(value: str) -> str:
    """``infer_type`` for a single header example typed by a user."""
    word = re.fullmatch(r"true|false|yes|no|是|否", value, re.I)
    return "boolean" if word else "number" if re.fullmatch(r"-?[0-9]+(\.[0-9]+)?", value) else "string"

def template_from_text(text: str) -> Template | None:
    """Template from pasted headers or a list of names; None if a model has to read the text."""
    lines = [line for line in re.split(r"\r?\n", text.strip()) if line.strip()]
    if not lines:
        return None
    head, one_line = lines[0], len(lines) == 1
    separator = "\t" if "\t" in head else "," if head.count(",") >= 2 else None
    if separator:
        names = [h.strip() for h in head.split(separator) if h.strip()]
    else:
        names = head.split() if one_line and 3 <= len(head.split()) <= 15 else []
    if len(names) >= 2:
        cut = separator if separator == "\t" else ","
        examples = [] if one_line else [v.strip() for v in lines[1].split(cut) if v.strip()]
        examples += [""] * (len(names) - len(examples))
        return [
            TemplateColumn(n, infer_type_of(e) if e else "string", n, e) for n, e in zip(names, examples)
        ]
    words = [line.strip() for line in lines]
    listed = not re.search(r"[\t,\s]", words[0]) if one_line else not any(re.search(r"[\t,]", w) for w in words)
    return [TemplateColumn(w, "string", w) for w in dict.fromkeys(words)] if listed else None

def import_keys(template: Template, keys: list[str]) -> Template:
    """Template with further string columns for keys it does not have yet."""
    have = {c.key for c in template}
    return template + [TemplateColumn(k, "string", k) for k in dict.fromkeys(keys) if k not in have]

def add_key(template: Template, name: str) -> Template:
    return import_keys(template, [name.strip()]) if name.strip() else template

__all__ = [n for n in dir() if not n.startswith("_") and n not in ("re", "trim", "annotations")]
