"""Named queries over the warehouse tables, one per operator or group of operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmerge import functions as fn
from docmerge.operators import cells as C
from docmerge.operators import grouping as G
from docmerge.operators import merge as M
from docmerge.operators import report as R
from docmerge.operators import reshape as S
from docmerge.operators import state as ST
from docmerge.operators import template as TP
from docmerge.operators import validate as V
from docmerge.operators.select import preview, rename_columns, select_export_columns, select_rows
from docmerge.plans import extract as X
from docmerge.plans import model_merge as MM
from docmerge.plans.align import merge_results
from docmerge.plans.extract import facts_extractor
from docmerge.plans.prompts import extraction_prompts
from docmerge.plans.prompts import template_prompt as template_prompt_of
from docmerge.schemas import PivotPreset, TemplateColumn
from docmerge.session import ensure_checkpoint_dir, stored
from docmerge.sinks.results import current_results
from docmerge.sinks.text import csv_line
from docmerge.sources import files as SF
from docmerge.sources import tables as T
from docmerge.streaming import flows

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

HEADER_KEYS = [c.key for c in T.ORDER_TEMPLATE if not c.repeating]
ALL_KEYS = [c.key for c in T.ORDER_TEMPLATE]


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    from docmerge import flow_queries

    return _QUERIES | flow_queries.queries()


# --- grouping ----------------------------------------------------------------


@query
def group_files(spark, sf):
    return G.group_files(T.document_files(spark, sf)).drop("group_key")


@query
def group_manifest_merge(spark, sf):
    files = T.document_files(spark, sf)
    old = G.group_members(files.where("session_id IN ('en', 'de')"))
    both = G.merge_groups_manifest(old, G.group_members(files))
    return G.manifest_counts(both).select("group_id", "file_count", "group_seq")


@query
def group_manifest_appended(spark, sf):
    files = T.document_files(spark, sf)
    old = G.group_members(files.where("session_id IN ('en', 'de')"))
    both = G.merge_groups_manifest(old, G.group_members(files))
    return G.manifest_counts(both, distinct=False).select("group_id", "file_count")


@query
def assign_group(spark, sf):
    files = T.document_files(spark, sf)
    labelled = T.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("file_id"))
    members = G.group_members(files.join(labelled, "file_id", "left_semi"))
    return G.assign_group(files, members).select("file_id", "group_id")


@query
def fallback_groups(spark, sf):
    return G.fallback_groups(T.order_results(spark, sf))


@query
def accumulate_group_counts(spark, sf):
    files = G.with_group(T.document_files(spark, sf))
    batches = files.groupBy("session_id", "group_id", "group_key").agg(
        F.count(F.lit(1)).alias("file_count"), F.min("file_seq").alias("group_seq")
    )
    return G.accumulate_group_counts(batches.withColumn("batch_seq", F.col("session_id"))).drop("group_key")


@query
def filter_groups(spark, sf):
    files = T.document_files(spark, sf)
    toxic = T.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("file_id"))
    wanted = G.with_group(files.join(toxic, "file_id", "left_semi"))
    return G.filter_groups(G.group_files(files), wanted).select("group_id", "file_count")


@query
def batch_numbers(spark, sf):
    return G.batch_numbers(T.document_files(spark, sf)).select("session_id", "file_id", "batch_no")


@query
def check_limits(spark, sf):
    files = T.document_files(spark, sf).withColumn("session_id", F.lit("all"))
    return SF.check_upload_limits(files)


@query
def file_verdicts(spark, sf):
    """Pages and documents as uploads: extension and size rules."""
    pages = T.table(spark, sf, "pages")
    return SF.with_verdict(
        pages.select("page_id", F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1).alias("file_name"), F.octet_length("html").alias("size"))
    ).select("page_id", "ext", "reject_reason")


# --- keys --------------------------------------------------------------------


@query
def normalize_keys(spark, sf):
    return T.raw_keys(spark, sf).select("key_id", fn.normalize_key("raw_key").alias("key"))


@query
def valid_keys(spark, sf):
    return T.number_like_keys(spark, sf).select("key_id", fn.is_valid_key("raw_key").alias("valid"))


@query
def key_checks(spark, sf):
    keys = T.raw_keys(spark, sf)
    return keys.select(
        "key_id",
        fn.clean_key_suffix("raw_key").alias("bare"),
        fn.strip_leading_punct(F.concat(F.lit(":; -"), F.col("raw_key"))).alias("led"),
        fn.is_joined_header_key(F.repeat(F.concat("raw_key", F.lit("-")), (F.col("key_id") % 7).cast("int"))).alias("joined"),
    )


# --- cells -------------------------------------------------------------------


def _results(spark, sf):
    return T.order_results(spark, sf), T.order_lines(spark, sf)


@query
def to_cells(spark, sf):
    results, entries = _results(spark, sf)
    return C.to_cells(results, entries).select("file_id", "origin", "entry_idx", "key_pos", "key", "value")


@query
def extraction_summary(spark, sf):
    return R.extraction_summary(T.order_results(spark, sf))


@query
def session_progress(spark, sf):
    return R.session_progress(T.order_results(spark, sf))


@query
def header_union(spark, sf):
    results = ST.successful(T.order_results(spark, sf))
    cells = C.to_keys(results, T.order_lines(spark, sf, numbered=False))
    return C.header_union(cells).select("key", "first_file_seq")


@query
def key_counts(spark, sf):
    results = ST.successful(T.order_results(spark, sf))
    return C.key_counts(C.to_keys(results, T.order_lines(spark, sf, numbered=False), origins=("header", "entry")))


@query
def field_samples(spark, sf):
    cells = C.to_cells(*_results(spark, sf))
    return C.field_samples(cells).select(
        "key", *[F.get("samples", F.lit(i)).alias(f"sample{i + 1}") for i in range(3)]
    )


@query
def template_prompt(spark, sf):
    prompt = template_prompt_of(C.field_samples(C.to_cells(*_results(spark, sf))))
    return prompt.select("user_prompt")


@query
def template_from_answers(spark, sf):
    """Columns proposed for each part: unknown types, blank keys and repeated keys are dropped."""
    p = F.col("p_partkey")
    column = F.struct(
        F.when(p % 9 == 0, " ").otherwise(F.col("p_brand")).alias("key"), F.when(p % 4 == 0, "date").otherwise("string").alias("type"),
        F.col("p_name").alias("description"), F.col("p_type").alias("example"), (p % 2 == 0).alias("repeating"),
    )
    answers = T.table(spark, sf, "part").select(p.alias("file_seq"), F.to_json(F.struct(F.array(column).alias("columns"))).alias("json"))
    return TP.template_from_answers(answers).select("key", "type")


@query
def value_preview(spark, sf):
    cells = C.to_cells(*_results(spark, sf))
    keys = spark.createDataFrame(list(enumerate(ALL_KEYS)), "pos int, key string")
    return C.value_preview(cells, keys).select("key", "file_name", "value")


@query
def preview_file_count(spark, sf):
    return C.preview_file_count(T.order_results(spark, sf))


def _entry_counts(spark, sf):
    """Lines per order, counted without numbering them."""
    return M.count_entries(T.order_lines(spark, sf, numbered=False))


def _messy_orders(spark, sf):
    """Order documents with nulls, empty texts, decorated and invalid keys, repeated inner keys and nested arrays."""
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    state = F.when(k % 3 == 0, "null").when(k % 3 == 1, '""').otherwise(F.concat(F.lit('"'), status, F.lit('"')))
    doc = F.concat(
        F.lit('{"1-状态":'), state, F.lit(',"2024-01-15":"x","检验结果2-priority{":"'), F.col("o_orderpriority"),
        F.when(k % 2 == 0, '","twice":{"k":1,"k":2}').otherwise('","twice":"once"'), F.lit(',"_note":"n","list":[['), k.cast("string"), F.lit(',[[]]],"'), status, F.lit('"]}'),
    )
    return T.table(spark, sf, "orders").select(
        F.lit("g").alias("group_id"), k.cast("string").alias("file_id"), k.cast("string").alias("file_name"), k.alias("file_seq"), F.lit(True).alias("success"), doc.alias("data_json"),
    )


@query
def messy_cells(spark, sf):
    """Empty cells, invalid, structure and hidden keys dropped; nested arrays as one text; repeated inner keys kept."""
    cells = C.to_cells(_messy_orders(spark, sf), origins=("data",))
    return C.drop_hidden_keys(C.drop_structure_keys(C.mergeable(cells))).select("file_id", "key", "value")


@query
def messy_merge(spark, sf):
    """The same documents folded by order year: first given value, conflicts, sources."""
    orders = T.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("file_id"), F.year("o_orderdate").cast("string").alias("year"))
    results = _messy_orders(spark, sf).join(orders, "file_id").withColumn("group_id", F.when(F.col("year") != "1995", F.col("year")))
    rows = M.merge_flat(results, template=[TemplateColumn("1-状态"), TemplateColumn("priority")])
    value = lambda key: F.try_element_at(F.col("data"), F.lit(key))
    return rows.select("group_id", value("1-状态").alias("state"), value("priority").alias("priority"), F.try_element_at(F.col("field_consistency"), F.lit("1-状态")).alias("consistent"), "n_sources")


@query
def field_counts(spark, sf):
    k = F.col("o_orderkey")
    entries = F.transform(F.sequence(F.lit(1), (k % 4).cast("int") + 1), lambda i: F.to_json(F.struct(i.alias("n"), k.alias("o"))))
    rows = T.table(spark, sf, "orders").select(
        k, (k % 5 != 0).alias("success"), F.when(k % 2 == 0, F.to_json(F.struct("o_orderstatus", "o_orderpriority", "o_custkey"))).alias("data_json"),
        F.when(k % 3 != 0, entries).alias("entries_json"),
    )
    return rows.select("o_orderkey", ST.field_count().cast("bigint").alias("n_fields"), ST.field_count_label().alias("label"))


@query
def repaired_names(spark, sf):
    """Names whose UTF-8 bytes were read as Latin-1, and names that only look like it."""
    name = F.concat(F.lit("检验 "), "p_name")
    broken = F.decode(F.encode(name, "UTF-8"), "ISO-8859-1")
    shown = F.when(F.col("p_partkey") % 2 == 0, broken).otherwise(F.concat("p_name", F.lit(" é")))
    return T.table(spark, sf, "part").select("p_partkey", fn.repair_filename(shown).alias("name"))


@query
def chosen_rows(spark, sf):
    """Rows of chosen ids under the user's column names."""
    rows = M.merge_flat(T.order_results(spark, sf), template=T.ORDER_TEMPLATE)
    chosen = T.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("cust"), F.col("c_custkey").cast("string"), F.lit("x")).alias("row_id"))
    out = select_export_columns(select_rows(rows, chosen), HEADER_KEYS, keep=("row_id",))
    return rename_columns(out, {"customer": "Kunde", "status": "Stand"})


@query
def declared_columns(spark, sf):
    """Usable template rows of a table of declarations: named, of a known type, described; the first of equal keys."""
    p = F.col("p_partkey")
    rows = T.table(spark, sf, "part").select(
        p.alias("pos"), F.when(p % 7 == 0, " ").otherwise(F.col("p_brand")).alias("key"), F.when(p % 5 == 0, "date").when(p % 5 == 1, "number").otherwise("string").alias("type"),
        F.when(p % 11 != 0, F.col("p_name")).alias("description"), F.lit("").alias("example"), F.lit(False).alias("repeating"),
    )
    return TP.valid_template(rows).select("key", "type", "description")


# --- merging -----------------------------------------------------------------


def _header_cells(spark, sf):
    return C.mergeable(C.to_cells(ST.successful(T.order_results(spark, sf)), origins=("header",)))


@query
def merge_header(spark, sf):
    return M.merge_header(_header_cells(spark, sf)).select("group_id", "key", "value", "consistent")


@query
def detect_conflicts(spark, sf):
    return M.detect_conflicts(_header_cells(spark, sf)).select("group_id", "key", "value", "seen_file_seq")


@query
def source_files(spark, sf):
    return M.source_files(T.order_results(spark, sf))


@query
def merge_start(spark, sf):
    return M.merge_start(T.order_results(spark, sf))


def _wide(rows, keys=tuple(ALL_KEYS), checked=("status", "priority", "line")):
    return rows.select(
        "row_id", "group_id", "group_seq", "entry_idx", "label", "n_sources", "is_merged", "merge_method",
        *[F.try_element_at(F.col("data"), F.lit(k)).alias(k) for k in keys],
        *[F.try_element_at(F.col("field_consistency"), F.lit(k)).alias(f"{k}_consistent") for k in checked],
    )


@query
def merge_nested(spark, sf):
    return _wide(M.merge_nested(*_results(spark, sf), T.ORDER_TEMPLATE, entry_counts=_entry_counts(spark, sf)))


@query
def merge_flat(spark, sf):
    return _wide(M.merge_flat(*_results(spark, sf), T.ORDER_TEMPLATE, entry_counts=_entry_counts(spark, sf)))


# Keys that are cleaned on the way in and come out in the template's spelling.
_SPELLED = [TemplateColumn("1-status"), TemplateColumn("2-customer")]


def _spelled(rows):
    value = lambda k: F.try_element_at(F.col("data"), F.lit(k))
    consistent = F.try_element_at(F.col("field_consistency"), F.lit("1-status"))
    return rows.select("group_id", value("1-status").alias("status"), value("2-customer").alias("customer"), consistent.alias("consistent"), value("status").alias("bare"), "n_sources")


@query
def merge_nested_spelled(spark, sf):
    return _spelled(M.merge_nested(T.order_results(spark, sf), template=_SPELLED))


@query
def merge_flat_spelled(spark, sf):
    return _spelled(M.merge_flat(T.order_results(spark, sf), template=_SPELLED))


@query
def merge_flat_strict(spark, sf):
    """Without a template header fields are no source, as strict mode asks."""
    return _wide(
        M.merge_flat(*_results(spark, sf), strict=True, entry_counts=_entry_counts(spark, sf)),
        keys=("line", "flag", "linestatus", "qty", "part"), checked=("line", "qty"),
    )


@query
def number_rows(spark, sf):
    entries = T.order_lines(spark, sf)
    rows = entries.join(T.order_results(spark, sf), "file_id").withColumn("group_key", F.col("group_id"))
    return M.number_rows(rows.select("group_id", "group_key", "file_id", "file_seq", "entry_idx")).select(
        "file_id", "entry_idx", "row_id", "label"
    )


@query
def replace_group_rows(spark, sf):
    """Groups of automobile customers merged again without their unfilled orders."""
    results = T.order_results(spark, sf)
    rows = M.merge_flat(results, template=T.ORDER_TEMPLATE)
    auto = results.where(F.get_json_object("header_json", "$.segment") == "AUTOMOBILE")
    again = M.merge_flat(auto.where(F.get_json_object("header_json", "$.status") != "P"), template=T.ORDER_TEMPLATE)
    out = M.replace_group_rows(rows, again, auto)
    return select_export_columns(out, HEADER_KEYS, keep=("group_id",))


@query
def export_selection(spark, sf):
    """Long export: a template column that no row has gives null."""
    rows = merge_results(T.order_results(spark, sf), template=[c for c in T.ORDER_TEMPLATE if not c.repeating])
    return select_export_columns(rows, ["priority", "customer", "remarks"], keep=("group_id",))


@query
def preview_rows(spark, sf):
    rows = M.merge_flat(T.order_results(spark, sf), template=T.ORDER_TEMPLATE)
    return select_export_columns(preview(rows), HEADER_KEYS, keep=("group_id", "group_seq"))


# --- template ----------------------------------------------------------------

_SLASHED = [TemplateColumn("c/customer"), TemplateColumn("state/status"), TemplateColumn("priority"), TemplateColumn("remarks")]


@query
def resolve_template(spark, sf):
    return TP.resolve_template_json(T.order_results(spark, sf), "header_json", _SLASHED, nulls=True).select("file_id", "key", "value")


@query
def resolve_template_cells(spark, sf):
    cells = C.to_cells(*_results(spark, sf))
    found = TP.resolve_template(cells, [*_SLASHED, TemplateColumn("amount/qty", repeating=True)])
    return found.select("file_id", "entry_idx", "key", "value")


@query
def template_mismatch(spark, sf):
    results = T.order_results(spark, sf)
    norm = TP.normalized_keys(spark, ["customer", "status", "remarks"])
    keys = F.when(F.col("success"), F.json_object_keys("header_json")).otherwise(F.array(*[F.lit(k) for k in norm]))
    m = TP.template_mismatch(keys, norm)
    return results.select(
        "file_id",
        F.array_join(m["extra"], ",").alias("extra"),
        F.array_join(m["missing"], ",").alias("missing"),
        m["matched"].alias("matched"),
    )


@query
def infer_template(spark, sf):
    found = TP.infer_template(T.table(spark, sf, "part"), order="p_partkey")
    return found.select("pos", "key", "type", "example")


# --- pivot and flattening ------------------------------------------------------


def _pivot_rows(spark, sf):
    return M.merge_nested(*_results(spark, sf), T.ORDER_TEMPLATE, entry_counts=_entry_counts(spark, sf))


def _stored_pivot_rows(spark, sf):
    return stored(_pivot_rows(spark, sf).select("group_id", "group_seq", "entry_idx", "label", "data"), f"{shared_folder(spark)}/rows")


@query
def pivot_wide(spark, sf):
    return S.pivot_long_to_wide(_stored_pivot_rows(spark, sf), T.ORDER_TEMPLATE, [T.ORDER_PRESET])


@query
def pivot_cells(spark, sf):
    """Two presets; the second writes its values under other names."""
    presets = [T.ORDER_PRESET, PivotPreset(pivot_key="line", values=("qty",))]
    return S.pivot_cells(_stored_pivot_rows(spark, sf), T.ORDER_TEMPLATE, presets)


@query
def pivot_column_names(spark, sf):
    return S.pivot_column_names(_pivot_rows(spark, sf), T.ORDER_TEMPLATE, [T.ORDER_PRESET]).select("name")


@query
def flatten_dot(spark, sf):
    events = T.table(spark, sf, "events")
    flat = S.flatten_dot_json(events, "props", "fields")
    return flat.select("event_id", F.try_element_at(F.col("fields"), F.lit("k")).alias("k"))


def _nested_orders(spark, sf):
    """Order documents with nesting, an array and a null."""
    orders = T.table(spark, sf, "orders")
    doc = F.struct(
        F.struct(F.col("o_orderstatus").alias("code"), F.struct(F.col("o_orderpriority").alias("level")).alias("more")).alias("state"),
        F.array("o_orderkey", "o_custkey").alias("ids"),
        F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("even"),
    )
    return orders.select("o_orderkey", F.to_json(doc, {"ignoreNullFields": "false"}).alias("doc"))


@query
def flatten_hyphen(spark, sf):
    flat = S.flatten_hyphen(_nested_orders(spark, sf), "doc")
    return flat.select("o_orderkey", F.inline("pairs")).select("o_orderkey", "key", F.col("text").alias("value"))


@query
def flatten_dotted(spark, sf):
    flat = S.flatten_dot_json(_nested_orders(spark, sf), "doc")
    return flat.select("o_orderkey", F.explode("fields").alias("key", "value"))


@query
def flatten_preview(spark, sf):
    orders = T.table(spark, sf, "orders")
    doc = F.struct(
        F.struct(F.col("o_custkey").alias("value"), F.col("o_orderstatus").alias("unit")).alias("dose"),
        F.struct(F.lit(1).alias("x")).alias("_hidden"),
        F.struct(F.col("o_orderpriority").alias("level")).alias("more"),
    )
    flat = S.flatten_preview(orders.select("o_orderkey", F.to_json(doc).alias("doc")), "doc")
    return flat.select("o_orderkey", F.explode("fields").alias("key", "value"))


@query
def needs_flatten(spark, sf):
    orders = _nested_orders(spark, sf).unionByName(
        T.table(spark, sf, "orders").select(
            (-F.col("o_orderkey") - 1).alias("o_orderkey"),
            F.to_json(F.struct(F.struct(F.col("o_orderstatus").alias("code")).alias("state"))).alias("doc"),
        )
    )
    return orders.select("o_orderkey", S.needs_flatten("doc").alias("nested"))


@query
def sheet_rows(spark, sf):
    events = T.table(spark, sf, "events")
    item = lambda name, c: F.struct(F.lit(name).alias("name"), F.col(c).cast("bigint").alias("n"))
    nested = events.select(
        F.col("event_id").alias("id"),
        F.array(item("user", "user_id"), item("event", "event_id")).alias("parts"),
        F.array("event_type", F.lit("x")).alias("tags"),
        F.struct(F.struct(F.col("event_type").alias("kind")).alias("deep")).alias("meta"),
    )
    return S.sheet_rows(nested)


# --- result state --------------------------------------------------------------


@query
def latest_results(spark, sf):
    return ST.latest_results(T.result_versions(spark, sf)).select("file_id", "attempt", "success")


@query
def best_results(spark, sf):
    return ST.best_results(T.result_versions(spark, sf)).select("file_id", "attempt", "success", "n_fields")


@query
def pending_files(spark, sf):
    files = T.document_files(spark, sf)
    done = T.table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("file_id"), (F.col("quality") == 1).alias("success")
    )
    return ST.pending_files(files, done).select("file_id", "file_name")


@query
def inherit_group(spark, sf):
    versions = T.result_versions(spark, sf)
    files = T.order_results(spark, sf).select("file_id", "group_id")
    return ST.inherit_group(files, versions.where("attempt > 1"))


@query
def resume_plan(spark, sf):
    files = T.document_files(spark, sf)
    none = T.order_results(spark, sf).where("false").select("file_id", "success")
    labels = T.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("file_id"))
    stored = files.join(labels, "file_id", "left_semi")
    work, gone = ST.resume_plan(files, none, stored)
    return work.select("file_id", F.lit("work").alias("state"), F.lit(None).cast("string").alias("error")).unionByName(
        gone.select("file_id", F.lit("gone").alias("state"), "error")
    )


@query
def overlay_retry(spark, sf):
    versions = T.result_versions(spark, sf)
    return ST.overlay_retry(versions.where("attempt = 1"), versions.where("attempt = 2")).select(
        "file_id", "group_id", "attempt", "success", "n_fields", "error"
    )


@query
def all_results(spark, sf):
    versions = T.result_versions(spark, sf)
    retried = ST.all_results(
        versions.where("attempt = 1").drop("error"), versions.where("attempt = 2"), versions.where("attempt = 3")
    )
    return ST.failed(retried).select("file_id", "attempt", "error")


@query
def expire_sessions(spark, sf):
    sessions = T.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("session_id")).agg(
        F.min("o_orderdate").alias("created_at")
    )
    return ST.expire_sessions(sessions, F.expr("TIMESTAMP '1995-06-02 00:00:00'"), "180 days")


@query
def session_latest(spark, sf):
    orders = T.table(spark, sf, "orders")
    sessions = orders.select(
        F.col("o_orderkey").alias("session_id"),
        F.when(F.col("o_orderstatus") == "P", "extracting").otherwise("done").alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )
    return ST.session_latest(sessions)


# --- values, exports ------------------------------------------------------------


@query
def csv_escape(spark, sf):
    docs = T.table(spark, sf, "documents").withColumn("signed", F.concat(F.lit("-"), F.col("n_chars").cast("string")))
    return docs.select("doc_id", csv_line(["lang", "signed", "text"]).alias("line"))


@query
def infer_types(spark, sf):
    parts = T.table(spark, sf, "part")
    v = F.when(F.col("p_partkey") % 4 == 0, F.col("p_size").cast("string")).when(F.col("p_partkey") % 4 == 1, F.lit("Yes")).when(
        F.col("p_partkey") % 4 == 2, F.concat(F.lit("-"), F.col("p_size").cast("string"), F.lit(".5"))
    ).otherwise(F.col("p_name"))
    return parts.select("p_partkey", fn.infer_type(v).alias("type"))


@query
def normalize_values(spark, sf):
    orders = T.table(spark, sf, "orders")
    doc = F.struct(
        F.struct(F.col("o_custkey").alias("value"), F.lit("mg").alias("unit")).alias("dose"),
        F.array(F.col("o_orderstatus"), F.lit(""), F.col("o_orderpriority")).alias("list"),
        F.struct(F.col("o_orderkey").alias("z"), F.lit("b").alias("a")).alias("other"),
        (F.col("o_orderkey") % 2 == 0).alias("flag"),
    )
    pairs = orders.select("o_orderkey", F.inline(fn.json_pairs(F.to_json(doc)))).withColumn("pair", F.struct("kind", "text"))
    return pairs.select("o_orderkey", "key", fn.normalize_value("pair").alias("value"), fn.render_value("pair").alias("shown"))


@query
def data_urls(spark, sf):
    docs = T.table(spark, sf, "documents")
    url = fn.to_data_url(F.encode("text", "UTF-8"), F.lit(""))
    return docs.select("doc_id", url.alias("url"), fn.is_data_url(url).alias("valid"))


@query
def private_hosts(spark, sf):
    pages = T.table(spark, sf, "pages")
    inner = F.concat(F.lit("http://10."), (F.col("page_id") % 300).cast("string"), F.lit(".0.1/"))
    urls = pages.select("page_id", "url").unionByName(pages.select((-F.col("page_id") - 1).alias("page_id"), inner.alias("url")))
    return urls.select("page_id", fn.is_private_host("url").alias("private"))


# --- responses -------------------------------------------------------------------


@query
def parse_response(spark, sf):
    read = T.model_responses(spark, sf).select("file_id", fn.parse_json_response("response").alias("r"))
    return read.select(
        "file_id",
        F.col("r.layer").alias("layer"),
        F.get_json_object("r.json", "$.status").alias("status"),
        F.get_json_object("r.json", "$.priority").alias("priority"),
    )


@query
def validate_flat(spark, sf):
    checked = V.validate_flat(_nested_orders(spark, sf), "doc")
    return checked.select(
        "o_orderkey",
        "reject_reason",
        *[F.get_json_object("data_json", f"$.{k}").alias(n) for k, n in (("state-code", "code"), ("state-more-level", "level"), ("ids", "ids"), ("even", "even"))],
    )


@query
def reject_reasons(spark, sf):
    """Answers that flat mode refuses, one for each of its checks, among good ones."""
    k = F.col("o_orderkey")
    text = (
        F.when(k % 6 == 0, F.lit(None)).when(k % 6 == 1, "{}").when(k % 6 == 2, '{"a":1}').when(k % 6 == 3, '{"a-b-c-d-e-f":1,"x":2}')
        .when(k % 6 == 4, F.concat(F.lit('{"box":{"a":{"b":'), k.cast("string"), F.lit('},"c":[1,2]}}'))).otherwise('[1,{"x":2}]')
    )
    checked = V.validate_flat(T.table(spark, sf, "orders").select(k, text.alias("doc")), "doc")
    return checked.select("o_orderkey", "reject_reason", "data_json")


@query
def reject_reasons_guided(spark, sf):
    k = F.col("o_orderkey")
    text = (
        F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, '{"status":"a"}').when(k % 5 == 2, '{"status":null,"entries":[{"line":null}]}')
        .when(k % 5 == 3, '{"entries":[{}],"状态":"x"}').otherwise(F.concat(F.lit('{"status":"'), F.col("o_orderstatus"), F.lit('","entries":[{"line":1},{"no":2}]}')))
    )
    template = [TemplateColumn("status"), TemplateColumn("line", repeating=True)]
    checked = V.validate_schema_guided(T.table(spark, sf, "orders").select(k, text.alias("json")), template)
    return checked.select("o_orderkey", "reject_reason", "header_json", F.array_join("entries_json", "|").alias("entries"))


def _guided_responses(spark, sf):
    orders = T.table(spark, sf, "orders")
    line = lambda c: F.struct(F.col(c).alias("1-line"), F.lit("x").alias("junk"))
    doc = F.struct(
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("基本信息-status"),
        F.lit("r").alias("line"),
        F.array(line("o_custkey"), line("o_orderkey")).alias("entries"),
    )
    empty = F.struct(F.col("o_orderstatus").alias("status"))
    text = F.when(F.col("o_orderkey") % 7 == 0, F.to_json(empty)).otherwise(F.to_json(doc))
    return orders.select("o_orderkey", text.alias("json"))


@query
def validate_schema_guided(spark, sf):
    template = [TemplateColumn("status"), TemplateColumn("line", repeating=True)]
    checked = V.validate_schema_guided(_guided_responses(spark, sf), template)
    first = F.get("entries_json", F.lit(0))
    return checked.select(
        "o_orderkey",
        "reject_reason",
        F.get_json_object("header_json", "$.status").alias("status"),
        F.size("entries_json").cast("bigint").alias("n_entries"),
        F.get_json_object(first, "$.line").alias("line"),
        F.get_json_object(first, "$.junk").alias("junk"),
    )


@query
def entries_from_response(spark, sf):
    orders = T.table(spark, sf, "orders")
    one = F.struct(F.col("o_orderstatus").alias("status"))
    conflict = F.array(F.struct(F.lit("status").alias("field"), F.array("o_orderstatus", "o_orderpriority").alias("values")))
    m = F.col("o_orderkey") % 4
    text = (
        F.when(m == 0, F.to_json(F.struct(F.array(one, one).alias("entries"), conflict.alias("conflicts"))))
        .when(m == 1, F.to_json(F.struct(one.alias("merged"))))
        .when(m == 2, F.to_json(one))
        .otherwise(F.to_json(F.struct(conflict.alias("conflicts"))))
    )
    out = V.entries_from_response(orders.select("o_orderkey", text.alias("json")))
    return out.select(
        "o_orderkey",
        F.size("entries").cast("bigint").alias("n_entries"),
        F.get_json_object(F.get("entries", F.lit(0)), "$.status").alias("status"),
        F.size("conflicts").cast("bigint").alias("n_conflicts"),
        F.array_join(F.get("conflicts", F.lit(0))["values"], "|").alias("conflict_values"),
    )


# --- prompts and models ------------------------------------------------------------


def _flat_results(spark, sf):
    return T.order_results(spark, sf).withColumn("data_json", F.col("header_json"))


@query
def extraction_prompt_sizes(spark, sf):
    prompts = extraction_prompts(T.document_files(spark, sf), T.ORDER_TEMPLATE)
    return prompts.select("file_id", F.md5(F.col("user_prompt").cast("binary")).alias("prompt_md5"), F.length("system_prompt").cast("bigint").alias("system_chars"), F.length("text").cast("bigint").alias("text_chars"))


@query
def merge_prompt(spark, sf):
    prompts = MM.merge_prompt(_flat_results(spark, sf))
    body = F.regexp_extract("user_prompt", r"(?s)(\[\n.*\n\])$", 1)
    return prompts.select("group_id", "n_files", body.alias("files"))


@query
def extract_documents(spark, sf):
    out = X.extract_documents(T.document_files(spark, sf), facts_extractor)
    facts = [F.get_json_object("data_json", f"$.{k}").alias(k) for k in ("chars", "lines")]
    return out.select("file_id", "group_id", "success", *facts, "attempt")


@query
def conversation_prompts(spark, sf):
    """Turns of a conversation as the files of one group, put into merge prompts."""
    turns = T.table(spark, sf, "conversations")
    results = turns.select(
        F.col("conv_id").cast("string").alias("group_id"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("file_id"),
        F.col("role").alias("file_name"),
        F.col("turn").alias("file_seq"),
        F.lit(True).alias("success"),
        F.to_json(F.struct("text")).alias("data_json"),
    )
    return MM.merge_prompt(results).select("group_id", "n_files", F.length("user_prompt").cast("bigint").alias("chars"))


def first_file_model(prompts):
    """Stand-in for a merge model: takes the first file's fields, reports no conflict; earlier merges are opened."""
    import json

    answers = []
    for p in prompts:
        first = json.loads(p.user[p.user.index("[\n") :])[0]["extracted_data"]
        answers.append(json.dumps({"entries": first.get("entries", [first]), "conflicts": []}, ensure_ascii=False))
    return answers


def choosy_model(prompts):
    """As ``first_file_model``, but refuses groups whose first status is "P" and loses the priority of the others."""
    import json

    answers = []
    for answer in map(json.loads, first_file_model(prompts)):
        entry = answer["entries"][0]
        answers.append("nothing" if entry["status"] == "P" else json.dumps({"entries": [{k: v for k, v in entry.items() if k != "priority"}]}))
    return answers


def _merged(merged):
    return merged.select("group_id", "entry_idx", *[F.try_element_at(F.col("data"), F.lit(k)).alias(k) for k in HEADER_KEYS], "merge_method")


@query
def merge_groups_with_model(spark, sf):
    return _merged(MM.merge_groups_with_model(_flat_results(spark, sf), first_file_model))


@query
def merge_groups_in_parts(spark, sf):
    """The same records from prompts of three files, in as many rounds as the groups need."""
    return _merged(MM.merge_groups_with_model(_flat_results(spark, sf), first_file_model, max_files=3))


@query
def merge_groups_refused(spark, sf):
    """Refused groups come out as error rows, lost keys as nulls that are reported."""
    merged = MM.merge_groups_with_model(_flat_results(spark, sf), choosy_model)
    lost = F.array_join(F.flatten(F.transform("conflicts", lambda c: c["values"])), ",")
    return merged.select("group_id", F.try_element_at(F.col("data"), F.lit("status")).alias("status"), F.try_element_at(F.col("data"), F.lit("priority")).alias("priority"), lost.alias("lost"), "merge_method", F.col("error").isNotNull().alias("failed"))


def mapping_model(prompts):
    """Stand-in for an alignment model: keeps a stray key in its first answer, maps two columns when asked again."""
    import json

    answers = []
    for p in prompts:
        records = json.loads(p.user[p.user.index("[") : p.user.index("\n\nColumns:")])
        entries = [{"buyer": r.get("customer"), "state": r.get("status")} | ({} if p.feedback else {"stray": 1}) for r in records]
        answers.append(json.dumps({"entries": entries}))
    return answers


@query
def align_with_model(spark, sf):
    """Records mapped to other columns in the second attempt; groups that could not be merged stay error rows."""
    merged = MM.merge_groups_with_model(_flat_results(spark, sf), choosy_model)
    aligned = MM.align_with_model(merged, [TemplateColumn("buyer"), TemplateColumn("state")], mapping_model)
    return aligned.select("group_id", *[F.try_element_at(F.col("data"), F.lit(k)).alias(k) for k in ("buyer", "state")], "attempt", "merge_method", F.col("error").isNotNull().alias("failed"))


@query
def align_prompt(spark, sf):
    merged = MM.merge_groups_with_model(_flat_results(spark, sf), first_file_model)
    prompts = MM.align_prompt(merged, [TemplateColumn("buyer", "string", "who buys"), TemplateColumn("state")])
    return prompts.select("group_id", F.md5(F.col("user_prompt").cast("binary")).alias("prompt_md5"))


def moody_extractor(prompts):
    """Stand-in for a model: in its first answer unreadable or too short for some documents, then size facts."""
    answers = []
    for p, facts in zip(prompts, facts_extractor(prompts)):
        size = len(p.user) % 3
        answers.append(facts if p.feedback or size == 0 else "nothing" if size == 1 else '{"chars": 1}')
    return answers


@query
def extract_retried(spark, sf):
    """Refused answers are asked for again with the reason."""
    out = X.extract_documents(T.document_files(spark, sf), moody_extractor)
    return out.select("file_id", "success", F.get_json_object("data_json", "$.chars").alias("chars"), "attempt", "error")


def stubborn_extractor(prompts):
    """Stand-in for a model that ignores the form: size facts, and nothing at all for every third length."""
    return ["nothing" if len(p.user) % 3 == 0 else facts for p, facts in zip(prompts, facts_extractor(prompts))]


@query
def extract_fallback(spark, sf):
    """A form that is never filled: one attempt without it, or a failed result with the last reason."""
    template = [TemplateColumn("title"), TemplateColumn("item", repeating=True)]
    out = X.extract_documents(T.document_files(spark, sf), stubborn_extractor, template, max_attempts=2)
    return out.select("file_id", "success", F.get_json_object("data_json", "$.chars").alias("chars"), "attempt", F.col("error").isNotNull().alias("failed"))


# --- reports -------------------------------------------------------------------------


@query
def run_report(spark, sf):
    return R.run_report(T.event_log(spark, sf))


@query
def progress_eta(spark, sf):
    events = T.table(spark, sf, "events")
    batches = events.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("duration_ms"), F.lit(1000).alias("total_batches")
    )
    return R.progress_eta(batches)


# --- streams ---------------------------------------------------------------------------


def _stream(spark, sf, name):
    """A table as a stream, be it one file or a folder of files: a pattern, unlike a plain path, may name either."""
    schema = T.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def shared_folder(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"


def _run_complete(df: DataFrame) -> DataFrame:
    """Final state of a complete-mode stream, stored in the shared folder."""
    folder = shared_folder(df.sparkSession)

    def store(batch, _):
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    df.writeStream.outputMode("complete").foreachBatch(store).option("checkpointLocation", f"{folder}/state").trigger(
        availableNow=True
    ).start().awaitTermination()
    return df.sparkSession.read.parquet(f"{folder}/out")


def _run_append(df: DataFrame) -> DataFrame:
    folder = shared_folder(df.sparkSession)
    df.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/state"
    ).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.parquet(f"{folder}/out")


@query
def stream_progress(spark, sf):
    log = _stream(spark, sf, "events").select(F.col("event_type").alias("event"), F.col("props").alias("data"), "ts")
    return _run_complete(flows.stream_progress(log))


@query
def stream_file_status(spark, sf):
    log = _stream(spark, sf, "events").select(F.col("event_type").alias("event"), "ts", F.col("user_id").cast("string").alias("file_id"))
    return _run_complete(flows.stream_file_status(log))


def silent_model(prompts):
    return ["nothing"] * len(prompts)


@query
def stream_versions(spark, sf):
    """A stream run that fails everywhere, then one on a checkpoint of its own: its results replace the failures."""
    folder = shared_folder(spark)
    docs = _stream(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("file_id"), F.concat("source", F.lit("x_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), F.col("doc_id").alias("file_seq"), "text",
    )
    for run, model in enumerate((silent_model, facts_extractor)):
        flows.stream_extract(docs, model, f"{folder}/results", f"{folder}/state{run}", "s").awaitTermination()
    return current_results(spark, f"{folder}/results").select("file_id", "success", F.get_json_object("data_json", "$.chars").alias("chars"))


@query
def stream_group_counts(spark, sf):
    docs = _stream(spark, sf, "documents").select(F.concat("source", F.lit("x_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"))
    return _run_complete(flows.stream_group_counts(docs))


@query
def stream_dedup(spark, sf):
    results = _stream(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("file_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return _run_append(flows.stream_dedup(results, "20000 days")).select("file_id")
