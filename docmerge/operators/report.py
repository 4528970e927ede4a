"""Counts, run reports and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def extraction_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("success").alias("succeeded"),
        F.count_if(~F.col("success")).alias("failed"),
    )


def session_progress(results: DataFrame) -> DataFrame:
    """Completed, failed and all files per session."""
    return results.groupBy("session_id").agg(
        F.count_if("success").alias("completed"),
        F.count_if(~F.col("success")).alias("failed"),
        F.count(F.lit(1)).alias("total"),
    )


def run_report(log: DataFrame) -> DataFrame:
    """Per kind of event: how often, how many succeeded or failed, fields and conflicts seen."""
    data = F.col("data")
    ok = F.get_json_object(data, "$.success")
    fields = F.size(F.json_object_keys(F.get_json_object(data, "$.data")))
    conflicts = F.json_array_length(F.get_json_object(data, "$.conflicts"))
    return log.groupBy("event").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(ok == "true").alias("n_success"),
        F.count_if((ok == "false") | (F.col("event") == "error")).alias("n_failed"),
        F.coalesce(F.sum(F.when(fields > 0, fields)), F.lit(0)).alias("n_fields"),
        F.coalesce(F.sum(conflicts), F.lit(0)).alias("n_conflicts"),
    )


def run_phases(log: DataFrame) -> DataFrame:
    return log.where("event = 'phase'").select(F.get_json_object("data", "$.phase").alias("phase"), *_time(log))


def run_files(log: DataFrame) -> DataFrame:
    """Outcome of each file of a run."""
    d = F.col("data")
    return log.where("event = 'file_complete'").select(
        F.get_json_object(d, "$.fileId").alias("file_id"),
        F.get_json_object(d, "$.fileName").alias("file_name"),
        (F.get_json_object(d, "$.success") == "true").alias("success"),
        F.coalesce(F.size(F.json_object_keys(F.get_json_object(d, "$.data"))), F.lit(0)).alias("n_fields"),
        F.get_json_object(d, "$.error").alias("error"),
        *_time(log),
    )


def run_groups(log: DataFrame) -> DataFrame:
    """Merged groups of a run with their number of conflicts."""
    d = F.col("data")
    return log.where("event = 'group_merged'").select(
        F.get_json_object(d, "$.groupKey").alias("group_key"),
        F.get_json_object(d, "$.mergeMethod").alias("merge_method"),
        F.json_array_length(F.get_json_object(d, "$.conflicts")).alias("n_conflicts"),
        *_time(log),
    )


def run_totals(log: DataFrame) -> DataFrame:
    """Totals that the run itself reported at its end."""
    d = F.col("data")
    return log.where("event = 'all_done'").select(
        F.get_json_object(d, "$.totalFiles").cast("bigint").alias("total_files"),
        F.get_json_object(d, "$.totalGroups").cast("bigint").alias("total_groups"),
        F.get_json_object(d, "$.mergedGroups").cast("bigint").alias("merged_groups"),
        F.json_array_length(F.get_json_object(d, "$.rows")).alias("n_rows"),
        *_time(log),
    )


def run_errors(log: DataFrame) -> DataFrame:
    return log.where("event = 'error'").select(F.get_json_object("data", "$.message").alias("message"), *_time(log))


def run_retries(log: DataFrame) -> DataFrame:
    """Retries per file."""
    return (
        log.where("event = 'file_retry'")
        .groupBy(F.get_json_object("data", "$.fileId").alias("file_id"))
        .agg(F.count(F.lit(1)).alias("n_retries"))
    )


def run_summary(log: DataFrame) -> DataFrame:
    """The whole report of a run from one scan: totals, and the same numbers by phase, file and group.

    ``part`` is "total", "phase", "file" or "group", ``name`` the phase, file id or group key. Events that name none of a kind only count in the others.
    """
    data = F.col("data")
    text = lambda path: F.get_json_object(data, path)
    is_event = lambda name: F.col("event") == name
    done = is_event("file_complete")
    fields = F.size(F.json_object_keys(F.when(done, text("$.data"))))
    facts = log.select(
        "event", text("$.phase").alias("phase"), text("$.fileId").alias("file"), text("$.groupKey").alias("group"), (text("$.success") == "true").alias("good"),
        F.when(fields > 0, fields).alias("fields"), F.json_array_length(F.when(is_event("group_merged"), text("$.conflicts"))).alias("conflicts"), text("$.totalFiles").cast("bigint").alias("total_files"),
    )
    sets = [["phase"], ["file"], ["group"], []]
    counted = facts.groupingSets(sets, "phase", "file", "group").agg(
        F.grouping_id().alias("set"),
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(done & F.col("good")).alias("n_succeeded"),
        F.count_if(done & ~F.coalesce("good", F.lit(False))).alias("n_failed"),
        F.count_if(is_event("file_retry")).alias("n_retries"),
        F.count_if(is_event("group_merged")).alias("n_merged"),
        F.count_if(is_event("error")).alias("n_errors"),
        F.coalesce(F.sum("fields"), F.lit(0)).alias("n_fields"),
        F.coalesce(F.sum("conflicts"), F.lit(0)).alias("n_conflicts"),
        F.max("total_files").alias("total_files"),
    )
    part = F.element_at(F.create_map(*[F.lit(x) for x in (3, "phase", 5, "file", 6, "group", 7, "total")]), F.col("set").cast("int"))
    named = counted.select(part.alias("part"), F.coalesce("phase", "file", "group").alias("name"), *[c for c in counted.columns if c.startswith(("n_", "total"))])
    return named.where("part = 'total' OR name IS NOT NULL")


def _time(log: DataFrame) -> list:
    return [F.col("ts")] if "ts" in log.columns else []


def progress_eta(batches: DataFrame, total: str = "total_batches", duration: str = "duration_ms") -> DataFrame:
    """Time left per session: mean batch time times the batches still to come."""
    done = F.count(F.lit(1))
    left = F.greatest(F.max(total) - done, F.lit(0))
    return batches.groupBy("session_id").agg(
        F.avg(duration).alias("mean_ms"), left.alias("remaining"), (F.avg(duration) * left).alias("eta_ms")
    )
