"""Result versions, retries, resume and expiry."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmerge.operators.identity import ID, id_columns, join_on, row_hash


def _keep_first(df: DataFrame, order: list[Column]) -> DataFrame:
    """One row per file of a session; map tasks drop the losers before the shuffle. What ``order`` leaves open goes by the row's hash."""
    window = Window.partitionBy(*id_columns(df)).orderBy(*order, row_hash(df))
    return df.withColumn("__rank", F.row_number().over(window)).where("__rank = 1").drop("__rank")


def _newest(df: DataFrame) -> list[Column]:
    return [F.desc(c) for c in ("result_seq", "attempt") if c in df.columns]


def latest_results(results: DataFrame) -> DataFrame:
    """The last written result of each file of a session; of equal versions the later attempt."""
    return _keep_first(results, _newest(results))


def best_results(results: DataFrame, n_fields: str = "n_fields") -> DataFrame:
    """Success beats failure, then more fields, then the earlier result, then the earlier attempt."""
    fields = F.when(F.col("success"), F.col(n_fields)).otherwise(0)
    return _keep_first(results, [F.desc("success"), fields.desc(), *[F.asc(c) for c in ("result_seq", "attempt") if c in results.columns]])


def field_count(data_json: str = "data_json", entries_json: str = "entries_json") -> Column:
    """Keys of the data object, or the number of entries."""
    keys = F.size(F.json_object_keys(data_json))
    return F.when(F.col(data_json).isNotNull(), keys).otherwise(F.coalesce(F.size(entries_json), F.lit(0)))


def field_count_label(data_json: str = "data_json", entries_json: str = "entries_json") -> Column:
    """Displayed size: "n", or "entries×keys of the first entry"."""
    first = F.coalesce(F.size(F.json_object_keys(F.get(entries_json, F.lit(0)))), F.lit(0))
    return (
        F.when(~F.col("success"), "—")
        .when(F.col(data_json).isNotNull(), F.size(F.json_object_keys(data_json)).cast("string"))
        .when(
            F.col(entries_json).isNotNull(),
            F.concat(F.size(entries_json).cast("string"), F.lit("×"), first.cast("string")),
        )
        .otherwise("—")
    )


def successful(df: DataFrame) -> DataFrame:
    return df.where("success")


def failed(df: DataFrame) -> DataFrame:
    return df.where(~F.col("success"))


def header_or_data_present(results: DataFrame) -> bool:
    """Any successful result with entries or data; stops at the first one found."""
    have = F.lit(False)
    if "entries_json" in results.columns:
        have = have | (F.size("entries_json") > 0)
    if "data_json" in results.columns:
        have = have | (F.size(F.json_object_keys("data_json")) > 0)
    return not results.where(F.col("success") & F.coalesce(have, F.lit(False))).isEmpty()


def has_header(results: DataFrame) -> bool:
    return not results.where(F.col("success") & (F.size(F.json_object_keys("header_json")) > 0)).isEmpty()


def pending_files(files: DataFrame, results: DataFrame, force: bool = False) -> DataFrame:
    """Files without a successful result in their session."""
    return files if force else join_on(files, successful(results), id_columns(files, results), "left_anti")


def inherit_group(files: DataFrame, results: DataFrame) -> DataFrame:
    """Keep the group that an earlier result of the file had in its session."""
    key = id_columns(files, results)
    earlier = latest_results(results).select(*key, F.col("group_id").alias("__earlier"))
    if len(key) < len(id_columns(results)):  # files without sessions: one of the file's groups
        earlier = earlier.groupBy(*key).agg(F.max("__earlier").alias("__earlier"))
    group = F.coalesce(F.when(F.col("__earlier") != "", F.col("__earlier")), F.col("group_id"))
    return join_on(files, earlier, key, "left").withColumn("group_id", group).drop("__earlier")


EXPIRED = "source file is no longer available"


def resume_plan(files: DataFrame, results: DataFrame, available: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files to work on, failed results for pending files whose source is gone)."""
    pending = pending_files(files, results)
    stored = available.select(*ID)
    inline = pending.where(F.col("session_id").isNull())
    held = pending.where(F.col("session_id").isNotNull())
    work = held.join(stored, list(ID), "left_semi").unionByName(inline)
    gone = held.join(stored, list(ID), "left_anti").select(
        "session_id",
        "file_id",
        "file_name",
        "file_seq",
        F.lit("").alias("group_id"),
        F.lit(False).alias("success"),
        F.lit(EXPIRED).alias("error"),
    )
    return work, gone


def overlay_retry(results: DataFrame, retry: DataFrame) -> DataFrame:
    """Retry success replaces a result but keeps its group; retry failure only updates the error.

    Of several retries of a file a successful one counts, of these the newest.
    """
    key = id_columns(results, retry)
    retry = retry.select([c for c in retry.columns if c in key or c not in ID])
    again = F.struct(*[c for c in results.columns if c in retry.columns])
    fresh = _keep_first(retry, [F.desc("success"), *_newest(retry)]).select(*key, again.alias("__new"))
    new_ok = F.coalesce(F.col("__new.success"), F.lit(False))
    tried = F.col("__new").isNotNull()
    columns = []
    for name in results.columns:
        old = F.col(name)
        if name in (*ID, "group_id") or name not in retry.columns:
            columns.append(old)
        elif name == "error":
            columns.append(F.when(tried, F.col("__new.error")).otherwise(old).alias(name))
        else:
            columns.append(F.when(new_ok, F.col(f"__new.`{name}`")).otherwise(old).alias(name))
    return join_on(results, fresh, key, "left").select(*columns)


def all_results(*parts: DataFrame) -> DataFrame:
    """Existing, new and synthetic failed results in one table."""
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    return union


def live_sessions(df: DataFrame, now: Column | datetime | None = None, max_age: str = "24 hours") -> DataFrame:
    """Rows of sessions that are not older than ``max_age``; unknown age is kept."""
    now = F.current_timestamp() if now is None else now if isinstance(now, Column) else F.lit(now)
    cutoff = now - F.expr(f"INTERVAL {max_age}")
    return df.where(F.col("created_at").isNull() | (F.col("created_at") >= cutoff))


expire_sessions = live_sessions


def session_latest(sessions: DataFrame, status: str = "extracting") -> DataFrame:
    """The newest interrupted session."""
    return sessions.where(F.col("status") == status).orderBy(F.desc("created_at"), "session_id").limit(1)
