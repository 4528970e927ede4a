"""Named queries over sessions, positions, stored files, streams and run logs, each beside its SQL.

They write what they need from the given tables to the shared folder and read it back.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmerge.operators import cells as C
from docmerge.operators import grouping as G
from docmerge.operators import merge as M
from docmerge.operators import report as R
from docmerge.operators import reshape as S
from docmerge.operators import state as ST
from docmerge.operators.identity import join_on
from docmerge.operators.ordering import scan_totals
from docmerge.operators.select import export_headers
from docmerge.oracles import FILES_SQL, ORACLES, PROMPT_CHARS_SQL
from docmerge.plans import extract as X
from docmerge.plans import model_merge as MM
from docmerge.plans.extract import facts_extractor
from docmerge.queries import HEADER_KEYS, first_file_model, moody_extractor, shared_folder, stubborn_extractor
from docmerge.schemas import PivotPreset, TemplateColumn
from docmerge.session import checkpointed
from docmerge.sinks.results import compact_days, current_results, expire_days, write_daily, write_results
from docmerge.sinks.files import write_files
from docmerge.sinks.text import write_csv_safe, write_json
from docmerge.sinks.xlsx import write_xlsx
from docmerge.sources import files as SF
from docmerge.sources import tables as T
from docmerge.sources.files import read_documents as read_uploads
from docmerge.sources.sessions import read_sessions, write_sessions
from docmerge.sources.stored import read_event_log as read_log
from docmerge.sources.stored import read_group_results
from docmerge.sources.stored import read_results as stored_results
from docmerge.streaming import flows
from docmerge.streaming.expiry import stream_expiry
from docmerge.streaming.retries import settle, with_state_store

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a query with its SQL."""

    def add(f):
        _QUERIES[f.__name__] = f
        _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


# --- sessions: one file id in two of them ------------------------------------------


def _two_sessions(spark, sf):
    """The documents in session "a", and longer texts under the same ids without a session."""
    files = T.document_files(spark, sf)
    longer = files.withColumn("session_id", F.lit(None).cast("string")).withColumn("text", F.concat("text", F.lit(" and more")))
    return files.withColumn("session_id", F.lit("a")).unionByName(longer)


_TWO_SQL = f"""{FILES_SQL}, two AS (SELECT 'a' AS session_id, file_id, file_seq, group_id, text FROM files
    UNION ALL SELECT NULL, file_id, file_seq, group_id, text || ' and more' FROM files)"""


@query(f"""WITH {_TWO_SQL}, p AS (SELECT *, {PROMPT_CHARS_SQL} AS n FROM two)
    SELECT session_id, file_id, group_id, true AS success, CAST(length(text) AS VARCHAR) AS chars, CASE WHEN n % 3 = 0 THEN 1 ELSE 2 END AS attempt FROM p""")
def extract_two_sessions(spark, sf):
    """Each result belongs to its own session, also after a retry."""
    out = X.extract_documents(_two_sessions(spark, sf), moody_extractor)
    return out.select("session_id", "file_id", "group_id", "success", F.get_json_object("data_json", "$.chars").alias("chars"), "attempt")


@query(f"""WITH {_TWO_SQL}, d AS (SELECT doc_id FROM labels WHERE quality = 1)
    SELECT session_id, file_id FROM two WHERE session_id IS NULL OR file_seq NOT IN (SELECT doc_id FROM d)""")
def pending_two_sessions(spark, sf):
    """What session "a" has done stays to be done elsewhere."""
    done = T.table(spark, sf, "labels").select(F.lit("a").alias("session_id"), F.col("doc_id").cast("string").alias("file_id"), (F.col("quality") == 1).alias("success"))
    return ST.pending_files(_two_sessions(spark, sf), done).select("session_id", "file_id")


def _versions(spark, sf):
    """Results of two sessions, written in two runs; the second run only has even documents of the session without a name."""
    rows = _two_sessions(spark, sf).select("session_id", "file_id", "file_name", "file_seq", F.lit(True).alias("success"), F.length("text").cast("bigint").alias("chars"))
    path = f"{shared_folder(spark)}/results"
    write_results(rows, path, result_seq=1)
    again = rows.where("session_id IS NULL AND file_seq % 2 = 0").withColumn("chars", -F.col("chars"))
    write_results(again, path, result_seq=2)
    return path


_CURRENT_SQL = f"""{_TWO_SQL}, cur AS (SELECT session_id, file_id, file_seq, CASE WHEN session_id IS NULL AND file_seq % 2 = 0 THEN -length(text) ELSE length(text) END AS chars FROM two)"""


@query(f"WITH {_CURRENT_SQL} SELECT session_id, file_id, chars FROM cur")
def current_two_sessions(spark, sf):
    return current_results(spark, _versions(spark, sf)).select("session_id", "file_id", "chars")


@query(f"""WITH {_TWO_SQL} SELECT session_id, file_id, CASE WHEN session_id = 'a' THEN 'old-a' ELSE group_id END AS group_id FROM two""")
def inherit_two_sessions(spark, sf):
    files = G.with_group(_two_sessions(spark, sf))
    earlier = files.where("session_id = 'a'").select("session_id", "file_id", F.lit("old-a").alias("group_id"), F.lit(1).alias("result_seq"), F.lit(True).alias("success"))
    return ST.inherit_group(files, earlier).select("session_id", "file_id", "group_id")


@query(f"""WITH {_TWO_SQL} SELECT session_id, file_id, CASE WHEN session_id IS NULL AND file_seq % 3 = 0 THEN 7 ELSE 1 END AS attempt,
    CASE WHEN session_id IS NULL AND file_seq % 3 = 1 THEN 'no answer' END AS error FROM two""")
def overlay_two_sessions(spark, sf):
    """Two retries of a file: one that fails and, for every third document, one that succeeds."""
    rows = _two_sessions(spark, sf).select("session_id", "file_id", "file_seq", F.lit("g").alias("group_id"), F.lit(1).alias("attempt"), F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"))
    again = rows.where("session_id IS NULL AND file_seq % 3 < 2")
    good = again.where("file_seq % 3 = 0").withColumn("attempt", F.lit(7))
    bad = again.withColumns({"attempt": F.lit(8), "success": F.lit(False), "error": F.lit("no answer")})
    return ST.overlay_retry(rows, bad.unionByName(good).unionByName(bad)).select("session_id", "file_id", "attempt", "error")


@query("""WITH v AS (SELECT o_custkey, o_orderkey, o_orderkey % 3 AS attempt, o_orderpriority FROM orders)
    SELECT CAST(o_custkey AS VARCHAR) AS file_id, max(attempt) AS attempt, count(*) FILTER (attempt = m) AS n
    FROM (SELECT *, max(attempt) OVER (PARTITION BY o_custkey) AS m FROM v) GROUP BY o_custkey""")
def latest_ties(spark, sf):
    """Versions of one time: the later attempt wins, and the same row whatever the partitioning is."""
    k = F.col("o_orderkey")
    versions = T.table(spark, sf, "orders").select(
        F.lit(None).cast("string").alias("session_id"), F.col("o_custkey").cast("string").alias("file_id"), k.alias("row"), (k % 3).alias("attempt"), F.lit(5).alias("result_seq"), F.lit(True).alias("success"),
    )
    one, two = ST.latest_results(versions), ST.latest_results(versions.repartition(13, "row"))
    same = one.join(two.select("file_id", F.col("row").alias("other")), "file_id").where("row = other")
    newest = versions.join(one.select("file_id", F.col("attempt").alias("newest")), "file_id").where("attempt = newest")
    return same.join(newest.groupBy("file_id").agg(F.count("*").alias("n")), "file_id").select("file_id", "attempt", "n")


# --- expiry by days ------------------------------------------------------------------

#: Sessions begin on four days, the orders of a customer are one session; the age limit falls on noon of the second day.
_BEGUN_SQL = """b AS (SELECT o_orderkey, o_custkey, o_custkey % 4 AS d, CASE WHEN o_custkey % 8 < 4 THEN 9 ELSE 15 END AS h FROM orders)"""


@query(f"""WITH {_BEGUN_SQL}, v AS (SELECT *, 1 AS result_seq FROM b UNION ALL SELECT *, 2 FROM b WHERE o_orderkey % 2 = 0),
    k AS (SELECT * FROM v WHERE (d > 1 OR d = 1 AND h = 15) AND (d <> 2 OR result_seq = 2 OR o_orderkey % 2 <> 0))
    SELECT CAST(d AS BIGINT) AS d, count(*) AS n_rows, CAST(sum(result_seq) AS BIGINT) AS seqs, d = 3 AS same_files, d = 1 AS in_changed FROM k GROUP BY d""")
def expire_and_compact(spark, sf):
    """Four days of results: one is deleted, one cut, one compacted, and the files of the last keep their names."""
    c = F.col("o_custkey")
    begun = F.make_timestamp(F.lit(2024), F.lit(5), (c % 4 + 1).cast("int"), F.when(c % 8 < 4, 9).otherwise(15), F.lit(0), F.lit(0))
    rows = T.table(spark, sf, "orders").select(
        c.cast("string").alias("session_id"), F.col("o_orderkey").cast("string").alias("file_id"), begun.alias("created_at"), (c % 4).alias("d"), (F.col("o_orderkey") % 2).alias("odd"), F.lit(True).alias("success")
    )
    path = f"{shared_folder(spark)}/daily"
    write_daily(rows, path, result_seq=1)
    write_daily(rows.where("odd = 0"), path, result_seq=2)
    names = lambda: spark.read.parquet(path).select("d", F.col("_metadata.file_name").alias("name")).distinct()
    before = checkpointed(names())
    changed = expire_days(spark, path, datetime(2024, 5, 9, 12), "7 days")
    compact_days(spark, path, [date(2024, 5, 3), date(2024, 5, 30)])
    kept = before.join(names(), ["d", "name"]).groupBy("d").agg(F.count("*").alias("kept"))
    same = before.groupBy("d").agg(F.count("*").alias("n")).join(kept, "d", "left").select("d", (F.coalesce("kept", F.lit(0)) == F.col("n")).alias("same_files"))
    after = spark.read.parquet(path).groupBy("d").agg(F.count("*").alias("n_rows"), F.sum("result_seq").alias("seqs"))
    return after.join(same, "d").withColumn("in_changed", F.col("d").isin([day.day - 1 for day in changed]))


# --- positions -----------------------------------------------------------------------


@query("""SELECT event_id, CAST(floor((row_number() OVER (ORDER BY ts, event_id) - 1) / (SELECT CASE WHEN count(*) <= 100 THEN 5 WHEN count(*) <= 200 THEN 8 ELSE 10 END FROM events)) AS BIGINT) AS batch_no
    FROM events""")
def event_batches(spark, sf):
    """Events as the files of one session, in the order of their time in microseconds."""
    files = T.table(spark, sf, "events").select(
        F.lit("s").alias("session_id"), F.col("event_id").cast("string").alias("file_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("file_seq"), "event_id",
    )
    return G.batch_numbers(files).select("event_id", "batch_no")


@query("""SELECT event_id, coalesce(sum(length(props)) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM events""")
def event_scan(spark, sf):
    """Characters logged before each event of its kind."""
    rows = T.table(spark, sf, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.length("props").alias("n"))
    return scan_totals(rows, ["event_type"], ["at"], weight=F.col("n"), out="before").select("event_id", "before")


@query("""WITH r AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_custkey % 3 <> 0 THEN 'g' || o_custkey % 3 ELSE 'group-unknown' END AS g FROM orders),
    n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY g) AS c FROM r)
    SELECT o_orderkey, CASE WHEN c > 1 THEN g || '-' || i ELSE g END AS row_id, CASE WHEN c > 1 THEN g || ' #' || (i + 1) ELSE g END AS label FROM n""")
def number_rows_ungrouped(spark, sf):
    """Rows without a group are numbered as the group of unknown files."""
    c = F.col("o_custkey")
    group = F.when(c % 3 != 0, F.concat(F.lit("g"), (c % 3).cast("string")))
    rows = T.table(spark, sf, "orders").select("o_orderkey", group.alias("group_id"), group.alias("group_key"), F.col("o_orderkey").alias("file_seq"), F.lit(0).cast("bigint").alias("entry_idx"))
    return M.number_rows(rows).select("o_orderkey", "row_id", "label")


@query("""WITH r AS (SELECT CASE WHEN o_custkey % 3 <> 0 THEN 'g' || o_custkey % 3 ELSE 'group-unknown' END AS group_id, o_orderkey AS s, o_orderstatus AS status, o_orderpriority AS priority FROM orders),
    c AS (SELECT group_id, 'status' AS key, status AS value, s FROM r UNION ALL SELECT group_id, 'priority', priority, s FROM r),
    v AS (SELECT group_id, key, value, min(s) AS seen_file_seq FROM c GROUP BY ALL)
    SELECT * FROM v QUALIFY count(*) OVER (PARTITION BY group_id, key) > 1""")
def conflicts_ungrouped(spark, sf):
    """Values of files without a group conflict like those of any group."""
    c = F.col("o_custkey")
    results = T.table(spark, sf, "orders").select(
        F.when(c % 3 != 0, F.concat(F.lit("g"), (c % 3).cast("string"))).alias("group_id"), F.col("o_orderkey").cast("string").alias("file_id"), F.lit("f").alias("file_name"),
        F.col("o_orderkey").alias("file_seq"), F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))).alias("header_json"),
    )
    return M.detect_conflicts(C.mergeable(C.to_cells(results, origins=("header",)))).select("group_id", "key", "value", "seen_file_seq")


# --- streams ---------------------------------------------------------------------------


def _arriving(spark, sf):
    """The documents as files that arrive in two batches, half of them without a session."""
    files = T.document_files(spark, sf).withColumn("session_id", F.when(F.col("file_seq") % 2 == 0, "a"))
    folder = f"{shared_folder(spark)}"
    files.repartition(2, "file_seq").write.parquet(f"{folder}/files")
    return folder, spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/files")


def slow_learner(prompts):
    """Stand-in for a model that needs three attempts for some documents: unreadable, then too short, then size facts."""
    answers = []
    for p, facts in zip(prompts, facts_extractor(prompts)):
        if len(p.user) % 3 != 1 or "too_few_fields" in (p.feedback or ""):
            answers.append(facts)
        else:
            answers.append('{"chars": 1}' if p.feedback else "nothing")
    return answers


@query(f"""WITH {FILES_SQL}, p AS (SELECT *, {PROMPT_CHARS_SQL} AS n FROM files)
    SELECT CASE WHEN file_seq % 2 = 0 THEN 'a' END AS session_id, file_id, group_id, true AS success, CAST(length(text) AS VARCHAR) AS chars, CASE WHEN n % 3 = 1 THEN 3 ELSE 1 END AS attempt FROM p""")
def stream_retried(spark, sf):
    """Files that arrive in two batches, asked again over further runs from the checkpoint until the third attempt succeeds."""
    folder, files = _arriving(spark, sf)
    settle(files, slow_learner, f"{folder}/results", f"{folder}/state")
    out = current_results(spark, f"{folder}/results")
    return out.select("session_id", "file_id", "group_id", "success", F.get_json_object("data_json", "$.chars").alias("chars"), "attempt")


@query(f"""WITH {FILES_SQL}, p AS (SELECT *, {PROMPT_CHARS_SQL} AS n FROM files)
    SELECT CASE WHEN file_seq % 2 = 0 THEN 'a' END AS session_id, file_id, n % 3 <> 0 AS success, CASE WHEN n % 3 <> 0 THEN CAST(length(text) AS VARCHAR) END AS chars, 3 AS attempt, n % 3 = 0 AS failed FROM p""")
def stream_fallback(spark, sf):
    """A form that is never filled: after two attempts one without it, or a failed result, as in the batch form."""
    folder, files = _arriving(spark, sf)
    template = [TemplateColumn("title"), TemplateColumn("item", repeating=True)]
    settle(files, stubborn_extractor, f"{folder}/results", f"{folder}/state", template, max_attempts=2)
    out = current_results(spark, f"{folder}/results")
    return out.select("session_id", "file_id", "success", F.get_json_object("data_json", "$.chars").alias("chars"), "attempt", F.col("error").isNotNull().alias("failed"))


_ENDS_SQL = """WITH s AS (SELECT o_custkey, CASE WHEN o_custkey % 50 <> 0 THEN min(o_orderdate) END AS created_at FROM orders GROUP BY o_custkey)"""


@query(f"""{_ENDS_SQL} SELECT CAST(o_custkey AS VARCHAR) AS session_id, created_at,
    CASE WHEN created_at < TIMESTAMP '1995-06-02 00:00:00' - INTERVAL 180 DAY THEN 'expired' ELSE 'live' END AS state FROM s""")
def stream_session_expiry(spark, sf):
    """Sessions of customers, seen again when the watermark stands at a fixed time: the expired ones end, the others go on."""
    now = F.expr("TIMESTAMP '1995-06-02 00:00:00'")
    sessions = T.table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("timestamp").alias("began"))
    sessions = sessions.select(F.col("o_custkey").cast("string").alias("session_id"), F.when(F.col("o_custkey") % 50 != 0, F.col("began")).alias("created_at"))
    folder = shared_folder(spark)
    clock = spark.range(1).select(F.lit("clock").alias("session_id"), now.alias("created_at"))
    for step, (rows, at) in enumerate(((sessions, F.expr("TIMESTAMP '1990-01-01 00:00:00'")), (clock, now), (sessions, now))):
        rows.select("*", at.alias("ts"), F.lit(step).alias("step")).coalesce(1).write.mode("append").parquet(f"{folder}/rows")
    rows = spark.readStream.schema("session_id string, created_at timestamp, ts timestamp, step int").option("maxFilesPerTrigger", 1).parquet(f"{folder}/rows")
    with with_state_store(spark):
        running = stream_expiry(rows, 180 * 86_400).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    out = spark.read.parquet(f"{folder}/out").where("session_id <> 'clock' AND (expired OR step = 2)")
    return out.select("session_id", "created_at", F.when(F.col("expired"), "expired").otherwise("live").alias("state"))


def _frames(rows: DataFrame, kind) -> DataFrame:
    """Event-stream text of events: one frame a row."""
    data = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.col("user_id").alias("user")))
    return rows.select(F.concat(F.lit("event: "), kind, F.lit("\ndata: "), data).alias("value"))


def _write_frames(frames: DataFrame, path: str) -> None:
    frames.coalesce(1).write.mode("append").option("lineSep", "\n\n").text(path)


@query("SELECT date_trunc('minute', ts)::TIMESTAMP AS minute, event_type AS event, count(*) AS count FROM events GROUP BY ALL")
def stream_progress_windows(spark, sf):
    """Events per minute of frames that arrive as files: windows are final when the watermark has passed them, late frames are dropped."""
    events, path = T.table(spark, sf, "events"), shared_folder(spark)
    middle = F.expr("TIMESTAMP '2024-01-15 12:00:30'")
    kind, fixed = F.col("event_type"), lambda at: spark.range(1).select(F.lit(0).alias("user_id"), F.expr(f"TIMESTAMP '{at}'").alias("ts"))
    _write_frames(_frames(events.where(F.col("ts") < middle), kind), f"{path}/log")
    _write_frames(_frames(events.where(F.col("ts") >= middle), kind), f"{path}/log")
    _write_frames(_frames(events.where(F.col("ts") < middle - F.expr("INTERVAL 1 DAY")), F.lit("late")), f"{path}/log")
    for at in ("2099-01-01 00:00:00", "2099-02-01 00:00:00"):
        _write_frames(_frames(fixed(at), F.lit("end")), f"{path}/log")
    counts = flows.stream_progress(flows.stream_event_log(spark, f"{path}/log", max_files=1), window="1 minute")
    counts.select(F.col("window.start").alias("minute"), "event", "count").writeStream.format("parquet").option("path", f"{path}/out").option(
        "checkpointLocation", f"{path}/state"
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").where("event <> 'end'")


@query("SELECT event_type AS event, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE event_id % 7 <> 0 GROUP BY event_type")
def read_event_log(spark, sf):
    """Frames read back in batch: those without data, or with broken data, are left out."""
    events, path = T.table(spark, sf, "events"), f"{shared_folder(spark)}/log"
    data = F.when(F.col("event_id") % 14 == 0, "{broken").when(F.col("event_id") % 7 != 0, F.to_json(F.struct("user_id")))
    frame = F.concat(F.lit("event: "), F.col("event_type"), F.coalesce(F.concat(F.lit("\ndata: "), data), F.lit("")))
    events.select(frame.alias("value")).write.option("lineSep", "\n\n").text(path)
    log = read_log(spark, path)
    return log.groupBy("event").agg(F.count("*").alias("n"), F.count_distinct(F.get_json_object("data", "$.user_id")).alias("users"))


# --- reports ---------------------------------------------------------------------------

_KIND_SQL = """CASE WHEN event_id % 11 = 0 THEN 'phase' WHEN event_id % 11 = 1 THEN 'group_merged' WHEN event_id % 11 = 2 THEN 'error' WHEN event_id % 11 = 3 THEN 'all_done'
    WHEN event_id % 11 < 6 THEN 'file_retry' ELSE 'file_complete' END"""


@query(f"""WITH e AS (SELECT event_id, {_KIND_SQL} AS event, 'u' || user_id AS u, event_type AS t FROM events),
    f AS (SELECT *, CASE WHEN event = 'phase' THEN t END AS phase, CASE WHEN event LIKE 'file%' THEN u END AS file, CASE WHEN event = 'group_merged' THEN t || '-g' END AS grp FROM e),
    g AS (SELECT CASE grouping_id(phase, file, grp) WHEN 3 THEN 'phase' WHEN 5 THEN 'file' WHEN 6 THEN 'group' ELSE 'total' END AS part, coalesce(phase, file, grp) AS name, count(*) AS n_events,
      count(*) FILTER (event = 'file_complete' AND event_id % 4 <> 0) AS n_succeeded, count(*) FILTER (event = 'file_complete' AND event_id % 4 = 0) AS n_failed,
      count(*) FILTER (event = 'file_retry') AS n_retries, count(*) FILTER (event = 'group_merged') AS n_merged, count(*) FILTER (event = 'error') AS n_errors,
      count(*) FILTER (event = 'file_complete') * 2 AS n_fields, CAST(coalesce(sum(event_id % 3) FILTER (event = 'group_merged'), 0) AS BIGINT) AS n_conflicts,
      max(event_id) FILTER (event = 'all_done') AS total_files
      FROM f GROUP BY GROUPING SETS ((phase), (file), (grp), ()))
    SELECT * FROM g WHERE part = 'total' OR name IS NOT NULL""")
def run_summary(spark, sf):
    """The whole report of a run: totals, phases, files and groups from one scan."""
    i = F.col("event_id")
    kind = F.when(i % 11 == 0, "phase").when(i % 11 == 1, "group_merged").when(i % 11 == 2, "error").when(i % 11 == 3, "all_done").when(i % 11 < 6, "file_retry").otherwise("file_complete")
    events = T.table(spark, sf, "events").withColumn("event", kind)
    e, conflicts = F.col("event"), F.expr("slice(array(1, 2), 1, cast(event_id % 3 as int))")
    data = F.to_json(F.struct(
        F.when(e == "phase", F.col("event_type")).alias("phase"), F.when(e.startswith("file"), F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("fileId"),
        F.when(e == "group_merged", F.concat("event_type", F.lit("-g"))).alias("groupKey"), F.when(e == "file_complete", i % 4 != 0).alias("success"),
        F.when(e == "file_complete", F.struct(i.alias("a"), F.lit("x").alias("b"))).alias("data"), conflicts.alias("conflicts"), F.when(e == "all_done", i).alias("totalFiles"),
    ))
    return R.run_summary(events.select("event", data.alias("data")))


# --- stored files ------------------------------------------------------------------------


@query("""WITH m AS (SELECT o_custkey, o_orderstatus AS s, count(*) AS n, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY ALL),
    c AS (SELECT o_custkey, CASE WHEN o_custkey % 3 <> 0 THEN min(o_orderdate) END AS created_at FROM orders GROUP BY o_custkey)
    SELECT 'cust' || o_custkey AS session_id, created_at, CASE WHEN o_custkey % 5 <> 0 THEN s END AS group_id, CASE WHEN o_custkey % 5 <> 0 THEN n END AS file_count, CASE WHEN o_custkey % 5 <> 0 THEN ids END AS ids
    FROM c JOIN m USING (o_custkey) QUALIFY o_custkey % 5 <> 0 OR row_number() OVER (PARTITION BY o_custkey ORDER BY s) = 1""")
def stored_sessions(spark, sf):
    """Session folders with their meta file and manifest, written and read back as they lie; some lack one, some have a broken one."""
    orders = T.table(spark, sf, "orders")
    c = F.col("o_custkey")
    groups = orders.groupBy(c, F.col("o_orderstatus").alias("groupId")).agg(F.count("*").alias("fileCount"), F.array_sort(F.collect_list("o_orderkey")).alias("fileIds"))
    listed = groups.groupBy(c).agg(F.to_json(F.collect_list(F.struct("groupId", F.col("groupId").alias("groupKey"), "fileCount", "fileIds"))).alias("groups_json"))
    meta = orders.groupBy(c).agg(F.to_json(F.struct(F.unix_millis(F.min(F.col("o_orderdate").cast("timestamp"))).alias("createdAt"), F.count("*").alias("fileCount"))).alias("meta_json"))
    sessions = listed.join(meta, "o_custkey").select(
        F.concat(F.lit("cust"), c.cast("string")).alias("session_id"), F.when(c % 3 != 0, F.col("meta_json")).when(c % 2 == 0, "{broken").alias("meta_json"), F.when(c % 5 != 0, F.col("groups_json")).otherwise("[]").alias("groups_json"),
    )
    path = f"{shared_folder(spark)}/sessions"
    write_sessions(sessions, path, shared=True)
    return read_sessions(spark, path, shared=True).select("session_id", "created_at", "group_id", "file_count", F.array_join("file_ids", ",").alias("ids"))


def _uploads(spark, sf):
    """The documents as uploaded files of several kinds."""
    d = F.col("doc_id")
    ext = F.element_at(F.array(*[F.lit(e) for e in ("txt", "md", "jpg", "png", "pdf", "TXT", "gif")]), (d % 7).cast("int") + 1)
    path = f"{shared_folder(spark)}/uploads"
    files = T.table(spark, sf, "documents").select(F.concat((d % 3).cast("string"), F.lit("/doc "), d.cast("string"), F.lit("."), ext).alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    write_files(files, path, shared=True)
    return path


_UPLOADS_SQL = """u AS (SELECT doc_id, 'doc ' || doc_id || '.' || (['txt', 'md', 'jpg', 'png', 'pdf', 'TXT', 'gif'])[doc_id % 7 + 1] AS file_name, coalesce(text, '') AS text, doc_id % 7 AS m,
    octet_length(encode(coalesce(text, ''))) AS size FROM documents)"""


@query(f"""WITH {_UPLOADS_SQL} SELECT file_name, CAST(size AS BIGINT) AS size, CASE WHEN m IN (0, 5) THEN 'text/plain' WHEN m = 1 THEN 'text/markdown' WHEN m = 2 THEN 'image/jpeg' WHEN m = 3 THEN 'image/png' WHEN m = 6 THEN 'image/gif' END AS mime,
    CASE WHEN m IN (0, 1, 5) THEN md5(text) END AS text_md5, CASE WHEN m IN (2, 3, 6) THEN CASE WHEN size = 0 THEN '[empty image file]' ELSE '[image file]' END END AS image_text,
    CASE WHEN m IN (2, 3, 6) AND size > 0 THEN CAST(4 * ceil(size / 3.0) AS BIGINT) END AS encoded, CASE WHEN m = 4 THEN 'unsupported type' END AS reject_reason FROM u""")
def read_documents(spark, sf):
    """Uploaded files read back: accepted texts and images, and the refused ones."""
    accepted, rejected = read_uploads(spark, _uploads(spark, sf))
    texts = SF.text_documents(accepted).select("file_name", "size", "mime", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    images = SF.image_documents(accepted).select("file_name", "size", "mime", F.col("text").alias("image_text"), F.length(F.substring_index("data_url", ",", -1)).cast("bigint").alias("encoded"))
    parts = texts.unionByName(images, allowMissingColumns=True).unionByName(rejected.select("file_name", "size", "reject_reason"), allowMissingColumns=True)
    return parts.select("file_name", "size", "mime", "text_md5", "image_text", "encoded", "reject_reason")


@query(f"WITH {_UPLOADS_SQL} SELECT file_name, CASE WHEN m = 4 THEN 'refused' ELSE 'taken' END AS state, CAST(size AS BIGINT) AS size FROM u")
def stream_documents(spark, sf):
    """The same files as a stream: taken and refused."""
    path, out = _uploads(spark, sf), shared_folder(spark)
    taken = flows.stream_documents(spark, path, max_files=1000).select("file_name", F.lit("taken").alias("state"), "size")
    refused = flows.stream_rejects(spark, path).select("file_name", F.lit("refused").alias("state"), "size")
    with flows.with_few_listers(spark):  # both run side by side: much of a batch is waiting for the driver
        running = [
            rows.writeStream.format("parquet").option("path", f"{out}/{name}").option("checkpointLocation", f"{out}/state-{name}").trigger(availableNow=True).start()
            for name, rows in (("taken", taken), ("refused", refused))
        ]
        for stream in running:
            stream.awaitTermination()
    return spark.read.parquet(f"{out}/taken").unionByName(spark.read.parquet(f"{out}/refused"))


@query("""SELECT 'c' || o_custkey % 10 AS session_id, CAST(o_orderkey AS VARCHAR) AS file_id, o_orderkey % 3 <> 0 AS success, o_orderstatus AS status, CASE WHEN o_orderkey % 3 <> 0 THEN 2 ELSE 0 END AS n_entries,
    o_custkey % 4 = 0 AS chosen FROM orders WHERE o_orderkey % 13 <> 0""")
def read_results(spark, sf):
    """Result files of sessions read back: hidden and broken ones are skipped; the results of listed files are marked."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    entries = F.when(k % 3 != 0, F.array(F.struct(F.lit(1).alias("n")), F.struct(F.lit(2).alias("n"))))
    body = F.to_json(F.struct(k.cast("string").alias("fileId"), F.lit("f.txt").alias("fileName"), F.lit("g").alias("groupId"), (k % 3 != 0).alias("success"), F.struct(F.col("o_orderstatus").alias("status")).alias("data"), entries.alias("entries")))
    session = F.concat(F.lit("c"), (c % 10).cast("string"))
    name = F.concat(session, F.when(k % 26 == 0, "/_").otherwise("/"), k.cast("string"), F.lit(".json"))
    orders = T.table(spark, sf, "orders")
    path = f"{shared_folder(spark)}/results"
    write_files(orders.select(name.alias("name"), F.when((k % 13 == 0) & (k % 26 != 0), F.lit("{broken")).otherwise(body).cast("binary").alias("content")), path, shared=True)
    results = checkpointed(stored_results(spark, f"{path}/*"))
    chosen = read_group_results(results, orders.where("o_custkey % 4 = 0").select(session.alias("session_id"), k.cast("string").alias("file_id")))
    marked = join_on(results, chosen.select("session_id", "file_id", F.lit(True).alias("chosen")), ["session_id", "file_id"], "left")
    return marked.select("session_id", "file_id", "success", F.get_json_object("data_json", "$.status").alias("status"), F.greatest(F.coalesce(F.size("entries_json"), F.lit(0)), F.lit(0)).alias("n_entries"), F.coalesce("chosen", F.lit(False)).alias("chosen"))


# --- exports ----------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority END AS priority, CAST(o_custkey AS VARCHAR) AS inner_value FROM orders")
def json_export(spark, sf):
    """JSON lines written and read back: nested values and nulls are kept."""
    orders = T.table(spark, sf, "orders")
    rows = orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")).alias("priority"), F.struct(F.col("o_custkey").alias("value")).alias("inner"))
    path = f"{shared_folder(spark)}/json"
    write_json(rows, path)
    kept = spark.read.text(path).where(F.col("value").contains('"priority":'))
    read = lambda key: F.get_json_object("value", f"$.{key}")
    return kept.select(read("o_orderkey").cast("bigint").alias("o_orderkey"), read("status").alias("status"), read("priority").alias("priority"), read("inner.value").alias("inner_value"))


@query(r"""SELECT doc_id, chr(39) || '=' || doc_id || ',' || coalesce(source, '') || ',' || repeat('"', 3) || 'q' || repeat('"', 2) || ',' || doc_id || '"' AS line FROM documents""")
def csv_export(spark, sf):
    """CSV files read back line by line: every file has a mark, a header and lines that end with CRLF."""
    docs = T.table(spark, sf, "documents")
    path = f"{shared_folder(spark)}/csv"
    write_csv_safe(docs.select(F.concat(F.lit("="), F.col("doc_id").cast("string")).alias("id"), "source", F.concat(F.lit('"q",'), F.col("doc_id").cast("string")).alias("q")), path)
    lines = spark.read.option("lineSep", "\r\n").text(path)
    return lines.where(~F.col("value").endswith("id,source,q")).select(F.regexp_extract("value", r'(\d+)"$', 1).cast("bigint").alias("doc_id"), F.col("value").alias("line"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name FROM part")
def xlsx_export(spark, sf):
    """Workbooks written and opened again."""
    path = f"{shared_folder(spark)}/xlsx"
    rows = T.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    write_xlsx(rows, path, shared=True)

    def cells(batches):
        import io
        import re
        import zipfile
        from html import unescape

        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                sheet = zipfile.ZipFile(io.BytesIO(content)).read("xl/worksheets/sheet1.xml").decode()
                found = [tuple(unescape(t) for t in re.findall(r"<t[^>]*>([^<]*)</t>", row)) for row in re.findall(r"<row>(.*?)</row>", sheet, re.S)]
                yield pd.DataFrame(found[1:], columns=["id", "name"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("content").mapInPandas(cells, "id string, name string")


# --- keys, templates, pivots --------------------------------------------------------------


@query("""WITH k AS (SELECT 'customer' AS key, count(*) AS n FROM orders UNION ALL SELECT 'status', count(*) FILTER (o_custkey % 2 = 0) FROM orders UNION ALL SELECT 'note', count(*) FILTER (o_custkey % 3 = 0) FROM orders
    UNION ALL SELECT 'alpha', count(*) FROM orders)
    SELECT key, n AS count, CAST(row_number() OVER (ORDER BY n DESC, key) AS BIGINT) AS place, CAST(list_position(['status', 'customer', 'alpha', 'note'], key) AS BIGINT) AS column_no FROM k WHERE n > 0""")
def keys_by_count(spark, sf):
    """Keys with the most frequent first, and their columns in an export that orders two of them."""
    c = F.col("o_custkey")
    doc = F.to_json(F.struct(F.lit("x").alias("customer"), F.when(c % 2 == 0, F.lit("s")).alias("status"), F.lit("a").alias("alpha"), F.when(c % 3 == 0, F.lit("n")).alias("note")))
    results = T.table(spark, sf, "orders").select(F.lit("g").alias("group_id"), F.col("o_orderkey").cast("string").alias("file_id"), F.lit("f").alias("file_name"), F.col("o_orderkey").alias("file_seq"), doc.alias("data_json"))
    ranked = checkpointed(C.keys_by_count(C.to_keys(results, origins=("data",))))
    names = [r["key"] for r in ranked.collect()]  # a handful of keys
    columns = export_headers(sorted(names), ["status", "customer"])
    place = lambda listed: F.element_at(F.create_map(*[F.lit(x) for pair in ((n, i + 1) for i, n in enumerate(listed)) for x in pair]), F.col("key")).cast("bigint")
    return ranked.select("key", "count", place(names).alias("place"), place(columns).alias("column_no"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS file_id, CASE WHEN o_custkey % 2 = 0 THEN 'status' ELSE 'lab-status' END AS key, o_orderstatus AS value FROM orders
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), CASE WHEN o_custkey % 2 = 0 THEN 'date-time' ELSE 'x' END, o_orderpriority FROM orders""")
def common_prefixes(spark, sf):
    """A prefix that all keys of an object share is cut off; one that not all share stays."""
    c, status, priority = F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    shared = F.to_json(F.struct(status.alias("lab-status"), priority.alias("lab-date-time")))
    mixed = F.to_json(F.struct(status.alias("lab-status"), priority.alias("x")))
    results = T.table(spark, sf, "orders").select(F.lit("g").alias("group_id"), F.col("o_orderkey").cast("string").alias("file_id"), F.lit("f").alias("file_name"), F.col("o_orderkey").alias("file_seq"), F.when(c % 2 == 0, shared).otherwise(mixed).alias("data_json"))
    return C.to_cells(results, origins=("data",), strip_prefix=True).select("file_id", F.col("raw_key").alias("key"), "value")


@query("""WITH r AS (SELECT o_custkey, o_orderstatus AS kind, o_orderpriority AS level, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
    f AS (SELECT o_custkey, kind, arg_min(level, i) AS level, arg_min(o_orderkey, i) AS no FROM r GROUP BY ALL),
    m AS (SELECT o_custkey, min(o_orderkey) AS least FROM orders GROUP BY o_custkey)
    SELECT 'g' || o_custkey AS group_id, max(level) FILTER (kind = 'F') AS "F_level", max(level) FILTER (kind = 'O') AS "O_level", max(level) FILTER (kind = 'P') AS "P_level",
      CAST(max(no) FILTER (kind = 'F') AS VARCHAR) AS "F_no", CAST(max(no) FILTER (kind = 'O') AS VARCHAR) AS "O_no", CAST(max(no) FILTER (kind = 'P') AS VARCHAR) AS "P_no", 'e' || min(least) AS extra
    FROM f JOIN m USING (o_custkey) GROUP BY o_custkey""")
def pivot_auto_values(spark, sf):
    """A preset without value columns takes all other repeating ones; keys outside of the template are extras."""
    k = F.col("o_orderkey")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = T.table(spark, sf, "orders").select(
        F.concat(F.lit("g"), F.col("o_custkey").cast("string")).alias("group_id"), F.col("o_custkey").alias("group_seq"), place.cast("bigint").alias("entry_idx"), F.lit("l").alias("label"),
        F.create_map(F.lit("kind"), F.col("o_orderstatus"), F.lit("level"), F.col("o_orderpriority"), F.lit("no"), k.cast("string"), F.lit("other"), F.concat(F.lit("e"), k.cast("string"))).alias("data"),
    )
    template = [TemplateColumn(n, repeating=True) for n in ("kind", "level", "no")]
    names = [f"{kind}_{value}" for kind in "FOP" for value in ("level", "no")]
    wide = S.pivot_long_to_wide(checkpointed(rows), template, [PivotPreset("kind")], names=names, extras=True)
    return wide.select("group_id", *names, F.try_element_at(F.col("extras"), F.lit("other")).alias("extra"))


# --- prompts bounded by bytes ---------------------------------------------------------------


def _flat_orders(spark, sf):
    return T.order_results(spark, sf).withColumn("data_json", F.col("header_json"))


@query(ORACLES["merge_groups_in_parts"])
def merge_groups_in_bytes(spark, sf):
    """The same records from prompts of 600 bytes of files, in as many rounds as the groups need."""
    merged = MM.merge_groups_with_model(_flat_orders(spark, sf), first_file_model, max_bytes=600)
    return merged.select("group_id", "entry_idx", *[F.try_element_at(F.col("data"), F.lit(k)).alias(k) for k in HEADER_KEYS], "merge_method")


@query("""WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS g, turn, octet_length(encode('{"file_name":' || CAST(to_json(role) AS VARCHAR) || ',"extracted_data":' || CAST(json_object('text', text) AS VARCHAR) || '}')) + 2 AS b FROM conversations)
    SELECT g AS group_id, count(*) AS n_files, CAST(sum(b) AS BIGINT) AS n_bytes, true AS fits FROM t GROUP BY g""")
def prompt_bytes(spark, sf):
    """Turns as files in prompts of 1500 bytes: every file is in one prompt, and no prompt of several files is above the bound."""
    turns = T.table(spark, sf, "conversations")
    results = turns.select(
        F.col("conv_id").cast("string").alias("group_id"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("file_id"), F.col("role").alias("file_name"), F.col("turn").alias("file_seq"),
        F.lit(True).alias("success"), F.to_json(F.struct("text")).alias("data_json"),
    )
    prompts = MM.merge_prompt(results, max_bytes=1500)
    listed = F.octet_length(F.regexp_extract("user_prompt", r"(?s)\[\n(.*)\n\]$", 1)) + 2
    parts = prompts.select("group_id", "n_files", listed.cast("bigint").alias("bytes"))
    return parts.groupBy("group_id").agg(F.sum("n_files").alias("n_files"), F.sum("bytes").alias("n_bytes"), F.min((F.col("n_files") == 1) | (F.col("bytes") <= 1500)).alias("fits"))


@query("SELECT 'headers' AS kind, count(*) > 0 AS present FROM orders UNION ALL SELECT 'entries', count(*) > 0 FROM orders UNION ALL SELECT 'failed', count(*) < 0 FROM orders")
def results_present(spark, sf):
    """Whether any successful result has a header, or entries or data: the choice between the forms of merging."""
    results = T.order_results(spark, sf)
    entries = results.withColumn("entries_json", F.array("header_json")).drop("header_json")
    found = (("headers", ST.has_header(results)), ("entries", ST.header_or_data_present(entries)), ("failed", ST.header_or_data_present(entries.withColumn("success", F.lit(False)))))
    return spark.createDataFrame(found, "kind string, present boolean")
