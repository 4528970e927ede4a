"""Extraction of arriving files with retries: what was refused waits in keyed state until it is asked again.

Two streams meet in the state of a file: the file itself, and the notices about its answers, which every batch writes beside
the checkpoint. A file that arrives is asked for; a refusal is answered with the next attempt and the reason, after the last one with an
attempt without the form (if there is one) or with a failed result; an accepted answer ends the file's state. The state holds a few
words on unsettled files; a refusal brings the prompt along, so that the state, which is rewritten at every step, has no texts. Only where timers ask again
without a notice are prompts kept in it. Judging stays in Spark's expressions, as in the batch form, because it happens between two batches.

A batch that is repeated after a failure finds its notices and asks nobody again; only a batch that broke off before its notices were
written asks once more.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from contextlib import AbstractContextManager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from docmerge.operators.grouping import with_group
from docmerge.operators.validate import clean_result_keys
from docmerge.plans.extract import judge, parsed
from docmerge.plans.prompts import extraction_prompts, system_prompt
from docmerge.plans.rounds import Model, ask, feedback_of
from docmerge.schemas import Template
from docmerge.session import stored, with_freed_shuffles, with_setting
from docmerge.sinks.results import write_results

_FILE = "session_id string, file_id string, group_id string, file_name string, file_seq bigint, system_prompt string, user_prompt string, data_url string"
_NOTICE = "session_id string, file_id string, attempt int, reason string, user_prompt string, data_url string"
_TASK = f"{_FILE}, attempt int, feedback string, plain boolean, failed boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> AbstractContextManager[None]:
    """The store that keyed state with timers needs; a query keeps the setting that it was started with."""
    return with_setting(spark, PROVIDER, ROCKSDB)


_NAMES = [c.split()[0] for c in _TASK.split(", ")]


class _Unsettled(StatefulProcessor):
    """One file: its prompt and how often it was asked. Rows come and go as pandas frames."""

    def __init__(self, max_attempts: int, guided: bool, plain_prompt: str, patience_ms: int | None):
        self.max_attempts, self.guided, self.plain_prompt, self.patience_ms = max_attempts, guided, plain_prompt, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", f"{_FILE}, attempt int")

    def _next(self, held: tuple, reason: str | None, timerValues) -> tuple:
        """The next attempt after ``held[-1]`` of them, or a failed result."""
        *file, asked = held
        failed = asked >= self.max_attempts + self.guided
        plain = self.guided and asked >= self.max_attempts
        if failed:
            self.file.clear()
        else:
            self.file.update((*(file if self.patience_ms else [*file[:6], None, None]), asked + 1))
            if self.patience_ms:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
            if plain:
                file[5] = self.plain_prompt
        return (*file, asked + (not failed), reason, plain, failed)

    def _forget_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def answered(self, rows: Iterable, timerValues) -> tuple | None:
        """The task that follows from a file's rows, if any does. State is read once: each call to it is a round trip."""
        arrived, notices = None, {}
        for row in rows:
            if row.kind == "file":
                arrived = row
            else:
                notices[int(row.attempt)] = (row.kind, row.reason, row.user_prompt, row.data_url)
        held = self.file.get()
        if held is None:
            return None if arrived is None else self._next((*(getattr(arrived, c) for c in _NAMES[:8]), 0), None, timerValues)
        if int(held[-1]) not in notices:
            return None
        kind, reason, *prompt = notices[int(held[-1])]
        prompt = [said if kept is None else kept for kept, said in zip(held[6:8], prompt)]
        held = (*held[:4], None if held[4] is None else int(held[4]), held[5], *prompt, int(held[-1]))
        if self.patience_ms:
            self._forget_timers()
        if kind == "accepted":
            self.file.clear()
            return None
        return self._next(held, reason, timerValues)

    def expired(self, timerValues) -> tuple | None:
        held = self.file.get()
        return None if held is None else self._next((*held[:-1], int(held[-1])), "no answer came", timerValues)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        plain = (row for batch in rows for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False))
        yield from self.frames(self.answered(plain, timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.frames(self.expired(timerValues))

    def frames(self, task: tuple | None) -> Iterator[pd.DataFrame]:
        if task is not None:
            yield pd.DataFrame([task], columns=_NAMES)

    def close(self) -> None:
        pass


class _UnsettledRows(_Unsettled):
    """The same on plain rows: a file has a row or two at a time, for which frames take most of the time."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self.rows(self.answered(rows, timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.rows(self.expired(timerValues))

    def rows(self, task: tuple | None) -> Iterator[Row]:
        if task is not None:
            yield Row(*_NAMES)(*task)


def _tasks(files: DataFrame, notices: DataFrame, template: Template | None, instructions: str, max_attempts: int, patience_ms: int | None) -> DataFrame:
    # What the model is told first is the same for all files: ``_told`` adds it to tasks, it is not carried along.
    prompts = extraction_prompts(with_group(files), template, instructions).withColumn("system_prompt", F.lit(None).cast("string"))
    for name, kind in (("session_id", "string"), ("data_url", "string"), ("file_seq", "bigint")):
        if name not in prompts.columns:
            prompts = prompts.withColumn(name, F.lit(None).cast(kind))
    names = [c.split()[0] for c in _FILE.split(", ")]
    arrived = prompts.select(*names, F.lit("file").alias("kind"), F.lit(None).cast("int").alias("attempt"), F.lit(None).cast("string").alias("reason"))
    said = notices.select(
        "session_id", "file_id", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in _FILE.split(", ")[2:6]], "user_prompt", "data_url",
        F.when(F.col("reason").isNull(), "accepted").otherwise("refused").alias("kind"), "attempt", "reason",
    )
    keyed = arrived.unionByName(said).withColumns({"in_session": F.col("session_id").isNotNull(), "in": F.coalesce("session_id", F.lit(""))})
    processor = _UnsettledRows(max_attempts, bool(template), None, patience_ms)
    return keyed.groupBy("in_session", "in", "file_id").transformWithState(processor, _TASK, "Append", "ProcessingTime" if patience_ms else "None")


def _told(tasks: DataFrame, template: Template | None, instructions: str) -> DataFrame:
    """Tasks with their system prompt; state of earlier versions has its own."""
    form = F.coalesce("system_prompt", F.lit(system_prompt(template, instructions)))
    return tasks.withColumn("system_prompt", F.when(F.col("plain"), system_prompt(None, instructions)).otherwise(form))


def _answers(tasks: DataFrame, model: Model, template: Template | None, last: int) -> DataFrame:
    """Asked and judged tasks as results; ``reason`` is null for what is accepted, ``error`` the last word on what failed. What was refused before
    attempt ``last`` comes with its prompt."""
    carry = ["session_id", "file_id", "group_id", "file_name", "file_seq", "attempt", "asked", "shown"]
    tasks = tasks.withColumns({"asked": F.when(F.col("attempt") < last, F.col("user_prompt")), "shown": F.when(F.col("attempt") < last, F.col("data_url"))})
    form = tasks.where("NOT plain").withColumn("feedback", F.when(F.col("feedback").isNotNull(), feedback_of(F.col("feedback"))))
    judged = judge(template)(ask(form, model, carry))
    judged = judged.select(*carry, "data_json", "header_json", "entries_json", F.col("reject_reason").alias("reason"))
    free = parsed(ask(tasks.where("plain").withColumn("last", F.col("feedback")).drop("feedback"), model, [*carry, "last"]))
    found = F.coalesce(F.size(F.json_object_keys("json")) > 0, F.lit(False))
    opened = free.select(
        *carry, F.when(found, clean_result_keys("json")).alias("data_json"), F.lit(None).cast("string").alias("header_json"),
        F.lit(None).cast("array<string>").alias("entries_json"), F.when(~found, F.col("last")).alias("reason"),
    )
    again = F.col("reason").isNotNull()
    found = judged.unionByName(opened).withColumns({"user_prompt": F.when(again, F.col("asked")), "data_url": F.when(again, F.col("shown"))})
    return found.drop("asked", "shown")


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    store, place = _folder(spark, path)
    return store.exists(place)


def _drop(spark: SparkSession, path: str) -> None:
    store, place = _folder(spark, path)
    store.delete(place, True)


def stream_extract_retried(
    files: DataFrame,
    model: Model,
    path: str,
    checkpoint: str,
    template: Template | None = None,
    instructions: str = "",
    max_attempts: int = 3,
    patience: int | None = None,
    trigger: dict[str, str | bool] | None = None,
    seen: list[int] | None = None,
) -> StreamingQuery:
    """Extract arriving files into the results table, asking again as ``extract_documents`` does, over as many batches as it takes.

    ``patience`` is how many seconds an answer may take until the file counts as refused (a timer; not for ``availableNow``).
    ``trigger`` is that of the query, by default every ten seconds; ``seen`` collects the number of tasks of each batch.
    """
    spark = files.sparkSession
    started, notices_path = time.time_ns() // 1000, f"{checkpoint}/notices"
    if not _exists(spark, notices_path):
        spark.createDataFrame([], _NOTICE).write.parquet(f"{notices_path}/batch-none")
    notices = spark.readStream.schema(_NOTICE).parquet(f"{notices_path}/*")
    tasks = _tasks(files, notices, template, instructions, max_attempts, patience * 1000 if patience else None)

    def store(batch: DataFrame, batch_id: int) -> None:
        told = f"{notices_path}/batch-{batch_id}"
        if _exists(spark, f"{told}/_SUCCESS"):
            return
        asked = f"{checkpoint}/asked/batch-{batch_id}"  # kept while the batch runs
        batch = stored(batch, f"{asked}/tasks")
        if seen is not None:
            seen.append(batch.count())
        last = 0 if patience else max_attempts + bool(template)  # with patience the state has the prompts
        answers = stored(_answers(_told(batch.where("NOT failed"), template, instructions), model, template, last), f"{asked}/answers")
        said = ["session_id", "file_id", "attempt", "reason", "user_prompt", "data_url"]
        names = [c for c in answers.columns if c not in said[3:]]
        good = answers.where("reason IS NULL").select(*names, F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"))
        lost = batch.where("failed").select(
            *[c for c in names if c in batch.columns], F.lit(None).cast("string").alias("data_json"), F.lit(None).cast("string").alias("header_json"),
            F.lit(None).cast("array<string>").alias("entries_json"), F.lit(False).alias("success"), F.col("feedback").alias("error"),
        )
        write_results(good.unionByName(lost), path, result_seq=started + batch_id)
        if not answers.isEmpty():
            answers.select(*said).write.mode("overwrite").parquet(told)
        _drop(spark, asked)

    with with_state_store(spark), with_freed_shuffles(spark):
        return tasks.writeStream.foreachBatch(store).option("checkpointLocation", f"{checkpoint}/query").trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def settle(files: DataFrame, model: Model, path: str, checkpoint: str, template: Template | None = None, instructions: str = "", max_attempts: int = 3) -> int:
    """Run the stream on what is there, again and again from its checkpoint, until no file waits; returns the number of runs."""
    runs = 0
    while True:
        seen: list[int] = []
        stream_extract_retried(files, model, path, checkpoint, template, instructions, max_attempts, trigger={"availableNow": True}, seen=seen).awaitTermination()
        runs += 1
        if not any(seen):
            return runs
