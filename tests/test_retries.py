"""Retries of arriving files: who is asked, and what timers do."""

import os
from types import SimpleNamespace

import pandas as pd

from docmerge.plans.extract import extract_documents
from docmerge.sinks.results import current_results
from docmerge.streaming import retries

SCHEMA = "session_id string, file_id string, file_name string, file_seq bigint, text string"


def recorder(path):
    """A model that notes each prompt and answers well when told what was wrong, or at once if the text is easy."""

    def model(prompts):
        out = []
        for p in prompts:
            with open(path, "a") as log:
                log.write(p.user.split()[-1] + ("+" if p.feedback else "") + "\n")
            out.append('{"a": 1, "b": 2}' if p.feedback or p.user.endswith("easy") else "nothing")
        return out

    return model


def test_restarts_ask_nobody_twice(spark, tmp_path):
    rows = [("s", "1", "a.txt", 1, "easy"), (None, "1", "b.txt", 2, "hard"), ("s", "2", "c.txt", 3, "harder")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    files = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    model, where = recorder(str(tmp_path / "log")), (str(tmp_path / "out"), str(tmp_path / "state"))
    assert retries.settle(files, model, *where) == 3
    asked = sorted(open(tmp_path / "log").read().split())
    assert asked == ["easy", "hard", "hard+", "harder", "harder+"]
    assert retries.settle(files, model, *where) == 1 and sorted(open(tmp_path / "log").read().split()) == asked
    want = extract_documents(spark.createDataFrame(rows, SCHEMA), recorder(os.devnull))
    pick = ["session_id", "file_id", "file_name", "file_seq", "success", "data_json", "error", "attempt"]
    assert sorted(map(str, current_results(spark, where[0]).select(*pick).collect())) == sorted(map(str, want.select(*pick).collect()))
    spark.createDataFrame([("s", "9", "z.txt", 9, "hard")], SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
    assert retries.settle(files, model, *where) == 3 and current_results(spark, where[0]).count() == 4


class FakeHandle:
    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):  # noqa: N802
        update = lambda v: setattr(self, "value", v)
        return SimpleNamespace(get=lambda: self.value, exists=lambda: self.value is not None, update=update, clear=lambda: update(None))

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)

    def listTimers(self):  # noqa: N802
        return iter(self.timers)


def test_files_without_an_answer_are_asked_again():
    handle, unsettled = FakeHandle(), retries._Unsettled(2, True, "plain", 5000)
    unsettled.init(handle)
    clock = lambda t: SimpleNamespace(getCurrentProcessingTimeInMs=lambda: t)
    file = {"session_id": None, "file_id": "f", "group_id": "g", "file_name": "n", "file_seq": 3, "system_prompt": "form", "user_prompt": "u", "data_url": None}
    rows = lambda **k: iter([pd.DataFrame([file | {"kind": "file", "attempt": None, "reason": None} | k])])
    step = lambda frames: [tuple(r) for f in frames for r in f[["system_prompt", "attempt", "feedback", "plain", "failed"]].itertuples(index=False)]
    assert step(unsettled.handleInputRows((), rows(), clock(0))) == [("form", 1, None, False, False)] and handle.timers == [5000]
    assert step(unsettled.handleInputRows((), rows(), clock(1))) == []  # listed again
    handle.timers.clear()
    assert step(unsettled.handleExpiredTimer((), clock(5000), None)) == [("form", 2, "no answer came", False, False)] and handle.timers == [10_000]
    assert step(unsettled.handleInputRows((), rows(kind="refused", attempt=1, reason="late"), clock(6000))) == []  # an answer that was given up
    assert step(unsettled.handleInputRows((), rows(kind="refused", attempt=2, reason="bad"), clock(7000))) == [("plain", 3, "bad", True, False)] and handle.timers == [12_000]
    handle.timers.clear()
    assert step(unsettled.handleExpiredTimer((), clock(12_000), None)) == [("form", 3, "no answer came", True, True)] and handle.value is None and handle.timers == []
    assert step(unsettled.handleExpiredTimer((), clock(13_000), None)) == []
