"""Sources, sinks, streams and flows on files."""

import datetime
import json
import os
import re
import zipfile

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docmerge.functions.salvage import salvage
from docmerge.operators import report as R
from docmerge.operators import reshape as S
from docmerge.operators import state as ST
from docmerge.operators import template as TP
from docmerge.operators.grouping import batch_size
from docmerge.operators.select import export_headers, rename_columns, select_rows
from docmerge.plans import extract as X
from docmerge.plans import model_merge as MM
from docmerge.plans.align import export_rows
from docmerge.plans.prompts import system_prompt
from docmerge.schemas import TemplateColumn, template_df
from docmerge.sinks import results as KR
from docmerge.sinks.text import write_csv_safe, write_json
from docmerge.sinks.xlsx import write_xlsx
from docmerge.sources import files as SF
from docmerge.sources import stored as SS
from docmerge.streaming import flows

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the model functions below run in workers


def put(folder, name, content):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as f:
        f.write(content if isinstance(content, bytes) else content.encode())


def run_to_memory(df, name, mode="append"):
    """Drive a stream over all that is there now and return its output table."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def read_parts(path, suffix):
    names = sorted(n for n in os.listdir(path) if n.endswith(suffix) and n.startswith("part"))
    return [open(os.path.join(path, n), "rb").read() for n in names]


def test_read_documents(spark, tmp_path):
    d = str(tmp_path)
    put(d, "a-1.txt", "hello")
    put(d + "/sub", "a-2.md", "检验")
    put(d, "pic.PNG", b"\x89PNG")
    put(d, "x.pdf", "no")
    good, bad = SF.read_documents(spark, d)
    assert sorted(r.file_seq for r in good.collect()) == [0, 1, 2]
    assert [(r.file_name, r.reject_reason) for r in bad.collect()] == [("x.pdf", "unsupported type")]
    large = SF.read_documents(spark, d, max_bytes=4)[1].where("file_name = 'a-1.txt'")
    assert [r.reject_reason for r in large.collect()] == ["too large"]
    assert {r.file_name: r.text for r in SF.text_documents(good).collect()} == {"a-1.txt": "hello", "a-2.md": "检验"}
    images = {r.file_name: r for r in SF.image_documents(good, threshold_mb=0).collect()}
    assert images["pic.PNG"].data_url == "data:image/png;base64,iVBORw==" and images["pic.PNG"].needs_recompress
    blank = good.where("ext = 'png'").withColumn("content", F.lit(b""))
    assert SF.image_documents(blank).head().text == SF.NO_IMAGE and SF.image_documents(blank).head().data_url is None


def test_read_results_and_manifest(spark, tmp_path):
    d = str(tmp_path / "results")
    put(d, "f1.json", json.dumps({"fileId": "f1", "fileName": "a.txt", "groupId": "a", "success": True, "data": {"k": {"v": 1}}, "entries": [{"x": 1}]}))
    put(d, "f2.json", '{"fileId": "f2", broken')
    put(d, "_groups.json", "[]")
    put(str(tmp_path), "groups.json", json.dumps([{"groupId": "a", "groupKey": "a", "fileCount": 2, "fileIds": ["f1", "f2"]}]))
    rows = SS.read_results(spark, d).collect()
    assert [(r.file_id, json.loads(r.data_json), [json.loads(e) for e in r.entries_json]) for r in rows] == [("f1", {"k": {"v": 1}}, [{"x": 1}])]
    ids = spark.createDataFrame([("f1",), ("f9",)], "file_id string")
    assert SS.read_group_results(SS.read_results(spark, d), ids).count() == 1
    assert [(r.session_id, r.file_seq, r.attempt, r.result_seq > 0) for r in rows] == [("results", 0, 1, True)]
    members = SS.read_groups_manifest(spark, f"{tmp_path}/groups.json").orderBy("file_seq").collect()
    assert [(m.group_id, m.file_id, m.file_seq) for m in members] == [("a", "f1", 0), ("a", "f2", 1)]


def test_presets_and_templates(spark):
    preset = SS.template_from_preset("clinical-report")
    assert SS.preset_names() == ["clinical-report"]
    assert (len(preset), len(TP.repeating_columns(preset)), len(TP.non_repeating_columns(preset))) == (17, 11, 6)
    bad = template_df(spark, [*preset, preset[0], TemplateColumn(" "), TemplateColumn("k", "date")])
    assert TP.valid_template(bad).count() == 17
    assert [c.key for c in TP.template_from_text("a\tb\tc\n1\tx\tyes")] == ["a", "b", "c"]
    assert [c.type for c in TP.template_from_text("a\tb\tc\n1\tx\tyes")] == ["number", "string", "boolean"]
    assert [c.key for c in TP.template_from_text("one two three")] == ["one", "two", "three"]
    assert [c.key for c in TP.template_from_text("a\nb\na")] == ["a", "b"]
    assert [c.key for c in TP.template_from_text("姓名")] == ["姓名"]
    assert TP.template_from_text("name, age") is None and TP.template_from_text("  ") is None
    assert [c.key for c in TP.add_key(TP.import_keys(preset[:1], ["a", "床号", "a"]), " b ")] == ["床号", "a", "b"]


EVENTS_TEXT = (
    'event: phase\ndata: {"phase":"grouping"}\n\n'
    'event: file_complete\ndata: {"fileId":"1","success":true,"data":{"a":1,"b":2}}\n\n'
    'event: file_complete\ndata: {"fileId":"2","success":false,"error":"no"}\n\n'
    "event: broken\ndata: {oops\n\n"
    "data: {}\n\n"
    'event: group_merged\ndata: {"groupKey":"g","mergeMethod":"programmatic","conflicts":[{"field":"a"}]}\n\n'
    'event: file_retry\ndata: {"fileId":"2"}\n\n'
    'event: error\ndata: {"message":"stop"}\n\n'
    'event: all_done\ndata: {"totalFiles":2,"totalGroups":1,"mergedGroups":1,"rows":[{}]}'
)


def test_event_log_report(spark, tmp_path):
    put(str(tmp_path), "run.txt", EVENTS_TEXT)
    log = SS.read_event_log(spark, str(tmp_path))
    assert sorted(r.event for r in log.collect()) == sorted(
        ["phase", "file_complete", "file_complete", "group_merged", "file_retry", "error", "all_done"]
    )
    report = {r.event: r for r in R.run_report(log).collect()}
    done = report["file_complete"]
    assert (done.n_events, done.n_success, done.n_failed, done.n_fields) == (2, 1, 1, 2)
    assert report["group_merged"].n_conflicts == 1 and report["error"].n_failed == 1
    assert {r.file_id: (r.success, r.n_fields, r.error) for r in R.run_files(log).collect()} == {"1": (True, 2, None), "2": (False, 0, "no")}
    assert R.run_totals(log).head().asDict() == {"total_files": 2, "total_groups": 1, "merged_groups": 1, "n_rows": 1}
    assert R.run_errors(log).head().message == "stop" and R.run_phases(log).head().phase == "grouping"
    assert R.run_groups(log).head().group_key == "g" and R.run_retries(log).head().n_retries == 1
    stream = flows.stream_progress(flows.stream_event_log(spark, str(tmp_path)))
    live = run_to_memory(stream, "live", "complete")
    assert {r.event: r["count"] for r in live.collect()} == {k: v.n_events for k, v in report.items()}


def table(spark):
    rows = [("=1", 'a"b', None), ("x,y", "line\r\nbreak", "-3"), ("ok", "", "@cmd")]
    return spark.createDataFrame(rows, "`a,b` string, `=c` string, d string").coalesce(1)


def test_csv_bytes(spark, tmp_path):
    write_csv_safe(table(spark), str(tmp_path / "csv"))
    (content,) = read_parts(str(tmp_path / "csv"), ".txt")
    assert content.decode() == (
        '﻿"a,b",\'=c,d\r\n\'=1,"a""b",\r\n"x,y","line\r\nbreak",\'-3\r\nok,,\'@cmd\r\n'
    )
    write_csv_safe(spark.range(6).repartition(3), str(tmp_path / "many"))
    assert all(c.startswith("﻿id\r\n".encode()) for c in read_parts(str(tmp_path / "many"), ".txt"))


def test_xlsx_of_an_empty_table_has_its_header(spark, tmp_path):
    df = spark.createDataFrame([("x", 1)], "a string, b int")
    for mode in ("append", "overwrite"):
        write_xlsx(df.where("b > 1").repartition(3), str(tmp_path / "empty"), mode)
    books = os.listdir(tmp_path / "empty")
    assert len(books) == 1 and books[0].endswith(".xlsx")
    with zipfile.ZipFile(tmp_path / "empty" / books[0]) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert sheet.count("<row>") == 1 and ">a<" in sheet and ">b<" in sheet


def test_json_and_xlsx(spark, tmp_path):
    df = table(spark)
    write_json(df, str(tmp_path / "json"))
    lines = read_parts(str(tmp_path / "json"), ".json")[0].decode().splitlines()
    assert json.loads(lines[0]) == {"a,b": "=1", "=c": 'a"b', "d": None}
    for mode in ("append", "overwrite"):
        write_xlsx(df, str(tmp_path / "xlsx"), mode, max_rows=3)
    books = sorted(os.listdir(tmp_path / "xlsx"))
    assert len(books) == 2 and all(b.endswith(".xlsx") for b in books)
    with zipfile.ZipFile(tmp_path / "xlsx" / books[0]) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert sheet.count("<row>") == 3
    assert re.findall(r">([^<]*)</t>", sheet)[:6] == ["a,b", "=c", "d", "=1", 'a"b', ""]


def test_export_rows(spark, tmp_path):
    rows = spark.createDataFrame([("r1", {"a": "1"}), ("r2", {"a": "2", "b": "x"})], "row_id string, data map<string,string>")
    chosen = select_rows(rows, spark.createDataFrame([("r2",)], "row_id string"))
    for fmt in ("csv", "json", "xlsx"):
        export_rows(chosen, ["b", "a", "z"], str(tmp_path / fmt), fmt)
    assert read_parts(str(tmp_path / "csv"), ".txt") == ["﻿b,a,z\r\nx,2,\r\n".encode()]
    with pytest.raises(ValueError):
        export_rows(rows, ["a"], str(tmp_path / "q"), "pdf")
    assert export_headers(["b", "a"], ["a", "z"]) == ["a", "z", "b"] and export_headers(["b", "a"]) == ["a", "b"]
    assert rename_columns(spark.range(1).selectExpr("id", "1 AS _label"), {"id": "n"}).columns == ["n"]


def test_results_table(spark, tmp_path):
    path, now = str(tmp_path / "r"), datetime.datetime(2024, 1, 3)
    rows = spark.createDataFrame(
        [("s1", "f1", False, "x"), ("s2", "f2", True, "y")], "session_id string, file_id string, success boolean, text string"
    )
    KR.write_results(rows, path, 1)
    KR.write_results(rows.where("file_id = 'f1'").withColumn("success", F.lit(True)), path, 2)
    current = {r.file_id: r.success for r in KR.current_results(spark, path).collect()}
    assert current == {"f1": True, "f2": True} and "text" not in KR.current_results(spark, path).columns
    KR.compact_results(spark, path, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2
    sessions = spark.createDataFrame(
        [("s1", datetime.datetime(2024, 1, 1)), ("s2", None)], "session_id string, created_at timestamp"
    )
    KR.drop_expired(spark, path, sessions, str(tmp_path / "live"), now)
    assert [r.session_id for r in spark.read.parquet(str(tmp_path / "live")).collect()] == ["s2"]


def test_best_results_equals_fold(spark):
    import random

    rng, rows = random.Random(1), []
    for f in range(60):
        for seq in range(rng.randint(1, 6)):
            rows.append((f"f{f}", seq, rng.random() < 0.5, rng.randint(0, 3)))
    want = {}
    for f, seq, ok, n in rows:
        old = want.get(f)
        if old is None or (ok and not old[1]) or (ok and old[1] and n > old[2]):
            want[f] = (seq, ok, n)
    df = spark.createDataFrame(rows, "file_id string, result_seq bigint, success boolean, n_fields int").repartition(4)
    assert {r.file_id: (r.result_seq, r.success, r.n_fields) for r in ST.best_results(df).collect()} == want
    plan = ST.best_results(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_field_counts_and_flags(spark):
    rows = spark.createDataFrame(
        [(True, '{"a":1,"b":2}', None), (True, None, ['{"a":1}', '{"a":2}']), (False, None, None)],
        "success boolean, data_json string, entries_json array<string>",
    )
    got = rows.select(ST.field_count().alias("n"), ST.field_count_label().alias("s")).collect()
    assert [(r.n, r.s) for r in got] == [(2, "2"), (2, "2×1"), (0, "—")]
    assert ST.header_or_data_present(rows) and not ST.header_or_data_present(rows.where("NOT success"))
    assert [batch_size(n) for n in (100, 101, 200, 201)] == [5, 8, 8, 10]


def test_deep_nesting(spark):
    deep = "1"
    for i in range(9):
        deep = '{"k%d":%s,"n":null}' % (i, deep)
    df = spark.createDataFrame([(1, deep), (2, '{"a":{"b":[1,{"c":2}]}}'), (3, "{}")], "id int, doc string")
    got = {r.id: {p.key: p.text for p in r.pairs} for r in S.flatten_hyphen(df, "doc").collect()}
    assert got == {1: {"-".join(f"k{i}" for i in reversed(range(9))): "1"}, 2: {"a-b": '1; {"c":2}'}, 3: {}}


class Flaky:
    """Refuses the first answer of every document, then reads it."""

    def __call__(self, prompts):
        return [p.user.split("document:\n\n")[-1] if p.feedback else "nothing" for p in prompts]


def documents(spark, texts):
    rows = [("s", f"f{i}", f"doc-{i}.txt", i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "session_id string, file_id string, file_name string, file_seq bigint, text string")


def test_extract_with_retry(spark):
    files = documents(spark, ["name: Ann, age: 4", '{"姓名":"张三","科室":{"a":"内科","b":"外科"}}', "unreadable"])
    out = {r.file_id: r for r in X.extract_documents(files, Flaky()).collect()}
    assert json.loads(out["f0"].data_json) == {"name": "Ann", "age": "4"} and out["f0"].attempt == 2
    assert json.loads(out["f1"].data_json)["姓名"] == "张三"
    assert not out["f2"].success and out["f2"].attempt == 3 and "no JSON" in out["f2"].error
    again = X.extract_documents(files, X.facts_extractor, earlier=spark.createDataFrame(list(out.values()), X.extract_documents(files.limit(0), X.facts_extractor).schema).withColumn("result_seq", F.lit(1)))
    assert [r.file_id for r in again.collect()] == ["f2"]


def test_extract_guided_with_fallback(spark):
    template = [TemplateColumn("姓名"), TemplateColumn("检验项目/诊断项目", repeating=True)]
    files = documents(
        spark,
        ['{"基本信息-姓名":"张三","entries":[{"诊断项目":"WBC"},"x",{"诊断项目":null}]}', '{"姓名":"李四","entries":[]}', "?"],
    )
    out = {r.file_id: r for r in X.extract_documents(files, X.rule_extractor, template, max_attempts=2).collect()}
    assert json.loads(out["f0"].header_json) == {"姓名": "张三"}
    assert [json.loads(e) for e in out["f0"].entries_json] == [{"检验项目/诊断项目": "WBC"}, {"检验项目/诊断项目": None}]
    assert out["f1"].success and json.loads(out["f1"].data_json)["姓名"] == "李四" and out["f1"].attempt == 3
    assert not out["f2"].success
    assert "Once per document:\n- 姓名" in system_prompt(template, "be brief")


def failing(prompts):
    if len(prompts) > 1 or "bad" in prompts[0].user:
        raise RuntimeError("down")
    return [prompts[0].user.split("Document:\n")[-1]]


def test_failing_call_fails_its_own_file(spark):
    out = X.extract_documents(documents(spark, ["a1: b, c1: d", "bad"]).coalesce(1), failing, max_attempts=1).collect()
    assert {r.file_id: r.success for r in out} == {"f0": True, "f1": False}
    assert "RuntimeError: down" in [r.error for r in out if not r.success][0]


def merge_model(prompts):
    answers = []
    for p in prompts:
        listed = json.loads(p.user[p.user.index("[\n"):])
        objects = [e for d in listed for e in d["extracted_data"].get("entries", [d["extracted_data"]])]
        merged = {k: v for d in reversed(objects) for k, v in d.items() if k not in ("lost", "Task")}
        answers.append(json.dumps({"entries": [merged | {"Task": "x"}], "conflicts": [{"field": "a", "values": ["1", 2]}]}))
    return answers


def align_model(prompts):
    return [json.dumps({"entries": [{"alpha": "1", "beta": None}]} if p.feedback else {"entries": [{"Alpha": 1, "junk": 2}]}) for p in prompts]


def test_model_merge_and_align(spark):
    rows = [("g", f"f{i}", f"n{i}", i, True, json.dumps({"a": str(i), "lost": "v"})) for i in range(5)] + [("h", "f9", "n9", 9, True, '{"a":"9"}')]
    results = spark.createDataFrame(rows, "group_id string, file_id string, file_name string, file_seq bigint, success boolean, data_json string")
    merged = MM.merge_groups_with_model(results, merge_model).orderBy("group_id").collect()
    assert [(r.group_id, r.merge_method, r.data) for r in merged] == [("g", "ai", {"a": "0", "lost": None}), ("h", "single", {"a": "9"})]
    for max_files in (2, 3):  # one record per group, however many prompts it takes
        parts = MM.merge_groups_with_model(results, merge_model, max_files=max_files).orderBy("group_id").collect()
        assert [(r.group_id, r.merge_method, r.data) for r in parts] == [(r.group_id, r.merge_method, r.data) for r in merged]
    refused = MM.merge_groups_with_model(results, lambda ps: ["nothing"] * len(ps), max_files=2)
    assert [(r.group_id, r.merge_method, r.error is None) for r in refused.orderBy("group_id").collect()] == [("g", "error", False), ("h", "single", True)]
    kept = MM.align_with_model(refused, [TemplateColumn("a")], lambda ps: ["nothing"] * len(ps), max_attempts=1)
    assert [(r.group_id, r.merge_method, r.error is None) for r in kept.orderBy("group_id").collect()] == [("g", "error", False), ("h", "error", False)]
    assert {c.field_name: c["values"] for c in merged[0].conflicts} == {"a": ["1", "2"], "_missing_keys": ["lost"]}
    template = [TemplateColumn("alpha"), TemplateColumn("beta")]
    source = MM.merge_groups_with_model(results, merge_model)
    aligned = MM.align_with_model(source, template, align_model).collect()
    assert all(r.data == {"alpha": "1", "beta": ""} and r.attempt == 2 for r in aligned) and len(aligned) == 2
    forced = MM.align_with_model(source, template, align_model, max_attempts=1).collect()
    assert all(r.data == {"alpha": "", "beta": ""} for r in forced)


def test_stream_extract_and_resume(spark, tmp_path):
    docs, out, state = (str(tmp_path / n) for n in ("docs", "out", "state"))
    put(docs, "p-1.txt", "name: Ann, age: 4")
    put(docs, "p-2.txt", "??")
    run = lambda: flows.stream_extract(flows.stream_documents(spark, docs, 1), X.rule_extractor, out, state, "s1").awaitTermination()
    run()
    first = {r.file_name: r.success for r in KR.current_results(spark, out).collect()}
    assert first == {"p-1.txt": True, "p-2.txt": False}
    put(docs, "p-3.txt", "x1: 1, y1: 2")
    run()
    assert spark.read.parquet(out).count() == 3


def test_stream_counts_dedup_ttl(spark, tmp_path):
    path = str(tmp_path / "in")
    now = datetime.datetime.now()
    rows = [("a-1.txt", "f1", now), ("a-2.txt", "f2", now), ("a-2.txt", "f2", now), ("b.txt", "f3", now - datetime.timedelta(days=2))]
    df = spark.createDataFrame(rows, "file_name string, file_id string, created_at timestamp")
    df.write.parquet(path)
    stream = lambda: spark.readStream.schema(df.schema).parquet(path)
    counts = run_to_memory(flows.stream_group_counts(stream()), "counts", "complete")
    assert {r.group_id: r.file_count for r in counts.collect()} == {"a": 3, "b": 1}
    once = run_to_memory(flows.stream_dedup(stream(), "10 days"), "once")
    assert sorted(r.file_id for r in once.collect()) == ["f1", "f2", "f3"]
    alive = run_to_memory(flows.stream_session_ttl(stream()), "alive")
    assert sorted(r.file_id for r in alive.collect()) == ["f1", "f2", "f2"]


def test_salvage_helper_is_total():
    for text in (None, "", "{", "}", "{}}", "```", "a:b", "[1,2", '{"a": }'):
        assert len(salvage(text)) == 3
