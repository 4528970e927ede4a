"""What larger tables ask for: folders of files as tables, few calls to state, many small files."""

import json
import time
from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql import functions as F

from docmerge import queries
from docmerge.operators.cells import to_cells, value_preview
from docmerge.operators.identity import join_on
from docmerge.operators.merge import merge_header, number_rows
from docmerge.operators.ordering import scan_totals
from docmerge.operators.reshape import pivot_cells, pivot_long_to_wide
from docmerge.operators.template import resolve_template
from docmerge.plans.model_merge import input_keys
from docmerge.plans.prompts import system_prompt
from docmerge.plans.rounds import CALL_ROWS, run_rounds
from docmerge.schemas import PivotPreset, TemplateColumn
from docmerge.session import checkpointed
from docmerge.sources.files import read_documents, read_files
from docmerge.sources.sessions import SessionReader
from docmerge.sources.stored import read_results
from docmerge.sources.tables import order_lines
from docmerge.streaming import expiry, retries
from docmerge.streaming.flows import with_few_listers


def test_streams_read_tables_of_several_files(spark, tmp_path):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(6).alias("n_chars"))
    for folder, parts in (("many", 4), ("one", 1)):
        docs.repartition(parts).write.parquet(str(tmp_path / folder / "documents.parquet"))
    spark.range(3).write.parquet(str(tmp_path / "many" / "documents.parquet2"))
    part = next((tmp_path / "one" / "documents.parquet").glob("part-*"))
    (tmp_path / "single").mkdir()
    (tmp_path / "single" / "documents.parquet").write_bytes(part.read_bytes())
    for folder in ("many", "one", "single"):
        assert [r["file_count"] for r in queries.stream_group_counts(spark, str(tmp_path / folder)).collect()] == [40]
        assert sorted((int(r["file_id"]), r["success"]) for r in queries.stream_versions(spark, str(tmp_path / folder)).collect()) == [(i, True) for i in range(40)]


class Calls:
    """Keyed state of one key that notes the calls to it, each of which is a round trip to the JVM."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], []

    def note(self, name, result=None):
        self.calls.append(name)
        return result

    def getValueState(self, name, schema):  # noqa: N802
        def update(value):
            self.value = value
            self.calls.append("update")

        return SimpleNamespace(get=lambda: self.note("get", self.value), exists=lambda: self.note("exists", self.value is not None), update=update, clear=lambda: update(None))

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(self.note("register", at))

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(self.note("delete", at))

    def listTimers(self):  # noqa: N802
        return iter(self.note("list", list(self.timers)))


def test_sessions_ask_state_once():
    handle, session = Calls(), expiry._Session(1000, ["session_id", "step"])
    session.init(handle)
    clock = lambda at: SimpleNamespace(getCurrentWatermarkInMs=lambda: at)
    seen = lambda at, *began: [tuple(r) for r in session.handleInputRows((True, "s"), iter([Row(session_id="s", step=1, began_ms=b) for b in began]), clock(at))]
    assert seen(0, 50, None, 40) == [("s", 1, 50, False), ("s", 1, None, False), ("s", 1, 40, False)]
    assert handle.calls == ["get", "update", "register"] and handle.timers == [1041]
    assert seen(0, 30, 60) and handle.timers == [1031] and handle.value == (30, False)
    handle.calls.clear()
    assert seen(1030, 30) == [("s", 1, 30, False)] and seen(1031, None) == [] and handle.calls == ["get", "get"]
    assert [tuple(r) for r in session.handleExpiredTimer((True, "s"), clock(1031), None)] == [("s", None, 30, True)]
    assert seen(5, 20) == [] and handle.timers == [1031]


def test_files_are_asked_for_without_frames():
    handle, file = Calls(), retries._UnsettledRows(2, True, "plain", None)
    file.init(handle)
    names = {"session_id": None, "file_id": "f", "group_id": "g", "file_name": "n", "file_seq": 3, "system_prompt": "form", "user_prompt": "u", "data_url": None}
    step = lambda **k: [(r.system_prompt, r.attempt, r.feedback, r.plain, r.failed) for r in file.handleInputRows((), iter([Row(**(names | {"kind": "file", "attempt": None, "reason": None} | k))]), None)]
    assert step() == [("form", 1, None, False, False)] and handle.calls == ["get", "update"]
    assert step() == [] and step(kind="refused", attempt=1, reason="bad") == [("form", 2, "bad", False, False)]
    assert step(kind="refused", attempt=2, reason="worse") == [("plain", 3, "worse", True, False)]
    handle.calls.clear()
    assert step(kind="accepted", attempt=3) == [] and handle.value is None and handle.calls == ["get", "update"]


def test_state_holds_no_texts(spark, tmp_path):
    names = {"session_id": None, "file_id": "f", "group_id": "g", "file_name": "n", "file_seq": 3, "system_prompt": None, "user_prompt": "a long text", "data_url": "an image"}
    for patience, kept in ((None, (None, None)), (5000, ("a long text", "an image"))):
        handle, file = Calls(), retries._UnsettledRows(2, True, None, patience)
        file.init(handle)
        clock = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 0)
        step = lambda **k: [(r.user_prompt, r.data_url, r.attempt) for r in file.handleInputRows((), iter([Row(**(names | {"kind": "file", "attempt": None, "reason": None} | k))]), clock)]
        assert step() == [("a long text", "an image", 1)] and handle.value[6:8] == kept
        said = {} if patience is None else {"user_prompt": None, "data_url": None}
        assert step(kind="refused", attempt=1, reason="bad", **said) == [("a long text", "an image", 2)] and handle.value[6:8] == kept
    docs = spark.createDataFrame([("s", str(i), f"{i}.txt", i, f"text {i}") for i in range(4)], "session_id string, file_id string, file_name string, file_seq long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    seen = tmp_path / "seen"
    seen.mkdir()

    def model(prompts):
        for p in prompts:
            (seen / f"{p.user.split()[-1]}-{p.feedback is not None}-{len(p.system)}").touch()
        return ["nothing"] * len(prompts)

    retries.settle(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), model, str(tmp_path / "out"), str(tmp_path / "state"), [TemplateColumn("title"), TemplateColumn("item", repeating=True)], max_attempts=2)
    form, plain = (len(system_prompt(t)) for t in ([TemplateColumn("title"), TemplateColumn("item", repeating=True)], None))
    assert {f.name for f in seen.iterdir()} == {f"{i}-{told}-{n}" for i in range(4) for told, n in ((False, form), (True, form), (False, plain))}
    assert not list((tmp_path / "state" / "asked").iterdir())
    notices = spark.read.parquet(str(tmp_path / "state" / "notices" / "*"))
    assert {(r.attempt, r.user_prompt is None) for r in notices.collect()} == {(1, False), (2, False), (3, True)}


def test_many_small_files_in_few_tasks(spark, tmp_path):
    for i in range(2500):
        place = tmp_path / f"s{i % 2}"
        place.mkdir(exist_ok=True)
        (place / f"{i}.json").write_text(json.dumps({"fileId": str(i), "success": True, "data": {"n": i}}) if i % 5 else "{broken")
    least, split = 4 * spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 * 1024 * 1024))  # a split per file
    try:
        files = read_files(spark, str(tmp_path))
        assert files.rdd.getNumPartitions() <= max(least, 2500 // 16) and files.count() == 2500
        found = read_results(spark, str(tmp_path / "*"))
        at = {(r["session_id"], r["file_id"]): (r["file_seq"], r["data_json"]) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", split)
    assert {k: v[1] for k, v in at.items()} == {(f"s{i % 2}", str(i)): f'{{"n": {i}}}' for i in range(2500) if i % 5}
    assert sorted(v[0] for k, v in at.items() if k[0] == "s0") == list(range(1000))
    assert "Relation [" not in found._jdf.queryExecution().optimizedPlan().toString()  # the files are not opened again


def test_a_batch_of_small_files_takes_as_many_tasks_as_cores(spark, tmp_path):
    from docmerge.streaming import flows

    (tmp_path / "in").mkdir()
    for i in range(300):
        (tmp_path / "in" / f"f{i}.txt").write_text(str(i))
    rows = flows.stream_documents(spark, str(tmp_path / "in"), max_files=300).select("file_name", "text")
    with with_few_listers(spark):
        assert spark.conf.get("spark.sql.streaming.fileSource.log.compactInterval") == "100"
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert len(list((tmp_path / "out").glob("*.parquet"))) <= spark.sparkContext.defaultParallelism
    found = {r.file_name: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {f"f{i}.txt": str(i) for i in range(300)}


def test_uploads_are_listed_once(spark, tmp_path):
    for i in range(20):
        (tmp_path / f"f {i}.{('txt', 'png', 'pdf')[i % 3]}").write_text(f"text {i}")
    accepted, rejected = read_documents(spark, str(tmp_path))
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("binaryFile")
    assert scans(accepted) == 1 and scans(rejected) == 0
    assert accepted.columns == ["session_id", "file_id", "file_name", "modified", "size", "content", "path", "ext", "mime", "file_seq"]
    rows = accepted.collect()
    assert sorted(r.file_seq for r in rows) == list(range(14)) and {r.file_name: bytes(r.content).decode() for r in rows} == {f"f {i}.{('txt', 'png')[i % 3]}": f"text {i}" for i in range(20) if i % 3 < 2}
    assert [r.file_seq for r in sorted(rows, key=lambda r: (r.modified, r.file_id))] == list(range(14))
    assert {r.file_name for r in rejected.collect()} == {f"f {i}.pdf" for i in range(20) if i % 3 == 2}


def test_batches_list_their_files_in_few_tasks(spark):
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name, None)
    with with_few_listers(spark):
        assert int(spark.conf.get(name)) == 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(name, None) == before


def test_many_folders_in_few_partitions(tmp_path):
    for i in range(600):
        (tmp_path / f"s{i:03d}").mkdir()
    for size, most in ((1, 256), (64, 10)):
        parts = SessionReader(str(tmp_path), size).partitions()
        assert len(parts) <= most and [n for p in parts for n in p.names] == [f"s{i:03d}" for i in range(600)]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_order_lines_are_placed_by_one_window(spark, tmp_path):
    def lines(sizes):
        texts = spark.createDataFrame([(k, n) for k, n in sizes.items()], "l_orderkey long, n int")
        i = F.col("i")
        return texts.select("l_orderkey", F.explode(F.sequence(F.lit(1), "n")).alias("i")).select(
            "l_orderkey", (i % 5).alias("l_linenumber"), (i % 7).alias("l_partkey"), i.cast("long").alias("l_suppkey"), F.lit(None).cast("timestamp").alias("l_shipdate"),
            F.lit(1.0).alias("l_extendedprice"), F.lit(2.0).alias("l_quantity"), F.lit("A").alias("l_returnflag"), F.lit("F").alias("l_linestatus"),
        )

    small, large = {1: 3, 2: 1, None: 4}, {1: 3, 2: 1, None: 4, 9: 12000}
    for name, sizes in (("small", small), ("large", large)):
        lines(sizes).write.parquet(str(tmp_path / name / "lineitem.parquet"))
        found = order_lines(spark, str(tmp_path / name))
        at = {}
        for r in found.collect():
            at.setdefault(r["file_id"], []).append((r["entry_idx"], json.loads(r["entry_json"])["line"], json.loads(r["entry_json"])["part"]))
        for key, n in sizes.items():
            mine = sorted(at[None if key is None else str(key)])
            assert [m[0] for m in mine] == list(range(n)) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)
        assert ("Join" in plan_of(found)) == (name == "large")  # only an order that may be large is counted in parts


def test_totals_come_with_positions(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, F.concat(F.lit("g"), (F.col("id") % 400).cast("string"))).alias("g"), F.col("id").alias("o"), (F.col("id") % 3).alias("w"))
    found = scan_totals(rows, ["g"], ["o"], weight=F.col("w"), out="t", total="all").collect()
    sums, last = {}, {}
    for r in sorted(found, key=lambda r: r["o"]):
        assert r["t"] == sums.get(r["g"], 0)
        sums[r["g"]] = r["t"] + r["w"]
    assert len(found) == 5000 and all(r["all"] == sums[r["g"]] for r in found)


def test_rows_are_numbered_without_reading_them_again(spark):
    rows = spark.range(6).select(F.when(F.col("id") < 4, "a").when(F.col("id") < 5, "b").alias("group_id"), (F.col("id") % 2).alias("file_seq"), F.lit(0).cast("long").alias("entry_idx"), F.col("id").alias("x"))
    found = number_rows(rows.withColumn("group_key", F.col("group_id")))
    assert "Range (" not in plan_of(found)
    got = sorted((r["row_id"], r["label"], r["row_no"], r["n_rows"]) for r in found.collect())
    assert got == [("a-0", "a #1", 0, 4), ("a-1", "a #2", 1, 4), ("a-2", "a #3", 2, 4), ("a-3", "a #4", 3, 4), ("b", "b", 0, 1), ("group-unknown", "group-unknown", 0, 1)]


def _cells(spark, rows):
    return spark.createDataFrame(
        [("f", "n", 1, "header", 0, pos, raw, key, kind, value) for pos, (raw, key, kind, value) in enumerate(rows)],
        "file_id string, file_name string, file_seq long, origin string, entry_idx long, key_pos int, raw_key string, key string, kind string, value string",
    )


def test_cells_stay_where_they_are_for_a_preview(spark):
    keys = spark.createDataFrame([(0, "a"), (1, "b")], "pos int, key string")
    found = value_preview(_cells(spark, [("a", "a", "string", "1"), ("c", "c", "string", "2")]), keys)
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r["pos"], r["key"], r["value"]) for r in found.collect()] == [(0, "a", "1")]


def test_templates_meet_cells_without_a_join(spark):
    rows = [("1-a", "a", "string", "old"), ("2-a", "a", "string", "late"), ("b", "b", "null", "null"), ("1-b", "b", "string", "clean"), ("y", "y", "string", "right"), ("x", "x", "null", "null"), ("1-w", "w", "null", "null"), ("z", "z", "string", "part"), ("s", "s", "string", "same"), ("1-s", "s", "string", "other")]
    template = [TemplateColumn(k) for k in ("a", "b", "x/y", "w/z", "s", "none")]
    found = resolve_template(_cells(spark, rows), template)
    assert "Join" not in plan_of(found) and resolve_template(_cells(spark, rows), []).collect() == []
    assert sorted((r["pos"], r["key"], r["value"]) for r in found.collect()) == [(0, "a", "late"), (1, "b", "clean"), (4, "s", "same")]


def test_models_get_few_prompts_at_once(spark):
    def counting_model(prompts):
        return [str(len(prompts))] * len(prompts)

    prompts = spark.range(300).coalesce(1).select(F.when(F.col("id") > 0, F.col("id")).alias("group_id"), F.lit("s").alias("system_prompt"), F.lit("u").alias("user_prompt"))
    good, _ = run_rounds(prompts, counting_model, lambda a: a.withColumn("reject_reason", F.lit(None).cast("string")), ["group_id"], 1)
    rows = good.collect()
    assert {int(r["response"]) for r in rows} <= set(range(1, CALL_ROWS + 1)) and {r["group_id"] for r in rows} == {None, *range(1, 300)}


def test_input_keys_need_no_places(spark):
    results = spark.range(4).select(F.lit("g").alias("group_id"), F.col("id").cast("string").alias("file_id"), F.col("id").alias("file_seq"), F.lit("n").alias("file_name"), (F.col("id") < 3).alias("success"), F.concat(F.lit('{"k'), F.col("id").cast("string"), F.lit('":1}')).alias("data_json"))
    found = input_keys(results)
    assert "Window" not in plan_of(found) and "Range (" in plan_of(found)
    assert [tuple(r) for r in found.collect()] == [("g", ["k0", "k1", "k2"])]


def test_flat_objects_are_opened_as_maps(spark):
    texts = [
        '{"a":"x","bc":1,"bd":null,"be":true,"bf":""}', '{"1-a":"x","1-b":-2}', '{"aa":1,"ab":2,"aa":3}', '{"1-a":1,"1-a":2}', '{"aa":1.50,"ab":{"value":2.0,"unit":"mg"},"ac":[1,["z",null]],"ad":null,"ae":"p"}',
        '{"1-a":"x","1-b":[1]}', '{"1-a":"x","b":2}', "{}", "[1]", "no", None, '{"aa":"\\u0041"}',
    ]
    results = spark.createDataFrame(list(enumerate(texts)), "file_seq long, data_json string")
    found = to_cells(results)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode(coalesce(flat" in plan  # a map, not pairs made value by value
    at = {}
    for r in found.collect():
        at.setdefault(r["file_seq"], []).append((r["key_pos"], r["raw_key"], r["key"], r["kind"], r["value"]))
    assert {i: sorted(cells) for i, cells in at.items()} == {
        0: [(0, "a", "a", "plain", "x"), (1, "bc", "bc", "plain", "1"), (2, "bd", "bd", "null", ""), (3, "be", "be", "plain", "true"), (4, "bf", "bf", "plain", "")],
        1: [(0, "1-a", "a", "plain", "x"), (1, "1-b", "b", "plain", "-2")],
        2: [(0, "aa", "aa", "plain", "3"), (1, "ab", "ab", "plain", "2")],
        3: [(0, "1-a", "a", "plain", "2")],
        4: [(0, "aa", "aa", "number", "1.5"), (1, "ab", "ab", "object", "2 mg"), (2, "ac", "ac", "array", "1; z"), (3, "ad", "ad", "null", ""), (4, "ae", "ae", "string", "p")],
        5: [(0, "1-a", "a", "string", "x"), (1, "1-b", "b", "array", "1")],
        6: [(0, "1-a", "a", "plain", "x"), (1, "b", "b", "plain", "2")],
        11: [(0, "aa", "aa", "string", "A")],
    }
    cut = {}
    for r in sorted(to_cells(results, strip_prefix=True).collect(), key=lambda r: r["key_pos"]):
        cut.setdefault(r["file_seq"], []).append((r["raw_key"], r["value"]))
    assert (cut[1], cut[3], cut[5], cut[6]) == ([("a", "x"), ("b", "-2")], [("1-a", "2")], [("a", "x"), ("b", "1")], [("1-a", "x"), ("b", "2")])


def test_joined_keys_are_no_structs(spark):
    left = spark.createDataFrame([("s", 1, "a"), (None, 2, "b"), ("s", None, "c"), ("t", 9, "d")], "session_id string, file_id long, x string")
    right = spark.createDataFrame([("s", "1", 10), (None, "2", 20), ("s", None, 30), (None, None, 40)], "session_id string, file_id string, y int")
    keys = ["session_id", "file_id"]
    found = join_on(left, right, keys)
    assert found.columns == ["session_id", "file_id", "x", "y"] and "struct(" not in plan_of(found)
    assert sorted((r["x"], r["y"]) for r in found.collect()) == [("a", 10), ("b", 20), ("c", 30)]
    assert [r["x"] for r in join_on(left, right, keys, "left_anti").collect()] == ["d"]
    assert sorted((r["x"], r["y"]) for r in join_on(left, right, keys, "left").collect()) == [("a", 10), ("b", 20), ("c", 30), ("d", None)]


def test_shuffles_go_when_their_result_is_stored(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    kept = lambda: {n for n in str(blocks.getAllFiles().mkString("\n")).split("\n") if "/shuffle_" in n}
    before = kept()
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3)
    stored = checkpointed(counts)
    for _ in range(50):  # they are removed in the background
        if kept() <= before:
            break
        time.sleep(0.2)
    assert kept() <= before
    assert sorted(r["count"] for r in stored.collect()) == sorted(r["count"] for r in counts.collect()) == [142] + [143] * 6


def test_pivots_shuffle_first_rows_only(spark):
    template = [TemplateColumn("name"), TemplateColumn("k", repeating=True), TemplateColumn("p", repeating=True), TemplateColumn("v", repeating=True)]
    rows = spark.createDataFrame(
        [(g, 1, i, f"{g} #{i}", {"name": f"n{i}", "k": f"k{i % 2}", "p": "a|b" if i % 2 else None, "v": str(i)}) for g in ("g", "h", None, "") for i in (3, 0, 2, 1)],
        "group_id string, group_seq int, entry_idx bigint, label string, data map<string,string>",
    ).repartition(3)
    presets = [PivotPreset("k", prefix="p", values=("v",)), PivotPreset("k", values=("name", "v"))]
    cells = pivot_cells(rows, template, presets)
    assert "Join" not in cells._jdf.queryExecution().optimizedPlan().toString()
    found = {(r.group_id, r.name): r.value for r in cells.collect()}
    first = {"k0_v": "0", "a|b_k1_v": "1", "k1_v": "1", "k0_name": "n0", "k1_name": "n1"}
    assert {n: v for (g, n), v in found.items() if g == "g"} == {n: v for (g, n), v in found.items() if g == "h"} == first
    wide = {r.group_id: r.asDict() for r in pivot_long_to_wide(rows, template, presets).collect()}
    assert {k: wide["g"][k] for k in first} == first and wide["g"]["name"] == "n0" and wide["g"]["_label"] == "g"
    assert len(wide) == 2 + len({g for g, _ in found} - {"g", "h"})


def test_merged_headers_are_shuffled_once(spark):
    cells = [("g", "same", "a"), ("g", "same", "a"), ("g", "two", "b"), ("g", "two", "a"), ("g", "none", None), ("g", "none", None), ("g", "some", None), ("g", "some", "x"), (None, "same", "z")]
    rows = spark.createDataFrame(
        [(g, 10 - i, "header", 0, i, k, v) for i, (g, k, v) in enumerate(cells)], "group_id string, file_seq long, origin string, entry_idx long, key_pos int, key string, value string",
    ).repartition(3)
    merged = merge_header(rows)
    assert merged._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")).count("Exchange hashpartitioning") == 1
    got = {(r.group_id, r.key): (r.value, r.consistent) for r in merged.collect()}
    assert got == {("g", "same"): ("a", True), ("g", "two"): ("a", False), ("g", "none"): (None, True), ("g", "some"): ("x", False), ("group-unknown", "same"): ("z", True)}
