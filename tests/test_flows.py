"""Session folders, byte-bounded merges and expiry beyond what the queries cover."""

import json

from pyspark.sql import functions as F

from docmerge.plans import model_merge as MM
from docmerge.sinks.results import compact_days, expire_days, stored_days, write_daily
from docmerge.sources.sessions import read_sessions, session_members, session_rows, write_sessions


def test_session_folders_of_any_state(spark, tmp_path):
    groups = json.dumps([{"groupId": "g1", "groupKey": "k", "fileCount": 2, "fileIds": ["a", "b"]}, {"groupId": None}, "x", {"groupId": 7}])
    rows = [("s1", '{"createdAt": 1700000000123, "fileCount": 2}', groups), ("s2", "{broken", None), ("s3", None, "[]"), ("s4", "[]", '{"no":"list"}')]
    frame = spark.createDataFrame(rows, "session_id string, meta_json string, groups_json string")
    assert write_sessions(frame, str(tmp_path / "s")) == 6
    got = {(r["session_id"], r["group_id"]): r for r in read_sessions(spark, str(tmp_path / "s")).collect()}
    assert set(got) == {("s1", "g1"), ("s1", "7"), ("s2", None), ("s3", None), ("s4", None)}
    one = got["s1", "g1"]
    assert one["file_ids"] == ["a", "b"] and one["file_count"] == 2 and one["file_total"] == 2
    assert read_sessions(spark, str(tmp_path / "s")).where("session_id = 's1'").select(F.unix_millis("created_at")).first()[0] == 1700000000123
    assert sorted((r["group_id"], r["file_id"], r["file_seq"]) for r in session_members(read_sessions(spark, str(tmp_path / "s"))).collect()) == [("g1", "a", 0), ("g1", "b", 1)]
    (tmp_path / "none").mkdir()
    assert read_sessions(spark, str(tmp_path / "none")).count() == 0
    assert list(session_rows("x", {"createdAt": True}, None)) == [("x", None, None, None, None, None, None)]


def joining():
    """A model that puts all values of ``v`` into one text, in order."""

    def model(prompts):
        out = []
        for p in prompts:
            listed = json.loads(p.user[p.user.index("[\n"):])
            out.append(json.dumps({"entries": [{"v": "".join(str(e["v"]) for d in listed for e in d["extracted_data"].get("entries", [d["extracted_data"]]))}]}))
        return out

    return model


def test_prompts_bounded_by_bytes(spark):
    texts = ["ab"] * 40 + ["x" * 300] + ["cd"] * 9
    rows = [("g", f"f{i:03d}", "n", i, True, json.dumps({"v": t})) for i, t in enumerate(texts)] + [("h", "one", "n", 0, True, '{"v":"alone"}')]
    results = spark.createDataFrame(rows, "group_id string, file_id string, file_name string, file_seq bigint, success boolean, data_json string")
    prompts = MM.merge_prompt(results, max_bytes=200).where("group_id = 'g'").orderBy("part").collect()
    assert sum(p["n_files"] for p in prompts) == 50 and len(prompts) > 10
    assert all(p["n_files"] == 1 or len(p["user_prompt"].split("[\n", 1)[1].rsplit("\n]", 1)[0].encode()) <= 200 for p in prompts)
    merged = {r["group_id"]: r for r in MM.merge_groups_with_model(results, joining(), max_bytes=1500).collect()}
    assert merged["g"]["data"]["v"] == "".join(texts) and merged["h"]["merge_method"] == "single"
    stuck = {r["group_id"]: r for r in MM.merge_groups_with_model(results, joining(), max_bytes=200).collect()}
    assert stuck["g"]["merge_method"] == "error" and "bound" in stuck["g"]["error"] and stuck["h"]["merge_method"] == "single"


def test_expiry_keeps_unknown_ages_and_untouched_days(spark, tmp_path):
    from datetime import date, datetime

    rows = [("a", "1", datetime(2024, 5, 1, 9)), ("b", "1", datetime(2024, 5, 2, 9)), ("c", "1", datetime(2024, 5, 2, 15)), ("d", "1", None), ("e", "1", datetime(2024, 5, 3))]
    frame = spark.createDataFrame(rows, "session_id string, file_id string, created_at timestamp")
    path = str(tmp_path / "t")
    for seq in (1, 2):
        write_daily(frame, path, seq)
    assert stored_days(spark, path) == [date(2024, 5, d) for d in (1, 2, 3)]
    assert expire_days(spark, path, datetime(2024, 5, 3, 12), "24 hours") == [date(2024, 5, 1), date(2024, 5, 2)]
    assert sorted(r["session_id"] for r in spark.read.parquet(path).collect()) == ["c", "c", "d", "d", "e", "e"]
    compact_days(spark, path, [date(2024, 5, 3), date(2020, 1, 1)])
    assert sorted(r["session_id"] for r in spark.read.parquet(path).collect()) == ["c", "c", "d", "d", "e"]
    assert expire_days(spark, path, datetime(2024, 5, 3, 15, 1), "1 days") == [date(2024, 5, 2)] and stored_days(spark, path) == [date(2024, 5, 3)]
    assert expire_days(spark, path, datetime(2024, 5, 3, 15, 1), "1 days") == []
