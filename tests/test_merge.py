"""Merging against a sequential fold written down independently, on random messy results."""

import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from docmerge.operators import merge as M
from docmerge.operators.cells import mergeable, to_cells
from docmerge.operators.ordering import scan_totals, with_position, with_running_total
from docmerge.operators.reshape import pivot_long_to_wide
from docmerge.plans.align import merge_results, retry_groups
from docmerge.schemas import RESULTS, PivotPreset, TemplateColumn

KEYS = ["姓名", "1-姓名", "基本信息-姓名", "WBC", "ＷＢＣ", "x", "T", "12", "WBC{", "结果-a", "结果-b", "note"]
VALUES = ["a", "b", "", None, 3, 2.5, {"value": 1, "unit": "g"}, ["p", "", "q"], True, "c\"d"]
TEMPLATE = [TemplateColumn("姓名"), TemplateColumn("2-extra"), TemplateColumn("WBC", repeating=True), TemplateColumn("note", repeating=True)]


def clean_key(k):
    k = re.sub(r"\s+", "", unicodedata.normalize("NFKC", k))
    old = None
    while old != k:
        old = k
        k = re.sub(r"^(\d+[-—–]|基本信息-)", "", k)
    return re.sub(r"[{:'\",}]+$", "", k)


def valid(k):
    return bool(k) and not re.fullmatch(r"\d+|[A-Za-z]", k) or k in ("T", "N", "M")


def text(v):
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, dict):
        return f"{v['value']} {v['unit']}"
    if isinstance(v, list):
        return "; ".join(x for x in v if x)
    return str(v)


def fields(obj):
    for k, v in obj.items():
        if v is not None and v != "" and valid(clean_key(k)):
            yield clean_key(k), text(v)


def unprefixed(obj):
    first = next(iter(obj), "")
    prefix = first.split("-")[0] + "-"
    if len(obj) > 1 and "-" in first and all(k.startswith(prefix) for k in obj):
        return {k[len(prefix):]: v for k, v in obj.items()}
    return obj


def fold(objects):
    merged, seen = {}, {}
    for obj in objects:
        for k, v in fields(obj):
            merged.setdefault(k, v)
            seen.setdefault(k, [])
            if v not in seen[k]:
                seen[k].append(v)
    return merged, {k: v for k, v in seen.items() if len(v) > 1}


def make(rng, n_files, n_groups):
    rows = []
    for i in range(n_files):
        obj = lambda m: {k: rng.choice(VALUES) for k in rng.sample(KEYS, rng.randint(0, m))}
        # Group g0 holds about half of all files.
        g = "g0" if rng.random() < 0.5 else f"g{rng.randrange(n_groups)}"
        rows.append(
            {
                "group_id": g, "file_id": f"f{i}", "file_name": f"{g}-{i % 3}.txt", "file_seq": rng.randrange(-(2**60), 2**60) if i % 2 else i * 9000,
                "success": rng.random() < 0.8, "header": obj(4) if rng.random() < 0.8 else None,
                "entries": [obj(5) for _ in range(rng.randint(0, 3))],
            }
        )
    return rows


def as_df(spark, rows):
    dump = lambda o: None if o is None else json.dumps(o, ensure_ascii=False)
    data = [
        ("s", r["group_id"], r["file_id"], r["file_name"], r["file_seq"], r["success"], None, dump(r["header"]), [dump(e) for e in r["entries"]], None, 1, 1)
        for r in rows
    ]
    return spark.createDataFrame(data, RESULTS)


def by_group(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: r["file_seq"]):
        if r["success"]:
            groups.setdefault(r["group_id"], []).append(r)
    return groups


def nested_model(rows):
    out = {}
    for g, files in by_group(rows).items():
        header, conflicts = fold([r["header"] or {} for r in files])
        entries = [e for r in files for e in r["entries"]]
        for i, e in enumerate(entries or [{}]):
            data = header | dict(fields(e))
            for key, norm in (("姓名", "姓名"), ("2-extra", "extra"), ("WBC", "WBC"), ("note", "note")):
                data.setdefault(key if norm not in data else norm, None)
            many = len(entries) > 1
            out[f"{g}-{i}" if many else g] = (
                f"{g} #{i + 1}" if many else g, data, {k: k not in conflicts for k in data}, len({r["file_name"] for r in files}), len(files) > 1 or many,
            )
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_nested_equals_fold(spark, seed):
    rows = make(random.Random(seed), 120, 12)
    want = nested_model(rows)
    df = as_df(spark, rows).repartition(5, F.rand(seed))
    got = {r.row_id: (r.label, r.data, r.field_consistency, r.n_sources, r.is_merged) for r in M.merge_nested(df, template=TEMPLATE).collect()}
    assert got == want
    long_entries = df.select("file_id", F.posexplode("entries_json").alias("entry_idx", "entry_json"))
    again = M.merge_nested(df.drop("entries_json"), long_entries, TEMPLATE)
    assert {r.row_id: r.data for r in again.collect()} == {k: v[1] for k, v in want.items()}


def test_merge_flat_equals_fold(spark):
    rows = make(random.Random(3), 120, 12)
    df = as_df(spark, rows)
    want = {}
    for g, files in by_group(rows).items():
        objects = [unprefixed(e) for r in files for e in r["entries"]]
        if objects:
            data, conflicts = fold(objects)
            want[g] = (data, {k: k not in conflicts for k in data}, len(objects) > 1, len({r["file_name"] for r in files if r["entries"]}))
    got = {r.row_id: (r.data, r.field_consistency, r.is_merged, r.n_sources) for r in M.merge_flat(df, strict=True).collect()}
    assert got == want


def test_conflicts_equal_fold(spark):
    rows = make(random.Random(4), 150, 8)
    want = {}
    for g, files in by_group(rows).items():
        want |= {(g, k): v for k, v in fold([r["header"] or {} for r in files])[1].items()}
    cells = mergeable(to_cells(as_df(spark, rows).where("success"), origins=("header",)))
    got = {}
    for r in M.detect_conflicts(cells).orderBy("seen_file_seq", "seen_key_pos").collect():
        got.setdefault((r.group_id, r.key), []).append(r.value)
    assert got == want


def test_row_order_does_not_matter(spark):
    rows = make(random.Random(5), 60, 6)
    a = M.merge_nested(as_df(spark, rows), template=TEMPLATE)
    random.Random(6).shuffle(rows)
    b = M.merge_nested(as_df(spark, rows).repartition(7), template=TEMPLATE)
    key = lambda r: r.row_id
    assert sorted(a.collect(), key=key) == sorted(b.collect(), key=key)


def test_template_spelling(spark):
    """A value under the clean form of a template key goes to the template's own key."""
    df = as_df(spark, [{"group_id": "g", "file_id": "f", "file_name": "n", "file_seq": 1, "success": True, "header": {"extra": "v"}, "entries": []}])
    assert M.merge_nested(df, template=TEMPLATE).head().data["2-extra"] == "v"
    strict = M.merge_nested(df, template=TEMPLATE, strict=True).head().data
    assert strict["extra"] == "v" and "2-extra" not in strict


def test_merge_choice_and_retry(spark):
    rows = make(random.Random(7), 40, 4)
    df = as_df(spark, rows)
    assert merge_results(df, template=[TemplateColumn("姓名")]).select("group_id").distinct().count() == merge_results(
        df, template=[TemplateColumn("姓名")]
    ).count()
    merged = merge_results(df, template=TEMPLATE)
    again = retry_groups(merged, df, ["g0"], template=TEMPLATE)
    assert sorted(r.row_id for r in again.collect()) == sorted(r.row_id for r in merged.collect())


@pytest.mark.parametrize("spread", [1, 20_000, 2**50])
def test_positions_in_large_and_sparse_groups(spark, spread):
    rng = random.Random(spread)
    seqs = rng.sample(range(-3000, 3000), 1500)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(5)}", s * spread, rng.randint(0, 4)) for s in seqs]
    df = spark.createDataFrame(rows, "g string, file_seq bigint, w int")
    want, want_sum, count, total = {}, {}, {}, {}
    for g, s, w in sorted(rows, key=lambda r: r[1]):
        want[g, s], want_sum[g, s] = count.get(g, 0), total.get(g, 0)
        count[g], total[g] = count.get(g, 0) + 1, total.get(g, 0) + w
    assert {(r.g, r.file_seq): r.pos for r in with_position(df, ["g"]).collect()} == want
    levels = [F.shiftright("file_seq", 39), F.shiftright("file_seq", 14)]
    sums = with_running_total(df, ["g"], levels, ["file_seq"], weight=F.col("w"), out="t")
    assert {(r.g, r.file_seq): r.t for r in sums.collect()} == want_sum
    scanned = scan_totals(df.repartition(7), ["g"], ["file_seq"], weight=F.col("w"), out="t")
    assert {(r.g, r.file_seq): r.t for r in scanned.collect()} == want_sum


def test_scan_over_many_ranges(spark):
    """One group over all ranges, groups inside of one, null groups and null orders; ranges are not joined up for small data."""
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 8 + [None, "a", "b"]), None if i == 5 else i * 10**12 - 10**15, rng.randint(-3, 9)) for i in range(3000)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "g string, file_seq bigint, w int")
        got = scan_totals(df, ["g"], ["file_seq"], weight=F.col("w"), out="t").collect()
        places = scan_totals(df, ["g"], ["file_seq"]).collect()
        assert scan_totals(df.limit(0), ["g"], ["file_seq"]).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    total, count, want = {}, {}, {}
    for g, s, w in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        want[g, s] = total.get(g, 0), count.get(g, 0)
        total[g], count[g] = total.get(g, 0) + w, count.get(g, 0) + 1
    assert {(r.g, r.file_seq): r.t for r in got} == {k: v[0] for k, v in want.items()}
    assert {(r.g, r.file_seq): r.pos for r in places} == {k: v[1] for k, v in want.items()}


def test_pivot_equals_loop(spark):
    rng = random.Random(8)
    template = [TemplateColumn("name"), *[TemplateColumn(k, repeating=True) for k in ("cls", "item", "val", "flag")]]
    presets = [PivotPreset("item", "cls"), PivotPreset("flag", None, ("val",)), PivotPreset("")]
    rows, n = [], {}
    for g in range(8):
        for i in range(rng.randint(1, 6)):
            pick = lambda *o: rng.choice(o)
            data = {"name": pick("n1", "n2", None), "cls": pick("", "A", "B"), "item": pick("i", "j", None), "val": pick("1", "2", None), "flag": pick("A", "i"), "other": pick("o1", "o2")}
            rows.append((f"g{g}", g * 10, i, f"G{g} #{i + 1}", data))
    names, want = [], {}
    name = lambda p, v, c: (f"{p}_" if p else "") + (v or "(empty)") + "_" + c
    plans = [("cls", "item", ["val", "flag"]), (None, "flag", ["val"])]
    for prefix, key, cols in plans:
        for _, _, _, _, d in rows:
            for c in cols:
                nm = name(d[prefix] if prefix else "", d[key] or "", c)
                if nm not in names:
                    names.append(nm)
    for g, _, i, label, d in rows:
        if g not in want:
            want[g] = {"_label": label.split(" #")[0], "name": d["name"]} | {"other": d["other"]}
            n[g] = [set(), set()]
    for k, (prefix, key, cols) in enumerate(plans):
        for g, _, i, label, d in rows:
            slot = (d[prefix] if prefix else "", d[key] or "")
            if slot not in n[g][k]:
                n[g][k].add(slot)
                for c in cols:
                    want[g][name(*slot, c)] = d[c]
    df = spark.createDataFrame(rows, "group_id string, group_seq int, entry_idx int, label string, data map<string,string>")
    out = pivot_long_to_wide(df.repartition(3), template, presets, extras=True)
    assert [c for c in out.columns if c not in ("group_id", "group_seq", "_label", "name", "extras")] == names
    for r in out.collect():
        row = r.asDict()
        assert {c: row[c] for c in ["_label", "name", *names]} == {c: want[r.group_id].get(c) for c in ["_label", "name", *names]}
        assert row["extras"] == {"other": want[r.group_id]["other"]}


def test_consistency_moves_with_its_key(spark):
    files = [{"group_id": "g", "file_id": f"f{i}", "file_name": f"n{i}", "file_seq": i, "success": True, "header": {"extra": f"v{i}", "same": "x"}, "entries": []} for i in (1, 2)]
    template = [TemplateColumn("2-extra"), TemplateColumn("1-same")]
    for merge in (M.merge_nested, M.merge_flat):
        (row,) = merge(as_df(spark, files), template=template).collect()
        assert (row.data, row.field_consistency) == ({"2-extra": "v1", "1-same": "x"}, {"2-extra": False, "1-same": True})


def test_files_without_group_and_ties(spark):
    files = [{"group_id": None, "file_id": f"f{i}", "file_name": "same.txt", "file_seq": 5, "success": True, "header": {"key": f"v{i}"}, "entries": []} for i in (2, 1)]
    (row,) = M.merge_nested(as_df(spark, files)).collect()
    assert (row.group_id, row.data, row.n_sources, row.is_merged) == ("group-unknown", {"key": "v1"}, 1, True)
