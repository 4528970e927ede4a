"""The stages against brute force, the registered queries against their SQL, and the split from the library."""

import os
import re
import sys

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests_llm_brute import brute_fingerprint, brute_groups_of, measures

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
from oracle_check import compare, duck  # noqa: E402

NAMES = [n for n in entry.queries() if re.match(r"op\d+_", n)]


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", [n for n in NAMES if n in entry.oracle_sql()])
def test_sql(spark, sf, name):
    assert compare(spark, duck(sf), sf, name, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_pipeline_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, tables = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        tables.append(docs)
    raw = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good, unique, clean, mixed, packed = ({}, {}, {}, [], [])
    for held, table in ((good, tables[0]), (unique, tables[1]), (clean, tables[2])):
        assert table.columns == names
        held.update({r["doc_id"]: r for r in table.collect()})
    mixed, packed = tables[3].collect(), tables[4].collect()
    for i, r in raw.items():
        n, chars, symbols, _, repeat = measures(r["text"])
        if n < 10 or 5 * repeat > n:
            assert i not in good
        elif symbols == 0 and repeat == 0 and not (r["text"] or "").isupper():
            words = (r["text"] or "").split()
            assert i in good or sum(a == b for a, b in zip(words, words[1:])) > 0.3 * n or sum(map(str.isupper, r["text"])) > 0.4 * chars
    groups = brute_groups_of([(i, brute_fingerprint(r["text"])) for i, r in good.items()])
    assert set(unique) == set(groups.values())
    assert set(clean) == set(unique) and all(r["n_chars"] == len(r["text"] or "") for r in clean.values())
    assert not any(re.search(r"[a-z0-9]@[a-z0-9]+\.[a-z]", r["text"] or "") for r in clean.values())
    assert any("[EMAIL]" in (r["text"] or "") for r in clean.values()) or not any("@" in (r["text"] or "") for r in unique.values())
    times = {i: sum(r["doc_id"] == i for r in mixed) for i in clean}
    assert len(mixed) == sum(times.values()) and max(times.values()) <= 2
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for i, r in clean.items()}
    assert sum(times[i] * words[i] for i in clean) == pytest.approx(1.5 * sum(words.values()), rel=0.02)
    assert sum(r["piece"] == 0 for r in packed) == len(mixed)


def test_pipeline_of_an_empty_table_and_nulls(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    for rows in ([], [(None, None, None, None, None), (1, "a b c d e f g h i j k", "en", None, 21), (1, "a b c d e f g h i j k", "en", None, 21)]):
        docs = spark.createDataFrame(rows, schema)
        for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = str(tmp_path / f"{len(rows)}-{name}")
            stage(spark, docs, sf).write.parquet(out)
            docs = spark.read.parquet(out)
            assert at == 4 or docs.columns == schema.names
        assert (docs.count() > 0) == bool(rows)


def test_clashing_names_and_large_ids(spark, sf, tmp_path):
    """Further columns come through under any name, and ids beyond 2^53 stay exact beside nulls."""
    clash = "_times long, row string, key string, copies long, n_words long, failure_bits string, times int, _kept int, component_id long, size int"
    base = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40")
    names = base.columns
    extra = [part.split() for part in clash.split(", ")]
    docs = base.selectExpr("doc_id + 9007199254740993 AS doc_id", *names[1:], *(f"cast(doc_id AS {kind}) AS `{name}`" for name, kind in extra))
    docs = docs.unionByName(docs.limit(1).selectExpr("cast(null AS long) AS doc_id", *docs.columns[1:]))
    docs.write.parquet(str(tmp_path / "in"))
    docs, known = spark.read.parquet(str(tmp_path / "in")), {r["doc_id"] for r in docs.collect()}
    columns = docs.columns
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if at < 4:
            assert docs.columns == columns
            assert all(r["doc_id"] is None or str(r["doc_id"] - 9007199254740993) == r["row"] for r in docs.collect())
    assert {r["doc_id"] for r in docs.collect()} <= known


def test_library_does_not_import_the_subpackage():
    top = os.path.join(os.path.dirname(entry.__file__), "docmerge")
    for folder, _, files in os.walk(top):
        if not folder.startswith(os.path.join(top, "llm")):
            for name in files:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as source:
                        assert "docmerge.llm" not in source.read() and "corpus_pipeline" not in name
