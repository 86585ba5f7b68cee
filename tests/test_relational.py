import os

import pytest
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import graph, lists, scoring, search, sets
from quern.session import SharedFolder
from quern.sources import store

QUICK = [
    "j08_cover_edges", "j17_division", "g20_hierarchy_dependents", "g22_topological_levels", "a14_change_coverage", "a16_health", "a22_labels", "a23_index_breakdown", "a25_owned_edges", "q21_snippets", "q24_indexed_search", "w09_carried", "w11_chunks", "t06_keyset_meta",
    "t07_active_list", "u03_edge_upsert", "u06_sequences", "u13_merged_links", "u14_tracked_files", "x09_placeholders", "x20_hash_maps", "s12_headings", "s18_json_lines", "s21_upsert_files", "d09_rule_failures", "d14_freshness", "n12_concatenated", "r03_cached_results",
]


@pytest.mark.parametrize("name", QUICK)
def test_sql_agrees(spark, small, name):
    import duckdb

    import __spark_entry__ as e

    db = duckdb.connect()
    for file in os.listdir(small):
        db.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{small}/{file}'")
    got, want = e.queries()[name](spark, small), db.execute(e.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(str(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(str(r) for r in want.fetchall())


def test_shared_folder(spark, tmp_path):
    folder = SharedFolder(spark, str(tmp_path / "f"))
    assert folder.read("CURRENT") is None
    folder.replace("CURRENT", "a")
    folder.replace("CURRENT", "é")
    assert folder.read("CURRENT") == "é" and folder.claim("LOCK") and not folder.claim("LOCK")
    folder.delete("LOCK")
    assert folder.names() == ["CURRENT"] and folder.claim("LOCK")


def test_old_versions_go(spark, tmp_path):
    st = store.Store(spark, str(tmp_path / "s"))
    one = lambda schema: spark.createDataFrame([], schema)
    tables = {"files": one("path string"), "docnodes": one("path string"), "symbols": one("id string"), "specs": one("spec_id string"), "relations": one("source string, target string, type string")}
    versions = [st.bulk_load(tables) for _ in range(3)]
    assert {n for n in st.folder.names() if len(n) == 32} == set(versions[1:]) and st.is_stale(versions[0]) and not st.is_stale(versions[2])


def test_index_gives_what_the_texts_give(spark, tmp_path):
    rows = spark.createDataFrame([("a:one", "Index of sessions", "the queue keeps the queue"), ("b:two", None, "no session here"), ("c:three", "Queue", None), ("d:four", "x", ""), (None, "queue", "queue")], "spec_id string, title string, content string")
    text = F.concat_ws(" ", "spec_id", "title", "content")
    index = search.Index.build(rows, "spec_id", F.col("spec_id"), F.col("title"), text, str(tmp_path / "index"))
    for query in ("queue", "session index", "one", "nothing"):
        want = [(r["spec_id"], r["tier"], r["hits"], round(r["bm25"], 9)) for r in search.ranked(rows.where("spec_id is not null"), F.col("spec_id"), F.col("title"), text, query, None, key="spec_id").collect()]
        assert [(r["spec_id"], r["tier"], r["hits"], round(r["bm25"], 9)) for r in index.search(query, None).collect()] == want


def test_chunks_hold_the_budget(spark):
    rows = spark.createDataFrame([(f"k{i:03}", i * 7 % 50) for i in range(200)] + [("big", 900), ("none", None), (None, 4)], "key string, size int")
    for group in (50_000, 40):
        got = sets.chunks(rows, "key", "size", 100, group).collect()
        assert len(got) == 202
        full = {}
        for r in got:
            full.setdefault((r["part"], r["chunk"]), []).append(r["size"])
        assert all(sum(v) <= 100 or len(v) == 1 for v in full.values())
    assert sets.chunks(rows.limit(0), "key", "size", 100).count() == 0


def test_keyset_meta_knows_what_follows(spark):
    rows = spark.createDataFrame([(c,) for c in "abcde"], "k string")
    ask = lambda limit, after=None: tuple(lists.keyset_meta(rows, ("k", "k"), limit, after).first())
    assert ask(2) == (5, 2, 2, "b", "b") and ask(2, ("b", "b")) == (5, 2, 2, "d", "d") and ask(2, ("d", "d")) == (5, 1, 2, None, None) and ask(5) == (5, 5, 5, None, None)


def test_health_and_totals(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "k string")
    issues = spark.createDataFrame([("a", "failure"), ("a", "warning"), ("b", "warning"), ("z", "failure")], "k string, severity string")
    got = scoring.health(items, issues, "k")
    assert {tuple(r) for r in got.collect()} == {("a", "failed", 1, 1), ("b", "warned", 0, 1), ("c", "passed", 0, 0)}
    assert tuple(scoring.health_totals(got).first()) == (3, 1, 1, 1) and tuple(scoring.health_totals(got.limit(0)).first()) == (0, 0, 0, 0)


def test_files_impact_unites(spark):
    symbols = spark.createDataFrame([("t", "t", "function", "f", 1), ("a", "a", "function", "g", 1), ("b", "b", "function", "h", 1)], "id string, name string, kind string, file_path string, line int")
    edges = spark.createDataFrame([("a", "t", "CALLS"), ("b", "a", "CALLS"), ("g", "f", "IMPORTS")], "source string, target string, type string")
    one = graph.FileImpact(symbols, edges, spark.createDataFrame([("f",), ("g",), ("none",)], "path string"))
    assert {(r["root"], r["direct"], r["total"]) for r in one.summary().collect()} == {("f", 1, 2), ("g", 1, 1), ("none", 0, 0)}
    assert {tuple(r) for r in one.affected().collect()} == {("f", "a", 1), ("f", "b", 2), ("g", "b", 1)}
    affected, paths = graph.files_affected(one)
    assert {tuple(r) for r in affected.collect()} == {("a", 1), ("b", 1)} and {r["path"] for r in paths.collect()} == {"h"}
    assert tuple(graph.files_impact(one.summary()).select("target", "direct", "total").first()) == ("f, g, none", 2, 3)


def test_cover_edges_and_prune(spark):
    symbols = spark.createDataFrame([("1", "n", "f"), ("2", "n", "f"), ("3", "n", "g")], "id string, name string, file_path string")
    links = spark.createDataFrame([("s", "f", ["n", "gone"]), ("s", "g", []), ("u", "g", None)], "spec_id string, file string, symbols array<string>")
    assert {tuple(r) for r in graph.cover_edges(links, symbols).collect()} == {("s", "1", "COVERS_SYMBOL"), ("s", "2", "COVERS_SYMBOL"), ("s", "g", "COVERS_FILE"), ("u", "g", "COVERS_FILE")}
    stored = spark.createDataFrame([("w:a", "w"), ("w:b", "w"), ("v:a", "v")], "k string, ws string")
    assert [r["k"] for r in sets.prune(stored, stored.where("k = 'w:a'"), "k", "ws").collect()] == ["w:b"]


def test_federated_leaves_out_what_fails(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "k string, score double")

    def broken():
        raise OSError("gone")

    assert [r["k"] for r in search.federated([rows, broken, lambda: rows.where("k = 'b'")], 2).collect()] == ["b", "b"]
    with pytest.raises(OSError):
        search.federated([broken], 2)


def test_literals_and_placeholders(spark):
    row = spark.createDataFrame([("100%_a\\b", "x-1")], "s string, t string")
    assert row.where(F.col("s").like("%" + search.like_literal("0%_a\\") + "%")).count() == 1 and row.where(F.col("s").like(search.like_literal("%"))).count() == 0
    out = row.select(tx.placeholders(F.lit("$2:$1$7"), F.col("t"), r"(\w)-(\d)").alias("a"), tx.placeholders(F.lit("$1"), F.col("t"), r"(\d)-(\w)").alias("b"), tx.quoted(F.lit("it's")).alias("c")).first()
    assert tuple(out) == ("1:x", None, "'it'\\''s'")
    assert store.sink(row.select("t"), "json") == '[{"t":"x-1"}]' and store.sink(row.select("t"), "text") == "t\nx-1"
