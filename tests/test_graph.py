import pytest
from pyspark.sql import functions as F

from quern.operators import graph, scoring, search, sets

SYMBOL = "id string, name string, kind string, file_path string, line int, column_number int, parent_id string, comment string"


def symbols(spark, *rows):
    return spark.createDataFrame([(i, n, k, f, ln, 0, None, None) for i, n, k, f, ln in rows], SYMBOL)


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), "source string, target string, type string")


@pytest.fixture
def hot(spark):
    s = symbols(spark, ("t", "target", "function", "ws-a:target.ts", 1), ("sa", "sameA", "function", "ws-a:callers.ts", 1), ("sb", "sameB", "function", "ws-a:callers.ts", 2), ("x", "cross", "function", "ws-b:cross.ts", 1))
    e = edges(spark, ("sa", "t", "CALLS"), ("sb", "t", "CALLS"), ("x", "t", "CALLS"), *[(f"ws-a:importer-{c}.ts", "ws-a:target.ts", "IMPORTS") for c in "abc"])
    return s, e


def test_hotspot_score(hot):
    row = scoring.hotspots(*hot, min_risk="LOW").first()
    assert (row["id"], row["score"], row["same_ws"], row["cross_ws"], row["importers"]) == ("t", 11, 2, 1, 3)


def test_importer_only_symbols_are_shown_on_request(spark, hot):
    s, e = hot
    lone = symbols(spark, ("l", "lone", "class", "ws-a:lone.ts", 1))
    e = e.unionByName(edges(spark, ("ws-a:x.ts", "ws-a:lone.ts", "IMPORTS")))
    assert scoring.scored(s.unionByName(lone), e).where("id = 'l'").count() == 0
    assert scoring.scored(s.unionByName(lone), e, importer_only=True).where("id = 'l'").first()["score"] == 1


@pytest.mark.parametrize(("d", "t", "p", "level"), [(0, 0, 0, "LOW"), (1, 1, 0, "LOW"), (2, 2, 0, "LOW"), (3, 3, 0, "MEDIUM"), (5, 5, 0, "MEDIUM"), (1, 3, 0, "MEDIUM"), (6, 6, 0, "HIGH"), (2, 10, 0, "HIGH"), (1, 20, 0, "CRITICAL"), (1, 1, 3, "CRITICAL"), (-1, -5, -2, "LOW")])
def test_risk_levels(spark, d, t, p, level):
    assert spark.range(1).select(scoring.risk_level(d, t, p)).first()[0] == level


def test_chain_cycle_and_depth(spark):
    s = symbols(spark, *[(c, c, "function", f"w:{c}.ts", 1) for c in "abcd"])
    e = edges(spark, ("b", "a", "CALLS"), ("c", "b", "CALLS"), ("a", "c", "USES_TYPE"), ("ghost", "a", "CALLS"), ("a", "a", "CALLS"))
    seeds = spark.createDataFrame([("a", "a")], "root string, id string")
    got = {(r["id"], r["depth"]) for r in graph.reach(s, e, seeds, True, 3, False).collect()}
    assert got == {("b", 1), ("c", 2)}
    one = graph.reach(s, e, seeds, True, 1, False)
    assert {(r["id"], r["depth"]) for r in one.collect()} == {("b", 1)}
    assert graph.truncated(graph.symbol_edges(s, e, True), one, seeds, 1).first()["truncated"]
    # upstream is downstream of the reversed graph
    back = e.select(F.col("target").alias("source"), F.col("source").alias("target"), "type")
    assert {(r["id"], r["depth"]) for r in graph.reach(s, back, seeds, False, 3, False).collect()} == got


def test_walk_through_files_matches_the_plain_definition(spark):
    s = symbols(spark, ("a", "a", "function", "w:a.ts", 1), ("b1", "b", "function", "w:b.ts", 1), ("b2", "b", "function", "w:b.ts", 2), ("c", "c", "function", "w:c.ts", 1))
    e = edges(spark, ("w:b.ts", "w:a.ts", "IMPORTS"), ("w:b.ts", "b2", "EXPORTS"), ("c", "b1", "CALLS"), ("w:a.ts", "a", "EXPORTS"))
    seeds = spark.createDataFrame([("a", "a"), ("c", "c")], "root string, id string")
    for up in (True, False):
        fast = {tuple(r) for r in graph.reach(s, e, seeds, up, 3, True).select("root", "id", "depth").collect()}
        plain = {tuple(r) for r in graph.walk(graph.symbol_edges(s, e, up, include_files=True), seeds, 3).select("root", "id", "depth").collect()}
        assert fast == plain
    assert ("a", "b1", 1) in {tuple(r) for r in graph.reach(s, e, seeds, True, 3, True).select("root", "id", "depth").collect()}


@pytest.mark.parametrize(("n", "level"), [(0, "LOW"), (4, "MEDIUM"), (8, "HIGH"), (25, "CRITICAL")])
def test_impact_of_n_callers(spark, n, level):
    s = symbols(spark, ("t", "t", "function", "w:t.ts", 1), *[(f"c{i}", "c", "function", f"w:c{i}.ts", 1) for i in range(n)])
    e = edges(spark, ("q", "q", "CALLS"), *[(f"c{i}", "t", "CALLS") for i in range(n)])
    summary, affected, paths = graph.impact(s, e, spark.createDataFrame([("t",)], "id string"))
    row = summary.first()
    assert (row["direct"], row["total"], row["risk"]) == (n, n, level)
    assert affected.count() == n and paths.count() == n


def test_impact_takes_the_larger_count_and_expands_imported_files(spark):
    s = symbols(spark, ("t", "t", "function", "w:t.ts", 1), ("u", "u", "function", "w:u.ts", 1), ("v", "v", "function", "w:u.ts", 2), ("w", "w", "function", "w:w.ts", 1))
    e = edges(spark, ("u", "t", "CALLS"), ("v", "u", "CALLS"), ("w:u.ts", "w:t.ts", "IMPORTS"), ("w:w.ts", "w:t.ts", "IMPORTS"), ("w:w.ts", "w", "EXPORTS"))
    summary, affected, _ = graph.impact(s, e, spark.createDataFrame([("t",)], "id string"))
    assert (summary.first()["direct"], summary.first()["indirect"]) == (2, 1)
    assert {(r["id"], r["depth"]) for r in affected.collect()} == {("u", 1), ("v", 1), ("w", 1)}


def test_spec_impact(spark):
    specs = spark.createDataFrame([("core:change",), ("core:get-status",)], "spec_id string")
    s = symbols(spark, ("f", "transition", "function", "core:change.ts", 1))
    e = edges(spark, ("core:get-status", "core:change", "DEPENDS_ON"), ("core:change", "core:change.ts", "COVERS_FILE"), ("core:get-status", "core:status.ts", "COVERS_FILE"), ("core:change", "f", "COVERS_SYMBOL"))
    reached, paths, marked = graph.spec_impact(specs, s, e, spark.createDataFrame([("core:change",)], "spec_id string"))
    assert [r["spec_id"] for r in reached.collect()] == ["core:get-status"]
    assert {r["path"] for r in paths.collect()} == {"core:change.ts", "core:status.ts"}
    assert [r["symbol_id"] for r in marked.collect()] == ["f"]


def test_topological_levels(spark):
    nodes = spark.createDataFrame([(c,) for c in "abc"], "id string")
    order = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "a string, b string")
    assert {(r["id"], r["level"]) for r in graph.topological_levels(nodes, order).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    with pytest.raises(ValueError, match="cycle"):
        graph.topological_levels(nodes, order.unionByName(spark.createDataFrame([("c", "a")], order.schema)))


def test_search_order(spark):
    s = symbols(spark, *[(f"core:src/repository.ts:function:{n}:{k}:0", n, "function", "core:src/repository.ts", k) for k, n in enumerate(["change", "changeLog", "prechange", "exchangeRate"], 1)])
    assert [r["name"] for r in search.symbols(s, "change").collect()] == ["change", "changeLog", "prechange", "exchangeRate"]
    specs = spark.createDataFrame([("core:scorekeeper", None, None, None), ("core:change", None, None, None)], "spec_id string, title string, description string, content string")
    assert [r["spec_id"] for r in search.specs(specs, "core").collect()][0] == "core:change"
    assert search.specs(specs, "   ").count() == 0
    assert search.specs(specs, 'core AND "-:').count() == 2


def test_occurrences_overlap(spark):
    rows = spark.createDataFrame([("a", "aaa\nxAA"), ("b", None), ("c", "")], "k string, t string")
    assert sorted((r["position"], r["line"]) for r in search.occurrences(rows, "k", "t", "aa").collect()) == [(0, 1), (1, 1), (5, 2)]


def test_set_relations(spark):
    row = lambda a, b: spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    ask = lambda f, a, b: row(a, b).select(f(F.col("a"), F.col("b"))).first()[0]
    assert ask(sets.subsequence, ["a", "c"], ["a", "b", "c"]) and not ask(sets.subsequence, ["c", "a"], ["a", "b", "c"])
    assert ask(sets.same_set, ["a", "b", "a"], ["b", "a"]) and not ask(sets.same_sequence, ["a", "b"], ["b", "a"])
    assert ask(sets.subset, [], ["a"]) and ask(sets.difference, ["b", "a", "b"], ["a"]) == ["b"]


def test_relational_division_ignores_empty_owners(spark):
    have = spark.createDataFrame([("c1", "m"), ("c1", "n"), ("c2", "m"), ("c2", "m")], "k string, m string")
    need = spark.createDataFrame([("i", "m"), ("i", "n"), ("j", "m")], "o string, m string")
    assert {tuple(r) for r in sets.divides(have, need, "k", "o", "m").collect()} == {("c1", "i"), ("c1", "j"), ("c2", "j")}


def test_sweep(spark):
    t = spark.createDataFrame([("a", "open"), ("b", "resolved"), ("c", "removed"), ("d", "ignored")], "file string, status string")
    p = spark.createDataFrame([("b",), ("c",), ("e",)], "file string")
    assert {tuple(r) for r in sets.sweep_tracked(t, p).collect()} == {("a", "removed"), ("b", "resolved"), ("c", "open"), ("d", "ignored"), ("e", "open")}


def test_empty_tables(spark):
    s, e = symbols(spark), edges(spark)
    assert scoring.hotspots(s, e).count() == 0
    assert scoring.edge_counts(e).where("edges = 0").count() == 12
    assert graph.reach(s, e, spark.createDataFrame([], "root string, id string"), True).count() == 0
    assert search.symbols(s, "x").count() == 0


def test_closure_has_no_depth_of_its_own(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(70)] + [("n70", "n68")], "a string, b string")
    got = graph.dependency_closure(chain, spark.createDataFrame([("n0", "n0")], "root string, id string"))
    assert {(r["id"], r["depth"]) for r in got.collect()} == {(f"n{i}", i) for i in range(1, 71)}


def test_registered_closure_is_whole(spark, tmp_path):
    import __spark_entry__ as e

    spec = "spec_id string, path string, title string, description string, content_hash string, content string, depends_on array<string>, workspace string"
    spark.createDataFrame([(f"w:s{i}", *[None] * 7) for i in range(10)], spec).write.parquet(str(tmp_path / "specs.parquet"))
    edges(spark, *[(f"w:s{i}", f"w:s{i + 1}", "DEPENDS_ON") for i in range(9)]).write.parquet(str(tmp_path / "relations.parquet"))
    got = e.queries()["g21_dependency_closure"](spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {(f"w:s{i}", f"w:s{j}", j - i) for i in range(10) for j in range(i + 1, 10)}
