import pytest
from pyspark.sql import functions as F

from quern.operators import scopes


def test_nearest_scope_wins_and_ambiguity_gives_nothing(spark):
    tree = spark.createDataFrame([("file", None), ("class", "file"), ("method", "class"), ("loop", "loop")], "id string, parent_id string")
    names = spark.createDataFrame([("file", "x", "outer"), ("class", "x", "inner"), ("file", "y", "one"), ("file", "y", "two"), ("method", "z", "own"), ("loop", "x", "never")], "scope_id string, name string, target string")
    facts = spark.createDataFrame([("method", "x"), ("method", "y"), ("method", "z"), ("file", "x"), ("file", "z"), ("loop", "x"), ("gone", "x"), (None, "x")], "scope_id string, name string")
    assert {tuple(r) for r in scopes.lookup(facts, names, tree).collect()} == {("method", "x", "inner"), ("method", "z", "own"), ("file", "x", "outer")}
    assert {tuple(r) for r in scopes.nearest(scopes.ancestors(tree), spark.createDataFrame([("file",), ("class",)], "ancestor string")).collect()} == {("class", "file"), ("method", "class")}


def test_packages(spark):
    rows = spark.createDataFrame([("@a/b/c",), ("lodash/fp",), ("./x",), ("/x",), (None,)], "s string")
    assert [r[0] for r in rows.select(scopes.package_of(F.col("s"))).collect()] == ["@a/b", "lodash", None, None, None]
    imports = spark.createDataFrame([("w:a.ts", "f", "@a/b"), ("w:a.ts", "g", "@a/b"), ("w:a.ts", "f", "none")], "path string, name string, target string")
    packages = spark.createDataFrame([("@a/b", "lib"), ("@a/b", "old"), ("c", "lib")], "package string, workspace string")
    symbols = spark.createDataFrame([("lib:f.ts:function:f:2:0", "f", "lib:f.ts"), ("lib:f.ts:function:f:1:0", "f", "lib:f.ts"), ("old:g.ts:function:g:1:0", "g", "old:g.ts")], "id string, name string, file_path string")
    found, twice = scopes.package_symbols(imports, packages, symbols)
    assert [tuple(r) for r in found.collect()] == [("w:a.ts", "f", "lib:f.ts:function:f:1:0")]
    assert [r[0] for r in twice.collect()] == ["@a/b"]


def test_fingerprints(spark):
    files = spark.createDataFrame([("w:a", "x", "w"), ("w:b", "y", "w"), ("v:a", "x", "v")], "path string, content string, workspace string")
    now = scopes.fingerprints(files, F.col("content"), F.col("workspace"))
    then = scopes.fingerprints(files.withColumn("content", F.when(F.col("path") == "w:a", "z").otherwise(F.col("content"))), F.col("content"), F.col("workspace"))
    assert [r[0] for r in scopes.mismatched(then, now).collect()] == ["w"]
    assert scopes.mismatched(then.limit(0), now).count() == 0


def test_concatenation_relation_and_edit(spark):
    parts = spark.createDataFrame([("s", "b.md", "2"), ("s", "spec.md", "1"), ("s", "a.md", None)], "spec_id string, filename string, content string")
    assert scopes.concatenated(parts, "spec_id").first()["content"] == "1\n\n2"
    left = spark.createDataFrame([("1", ["a"]), ("2", ["a", "b"]), ("3", ["a"])], "k string, values array<string>")
    right = spark.createDataFrame([("1", ["b", "a"]), ("2", ["b", "a"]), ("4", ["a"])], "k string, values array<string>")
    ask = lambda *a: {tuple(r) for r in scopes.cross_relation(left, right, "k", *a).collect()}
    assert ask("subset") == {("1", "ok"), ("2", "ok"), ("3", "deferred"), ("4", "deferred")}
    assert ask("all-equal", True) == {("1", "broken"), ("2", "broken"), ("3", "deferred"), ("4", "deferred")}
    row = spark.createDataFrame([(["a", "b"],)], "v array<string>")
    assert row.select(scopes.edit_list(F.col("v"), ["a"], ["c", "b"])).first()[0] == ["b", "c"]
    with pytest.raises(Exception, match="not in the list"):
        row.select(scopes.edit_list(F.col("v"), ["x"])).collect()
