import json

import pytest

from quern.functions import stem, trees
from quern.operators import documents as doc
from quern.operators import lists

SPEC = """# Title

Intro *text*.

## Purpose

Because.

## Requirements

### Requirement: One

Body one.

- a
  - b
- c

### Requirement: Two

```ts
# not a heading
```

1. first
2. second
"""


def test_markdown_round_trip():
    tree = trees.parse_markdown(SPEC)
    again = trees.parse_markdown(trees.render(tree))
    assert trees.flatten(again) == trees.flatten(tree)
    labels = [n["label"] for n, _ in trees.find(tree, {"type": "section"})]
    assert labels == ["Title", "Purpose", "Requirements", "Requirement: One", "Requirement: Two"]


@pytest.mark.parametrize(("form", "text"), [("json", '{"a": [1, {"b": null}], "c": "x"}'), ("yaml", "a:\n- 1\n- b: null\nc: x")])
def test_values_round_trip(form, text):
    tree = trees.parse(text, form)
    assert trees.parse(trees.render(tree, form), form) == tree
    assert trees.parse("", form) == {"type": "document", "children": []}


def test_selection_by_rows_and_by_tree_agree(spark):
    docs = spark.createDataFrame([("d", SPEC), ("empty", ""), ("none", None), (None, "# x")], "k string, content string")
    rows = doc.nodes(docs, "k").cache()
    tree = trees.parse_markdown(SPEC)
    for selector in ({"type": "section", "matches": "^requirement:"}, {"type": "section", "level": 2}, {"type": "list-item", "parent": {"type": "section", "matches": "One"}}, {"type": "section", "matches": "Requirement:", "index": 1}, {"type": "paragraph", "contains": "because"}, {"type": "section", "matches": "(a+)+$"}):
        got = [(r["type"], r["label"]) for r in doc.select(rows, selector).orderBy("ord").collect()]
        assert got == [(n["type"], n.get("label")) for n, _ in trees.find(tree, selector)], selector
    assert {r["doc"] for r in rows.collect()} == {"d", "empty"}


def test_rules(spark):
    docs = spark.createDataFrame([("good", SPEC), ("bad", "## Requirement: A\n\n## Requirement: a\n")], "k string, content string")
    rows = doc.nodes(docs, "k")
    ask = lambda rule: {(r["doc"], r["problem"]) for r in doc.check_rule(rows, docs, "k", rule).collect()}
    assert ask({"selector": {"type": "section", "matches": "Purpose"}}) == {("bad", "missing")}
    assert ask({"selector": {"type": "section", "matches": "Requirement:"}, "unique_by": "label"}) == {("bad", "repeated keys")}
    assert ask({"selector": {"type": "section", "matches": "Requirement:"}, "max": 1}) == {("bad", "count not max 1"), ("good", "count not max 1")}


def test_delta():
    tree = trees.parse_markdown("# T\n\n## A\n\none\n\n## B\n\n- x\n")
    out = trees.render(trees.apply_delta(tree, [
        {"op": "modified", "selector": {"type": "section", "matches": "^A$"}, "rename": "AA", "content": "two"},
        {"op": "added", "position": {"after": {"type": "section", "matches": "^AA$"}}, "content": "## C\n\nthree"},
        {"op": "added", "position": {"parent": {"type": "list"}}, "content": "- y\n- z"},
        {"op": "no-op"},
    ]))
    assert out == "# T\n\n## AA\n\ntwo\n\n## C\n\nthree\n\n## B\n\n- x\n- y\n- z"
    with pytest.raises(trees.DeltaError):
        trees.apply_delta(tree, [{"op": "removed", "selector": {"type": "section"}}])
    with pytest.raises(trees.DeltaError):
        trees.apply_delta(tree, [{"op": "removed", "selector": {"type": "section", "matches": "^A$"}}] * 2)


def test_merge_by_key():
    old = trees.parse_yaml("- id: a\n  v: 1\n- id: b\n  v: 2")["children"][0]["children"]
    new = trees.parse_yaml("- id: b\n  v: 3\n- id: c\n  v: 4")["children"][0]["children"]
    merged = {"type": "document", "children": [{"type": "sequence", "children": trees.merge_by(old, new, "id")}]}
    assert trees.parse_yaml(trees.render(merged, "yaml"))["children"][0] == trees.parse_yaml("- id: a\n  v: 1\n- id: b\n  v: 3\n- id: c\n  v: 4")["children"][0]


def test_preview(spark):
    docs = spark.createDataFrame([("a", "# T\n\nx"), ("b", "# T"), ("c", "# T")], "k string, content string")
    deltas = spark.createDataFrame([("a", json.dumps([{"op": "added", "content": "y"}])), ("b", json.dumps([{"op": "removed", "selector": {"type": "list"}}]))], "k string, delta string")
    got = {r["doc"]: r for r in doc.preview(docs, deltas, "k").collect()}
    assert (got["a"]["merged"], got["a"]["status"]) == ("# T\n\nx\n\ny", "merged")
    assert got["b"]["status"] == "error" and got["c"]["status"] == "missing"
    assert "+y" in got["a"]["diff"]


def test_text_helpers():
    assert trees.summary("# T\n\nOne\ntwo\n\n## X") == "One two"
    assert trees.summary("# T\n\n## Purpose\n\nWhy") == "Why"
    assert trees.summary("nothing") is None
    assert trees.shift_headings("# a\n```\n# b\n```\n###### c", 1) == "## a\n```\n# b\n```\n###### c"
    assert trees.json_path({"a": [{"b": 1}, {"b": 2}], "c": {"b": 3}}, "$..b") == [1, 2, 3]
    assert trees.json_path({"a": [{"b": 1}, {"b": 2}]}, "$.a[*].b") == [1, 2] and trees.json_path({"a": [5, 6]}, "$.a[1]") == [6]
    assert trees.resolve_link("w:a/b/spec.md", "../c/x.md#y") == "w:a/c/x.md" and trees.resolve_link("w:a.md", "../../x") is None
    assert [stem.stem(w) for w in ("caresses", "ponies", "relational", "hopping", "agreed", "happy", "probate", "controlling")] == ["caress", "poni", "relat", "hop", "agre", "happi", "probat", "control"]


def test_pages(spark):
    rows = spark.createDataFrame([(f"k{i:02}",) for i in range(10)], "k string")
    from pyspark.sql import functions as F

    all_ = [r[0] for r in rows.orderBy("k").collect()]
    pages = [[r[0] for r in lists.page(rows, [F.col("k")], limit=3, number=n).collect()] for n in range(1, 5)]
    assert sum(pages, []) == all_
    assert [r[0] for r in lists.page(rows, [F.col("k")], limit=3, after=("k04", "k04"), keys=("k", "k")).collect()] == all_[5:8]
    with pytest.raises(ValueError):
        lists.page(rows, [F.col("k")], number=1)
    assert lists.check_limit("all") is None and lists.check_limit(None) == 100
