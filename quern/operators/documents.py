"""Document trees as rows: parsing, selection, extraction, rules, deltas.

Parsing gives one row a node with its path of child numbers; pre-order is the order of paths, a parent the path without
its last number, an ancestor any prefix. Selection, extraction and rules are joins and aggregates on such rows.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions import trees

NODE = "path array<int>, parent_path array<int>, above array<string>, type string, label string, value string, value_type string, level int, ordered boolean, ord int, error string"


def _parse(form: str):
    names = [c.split()[0] for c in NODE.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["doc"], pdf["content"], strict=True):
                try:
                    rows += [(key, *node, None) for node in trees.flatten(trees.parse(text, form))]
                except Exception as error:  # one bad document is a row, not a failed job
                    rows.append((key, *[None] * 9, 0, str(error)[:200]))
            yield pd.DataFrame(rows, columns=["doc", *names])

    return run


def nodes(documents: DataFrame, key: str, form: str = "markdown", content: str = "content") -> DataFrame:
    """Rows of all nodes: doc and the columns of ``NODE``. Null keys and contents are left out; a text that does not parse gives one row with ``error``."""
    src = documents.where(F.col(key).isNotNull() & F.col(content).isNotNull()).select(F.col(key).alias("doc"), F.col(content).alias("content"))
    return src.mapInPandas(_parse(form), f"doc {src.schema['doc'].dataType.simpleString()}, {NODE}")


def _text(rows: DataFrame) -> DataFrame:
    """Adds ``text``: a node's value, or those of its children, line by line."""
    kids = rows.where("value is not null").groupBy("doc", F.col("parent_path").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]), "\n").alias("_kids"))
    return rows.join(kids, ["doc", "path"], "left").withColumn("text", F.coalesce("value", "_kids", F.lit(""))).drop("_kids")


def _holds(selector: dict) -> Column:
    out = F.col("type") == selector["type"]
    if "matches" in selector:
        out = out & tx.matches(F.coalesce("label", F.lit("")), "(?i)" + selector["matches"])
    if "contains" in selector:
        out = out & tx.matches(F.col("text"), "(?i)" + selector["contains"])
    if "level" in selector:
        out = out & (F.col("level") == selector["level"])
    return F.coalesce(out, F.lit(False))


def select(rows: DataFrame, selector: dict, direct: bool = False) -> DataFrame:
    """Nodes for a selector (type, matches, contains, level, where, parent, index).

    A parent condition is put to the nearest ancestor of its type or, if ``direct``, to the parent itself.
    """
    src = _text(rows) if "contains" in json.dumps(selector) else rows.withColumn("text", F.lit(""))
    out = src.where(_holds(selector))
    for field, pattern in selector.get("where", {}).items():
        has = rows.where((F.col("label") == field) & tx.matches(F.coalesce("value", F.lit("")), "(?i)" + pattern)).select("doc", F.explode(F.array("parent_path", F.slice("parent_path", F.lit(1), F.greatest(F.size("parent_path") - 1, F.lit(0))))).alias("path")).distinct()
        out = out.join(has, ["doc", "path"], "left_semi")
    if "parent" in selector:
        up = selector["parent"]
        good = src.where(_holds(up)).select("doc", F.col("path").alias("_near"))
        near = F.col("parent_path") if direct else F.slice("path", F.lit(1), F.array_position(F.reverse("above"), up["type"]).cast("int") * -1 + F.size("above"))
        some = F.lit(True) if direct else F.array_contains("above", up["type"])
        out = out.where(some).withColumn("_near", near).join(good, ["doc", "_near"], "left_semi").drop("_near")
    if "index" in selector:
        out = out.withColumn("_n", F.row_number().over(W.partitionBy("doc").orderBy("ord"))).where(F.col("_n") == selector["index"] + 1).drop("_n")
    return out.drop("text")


def extract(found: DataFrame, source: str = "content", capture: str | None = None, strip: str | None = None) -> DataFrame:
    """(doc, ord, part, text): label or text of selected nodes, all captures of a pattern if given."""
    rows = _text(found) if source == "content" else found.withColumn("text", F.coalesce("label", F.lit("")))
    parts = tx.all_captures(F.col("text"), capture, strip) if capture else F.array(F.regexp_replace("text", strip, "") if strip else F.col("text"))
    return rows.select("doc", "ord", F.posexplode(parts).alias("part", "text"))


def grouped(found: DataFrame) -> DataFrame:
    """(doc, label, first, count) of selected nodes by label, in the order first seen."""
    return found.groupBy("doc", "label").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("count"))


def check_rule(rows: DataFrame, documents: DataFrame, key: str, rule: dict) -> DataFrame:
    """Failures (doc, severity, problem) of one rule: selector, required, exactly, min, max, unique_by ('label'), content_matches."""
    found = select(rows, rule["selector"])
    n = documents.select(F.col(key).alias("doc")).distinct().join(found.groupBy("doc").agg(F.count(F.lit(1)).alias("n")), "doc", "left").fillna(0, ["n"])
    bad = [n.where("n = 0").select("doc", F.lit("failure" if rule.get("required", True) else "warning").alias("severity"), F.lit("missing").alias("problem"))]
    for name, wrong in (("exactly", lambda v: F.col("n") != v), ("min", lambda v: F.col("n") < v), ("max", lambda v: F.col("n") > v)):
        if name in rule:
            bad.append(n.where((F.col("n") > 0) & wrong(rule[name])).select("doc", F.lit("failure").alias("severity"), F.lit(f"count not {name} {rule[name]}").alias("problem")))
    if "unique_by" in rule:
        twice = found.groupBy("doc", F.lower(F.trim(F.coalesce(rule["unique_by"], F.lit("")))).alias("k")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc").distinct()
        bad.append(twice.select("doc", F.lit("failure").alias("severity"), F.lit("repeated keys").alias("problem")))
    if "content_matches" in rule:
        wrong = _text(found).where(~tx.matches(F.col("text"), rule["content_matches"])).select("doc").distinct()
        bad.append(wrong.select("doc", F.lit("failure").alias("severity"), F.lit("content does not match").alias("problem")))
    out = bad[0]
    for more in bad[1:]:
        out = out.unionByName(more)
    return out


def _apply(form: str):
    def run(batches):
        for pdf in batches:
            rows = []
            for key, content, delta in zip(pdf["doc"], pdf["content"], pdf["delta"], strict=True):
                try:
                    merged = content if delta is None else trees.render(trees.apply_delta(trees.parse(content or "", form), json.loads(delta), form), form)
                    status = "missing" if delta is None else "no-op" if all(e["op"] == "no-op" for e in json.loads(delta)) else "merged"
                    rows.append((key, merged, status, trees.unified_diff(content or "", merged or "", str(key)), None))
                except Exception as error:
                    rows.append((key, None, "error", None, str(error)[:200]))
            yield pd.DataFrame(rows, columns=["doc", "merged", "status", "diff", "error"])

    return run


def preview(documents: DataFrame, deltas: DataFrame, key: str, form: str = "markdown") -> DataFrame:
    """Each document after its delta (JSON list of entries): doc, merged, status (merged, no-op, missing, error), diff, error."""
    src = documents.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), "content").join(deltas.select(F.col(key).alias("doc"), "delta"), "doc", "left")
    return src.mapInPandas(_apply(form), f"doc {src.schema['doc'].dataType.simpleString()}, merged string, status string, diff string, error string")


def fresh(stored: DataFrame, current: DataFrame, key: str = "doc") -> DataFrame:
    """(key, fresh): whether every stored file hash (map ``hashes``) equals the current one (file, hash); an empty map is not fresh."""
    each = stored.select(key, F.explode_outer("hashes").alias("file", "stored")).join(current.select("file", F.col("hash").alias("now")), "file", "left")
    return each.groupBy(key).agg(F.every(F.coalesce(F.col("stored") == F.col("now"), F.lit(False))).alias("fresh"))
