"""Queries over document trees and source extraction."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import trees
from quern.operators import documents as doc
from quern.plans.common import with_graph
from quern.plans.lookups import _DOC, _FIL, _SPE
from quern.session import Scratch
from quern.sources import extract

_REQUIREMENT = {"type": "section", "matches": "^Requirement:", "parent": {"type": "section", "matches": "^Requirements$"}}


def _nodes(s, d):
    return doc.nodes(_SPE(s, d), "spec_id")


def _rules(s, d):
    rows, specs = Scratch(s, "nodes").put(_nodes(s, d)), _SPE(s, d)
    out = None
    for k, rule in enumerate(({"selector": {"type": "section", "level": 1}, "exactly": 1}, {"selector": {"type": "section", "matches": "^Purpose$"}}, {"selector": _REQUIREMENT, "required": False, "unique_by": "label"})):
        part = doc.check_rule(rows, specs, "spec_id", rule).withColumn("rule", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def _preview(s, d):
    specs = _SPE(s, d)
    entries = json.dumps([{"op": "added", "content": "## Changes\n\n- reviewed"}])
    deltas = specs.where("title is not null").select("spec_id", F.lit(entries).alias("delta"))
    return doc.preview(specs, deltas, "spec_id").select(F.col("doc").alias("spec_id"), "status", F.length("merged").alias("chars"))


def _summaries(s, d):
    summary = F.udf(lambda text: trees.summary(text), T.StringType(), useArrow=True)
    return _SPE(s, d).where("content is not null").select("spec_id", summary("content").alias("summary"))


def _resolved(s, d):
    # the facts are used several times over: files are read and parsed once
    found = Scratch(s, "facts").put(extract.analysed(_FIL(s, d)))
    return extract.call_edges(found, extract.import_edges(found, _FIL(s, d)))


def _resolved_bases(s, d):
    found = Scratch(s, "facts").put(extract.analysed(_FIL(s, d)))
    return extract.base_edges(found, extract.import_edges(found, _FIL(s, d)))


QUERIES = {
    "s12_markdown_nodes": lambda s, d: _nodes(s, d).select("doc", "ord", "type", "label", "level", F.array_join(F.transform("path", lambda p: p.cast("string")), ".").alias("path")),
    "s15_plaintext_lines": lambda s, d: doc.nodes(_DOC(s, d), "path", "plaintext").where("type in ('paragraph', 'line')").groupBy("doc").agg(F.sum(F.when(F.col("type") == "paragraph", 1).otherwise(0)).alias("paragraphs"), F.sum(F.when(F.col("type") == "line", 1).otherwise(0)).alias("lines")),
    "d01_requirements": lambda s, d: doc.select(_nodes(s, d), _REQUIREMENT).select("doc", "ord", "label"),
    "d05_requirement_names": lambda s, d: doc.extract(doc.select(_nodes(s, d), _REQUIREMENT), "label", r"^Requirement:\s*(.+)$"),
    "d06_sections_by_label": lambda s, d: doc.grouped(doc.select(_nodes(s, d), {"type": "section"})),
    "d09_rule_failures": _rules,
    "d13_preview": _preview,
    "x12_summaries": _summaries,
    "s08_extracted_symbols": lambda s, d: extract.symbols(extract.analysed(_FIL(s, d))),
    "n01_import_facts": lambda s, d: extract.analysed(_FIL(s, d)).where("fact = 'import'").select("path", "name", "kind", "target", "line"),
    "n04_resolved_calls": _resolved,
    "n04_resolved_bases": _resolved_bases,
    "n06_import_edges": lambda s, d: extract.import_edges(extract.analysed(_FIL(s, d)), _FIL(s, d)),
}

SQL = {
    "s15_plaintext_lines": with_graph(", p AS (SELECT path, unnest(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10) || chr(10))) AS t FROM doc) SELECT path AS doc, count(*) AS paragraphs, CAST(sum(len(string_split(t, chr(10)))) AS BIGINT) AS lines FROM p WHERE trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(65279)) <> '' GROUP BY path"),
}
