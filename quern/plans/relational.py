"""Sets, lists, merges, stores and scalar functions over the graph tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import text as tx
from quern.operators import documents as doc
from quern.operators import events as ev
from quern.operators import graph as g
from quern.operators import lists, scopes, scoring, search, sets
from quern.plans import graph as gp
from quern.plans.common import GRAPH, HUB, HUB_FILE, with_graph
from quern.plans.lookups import _DOC, _FIL, _REL, _SPE, _SYM
from quern.session import Scratch
from quern.sources.store import Store, publish_lines, read_lines
from quern.streaming import incremental
from quern.tables import graph, load

_PLAIN = lambda c: F.coalesce(c, F.array().cast("array<string>"))


def _links(s, d):
    """Implementation links of the specs, from their coverage edges: (spec_id, file, symbols)."""
    rel = _REL(s, d)
    marked = rel.where("type = 'COVERS_SYMBOL'").join(_SYM(s, d).select(F.col("id").alias("target"), "name", "file_path"), "target")
    named = marked.groupBy(F.col("source").alias("spec_id"), F.col("file_path").alias("file")).agg(F.collect_set("name").alias("symbols"))
    whole = rel.where("type = 'COVERS_FILE'").select(F.col("source").alias("spec_id"), F.col("target").alias("file"), F.array().cast("array<string>").alias("symbols"))
    return named.unionByName(whole)


def _overrides(s, d):
    return sets.overrides(_SYM(s, d), _REL(s, d)).withColumn("type", F.lit("OVERRIDES"))


def _overriders(s, d):
    edges = Scratch(s, "overrides").put(_overrides(s, d))
    some = edges.agg(F.min("target")).first()[0] or ""
    return g.neighbours(edges, ["OVERRIDES"], some, True).select("source", "target")


def _files_impact(s, d):
    out = g.files_impact(g.file_impact(_SYM(s, d), _REL(s, d), s.createDataFrame([(HUB_FILE,), (gp._FILE,)], "path string")))
    return out.select("target", *[F.col(c).cast("long").alias(c) for c in ("direct", "indirect", "transitive", "total")], "risk")


def _change_summary(s, d):
    per, affected = g.detect_changes(_SYM(s, d), _REL(s, d), s.createDataFrame([(HUB_FILE,), (gp._FILE,)], "path string"))
    return g.change_summary(per, affected, 2)


def _core_files(s, d):
    return _FIL(s, d).where(F.col("path").startswith("platform-core:")).select("path")


def _acyclic(s, d):
    """Dependencies between known specs that point to a smaller id: a graph without cycles."""
    known = _SPE(s, d).select(F.col("spec_id").alias("k"))
    edges = _REL(s, d).where("type = 'DEPENDS_ON' and source > target").select(F.col("target").alias("a"), F.col("source").alias("b"))
    return edges.join(known.withColumnRenamed("k", "a"), "a", "left_semi").join(known.withColumnRenamed("k", "b"), "b", "left_semi").select("a", "b")


def _levels(s, d):
    return g.topological_levels(_SPE(s, d).select(F.col("spec_id").alias("id")), _acyclic(s, d))


def _descendants(s, d):
    edges = Scratch(s, "acyclic").put(_acyclic(s, d))
    return g.descendants_in_order(_SPE(s, d).select(F.col("spec_id").alias("id")), edges, edges.agg(F.min("a").alias("id")))


def _affected(s, d):
    return g.Impact(_SYM(s, d), _REL(s, d), s.createDataFrame([(HUB,)], "id string"))


def _issues(s, d):
    spe = _SPE(s, d)
    one = lambda when, severity: spe.where(when).select("spec_id", F.lit(severity).alias("severity"))
    return one("title is null", "failure").unionByName(one("description is null", "warning"))


def _health(s, d):
    return scoring.health(_SPE(s, d), _issues(s, d), "spec_id")


def _changed_files(s, d):
    fil = _FIL(s, d)
    return sets.file_diff(fil.where("content_hash is not null"), fil.where("content is not null").select("path", tx.content_hash(F.col("content")).alias("content_hash")))


def _indexed(s, d):
    text = F.concat_ws(" ", "spec_id", "title", "description", "content")
    index = search.Index.build(_SPE(s, d), "spec_id", F.col("spec_id"), F.col("title"), text, Scratch(s, "index").root)
    return index.search("index-session queue", None).select("spec_id", "tier", "hits", "strength", F.round("bm25", 6).alias("bm25"))


def _federated(s, d):
    spe = _SPE(s, d)

    def broken():
        raise OSError("a workspace that cannot be read")

    one = lambda w: search.substring_search(spe.where(F.col("workspace") == w), "spec_id", "content", "the reviewer").select("spec_id", "score", F.lit(w).alias("workspace"))
    return search.federated([one("platform-core"), broken, one("temporary-edge"), one("archived-policy")], 1_000).select("spec_id", "workspace", F.round("score", 6).alias("score"))


def _merged(s, d):
    spe = _SPE(s, d)
    text = spe.where(F.contains("content", F.lit("the reviewer"))).select("spec_id", F.length("content").alias("score"), F.substring("content", 1, 20).alias("snippet"))
    identity = spe.where(F.contains("spec_id", F.lit("index"))).select("spec_id", F.length("spec_id").alias("score"), F.lit(None).cast("string").alias("snippet"))
    return search.merged([text, identity], "spec_id")


def _listed_linked(s, d):
    listed = _SPE(s, d).select("spec_id", F.array_distinct(_PLAIN("depends_on")).alias("listed"))
    linked = _REL(s, d).where("type = 'DEPENDS_ON'").groupBy(F.col("source").alias("spec_id")).agg(F.sort_array(F.collect_set("target")).alias("linked"))
    return listed.join(linked, "spec_id", "left").withColumn("linked", _PLAIN("linked"))


def _sequences(s, d):
    a, b = F.col("listed"), F.col("linked")
    return _listed_linked(s, d).select("spec_id", sets.same_sequence(a, b).alias("same"), sets.subsequence(a, b).alias("in_order"), F.array_join(sets.difference(b, a), ",").alias("only_linked"), sets.same_sequence(F.sort_array(a), F.sort_array(b)).alias("same_sorted"))


def _merged_links(s, d):
    links = _links(s, d).withColumns({"change": F.substring_index("spec_id", ":", 1), "explicit": F.size("symbols") > 0, "spec_id": F.substring_index("spec_id", "/", 1)})
    return sets.merge_links(links).select("change", "spec_id", "file", F.array_join("symbols", ",").alias("symbols"), "explicit")


def _sweep(s, d):
    fil = _FIL(s, d)
    status = F.when(F.col("language").isNull(), "ignored").when(F.lower("language") == "go", "removed").otherwise("open")
    present = fil.where("content is not null").select(F.col("path").alias("file")).unionByName(_DOC(s, d).select(F.col("path").alias("file")))
    return sets.sweep_tracked(fil.select(F.col("path").alias("file"), status.alias("status")), present)


def _edge_upsert(s, d):
    raw = load(s, d, "relations").where("source is not null and target is not null and type is not null")
    line = F.col("metadata")["line"].alias("line")
    old = raw.select("source", "target", "type", F.lit(None).cast("string").alias("line")).dropDuplicates(["source", "target", "type"])
    new = raw.where("observed_at is not null").select("source", "target", "type", line, "observed_at")
    return sets.upsert_edges(old, new, "observed_at")


def _store(s, d):
    t = graph(s, d)
    store = Store(s, Scratch(s, "store").root)
    store.bulk_load(t)
    return store


def _store_relations(s, d):
    return _store(s, d).table("relations").groupBy("type").agg(F.count(F.lit(1)).alias("edges"))


def _store_upsert(s, d):
    store = _store(s, d)
    core = store.table("files").where(F.col("path").startswith("platform-core:"))
    symbols = store.table("symbols").where(F.col("file_path").startswith("platform-core:") & (F.col("kind") == "class"))
    edges = store.table("relations").where("type = 'DEFINES'").join(symbols.select(F.col("id").alias("target")), "target", "left_semi")
    store.upsert_files(core.withColumn("content_hash", F.lit("new")), symbols, edges)
    hashes = store.table("files").select(F.when(F.col("content_hash") == "new", "new").otherwise("old").alias("what")).groupBy("what").agg(F.count(F.lit(1)).alias("n"))
    return hashes.unionByName(store.table("symbols").agg(F.count(F.lit(1)).alias("n")).select(F.lit("symbols").alias("what"), "n")).unionByName(store.table("relations").groupBy(F.col("type").alias("what")).agg(F.count(F.lit(1)).alias("n")))


def _store_removed(s, d):
    store = _store(s, d)
    store.remove_files(store.table("files").where(F.col("path").startswith("platform-core:")).select("path"))
    return store.table("relations").groupBy("type").agg(F.count(F.lit(1)).alias("edges")).unionByName(store.table("symbols").agg(F.count(F.lit(1)).alias("edges")).select(F.lit("symbols").alias("type"), "edges"))


def _store_specs(s, d):
    store = _store(s, d)
    store.upsert("specs", store.table("specs").where("title is null").withColumn("title", F.lit("Untitled")))
    store.upsert("docnodes", store.table("docnodes").where("content is null").withColumn("content", F.lit("")))
    store.remove("specs", store.table("specs").where("workspace = 'platform-core'").select("spec_id"))
    return store.table("specs").select("spec_id", "title").unionByName(store.table("docnodes").select(F.col("path").alias("spec_id"), F.length("content").cast("string").alias("title")))


def _store_added(s, d):
    store = _store(s, d)
    store.add_relations(_overrides(s, d))
    return store.table("relations").where("type in ('OVERRIDES', 'EXTENDS')").select("source", "target", "type")


def _store_cleared(s, d):
    store = _store(s, d)
    before = store.generation
    store.clear()
    counts = store.statistics()
    return counts.withColumn("stale", F.lit(store.is_stale(before)))


def _json_lines(s, d):
    root = Scratch(s, "lines").root
    lines = publish_lines(_SPE(s, d).select("spec_id", "title"), root)
    s.createDataFrame([("{not json",), ('{"spec_id": 1',)], "value string").write.mode("append").text(lines)
    return read_lines(s, f"{lines}/*", "spec_id string, title string").select("spec_id", "title")


def _carried(s, d):
    items = _SYM(s, d).select("id", "file_path", F.struct("line", "column_number", "id").alias("at"), F.when(F.col("kind").isin("class", "interface"), F.col("name")).alias("section"), "kind")
    return ev.carry_forward(items, "file_path", "at", "section", F.col("kind") == "method").select("id", "section")


def _cached(s, d):
    fil = _FIL(s, d)
    current = fil.select(F.col("path").alias("key"), F.coalesce("content_hash", F.lit("")).alias("stamp"), F.coalesce(F.md5(F.col("content").cast("binary")), F.lit("")).alias("fingerprint"))
    cache = load(s, d, "files").where("path is not null").groupBy(F.col("path").alias("key")).agg(F.max("content_hash").alias("stamp"), F.max(F.md5(F.col("content").cast("binary"))).alias("fingerprint"), F.max("language").alias("result")).withColumn("version", F.when(F.lower("result") == "go", "1").otherwise("2"))
    return incremental.cached_results(current, cache, "2")


def _freshness(s, d):
    fil = _FIL(s, d)
    covers = _REL(s, d).where("type = 'COVERS_FILE'").select(F.col("source").alias("doc"), F.col("target").alias("file"))
    stored = covers.join(fil.select(F.col("path").alias("file"), F.coalesce("content_hash", F.lit("")).alias("h")), "file").groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("file", "h"))).alias("hashes"))
    return doc.fresh(stored, fil.where("content is not null").select(F.col("path").alias("file"), tx.content_hash(F.col("content")).alias("hash")))


def _hash_maps(s, d):
    covers = _REL(s, d).where("type = 'COVERS_FILE'").select(F.col("source").alias("spec_id"), F.col("target").alias("path"))
    pairs = covers.join(_FIL(s, d).select("path", F.coalesce("content_hash", F.lit("")).alias("h")), "path").groupBy("spec_id").agg(F.array_sort(F.collect_list(F.struct("path", "h"))).alias("p"))
    return pairs.select("spec_id", tx.file_hashes(F.col("p.path"), F.col("p.h")).alias("m")).select("spec_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("hashes"))


def _packages(s, d):
    """Imports by package, and which workspace a package belongs to, taken from who imports it."""
    rel = load(s, d, "relations").where("metadata['specifier'] is not null and source is not null")
    # the tables' specifiers are all relative: what they name stands for a package here
    imports = rel.select(F.col("source").alias("path"), F.regexp_replace(F.col("metadata")["specifier"], r"^[./]+", "").alias("target"), F.lit("toString").alias("name")).distinct()
    packages = imports.select(scopes.package_of(F.col("target")).alias("package"), F.substring_index("path", ":", 1).alias("workspace")).where("package is not null").distinct()
    return scopes.package_symbols(imports, packages, _SYM(s, d).where("name is not null"))


def _concatenated(s, d):
    parts = _DOC(s, d).select(F.regexp_replace("path", r"[^/]*$", "").alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), "content")
    return scopes.concatenated(parts, "folder").select("folder", "content_hash")


def _active(s, d):
    rows = load(s, d, "events").groupBy(F.col("user_id").alias("name")).agg(F.min("ts").alias("created_at"), F.max("ts").alias("at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return rows.withColumn("state", F.when(F.col("last") == "error", "drafted").when(F.col("last") == "click", "discarded").otherwise("open"))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _there_and_back(vectors: pd.Series) -> pd.Series:
    """Vectors as the bytes of 32-bit floats, and read again."""
    return vectors.map(lambda v: np.frombuffer(np.asarray(v, dtype="<f4").tobytes(), dtype="<f4"))


def _vectors(s, d):
    src = load(s, d, "files").where("embedding is not null and size(embedding) > 0 and path is not null").select("path", "embedding").distinct()
    return src.select("path", _there_and_back("embedding").alias("v")).select("path", F.size("v").alias("n"), F.col("v")[0].cast("double").alias("first")).where(~F.isnan("first")).distinct()


def _headings(s, d):
    return doc.select(doc.nodes(_SPE(s, d), "spec_id"), {"type": "section"})


def _requirements(s, d):
    from quern.plans.documents import _REQUIREMENT

    return doc.select(doc.nodes(_SPE(s, d), "spec_id"), _REQUIREMENT)


QUERIES = {
    "j08_cover_edges": lambda s, d: g.cover_edges(_links(s, d), _SYM(s, d)),
    "j17_division": lambda s, d: sets.divides(_REL(s, d).where("type = 'COVERS_FILE'").select(F.col("source").alias("spec_id"), "target"), _REL(s, d).where("type = 'COVERS_FILE'").select(F.col("source").alias("within"), "target"), "spec_id", "within", "target"),
    "g06_overriders": _overriders,
    "g17_files_impact": _files_impact,
    "g19_change_summary": _change_summary,
    "g20_hierarchy_dependents": lambda s, d: g.hierarchy_dependents(_SYM(s, d), _REL(s, d), _core_files(s, d)),
    "g22_topological_levels": _levels,
    "g23_descendants": _descendants,
    "a11_total_symbols": lambda s, d: scoring.with_total(scoring.hotspots(_SYM(s, d), _REL(s, d)).select("id"), _SYM(s, d)),
    "a14_change_coverage": lambda s, d: scoring.change_coverage(_SPE(s, d).where("depends_on is not null").select(F.col("spec_id").alias("change"), F.col("depends_on").alias("spec_ids")), _SPE(s, d), _REL(s, d)),
    "a16_health": _health,
    "a17_totals": lambda s, d: scoring.health_totals(_health(s, d)),
    "a19_artifact_status": lambda s, d: scoring.artifact_status(_SPE(s, d).select(F.col("workspace").alias("artifact"), F.when(F.col("title").isNull(), "missing").when(F.col("description").isNull(), "in-progress").otherwise("complete").alias("state"))),
    "a22_labels": lambda s, d: doc.grouped(_headings(s, d)).select("doc", "label", F.col("count").alias("n")),
    "a23_index_breakdown": lambda s, d: sets.index_breakdown(_changed_files(s, d), F.substring_index("path", ":", 1)),
    "a24_candidates": _merged,
    "a25_owned_edges": lambda s, d: sets.owner_of_edges(_REL(s, d), _SYM(s, d)),
    "q15_ranked": lambda s, d: search.specs(_SPE(s, d), "index-session queue", 10).select("spec_id"),
    "q17_literal_like": lambda s, d: _SYM(s, d).where(F.col("name").like("%" + search.like_literal("_") + "%")).select("id"),
    "q21_snippets": lambda s, d: _SYM(s, d).where("comment is not null").select("id", tx.normal_snippet(F.col("comment")).alias("snippet")),
    "q23_federated": _federated,
    "q23_titles": lambda s, d: _SPE(s, d).select("spec_id", search.shown_title(F.col("title"), F.col("content"), F.col("spec_id")).alias("title")),
    "q24_indexed_search": _indexed,
    "w09_carried": _carried,
    "w11_chunks": lambda s, d: sets.chunks(_FIL(s, d).select("path", F.octet_length("content").alias("size")), "path", "size", 65_536),
    "t02_affected_in_order": lambda s, d: _affected(s, d).affected.orderBy(*lists.affected_order()).limit(25).select("id", "depth"),
    "t03_affected_files": lambda s, d: lists.page(_affected(s, d).paths().select("path"), [F.col("path")], 25),
    "t06_keyset_meta": lambda s, d: lists.keyset_meta(_SPE(s, d), ("spec_id", "spec_id"), 25, ("m", "")).select("total", "count", "next_key"),
    "t07_active_list": lambda s, d: lists.page(_active(s, d), lists.active_order(), 50).select("name", "state"),
    "t08_archive_list": lambda s, d: lists.page(_active(s, d), lists.archive_order("at"), 50).select("name", "at"),
    "t11_preview_files": lambda s, d: lists.page(_DOC(s, d).select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("filename")), [*lists.preview_order(), F.col("path")], 30),
    "t12_first_keys": lambda s, d: _SPE(s, d).where("depends_on is not null").select("spec_id", lists.first_keys(F.array_distinct("depends_on"), 2).alias("shown")),
    "u03_edge_upsert": _edge_upsert,
    "u04_least_depth": lambda s, d: g.reach(_SYM(s, d), _REL(s, d), gp._named(s, d, "toString"), False, 3, False).groupBy("id").agg(F.min("depth").alias("depth")),
    "u06_sequences": _sequences,
    "u13_merged_links": _merged_links,
    "u14_tracked_files": _sweep,
    "x01_strings": lambda s, d: _SYM(s, d).select("id", F.lower("name").alias("lower"), F.col("name").startswith("get").alias("prefix"), F.col("name").endswith("Id").alias("suffix"), F.instr("name", "e").alias("at")),
    "x03_globs": lambda s, d: _FIL(s, d).where(F.col("path").rlike(tx.path_glob("*:*/hooks/*.ts"))).select("path"),
    "x07_captures": lambda s, d: _SPE(s, d).where("content is not null").select("spec_id", F.array_join(tx.all_captures(F.col("content"), r"`([A-Za-z]+)`"), ",").alias("names")),
    "x08_capture_or_all": lambda s, d: _SPE(s, d).select("spec_id", tx.capture_or_all(F.col("spec_id"), r"/([a-z]+)-").alias("part")),
    "x09_placeholders": lambda s, d: _FIL(s, d).select("path", tx.placeholders(F.lit("$1/$2 ($3$4)"), F.col("path"), r"^([^:]+):(.+)\.(\w+)$").alias("out")),
    "x10_templates": lambda s, d: _SPE(s, d).select("spec_id", tx.expand_template(F.lit("open {{spec.id}} in {{workspace}} {{other}}"), {"spec.id": tx.quoted(F.col("spec_id")), "workspace": F.coalesce("workspace", F.lit(""))}).alias("command")),
    "x20_hash_maps": _hash_maps,
    "x21_numbers": lambda s, d: _SYM(s, d).select("id", F.least(F.greatest("line", F.lit(10)), F.lit(100)).alias("clamped"), (2 * F.col("line") + 3 * F.col("column_number")).alias("weighted")),
    "x23_dates": lambda s, d: load(s, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), (F.to_timestamp(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")) > F.lit("2024-01-02T00:00:00").cast("timestamp")).alias("later")),
    "x24_arrays": lambda s, d: _SPE(s, d).where("size(depends_on) > 0").select("spec_id", F.array_join(F.array_distinct("depends_on"), ",").alias("stable"), F.element_at("depends_on", 1).alias("first"), F.array_join(F.slice("depends_on", 1, 2), ",").alias("two"), F.array_join(F.sort_array("depends_on"), ",").alias("sorted")),
    "x25_maps": lambda s, d: load(s, d, "events").select("event_id", F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>"))["k"].alias("k")),
    "x27_json": lambda s, d: _SPE(s, d).select("spec_id", F.to_json(F.struct("spec_id", "workspace")).alias("json")),
    "x29_fallbacks": lambda s, d: _FIL(s, d).select("path", F.coalesce("language", "workspace", F.lit("none")).alias("known")),
    "x30_vectors": _vectors,
    "s12_headings": lambda s, d: _headings(s, d).groupBy("doc", "level").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("first"), F.max("label").alias("last")),
    "s18_json_lines": _json_lines,
    "s20_bulk_load": _store_relations,
    "s21_upsert_files": _store_upsert,
    "s23_upsert_specs": _store_specs,
    "s24_remove_files": _store_removed,
    "s26_add_relations": _store_added,
    "s27_clear": _store_cleared,
    "s29_reference_as_of": lambda s, d: ev.reference_as_of(load(s, d, "events").select(F.col("ts").alias("at"), F.col("event_id").alias("ref")), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")),
    "d02_requirements": lambda s, d: _requirements(s, d).groupBy("doc", "label").agg(F.count(F.lit(1)).alias("n")),
    "d05_names": lambda s, d: doc.extract(_requirements(s, d), "label", r"^Requirement:\s*(.+)$").select("doc", "text").distinct(),
    "d14_freshness": _freshness,
    "n11_package_collisions": lambda s, d: _packages(s, d)[1],
    "j11_package_symbols": lambda s, d: _packages(s, d)[0],
    "n12_concatenated": _concatenated,
    "n13_pruned_specs": lambda s, d: sets.prune(_SPE(s, d), _SPE(s, d).where("title is not null"), "spec_id", "workspace"),
    "n19_edited_lists": lambda s, d: _SPE(s, d).where("depends_on is not null").select("spec_id", F.array_join(scopes.edit_list(F.col("depends_on"), [], ["platform-core:added/one", "platform-core:added/one"]), ",").alias("edited")),
    "n30_workspaces": lambda s, d: _FIL(s, d).select("workspace").unionByName(_DOC(s, d).select("workspace")).unionByName(_SPE(s, d).select("workspace")).where("workspace is not null").distinct(),
    "r01_windowed_counts": lambda s, d: incremental.windowed_counts(load(s, d, "events"), "ts", F.col("event_type")).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "key", "n"),
    "r01_first_seen": lambda s, d: incremental.first_seen(load(s, d, "events"), "ts", ["user_id", "event_type"]).select("user_id", "event_type"),
    "r03_cached_results": _cached,
}

_LINKS = ", lk AS (SELECT r.source AS spec_id, s.file_path AS file, list(DISTINCT s.name) AS symbols FROM rel r JOIN sym s ON s.id = r.target WHERE r.type = 'COVERS_SYMBOL' GROUP BY 1, 2 UNION ALL SELECT source, target, [] FROM rel WHERE type = 'COVERS_FILE')"
_OVER = ", b AS (SELECT DISTINCT source AS sub, target AS base FROM rel WHERE type IN ('EXTENDS', 'IMPLEMENTS')), m AS (SELECT id, name, parent_id FROM sym WHERE kind = 'method'), ov AS (SELECT DISTINCT x.id AS source, y.id AS target FROM b JOIN m x ON x.parent_id = b.sub JOIN m y ON y.parent_id = b.base AND y.name = x.name WHERE NOT EXISTS (SELECT 1 FROM rel r WHERE r.type = 'OVERRIDES' AND r.source = x.id AND r.target = y.id))"
_TWO = f"SELECT * FROM (VALUES ('{HUB_FILE}'), ('{gp._FILE}')) t(path)"
_ORDER = "CASE risk WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END"
_SUMS = "CAST(coalesce(sum(n) FILTER (k = 1), 0) AS BIGINT) AS direct, CAST(coalesce(sum(n) FILTER (k = 2), 0) AS BIGINT) AS indirect, CAST(coalesce(sum(n) FILTER (k = 3), 0) AS BIGINT) AS transitive"
_FILE_IMPACT = (
    f", own AS ({_TWO}), up AS ({gp._UP}), ins AS (SELECT id, file_path FROM sym WHERE file_path IN (SELECT path FROM own)), w AS (SELECT id AS root, id, 0 AS depth FROM ins UNION SELECT w.root, u.b, w.depth + 1 FROM w JOIN up u ON u.a = w.id WHERE w.depth < 3), r AS (SELECT root, least(d, 3) AS k, count(*) AS s FROM (SELECT root, id, min(depth) AS d FROM w GROUP BY root, id) WHERE d > 0 GROUP BY 1, 2),"
    f" fw AS (SELECT path AS root, path AS id, 0 AS depth FROM own UNION SELECT fw.root, e.source, fw.depth + 1 FROM fw JOIN rel e ON e.type = 'IMPORTS' AND e.target = fw.id WHERE fw.depth < 3), f AS (SELECT root, least(d, 3) AS k, count(*) AS f FROM (SELECT root, id, min(depth) AS d FROM fw GROUP BY root, id) WHERE d > 0 GROUP BY 1, 2), ks AS (SELECT * FROM (VALUES (1), (2), (3)) t(k)),"
    f" per AS (SELECT i.id, i.file_path AS root, ks.k, greatest(coalesce(r.s, 0), coalesce(f.f, 0)) AS n FROM ins i CROSS JOIN ks LEFT JOIN r ON r.root = i.id AND r.k = ks.k LEFT JOIN f ON f.root = i.file_path AND f.k = ks.k),"
    f" each AS (SELECT root, {_SUMS} FROM per GROUP BY id, root UNION ALL SELECT o.path, {_SUMS} FROM own o LEFT JOIN (SELECT root, k, f AS n FROM f) f ON f.root = o.path GROUP BY o.path),"
    f" rated AS (SELECT *, direct + indirect + transitive AS total, {gp._RISK.format(d='direct', t='(direct + indirect + transitive)')} AS risk FROM each),"
    f" fi AS (SELECT root, max(direct) AS direct, max(indirect) AS indirect, max(transitive) AS transitive, max(total) AS total, arg_max(risk, {_ORDER}) AS risk FROM rated GROUP BY root)"
)
_DEP = "('CALLS', 'CONSTRUCTS', 'USES_TYPE')"
_AFFECTED = (
    f", up AS ({gp._UP}), w AS (SELECT '{HUB}' AS id, 0 AS depth UNION SELECT u.b, w.depth + 1 FROM w JOIN up u ON u.a = w.id WHERE w.depth < 3), own AS (SELECT id, min(depth) AS d FROM w GROUP BY id HAVING min(depth) > 0),"
    f" fw AS (SELECT '{HUB_FILE}' AS id, 0 AS depth UNION SELECT e.source, fw.depth + 1 FROM fw JOIN rel e ON e.type = 'IMPORTS' AND e.target = fw.id WHERE fw.depth < 3), f AS (SELECT id AS path, min(depth) AS d FROM fw GROUP BY id HAVING min(depth) > 0),"
    f" bo AS (SELECT source AS a, target AS b FROM rel WHERE type IN {_DEP} UNION SELECT target, source FROM rel WHERE type IN {_DEP}), tou AS (SELECT DISTINCT f.path, f.d, s.id FROM f JOIN sym s ON s.file_path = f.path JOIN bo ON bo.a = s.id WHERE bo.b IN (SELECT id FROM own)),"
    f" cl AS (SELECT path, d, id FROM tou UNION SELECT cl.path, cl.d, bo.b FROM cl JOIN bo ON bo.a = cl.id JOIN sym s ON s.id = bo.b AND s.file_path = cl.path),"
    f" ex AS (SELECT f.d, s.id FROM f JOIN rel e ON e.type = 'EXPORTS' AND e.source = f.path JOIN sym s ON s.id = e.target WHERE f.path NOT IN (SELECT path FROM tou)),"
    f" aff AS (SELECT id, CAST(min(d) AS INTEGER) AS depth FROM (SELECT id, d FROM own UNION ALL SELECT id, d FROM cl UNION ALL SELECT id, d FROM ex) WHERE id <> '{HUB}' GROUP BY id)"
)
_ACYCLIC = ", e AS (SELECT target AS a, source AS b FROM rel WHERE type = 'DEPENDS_ON' AND source > target AND source IN (SELECT spec_id FROM spe) AND target IN (SELECT spec_id FROM spe)), lv AS (SELECT spec_id AS id, 0 AS level FROM spe UNION SELECT e.b, lv.level + 1 FROM lv JOIN e ON e.a = lv.id), levels AS (SELECT id, CAST(max(level) AS INTEGER) AS level FROM lv GROUP BY id)"
_HEALTH = ", h AS (SELECT spec_id, CASE WHEN title IS NULL THEN 'failed' WHEN description IS NULL THEN 'warned' ELSE 'passed' END AS status, CAST(title IS NULL AS BIGINT) AS failures, CAST(description IS NULL AS BIGINT) AS warnings FROM spe)"
_HASH = "'sha256:' || sha256(content)"
_CHANGED = f", df AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'deleted' WHEN a.content_hash = b.h THEN 'same' ELSE 'changed' END AS change FROM (SELECT * FROM fil2 WHERE content_hash IS NOT NULL) a FULL JOIN (SELECT path, {_HASH} AS h FROM fil2 WHERE content IS NOT NULL) b ON a.path = b.path)"
_SUBSTRING = ", h AS (SELECT spec_id, workspace, content, unnest(range(1, length(content) - 10)) AS i FROM spe WHERE contains(lower(content), 'the reviewer') AND workspace IN ('platform-core', 'temporary-edge', 'archived-policy')), m AS (SELECT spec_id, workspace, content, i - 1 AS p FROM h WHERE substr(lower(content), i, 12) = 'the reviewer') SELECT spec_id, workspace, round(sum(1 + 1 / (1 + p / length(content))), 6) AS score FROM m GROUP BY spec_id, workspace"
_STATES = "WITH a AS (SELECT user_id AS name, min(ts) AS created_at, max(ts) AS \"at\", arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY user_id), t AS (SELECT *, CASE last WHEN 'error' THEN 'drafted' WHEN 'click' THEN 'discarded' ELSE 'open' END AS state FROM a) "
_SECTIONS = r", ln AS (SELECT spec_id AS doc, unnest(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)), 1) AS pos FROM spe WHERE content IS NOT NULL), fe AS (SELECT *, sum(CAST(regexp_matches(line, '^ {0,3}(```|~~~)') AS INTEGER)) OVER (PARTITION BY doc ORDER BY pos) AS fences FROM ln), hd AS (SELECT doc, pos, CAST(length(regexp_extract(line, '^(#{1,6})[ \t]', 1)) AS INTEGER) AS level, trim(regexp_replace(regexp_extract(line, '^#{1,6}[ \t]+(.*)$', 1), '[ \t]+#+[ \t]*$', '')) AS label FROM fe WHERE fences % 2 = 0 AND regexp_matches(line, '^#{1,6}[ \t]+\S'))"
_REQ = _SECTIONS + ", up AS (SELECT h.doc, h.pos, h.label, arg_max(p.label, p.pos) AS above FROM hd h JOIN hd p ON p.doc = h.doc AND p.pos < h.pos AND p.level < h.level GROUP BY 1, 2, 3), rq AS (SELECT * FROM up WHERE lower(label) LIKE 'requirement:%' AND lower(above) = 'requirements')"
_SPECIFIER = "metadata['specifier']"
_PACKAGES = f", im AS (SELECT DISTINCT source AS path, regexp_replace({_SPECIFIER}, '^[./]+', '') AS target FROM relations WHERE {_SPECIFIER} IS NOT NULL AND source IS NOT NULL), pk AS (SELECT *, CASE WHEN regexp_matches(target, '^[./]') THEN NULL WHEN starts_with(target, '@') THEN array_to_string(string_split(target, '/')[1:2], '/') ELSE split_part(target, '/', 1) END AS package FROM im), ow AS (SELECT package, min(split_part(path, ':', 1)) AS workspace, count(DISTINCT split_part(path, ':', 1)) AS n FROM pk WHERE package IS NOT NULL GROUP BY package)"
_REMAIN = ", gone AS (SELECT path AS k FROM fil2 WHERE starts_with(path, 'platform-core:') UNION SELECT id FROM sym WHERE file_path IN (SELECT path FROM fil2 WHERE starts_with(path, 'platform-core:'))), rest AS (SELECT * FROM rel WHERE source NOT IN (SELECT k FROM gone) AND target NOT IN (SELECT k FROM gone))"

SQL = {
    name: with_graph(sql, True)
    for name, sql in {
        "j08_cover_edges": _LINKS + " SELECT spec_id AS source, file AS target, 'COVERS_FILE' AS type FROM lk WHERE len(symbols) = 0 UNION SELECT l.spec_id, s.id, 'COVERS_SYMBOL' FROM (SELECT spec_id, file, unnest(symbols) AS name FROM lk) l JOIN sym s ON s.file_path = l.file AND s.name = l.name",
        "j17_division": ", c AS (SELECT DISTINCT source, target FROM rel WHERE type = 'COVERS_FILE'), n AS (SELECT source, count(*) AS k FROM c GROUP BY source) SELECT a.source AS spec_id, b.source AS within FROM c a JOIN c b ON a.target = b.target JOIN n ON n.source = b.source GROUP BY 1, 2, n.k HAVING count(*) = n.k",
        "g06_overriders": _OVER + " SELECT source, target FROM ov WHERE target = (SELECT min(target) FROM ov)",
        "g14_impact_symbols": _AFFECTED + f" SELECT '{HUB}' AS root, id, depth FROM aff WHERE id IN (SELECT id FROM sym)",
        "g16_file_impact": _FILE_IMPACT + " SELECT * FROM fi",
        "g17_files_impact": _FILE_IMPACT + f" SELECT string_agg(root, ', ' ORDER BY root) AS target, CAST(sum(direct) AS BIGINT) AS direct, CAST(sum(indirect) AS BIGINT) AS indirect, CAST(sum(transitive) AS BIGINT) AS transitive, CAST(sum(total) AS BIGINT) AS total, arg_max(risk, {_ORDER}) AS risk FROM fi",
        "g19_change_summary": gp._walk_sql(gp._UP_FILES, f"SELECT id AS root, id FROM sym WHERE file_path IN ({_TWO})", 3, f", k AS (SELECT root AS id, count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 0) AS total FROM r GROUP BY root), q AS (SELECT *, {gp._RISK.format(d='direct', t='total')} AS risk FROM k), z AS (SELECT count(*) AS changed, arg_max(risk, {_ORDER}) AS risk, (SELECT count(DISTINCT id) FROM r WHERE depth > 0) AS affected FROM q) SELECT changed, risk, affected, '2 file(s) changed, ' || changed || ' symbol(s) modified, ' || affected || ' symbol(s) affected; risk ' || risk AS summary FROM z"),
        "g20_hierarchy_dependents": "SELECT DISTINCT s.file_path AS path FROM rel r JOIN sym t ON t.id = r.target AND t.kind IN ('class', 'interface') JOIN sym s ON s.id = r.source WHERE r.type IN ('EXTENDS', 'IMPLEMENTS', 'OVERRIDES') AND t.file_path IN (SELECT path FROM fil2 WHERE starts_with(path, 'platform-core:')) AND s.file_path NOT IN (SELECT path FROM fil2 WHERE starts_with(path, 'platform-core:'))",
        "g22_topological_levels": _ACYCLIC + " SELECT id, level FROM levels",
        "g23_descendants": _ACYCLIC + ", ds AS (SELECT min(a) AS id FROM e UNION SELECT e.b FROM ds JOIN e ON e.a = ds.id) SELECT id, level FROM levels WHERE id IN (SELECT id FROM ds) AND id <> (SELECT min(a) FROM e)",
        "a11_total_symbols": gp._SCORES + "SELECT id, (SELECT count(*) FROM sym) AS total_symbols FROM scores WHERE (callers > 0 OR weight > 0) AND kind IN ('class', 'method', 'function') AND risk <> 'LOW' ORDER BY score DESC, id LIMIT 20",
        "a14_change_coverage": ", ch AS (SELECT DISTINCT spec_id AS change, unnest(depends_on) AS spec_id FROM spe WHERE depends_on IS NOT NULL) SELECT c.change, c.spec_id, c.spec_id IN (SELECT spec_id FROM spe) AS found, (SELECT count(DISTINCT target) FROM rel r WHERE r.source = c.spec_id AND r.type = 'COVERS_FILE') AS files, (SELECT count(DISTINCT target) FROM rel r WHERE r.source = c.spec_id AND r.type = 'COVERS_SYMBOL') AS symbols FROM ch c WHERE c.spec_id IS NOT NULL",
        "a16_health": _HEALTH + " SELECT * FROM h",
        "a17_totals": _HEALTH + " SELECT count(*) AS total, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'warned') AS warned, count(*) FILTER (status = 'failed') AS failed FROM h",
        "a19_artifact_status": "SELECT workspace AS artifact, CASE WHEN bool_and(title IS NOT NULL AND description IS NOT NULL) THEN 'complete' WHEN bool_and(title IS NULL) THEN 'missing' ELSE 'in-progress' END AS status FROM spe GROUP BY workspace",
        "a22_labels": _SECTIONS + " SELECT doc, label, count(*) AS n FROM hd GROUP BY doc, label",
        "a23_index_breakdown": _CHANGED + " SELECT split_part(path, ':', 1) AS workspace, count(*) FILTER (change <> 'deleted') AS discovered, count(*) FILTER (change IN ('new', 'changed')) AS indexed, count(*) FILTER (change = 'same') AS skipped, count(*) FILTER (change = 'deleted') AS removed FROM df GROUP BY 1",
        "a24_candidates": "SELECT spec_id, max(score) AS score, max(snippet) AS snippet FROM (SELECT spec_id, CAST(length(content) AS INTEGER) AS score, substr(content, 1, 20) AS snippet FROM spe WHERE contains(content, 'the reviewer') UNION ALL SELECT spec_id, CAST(length(spec_id) AS INTEGER), NULL FROM spe WHERE contains(spec_id, 'index')) GROUP BY spec_id",
        "a25_owned_edges": "SELECT coalesce(s.file_path, r.source) AS file_path, r.type, count(*) AS edges FROM rel r LEFT JOIN sym s ON s.id = r.source GROUP BY 1, 2",
        "q15_ranked": gp.SQL["q02_search_specs"].split(GRAPH.strip())[1].rsplit("SELECT spec_id, CAST(tier", 1)[0] + "SELECT spec_id FROM res WHERE bm25 > 0 OR hits > 0 ORDER BY tier DESC, hits DESC, strength DESC, bm25 DESC, spec_id LIMIT 10",
        "q18_symbol_snippets": gp.symbol_search_sql("log event").split(GRAPH.strip())[1].rsplit("SELECT id, CAST(tier", 1)[0] + r", bs AS (SELECT id FROM res WHERE bm25 > 0 OR hits > 0 ORDER BY tier DESC, hits DESC, strength DESC, bm25 DESC, id LIMIT 20), sn AS (SELECT s.id, s.line, regexp_split_to_array(coalesce(f.content, ''), '\r?\n') AS ls FROM bs JOIN sym s ON s.id = bs.id LEFT JOIN fil2 f ON f.path = s.file_path), ar AS (SELECT id, line, ls, list_filter(range(1, len(ls) + 1), lambda i: trim(ls[i]) <> '' AND i < line) AS b, list_filter(range(1, len(ls) + 1), lambda i: trim(ls[i]) <> '' AND i > line) AS a FROM sn), ed AS (SELECT id, ls, CAST(greatest(coalesce(b[greatest(len(b) - 1, 1)], line), 1) AS INTEGER) AS start_line, CAST(least(coalesce(a[least(2, len(a))], line), greatest(len(ls), 1)) AS INTEGER) AS end_line FROM ar) SELECT id, start_line, end_line, array_to_string(ls[start_line:end_line], chr(10)) AS snippet FROM ed".replace("\\r", "\r").replace("\\n", "\n"),
        "q17_literal_like": "SELECT id FROM sym WHERE contains(name, '_')",
        "q21_snippets": r", k AS (SELECT id, list_transform(regexp_split_to_array(replace(regexp_replace(regexp_replace(comment, '\x1B\[[0-9;]*[A-Za-z]', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), chr(9), '  '), '\r?\n'), lambda x: rtrim(x, ' ')) AS l FROM sym WHERE comment IS NOT NULL), i AS (SELECT id, l, coalesce(list_min(list_transform(list_filter(l, lambda x: x <> ''), lambda x: length(x) - length(ltrim(x, ' ')))), 0) AS n FROM k) SELECT id, array_to_string(list_transform(l, lambda x: substr(x, n + 1)), chr(10)) AS snippet FROM i",
        "q23_federated": _SUBSTRING,
        "q23_titles": r"SELECT spec_id, coalesce(nullif(trim(title), ''), nullif(regexp_extract(content, '(?m)^#[ \t]+([^\r\n]+?)[ \t]*\r?$', 1), ''), spec_id) AS title FROM spe",
        "w09_carried": "SELECT id, CASE WHEN own IS NULL AND kind = 'method' THEN carried ELSE own END AS section FROM (SELECT id, kind, CASE WHEN kind IN ('class', 'interface') THEN name END AS own, last_value(CASE WHEN kind IN ('class', 'interface') THEN name END IGNORE NULLS) OVER (PARTITION BY file_path ORDER BY line, column_number, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM sym)",
        "w11_chunks": ", o AS (SELECT path, CAST(coalesce(octet_length(encode(content)), 0) AS BIGINT) AS size, row_number() OVER (ORDER BY path) AS n FROM fil2), c AS (SELECT path, size, n, 0 AS chunk, size AS full_ FROM o WHERE n = 1 UNION ALL SELECT o.path, o.size, o.n, CASE WHEN c.full_ + o.size > 65536 THEN c.chunk + 1 ELSE c.chunk END, CASE WHEN c.full_ + o.size > 65536 THEN o.size ELSE c.full_ + o.size END FROM c JOIN o ON o.n = c.n + 1) SELECT 0 AS part, chunk, path, size FROM c",
        "t02_affected_in_order": _AFFECTED + " SELECT a.id, a.depth FROM aff a JOIN sym s ON s.id = a.id ORDER BY a.depth, s.file_path, s.line, s.name, s.id LIMIT 25",
        "t03_affected_files": _AFFECTED + " SELECT DISTINCT path FROM (SELECT s.file_path AS path FROM own o JOIN sym s ON s.id = o.id UNION ALL SELECT path FROM f) ORDER BY path LIMIT 25",
        "t06_keyset_meta": ", p AS (SELECT spec_id FROM spe WHERE spec_id > 'm' ORDER BY spec_id LIMIT 26) SELECT (SELECT count(*) FROM spe) AS total, least(count(*), 25) AS count, CASE WHEN count(*) > 25 THEN (SELECT spec_id FROM p ORDER BY spec_id LIMIT 1 OFFSET 24) END AS next_key FROM p",
        "t11_preview_files": "SELECT path, filename FROM (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS filename FROM doc) ORDER BY CASE WHEN filename = 'spec.md' THEN 0 ELSE 1 END, filename, path LIMIT 30",
        "t12_first_keys": ", k AS (SELECT DISTINCT spec_id, depends_on FROM spe WHERE depends_on IS NOT NULL), o AS (SELECT spec_id, list_filter(depends_on, lambda x, i: list_position(depends_on, x) = i) AS v FROM k) SELECT spec_id, array_to_string(v[1:2], ', ') || CASE WHEN len(v) > 2 THEN ' and ' || (len(v) - 2) || ' more' ELSE '' END AS shown FROM o",
        "u03_edge_upsert": "SELECT source, target, type, arg_max(metadata['line'], observed_at) FILTER (observed_at IS NOT NULL) AS line FROM relations WHERE source IS NOT NULL AND target IS NOT NULL AND type IS NOT NULL GROUP BY source, target, type",
        "u04_least_depth": gp._walk_sql(gp._DOWN, gp._NAMED("toString"), 3, "SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE depth > 0 GROUP BY id"),
        "u06_sequences": ", a AS (SELECT spec_id, coalesce(depends_on, []) AS d FROM spe), l AS (SELECT spec_id, list_filter(d, lambda x, i: list_position(d, x) = i) AS a FROM a), k AS (SELECT source AS spec_id, list(DISTINCT target ORDER BY target) AS b FROM rel WHERE type = 'DEPENDS_ON' GROUP BY source), c AS (SELECT l.spec_id, a, coalesce(b, []) AS b FROM l LEFT JOIN k ON k.spec_id = l.spec_id) SELECT spec_id, a = b AS same, list_filter(b, lambda x: list_contains(a, x)) = a AS in_order, array_to_string(list_filter(b, lambda x: NOT list_contains(a, x)), ',') AS only_linked, list_sort(a) = list_sort(b) AS same_sorted FROM c",
        "u13_merged_links": _LINKS + " SELECT split_part(spec_id, ':', 1) AS change, split_part(spec_id, '/', 1) AS spec_id, file, array_to_string(list_sort(list_distinct(flatten(list(symbols)))), ',') AS symbols, bool_or(len(symbols) > 0) AS explicit FROM lk GROUP BY 1, 2, 3",
        "u14_tracked_files": ", t AS (SELECT path AS file, CASE WHEN language IS NULL THEN 'ignored' WHEN lower(language) = 'go' THEN 'removed' ELSE 'open' END AS status FROM fil2), p AS (SELECT path AS file FROM fil2 WHERE content IS NOT NULL UNION SELECT path FROM doc) SELECT coalesce(t.file, p.file) AS file, CASE WHEN status IS NULL THEN 'open' WHEN status = 'ignored' THEN 'ignored' WHEN p.file IS NULL THEN 'removed' WHEN status = 'removed' THEN 'open' ELSE status END AS status FROM t FULL JOIN p ON p.file = t.file",
        "x01_strings": "SELECT id, lower(name) AS lower, starts_with(name, 'get') AS prefix, ends_with(name, 'Id') AS suffix, CAST(instr(name, 'e') AS INTEGER) AS \"at\" FROM sym",
        "x03_globs": "SELECT path FROM fil2 WHERE regexp_matches(path, '^.*:.*/hooks/.*\\.ts$')",
        "x07_captures": "SELECT spec_id, array_to_string(regexp_extract_all(content, '`([A-Za-z]+)`', 1), ',') AS names FROM spe WHERE content IS NOT NULL",
        "x08_capture_or_all": "SELECT spec_id, coalesce(nullif(regexp_extract(spec_id, '/([a-z]+)-', 1), ''), spec_id) AS part FROM spe",
        "x09_placeholders": "SELECT path, CASE WHEN regexp_matches(path, '^([^:]+):(.+)\\.(\\w+)$') THEN regexp_replace(path, '^([^:]+):(.+)\\.(\\w+)$', '\\1/\\2 (\\3)') END AS out FROM fil2",
        "x10_templates": "SELECT spec_id, 'open ''' || replace(spec_id, '''', '''\\''''') || ''' in ' || coalesce(workspace, '') || ' {{other}}' AS command FROM spe",
        "x20_hash_maps": "SELECT r.source AS spec_id, string_agg(f.path || '=' || coalesce(f.content_hash, ''), ',' ORDER BY f.path) AS hashes FROM rel r JOIN fil2 f ON f.path = r.target WHERE r.type = 'COVERS_FILE' GROUP BY r.source",
        "x21_numbers": "SELECT id, CAST(least(greatest(line, 10), 100) AS INTEGER) AS clamped, CAST(2 * line + 3 * column_number AS INTEGER) AS weighted FROM sym",
        "x24_arrays": ", k AS (SELECT spec_id, depends_on AS d FROM spe WHERE len(depends_on) > 0) SELECT spec_id, array_to_string(list_filter(d, lambda x, i: list_position(d, x) = i), ',') AS stable, d[1] AS first, array_to_string(d[1:2], ',') AS two, array_to_string(list_sort(d), ',') AS sorted FROM k",
        "x27_json": "SELECT spec_id, '{\"spec_id\":\"' || spec_id || '\"' || coalesce(',\"workspace\":\"' || workspace || '\"', '') || '}' AS json FROM spe",
        "x29_fallbacks": "SELECT path, coalesce(language, workspace, 'none') AS known FROM fil2",
        "s12_headings": _SECTIONS + " SELECT doc, level, count(*) AS n, min(label) AS first, max(label) AS last FROM hd GROUP BY doc, level",
        "s18_json_lines": "SELECT spec_id, title FROM spe",
        "s20_bulk_load": "SELECT type, count(*) AS edges FROM rel GROUP BY type",
        "s21_upsert_files": _REMAIN + ", cs AS (SELECT id FROM sym WHERE starts_with(file_path, 'platform-core:') AND kind = 'class'), new_ AS (SELECT * FROM rel WHERE type = 'DEFINES' AND target IN (SELECT id FROM cs)), ib AS (SELECT * FROM rel WHERE target IN (SELECT id FROM cs) AND source NOT IN (SELECT k FROM gone)), al AS (SELECT * FROM rest UNION SELECT * FROM new_ UNION SELECT * FROM ib) SELECT CASE WHEN starts_with(path, 'platform-core:') THEN 'new' ELSE 'old' END AS what, count(*) AS n FROM fil2 GROUP BY 1 UNION ALL SELECT 'symbols', (SELECT count(*) FROM sym WHERE file_path IS NULL OR file_path NOT IN (SELECT path FROM fil2 WHERE starts_with(path, 'platform-core:'))) + (SELECT count(*) FROM cs) UNION ALL SELECT type, count(*) FROM al GROUP BY type",
        "s23_upsert_specs": "SELECT spec_id, coalesce(title, 'Untitled') AS title FROM spe WHERE workspace IS NULL OR workspace <> 'platform-core' UNION ALL SELECT path, CAST(length(coalesce(content, '')) AS VARCHAR) FROM doc",
        "s24_remove_files": _REMAIN + " SELECT type, count(*) AS edges FROM rest GROUP BY type UNION ALL SELECT 'symbols', count(*) FROM sym WHERE file_path IS NULL OR file_path NOT IN (SELECT path FROM fil2 WHERE starts_with(path, 'platform-core:'))",
        "s26_add_relations": _OVER + " SELECT source, target, type FROM rel WHERE type IN ('OVERRIDES', 'EXTENDS') UNION SELECT source, target, 'OVERRIDES' FROM ov",
        "s27_clear": "SELECT 0 AS files, 0 AS docnodes, 0 AS symbols, 0 AS specs, true AS stale",
        "d02_requirements": _REQ + " SELECT doc, label, count(*) AS n FROM rq GROUP BY doc, label",
        "d05_names": _REQ + " SELECT DISTINCT doc, trim(substr(label, 13)) AS text FROM rq WHERE starts_with(label, 'Requirement:')",
        "d09_rule_failures": _REQ + ", n1 AS (SELECT s.spec_id AS doc, count(h.pos) AS n FROM spe s LEFT JOIN hd h ON h.doc = s.spec_id AND h.level = 1 GROUP BY 1), n2 AS (SELECT s.spec_id AS doc, count(h.pos) AS n FROM spe s LEFT JOIN hd h ON h.doc = s.spec_id AND lower(h.label) = 'purpose' GROUP BY 1), n3 AS (SELECT s.spec_id AS doc, count(h.pos) AS n FROM spe s LEFT JOIN rq h ON h.doc = s.spec_id GROUP BY 1) SELECT doc, 'failure' AS severity, 'missing' AS problem, 0 AS rule FROM n1 WHERE n = 0 UNION ALL SELECT doc, 'failure', 'count not exactly 1', 0 FROM n1 WHERE n > 1 UNION ALL SELECT doc, 'failure', 'missing', 1 FROM n2 WHERE n = 0 UNION ALL SELECT doc, 'warning', 'missing', 2 FROM n3 WHERE n = 0 UNION ALL SELECT doc, 'failure', 'repeated keys', 2 FROM (SELECT DISTINCT doc FROM (SELECT doc, lower(trim(label)) AS k FROM rq GROUP BY 1, 2 HAVING count(*) > 1))",
        "d14_freshness": f"SELECT r.source AS doc, bool_and(coalesce(coalesce(f.content_hash, '') = {_HASH}, false)) AS fresh FROM rel r JOIN fil2 f ON f.path = r.target WHERE r.type = 'COVERS_FILE' GROUP BY r.source",
        "n11_package_collisions": _PACKAGES + " SELECT package FROM ow WHERE n > 1",
        "j11_package_symbols": _PACKAGES + ", nm AS (SELECT split_part(file_path, ':', 1) AS workspace, name, min(id) AS symbol_id FROM sym WHERE name = 'toString' GROUP BY 1, 2) SELECT p.path, nm.name, nm.symbol_id FROM pk p JOIN ow ON ow.package = p.package JOIN nm ON nm.workspace = ow.workspace",
        "n12_concatenated": ", p AS (SELECT regexp_replace(path, '[^/]*$', '') AS folder, regexp_extract(path, '([^/]*)$', 1) AS name, content FROM doc) SELECT folder, 'sha256:' || sha256(string_agg(coalesce(content, ''), chr(10) ORDER BY CASE WHEN name = 'spec.md' THEN 0 ELSE 1 END, name)) AS content_hash FROM p GROUP BY folder",
        "n13_pruned_specs": "SELECT spec_id FROM spe WHERE title IS NULL AND workspace IN (SELECT workspace FROM spe WHERE title IS NOT NULL)",
        "n19_edited_lists": ", k AS (SELECT spec_id, list_append(depends_on, 'platform-core:added/one') AS d FROM spe WHERE depends_on IS NOT NULL) SELECT spec_id, array_to_string(list_filter(d, lambda x, i: list_position(d, x) = i), ',') AS edited FROM k",
        "n30_workspaces": "SELECT workspace FROM fil2 WHERE workspace IS NOT NULL UNION SELECT workspace FROM doc WHERE workspace IS NOT NULL UNION SELECT workspace FROM spe WHERE workspace IS NOT NULL",
        "r03_cached_results": ", cu AS (SELECT path AS key, coalesce(content_hash, '') AS s, coalesce(md5(content), '') AS f FROM fil2), ca AS (SELECT path AS key, max(content_hash) AS s, max(md5(content)) AS f, max(language) AS result FROM files WHERE path IS NOT NULL GROUP BY path), k AS (SELECT * FROM ca WHERE CASE WHEN lower(result) = 'go' THEN '1' ELSE '2' END = '2'), j AS (SELECT cu.key, CASE WHEN cu.s = k.s THEN 'hard' WHEN cu.f = k.f THEN 'soft' ELSE 'miss' END AS hit, k.result FROM cu LEFT JOIN k ON k.key = cu.key) SELECT key, hit, CASE WHEN hit <> 'miss' THEN result END AS result FROM j",
    }.items()
} | {
    "q24_indexed_search": gp.SQL["q02_search_specs"],
    "t07_active_list": _STATES + "SELECT name, state FROM t ORDER BY CASE WHEN state IN ('drafted', 'discarded') THEN NULL ELSE created_at END ASC NULLS LAST, CASE WHEN state IN ('drafted', 'discarded') THEN \"at\" END DESC NULLS LAST, name LIMIT 50",
    "t08_archive_list": _STATES + "SELECT name, \"at\" FROM t ORDER BY \"at\" DESC, name LIMIT 50",
    "x23_dates": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, date_trunc('second', ts) > TIMESTAMP '2024-01-02 00:00:00' AS later FROM events",
    "x25_maps": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "x30_vectors": "SELECT DISTINCT path, CAST(len(embedding) AS INTEGER) AS n, CAST(embedding[1] AS DOUBLE) AS first FROM files WHERE embedding IS NOT NULL AND len(embedding) > 0 AND path IS NOT NULL AND NOT isnan(embedding[1])",
    "s29_reference_as_of": "SELECT arg_max(event_id, ts) AS ref FROM events WHERE ts <= TIMESTAMP '2024-01-10 00:00:00'",
    "r01_windowed_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type AS key, count(*) AS n FROM events GROUP BY 1, 2",
    "r01_first_seen": "SELECT DISTINCT user_id, event_type FROM events",
}
