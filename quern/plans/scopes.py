"""Queries on scopes, packages and workspaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import scopes
from quern.plans.common import with_graph
from quern.plans.lookups import _FIL, _REL, _SPE, _SYM
from quern.tables import load


def _nearest_class(s, d):
    sym = _SYM(s, d)
    return scopes.nearest(scopes.ancestors(sym), sym.where("kind = 'class'").select(F.col("id").alias("ancestor")))


def _scoped_names(s, d):
    sym = _SYM(s, d).where("name is not null")
    names = sym.where("parent_id is not null and parent_id <> ''").select(F.col("parent_id").alias("scope_id"), "name", F.col("id").alias("target"))
    return scopes.lookup(sym.select(F.col("id").alias("scope_id"), "name"), names, sym)


def _mismatched(s, d):
    files = _FIL(s, d).where("content is not null and workspace is not null")
    stored = scopes.fingerprints(files, F.coalesce("content_hash", F.lit("")), F.col("workspace"))
    return scopes.mismatched(stored, scopes.fingerprints(files, tx.content_hash(F.col("content")), F.col("workspace")))


def _cross(s, d):
    listed = _SPE(s, d).where("depends_on is not null").select("spec_id", F.array_distinct("depends_on").alias("values"))
    linked = _REL(s, d).where("type = 'DEPENDS_ON'").groupBy(F.col("source").alias("spec_id")).agg(F.sort_array(F.collect_list("target")).alias("values"))
    return scopes.cross_relation(listed, linked, "spec_id", "subset")


QUERIES = {
    "w10_nearest_class": _nearest_class,
    "j14_scoped_names": _scoped_names,
    "n07_packages": lambda s, d: load(s, d, "relations").where("metadata['specifier'] is not null").select(F.col("metadata")["specifier"].alias("specifier")).distinct().withColumn("package", scopes.package_of(F.col("specifier"))),
    "a26_dependency_workspaces": lambda s, d: _SPE(s, d).where("depends_on is not null").select("spec_id", F.array_join(F.sort_array(F.array_distinct(F.transform("depends_on", lambda x: F.substring_index(x, ":", 1)))), ",").alias("workspaces")),
    "x19_workspace_fingerprints": lambda s, d: scopes.fingerprints(_FIL(s, d).where("content is not null"), F.col("content"), F.col("workspace")),
    "m03_mismatched_workspaces": _mismatched,
    "d10_cross_relation": _cross,
}

_UP = ", ids AS (SELECT id FROM sym), up AS (SELECT s.id, min(p.id) AS parent FROM sym s JOIN ids p ON p.id = s.parent_id WHERE s.parent_id <> '' GROUP BY s.id), tree AS (SELECT id, [id] AS path FROM ids WHERE id NOT IN (SELECT id FROM up) UNION ALL SELECT u.id, list_append(t.path, u.id) FROM tree t JOIN up u ON u.parent = t.id), anc AS (SELECT id, unnest(path) AS ancestor, len(path) - generate_subscripts(path, 1) AS distance FROM tree)"
_PART = "CAST(('0x' || substr(sha256(path || chr(10) || {0}), 1, 8)) AS BIGINT)"

SQL = {
    name: with_graph(sql, True)
    for name, sql in {
        "w10_nearest_class": _UP + " SELECT a.id, arg_min(a.ancestor, a.distance) AS ancestor FROM anc a JOIN sym s ON s.id = a.ancestor AND s.kind = 'class' WHERE a.distance > 0 GROUP BY a.id",
        "j14_scoped_names": _UP + ", b AS (SELECT parent_id AS at_, name, id AS target FROM sym WHERE parent_id <> '' AND name IS NOT NULL), m AS (SELECT f.id AS scope_id, f.name, a.distance, min(b.target) AS lo, max(b.target) AS hi FROM sym f JOIN anc a ON a.id = f.id JOIN b ON b.at_ = a.ancestor AND b.name = f.name GROUP BY 1, 2, 3), n AS (SELECT *, row_number() OVER (PARTITION BY scope_id, name ORDER BY distance) AS k FROM m) SELECT scope_id, name, lo AS target FROM n WHERE k = 1 AND lo = hi",
        "a26_dependency_workspaces": "SELECT spec_id, array_to_string(list_sort(list_distinct(list_transform(depends_on, lambda x: split_part(x, ':', 1)))), ',') AS workspaces FROM spe WHERE depends_on IS NOT NULL",
        "x19_workspace_fingerprints": f"SELECT workspace, count(*) AS files, CAST(sum({_PART.format('content')}) AS BIGINT) AS fingerprint FROM fil2 WHERE content IS NOT NULL GROUP BY workspace",
        "m03_mismatched_workspaces": f"SELECT workspace FROM fil2 WHERE content IS NOT NULL AND workspace IS NOT NULL GROUP BY workspace HAVING sum({_PART.format(chr(39) + 'sha256:' + chr(39) + ' || sha256(content)')}) <> sum({_PART.format(chr(99) + 'oalesce(content_hash, ' + chr(39) * 2 + ')')})",
        "d10_cross_relation": ", a AS (SELECT spec_id, list_distinct(depends_on) AS v FROM spe WHERE depends_on IS NOT NULL), b AS (SELECT source AS spec_id, list(target) AS v FROM rel WHERE type = 'DEPENDS_ON' GROUP BY source) SELECT coalesce(a.spec_id, b.spec_id) AS spec_id, CASE WHEN a.v IS NULL OR b.v IS NULL THEN 'deferred' WHEN list_has_all(b.v, a.v) THEN 'ok' ELSE 'broken' END AS verdict FROM a FULL JOIN b ON a.spec_id = b.spec_id",
    }.items()
} | {
    "n07_packages": "SELECT DISTINCT metadata['specifier'] AS specifier, CASE WHEN regexp_matches(metadata['specifier'], '^[./]') THEN NULL WHEN starts_with(metadata['specifier'], '@') THEN array_to_string(string_split(metadata['specifier'], '/')[1:2], '/') ELSE split_part(metadata['specifier'], '/', 1) END AS package FROM relations WHERE metadata['specifier'] IS NOT NULL",
}
