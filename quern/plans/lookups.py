"""Lookups, filters, projections and scalar functions over the graph tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import lookup, scoring, search, sets
from quern.plans.common import HUB, HUB_FILE, with_graph
from quern.tables import docnodes_of, graph, load, relations_of, specs_of, symbols_of

_SYM = lambda s, d: symbols_of(load(s, d, "symbols"))
_REL = lambda s, d: relations_of(load(s, d, "relations"))
_SPE = lambda s, d: specs_of(load(s, d, "specs"))
_DOC = lambda s, d: docnodes_of(load(s, d, "docnodes"))
_FIL = lambda s, d: graph(s, d)["files"]
SPEC = "temporary-edge:fixtures-outline/render-filter-section"
DOCUMENT = "packages/canonical-commit/docs/fixtures/outline/render-filter-section.json"

QUERIES = {
    "s01_scan_files": lambda s, d: _FIL(s, d).select("path", "workspace", "language", "content_hash", F.length("content").alias("chars")),
    "s02_scan_documents": lambda s, d: _DOC(s, d).select("path", "workspace", F.length("content").alias("chars")),
    "s03_scan_specs": lambda s, d: _SPE(s, d).select("spec_id", "title", F.coalesce(F.size("depends_on"), F.lit(0)).alias("dependencies")).withColumn("dependencies", F.greatest("dependencies", F.lit(0))),
    "f01_get_file": lambda s, d: lookup.by_key(_FIL(s, d), "path", HUB_FILE).select("path", "workspace", "content_hash"),
    "f02_files_by_config_path": lambda s, d: _FIL(s, d).where(tx.normal_path(F.col("config_relative_path")) == "packages/platform-core/src/shared/kernel/log-event.ts").select("path"),
    "f03_documents_by_config_path": lambda s, d: _DOC(s, d).where(F.col("config_relative_path") == DOCUMENT).select("path"),
    "f04_get_symbol": lambda s, d: lookup.by_key(_SYM(s, d), "id", HUB).select("id", "name", "kind", "file_path", "line"),
    "f04_get_spec": lambda s, d: lookup.by_key(_SPE(s, d), "spec_id", SPEC).select("spec_id", "title", "path"),
    "f05_symbol_query": lambda s, d: lookup.find_symbols(_SYM(s, d), kind="function", file_path="*:*/kernel/*.ts", comment="the").select("id", "name"),
    "f06_name_equals": lambda s, d: lookup.find_symbols(_SYM(s, d), name="TOSTRING").select("id"),
    "f07_comment_contains": lambda s, d: lookup.find_symbols(_SYM(s, d), comment="Until the change is closed").select("id"),
    "f08_path_glob": lambda s, d: lookup.find_symbols(_SYM(s, d), file_path="platform-core:*/import-map/*").select("id", "file_path"),
    "f09_name_glob": lambda s, d: lookup.find_symbols(_SYM(s, d), name="PARSE*").select("id", "name"),
    "f10_not_excluded": lambda s, d: _FIL(s, d).where(~tx.excluded(F.col("path"), F.substring_index("path", ":", 1), ["*/Generated/*", "*.min.*"], ["platform-core"])).select("path"),
    "f11_search_filters": lambda s, d: lookup.search_filter(_SYM(s, d), ["class", "interface"], "*.ts", "platform-core", ["*/fixtures/*"]).select("id"),
    "f12_spec_filters": lambda s, d: _SPE(s, d).where((F.col("workspace") != "platform-core") & ~F.col("path").rlike(tx.exclude_glob("*/cli-*"))).select("spec_id"),
    "f13_workspaces": lambda s, d: _FIL(s, d).groupBy(F.substring_index("path", ":", 1).alias("workspace")).agg(F.count(F.lit(1)).alias("files")),
    "f14_exported_symbols": lambda s, d: lookup.exported_symbols(_SYM(s, d), _REL(s, d), HUB_FILE).select("id", "name"),
    "f15_resolve_file": lambda s, d: lookup.resolve_file(_FIL(s, d), _DOC(s, d), "./packages\\platform-core\\src\\shared\\kernel\\log-event.ts"),
    "f16_resolve_symbol": lambda s, d: lookup.resolve_symbol(_SYM(s, d), HUB_FILE + ":logEvent"),
    "f18_spec_pattern": lambda s, d: _SPE(s, d).where(lookup.spec_pattern(F.col("spec_id"), "temporary-edge:fixtures-outline/*")).select("spec_id"),
    "f19_specs_of_workspaces": lambda s, d: _SPE(s, d).where(F.col("workspace").isin("platform-core", "temporary-edge")).select("spec_id", "workspace"),
    "f20_spec_list": lambda s, d: _SPE(s, d).select("spec_id", F.coalesce("title", tx.title(F.col("content"), F.col("spec_id"))).alias("title"), F.col("description").alias("summary")),
    "f22_prefix_exclusion": lambda s, d: _FIL(s, d).where(~tx.under_prefix(F.substring_index("path", ":", -1), "src")).select("path"),
    "j02_symbol_with_content": lambda s, d: _SYM(s, d).join(_FIL(s, d).select(F.col("path").alias("file_path"), F.length("content").alias("chars")), "file_path", "left").select("id", "chars"),
    "j05_valid_edges": lambda s, d: _valid(s, d),
    "j07_file_diff": lambda s, d: sets.file_diff(_FIL(s, d).where("content_hash is not null"), _FIL(s, d).where("content is not null").select("path", tx.content_hash(F.col("content")).alias("content_hash"))),
    "j09_known_dependencies": lambda s, d: _SPE(s, d).select("spec_id", F.explode(F.array_distinct("depends_on")).alias("dependency")).join(_SPE(s, d).select(F.col("spec_id").alias("dependency")), "dependency", "left_semi").select("spec_id", "dependency"),
    "j15_unique_names": lambda s, d: sets.unique_target(_SYM(s, d), "name", "id").select("name", "id"),
    "j16_overrides": lambda s, d: sets.overrides(_SYM(s, d), _REL(s, d)),
    "j17_structural_implements": lambda s, d: _structural(s, d),
    "j18_overlap": lambda s, d: sets.overlap(_REL(s, d).where("type = 'COVERS_FILE'"), "target", "source"),
    "j19_overlap_of_one": lambda s, d: _overlap_of_one(s, d),
    "j20_methods_by_parent": lambda s, d: _SYM(s, d).where("kind = 'method' and parent_id is not null and parent_id <> ''").groupBy("parent_id").agg(F.count(F.lit(1)).alias("methods"), F.count_distinct("name").alias("names")),
    "j21_specs_of_symbols": lambda s, d: _REL(s, d).where("type = 'COVERS_SYMBOL'").join(_SYM(s, d).select(F.col("id").alias("target"), "name"), "target").select(F.col("source").alias("spec_id"), F.col("target").alias("symbol_id"), "name"),
    "u02_unique_edges": lambda s, d: sets.unique_edges(load(s, d, "relations").where("source is not null and target is not null and type is not null").select("source", "target", "type")),
    "u05_dependency_sets": lambda s, d: _dependency_sets(s, d),
    "u11_selection": lambda s, d: _selection(s, d),
    "a18_tasks": lambda s, d: scoring.task_counts(_DOC(s, d), "path"),
    "x04_name_words": lambda s, d: _SYM(s, d).select("id", F.array_join(tx.split_words(F.col("name")), " ").alias("words")),
    "x05_components": lambda s, d: _SPE(s, d).select("spec_id", tx.components(F.col("spec_id")).alias("components")),
    "x06_symbol_ids": lambda s, d: _SYM(s, d).select("id", (tx.symbol_id(F.col("file_path"), F.col("kind"), F.col("name"), F.col("line"), F.col("column_number")) == F.lower("id")).alias("lower_equal")),
    "x13_titles": lambda s, d: _DOC(s, d).select("path", tx.title(F.col("content"), F.col("path")).alias("title")),
    "x14_cleaned_hash": lambda s, d: _SPE(s, d).where("content is not null").select("spec_id", tx.content_hash(tx.cleanup(F.col("content"), [(r"[ \t]+$", ""), (r"^- \[[xX]\]", "- [ ]")])).alias("hash")),
    "x17_normal_paths": lambda s, d: _FIL(s, d).select("path", tx.normal_path(F.col("config_relative_path")).alias("normal")),
    "x18_content_hashes": lambda s, d: _FIL(s, d).where("content is not null").select("path", tx.content_hash(F.col("content")).alias("hash")),
    "x26_json_fields": lambda s, d: load(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")),
    "x28_stale": lambda s, d: _FIL(s, d).select("path", tx.stale(F.col("content_hash"), tx.content_hash(F.col("content"))).alias("stale")),
    "q05_expanded_names": lambda s, d: _SYM(s, d).select("id", tx.expand_name(F.col("name")).alias("search_text")),
    "q22_substring_search": lambda s, d: search.substring_search(_SPE(s, d), "spec_id", "content", "the reviewer").select("spec_id", F.round("score", 6).alias("score"), "matches", "first_line"),
}


def _valid(s, d):
    from quern.operators.graph import with_endpoints

    t = graph(s, d)
    return with_endpoints(t["relations"], t["files"], t["symbols"], t["specs"]).select("source", "target", "type")


def _structural(s, d):
    sym = _SYM(s, d)
    methods = sym.where("kind in ('method', 'function')").select("name", F.col("parent_id").alias("owner"))
    own = lambda kind, key: methods.join(sym.where(F.col("kind") == kind).select(F.col("id").alias("owner")), "owner").select(F.col("owner").alias(key), "name")
    return sets.divides(own("class", "class_id"), own("interface", "interface_id"), "class_id", "interface_id", "name")


def _overlap_of_one(s, d):
    covers = _REL(s, d).where("type = 'COVERS_FILE'")
    shared = sets.overlap(covers, "target", "source")
    one = covers.agg(F.min("source").alias("source"))
    return shared.join(covers.join(F.broadcast(one), "source").select("target"), "target", "left_semi")


def _dependency_sets(s, d):
    stored = _SPE(s, d).select("spec_id", F.coalesce("depends_on", F.array().cast("array<string>")).alias("listed"))
    edges = _REL(s, d).where("type = 'DEPENDS_ON'").groupBy(F.col("source").alias("spec_id")).agg(F.sort_array(F.collect_list("target")).alias("linked"))
    both = stored.join(edges, "spec_id", "left").withColumn("linked", F.coalesce("linked", F.array().cast("array<string>")))
    return both.select("spec_id", sets.same_set(F.col("listed"), F.col("linked")).alias("same"), sets.subset(F.col("listed"), F.col("linked")).alias("listed_in_linked"), sets.subset(F.col("linked"), F.col("listed")).alias("linked_in_listed"), F.size(sets.difference(F.col("listed"), F.col("linked"))).alias("only_listed"), F.size(F.array_distinct("listed")).alias("distinct_listed"))


def _selection(s, d):
    spe, rel = _SPE(s, d), _REL(s, d)
    include = spe.select("spec_id", F.lit(0).alias("rank"), F.lit("pattern").alias("source")).unionByName(rel.where("type = 'DEPENDS_ON'").select(F.col("target").alias("spec_id"), F.lit(1).alias("rank"), F.lit("traversal").alias("source")))
    exclude = spe.where("workspace = 'platform-core'").select("spec_id")
    protected = rel.where("type = 'COVERS_SYMBOL'").select(F.col("source").alias("spec_id"), F.lit(3).alias("rank"), F.lit("specIds").alias("source"))
    return sets.selection(include, exclude, protected)


_NORMAL = "regexp_replace(replace({}, '\\', '/'), '^(\\./)+', '')"
_TITLE = "coalesce(nullif(regexp_extract({0}, '(?m)^#[ \\t]+([^\\r\\n]+?)[ \\t]*\\r?$', 1), ''), {1})"
_PARTS = "lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'), '[:/_.-]+', ' ', 'g')))"
_EXPANDED = "lower(trim(replace(replace(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '_', ' '), '-', ' ')))"
_NODES = "nodes AS (SELECT path AS k, 'file' AS kind FROM fil2 UNION SELECT id, 'symbol' FROM sym UNION SELECT spec_id, 'spec' FROM spe)"
_ENDS = "ends AS (SELECT * FROM (VALUES ('IMPORTS','file','file'),('DEFINES','file','symbol'),('EXPORTS','file','symbol'),('CALLS','symbol','symbol'),('CONSTRUCTS','symbol','symbol'),('USES_TYPE','symbol','symbol'),('EXTENDS','symbol','symbol'),('IMPLEMENTS','symbol','symbol'),('OVERRIDES','symbol','symbol'),('DEPENDS_ON','spec','spec'),('COVERS_FILE','spec','file'),('COVERS_SYMBOL','spec','symbol')) t(type, a, b))"

SQL = {
    name: with_graph(sql)
    for name, sql in {
        "s01_scan_files": "SELECT path, workspace, language, content_hash, CAST(length(content) AS INTEGER) AS chars FROM fil2",
        "s02_scan_documents": "SELECT path, workspace, CAST(length(content) AS INTEGER) AS chars FROM doc",
        "s03_scan_specs": "SELECT spec_id, title, CAST(coalesce(len(depends_on), 0) AS INTEGER) AS dependencies FROM spe",
        "f01_get_file": f"SELECT path, workspace, content_hash FROM fil2 WHERE path = '{HUB_FILE}'",
        "f02_files_by_config_path": f"SELECT path FROM fil2 WHERE {_NORMAL.format('config_relative_path')} = 'packages/platform-core/src/shared/kernel/log-event.ts'",
        "f03_documents_by_config_path": f"SELECT path FROM doc WHERE config_relative_path = '{DOCUMENT}'",
        "f04_get_symbol": f"SELECT id, name, kind, file_path, line FROM sym WHERE id = '{HUB}'",
        "f04_get_spec": f"SELECT spec_id, title, path FROM spe WHERE spec_id = '{SPEC}'",
        "f05_symbol_query": "SELECT id, name FROM sym WHERE kind = 'function' AND regexp_matches(file_path, '^.*:.*/kernel/.*\\.ts$') AND contains(lower(coalesce(comment, '')), 'the')",
        "f06_name_equals": "SELECT id FROM sym WHERE lower(name) = 'tostring'",
        "f07_comment_contains": "SELECT id FROM sym WHERE contains(lower(comment), 'until the change is closed')",
        "f08_path_glob": "SELECT id, file_path FROM sym WHERE regexp_matches(file_path, '^platform-core:.*/import-map/.*$')",
        "f09_name_glob": "SELECT id, name FROM sym WHERE lower(name) LIKE 'parse%'",
        "f10_not_excluded": "SELECT path FROM fil2 WHERE split_part(path, ':', 1) <> 'platform-core' AND NOT lower(path) LIKE '%/generated/%' AND NOT lower(path) LIKE '%.min.%'",
        "f11_search_filters": "SELECT id FROM sym WHERE kind IN ('class', 'interface') AND file_path LIKE '%.ts' AND starts_with(file_path, 'platform-core:') AND NOT lower(file_path) LIKE '%/fixtures/%'",
        "f12_spec_filters": "SELECT spec_id FROM spe WHERE workspace <> 'platform-core' AND NOT lower(path) LIKE '%/cli-%'",
        "f13_workspaces": "SELECT split_part(path, ':', 1) AS workspace, count(*) AS files FROM fil2 GROUP BY 1",
        "f14_exported_symbols": f"SELECT id, name FROM sym WHERE id IN (SELECT target FROM rel WHERE type = 'EXPORTS' AND source = '{HUB_FILE}')",
        "f15_resolve_file": f"SELECT DISTINCT path FROM (SELECT path, config_relative_path AS c FROM fil2 UNION ALL SELECT path, config_relative_path FROM doc) WHERE {_NORMAL.format('c')} = 'packages/platform-core/src/shared/kernel/log-event.ts'",
        "f16_resolve_symbol": f"SELECT id FROM sym WHERE file_path = '{HUB_FILE}' AND name = 'logEvent'",
        "f18_spec_pattern": "SELECT spec_id FROM spe WHERE starts_with(spec_id, 'temporary-edge:fixtures-outline/')",
        "f19_specs_of_workspaces": "SELECT spec_id, workspace FROM spe WHERE workspace IN ('platform-core', 'temporary-edge')",
        "f20_spec_list": f"SELECT spec_id, coalesce(title, {_TITLE.format('content', 'spec_id')}) AS title, description AS summary FROM spe",
        "f22_prefix_exclusion": "SELECT path FROM (SELECT path, split_part(path, ':', -1) AS p FROM fil2) WHERE NOT (p = 'src' OR starts_with(p, 'src/'))",
        "j02_symbol_with_content": "SELECT s.id, CAST(length(f.content) AS INTEGER) AS chars FROM sym s LEFT JOIN fil2 f ON f.path = s.file_path",
        "j05_valid_edges": f", {_NODES}, {_ENDS} SELECT r.source, r.target, r.type FROM rel r JOIN ends e ON e.type = r.type WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.k = r.source AND n.kind = e.a) AND EXISTS (SELECT 1 FROM nodes n WHERE n.k = r.target AND n.kind = e.b)",
        "j07_file_diff": "SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'deleted' WHEN a.content_hash = b.h THEN 'same' ELSE 'changed' END AS change FROM (SELECT * FROM fil2 WHERE content_hash IS NOT NULL) a FULL JOIN (SELECT path, 'sha256:' || sha256(content) AS h FROM fil2 WHERE content IS NOT NULL) b ON a.path = b.path",
        "j09_known_dependencies": "SELECT DISTINCT spec_id, dependency FROM (SELECT spec_id, unnest(depends_on) AS dependency FROM spe) WHERE dependency IN (SELECT spec_id FROM spe)",
        "j15_unique_names": "SELECT name, min(id) AS id FROM sym WHERE name IS NOT NULL GROUP BY name HAVING min(id) = max(id)",
        "j16_overrides": ", b AS (SELECT DISTINCT source AS sub, target AS base FROM rel WHERE type IN ('EXTENDS', 'IMPLEMENTS')), m AS (SELECT id, name, parent_id FROM sym WHERE kind = 'method') SELECT DISTINCT x.id AS source, y.id AS target FROM b JOIN m x ON x.parent_id = b.sub JOIN m y ON y.parent_id = b.base AND y.name = x.name WHERE NOT EXISTS (SELECT 1 FROM rel r WHERE r.type = 'OVERRIDES' AND r.source = x.id AND r.target = y.id)",
        "j17_structural_implements": ", m AS (SELECT DISTINCT s.name, o.id AS owner, o.kind FROM sym s JOIN sym o ON o.id = s.parent_id WHERE s.kind IN ('method', 'function') AND o.kind IN ('class', 'interface')), n AS (SELECT owner, count(*) AS k FROM m WHERE kind = 'interface' GROUP BY owner) SELECT c.owner AS class_id, i.owner AS interface_id FROM m c JOIN m i ON i.name = c.name AND c.kind = 'class' AND i.kind = 'interface' JOIN n ON n.owner = i.owner GROUP BY c.owner, i.owner, n.k HAVING count(*) = n.k",
        "j18_overlap": "SELECT target, count(DISTINCT source) AS owners, min(source) AS first_owner, max(source) AS last_owner FROM rel WHERE type = 'COVERS_FILE' GROUP BY target HAVING count(DISTINCT source) > 1",
        "j19_overlap_of_one": ", c AS (SELECT * FROM rel WHERE type = 'COVERS_FILE') SELECT target, count(DISTINCT source) AS owners, min(source) AS first_owner, max(source) AS last_owner FROM c WHERE target IN (SELECT target FROM c WHERE source = (SELECT min(source) FROM c)) GROUP BY target HAVING count(DISTINCT source) > 1",
        "j20_methods_by_parent": "SELECT parent_id, count(*) AS methods, count(DISTINCT name) AS names FROM sym WHERE kind = 'method' AND parent_id <> '' GROUP BY parent_id",
        "j21_specs_of_symbols": "SELECT r.source AS spec_id, s.id AS symbol_id, s.name FROM rel r JOIN sym s ON s.id = r.target WHERE r.type = 'COVERS_SYMBOL'",
        "u02_unique_edges": "SELECT DISTINCT source, target, type FROM relations WHERE source IS NOT NULL AND target IS NOT NULL AND type IS NOT NULL",
        "u05_dependency_sets": ", a AS (SELECT spec_id, coalesce(depends_on, []) AS l FROM spe), b AS (SELECT source AS spec_id, list(target ORDER BY target) AS k FROM rel WHERE type = 'DEPENDS_ON' GROUP BY source), c AS (SELECT a.spec_id, l, coalesce(k, []) AS k FROM a LEFT JOIN b ON a.spec_id = b.spec_id) SELECT spec_id, list_has_all(k, l) AND list_has_all(l, k) AS same, list_has_all(k, l) AS listed_in_linked, list_has_all(l, k) AS linked_in_listed, CAST(len(list_filter(list_distinct(l), lambda x: NOT list_contains(k, x))) AS INTEGER) AS only_listed, CAST(len(list_distinct(l)) AS INTEGER) AS distinct_listed FROM c",
        "u11_selection": ", i AS (SELECT spec_id, 0 AS rank, 'pattern' AS source FROM spe UNION ALL SELECT target, 1, 'traversal' FROM rel WHERE type = 'DEPENDS_ON'), p AS (SELECT source AS spec_id, 3 AS rank, 'specIds' AS source FROM rel WHERE type = 'COVERS_SYMBOL'), e AS (SELECT spec_id FROM spe WHERE workspace = 'platform-core'), k AS (SELECT * FROM i WHERE spec_id NOT IN (SELECT spec_id FROM e) OR spec_id IN (SELECT spec_id FROM p) UNION ALL SELECT * FROM p) SELECT spec_id, max(rank) AS rank, arg_max(source, rank) AS source FROM k GROUP BY spec_id",
        "a18_tasks": ", n AS (SELECT path, len(regexp_extract_all(content, '(?m)^\\s*[-*]\\s+\\[[xX]\\]')) AS d, len(regexp_extract_all(content, '(?m)^\\s*[-*]\\s+\\[ \\]')) AS o FROM doc) SELECT path, CAST(coalesce(sum(d), 0) AS BIGINT) AS done, CAST(coalesce(sum(o), 0) AS BIGINT) AS open FROM n GROUP BY ROLLUP (path)",
        "x04_name_words": f"SELECT id, {_PARTS} AS words FROM sym",
        "x05_components": "SELECT spec_id, ' ' || translate(spec_id, ':/_.-', '     ') || ' ' AS components FROM spe",
        "x06_symbol_ids": "SELECT id, concat_ws(':', file_path, kind, name, CAST(line AS VARCHAR), CAST(column_number AS VARCHAR)) = lower(id) AS lower_equal FROM sym",
        "x13_titles": f"SELECT path, {_TITLE.format('content', 'path')} AS title FROM doc",
        "x14_cleaned_hash": "SELECT spec_id, 'sha256:' || sha256(regexp_replace(regexp_replace(content, '(?m)[ \\t]+$', '', 'g'), '(?m)^- \\[[xX]\\]', '- [ ]', 'g')) AS hash FROM spe WHERE content IS NOT NULL",
        "x17_normal_paths": f"SELECT path, {_NORMAL.format('config_relative_path')} AS normal FROM fil2",
        "x18_content_hashes": "SELECT path, 'sha256:' || sha256(content) AS hash FROM fil2 WHERE content IS NOT NULL",
        "x28_stale": "SELECT path, content_hash <> 'sha256:' || sha256(content) AS stale FROM fil2",
        "q05_expanded_names": f"SELECT id, CASE WHEN {_EXPANDED} = lower(name) THEN name ELSE name || ' ' || {_EXPANDED} END AS search_text FROM sym",
        "q22_substring_search": ", h AS (SELECT spec_id, content, unnest(range(1, length(content) - 10)) AS i FROM spe WHERE contains(lower(content), 'the reviewer')), m AS (SELECT spec_id, content, i - 1 AS p FROM h WHERE substr(lower(content), i, 12) = 'the reviewer') SELECT spec_id, round(sum(1 + 1 / (1 + p / length(content))), 6) AS score, count(*) AS matches, CAST(min(length(substr(content, 1, p)) - length(replace(substr(content, 1, p), chr(10), '')) + 1) AS INTEGER) AS first_line FROM m GROUP BY spec_id",
    }.items()
} | {"x26_json_fields": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"}
