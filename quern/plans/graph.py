"""Adjacency, traversal, impact, scoring, search and coverage over the graph tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import events as ev
from quern.operators import graph as g
from quern.operators import lists, scoring, search
from quern.plans.common import HUB, HUB_FILE, SINK, with_graph
from quern.plans.lookups import _DOC, _FIL, _REL, _SPE, _SYM
from quern.tables import DEPENDENCY, load

_LIST = lambda s, d, types, node, incoming: g.neighbours(_REL(s, d), types, node, incoming).select("source", "target", "type")
_SPEC = "archived-policy:fixtures-layout/index-session-queue"
_FILE = "temporary-cache:infra/metadata/scan_section_record.py"


def _seeds(s, *ids):
    return s.createDataFrame([(i, i) for i in ids], "root string, id string")


def _named(s, d, name):
    return _SYM(s, d).where(F.col("name") == name).select(F.col("id").alias("root"), "id")


def _summary(s, d):
    out = g.Impact(_SYM(s, d), _REL(s, d), s.createDataFrame([(HUB,), (SINK,)], "id string")).summary()
    return out.select("root", *[F.col(c).cast("long").alias(c) for c in ("direct", "indirect", "transitive", "total")], "risk")


def _affected(s, d):
    return g.Impact(_SYM(s, d), _REL(s, d), s.createDataFrame([(HUB,)], "id string")).affected.select("root", "id", "depth")


def _file_impact(s, d):
    out = g.file_impact(_SYM(s, d), _REL(s, d), s.createDataFrame([(HUB_FILE,), (_FILE,)], "path string"))
    return out.select("root", *[F.col(c).cast("long").alias(c) for c in ("direct", "indirect", "transitive", "total")], "risk")


def _spec_impact(s, d):
    reached, paths, marked = g.spec_impact(_SPE(s, d), _SYM(s, d), _REL(s, d), _SPE(s, d).select("spec_id"))
    out = reached.select("root", F.lit("spec").alias("kind"), F.col("spec_id").alias("item"))
    return out.unionByName(paths.select("root", F.lit("file").alias("kind"), F.col("path").alias("item"))).unionByName(marked.select("root", F.lit("symbol").alias("kind"), F.col("symbol_id").alias("item")))


def _changes(s, d):
    per, _ = g.detect_changes(_SYM(s, d), _REL(s, d), s.createDataFrame([(HUB_FILE,), (_FILE,)], "path string"))
    return per.select("id", F.col("direct").cast("long").alias("direct"), F.col("total").cast("long").alias("total"), "risk")


def _truncated(s, d):
    seeds = _named(s, d, "to_string")
    sym, rel = _SYM(s, d), _REL(s, d)
    return g.truncated(g.symbol_edges(sym, rel, False), g.reach(sym, rel, seeds, False, 2, False), seeds, 2)


def _closure(s, d):
    edges = _REL(s, d).where("type = 'DEPENDS_ON'").select(F.col("source").alias("a"), F.col("target").alias("b"))
    return g.dependency_closure(edges, _SPE(s, d).select(F.col("spec_id").alias("root"), F.col("spec_id").alias("id")))


def _facts(s, d):
    facts = load(s, d, "relations").where("metadata['line'] is not null and source is not null").select(F.col("source").alias("id"), F.col("metadata")["line"].cast("int").alias("line"), F.col("target").alias("fact_target")).distinct()
    facts = facts.join(_SYM(s, d).select("id", "file_path"), "id").select("file_path", "line", F.col("id").alias("fact_source"), "fact_target")
    return ev.enclosing(facts, _SYM(s, d))


def _changes_state(s, d):
    kind = F.create_map(*[F.lit(x) for x in ("signup", "created", "view", "transitioned", "click", "transitioned", "purchase", "signed-off", "error", "invalidated")])
    to = F.create_map(*[F.lit(x) for x in ("view", "implementing", "click", "verifying")])
    log = load(s, d, "events").select(F.col("user_id").alias("change"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), kind[F.col("event_type")].alias("type"), to[F.col("event_type")].alias("to_state"))
    return ev.change_state(log)


def _page(s, d, **how):
    rows = _SPE(s, d).select("spec_id", "title")
    return lists.page(rows, [F.col("spec_id")], **how)


def _health(s, d):
    t = _FIL(s, d)
    counts = [t.agg(F.count(F.lit(1)).alias("files")), _DOC(s, d).agg(F.count(F.lit(1)).alias("documents")), _SYM(s, d).agg(F.count(F.lit(1)).alias("symbols")), _SPE(s, d).agg(F.count(F.lit(1)).alias("specs"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.join(F.broadcast(c))  # one row each
    return out


def _bm25(s, d, what, query, stems=False):
    run, table = {"symbols": (search.symbols, _SYM), "specs": (search.specs, _SPE), "documents": (search.documents, _DOC)}[what]
    out = run(table(s, d), query, None, stems)
    key = {"symbols": "id", "specs": "spec_id", "documents": "path"}[what]
    return out.select(key, "tier", "hits", "strength", F.round("bm25", 6).alias("bm25"))


QUERIES = {
    "g01_callers": lambda s, d: _LIST(s, d, DEPENDENCY, HUB, True),
    "g02_callees": lambda s, d: _LIST(s, d, DEPENDENCY, SINK, False),
    "g03_importers": lambda s, d: _LIST(s, d, ["IMPORTS"], _FILE, True),
    "g03_importees": lambda s, d: _LIST(s, d, ["IMPORTS"], HUB_FILE, False),
    "g04_extenders": lambda s, d: _REL(s, d).where("type = 'EXTENDS'").select("source", "target"),
    "g05_implementors": lambda s, d: _REL(s, d).where("type = 'IMPLEMENTS'").select("source", "target"),
    "g07_spec_dependencies": lambda s, d: _LIST(s, d, ["DEPENDS_ON"], _SPEC, False),
    "g08_covered_files": lambda s, d: _REL(s, d).where("type = 'COVERS_FILE'").select("source", "target"),
    "g09_covered_symbols": lambda s, d: _REL(s, d).where("type = 'COVERS_SYMBOL'").select("source", "target"),
    "g10_upstream": lambda s, d: g.reach(_SYM(s, d), _REL(s, d), _seeds(s, HUB), True, 3, True),
    "g10_upstream_symbols_only": lambda s, d: g.reach(_SYM(s, d), _REL(s, d), _named(s, d, "to_string"), True, 3, False),
    "g11_downstream": lambda s, d: g.reach(_SYM(s, d), _REL(s, d), _seeds(s, SINK), False, 3, True),
    "g11_downstream_many": lambda s, d: g.reach(_SYM(s, d), _REL(s, d), _named(s, d, "toString"), False, 3, False),
    "g12_truncated": _truncated,
    "g13_impact_summary": _summary,
    "g14_impact_symbols": _affected,
    "g15_file_reach": lambda s, d: g.file_reach(_REL(s, d), _seeds(s, _FILE), "upstream", 3),
    "g16_file_impact": _file_impact,
    "g18_spec_impact": _spec_impact,
    "g19_detect_changes": _changes,
    "g21_dependency_closure": _closure,
    "g24_roots": lambda s, d: _SPE(s, d).select("spec_id").join(_REL(s, d).where("type = 'DEPENDS_ON'").select(F.col("source").alias("spec_id")), "spec_id", "left_anti"),
    "j01_caller_rows": lambda s, d: scoring.caller_rows(_SYM(s, d), _REL(s, d)),
    "j13_enclosing_symbols": _facts,
    "a01_node_counts": _health,
    "a02_edge_counts": lambda s, d: scoring.edge_counts(_REL(s, d)),
    "a03_languages": lambda s, d: _FIL(s, d).select("language").where("language is not null").distinct(),
    "a04_direct_callers": lambda s, d: scoring.direct_callers(_SYM(s, d), _REL(s, d)),
    "a05_importers": lambda s, d: scoring.importer_counts(_REL(s, d)),
    "a06_hierarchy": lambda s, d: scoring.hierarchy_counts(_REL(s, d)),
    "a07_scores": lambda s, d: scoring.scored(_SYM(s, d), _REL(s, d), importer_only=True).select("id", F.col("score").cast("long").alias("score"), "risk"),
    "a09_max_risk": lambda s, d: scoring.max_risk(scoring.scored(_SYM(s, d), _REL(s, d)).withColumn("workspace", F.substring_index("file_path", ":", 1)), "workspace"),
    "a10_hotspots": lambda s, d: scoring.hotspots(_SYM(s, d), _REL(s, d)).select("id", "name", "kind", F.col("score").cast("long").alias("score"), "risk"),
    "a13_coverage": lambda s, d: scoring.coverage(_SPE(s, d), _REL(s, d), _SPE(s, d)),
    "a15_specs_by_workspace": lambda s, d: _SPE(s, d).groupBy("workspace").agg(F.count(F.lit(1)).alias("specs")),
    "a21_repeated_keys": lambda s, d: load(s, d, "files").groupBy("path").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"),
    "w01_change_state": lambda s, d: _changes_state(s, d),
    "w06_last_file_row": lambda s, d: ev.last_row(load(s, d, "files").where("indexed_at is not null").select("path", "workspace", "indexed_at"), "path", "indexed_at").select("path", "indexed_at"),
    "w08_method_parents": lambda s, d: ev.method_parents(_SYM(s, d)),
    "t04_second_page": lambda s, d: _page(s, d, limit=25, number=2),
    "t05_after_cursor": lambda s, d: _page(s, d, limit=25, after=("m", ""), keys=("spec_id", "spec_id")),
    "t06_page_meta": lambda s, d: lists.page_meta(_SPE(s, d).select("spec_id"), _page(s, d, limit=25, number=2), 25, 2).select(F.col("total").cast("long").alias("total"), F.col("count").cast("long").alias("count"), "limit", "page", "more"),
    "q01_search_symbols": lambda s, d: _bm25(s, d, "symbols", "rank Section"),
    "q02_search_specs": lambda s, d: _bm25(s, d, "specs", "index-session queue"),
    "q03_search_documents": lambda s, d: _bm25(s, d, "documents", "outline.filter"),
    "q07_search_specs_stemmed": lambda s, d: _bm25(s, d, "specs", "indexed sessions", True),
    "q18_symbol_snippets": lambda s, d: search.symbol_snippets(search.symbols(_SYM(s, d), "log event", 20), _FIL(s, d)).select("id", "start_line", "end_line", "snippet"),
}


def _walk_sql(step: str, seeds: str, depth: int | str, tail: str = "") -> str:
    return f", step AS ({step}), w AS (SELECT root, id, 0 AS depth FROM ({seeds}) UNION SELECT w.root, s.b, w.depth + 1 FROM w JOIN step s ON s.a = w.id WHERE w.depth < {depth}), r AS (SELECT root, id, min(depth) AS depth FROM w GROUP BY root, id) " + (tail or "SELECT root, id, CAST(depth AS INTEGER) AS depth FROM r WHERE depth > 0")


_LINKS = "('CALLS', 'CONSTRUCTS', 'USES_TYPE', 'EXTENDS', 'IMPLEMENTS', 'OVERRIDES')"
_UP = f"SELECT DISTINCT target AS a, source AS b FROM rel WHERE type IN {_LINKS} AND source IN (SELECT id FROM sym)"
_DOWN = f"SELECT DISTINCT source AS a, target AS b FROM rel WHERE type IN {_LINKS} AND target IN (SELECT id FROM sym)"
_UP_FILES = _UP + " UNION SELECT s.id, t.id FROM sym s JOIN rel r ON r.type = 'IMPORTS' AND r.target = s.file_path JOIN sym t ON t.file_path = r.source"
_DOWN_FILES = _DOWN + " UNION SELECT s.id, e.target FROM sym s JOIN rel r ON r.type = 'IMPORTS' AND r.source = s.file_path JOIN rel e ON e.type = 'EXPORTS' AND e.source = r.target WHERE e.target IN (SELECT id FROM sym)"
_ONE = lambda *ids: "SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{i}')" for i in ids) + ") t(root, id)"
_NAMED = lambda name: f"SELECT id AS root, id FROM sym WHERE name = '{name}'"
_RISK = "CASE WHEN {t} >= 20 THEN 'CRITICAL' WHEN {d} >= 6 OR {t} >= 10 THEN 'HIGH' WHEN {d} >= 3 OR {t} > {d} THEN 'MEDIUM' ELSE 'LOW' END"
_SCORES = f"""
, c AS (SELECT r.target AS id, sum(CASE WHEN split_part(t.file_path, ':', 1) = split_part(s.file_path, ':', 1) THEN 1 ELSE 0 END) AS same, sum(CASE WHEN split_part(t.file_path, ':', 1) = split_part(s.file_path, ':', 1) THEN 0 ELSE 1 END) AS crossed FROM rel r JOIN sym t ON t.id = r.target JOIN sym s ON s.id = r.source WHERE r.type IN ('CALLS', 'CONSTRUCTS', 'USES_TYPE') GROUP BY r.target),
i AS (SELECT target AS path, count(DISTINCT source) AS n FROM rel WHERE type = 'IMPORTS' GROUP BY target),
h AS (SELECT target AS id, count(*) FILTER (type = 'EXTENDS') AS e, count(*) FILTER (type = 'IMPLEMENTS') AS m, count(*) FILTER (type = 'OVERRIDES') AS o FROM rel WHERE type IN ('EXTENDS', 'IMPLEMENTS', 'OVERRIDES') GROUP BY target),
a AS (SELECT s.id, s.name, s.kind, s.file_path, coalesce(c.same, 0) AS same, coalesce(c.crossed, 0) AS crossed, coalesce(i.n, 0) AS imp, coalesce(h.e, 0) AS e, coalesce(h.m, 0) AS m, coalesce(h.o, 0) AS o FROM sym s LEFT JOIN c ON c.id = s.id LEFT JOIN i ON i.path = s.file_path LEFT JOIN h ON h.id = s.id),
b AS (SELECT *, same + crossed AS callers, 3 * e + 4 * m + 2 * o AS weight FROM a),
scores AS (SELECT id, name, kind, file_path, callers, weight, CAST(2 * same + 4 * crossed + weight + CASE WHEN callers > 0 OR weight > 0 THEN least(imp, greatest(callers, 1)) ELSE imp END AS BIGINT) AS score, {_RISK.format(d="(callers + e + m)", t="(callers + imp + weight)")} AS risk FROM b WHERE callers > 0 OR weight > 0 OR imp > 0)
"""


def _search_sql(table: str, key: str, canonical: str, alternate: str, text: str, query: str) -> str:
    from quern.functions.text import expand_query

    normal, raw, tokens = expand_query(query)
    words = list(dict.fromkeys(t for token in tokens for t in search._plain(token)))
    ids = ["a", "b"]
    one = lambda x, t: f"CASE WHEN {x} = '{t}' THEN 40 WHEN starts_with({x}, '{t}') THEN 30 WHEN ends_with({x}, '{t}') THEN 20 WHEN instr(' ' || translate({x}, ':/_.-', '     ') || ' ', ' {t} ') > 0 THEN 15 WHEN contains({x}, '{t}') THEN 10 ELSE 0 END"
    each = [f"greatest({', '.join(one(x, t) for x in ids)})" for t in tokens]
    prefix = f" WHEN starts_with(a, '{normal}') OR starts_with(b, '{normal}') THEN 3" if len(raw) == 1 else ""
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{k}" for k, t in enumerate(words))
    df = ", ".join(f"count(*) FILTER (t{k} > 0) AS d{k}" for k in range(len(words)))
    score = " + ".join(f"ln(1 + (docs - d{k} + 0.5) / (d{k} + 0.5)) * t{k} * 2.2 / (t{k} + 1.2 * (0.25 + 0.75 * n / av))" for k in range(len(words)))
    return f""", base AS (SELECT {key}, lower(coalesce({canonical}, '')) AS a, lower(coalesce({alternate}, '')) AS b, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}),
tfs AS (SELECT *, len(w) AS n, {tf} FROM base), corpus AS (SELECT count(*) AS docs, avg(n) AS av, {df} FROM tfs),
res AS (SELECT {key}, greatest(CASE WHEN a = '{normal}' THEN 5 WHEN b = '{normal}' THEN 4{prefix} ELSE 1 END, CASE WHEN {' + '.join(each)} > 0 THEN 2 ELSE 1 END) AS tier, {' + '.join(f'CASE WHEN {e} > 0 THEN 1 ELSE 0 END' for e in each)} AS hits, {' + '.join(each)} AS strength, round({score}, 6) AS bm25 FROM tfs, corpus)
SELECT {key}, CAST(tier AS INTEGER) AS tier, CAST(hits AS INTEGER) AS hits, CAST(strength AS INTEGER) AS strength, bm25 FROM res WHERE bm25 > 0 OR hits > 0"""


def _symbol_search(query: str) -> str:
    return _search_sql("sym", "id", "id", "name", f"concat_ws(' ', CASE WHEN {'{x}'} = lower(name) THEN name ELSE name || ' ' || {'{x}'} END, coalesce(comment, ''))".replace("{x}", "lower(trim(replace(replace(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '_', ' '), '-', ' ')))"), query)


def symbol_search_sql(query: str) -> str:
    return with_graph(_symbol_search(query))


_EDGE = "SELECT source, target, type FROM rel WHERE "
_IMPACT = (
    f", up AS ({_UP}), w AS (SELECT root, id, 0 AS depth FROM ({_ONE(HUB, SINK)}) UNION SELECT w.root, s.b, w.depth + 1 FROM w JOIN up s ON s.a = w.id WHERE w.depth < 3), r AS (SELECT root, least(d, 3) AS k, count(*) AS s FROM (SELECT root, id, min(depth) AS d FROM w GROUP BY root, id) WHERE d > 0 GROUP BY 1, 2),"
    f" fw AS (SELECT root, s.file_path AS id, 0 AS depth FROM ({_ONE(HUB, SINK)}) t JOIN sym s ON s.id = t.id UNION SELECT fw.root, r.source, fw.depth + 1 FROM fw JOIN rel r ON r.type = 'IMPORTS' AND r.target = fw.id WHERE fw.depth < 3), f AS (SELECT root, least(d, 3) AS k, count(*) AS f FROM (SELECT root, id, min(depth) AS d FROM fw GROUP BY root, id) WHERE d > 0 GROUP BY 1, 2),"
    f" b AS (SELECT coalesce(r.root, f.root) AS root, coalesce(r.k, f.k) AS k, greatest(coalesce(s, 0), coalesce(f.f, 0)) AS n FROM r FULL JOIN f ON r.root = f.root AND r.k = f.k),"
    f" t AS (SELECT o.root, CAST(coalesce(sum(n) FILTER (k = 1), 0) AS BIGINT) AS direct, CAST(coalesce(sum(n) FILTER (k = 2), 0) AS BIGINT) AS indirect, CAST(coalesce(sum(n) FILTER (k = 3), 0) AS BIGINT) AS transitive FROM ({_ONE(HUB, SINK)}) o LEFT JOIN b ON b.root = o.root GROUP BY o.root)"
    f" SELECT *, direct + indirect + transitive AS total, {_RISK.format(d='direct', t='(direct + indirect + transitive)')} AS risk FROM t"
)

SQL = {
    name: with_graph(sql, recursive)
    for name, (sql, recursive) in {
        "g01_callers": (_EDGE + f"type IN ('CALLS', 'CONSTRUCTS', 'USES_TYPE') AND target = '{HUB}'", False),
        "g02_callees": (_EDGE + f"type IN ('CALLS', 'CONSTRUCTS', 'USES_TYPE') AND source = '{SINK}'", False),
        "g03_importers": (_EDGE + f"type = 'IMPORTS' AND target = '{_FILE}'", False),
        "g03_importees": (_EDGE + f"type = 'IMPORTS' AND source = '{HUB_FILE}'", False),
        "g04_extenders": ("SELECT source, target FROM rel WHERE type = 'EXTENDS'", False),
        "g05_implementors": ("SELECT source, target FROM rel WHERE type = 'IMPLEMENTS'", False),
        "g07_spec_dependencies": (_EDGE + f"type = 'DEPENDS_ON' AND source = '{_SPEC}'", False),
        "g08_covered_files": ("SELECT source, target FROM rel WHERE type = 'COVERS_FILE'", False),
        "g09_covered_symbols": ("SELECT source, target FROM rel WHERE type = 'COVERS_SYMBOL'", False),
        "g10_upstream": (_walk_sql(_UP_FILES, _ONE(HUB), 3), True),
        "g10_upstream_symbols_only": (_walk_sql(_UP, _NAMED("to_string"), 3), True),
        "g11_downstream": (_walk_sql(_DOWN_FILES, _ONE(SINK), 3), True),
        "g11_downstream_many": (_walk_sql(_DOWN, _NAMED("toString"), 3), True),
        "g12_truncated": (_walk_sql(_DOWN, _NAMED("to_string"), 3, "SELECT root, coalesce(bool_or(depth = 3), false) AS truncated FROM r GROUP BY root"), True),
        "g13_impact_summary": (_IMPACT, True),
        "g15_file_reach": (_walk_sql("SELECT target AS a, source AS b FROM rel WHERE type = 'IMPORTS'", _ONE(_FILE), 3), True),
        "g18_spec_impact": (
            _walk_sql("SELECT target AS a, source AS b FROM rel WHERE type = 'DEPENDS_ON' AND source IN (SELECT spec_id FROM spe)", "SELECT spec_id AS root, spec_id AS id FROM spe", 3, ", m AS (SELECT r.root, e.target, s.file_path FROM r JOIN rel e ON e.type = 'COVERS_SYMBOL' AND e.source = r.id JOIN sym s ON s.id = e.target) SELECT root, 'spec' AS kind, id AS item FROM r WHERE depth > 0 UNION SELECT r.root, 'file', e.target FROM r JOIN rel e ON e.type = 'COVERS_FILE' AND e.source = r.id UNION SELECT root, 'file', file_path FROM m UNION SELECT root, 'symbol', target FROM m"),
            True,
        ),
        "g19_detect_changes": (
            _walk_sql(_UP_FILES, f"SELECT id AS root, id FROM sym WHERE file_path IN ('{HUB_FILE}', '{_FILE}')", 3, f", k AS (SELECT root AS id, count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 0) AS total FROM r GROUP BY root) SELECT *, {_RISK.format(d='direct', t='total')} AS risk FROM k"),
            True,
        ),
        "g21_dependency_closure": (_walk_sql("SELECT source AS a, target AS b FROM rel WHERE type = 'DEPENDS_ON'", "SELECT spec_id AS root, spec_id AS id FROM spe", "(SELECT count(*) FROM spe)"), True),
        "g24_roots": ("SELECT spec_id FROM spe WHERE spec_id NOT IN (SELECT source FROM rel WHERE type = 'DEPENDS_ON')", False),
        "j01_caller_rows": ("SELECT r.target, t.file_path AS target_file, r.source, s.file_path AS source_file, r.type FROM rel r JOIN sym t ON t.id = r.target JOIN sym s ON s.id = r.source WHERE r.type IN ('CALLS', 'CONSTRUCTS', 'USES_TYPE')", False),
        "j13_enclosing_symbols": (", f AS (SELECT DISTINCT s.file_path, CAST(r.metadata['line'] AS INTEGER) AS line, r.source AS fact_source, r.target AS fact_target FROM relations r JOIN sym s ON s.id = r.source WHERE r.metadata['line'] IS NOT NULL), d AS (SELECT f.*, s.id, row_number() OVER (PARTITION BY f.file_path, f.line, f.fact_source, f.fact_target ORDER BY s.line DESC, s.column_number DESC, s.id DESC) AS n FROM f LEFT JOIN sym s ON s.file_path = f.file_path AND s.line <= f.line) SELECT file_path, line, fact_source, fact_target, id AS enclosing_id FROM d WHERE n = 1", False),
        "a01_node_counts": ("SELECT (SELECT count(*) FROM fil2) AS files, (SELECT count(*) FROM doc) AS documents, (SELECT count(*) FROM sym) AS symbols, (SELECT count(*) FROM spe) AS specs", False),
        "a02_edge_counts": ("SELECT t.type, count(r.source) AS edges FROM (VALUES ('IMPORTS'),('DEFINES'),('CALLS'),('CONSTRUCTS'),('USES_TYPE'),('EXPORTS'),('DEPENDS_ON'),('COVERS_FILE'),('COVERS_SYMBOL'),('EXTENDS'),('IMPLEMENTS'),('OVERRIDES')) t(type) LEFT JOIN rel r ON r.type = t.type GROUP BY t.type", False),
        "a03_languages": ("SELECT DISTINCT language FROM fil2 WHERE language IS NOT NULL", False),
        "a04_direct_callers": (_SCORES + "SELECT id, CAST(same AS BIGINT) AS same_ws, CAST(crossed AS BIGINT) AS cross_ws FROM c", False),
        "a05_importers": (_SCORES + "SELECT path, n AS importers FROM i", False),
        "a06_hierarchy": (_SCORES + "SELECT id, e AS extenders, m AS implementors, o AS overriders FROM h", False),
        "a07_scores": (_SCORES + "SELECT id, score, risk FROM scores", False),
        "a09_max_risk": (_SCORES + "SELECT split_part(file_path, ':', 1) AS workspace, arg_max(risk, CASE risk WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END) AS risk FROM scores WHERE callers > 0 OR weight > 0 GROUP BY 1", False),
        "a10_hotspots": (_SCORES + "SELECT id, name, kind, score, risk FROM scores WHERE (callers > 0 OR weight > 0) AND kind IN ('class', 'method', 'function') AND risk <> 'LOW' ORDER BY score DESC, id LIMIT 20", False),
        "a13_coverage": ("SELECT s.spec_id, true AS found, count(DISTINCT r.target) FILTER (r.type = 'COVERS_FILE') AS files, count(DISTINCT r.target) FILTER (r.type = 'COVERS_SYMBOL') AS symbols FROM spe s LEFT JOIN rel r ON r.source = s.spec_id AND r.type IN ('COVERS_FILE', 'COVERS_SYMBOL') GROUP BY s.spec_id", False),
        "a15_specs_by_workspace": ("SELECT workspace, count(*) AS specs FROM spe GROUP BY workspace", False),
        "w08_method_parents": ("SELECT id, owner_id FROM (SELECT id, kind, last_value(CASE WHEN kind IN ('class', 'interface') THEN id END IGNORE NULLS) OVER (PARTITION BY file_path ORDER BY line, column_number, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS owner_id FROM sym) WHERE kind = 'method'", False),
        "t04_second_page": ("SELECT spec_id, title FROM spe ORDER BY spec_id LIMIT 25 OFFSET 25", False),
        "t05_after_cursor": ("SELECT spec_id, title FROM spe WHERE spec_id > 'm' ORDER BY spec_id LIMIT 25", False),
        "t06_page_meta": ("SELECT count(*) AS total, greatest(least(count(*) - 25, 25), 0) AS count, 25 AS limit, 2 AS page, count(*) > 50 AS more FROM spe", False),
        "q01_search_symbols": (_symbol_search("rank Section"), False),
        "q02_search_specs": (_search_sql("spe", "spec_id", "spec_id", "title", "concat_ws(' ', spec_id, title, description, content)", "index-session queue"), False),
        "q03_search_documents": (_search_sql("doc", "path", "path", "config_relative_path", "concat_ws(' ', path, config_relative_path, content)", "outline.filter"), False),
    }.items()
} | {
    "a21_repeated_keys": "SELECT path, count(*) AS rows FROM files GROUP BY path HAVING count(*) > 1",
    "w06_last_file_row": "SELECT path, max(indexed_at) AS indexed_at FROM files WHERE indexed_at IS NOT NULL GROUP BY path",
    "w01_change_state": """WITH l AS (SELECT user_id AS change, event_id AS seq, ts AS "at", CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'signed-off' WHEN 'error' THEN 'invalidated' ELSE 'transitioned' END AS type, CASE event_type WHEN 'view' THEN 'implementing' WHEN 'click' THEN 'verifying' END AS st FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY change ORDER BY "at", seq) AS n FROM l)
SELECT change, coalesce(arg_max(st, n) FILTER (type = 'transitioned'), 'drafting') AS state, false AS drafted, false AS approved, coalesce(max(n) FILTER (type = 'signed-off') > coalesce(max(n) FILTER (type = 'invalidated'), 0), false) AS signed_off, min("at") FILTER (st = 'implementing') AS implementing_at, arg_max("at", n) FILTER (type = 'invalidated') AS invalidated_at, count(*) AS events FROM k GROUP BY change""",
}
