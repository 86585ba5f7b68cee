"""What the SQL counterparts share: the graph tables as :func:`quern.tables.graph` gives them."""

HUB_FILE = "platform-core:src/shared/kernel/log-event.ts"
HUB = HUB_FILE + ":function:logEvent:10:0"
SINK = HUB_FILE + ":interface:LogSink:3:0"

GRAPH = """
fil AS (SELECT path, arg_max(struct_pack(config_relative_path, language, content_hash, workspace, content), coalesce(indexed_at, TIMESTAMP '1970-01-01')) AS r FROM files WHERE path IS NOT NULL GROUP BY path),
fil2 AS (SELECT DISTINCT path, r.config_relative_path, r.language, r.content_hash, r.workspace, r.content FROM fil),
sym AS (SELECT DISTINCT id, name, lower(trim(kind)) AS kind, file_path, line, column_number, parent_id, comment FROM symbols WHERE id IS NOT NULL),
rel AS (SELECT DISTINCT source, target, upper(trim(type)) AS type FROM relations WHERE source IS NOT NULL AND target IS NOT NULL AND type IS NOT NULL),
spe AS (SELECT DISTINCT spec_id, path, title, description, content_hash, content, depends_on, workspace FROM specs WHERE spec_id IS NOT NULL),
doc AS (SELECT DISTINCT path, config_relative_path, content_hash, content, workspace FROM docnodes WHERE path IS NOT NULL)
"""


def with_graph(sql: str, recursive: bool = False) -> str:
    """The query after the graph tables; it may begin with more of them and a comma."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{GRAPH.strip()}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
