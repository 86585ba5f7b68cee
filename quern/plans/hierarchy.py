"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import hierarchy
from quern.tables import load


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.endless(load(spark, folder, "symbols").select("id", "parent_id")).select(F.col("id").alias("symbol_id"))


def p5_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    out = hierarchy.resolve(load(spark, folder, "symbols").select("id", "parent_id"), paths=True)
    return out.select(F.col("id").alias("symbol_id"), "root", "depth", "endless", F.array_join("path", " > ").alias("path"))


def p5_descendants(spark: SparkSession, folder: str) -> DataFrame:
    out = hierarchy.descendants(hierarchy.resolve(load(spark, folder, "symbols").select("id", "parent_id"), paths=True))
    return out.select("ancestor", "descendant", "distance")


QUERIES = {"p5_found": p5_found, "p5_hierarchy": p5_hierarchy, "p5_descendants": p5_descendants}

_WALK = """
WITH RECURSIVE ids AS (SELECT DISTINCT id FROM symbols WHERE id IS NOT NULL),
up AS (SELECT i.id, min(p.id) AS parent FROM ids i LEFT JOIN symbols s ON s.id = i.id LEFT JOIN ids p ON p.id = s.parent_id AND s.parent_id <> '' GROUP BY i.id),
walk AS (
  SELECT id, id AS root, CAST(0 AS BIGINT) AS depth, [id] AS path FROM up WHERE parent IS NULL
  UNION ALL
  SELECT u.id, w.root, w.depth + 1, list_append(w.path, u.id) FROM walk w JOIN up u ON u.parent = w.id
)
"""

SQL = {
    "p5_found": _WALK + "SELECT i.id AS symbol_id FROM ids i WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.id = i.id)",
    "p5_hierarchy": _WALK + "SELECT i.id AS symbol_id, w.root, w.depth, w.id IS NULL AS endless, array_to_string(w.path, ' > ') AS path FROM ids i LEFT JOIN walk w ON w.id = i.id",
    "p5_descendants": _WALK + "SELECT a.ancestor, a.id AS descendant, a.depth - a.pos + 1 AS distance FROM (SELECT id, depth, unnest(path[1:len(path)-1]) AS ancestor, generate_subscripts(path[1:len(path)-1], 1) AS pos FROM walk) a",
}
