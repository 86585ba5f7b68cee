"""Tables of a data folder, and the fixed vocabulary of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Relation types in their order, and the groups that operators use.
RELATION_TYPES = [
    "IMPORTS", "DEFINES", "CALLS", "CONSTRUCTS", "USES_TYPE", "EXPORTS",
    "DEPENDS_ON", "COVERS_FILE", "COVERS_SYMBOL", "EXTENDS", "IMPLEMENTS", "OVERRIDES",
]
DEPENDENCY = ["CALLS", "CONSTRUCTS", "USES_TYPE"]
HIERARCHY = ["EXTENDS", "IMPLEMENTS", "OVERRIDES"]
RISK_LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def workspace_of(key: Column) -> Column:
    """The text before the first colon, or all of it."""
    return F.substring_index(key, ":", 1)


def graph(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The graph tables as operators want them: one row a key, kinds and types in one spelling.

    Repeated files keep their latest ``indexed_at``; all other repeats are exact, and should they differ each column takes
    its smallest value, so every table is a function of its key. Null keys name nothing and are left out. Columns are
    aggregated apart: what a query does not use is neither read nor shuffled, contents above all.
    """
    read = lambda name: load(spark, folder, name)
    return {"files": files_of(read("files")), "symbols": symbols_of(read("symbols")), "relations": relations_of(read("relations")), "specs": specs_of(read("specs")), "docnodes": docnodes_of(read("docnodes"))}


def files_of(raw: DataFrame) -> DataFrame:
    cols = ["config_relative_path", "language", "content_hash", "workspace", "content"]
    order = F.struct(F.coalesce("indexed_at", F.lit("1970-01-01").cast("timestamp_ntz")), "content_hash")
    return raw.where("path is not null").groupBy("path").agg(*[F.max_by(c, order).alias(c) for c in cols])


def _one_each(raw: DataFrame, key: str, cols: list[str]) -> DataFrame:
    return raw.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.min(c).alias(c) for c in cols])


def symbols_of(raw: DataFrame) -> DataFrame:
    return _one_each(raw, "id", ["name", "kind", "file_path", "line", "column_number", "parent_id", "comment"]).withColumn("kind", F.lower(F.trim("kind")))


def specs_of(raw: DataFrame) -> DataFrame:
    return _one_each(raw, "spec_id", ["path", "title", "description", "content_hash", "content", "depends_on", "workspace"])


def docnodes_of(raw: DataFrame) -> DataFrame:
    return _one_each(raw, "path", ["config_relative_path", "content_hash", "content", "workspace"])


def relations_of(raw: DataFrame) -> DataFrame:
    """Distinct (source, target, type) with the type in capitals."""
    return raw.where("source is not null and target is not null and type is not null").select("source", "target", F.upper(F.trim("type")).alias("type")).distinct()
