"""Counts, hotspot scores, risk levels and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.tables import DEPENDENCY, RELATION_TYPES, RISK_LEVELS


def risk_level(direct, total, processes=0) -> Column:
    """LOW to CRITICAL from direct and all dependents and affected processes; negatives count as 0."""
    col = lambda x: F.greatest(F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x, F.lit(0))
    d, t, p = col(direct), col(total), col(processes)
    return F.when((t >= 20) | (p >= 3), "CRITICAL").when((d >= 6) | (t >= 10), "HIGH").when((d >= 3) | (t > d), "MEDIUM").otherwise("LOW")


def risk_order(risk: Column) -> Column:
    out = F.when(risk == RISK_LEVELS[0], 0)
    for k, name in enumerate(RISK_LEVELS[1:], 1):
        out = out.when(risk == name, k)
    return out


def max_risk(rows: DataFrame, key: str, risk: str = "risk") -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(risk, risk_order(F.col(risk))).alias("risk"))


def edge_counts(relations: DataFrame) -> DataFrame:
    """Distinct edges of every type, zero where there are none."""
    types = relations.sparkSession.createDataFrame([(t,) for t in RELATION_TYPES], "type string")
    got = relations.select("source", "target", "type").distinct().groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return types.join(got, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("edges"))


def caller_rows(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """One row per dependency edge between two symbols, with both files."""
    edges = relations.where(F.col("type").isin(DEPENDENCY)).select("source", "target", "type")
    callee = symbols.select(F.col("id").alias("target"), F.col("file_path").alias("target_file"))
    caller = symbols.select(F.col("id").alias("source"), F.col("file_path").alias("source_file"))
    return edges.join(callee, "target").join(caller, "source").select("target", "target_file", "source", "source_file", "type")


def direct_callers(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """Per symbol, callers of the same and of other workspaces, counted by edge."""
    rows = caller_rows(symbols, relations)
    same = F.substring_index("target_file", ":", 1) == F.substring_index("source_file", ":", 1)
    return rows.groupBy(F.col("target").alias("id")).agg(F.sum(F.when(same, 1).otherwise(0)).alias("same_ws"), F.sum(F.when(same, 0).otherwise(1)).alias("cross_ws"))


def importer_counts(relations: DataFrame) -> DataFrame:
    return relations.where("type = 'IMPORTS'").select("target", "source").distinct().groupBy(F.col("target").alias("path")).agg(F.count(F.lit(1)).alias("importers"))


def hierarchy_counts(relations: DataFrame) -> DataFrame:
    one = lambda t: F.sum(F.when(F.col("type") == t, 1).otherwise(0))
    return relations.where(F.col("type").isin("EXTENDS", "IMPLEMENTS", "OVERRIDES")).groupBy(F.col("target").alias("id")).agg(one("EXTENDS").alias("extenders"), one("IMPLEMENTS").alias("implementors"), one("OVERRIDES").alias("overriders"))


def scored(symbols: DataFrame, relations: DataFrame, importer_only: bool = False) -> DataFrame:
    """Every symbol with evidence, its counts, score and risk.

    Score = 2·callers of the workspace + 4·callers of others + importers + 3·extenders + 4·implementors + 2·overriders; importers
    count up to the number of callers, at least 1; without callers or hierarchy all count, if such symbols are wanted.
    """
    s = symbols.select("id", "name", "kind", "file_path", "line")
    s = s.join(direct_callers(symbols, relations), "id", "left").join(importer_counts(relations).withColumnRenamed("path", "file_path"), "file_path", "left").join(hierarchy_counts(relations), "id", "left").fillna(0)
    callers, weight = F.col("same_ws") + F.col("cross_ws"), 3 * F.col("extenders") + 4 * F.col("implementors") + 2 * F.col("overriders")
    evidence = (callers > 0) | (weight > 0)
    shown = evidence | (F.lit(importer_only) & (F.col("importers") > 0))
    part = F.when(evidence, F.least("importers", F.greatest(callers, F.lit(1)))).otherwise(F.col("importers"))
    return s.where(shown).withColumn("score", 2 * F.col("same_ws") + 4 * F.col("cross_ws") + part + weight).withColumn("risk", risk_level(callers + F.col("extenders") + F.col("implementors"), callers + F.col("importers") + weight))


def hotspots(symbols: DataFrame, relations: DataFrame, kinds: list[str] | None = None, min_score: int = 1, min_risk: str = "MEDIUM", limit: int | None = 20, importer_only: bool = False, workspace: str | None = None, file_path: str | None = None, exclude_paths: list[str] = (), exclude_workspaces: list[str] = ()) -> DataFrame:
    """Symbols by score, ties by id; kinds default to class, method and function."""
    kinds = ["class", "method", "function"] if kinds is None else kinds
    out = scored(symbols, relations, importer_only).where((F.col("score") >= min_score) & (risk_order(F.col("risk")) >= RISK_LEVELS.index(min_risk)))
    if kinds:
        out = out.where(F.col("kind").isin(kinds))
    if workspace:
        out = out.where(F.col("file_path").startswith(workspace + ":"))
    if file_path:
        out = out.where(F.col("file_path") == file_path)
    out = out.where(~tx.excluded(F.col("file_path"), F.substring_index("file_path", ":", 1), exclude_paths, exclude_workspaces))
    ordered = out.orderBy(F.desc("score"), "id")
    return ordered if limit is None else ordered.limit(limit)


def coverage(specs: DataFrame, relations: DataFrame, wanted: DataFrame) -> DataFrame:
    """Distinct covered files and symbols of each wanted spec_id, and whether the spec exists."""
    got = relations.where(F.col("type").isin("COVERS_FILE", "COVERS_SYMBOL")).groupBy(F.col("source").alias("spec_id")).agg(F.count_distinct(F.when(F.col("type") == "COVERS_FILE", F.col("target"))).alias("files"), F.count_distinct(F.when(F.col("type") == "COVERS_SYMBOL", F.col("target"))).alias("symbols"))
    known = specs.select("spec_id", F.lit(True).alias("found")).distinct()
    return wanted.select("spec_id").distinct().join(known, "spec_id", "left").join(got, "spec_id", "left").select("spec_id", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("symbols", F.lit(0)).alias("symbols"))


def task_counts(documents: DataFrame, key: str, done: str = r"^\s*[-*]\s+\[[xX]\]", open_: str = r"^\s*[-*]\s+\[ \]") -> DataFrame:
    """Done and open tasks per document and in all (null key)."""
    n = lambda pattern: F.regexp_count("content", F.lit(f"(?m){pattern}"))
    return documents.select(F.col(key), n(done).alias("d"), n(open_).alias("o")).rollup(key).agg(F.coalesce(F.sum("d"), F.lit(0)).alias("done"), F.coalesce(F.sum("o"), F.lit(0)).alias("open"))


def artifact_status(files: DataFrame, key: str = "artifact", state: str = "state") -> DataFrame:
    """Status of an artifact from its files' states, in order of priority."""
    some = lambda s: F.coalesce(F.bool_or(F.col(state) == s), F.lit(False))
    every = lambda *s: F.coalesce(F.bool_and(F.col(state).isin(*s)), F.lit(False))
    status = F.when(F.count(state) == 0, "missing").when(some("drifted-pending-review"), "drifted-pending-review").when(some("pending-review"), "pending-review").when(some("pending-parent-artifact-review"), "pending-parent-artifact-review")
    status = status.when(every("skipped"), "skipped").when(every("complete", "skipped"), "complete").when(every("missing"), "missing").otherwise("in-progress")
    return files.groupBy(key).agg(status.alias("status"))


def with_total(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds ``total_symbols``, the number of all symbols, whatever filters the rows have passed."""
    return rows.join(F.broadcast(symbols.agg(F.count(F.lit(1)).alias("total_symbols"))))  # one row


def change_coverage(changes: DataFrame, specs: DataFrame, relations: DataFrame) -> DataFrame:
    """Coverage of every spec of every change (change, spec_ids)."""
    each = changes.select("change", F.explode(F.array_distinct("spec_ids")).alias("spec_id"))
    return each.join(coverage(specs, relations, each), "spec_id").select("change", "spec_id", "found", "files", "symbols")


def health(items: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """(key, status, failures, warnings): failed with any failure, else warned with any warning, else passed. ``issues`` has key and severity."""
    n = lambda s: F.sum(F.when(F.col("severity") == s, 1).otherwise(0))
    per = issues.groupBy(key).agg(n("failure").alias("failures"), n("warning").alias("warnings"))
    out = items.select(key).distinct().join(per, key, "left").fillna(0, ["failures", "warnings"])
    return out.withColumn("status", F.when(F.col("failures") > 0, "failed").when(F.col("warnings") > 0, "warned").otherwise("passed")).select(key, "status", "failures", "warnings")


def health_totals(checked: DataFrame) -> DataFrame:
    """One row: total, passed, warned, failed of :func:`health`."""
    n = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0))
    return checked.agg(F.count(F.lit(1)).alias("total"), *[F.coalesce(n(s), F.lit(0)).alias(s) for s in ("passed", "warned", "failed")])
