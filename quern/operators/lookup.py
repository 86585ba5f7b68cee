"""Point lookups, filters, selector resolution. Filters on stored columns reach the scan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as tx


def by_key(table: DataFrame, key: str, value: str) -> DataFrame:
    return table.where(F.col(key) == value)


def find_symbols(symbols: DataFrame, kind: str | None = None, file_path: str | None = None, file_paths: list[str] | None = None, parent: str | None = None, name: str | None = None, comment: str | None = None, case_sensitive: bool = False) -> DataFrame:
    """All given conditions hold; ``*`` in path or name makes a glob. Null comments count as empty."""
    fold = (lambda c: c) if case_sensitive else F.lower
    same = (lambda s: s) if case_sensitive else str.lower
    if kind is not None:
        symbols = symbols.where(F.col("kind") == kind)
    if file_path is not None:
        symbols = symbols.where(F.col("file_path").rlike(tx.path_glob(file_path)) if "*" in file_path else F.col("file_path") == file_path)
    if file_paths is not None:
        symbols = symbols.where(F.col("file_path").isin(list(file_paths)))
    if parent is not None:
        symbols = symbols.where(F.col("parent_id") == parent)
    if name is not None:
        symbols = symbols.where(F.col("name").rlike(tx.name_glob(name, case_sensitive)) if "*" in name else fold(F.col("name")) == same(name))
    if comment is not None:
        symbols = symbols.where(F.contains(fold(F.coalesce("comment", F.lit(""))), F.lit(same(comment))))
    return symbols


def search_filter(symbols: DataFrame, kinds: list[str] | None = None, file_pattern: str | None = None, workspace: str | None = None, exclude_paths: list[str] = (), exclude_workspaces: list[str] = ()) -> DataFrame:
    if kinds:
        symbols = symbols.where(F.col("kind").isin(list(kinds)))
    if file_pattern:
        symbols = symbols.where(F.col("file_path").rlike(tx.path_glob(file_pattern)))
    if workspace:
        symbols = symbols.where(F.col("file_path").startswith(workspace + ":"))
    return symbols.where(~tx.excluded(F.col("file_path"), F.substring_index("file_path", ":", 1), exclude_paths, exclude_workspaces))


def exported_symbols(symbols: DataFrame, relations: DataFrame, file_path: str) -> DataFrame:
    edges = relations.where((F.col("type") == "EXPORTS") & (F.col("source") == file_path)).select(F.col("target").alias("id"))
    return symbols.join(edges, "id", "left_semi")


def _first_that_answers(parts: list[DataFrame]) -> DataFrame:
    """Rows of the first of several lookups that has any."""
    out = parts[0].withColumn("rank", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        out = out.unionByName(part.withColumn("rank", F.lit(k)))
    best = out.agg(F.min("rank").alias("best"))
    return out.join(F.broadcast(best), out["rank"] == best["best"]).drop("rank", "best")


def resolve_file(files: DataFrame, docnodes: DataFrame, selector: str) -> DataFrame:
    """Paths for a file selector: exact path in either table, else equal config-relative path."""
    both = files.select("path", "config_relative_path").unionByName(docnodes.select("path", "config_relative_path"))
    normal = selector.replace("\\", "/").removeprefix("./")
    exact = both.where(F.col("path") == normal).select("path")
    relative = both.where(tx.normal_path(F.col("config_relative_path")) == normal).select("path")
    return _first_that_answers([exact, relative]).distinct()


def resolve_symbol(symbols: DataFrame, selector: str) -> DataFrame:
    """Ids for a symbol selector: exact id, ``file:kind:name:line:col``, ``file:kind:name`` or ``file:name``, bare name."""
    parts = [symbols.where(F.col("id") == selector).select("id")]
    m = re.fullmatch(r"(.+):([a-zA-Z]+):([^:]+):(\d+):(\d+)", selector)
    if m:
        parts.append(symbols.where((F.col("file_path") == m[1]) & (F.col("kind") == m[2].lower()) & (F.col("name") == m[3]) & (F.col("line") == int(m[4])) & (F.col("column_number") == int(m[5]))).select("id"))
    m = re.fullmatch(r"(.+):([a-zA-Z]+):([^:]+)", selector)
    n = re.fullmatch(r"(.+):([^:]+)", selector)
    if m or n:
        hit = F.lit(False)
        if m:
            hit = hit | ((F.col("file_path") == m[1]) & (F.col("kind") == m[2].lower()) & (F.col("name") == m[3]))
        if n:
            hit = hit | ((F.col("file_path") == n[1]) & (F.col("name") == n[2]))
        parts.append(symbols.where(hit).select("id"))
    parts.append(symbols.where(F.col("name") == selector).select("id"))
    return _first_that_answers(parts).distinct()


def require_one(found: DataFrame, selector: str) -> str:
    """The only answer; none and several are errors."""
    rows = found.limit(2).collect()
    if not rows:
        raise LookupError(f"nothing matches {selector}")
    if len(rows) > 1:
        raise LookupError(f"{selector} is ambiguous")
    return rows[0][0]


def spec_pattern(spec_id: Column, pattern: str) -> Column:
    """``*`` and ``ALL`` match all, ``prefix/*`` what begins so, anything else itself."""
    if pattern in ("*", "ALL"):
        return F.lit(True)
    return spec_id.startswith(pattern[:-1]) if pattern.endswith("/*") else spec_id == pattern
