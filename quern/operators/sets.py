"""Set relations, duplicates, overlaps, and keyed merges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["source", "target", "type"])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key is not written anew, and the new rows; of several new rows of a key the last in order counts."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def upsert_edges(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Edges by key with the metadata last written; ``order`` is a column of ``new``."""
    rest = [c for c in new.columns if c not in ("source", "target", "type")]
    last = new.groupBy("source", "target", "type").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("source", "target", "type", "_r.*").drop(order)
    return upsert(old, last, ["source", "target", "type"])


def remove_files(files: DataFrame, symbols: DataFrame, relations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables without the files in ``gone`` (path), their symbols, and every edge that touches either."""
    dead = symbols.join(gone.select(F.col("path").alias("file_path")), "file_path", "left_semi").select(F.col("id").alias("k")).unionByName(gone.select(F.col("path").alias("k"))).distinct()
    edges = relations.join(dead.withColumnRenamed("k", "source"), "source", "left_anti").join(dead.withColumnRenamed("k", "target"), "target", "left_anti")
    return files.join(gone, "path", "left_anti"), symbols.join(gone.select(F.col("path").alias("file_path")), "file_path", "left_anti"), edges


def file_diff(stored: DataFrame, current: DataFrame, key: str = "path", value: str = "content_hash") -> DataFrame:
    """(key, change): new, changed, same or deleted."""
    s = stored.select(F.col(key), F.col(value).alias("_s"), F.lit(True).alias("_in_s"))
    c = current.select(F.col(key), F.col(value).alias("_c"), F.lit(True).alias("_in_c"))
    kind = F.when(F.col("_in_s").isNull(), "new").when(F.col("_in_c").isNull(), "deleted").when(F.col("_s").eqNullSafe(F.col("_c")), "same").otherwise("changed")
    return s.join(c, key, "full_outer").select(key, kind.alias("change"))


def overlap(rows: DataFrame, item: str, owner: str) -> DataFrame:
    """Items that more than one owner aims at, with the owners' number and names in order."""
    return rows.select(item, owner).distinct().groupBy(item).agg(F.count(F.lit(1)).alias("owners"), F.min(owner).alias("first_owner"), F.max(owner).alias("last_owner")).where("owners > 1")


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def same_set(a: Column, b: Column) -> Column:
    return subset(a, b) & subset(b, a)


def same_sequence(a: Column, b: Column) -> Column:
    return a == b


def subsequence(a: Column, b: Column) -> Column:
    """Whether ``a`` is found in ``b`` in order, greedily."""
    taken = F.aggregate(b, F.lit(0), lambda k, x: F.when((k < F.size(a)) & (F.try_element_at(a, k + 1) == x), k + 1).otherwise(k))
    return taken == F.size(a)


def difference(a: Column, b: Column) -> Column:
    """Elements of ``a`` not in ``b``, once, in order."""
    return F.array_except(a, b)


def unique_target(candidates: DataFrame, fact: str, target: str) -> DataFrame:
    """Facts whose candidates name exactly one target; ambiguity gives no answer."""
    return candidates.groupBy(fact).agg(F.min(target).alias(target), F.max(target).alias("_hi")).where(F.col(target) == F.col("_hi")).drop("_hi")


def divides(parts: DataFrame, whole: DataFrame, key: str, owner: str, member: str) -> DataFrame:
    """(key, owner): keys of ``parts`` (key, member) that have every member of an owner in ``whole`` (owner, member); owners without members match nothing.

    Only keys that have the rarest member of an owner are candidates, so a member that everybody has multiplies nothing.
    """
    have, need = parts.select(key, member).distinct(), whole.select(owner, member).distinct()
    often = have.groupBy(member).agg(F.count(F.lit(1)).alias("_n"))
    rated = need.join(often, member, "left")
    rarest = rated.groupBy(owner).agg(F.min_by(member, F.struct(F.coalesce("_n", F.lit(0)), member)).alias(member), F.count(F.lit(1)).alias("_need"), F.count("_n").alias("_known"))
    candidates = rarest.where("_need = _known").join(have, member).select(key, owner, "_need")
    got = candidates.join(need, owner).join(have, [key, member], "left_semi").groupBy(key, owner, "_need").agg(F.count(F.lit(1)).alias("_got"))
    return got.where("_got = _need").select(key, owner)


def owner_of_edges(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_path, type, edges): edges by the file that owns their source, a symbol's file or the file itself."""
    own = symbols.select(F.col("id").alias("source"), "file_path")
    return relations.join(own, "source", "left").groupBy(F.coalesce("file_path", "source").alias("file_path"), "type").agg(F.count(F.lit(1)).alias("edges"))


def index_breakdown(change: DataFrame, workspace: Column) -> DataFrame:
    """Per workspace from (path, change) of :func:`file_diff`: discovered, indexed, skipped, removed."""
    n = lambda *kinds: F.sum(F.when(F.col("change").isin(*kinds), 1).otherwise(0))
    return change.groupBy(workspace.alias("workspace")).agg(n("new", "changed", "same").alias("discovered"), n("new", "changed").alias("indexed"), n("same").alias("skipped"), n("deleted").alias("removed"))


def prune(stored: DataFrame, current: DataFrame, key: str, workspace: str) -> DataFrame:
    """Keys that are stored and no longer there, of the workspaces that ``current`` covers; others are left alone."""
    seen = current.select(workspace).distinct()
    return stored.join(seen, workspace, "left_semi").join(current.select(key), key, "left_anti").select(key)


def chunks(items: DataFrame, key: str, size: str, budget: int, group: int = 50_000) -> DataFrame:
    """(part, chunk, key, size): items in chunks whose sizes add up to the budget at most; a larger item is alone.

    Items are dealt by hash into parts of about ``group`` and taken in order of the key within each, greedily, so a part
    is one task's bounded work. Null keys are left out, null sizes count as 0.
    """
    src = items.where(F.col(key).isNotNull()).select(key, F.coalesce(F.col(size), F.lit(0)).cast("long").alias(size))
    parts = max(1, -(-src.count() // group))
    kind = src.schema[key].dataType.simpleString()

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, ignore_index=True)
        chunk, full, out = -1, budget + 1, []
        for n in pdf[size].tolist():
            if full + n > budget:
                chunk, full = chunk + 1, 0
            full += n
            out.append(chunk)
        return pdf.assign(chunk=out)[["part", "chunk", key, size]]

    dealt = src.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    return dealt.groupBy("part").applyInPandas(take, f"part int, chunk int, {key} {kind}, {size} long")


def overrides(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """OVERRIDES edges (source, target): methods of a type and of its direct bases with the same name, those known left out."""
    bases = relations.where(F.col("type").isin("EXTENDS", "IMPLEMENTS")).select(F.col("source").alias("sub"), F.col("target").alias("base")).distinct()
    methods = symbols.where("kind = 'method'").select("id", "name", "parent_id")
    below = methods.select(F.col("id").alias("source"), "name", F.col("parent_id").alias("sub"))
    above = methods.select(F.col("id").alias("target"), "name", F.col("parent_id").alias("base"))
    found = bases.join(below, "sub").join(above, ["base", "name"]).select("source", "target").distinct()
    return found.join(relations.where("type = 'OVERRIDES'").select("source", "target"), ["source", "target"], "left_anti")


def selection(include: DataFrame, exclude: DataFrame, protected: DataFrame, key: str = "spec_id") -> DataFrame:
    """Included minus excluded keys, the protected ones always, each with its strongest source (``rank`` larger is stronger)."""
    kept = include.join(exclude.select(key).distinct(), key, "left_anti").unionByName(include.join(protected.select(key).distinct(), key, "left_semi")).unionByName(protected.select(*include.columns))
    return kept.groupBy(key).agg(F.max("rank").alias("rank"), F.max_by("source", "rank").alias("source"))


def merge_links(links: DataFrame) -> DataFrame:
    """Implementation links by (change, spec_id, file): symbols united, explicit if any is."""
    return links.groupBy("change", "spec_id", "file").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("symbols")))).alias("symbols"), F.bool_or("explicit").alias("explicit"))


def sweep_tracked(tracked: DataFrame, present: DataFrame) -> DataFrame:
    """Tracked files (file, status) against those present (file): missing ones are removed, reappeared and new ones open, ignored ones stay."""
    t, p = tracked.select("file", "status"), present.select("file", F.lit(True).alias("_here")).distinct()
    status = F.when(F.col("status").isNull(), "open").when(F.col("status") == "ignored", "ignored").when(F.col("_here").isNull(), "removed").when(F.col("status") == "removed", "open").otherwise(F.col("status"))
    return t.join(p, "file", "full_outer").select("file", status.alias("status"))
