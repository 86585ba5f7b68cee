"""State from event logs, and other behaviour of rows in order: all by aggregates or windows over one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _last(what: Column, order: Column, when: Column) -> Column:
    return F.max_by(F.when(when, what), F.when(when, order))


def change_state(events: DataFrame, key: str = "change", order: tuple[str, ...] = ("at", "seq")) -> DataFrame:
    """Per change: state (the last transition, default ``drafting``), drafted, approved and signed off (last such event not followed by an invalidation), first time of implementing, last invalidation.

    ``events`` has type, to_state and the order columns. Aggregates only: a change with a third of all events is
    reduced before the shuffle.
    """
    o = F.struct(*order)
    kind = F.col("type")
    latest = lambda k: F.max(F.when(kind == k, o))
    out = events.groupBy(key).agg(
        F.coalesce(_last(F.col("to_state"), o, kind == "transitioned"), F.lit("drafting")).alias("state"),
        F.coalesce(_last(kind, o, kind.isin("drafted", "restored")) == "drafted", F.lit(False)).alias("drafted"),
        latest("approved").alias("_a"), latest("signed-off").alias("_s"), latest("invalidated").alias("_i"),
        F.min(F.when((kind == "transitioned") & (F.col("to_state") == "implementing"), F.col(order[0]))).alias("implementing_at"),
        F.count(F.lit(1)).alias("events"),
    )
    active = lambda c: F.col(c).isNotNull() & (F.col("_i").isNull() | (F.col(c) > F.col("_i")))
    return out.select(key, "state", "drafted", active("_a").alias("approved"), active("_s").alias("signed_off"), "implementing_at", F.col(f"_i.{order[0]}").alias("invalidated_at"), "events")


def last_row(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last written row of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def enclosing(facts: DataFrame, symbols: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Each fact (file_path, line) with the nearest symbol of its file that begins at or before its line: ``enclosing_id``.

    One window over both sides by file, in order; a symbol on the line of a fact encloses it.
    """
    decl = symbols if kinds is None else symbols.where(F.col("kind").isin(kinds))
    cols = [c for c in facts.columns if c not in ("file_path", "line")]
    left = facts.select("file_path", "line", F.lit(1).alias("_side"), F.lit(None).cast("int").alias("_col"), F.lit(None).cast("string").alias("_id"), F.struct(*cols).alias("_fact"))
    right = decl.select("file_path", "line", F.lit(0).alias("_side"), F.col("column_number").alias("_col"), F.col("id").alias("_id"), F.lit(None).cast(left.schema["_fact"].dataType).alias("_fact"))
    w = W.partitionBy("file_path").orderBy("line", "_side", "_col", "_id").rowsBetween(W.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("enclosing_id", F.last("_id", True).over(w))
    return both.where("_side = 1").select("file_path", "line", "_fact.*", "enclosing_id")


def method_parents(symbols: DataFrame) -> DataFrame:
    """(id, owner_id): the last class or interface before each method in its file."""
    w = W.partitionBy("file_path").orderBy("line", "column_number", "id").rowsBetween(W.unboundedPreceding, -1)
    owner = F.last(F.when(F.col("kind").isin("class", "interface"), F.col("id")), True).over(w)
    return symbols.withColumn("owner_id", owner).where("kind = 'method'").select("id", "owner_id")


def carry_forward(items: DataFrame, group: str, order: str, field: str, follows: Column) -> DataFrame:
    """Items without a field that follow one take its field over."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return items.withColumn(field, F.when(F.col(field).isNull() & follows, F.last(field, True).over(w)).otherwise(F.col(field)))


def reference_as_of(refs: DataFrame, at: Column) -> DataFrame:
    """The reference in force at a time: the last one not after it."""
    return refs.where(F.col("at") <= at).agg(F.max_by("ref", "at").alias("ref"))
