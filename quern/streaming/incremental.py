"""Structured Streaming forms: the same operators, fed bit by bit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import events, sets
from quern.sources.store import Store


def windowed_counts(stream: DataFrame, at: str, key: Column, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by tumbling window and key; rows later than ``late`` are dropped with their closed windows. Works on a batch as well."""
    rows = stream.withWatermark(at, late) if stream.isStreaming else stream
    return rows.groupBy(F.window(at, size).alias("w"), key.alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "key", "n")


def first_seen(stream: DataFrame, at: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if stream.isStreaming else stream.dropDuplicates(keys)


def merge_batches(stream: DataFrame, merge, checkpoint: str):
    """Start a query that hands every batch, with its number, to ``merge``; a batch repeated after a failure has its old number."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, number: merge(rows, number)).start()


def change_states(stream: DataFrame, key: str = "change", order: tuple[str, ...] = ("at", "seq")) -> DataFrame:
    """State per change as of all events so far (output mode ``update`` or ``complete``): one small struct of state a change, whatever its events."""
    return events.change_state(stream, key, order)


def upsert_changed(store: Store, files: DataFrame, symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """Bring a batch of files, with all their symbols and edges, into the store; files whose content hash is stored already are left alone.

    Returns (path, change). A batch that comes again changes nothing, so a repeated batch is harmless.
    """
    stored = store.table("files").join(files.select("path").distinct(), "path", "left_semi")
    change = sets.file_diff(stored, files)
    wanted = change.where("change in ('new', 'changed')").select("path")
    if not wanted.isEmpty():
        of = lambda df, c: df.join(wanted.withColumnRenamed("path", c), c, "left_semi")
        mine = of(symbols, "file_path")
        edges = relations.join(mine.select(F.col("id").alias("source")).unionByName(wanted.withColumnRenamed("path", "source")), "source", "left_semi")
        store.upsert_files(of(files, "path"), mine, edges)
    return change


def cached_results(current: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """(key, hit, result): hard where the stamp is the same, soft where only the fingerprint is, miss otherwise or where the cache has another version."""
    c = cache.where(F.col("version") == version).select("key", F.col("stamp").alias("_s"), F.col("fingerprint").alias("_f"), "result")
    hit = F.when(F.col("stamp") == F.col("_s"), "hard").when(F.col("fingerprint") == F.col("_f"), "soft").otherwise("miss")
    return current.join(c, "key", "left").select("key", hit.alias("hit"), F.when(hit != "miss", F.col("result")).alias("result"))


def needs_rebuild(listed: DataFrame, present: DataFrame, invalid: bool = False) -> bool:
    """Whether a list of (key, stamp) no longer tells what is there: marked invalid, other in number, or with another stamp."""
    if invalid:
        return True
    return not sets.file_diff(listed, present, "key", "stamp").where("change <> 'same'").isEmpty()
