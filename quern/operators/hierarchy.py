"""Parent–child links to full hierarchies, by tree contraction.

Links form trees of unknown depth, chains and cycles. Each round contracts the forest twice over: an independent set
of nodes with one child is spliced out of its chain (compress), then all leaves are taken off (rake). What was taken
off is recorded with the surviving ancestor and the distance to it. A finite graph in which every node has at most one
parent either vanishes this way or ends in nodes that are their own parent: what is left of cycles. Going back through
the records, last first, gives every node its root, depth and path, or marks it as hanging in a cycle.

Rounds number O(log n) whatever the depth; a round joins only what still stands, on 8-byte numbers.
Hot parents cost nothing extra: children are counted with partial aggregates, and only parents with a single child
are ever looked up by name, so no join key repeats on both sides; adaptive execution splits a large left side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import Scratch


def _numbered(src: DataFrame, scratch: Scratch, named: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (id, nid), those of them that name no parent, and for the rest (c, p): p is the one existing parent or null. ``named`` adds the id as ``cid``."""
    key = lambda c: [F.xxhash64(c).alias("k1"), F.xxhash64(F.lit("quern"), c).alias("k2")]
    once = src.groupBy("id").agg(F.min("parent").alias("lo"), F.max("parent").alias("hi"))
    one = F.col("lo") == F.col("hi")
    nodes = scratch.put(
        once.select(F.monotonically_increasing_id().alias("nid"), "id", *key("id"), F.when(one, F.xxhash64("lo")).alias("q1"), F.when(one, F.xxhash64(F.lit("quern"), "lo")).alias("q2"), F.coalesce(~one, F.lit(False)).alias("several"))
    )
    cid = [F.col("id").alias("cid")] if named else []
    names = nodes.select(F.col("nid").alias("p"), F.col("k1").alias("q1"), F.col("k2").alias("q2"))
    single = nodes.where("q1 is not null").select(F.col("nid").alias("c"), "q1", "q2", *cid).join(names, ["q1", "q2"], "left").select("c", "p", *(["cid"] if named else []))
    # ids whose rows disagree: the smallest parent that exists counts
    disputed = nodes.where("several").select("id", F.col("nid").alias("c"))
    choice = src.join(disputed, "id").where("parent is not null").select("c", "parent", F.xxhash64("parent").alias("q1"), F.xxhash64(F.lit("quern"), "parent").alias("q2")).distinct()
    settled = choice.join(names, ["q1", "q2"]).groupBy("c").agg(F.min_by("p", "parent").alias("p"))
    settled = disputed.select("c", *cid).join(settled, "c", "left").select("c", "p", *(["cid"] if named else []))
    return nodes.select("id", "nid"), nodes.where("q1 is null and not several").select("id", "nid"), scratch.put(single.unionByName(settled))


def resolve(rows: DataFrame, id_col: str = "id", parent_col: str = "parent_id", paths: bool = False) -> DataFrame:
    """One row per distinct id: ``id``, ``root``, ``depth`` (root 0), ``endless`` and, if asked for, ``path`` (ids from the root).

    Defined results: null ids are left out; a parent that is null, empty or names no row ends the chain; repeated rows
    count once; of several parents of one id the smallest existing one counts; ids on or below a cycle are
    ``endless`` and have null root, depth and path; an empty table gives an empty result. Other columns are ignored.
    """
    scratch = Scratch(rows.sparkSession, "hierarchy")
    parent = F.col(parent_col).cast("string")
    src = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.when(parent != "", parent).alias("parent"))
    nodes, free, links = _numbered(src, scratch, paths)
    none = F.array().cast("array<string>")
    extra = ["cid", "seg"] if paths else []
    alive = links.where("p is not null").select("c", "p", F.lit(1).cast("long").alias("w"), *([F.col("cid"), none.alias("seg")] if paths else []))
    first = alive
    rounds: list[DataFrame] = []
    while not alive.where("c <> p").isEmpty():
        coin = lambda c, i=len(rounds): F.xxhash64(F.lit(i), F.col(c))
        kids = alive.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("kid")).withColumnRenamed("p", "k")
        seen = alive.join(kids, alive.c == kids.k, "left").drop("k")
        picked = (F.col("n") == 1) & (F.col("p") != F.col("c")) & (F.col("kid") != F.col("c")) & (coin("c") < coin("kid")) & (coin("c") < coin("p"))
        seen = seen.withColumn("picked", F.coalesce(picked, F.lit(False)))
        # each spliced node, under its own number, leads on to its parent
        spliced = seen.where("picked").select(F.col("c").alias("v"), F.col("p").alias("up"), F.col("w").alias("w2"), *([F.col("cid").alias("vid"), F.col("seg").alias("seg2")] if paths else []))
        kept = seen.where("not picked").join(spliced, F.col("p") == F.col("v"), "left")
        segs = [F.col("cid"), F.when(F.col("v").isNotNull(), F.concat("seg2", F.array("vid"), "seg")).otherwise(F.col("seg")).alias("seg")] if paths else []
        rest = kept.select("c", F.coalesce("up", "p").alias("p"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), *segs, F.when(F.col("n").isNull(), F.lit(2)).otherwise(F.lit(0)).alias("gone"))
        done = scratch.put(rest.unionByName(seen.where("picked").select("c", "p", "w", *extra, F.lit(1).alias("gone"))))
        rounds.append(done)
        alive = done.where("gone = 0").drop("gone")
    # back through the records; nodes that never had a parent need no row, a missing one is a root
    solved = [alive.select("c", F.lit(None).cast("long").alias("root"), F.lit(None).cast("long").alias("depth"), F.lit(True).alias("endless"), *([F.col("cid"), none.alias("path")] if paths else []))]
    tops: list[DataFrame] = []
    if paths:
        roots = free.select(F.col("nid").alias("p"), "id").unionByName(links.where("p is null").select(F.col("c").alias("p"), F.col("cid").alias("id")))
        held = roots.join(first.select("p").distinct(), "p", "left_semi")
        tops = [scratch.put(held.select(F.col("p").alias("c"), F.col("p").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit(False).alias("endless"), F.col("id").alias("cid"), F.array("id").alias("path")))]
    for k, done in enumerate(reversed(rounds)):
        known = solved[0]
        for more in solved[1:] + tops:
            known = known.unionByName(more)
        known = known.select(F.col("c").alias("p"), "root", "depth", "endless", *(["path"] if paths else []))
        for gone in (2, 1):  # leaves went last, so they come back first; both hang on survivors of the round
            back = done.where(F.col("gone") == gone).drop("gone").join(known, "p", "left")
            path = [F.when(F.coalesce("endless", F.lit(False)), none).otherwise(F.concat("path", "seg", F.array("cid"))).alias("path")] if paths else []
            endless = F.coalesce("endless", F.lit(False))
            back = back.select("c", F.when(~endless, F.coalesce("root", "p")).alias("root"), F.when(~endless, F.coalesce("depth", F.lit(0)) + F.col("w")).alias("depth"), endless.alias("endless"), *(["cid"] if paths else []), *path)
            solved.append(back)
        if k < len(rounds) - 1:  # the last step, by far the largest, is left to the caller's plan
            solved[-2:] = [scratch.put(solved[-2].unionByName(solved[-1]))]
    known = solved[0]
    for more in solved[1:]:
        known = known.unionByName(more)
    if paths:  # every node is in the records, or is a root and its own path
        alone = free.select("id").unionByName(links.where("p is null").select(F.col("cid").alias("id")))
        below = known.select(F.col("cid").alias("id"), F.when(~F.col("endless"), F.col("path")[0]).alias("root"), "depth", "endless", F.when(~F.col("endless"), F.col("path")).alias("path"))
        return below.unionByName(alone.select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit(False).alias("endless"), F.array("id").alias("path")))
    out = nodes.join(known.withColumnRenamed("c", "nid"), "nid", "left")
    endless = F.coalesce("endless", F.lit(False))
    named = out.select("id", F.coalesce("root", F.when(~endless, F.col("nid"))).alias("rid"), F.when(~endless, F.coalesce("depth", F.lit(0))).alias("depth"), endless.alias("endless"))
    return named.join(nodes.select(F.col("nid").alias("rid"), F.col("id").alias("root")), "rid", "left").select("id", "root", "depth", "endless")


def endless(rows: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """Ids whose chain of parents never ends (on a cycle or below one)."""
    return resolve(rows, id_col, parent_col).where("endless").select("id")


def descendants(resolved: DataFrame) -> DataFrame:
    """All (ancestor, descendant, distance) of a result of :func:`resolve` with paths; nodes in cycles have none.

    The pairs come from each node's own path, so nothing is gathered by ancestor.
    """
    up = resolved.where("path is not null").select("id", "depth", F.posexplode(F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0)))).alias("pos", "ancestor"))
    return up.select("ancestor", F.col("id").alias("descendant"), (F.col("depth") - F.col("pos")).alias("distance"))
