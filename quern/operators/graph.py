"""Adjacency, traversal by level, and impact.

A traversal is a loop over levels on the driver; each level is one join of the frontier, keyed by root, with the edges,
an anti join with what was reached before, and a written table, so plans do not grow and many roots walk at once.
Edges are reduced to two columns and content never enters a join.
"""

from __future__ import annotations

import itertools
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.scoring import risk_level
from quern.session import Scratch
from quern.tables import DEPENDENCY, HIERARCHY

# Which table each end of a relation type names.
ENDPOINTS = {"IMPORTS": ("file", "file"), "DEFINES": ("file", "symbol"), "EXPORTS": ("file", "symbol"), "CALLS": ("symbol", "symbol"), "CONSTRUCTS": ("symbol", "symbol"), "USES_TYPE": ("symbol", "symbol"), "EXTENDS": ("symbol", "symbol"), "IMPLEMENTS": ("symbol", "symbol"), "OVERRIDES": ("symbol", "symbol"), "DEPENDS_ON": ("spec", "spec"), "COVERS_FILE": ("spec", "file"), "COVERS_SYMBOL": ("spec", "symbol")}

#: A walk writes its levels together when there are more than so many.
MERGE = 16


def neighbours(relations: DataFrame, types: list[str], node: str, incoming: bool) -> DataFrame:
    """Edges of some types into (or out of) a node."""
    return relations.where(F.col("type").isin(list(types)) & (F.col("target" if incoming else "source") == node))


def with_endpoints(relations: DataFrame, files: DataFrame, symbols: DataFrame, specs: DataFrame) -> DataFrame:
    """Edges both ends of which exist; others are dropped silently, as unknown types are."""
    keys = {"file": files.select(F.col("path").alias("k")), "symbol": symbols.select(F.col("id").alias("k")), "spec": specs.select(F.col("spec_id").alias("k"))}
    nodes = None
    for kind, ids in keys.items():
        part = ids.select("k", F.lit(kind).alias("kind"))
        nodes = part if nodes is None else nodes.unionByName(part)
    nodes = nodes.distinct()
    side = lambda n: F.create_map(*[F.lit(x) for t, ends in ENDPOINTS.items() for x in (t, ends[n])])[F.col("type")]
    edges = relations.withColumns({"s_kind": side(0), "t_kind": side(1)}).where("s_kind is not null")
    edges = edges.join(nodes.withColumnsRenamed({"k": "source", "kind": "s_kind"}), ["source", "s_kind"], "left_semi")
    return edges.join(nodes.withColumnsRenamed({"k": "target", "kind": "t_kind"}), ["target", "t_kind"], "left_semi").drop("s_kind", "t_kind")


def walk(edges: DataFrame, seeds: DataFrame, depth: int | None) -> DataFrame:
    """Nodes reached from each root: (root, id, depth), depth from 1, shallowest only; ``edges`` is (a, b), walked from a to b.

    Without a depth the walk ends when nothing new is reached. A root is never its own result. ``seeds`` is (root, id). Null ends lead nowhere.
    """
    scratch = Scratch(edges.sparkSession, "walk")
    # written once, two columns wide: every level reads it again
    edges = scratch.put(edges.where("a is not null and b is not null").select("a", "b").distinct())
    seen = scratch.put(seeds.select("root", "id").distinct().withColumn("depth", F.lit(0)))
    levels, front = [seen], seen
    for level in itertools.count(1) if depth is None else range(1, depth + 1):
        if len(levels) > MERGE:  # long chains: plans do not grow with the depth
            merged = levels[0]
            for more in levels[1:]:
                merged = merged.unionByName(more)
            levels = [scratch.put(merged)]
        step = front.select("root", F.col("id").alias("a")).join(edges, "a").select("root", F.col("b").alias("id")).distinct()
        known = levels[0].select("root", "id")
        for more in levels[1:]:
            known = known.unionByName(more.select("root", "id"))
        front = scratch.put(step.join(known, ["root", "id"], "left_anti").withColumn("depth", F.lit(level)))
        if front.isEmpty():
            break
        levels.append(front)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.where("depth > 0")


def symbol_edges(symbols: DataFrame, relations: DataFrame, upstream: bool, include_files: bool = False) -> DataFrame:
    """(a, b) edges of a symbol traversal; ``b`` always has a symbol row.

    With files, upstream adds all symbols of importing files, downstream the exported symbols of imported files.
    """
    links = relations.where(F.col("type").isin(DEPENDENCY + HIERARCHY))
    edges = links.select(F.col("target").alias("a"), F.col("source").alias("b")) if upstream else links.select(F.col("source").alias("a"), F.col("target").alias("b"))
    if include_files:
        imports = relations.where("type = 'IMPORTS'")
        own = symbols.select(F.col("id").alias("a"), "file_path")
        if upstream:
            far = symbols.select(F.col("id").alias("b"), F.col("file_path").alias("far"))
            pairs = imports.select(F.col("target").alias("file_path"), F.col("source").alias("far"))
        else:
            far = relations.where("type = 'EXPORTS'").select(F.col("source").alias("far"), F.col("target").alias("b"))
            pairs = imports.select(F.col("source").alias("file_path"), F.col("target").alias("far"))
        edges = edges.unionByName(own.join(pairs, "file_path").join(far, "far").select("a", "b"))
    return edges.join(symbols.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")


def reach(symbols: DataFrame, relations: DataFrame, seeds: DataFrame, upstream: bool, depth: int = 3, include_files: bool = True) -> DataFrame:
    """Symbols that depend on (upstream) or are needed by each root: (root, id, depth)."""
    if not include_files:
        return walk(symbol_edges(symbols, relations, upstream), seeds, depth)
    return _walk_with_files(symbols, relations, seeds, upstream, depth)


def _walk_with_files(symbols: DataFrame, relations: DataFrame, seeds: DataFrame, upstream: bool, depth: int) -> DataFrame:
    """Level by level through files as well, without ever joining all symbols of a file with all of another."""
    scratch = Scratch(symbols.sparkSession, "walk")
    edges = scratch.put(symbol_edges(symbols, relations, upstream).distinct())
    symbols = scratch.put(symbols.select("id", "file_path"))
    imports = relations.where("type = 'IMPORTS'")
    files = scratch.put(imports.select(F.col("target").alias("file_path"), F.col("source").alias("far")) if upstream else imports.select(F.col("source").alias("file_path"), F.col("target").alias("far")))
    members = symbols.select(F.col("file_path").alias("far"), "id") if upstream else relations.where("type = 'EXPORTS'").select(F.col("source").alias("far"), F.col("target").alias("id")).join(symbols.select("id"), "id", "left_semi")
    seen = scratch.put(seeds.select("root", "id").distinct().withColumn("depth", F.lit(0)))
    levels, front = [seen], seen
    for level in range(1, depth + 1):
        links = front.select("root", F.col("id").alias("a")).join(edges, "a").select("root", F.col("b").alias("id"))
        at = front.join(symbols.select("id", "file_path"), "id").select("root", "file_path").distinct()
        via = at.join(files, "file_path").select("root", "far").distinct().join(members, "far").select("root", "id")
        known = levels[0].select("root", "id")
        for more in levels[1:]:
            known = known.unionByName(more.select("root", "id"))
        front = scratch.put(links.unionByName(via).distinct().join(known, ["root", "id"], "left_anti").withColumn("depth", F.lit(level)))
        if front.isEmpty():
            break
        levels.append(front)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.where("depth > 0")


def truncated(edges: DataFrame, reached: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(root, truncated): whether a node at the last level has a neighbour not reached; ``edges`` as in :func:`walk`."""
    all_seen = reached.select("root", "id").unionByName(seeds.select("root", "id"))
    last = reached.where(F.col("depth") == depth).select("root", F.col("id").alias("a"))
    beyond = last.join(edges, "a").select("root", F.col("b").alias("id")).join(all_seen, ["root", "id"], "left_anti").select("root").distinct()
    return seeds.select("root").distinct().join(beyond.withColumn("more", F.lit(True)), "root", "left").select("root", F.coalesce("more", F.lit(False)).alias("truncated"))


def file_reach(relations: DataFrame, seeds: DataFrame, direction: str = "upstream", depth: int = 3) -> DataFrame:
    """Files over IMPORTS from each root file: (root, id, depth)."""
    imports = relations.where("type = 'IMPORTS'")
    up = imports.select(F.col("target").alias("a"), F.col("source").alias("b"))
    down = imports.select(F.col("source").alias("a"), F.col("target").alias("b"))
    return walk(up if direction == "upstream" else down if direction == "downstream" else up.unionByName(down), seeds, depth)


def imported_file_symbols(symbols: DataFrame, relations: DataFrame, files: DataFrame, affected: DataFrame) -> DataFrame:
    """Symbols of reached files that hang together with what is affected: (root, id, depth).

    ``files`` is (root, path, depth), ``affected`` (root, id). In each file the symbols with a dependency edge to an affected
    one are seeds; what they reach in the file over dependency edges of either direction is added; a file without
    seeds gives its exported symbols.
    """
    links = relations.where(F.col("type").isin(DEPENDENCY)).select("source", "target")
    both = links.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(links.select(F.col("target").alias("a"), F.col("source").alias("b"))).distinct()
    inside = files.join(symbols.select("id", F.col("file_path").alias("path")), "path").select("root", "depth", "path", "id")
    touching = inside.join(both, inside.id == both.a).select("root", "depth", "path", "id", "b").join(affected.select("root", F.col("id").alias("b")), ["root", "b"], "left_semi").select("root", "depth", "path", "id").distinct()
    where = symbols.select(F.col("id").alias("a"), F.col("file_path").alias("fa"))
    local = both.join(where, "a").join(symbols.select(F.col("id").alias("b"), F.col("file_path").alias("fb")), "b").where("fa = fb").select("a", "b")
    seeds = touching.select(F.struct("root", "depth", "path").alias("root"), "id")
    # a closure inside one file: at most as many levels as the longest chain, so walk until nothing is new
    closed = seeds.unionByName(walk(local, seeds, None).select("root", "id")).select("root.root", "root.depth", "id")
    bare = files.join(touching.select("root", "depth", "path").distinct(), ["root", "depth", "path"], "left_anti")
    exported = relations.where("type = 'EXPORTS'").select(F.col("source").alias("path"), F.col("target").alias("id"))
    return closed.unionByName(bare.join(exported, "path").join(symbols.select("id"), "id", "left_semi").select("root", "depth", "id")).groupBy("root", "id").agg(F.min("depth").alias("depth")).select("root", "id", "depth")


class Impact:
    """Impact of each target symbol (``targets`` is (id)); what is asked for is walked, and walked once.

    Symbols and files are walked apart; each depth counts the larger of the two. In both directions an id reached both
    ways keeps its upstream depth, while counts by depth take each way's own.
    """

    def __init__(self, symbols: DataFrame, relations: DataFrame, targets: DataFrame, direction: str = "upstream", depth: int = 3):
        self.scratch = Scratch(symbols.sparkSession, "impact")
        self.symbols = self.scratch.put(symbols.select("id", "name", "file_path", "line"))
        self.relations = self.scratch.put(relations.where(F.col("type").isin(DEPENDENCY + HIERARCHY + ["IMPORTS", "EXPORTS"])).select("source", "target", "type"))
        self.seeds = targets.select(F.col("id").alias("root"), "id").distinct()
        self.direction, self.depth = direction, depth

    @cached_property
    def reached(self) -> DataFrame:
        """(root, id, depth, way): symbols over dependency and hierarchy edges, each way apart."""
        ways = [w for w in ("upstream", "downstream") if self.direction in (w, "both")]
        parts = [reach(self.symbols, self.relations, self.seeds, w == "upstream", self.depth, include_files=False).withColumn("way", F.lit(k)) for k, w in enumerate(ways)]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    @cached_property
    def own(self) -> DataFrame:
        return self.scratch.put(self.reached.groupBy("root", "id").agg(F.min_by("depth", "way").alias("depth")))

    @cached_property
    def files(self) -> DataFrame:
        """(root, id, depth): files over imports from the file of each target."""
        home = self.seeds.join(self.symbols.select("id", "file_path"), "id").select("root", F.col("file_path").alias("id"))
        return file_reach(self.relations, home, self.direction, self.depth)

    def summary(self) -> DataFrame:
        """root, direct, indirect, transitive, total, risk."""
        bucket = F.least("depth", F.lit(3))
        by_symbol = self.reached.select("root", "id", bucket.alias("b"), "depth").distinct().groupBy("root", "b").agg(F.count(F.lit(1)).alias("s"))
        by_file = self.files.select("root", bucket.alias("b")).groupBy("root", "b").agg(F.count(F.lit(1)).alias("f"))
        each = by_symbol.join(by_file, ["root", "b"], "full_outer").select("root", "b", F.greatest(F.coalesce("s", F.lit(0)), F.coalesce("f", F.lit(0))).alias("n"))
        out = self.seeds.select("root").join(each, "root", "left").groupBy("root").agg(*[F.coalesce(F.sum(F.when(F.col("b") == k, F.col("n"))), F.lit(0)).alias(c) for k, c in ((1, "direct"), (2, "indirect"), (3, "transitive"))])
        return out.withColumn("total", F.col("direct") + F.col("indirect") + F.col("transitive")).withColumn("risk", risk_level("direct", "total"))

    @cached_property
    def affected(self) -> DataFrame:
        """root, id, name, file_path, line, depth: reached symbols and those of reached files that hang together with them."""
        extra = imported_file_symbols(self.symbols, self.relations, self.files.select("root", F.col("id").alias("path"), "depth"), self.own.select("root", "id"))
        every = self.own.unionByName(extra).groupBy("root", "id").agg(F.min("depth").alias("depth")).where("root <> id")
        return self.scratch.put(every.join(self.symbols.select("id", "name", "file_path", "line"), "id").select("root", "id", "name", "file_path", "line", "depth"))

    def paths(self) -> DataFrame:
        """(root, path): files of reached symbols, and reached files."""
        of_symbols = self.own.where("root <> id").join(self.symbols.select("id", "file_path"), "id").select("root", F.col("file_path").alias("path"))
        return of_symbols.unionByName(self.files.select("root", F.col("id").alias("path"))).distinct()


def impact(symbols: DataFrame, relations: DataFrame, targets: DataFrame, direction: str = "upstream", depth: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summary, affected symbols and affected files of :class:`Impact`."""
    one = Impact(symbols, relations, targets, direction, depth)
    return one.summary(), one.affected, one.paths()


_RISK_ORDER = "case risk when 'CRITICAL' then 3 when 'HIGH' then 2 when 'MEDIUM' then 1 else 0 end"


class FileImpact:
    """Impact of each file (``paths`` is (path)): its own walk over imports and the impact of its symbols together."""

    def __init__(self, symbols: DataFrame, relations: DataFrame, paths: DataFrame, direction: str = "upstream", depth: int = 3):
        self.own = paths.select(F.col("path").alias("root")).distinct()
        self.walked = file_reach(relations, self.own.select("root", F.col("root").alias("id")), direction, depth)
        self.inside = symbols.join(self.own.withColumnRenamed("root", "file_path"), "file_path", "left_semi").select("id", "file_path")
        self.each = Impact(symbols, relations, self.inside.select("id"), direction, depth)

    def summary(self) -> DataFrame:
        """root, direct, indirect, transitive, total, risk: the larger of the file's walk and any symbol's, by count and by risk."""
        bucket = F.least("depth", F.lit(3))
        files = self.walked.groupBy("root").agg(*[F.sum(F.when(bucket == k, 1).otherwise(0)).alias(c) for k, c in ((1, "direct"), (2, "indirect"), (3, "transitive"))])
        files = self.own.join(files, "root", "left").fillna(0).withColumn("total", F.col("direct") + F.col("indirect") + F.col("transitive")).withColumn("risk", risk_level("direct", "total"))
        symbols = self.each.summary().join(self.inside.select(F.col("id").alias("root"), "file_path"), "root").drop("root").withColumnRenamed("file_path", "root")
        both = files.unionByName(symbols).withColumn("o", F.expr(_RISK_ORDER))
        return both.groupBy("root").agg(F.max("direct").alias("direct"), F.max("indirect").alias("indirect"), F.max("transitive").alias("transitive"), F.max("total").alias("total"), F.max_by("risk", "o").alias("risk"))

    def affected(self) -> DataFrame:
        """(root, id, depth): symbols affected by any symbol of the file, at their least depth."""
        of = self.inside.select(F.col("id").alias("root"), F.col("file_path").alias("file"))
        return self.each.affected.join(of, "root").groupBy(F.col("file").alias("root"), "id").agg(F.min("depth").alias("depth"))

    def paths(self) -> DataFrame:
        """(root, path): files reached by the file's own walk or affected by any of its symbols."""
        of = self.inside.select(F.col("id").alias("root"), F.col("file_path").alias("file"))
        return self.each.paths().join(of, "root").select(F.col("file").alias("root"), "path").unionByName(self.walked.select("root", F.col("id").alias("path"))).distinct()


def file_impact(symbols: DataFrame, relations: DataFrame, paths: DataFrame, direction: str = "upstream", depth: int = 3) -> DataFrame:
    return FileImpact(symbols, relations, paths, direction, depth).summary()


def files_impact(each: DataFrame) -> DataFrame:
    """Several files as one: counts are summed, the risk is the largest, the target names all."""
    return each.withColumn("o", F.expr(_RISK_ORDER)).agg(F.array_join(F.sort_array(F.collect_list("root")), ", ").alias("target"), F.sum("direct").alias("direct"), F.sum("indirect").alias("indirect"), F.sum("transitive").alias("transitive"), F.sum("total").alias("total"), F.max_by("risk", "o").alias("risk"))


def files_affected(one: FileImpact) -> tuple[DataFrame, DataFrame]:
    """Of several files as one: affected symbols (id, depth) at their least depth, and affected files (path), the changed ones themselves left out."""
    symbols = one.affected().groupBy("id").agg(F.min("depth").alias("depth"))
    return symbols, one.paths().select("path").distinct().join(one.own.select(F.col("root").alias("path")), "path", "left_anti")


def spec_impact(specs: DataFrame, symbols: DataFrame, relations: DataFrame, seeds: DataFrame, depth: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For each spec in ``seeds`` (spec_id): dependent specs (root, spec_id, depth), covered files and covered symbols of target and dependents."""
    own = seeds.select(F.col("spec_id").alias("root"), F.col("spec_id").alias("id")).distinct()
    edges = relations.where("type = 'DEPENDS_ON'").select(F.col("target").alias("a"), F.col("source").alias("b"))
    edges = edges.join(specs.select(F.col("spec_id").alias("b")), "b", "left_semi")
    reached = walk(edges, own, depth)
    every = own.unionByName(reached.select("root", "id"))
    covered = lambda kind: every.join(relations.where(F.col("type") == kind).select(F.col("source").alias("id"), "target"), "id").select("root", "target").distinct()
    marked = covered("COVERS_SYMBOL").join(symbols.select(F.col("id").alias("target"), "file_path"), "target")
    paths = covered("COVERS_FILE").select("root", F.col("target").alias("path")).unionByName(marked.select("root", F.col("file_path").alias("path"))).distinct()
    return reached.select("root", F.col("id").alias("spec_id"), "depth"), paths, marked.select("root", F.col("target").alias("symbol_id"))


def detect_changes(symbols: DataFrame, relations: DataFrame, changed: DataFrame, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """What changed files (path) affect: (changed symbol, affected, risk) and the set of affected symbols (id, depth)."""
    inside = symbols.join(changed.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").select("id")
    reached = reach(symbols, relations, inside.select(F.col("id").alias("root"), "id"), True, depth, include_files=True)
    per = inside.join(reached.groupBy(F.col("root").alias("id")).agg(F.count(F.lit(1)).alias("total"), F.sum(F.when(F.col("depth") == 1, 1).otherwise(0)).alias("direct")), "id", "left").fillna(0)
    return per.withColumn("risk", risk_level("direct", "total")), reached.groupBy("id").agg(F.min("depth").alias("depth"))


def dependency_closure(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(root, id, depth) over (a, b), of any depth unless one is given; cycles end by themselves."""
    return walk(edges, seeds, depth)


def change_summary(per: DataFrame, affected: DataFrame, files: int) -> DataFrame:
    """One row of :func:`detect_changes`: changed and affected symbols, the largest risk, and a sentence that says so."""
    order = F.expr(_RISK_ORDER)
    out = per.agg(F.count(F.lit(1)).alias("changed"), F.coalesce(F.max_by("risk", order), F.lit("LOW")).alias("risk")).join(F.broadcast(affected.agg(F.count(F.lit(1)).alias("affected"))))
    return out.withColumn("summary", F.concat(F.lit(f"{files} file(s) changed, "), F.col("changed").cast("string"), F.lit(" symbol(s) modified, "), F.col("affected").cast("string"), F.lit(" symbol(s) affected; risk "), F.col("risk")))


def hierarchy_dependents(symbols: DataFrame, relations: DataFrame, changed: DataFrame) -> DataFrame:
    """(path): files, not changed themselves, with a symbol one hierarchy edge above a class or interface of the changed files (path)."""
    types = symbols.where("kind in ('class', 'interface')").join(changed.select(F.col("path").alias("file_path")), "file_path", "left_semi").select(F.col("id").alias("target"))
    above = relations.where(F.col("type").isin(HIERARCHY)).join(types, "target", "left_semi").select(F.col("source").alias("id")).distinct()
    return symbols.join(above, "id", "left_semi").select(F.col("file_path").alias("path")).distinct().join(changed.select("path"), "path", "left_anti")


def cover_edges(links: DataFrame, symbols: DataFrame) -> DataFrame:
    """Coverage edges (source, target, type) of implementation links (spec_id, file, symbols): each named symbol of the file, the file itself where none is named."""
    whole = links.where(F.coalesce(F.size("symbols"), F.lit(0)) <= 0).select(F.col("spec_id").alias("source"), F.col("file").alias("target"), F.lit("COVERS_FILE").alias("type"))
    named = links.select("spec_id", F.col("file").alias("file_path"), F.explode("symbols").alias("name")).join(symbols.select("file_path", "name", "id"), ["file_path", "name"])
    return whole.unionByName(named.select(F.col("spec_id").alias("source"), F.col("id").alias("target"), F.lit("COVERS_SYMBOL").alias("type"))).distinct()


def descendants_in_order(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, level): everything after the seeds (id) in a graph without cycles, seeds excluded, with its topological level."""
    after = walk(edges, seeds.select(F.lit(1).alias("root"), "id"), None).select("id").distinct()
    return topological_levels(nodes, edges).join(after, "id", "left_semi").join(seeds.select("id"), "id", "left_anti")


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): the length of the longest way from a node without predecessors; ``edges`` is (a before b).

    Nodes are taken off level by level; what remains when nothing can be taken is a cycle, an error.
    """
    scratch = Scratch(nodes.sparkSession, "levels")
    left = scratch.put(nodes.select("id").distinct())
    open_edges = scratch.put(edges.select("a", "b").join(left.withColumnRenamed("id", "a"), "a", "left_semi").join(left.withColumnRenamed("id", "b"), "b", "left_semi").distinct())
    done, level = [], 0
    while not left.isEmpty():
        free = scratch.put(left.join(open_edges.select(F.col("b").alias("id")).distinct(), "id", "left_anti"))
        if free.isEmpty():
            raise ValueError("the graph has a cycle")
        done.append(free.withColumn("level", F.lit(level)))
        left = scratch.put(left.join(free, "id", "left_anti"))
        open_edges = scratch.put(open_edges.join(free.withColumnRenamed("id", "a"), "a", "left_anti"))
        level += 1
    out = done[0] if done else nodes.select("id", F.lit(0).alias("level")).limit(0)
    for more in done[1:]:
        out = out.unionByName(more)
    return out
