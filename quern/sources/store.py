"""The graph on disk: versions of Parquet tables behind a pointer, with bulk load, keyed merges, removal and JSON-lines lists.

A write makes a whole new version folder and then moves the pointer, one small file replaced in one step, so readers see
the old version or the new one and a lost job leaves no half-written table. The version is also the generation token by
which a reader notices that it is stale. A lock file, created only if absent, keeps writers apart.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import graph, lookup, scoring, search, sets
from quern.session import SharedFolder
from quern.tables import DEPENDENCY

TABLES = ["files", "docnodes", "symbols", "specs", "relations"]
KEYS = {"files": ["path"], "docnodes": ["path"], "symbols": ["id"], "specs": ["spec_id"], "relations": ["source", "target", "type"]}


class Store:
    """A store in a folder that every executor can reach. The pointer and lock are small files beside the versions.

    Every write takes the lock unless the store is used as a context, which holds it over several. The version before
    the current one stays for readers that began with it; older ones are removed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = SharedFolder(spark, self.root)
        self.held = False

    # pointer, lock
    @property
    def generation(self) -> str | None:
        return self.meta().get("version")

    def meta(self) -> dict:
        return json.loads(self.folder.read("CURRENT") or "{}")

    def _publish(self, version: str, meta: dict) -> None:
        before = self.generation
        self.folder.replace("CURRENT", json.dumps(meta | {"version": version, "written": time.time()}))
        for name in self.folder.names():
            if len(name) == 32 and name not in (version, before):
                self.folder.delete(name)

    def __enter__(self):
        if not self.folder.claim("LOCK"):
            raise RuntimeError("another writer holds the store")
        self.held = True
        return self

    def __exit__(self, *_):
        self.held = False
        self.folder.delete("LOCK")

    def is_stale(self, generation: str | None) -> bool:
        return generation != self.generation

    # reading, writing
    def table(self, name: str) -> DataFrame:
        version = self.generation
        if version is None:
            raise LookupError("the store is empty")
        return self.spark.read.parquet(f"{self.root}/{version}/{name}")

    def bulk_load(self, tables: dict[str, DataFrame], **meta) -> str:
        """A new version of all tables, those not given taken over; edges lie in folders by type."""
        if not self.held:
            with self:
                return self.bulk_load(tables, **meta)
        version = uuid.uuid4().hex
        for name in TABLES:
            df = tables[name] if name in tables else self.table(name)
            writer = df.write
            (writer.partitionBy("type") if name == "relations" else writer).parquet(f"{self.root}/{version}/{name}")
        self._publish(version, {k: v for k, v in self.meta().items() if k not in ("version", "written")} | meta)
        return version

    def upsert(self, name: str, rows: DataFrame) -> str:
        """Rows written anew by key; a file takes its symbols and edges with it, see :meth:`upsert_files`."""
        return self.bulk_load({name: sets.upsert(self.table(name), rows.select(*self.table(name).columns), KEYS[name])})

    def upsert_files(self, files: DataFrame, symbols: DataFrame, relations: DataFrame) -> str:
        """Files with their symbols and edges in place of what was there. Edges from elsewhere into symbols that stay are kept."""
        gone = files.select("path").distinct()
        f, s, r = sets.remove_files(self.table("files"), self.table("symbols"), self.table("relations"), gone)
        inbound = self.table("relations").join(symbols.select(F.col("id").alias("target")), "target", "left_semi")
        inside = self.table("symbols").join(gone.select(F.col("path").alias("file_path")), "file_path", "left_semi").select(F.col("id").alias("source")).unionByName(gone.select(F.col("path").alias("source")))
        kept = inbound.join(inside, "source", "left_anti")
        edges = r.unionByName(kept.select(*r.columns)).unionByName(relations.select(*r.columns)).dropDuplicates(KEYS["relations"])
        return self.bulk_load({"files": f.unionByName(files.select(*f.columns)), "symbols": s.unionByName(symbols.select(*s.columns)), "relations": edges})

    def remove_files(self, gone: DataFrame) -> str:
        f, s, r = sets.remove_files(self.table("files"), self.table("symbols"), self.table("relations"), gone)
        return self.bulk_load({"files": f, "symbols": s, "relations": r})

    def remove(self, name: str, gone: DataFrame) -> str:
        """Rows by key; the edges of removed specs go too."""
        key = KEYS[name][0]
        out = {name: self.table(name).join(gone.select(key), key, "left_anti")}
        if name == "specs":
            r = self.table("relations")
            out["relations"] = r.join(gone.select(F.col(key).alias("source")), "source", "left_anti").join(gone.select(F.col(key).alias("target")), "target", "left_anti")
        return self.bulk_load(out)

    def add_relations(self, edges: DataFrame) -> str:
        old = self.table("relations")
        return self.bulk_load({"relations": sets.upsert(old, edges.select(*old.columns).dropDuplicates(KEYS["relations"]), KEYS["relations"])})

    def clear(self) -> str:
        return self.bulk_load({name: self.table(name).limit(0) for name in TABLES})

    # the operators over the store
    def hotspots(self, **options) -> DataFrame:
        return scoring.hotspots(self.table("symbols"), self.table("relations"), **options)

    def impact(self, targets: DataFrame, direction: str = "upstream", depth: int = 3):
        return graph.impact(self.table("symbols"), self.table("relations"), targets, self._way(direction), depth)

    def callers(self, node: str) -> DataFrame:
        return graph.neighbours(self.table("relations"), DEPENDENCY, node, True)

    def callees(self, node: str) -> DataFrame:
        return graph.neighbours(self.table("relations"), DEPENDENCY, node, False)

    def importers(self, path: str) -> DataFrame:
        return graph.neighbours(self.table("relations"), ["IMPORTS"], path, True)

    def importees(self, path: str) -> DataFrame:
        return graph.neighbours(self.table("relations"), ["IMPORTS"], path, False)

    def overriders(self, node: str) -> DataFrame:
        return graph.neighbours(self.table("relations"), ["OVERRIDES"], node, True)

    def find_symbols(self, **conditions) -> DataFrame:
        return lookup.find_symbols(self.table("symbols"), **conditions)

    def resolve_file(self, selector: str) -> DataFrame:
        return lookup.resolve_file(self.table("files"), self.table("docnodes"), selector)

    def resolve_symbol(self, selector: str) -> DataFrame:
        return lookup.resolve_symbol(self.table("symbols"), selector)

    def exported_symbols(self, path: str) -> DataFrame:
        return lookup.exported_symbols(self.table("symbols"), self.table("relations"), path)

    def file_impact(self, paths: DataFrame, direction: str = "upstream", depth: int = 3) -> graph.FileImpact:
        return graph.FileImpact(self.table("symbols"), self.table("relations"), paths, self._way(direction), depth)

    def spec_impact(self, seeds: DataFrame, depth: int = 3):
        return graph.spec_impact(self.table("specs"), self.table("symbols"), self.table("relations"), seeds, depth)

    def detect_changes(self, changed: DataFrame, depth: int = 3):
        return graph.detect_changes(self.table("symbols"), self.table("relations"), changed, depth)

    def coverage(self, wanted: DataFrame) -> DataFrame:
        return scoring.coverage(self.table("specs"), self.table("relations"), wanted)

    @staticmethod
    def _way(direction: str) -> str:
        return {"dependents": "upstream", "dependencies": "downstream"}.get(direction, direction)

    def search(self, query: str, limit: int = 20, kinds: tuple[str, ...] = ()) -> dict[str, DataFrame]:
        """Results by kind of node; all kinds where none is named."""
        run = {"symbols": lambda: search.symbols(self.table("symbols"), query, limit), "specs": lambda: search.specs(self.table("specs"), query, limit), "documents": lambda: search.documents(self.table("docnodes"), query, limit)}
        return {k: run[k]() for k in kinds or run}

    def statistics(self) -> DataFrame:
        out = None
        for name in ("files", "docnodes", "symbols", "specs"):
            part = self.table(name).agg(F.count(F.lit(1)).alias(name))
            out = part if out is None else out.join(F.broadcast(part))
        return out


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines list; malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def publish_lines(rows: DataFrame, root: str) -> str:
    """The list as JSON lines in a new folder, then named by the pointer."""
    version = uuid.uuid4().hex
    rows.write.json(f"{root}/{version}")
    SharedFolder(rows.sparkSession, root).replace("CURRENT", version)
    return f"{root}/{version}"


def sink(rows: DataFrame, form: str, limit: int | None = None) -> str:
    """Rows of a result as ``json`` or as ``text`` with aligned columns; for what a person reads, so ``limit`` rows at most."""
    shown = rows if limit is None else rows.limit(limit)
    if form == "json":
        return "[" + ",".join(shown.toJSON().collect()) + "]"
    if form != "text":
        raise ValueError(f"no such form: {form}")
    cells = [[*shown.columns], *[["" if v is None else str(v) for v in row] for row in shown.collect()]]
    widths = [max(map(len, column)) for column in zip(*cells, strict=True)]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(row, widths, strict=True)).rstrip() for row in cells)
