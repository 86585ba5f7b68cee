"""Names in nested scopes, packages and workspaces: nearest answers, and none where the answer is not one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import hierarchy


def ancestors(scopes: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """(id, ancestor, distance), each scope its own at 0; scopes on or below a cycle have none."""
    full = hierarchy.resolve(scopes, id_col, parent_col, paths=True).where("path is not null")
    return full.select("id", F.posexplode(F.reverse("path")).alias("distance", "ancestor"))


def nearest(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """(id, ancestor): the nearest proper ancestor that is in ``marked`` (ancestor); ``rows`` as :func:`ancestors` gives them."""
    return rows.where("distance > 0").join(marked.select("ancestor").distinct(), "ancestor", "left_semi").groupBy("id").agg(F.min_by("ancestor", "distance").alias("ancestor"))


def lookup(facts: DataFrame, bindings: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope_id, name, target) of facts (scope_id, name): the binding in the nearest scope that has the name, if it is one."""
    up = ancestors(scopes).select(F.col("id").alias("scope_id"), F.col("ancestor").alias("at"), "distance")
    met = facts.select("scope_id", "name").distinct().join(up, "scope_id").join(bindings.select(F.col("scope_id").alias("at"), "name", "target"), ["at", "name"])
    near = met.groupBy("scope_id", "name", "distance").agg(F.min("target").alias("target"), F.max("target").alias("hi"))
    best = near.groupBy("scope_id", "name").agg(F.min_by(F.struct("target", "hi"), "distance").alias("b"))
    return best.where("b.target = b.hi").select("scope_id", "name", "b.target")


def package_of(specifier: Column) -> Column:
    """``@scope/name`` or the first segment of a package specifier; null for relative and absolute ones."""
    return F.when(specifier.rlike(r"^[./]"), None).when(specifier.startswith("@"), F.substring_index(specifier, "/", 2)).otherwise(F.substring_index(specifier, "/", 1))


def package_symbols(imports: DataFrame, packages: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Imports (path, name, target) of workspace packages (package, workspace) as (path, name, symbol_id), the first symbol by id; and packages named twice.

    Of a package that two workspaces claim the first workspace counts.
    """
    own = packages.groupBy("package").agg(F.min("workspace").alias("workspace"), F.count_distinct("workspace").alias("n"))
    asked = imports.withColumn("package", package_of(F.col("target"))).join(own.select("package", "workspace"), "package")
    named = symbols.select(F.substring_index("file_path", ":", 1).alias("workspace"), "name", F.col("id").alias("symbol_id")).groupBy("workspace", "name").agg(F.min("symbol_id").alias("symbol_id"))
    return asked.join(named, ["workspace", "name"]).select("path", "name", "symbol_id"), own.where("n > 1").select("package")


def fingerprints(files: DataFrame, text: Column, by: Column) -> DataFrame:
    """(workspace, files, fingerprint) whose fingerprint changes with any text; sums of hash parts, so no list of files is gathered."""
    part = F.conv(F.substring(F.sha2(F.concat_ws("\n", "path", text).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return files.groupBy(by.alias("workspace")).agg(F.count(F.lit(1)).alias("files"), F.sum(part).alias("fingerprint"))


def mismatched(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Workspaces whose fingerprint differs or that only one side has; an empty store mismatches nothing."""
    any_ = stored.agg((F.count(F.lit(1)) > 0).alias("_any"))
    both = stored.select("workspace", F.col("fingerprint").alias("s")).join(current.select("workspace", F.col("fingerprint").alias("c")), "workspace", "full_outer")
    return both.where(~F.col("s").eqNullSafe(F.col("c"))).join(F.broadcast(any_)).where("_any").select("workspace")


def concatenated(parts: DataFrame, key: str, name: str = "filename", content: str = "content") -> DataFrame:
    """(key, content, content_hash): the parts of each document, ``spec.md`` first, then by name. A document is what one row holds anyway."""
    rank = F.when(F.col(name) == "spec.md", 0).otherwise(1)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.col(name).alias("n"), F.coalesce(content, F.lit("")).alias("c")))), lambda x: x["c"]), "\n")
    return parts.groupBy(key).agg(joined.alias("content")).withColumn("content_hash", F.concat(F.lit("sha256:"), F.sha2(F.col("content").cast("binary"), 256)))


def cross_relation(left: DataFrame, right: DataFrame, key: str, relation: str, ordered: bool = False) -> DataFrame:
    """Verdicts (key, verdict) on keyed arrays ``values`` of two sides: ok, broken, or deferred where a side is missing.

    ``relation`` is all-equal, subset or superset (of the left side against the right); ordered ones compare sequences.
    """
    from quern.operators import sets

    both = left.select(key, F.col("values").alias("a")).join(right.select(key, F.col("values").alias("b")), key, "full_outer")
    a, b = F.col("a"), F.col("b")
    holds = {"all-equal": sets.same_sequence(a, b) if ordered else sets.same_set(a, b), "subset": sets.subsequence(a, b) if ordered else sets.subset(a, b), "superset": sets.subsequence(b, a) if ordered else sets.subset(b, a)}[relation]
    return both.select(key, F.when(a.isNull() | b.isNull(), "deferred").when(holds, "ok").otherwise("broken").alias("verdict"))


def edit_list(values: Column, remove: list[str] = (), add: list[str] = ()) -> Column:
    """A list without some entries and with others at its end, none twice; taking out what is not there is an error."""
    gone, new = F.array(*map(F.lit, remove)).cast("array<string>"), F.array(*map(F.lit, add)).cast("array<string>")
    missing = F.array_except(gone, values)
    return F.array_distinct(F.concat(F.when(F.size(missing) == 0, F.array_except(values, gone)).otherwise(F.raise_error(F.concat(F.lit("not in the list: "), F.array_join(missing, ", ")))), new))
