"""Files of a folder: discovery with ignore rules, decoding, classification."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Folders left out, endings of files that are no text, languages by ending.
EXCLUDED = ["node_modules/", ".git/", ".hg/", ".svn/", "dist/", "build/", "coverage/", ".next/", ".nuxt/"]
BINARY = ["gif", "png", "jpg", "jpeg", "pdf", "sql", "zip", "tiff", "pack", "ico", "war", "7z"]
LANGUAGES = {"ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "py": "python", "pyi": "python", "go": "go", "php": "php"}


def ignore_regex(rule: str) -> str:
    """A gitignore pattern as an expression on a relative path."""
    folder = rule.endswith("/")
    body = rule.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("^" if anchored else "(?:^|.*/)") + out + ("/.*" if folder else "(?:/.*)?") + "$"


def ignored(path: Column, rules: list[str]) -> Column:
    """The last rule that matches decides; ``!`` takes a file back."""
    out = F.lit(False)
    for rule in rules:
        back = rule.startswith("!")
        out = F.when(path.rlike(ignore_regex(rule[back:])), F.lit(not back)).otherwise(out)
    return out


def discover(spark: SparkSession, root: str, rules: list[str] | None = None, gitignore: list[str] = (), allowed: list[str] = (), binary: list[str] | None = None) -> DataFrame:
    """(path relative to the root, content as bytes, length, modified): the listing is distributed, ignore rules are expressions on the path.

    Rules of .gitignore files come first, then ``rules`` (default ``EXCLUDED``), so later negations win.
    """
    src = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^file:/*", "/", root.rstrip("/"))
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(base) + "/", "")
    out = src.select(rel.alias("path"), "content", "length", F.col("modificationTime").alias("modified"))
    out = out.where(~ignored(F.col("path"), [*gitignore, *(EXCLUDED if rules is None else rules)]))
    out = out.where(~F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(BINARY if binary is None else binary))
    if allowed:
        keep = F.lit(False)
        for pattern in allowed:
            keep = keep | F.col("path").rlike(ignore_regex(pattern))
        out = out.where(keep)
    return out


def decode_bytes(raw: bytes) -> str | None:
    """Text by byte order mark, strict UTF-8, UTF-16 by where zero bytes lie, Windows-1252; None for what is no text."""
    if raw.startswith(b"\xef\xbb\xbf"):
        return raw[3:].decode("utf-8", "replace")
    for mark, name in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return raw[2:].decode(name, "replace")
    try:
        text = raw.decode("utf-8")
        if "\0" not in text:
            return text
    except UnicodeDecodeError:
        pass
    for parity, name in ((1, "utf-16-le"), (0, "utf-16-be")):
        part = raw[parity::2]
        if part and part.count(0) / len(part) >= 0.6:
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                pass
    if 0 not in raw:
        try:
            return raw.decode("cp1252")
        except UnicodeDecodeError:
            return None
    return None


@F.pandas_udf(T.StringType())
def decode(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else decode_bytes(bytes(b)))


def classify(decoded: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """Adds ``language`` and ``kind``: file (a known ending), document (other text) or skipped (no text)."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    language = known[F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))]
    return decoded.withColumn("language", language).withColumn("kind", F.when(F.col(text).isNull(), "skipped").when(F.col("language").isNotNull(), "file").otherwise("document"))


def outside(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Paths that lie under none of the workspace roots (column root); each path is matched with its own folders only."""
    folders = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))
    under = paths.select("path", F.explode(folders).alias("root")).join(roots.select("root").distinct(), "root", "left_semi").select("path").distinct()
    return paths.join(under, "path", "left_anti")


def modified_since(commits: DataFrame, refs: DataFrame, at, excluded: list[str] = ()) -> DataFrame:
    """Files changed by commits (file, at) after the reference in force at a time; prefixes are left out."""
    base = refs.where(F.col("at") <= at).agg(F.max("at").alias("base"))
    out = commits.join(F.broadcast(base)).where(F.col("base").isNull() | (F.col("at") > F.col("base")))
    for prefix in excluded:
        out = out.where(~((F.col("file") == prefix) | F.col("file").startswith(prefix.rstrip("/") + "/")))
    return out.select("file").distinct()
