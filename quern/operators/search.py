"""Full-text search: BM25 over query tokens, joined with ranking by identity.

The query is cut into tokens on the driver; everything else is one plan: identity columns are expressions on the row, term
counts are taken per row for the query's tokens only, and corpus statistics are one aggregate row. Snippets are made after
the limit. Where many queries are put to the same texts, :class:`Index` writes postings once.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import text as tx
from quern.functions.stem import stem

K1, B = 1.2, 0.75


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed(words: pd.Series) -> pd.Series:
    """Porter stems of arrays of lower-case words."""
    return words.map(lambda ws: None if ws is None else [stem(w) for w in ws])


def strength(identity: Column, token: str) -> Column:
    """40 equal, 30 prefix, 20 suffix, 15 component, 10 anywhere, else 0."""
    return F.when(identity == token, 40).when(identity.startswith(token), 30).when(identity.endswith(token), 20).when(F.instr(tx.components(identity), f" {token} ") > 0, 15).when(identity.contains(token), 10).otherwise(0)


def identity_rank(rows: DataFrame, canonical: Column, alternate: Column | None, query: str) -> DataFrame:
    """Adds tier (5 to 1), hits and strength of the query on one or two identities."""
    normal, raw, expanded = tx.expand_query(query)
    ids = [F.lower(F.coalesce(x, F.lit(""))) for x in (canonical, alternate) if x is not None]
    each = [F.greatest(*[strength(x, t) for x in ids]) if len(ids) > 1 else strength(ids[0], t) for t in expanded]
    total = lambda cols: sum(cols[1:], cols[0]) if cols else F.lit(0)
    hits = total([F.when(e > 0, 1).otherwise(0) for e in each])
    tier = F.when(ids[0] == normal, 5)
    if len(ids) > 1:
        tier = tier.when(ids[1] == normal, 4)
    if len(raw) == 1:
        prefix = ids[0].startswith(normal)
        for x in ids[1:]:
            prefix = prefix | x.startswith(normal)
        tier = tier.when(prefix, 3)
    return rows.withColumns({"tier": F.greatest(tier.otherwise(1), F.when(hits > 0, 2).otherwise(1)), "hits": hits, "strength": total(each)})


def bm25(rows: DataFrame, text: Column, query: str, stems: bool = False) -> DataFrame:
    """Adds ``bm25``: the Okapi score of the row's text for the query's tokens (any may match), 0 where none does."""
    words = tx.tokens(F.coalesce(text, F.lit("")))
    wanted = list(dict.fromkeys(t for token in tx.expand_query(query)[2] for t in _plain(token)))
    if stems:
        words, wanted = stemmed(words), list(dict.fromkeys(map(stem, wanted)))
    if not wanted:
        return rows.withColumn("bm25", F.lit(0.0))
    tf = [F.size(F.filter("_w", _equals(t))).alias(f"_t{k}") for k, t in enumerate(wanted)]
    counted = rows.withColumn("_w", words).select("*", *tf, F.size("_w").alias("_n")).drop("_w")
    return _scored(counted, len(wanted))


def _scored(counted: DataFrame, n: int) -> DataFrame:
    """Adds ``bm25`` from the columns ``_t0`` … of token counts and ``_n``, the length of a row."""
    wanted = range(n)
    corpus = counted.agg(F.count(F.lit(1)).alias("_docs"), F.avg("_n").alias("_avg"), *[F.sum(F.when(F.col(f"_t{k}") > 0, 1).otherwise(0)).alias(f"_d{k}") for k in range(len(wanted))])
    score = F.lit(0.0)
    for k in range(len(wanted)):
        idf = F.log(1 + (F.col("_docs") - F.col(f"_d{k}") + 0.5) / (F.col(f"_d{k}") + 0.5))
        score = score + idf * F.col(f"_t{k}") * (K1 + 1) / (F.col(f"_t{k}") + K1 * (1 - B + B * F.col("_n") / F.col("_avg")))
    joined = counted.join(F.broadcast(corpus))  # one row
    return joined.withColumn("bm25", score).drop("_n", "_docs", "_avg", *[f"_{c}{k}" for k in range(len(wanted)) for c in "td"])


def _equals(word: str):
    return lambda w: w == word


def _plain(token: str) -> list[str]:
    return re.findall(r"[^\W_]+", token)


def ranked(rows: DataFrame, canonical: Column, alternate: Column | None, text: Column, query: str, limit: int | None = 20, stems: bool = False, key: str = "id") -> DataFrame:
    """Rows that match by text or identity, best first: tier, hits, strength, text score, then key."""
    return _ordered(identity_rank(bm25(rows, text, query, stems), canonical, alternate, query), limit, key)


def _ordered(both: DataFrame, limit: int | None, key: str) -> DataFrame:
    found = both.where((F.col("bm25") > 0) | (F.col("hits") > 0))
    found = found.withColumn("score", F.col("tier") * 1_000_000 + F.col("hits") * 10_000 + F.col("strength") * 100 + F.col("bm25"))
    ordered = found.orderBy(F.desc("tier"), F.desc("hits"), F.desc("strength"), F.desc("bm25"), key)
    return ordered if limit is None else ordered.limit(limit)


class Index:
    """Written postings: (bucket, token, key, tf) in folders by the token's bucket, and (key, a, b, n), a row's identities and length.

    A query reads the buckets of its tokens and the narrow table, no text. Tokens are counted before they are shuffled,
    and a bucket is written by several tasks, so a token that stands in a third of all texts is spread.
    """

    BUCKETS, SPREAD = 64, 8

    def __init__(self, docs: DataFrame, postings: DataFrame, key: str, stems: bool):
        self.docs, self.postings, self.key, self.stems = docs, postings, key, stems

    @classmethod
    def build(cls, rows: DataFrame, key: str, canonical: Column, alternate: Column | None, text: Column, root: str, stems: bool = False) -> Index:
        """Write the index of rows under a folder that all executors share. Null keys are left out, null texts are empty."""
        spark = rows.sparkSession
        words = tx.tokens(F.coalesce(text, F.lit("")))
        words = stemmed(words) if stems else words
        src = rows.where(F.col(key).isNotNull()).select(F.col(key), canonical.alias("a"), (F.lit(None).cast("string") if alternate is None else alternate).alias("b"), words.alias("w"))
        src.select(key, "a", "b", F.size("w").alias("n")).write.parquet(f"{root}/docs")
        bucket = F.pmod(F.xxhash64("token"), F.lit(cls.BUCKETS)).cast("int")
        tf = src.select(key, F.explode("w").alias("token")).groupBy("token", key).agg(F.count(F.lit(1)).cast("int").alias("tf")).withColumn("bucket", bucket)
        tf.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(cls.SPREAD))).sortWithinPartitions("token").write.partitionBy("bucket").parquet(f"{root}/postings")
        postings = spark.read.schema(f"token string, {key} {rows.schema[key].dataType.simpleString()}, tf int, bucket int").parquet(f"{root}/postings")
        return cls(spark.read.parquet(f"{root}/docs"), postings, key, stems)

    def search(self, query: str, limit: int | None = 20) -> DataFrame:
        """Rows that match by text or identity, best first, as :func:`ranked` gives them from the texts."""
        wanted = list(dict.fromkeys(t for token in tx.expand_query(query)[2] for t in _plain(token)))
        wanted = list(dict.fromkeys(map(stem, wanted))) if self.stems else wanted
        hit = self.postings.where(F.col("token").isin(wanted)) if wanted else self.postings.limit(0)
        if wanted:  # the buckets are known before the scan
            numbers = self.docs.sparkSession.createDataFrame([(t,) for t in wanted], "token string").select(F.pmod(F.xxhash64("token"), F.lit(self.BUCKETS)).alias("b")).collect()
            hit = hit.where(F.col("bucket").isin([int(r["b"]) for r in numbers]))
        counts = hit.groupBy(self.key).agg(*[F.coalesce(F.sum(F.when(F.col("token") == t, F.col("tf"))), F.lit(0)).alias(f"_t{k}") for k, t in enumerate(wanted)], F.count(F.lit(1)).alias("_any"))
        rows = self.docs.withColumnRenamed("n", "_n").join(counts, self.key, "left").fillna(0, [f"_t{k}" for k in range(len(wanted))])
        return _ordered(identity_rank(_scored(rows, len(wanted)), F.col("a"), F.col("b"), query), limit, self.key)


def symbols(table: DataFrame, query: str, limit: int | None = 20, stems: bool = False) -> DataFrame:
    text = F.concat_ws(" ", tx.expand_name(F.col("name")), F.coalesce("comment", F.lit("")))
    return ranked(table, F.col("id"), F.col("name"), text, query, limit, stems)


def specs(table: DataFrame, query: str, limit: int | None = 20, stems: bool = False) -> DataFrame:
    text = F.concat_ws(" ", "spec_id", "title", "description", "content")
    return ranked(table, F.col("spec_id"), F.col("title"), text, query, limit, stems, "spec_id")


def documents(table: DataFrame, query: str, limit: int | None = 20, stems: bool = False) -> DataFrame:
    text = F.concat_ws(" ", "path", "config_relative_path", "content")
    return ranked(table, F.col("path"), F.col("config_relative_path"), text, query, limit, stems, "path")


def symbol_snippets(found: DataFrame, files: DataFrame, context: int = 2) -> DataFrame:
    """Adds snippet, start_line and end_line: the symbol's line and up to ``context`` non-blank lines on each side."""
    src = found.join(files.select(F.col("path").alias("file_path"), "content"), "file_path", "left")
    lines = F.split(F.coalesce("content", F.lit("")), "\r?\n")
    numbered = F.zip_with(lines, F.sequence(F.lit(1), F.size(lines)), lambda s, n: F.struct(n.alias("n"), s.alias("s")))
    full = F.filter(numbered, lambda x: F.trim(x["s"]) != "")
    before = F.filter(full, lambda x: x["n"] < F.col("line"))
    after = F.filter(full, lambda x: x["n"] > F.col("line"))
    first = F.coalesce(F.element_at(F.slice(F.reverse(before), 1, context), -1)["n"], F.col("line"))
    last = F.coalesce(F.element_at(F.slice(after, 1, context), -1)["n"], F.col("line"))
    src = src.withColumns({"start_line": F.greatest(first, F.lit(1)), "end_line": F.least(last, F.greatest(F.size(lines), F.lit(1)))})
    return src.withColumn("snippet", F.array_join(F.slice(lines, F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n")).drop("content")


def occurrences(table: DataFrame, key: str, text: str, needle: str, reach: int = 60) -> DataFrame:
    """Every place (overlaps too, case ignored) of a needle: key, position from 0, line, snippet; and its weight 1 + 1/(1 + position/length)."""
    if not needle:
        raise ValueError("an empty needle is everywhere")
    # cut before every occurrence, overlapping ones too: the lengths of the parts add up to the places
    folded = F.lower(F.coalesce(F.col(text), F.lit("")))
    parts = F.split(folded, "(?=" + re.escape(needle.lower()) + ")")
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("places"))
    found = F.aggregate(parts, state, lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.when((s["at"] > 0) | folded.startswith(needle.lower()), F.concat(s["places"], F.array(s["at"]))).otherwise(s["places"]).alias("places")))
    hit = table.where(folded.contains(needle.lower())).select(F.col(key), F.col(text).alias("_text"), F.explode(found["places"]).alias("position"))
    size = len(needle)
    before = F.substring("_text", F.lit(1), F.col("position"))
    return hit.select(key, "position", (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line"), F.substring("_text", F.greatest(F.col("position") - reach, F.lit(0)) + 1, F.lit(size + reach) + F.least("position", F.lit(reach))).alias("snippet"), (1 + 1 / (1 + F.col("position") / F.length("_text"))).alias("weight"))


def substring_search(table: DataFrame, key: str, text: str, needle: str) -> DataFrame:
    """Score per key of a substring search: the sum of the weights of its places."""
    return occurrences(table, key, text, needle).groupBy(key).agg(F.sum("weight").alias("score"), F.count(F.lit(1)).alias("matches"), F.min("line").alias("first_line"))


def federated(parts: list, limit: int) -> DataFrame:
    """The best of several results with the same columns: each cut to the limit, then all.

    A part is a DataFrame or a function that gives one; a function that fails is left out. If all fail, so does this.
    """
    out, error = None, None
    for part in parts:
        try:
            best = (part() if callable(part) else part).orderBy(F.desc("score")).limit(limit)
        except Exception as wrong:  # one workspace that cannot be read does not spoil the others
            error = wrong
            continue
        out = best if out is None else out.unionByName(best)
    if out is None:
        raise error or ValueError("nothing to search")
    return out.orderBy(F.desc("score")).limit(limit)


def shown_title(stored: Column, content: Column, key: Column) -> Column:
    """The stored title, else the first heading, else the key."""
    return F.coalesce(F.nullif(F.trim(stored), F.lit("")), tx.title(content, key))


def like_literal(value: str) -> str:
    """A text for LIKE … ESCAPE '\\' that matches itself only."""
    return re.sub(r"([\\%_])", r"\\\1", value)


def merged(parts: list[DataFrame], key: str) -> DataFrame:
    """Candidates (key, score, snippet) of several searches: each key once, with its largest score and snippet."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(key).agg(F.max("score").alias("score"), F.max("snippet").alias("snippet"))
