"""Queries of the problems on text and vectors, and their SQL where there is any."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import functions, generated, leakage, neighbours, packing, prose, splitting, validity
from quern.session import Scratch
from quern.tables import load


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return generated.classify(load(spark, folder, "files")).where("found").select("path")


def p1_held_out(spark: SparkSession, folder: str) -> DataFrame:
    return generated.held_out(load(spark, folder, "files"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return functions.documented(load(spark, folder, "symbols"), load(spark, folder, "files"), with_code=False, without_node=True).select("symbol_id")


def p2_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return functions.documented(load(spark, folder, "symbols"), load(spark, folder, "files"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.alike(neighbours.nearest(load(spark, folder, "files")))


def p3_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(load(spark, folder, "files")).neighbours


def p3_recall(spark: SparkSession, folder: str) -> DataFrame:
    files = load(spark, folder, "files")
    return neighbours.recall(files, Scratch(spark, "nearest").put(neighbours.nearest(files).neighbours))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return validity.verdicts(load(spark, folder, "files")).where("not valid").select("path").distinct()


def p4_rates(spark: SparkSession, folder: str) -> DataFrame:
    return validity.rates(validity.verdicts(load(spark, folder, "files")))


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.items_of(*(load(spark, folder, name) for name in ("files", "specs", "docnodes")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    pieces = splitting.split(_items(spark, folder))
    return pieces.where("piece = 0").select("item_table", "item_key").distinct()


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split(_items(spark, folder))


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(load(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(load(spark, folder, "documents"), load(spark, folder, "evalitems")).select("doc_id", "item_id")


def p8_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    found = leakage.leaks(load(spark, folder, "documents"), load(spark, folder, "evalitems"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("words").alias("longest"))


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    documents = load(spark, folder, "documents")
    return leakage.clean(documents, leakage.leaks(documents, load(spark, folder, "evalitems"))).select("doc_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return prose.verdicts(load(spark, folder, "documents"), load(spark, folder, "commonwords")).where("not natural").select("doc_id").distinct()


def p9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return prose.statistics(load(spark, folder, "documents"), load(spark, folder, "commonwords"))


def p9_counts(spark: SparkSession, folder: str) -> DataFrame:
    return prose.counts(load(spark, folder, "documents"), load(spark, folder, "commonwords"))


QUERIES = {
    "p1_found": p1_found, "p1_held_out": p1_held_out, "p2_found": p2_found, "p2_pairs": p2_pairs, "p3_found": p3_found, "p3_nearest": p3_nearest, "p3_recall": p3_recall, "p4_found": p4_found, "p4_rates": p4_rates, "p6_found": p6_found, "p6_pieces": p6_pieces,
    "p7_packed": p7_packed, "p8_found": p8_found, "p8_leaked_items": p8_leaked_items, "p8_clean": p8_clean, "p9_found": p9_found, "p9_statistics": p9_statistics, "p9_counts": p9_counts,
}

_USABLE = "u AS (SELECT path, min(CAST(embedding AS DOUBLE[])) AS v FROM files WHERE path IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY path)"
_SHINGLES = """
d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM evalitems WHERE text IS NOT NULL),
dg AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 10, 1)), lambda i: array_to_string(w[i:i+11], ' '))) AS g FROM d),
eg AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 10, 1)), lambda i: array_to_string(w[i:i+11], ' '))) AS g FROM e)
"""

SQL = {
    "p3_found": f"""WITH {_USABLE},
s AS (SELECT a.path, b.path AS other, list_cosine_similarity(a.v, b.v) AS sim FROM u a JOIN u b ON a.path <> b.path),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY sim DESC, other) AS n FROM s)
SELECT DISTINCT least(path, other) AS path_a, greatest(path, other) AS path_b FROM r WHERE n <= 5 AND sim >= 0.9""",
    "p6_found": " UNION ".join(f"SELECT '{table}' AS item_table, {key} AS item_key FROM {table} WHERE {key} IS NOT NULL AND length(content) > 6000" for table, key in (("files", "path"), ("specs", "spec_id"), ("docnodes", "path"))),
    "p8_found": f"WITH {_SHINGLES} SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)",
    "p8_leaked_items": f"""WITH {_SHINGLES.replace("unnest(list_transform", "unnest(range(1, greatest(len(w) - 10, 1))) AS i, unnest(list_transform").replace("eg AS (SELECT DISTINCT", "eg AS (SELECT")},
mt AS (SELECT DISTINCT doc_id, item_id, dg.i AS i, dg.i - eg.i AS diagonal FROM dg JOIN eg USING (g)),
rn AS (SELECT doc_id, item_id, diagonal, i - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY i) AS run FROM mt),
ln AS (SELECT doc_id, item_id, count(*) + 11 AS words FROM rn GROUP BY doc_id, item_id, diagonal, run)
SELECT item_id, count(DISTINCT doc_id) AS documents, max(words) AS longest FROM ln GROUP BY item_id""",
    "p8_clean": f"WITH {_SHINGLES} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM dg JOIN eg USING (g))",
    "p9_counts": """WITH k AS (SELECT DISTINCT lower(word) AS word FROM commonwords),
t AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w, list_filter(list_transform(string_split(text, chr(10)), lambda s: regexp_replace(s, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g')), lambda s: s <> '') AS l FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM t) x JOIN k USING (word) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS INTEGER) AS words, round(CASE WHEN len(w) > 0 THEN length(array_to_string(w, '')) / len(w) ELSE 0 END, 6) AS mean_word_length,
 round(CASE WHEN length(regexp_replace(text, '[ \\t\\r\\n]', '', 'g')) > 0 THEN length(regexp_replace(text, '[\\p{L}\\p{N} \\t\\r\\n]', '', 'g')) / length(regexp_replace(text, '[ \\t\\r\\n]', '', 'g')) ELSE 0 END, 6) AS symbol_ratio,
 CAST(len(l) AS INTEGER) AS lines, round(CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda s: regexp_matches(s, '[.!?…]$'))) / len(l) ELSE 0 END, 6) AS punctuated_lines,
 round(CASE WHEN len(w) > 0 THEN coalesce(c.n, 0) / len(w) ELSE 0 END, 6) AS common_words
FROM t LEFT JOIN c ON c.doc_id = t.doc_id""",
}
MODULES = [sys.modules[__name__]]
