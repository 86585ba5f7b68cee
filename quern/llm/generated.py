"""Generated, minified and vendored files, and data saved as code.

A random forest over what a text is like (compression ratio, token entropy, identifier lengths, comment density, line
and character make-up) learns from files that say what they are: a notice in the header, a telling path, a text that is
nothing but one literal. Notices and paths are hidden from the features, so the forest finds the files that say nothing.
A file is reported if it says so itself or the forest gives it at least ``THRESHOLD``.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import Scratch

#: The forest is fitted on at most about this many rows, taken by the hash of the path; everything else covers all rows.
FIT_ROWS = 20_000
THRESHOLD = 0.5
#: Files that say nothing but score this much in a first forest are no examples of hand-written text for the second.
DOUBT = 0.3

# Folders and name endings by which tools and package managers keep what nobody wrote here.
FOLDERS = ["node_modules", "vendor", "vendored", "third_party", "thirdparty", "third-party", "bower_components", "site-packages", "dist", "generated", "__generated__", "gen", "autogen", "codegen_out", "external/[^/]+/[^/]+", "public/assets"]
PATH = re.compile(r"(?:^|[:/])(?:" + "|".join(FOLDERS) + r")/", re.IGNORECASE)
NAME = re.compile(r"(?:[._-]min|\.bundle|[._-]chunk|\.gen|\.generated|\.g|\.pb|_pb|_pb2|_pb2_grpc|_gen|_generated|\.designer|zz_generated.*|\.pb\.gw)\.[A-Za-z]+$", re.IGNORECASE)
# What header comments of such files say.
NOTICES = [
    r"code\s+generated\s+(?:by|from)\b", r"\bauto(?:matically)?[\s-]?generated\b", r"(?:^|\s)@generated\b", r"\bgenerated\s+(?:by|from|using|with)\s+[`'\"]?[\w./-]+.*(?:do\s+not|don't|edit|modif|overwrit|\d)",
    r"\bthis\s+file\s+(?:was|is|has\s+been)\s+(?:\w+\s+)?(?:generated|produced|created\s+by|emitted)", r"\bdo\s+not\s+(?:edit|modify|change)\b", r"\bproduced\s+by\s+\S+\s+(?:at\s+build|from|\d)", r"\b(?:manual|any|local)\s+(?:\w+\s+)?(?:edits?|changes?)\s+(?:(?:is|are|will\s+be|gets?)\s+)?(?:overwritten|lost)", r"\bchanges\s+will\s+be\s+lost\b",
    r"\boutput\s+of\s+\S+\.\w+\s*\(run\b", r"\bautogenerated\s+from\b", r"\bgenerado\s+autom[aá]ticamente\b", r"\bno\s+lo\s+(?:modifique|edite)\b", r"\bautomatisch\s+(?:erzeugt|generiert|erstellt)\b", r"\bnicht\s+(?:bearbeiten|editieren|ändern)\b", r"\bg[eé]n[eé]r[eé]\s+automatiquement\b", r"\bne\s+pas\s+modifier\b", r"\bgerado\s+automaticamente\b",
    r"\bupstream\s+copy\b", r"\bvendored\s+(?:from|copy)\b", r"\bcopied\s+(?:verbatim\s+)?from\s+(?:the\s+)?[\w./@-]+", r"\bsee\s+upstream\b", r"\(c\)\s+(?:\d{4}[\d, -]*)?(?:the\s+)?[\w.-]+\s+contributors\b", r"@license\s+\S+\s+\S*\d", r"^\s*!\s*\S+\s+v\d+\.\d+", r"\btaken\s+(?:verbatim\s+)?from\s+(?:the\s+)?[\w./@-]+\s+(?:project|library|package)", r"\bv\d+\.\d+\S*\s+-\s+\w+\s+licensed\b",
]
NOTICE = re.compile("|".join(f"(?:{n})" for n in NOTICES), re.IGNORECASE | re.MULTILINE)
MAP_LINE = re.compile(r"^[^\S\n]*+(?://|/\*)[#@]\s*sourceMappingURL=", re.MULTILINE)

_HEAD = re.compile(r"\A﻿?(?:#![^\n]*\n)?(?:\s*(?:<\?php\b|//[^\n]*|#[^\n]*|/\*[\s\S]*?\*/|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|['\"]use strict['\"];?|declare\(strict_types=1\);))+")
_COMMENT = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|^[ \t]*#[^\n]*|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''", re.MULTILINE)
_TOKEN = re.compile(r"[^\W\d]\w*|\d+|[^\s\w]")
_LITERAL = re.compile(r"\A﻿?\s*(?:package\s+\w+\s*|<\?php\s*)?(?:(?:export\s+(?:default\s+)?)?(?:const|var|let)?\s*[\w$]+(?:\s*:\s*[\w<>\[\]]+)?\s*=\s*|module\.exports\s*=\s*|export\s+default\s+|return\s+)?(?:\[\]\w+\s*|map\[\w+\]\w+\s*)?[\[{(\"'`]")
_VALUES = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\b(?:0[xX][\da-fA-F]+|\d[\d.]*|true|false|null|None|True|False|nil|any|string|int)\b|[\s\[\]{}(),:;+-]|=>")
_INSIDE = re.compile(r"\A[\s*/#!\"'-]+", re.MULTILINE)
FEATURES = ["log_chars", "ratio", "entropy", "char_entropy", "ident_mean", "ident_long", "ident_short", "distinct", "comment", "line_mean", "line_max", "spaces", "digits", "punctuation", "quotes", "repeat"]


def notice_in_header(text: str) -> bool:
    """Whether the comments before the first code say the file is generated, minified or taken over; a source map line counts too."""
    head = _HEAD.match(text)
    if head:
        said = _INSIDE.sub(lambda m: "!" if "!" in m[0] else " ", re.sub(r"^[ \t]*(?://+|#+|\*+|/\*+)", lambda m: "!" if m[0].endswith("!") else "", head[0], flags=re.MULTILINE))
        if NOTICE.search(said) or re.search(r"/\*!\s*\S+\s+v?\d+\.\d+", head[0]):
            return True
    return bool(MAP_LINE.search(text))


def is_one_literal(text: str) -> bool:
    """Whether the text is one array, object or string, assigned, returned or bare, and little else."""
    body = _HEAD.sub("", text, count=1) if not text.lstrip("﻿ \n").startswith("<?php") else text
    m = _LITERAL.match(body)
    if not m or len(body) < 200:
        return False
    rest = body[m.end() - 1 :]
    return len(_VALUES.sub("", rest)) <= 0.02 * len(rest)


def features(text: str) -> list[float]:
    """Numbers on the text without its header comment and source map line."""
    body = MAP_LINE.sub("", _HEAD.sub("", text, count=1))
    raw = body.encode("utf-8", "replace")
    n = max(1, len(body))
    tokens = _TOKEN.findall(body)
    counts = Counter(tokens)
    total = max(1, len(tokens))
    names = [(t, k) for t, k in counts.items() if t[0].isalpha() or t[0] == "_"]
    named = max(1, sum(k for _, k in names))
    entropy = math.log2(total) - sum(k * math.log2(k) for k in counts.values()) / total
    chars = Counter(body)
    char_entropy = math.log2(n) - sum(k * math.log2(k) for k in chars.values()) / n
    lines = body.split("\n")
    comments = sum(map(len, _COMMENT.findall(body)))
    # head and tail of lines: how often a line starts as another does
    starts = Counter(re.sub(r"\d+", "0", line.strip()[:12]) for line in lines if line.strip())
    repeat = sum(k for k in starts.values() if k > 2) / max(1, sum(starts.values()))
    return [
        math.log(n), len(zlib.compress(raw, 1)) / max(1, len(raw)), entropy, char_entropy, sum(len(t) * k for t, k in names) / named, sum(k for t, k in names if len(t) >= 8) / named, sum(k for t, k in names if len(t) <= 2) / named,
        len(counts) / total, comments / n, n / len(lines), math.log1p(max(map(len, lines))), sum(chars[c] for c in " \t\n") / n, sum(chars[c] for c in "0123456789") / n, sum(chars[c] for c in "{}()[];,.:=<>") / n, sum(chars[c] for c in "\"'`") / n, repeat,
    ]


def _describe(batches):
    for pdf in batches:
        rows = []
        for path, text in zip(pdf["path"], pdf["content"], strict=True):
            if text is None or not text.strip():
                rows.append((path, bool(PATH.search(path) or NAME.search(path)), False, *[None] * len(FEATURES)))
                continue
            says = bool(PATH.search(path) or NAME.search(path) or notice_in_header(text))
            rows.append((path, says, is_one_literal(text), *features(text)))
        yield pd.DataFrame(rows, columns=["path", "says", "literal", *FEATURES])


def described(files: DataFrame) -> DataFrame:
    """Per row: path, ``says`` (path or header tells), ``literal`` and the features; features are null for null and blank texts."""
    schema = "path string, says boolean, literal boolean, " + ", ".join(f"{f} double" for f in FEATURES)
    return files.where("path is not null").select("path", "content").mapInPandas(_describe, schema)


def _forest(trees: int, depth: int) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=3, maxBins=64, seed=7, featuresCol="features", labelCol="label")


def _fitted(sample: DataFrame):
    """The second forest, fitted without the unlabelled rows that the first doubts."""
    first = _forest(20, 7).fit(sample)
    clear = first.transform(sample).where((F.col("label") == 1) | (vector_to_array("probability")[1] < DOUBT)).select("features", "label")
    return _forest(30, 9).fit(clear)


def classify(files: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per path: ``path``, ``says``, ``literal``, ``score`` (the forest's, null where there is no text) and ``found``.

    Rows that repeat a path count once, with their largest values. Null and blank texts are found only by their path.
    Without both labelled and other files there is nothing to learn: the score is then 1 for labelled files and 0 for
    others. Notices name only some of the positives, so the forest is fitted twice: unlabelled files that the first one
    doubts are left out of the second's examples. Null paths are left out; an empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(files.sparkSession, "generated")
    rows = scratch.put(described(files))
    rows = rows.withColumn("label", (F.col("says") | F.col("literal")).cast("double"))
    texts = rows.where("ratio is not null")
    share = texts.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).first()
    n, pos = share["n"], share["pos"] or 0
    if 0 < pos < n:
        keep = fit_rows / max(n, fit_rows)
        # the hash of the path as a number in [0, 1): the same rows on every run, about fit_rows of them
        sample = texts.where((F.xxhash64("path").bitwiseAND(F.lit(0xFFFFFF)) / F.lit(float(0x1000000))) < keep)
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
        sample = scratch.put(vectors.transform(sample).select("features", "label"))
        forest = _fitted(sample)
        scored = forest.transform(vectors.transform(texts)).select("path", "says", "literal", vector_to_array("probability")[1].alias("score"))
    else:
        scored = texts.select("path", "says", "literal", F.col("label").alias("score"))
    out = scored.unionByName(rows.where("ratio is null").select("path", "says", "literal", F.lit(None).cast("double").alias("score")))
    out = out.groupBy("path").agg(F.max("says").alias("says"), F.max("literal").alias("literal"), F.max("score").alias("score"))
    return out.withColumn("found", F.col("says") | F.coalesce(F.col("score") >= threshold, F.lit(False)))


def held_out(files: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """What the forest alone finds on rows it was not fitted on: (sign, rows, found).

    ``sign`` is ``notice or path``, ``literal`` or ``none``. Half of the rows, by the hash of the path, fit; the other
    half, all of it, is scored. A table without both kinds of rows gives no row.
    """
    scratch = Scratch(files.sparkSession, "held-out")
    rows = scratch.put(described(files).where("ratio is not null").withColumn("label", (F.col("says") | F.col("literal")).cast("double")))
    side = F.pmod(F.xxhash64(F.lit("half"), "path"), F.lit(2))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    n = rows.count()
    keep = 2 * fit_rows / max(n, 2 * fit_rows)
    mine = scratch.put(vectors.transform(rows.where((side == 0) & (F.xxhash64("path").bitwiseAND(F.lit(0xFFFFFF)) / F.lit(float(0x1000000)) < keep))).select("features", "label"))
    sign = F.when(F.col("says"), "notice or path").when(F.col("literal"), "literal").otherwise("none").alias("sign")
    if mine.select("label").distinct().count() < 2:
        return rows.limit(0).select(sign, F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("found"))
    forest = _fitted(mine)
    scored = forest.transform(vectors.transform(rows.where(side == 1))).select(sign, vector_to_array("probability")[1].alias("score"))
    return scored.groupBy("sign").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.col("score") >= threshold, 1).otherwise(0)).alias("found"))
