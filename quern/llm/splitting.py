"""Splitting oversized items at natural boundaries, by content-defined chunking.

A rolling hash over the last ``WINDOW`` characters marks landmarks that depend on nothing but the text around them. A piece
ends at the first landmark past the least size, moved to the nearest natural boundary (end of a paragraph, line or
sentence; between words where there is none); without a landmark it ends before the limit. So an edit changes the pieces near it and no others.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 6_000, 200
WINDOW, SPACING = 64, 1_400
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Natural boundaries (ends of paragraphs, lines and sentences), and what is left between words.
_KINDS = [re.compile(r"\n[ \t\r]*\n[ \t\r\n]*|\n[ \t]*|[.!?;。！？]['\"”’)\]]*\s+|[。！？]"), re.compile(r"\s+")]


def landmarks(text: str, spacing: int = SPACING) -> np.ndarray:
    """Positions after which a cut may fall, one in about ``spacing``, by the hash of the ``WINDOW`` characters before."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        power, width = _BASE, 1
        while width < WINDOW:  # a window of twice the width is two windows side by side
            if len(h) > width:
                before = np.concatenate([np.zeros(width, np.uint64), h[:-width]])
                h = h + before * power
            power, width = power * power, width * 2
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.flatnonzero((h >> np.uint64(24)) % np.uint64(spacing) == 0) + 1


def _snap(at: int, low: int, high: int, kinds: list[np.ndarray]) -> int:
    """The natural boundary in bounds that is nearest to the landmark; without one the nearest blank, else the place itself."""
    for ends in kinds:
        i, j = np.searchsorted(ends, [low, high + 1])
        if i < j:
            near = ends[i:j]
            return int(near[np.argmin(np.abs(near - at))])
    return at


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces: each at most ``limit`` long, each beginning ``overlap`` before the end of the last.

    A text within the limit is one piece; an empty one has none.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    fresh = limit - overlap  # new characters a piece may bring
    least = max(1, fresh // 3)
    marks = landmarks(text, max(1, min(SPACING, fresh // 4)))
    kinds = [np.array([m.end() for m in kind.finditer(text)], dtype=np.int64) for kind in _KINDS]
    out, at = [], 0
    while True:
        begin = max(0, at - overlap) if at else 0
        if len(text) - begin <= limit:
            out.append((begin, len(text)))
            return out
        low, high = at + least, begin + limit
        i, j = np.searchsorted(marks, [low, high + 1])
        end = _snap(int(marks[i]) if i < j else high, low, high, kinds)
        if end == high and text[end - 1] == "\r" and text[end] == "\n":
            end -= 1
        out.append((begin, max(end, at + 1)))
        at = max(end, at + 1)


def _pieces(limit: int, overlap: int):
    def run(batches):
        for pdf in batches:
            rows = []
            for table, key, version, text in pdf[["item_table", "item_key", "version", "content"]].itertuples(index=False, name=None):
                last = 0
                for n, (a, b) in enumerate(cuts(text, limit, overlap)):
                    rows.append((table, key, version, n, a, b, max(0, last - a), text[a:b]))
                    last = b
            yield pd.DataFrame(rows, columns=["item_table", "item_key", "version", "piece", "start", "end", "overlap", "text"])

    return run


def oversized(items: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Items (item_table, item_key, content) longer than the limit, in characters, with the version of their content; repeated rows once."""
    big = items.where(F.col("item_key").isNotNull() & (F.length("content") > limit))
    return big.select("item_table", "item_key", F.xxhash64("content").alias("version"), "content").dropDuplicates(["item_table", "item_key", "version"])


def split(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every oversized item: item_table, item_key, version, piece (from 0), start, end, overlap, text.

    ``overlap`` is how many first characters repeat the piece before, so the texts without them join to the content.
    Null keys, null contents and items within the limit give nothing; two contents of one key are two versions;
    other columns are ignored.
    """
    schema = "item_table string, item_key string, version long, piece int, start int, end int, overlap int, text string"
    return oversized(items, limit).mapInPandas(_pieces(limit, overlap), schema)


def items_of(files: DataFrame, specs: DataFrame, docnodes: DataFrame) -> DataFrame:
    one = lambda df, table, key: df.select(F.lit(table).alias("item_table"), F.col(key).cast("string").alias("item_key"), "content")
    return one(files, "files", "path").unionByName(one(specs, "specs", "spec_id")).unionByName(one(docnodes, "docnodes", "path"))
