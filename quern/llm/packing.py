"""Filling fixed-capacity containers with texts, by swap-based local search.

Texts are measured in tokens of a public tokenizer. They are dealt by hash into groups of bounded size, and each group is
packed by itself: best fit gives a start, then documents move and are exchanged one for one and two for one between
underfull containers. Every step raises the sum of squared fills, so it ends, and containers run empty on the way.
At most one container a group is left far from full, a share that does not grow with the data.
"""

from __future__ import annotations

import base64
import bisect
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import Scratch

CAPACITY = 4_096
#: Texts in a group; a group is one task's work.
GROUP = 8_000
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def tokenizer(ranks: str = RANKS):
    import tiktoken

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def _measure(ranks: str):
    def run(batches):
        encode = tokenizer(ranks).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": np.array([_count(encode, text) for text in pdf["text"]], dtype=np.int64)})

    return run


def _count(encode, text: str, step: int = 1 << 20) -> int:
    """Tokens of a text; very long ones in slices at line ends, where the pattern splits anyway."""
    if len(text) <= step:
        return len(encode(text))
    total, at = 0, 0
    while at < len(text):
        end = text.find("\n", at + step)
        end = len(text) if end < 0 else end
        total += len(encode(text[at:end]))
        at = end
    return total


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers of item numbers: largest items first, each where the least room is left."""
    rooms: list[tuple[int, int]] = []  # (room, container), sorted
    bins: list[list[int]] = []
    for item in np.argsort(-sizes, kind="stable"):
        size = int(sizes[item])
        at = bisect.bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(int(item))
        bisect.insort(rooms, (room - size, b))
    return bins


def improve(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Move and exchange items from the emptiest container into others that have room, while squared fill rises."""
    bins = [b for b in bins if b]
    fill = [int(sizes[b].sum()) for b in bins]
    bound = -(-sum(fill) // capacity)
    stuck: set[int] = set()
    while len([b for b in bins if b]) > bound:
        live = [i for i, b in enumerate(bins) if b and i not in stuck]
        if len(live) < 2:
            break
        a = min(live, key=lambda i: (fill[i], i))
        moved = False
        for b in sorted((i for i in live if i != a and fill[i] < capacity), key=lambda i: (-fill[i], i)):
            while bins[a] and (step := _step(sizes[bins[a]], sizes[bins[b]], capacity - fill[b])):
                give, take = step
                out = [bins[a][k] for k in give]
                back = [bins[b][k] for k in take]
                bins[a] = [x for k, x in enumerate(bins[a]) if k not in give] + back
                bins[b] = [x for k, x in enumerate(bins[b]) if k not in take] + out
                gain = int(sizes[out].sum() - (sizes[back].sum() if back else 0))
                fill[a], fill[b], moved = fill[a] - gain, fill[b] + gain, True
            if not bins[a]:
                break
        if not moved:
            stuck.add(a)
    return [b for b in bins if b]


def _step(a: np.ndarray, b: np.ndarray, room: int):
    """The exchange that fills ``room`` best: (items of a to give, items of b to take), or None. The gain is positive."""
    if room <= 0:
        return None
    best, step = 0, None
    gains = np.where(a <= room, a, 0)
    if gains.max() > best:
        best, step = int(gains.max()), ((int(gains.argmax()),), ())
    ones = a[:, None] - b[None, :]
    ones = np.where(ones <= room, ones, 0)
    if ones.size and ones.max() > best:
        i, j = np.unravel_index(ones.argmax(), ones.shape)
        best, step = int(ones.max()), ((int(i),), (int(j),))
    if len(a) > 1 and len(b):
        i, j = np.triu_indices(len(a), 1)
        twos = (a[i] + a[j])[:, None] - b[None, :]
        twos = np.where(twos <= room, twos, 0)
        if twos.max() > best:
            p, k = np.unravel_index(twos.argmax(), twos.shape)
            best, step = int(twos.max()), ((int(i[p]), int(j[p])), (int(k),))
    return step


def pack_sizes(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    return improve(best_fit(sizes, capacity), sizes, capacity)


def _pack(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], ignore_index=True)
        sizes = pdf["tokens"].to_numpy(dtype=np.int64)
        slot = np.empty(len(pdf), dtype=np.int64)
        for n, items in enumerate(pack_sizes(sizes, capacity)):
            slot[items] = n
        pdf["container"] = pdf["part"] * np.int64(1 << 32) + slot
        return pdf[["container", "doc_id", "piece", "start_token", "tokens"]]

    return run


def pack(documents: DataFrame, capacity: int = CAPACITY, ranks: str = RANKS, group: int = GROUP) -> DataFrame:
    """Every text in a container: container, doc_id, piece, start_token, tokens; the tokens of a container never exceed the capacity.

    A text larger than the capacity is cut into full pieces and a rest; no other text is split. Null ids and null
    texts are left out; an empty text takes no room but has its row; a repeated id counts once, with its longest text;
    an empty table gives an empty result; other columns are ignored.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "packing")
    src = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    key = src.schema["doc_id"].dataType.simpleString()
    measured = scratch.put(src.mapInPandas(_measure(ranks), f"doc_id {key}, tokens long").groupBy("doc_id").agg(F.max("tokens").alias("tokens")))
    pieces = measured.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("tokens") / capacity) - 1, F.lit(0)).cast("int")), lambda k: k)).alias("piece", "k"), "tokens")
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * F.lit(capacity)).cast("long").alias("start_token"), F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("piece") * F.lit(capacity)).alias("tokens"))
    groups = max(1, -(-measured.count() // group))
    # a full piece is a container as it is: only rests, one a text at most, are packed
    whole = pieces.where(F.col("tokens") == capacity).select((-1 - F.monotonically_increasing_id()).alias("container"), "doc_id", "piece", "start_token", "tokens")
    dealt = pieces.where(F.col("tokens") < capacity).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    packed = dealt.groupBy("part").applyInPandas(_pack(capacity), f"container long, doc_id {key}, piece int, start_token long, tokens long")
    return packed.unionByName(whole)
