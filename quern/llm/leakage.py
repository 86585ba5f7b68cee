"""Evaluation texts that leaked into a corpus, by suffix arrays over the corpus.

Each shard of the corpus, a bounded run of documents, becomes a suffix array over its words: suffixes sorted by their first
27 words, by sorting triples, triples of triples, and once more. Every suffix of every item is looked up in it by binary
search; what shares at least ``LEAST`` words is followed to the longest verbatim match. Documents never leave their
partition and each shard is built once. Items are broadcast in blocks of bounded size, which a shard takes one after
the other; only beyond ``PASS`` blocks is the corpus read again.

Passages that many items and documents share (an instruction, a licence, one word again and again) are classes: places
with the same words before and at them, and suffixes whose word before differs. Only members of such classes that cannot
be longer to the left are paired, in windows of bounded size.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import Scratch

LEAST = 12
#: Words in a shard, below 2**21; characters of items in a block, and blocks in one pass over the corpus: 128 MB of text.
SHARD, ITEM_BLOCK, PASS = 1_000_000, 16_000_000, 8
#: Pairs of places looked at together.
PAIRS = 200_000
_WORD = re.compile(r"[^\W_]+")
_BITS = 21


class _Numbers(dict):
    """Numbers words from 1, as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self) + 1
        return n


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Shard:
    """A suffix array over documents, each given as its words' numbers; 0 parts documents and ends the array."""

    def __init__(self, docs: list[list[int]]):
        self.starts = np.cumsum([0] + [len(d) + 1 for d in docs])
        flat = np.zeros(int(self.starts[-1]), dtype=np.int64)
        for a, d in zip(self.starts, docs, strict=False):
            flat[a : a + len(d)] = d
        self.words = flat
        self.key3, self.rank3 = self._rank(flat, 1)
        self.key9, self.rank9 = self._rank(self.rank3, 3)
        keys = self._packed(self.rank9, 9)
        self.suffixes = np.argsort(keys, kind="stable")
        self.keys = keys[self.suffixes]
        self.before = flat[self.suffixes - 1]  # the word before each suffix, 0 where there is none
        self.first9 = self.key9 >> (2 * _BITS)  # of each rank of nine words, its first three

    @staticmethod
    def _packed(rank: np.ndarray, step: int) -> np.ndarray:
        n = len(rank)
        out = rank << (2 * _BITS)
        out[: max(0, n - step)] |= rank[step:] << _BITS
        out[: max(0, n - 2 * step)] |= rank[2 * step :]
        return out

    @classmethod
    def _rank(cls, rank: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted distinct keys of three neighbours, and each place's number among them from 0."""
        keys = cls._packed(rank, step)
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        new = np.empty(len(s), dtype=bool)
        new[:1] = True
        np.not_equal(s[1:], s[:-1], out=new[1:])
        out = np.empty(len(s), dtype=np.int64)
        out[order] = np.cumsum(new) - 1
        return s[new], out

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        at = np.searchsorted(keys, wanted)
        return np.where((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == wanted), at, -1)

    def ranges(self, items: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place in ``items``, the range of suffixes that share its first twelve words."""
        three = [self._find(self.key3, (items[at + k] << (2 * _BITS)) | (items[at + k + 1] << _BITS) | items[at + k + 2]) for k in (0, 3, 6, 9)]
        known = np.minimum.reduce(three) >= 0
        nine = np.where(known, self._find(self.key9, (three[0].clip(0) << (2 * _BITS)) | (three[1].clip(0) << _BITS) | three[2].clip(0)), -1)
        known &= nine >= 0
        # ranks of nine words are in order, so those that begin with the fourth triple are neighbours
        lo, hi = np.searchsorted(self.first9, three[3], "left"), np.searchsorted(self.first9, three[3], "right")
        known &= lo < hi
        base = nine.clip(0) << (2 * _BITS)
        a = np.searchsorted(self.keys, base | (lo << _BITS), "left")
        b = np.searchsorted(self.keys, base | ((hi - 1).clip(0) << _BITS) | ((1 << _BITS) - 1), "right")
        return np.where(known, a, 0), np.where(known, b, 0)


def _spans(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of some runs laid end to end."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _classes(shard: Shard, a: np.ndarray, b: np.ndarray, before: np.ndarray):
    """Of each class (a range of suffixes, the word before its places) the suffixes with another word before: (how many, them)."""
    count, found = np.zeros(len(a), dtype=np.int64), []
    cum = np.concatenate([[0], np.cumsum(b - a)])
    at = 0
    while at < len(a):  # whole classes, about PAIRS suffixes at a time; a larger class by itself
        end = max(at + 1, int(np.searchsorted(cum, cum[at] + PAIRS, "right")) - 1)
        n = (b - a)[at:end]
        own = np.repeat(np.arange(at, end), n)
        where = a[own] + _spans(n)
        good = shard.before[where] != before[own]
        np.add.at(count, own[good], 1)
        found.append(shard.suffixes[where[good]])
        at = end
    return count, np.concatenate([np.array([], dtype=np.int64), *found])


def matches(shard: Shard, items: np.ndarray, item_starts: np.ndarray, least: int = LEAST):
    """Maximal common runs of at least ``least`` (12 or more) words, in windows: arrays (document, item, place in each, length)."""
    ends = np.append(item_starts, len(items))[1:] - 1  # each item is ended by -1
    at = np.concatenate([np.array([], dtype=np.int64), *(np.arange(a, b - least + 1) for a, b in zip(item_starts, ends, strict=True))]).astype(np.int64)
    if len(at):
        # a window with a word the shard does not have cannot match
        known = np.concatenate([[0], np.cumsum(items > 0)])
        at = at[known[at + LEAST] - known[at] == LEAST]
    if not len(at):
        return
    a, b = shard.ranges(items, at)
    at, a, b = at[b > a], a[b > a], b[b > a]
    before = np.where(at > 0, items[at - 1], -1)
    order = np.lexsort((before, a))
    at, a, b, before = at[order], a[order], b[order], before[order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (before[1:] != before[:-1])])) if len(at) else np.array([], dtype=np.int64)
    places = np.diff(np.append(new, len(at)))
    suffixes, where_all = _classes(shard, a[new], b[new], before[new])
    first = np.cumsum(suffixes) - suffixes
    cum = np.concatenate([[0], np.cumsum(places * suffixes)])
    for low in range(0, int(cum[-1]), PAIRS):
        pair = np.arange(low, min(low + PAIRS, int(cum[-1])))
        own = np.searchsorted(cum, pair, "right") - 1
        off = pair - cum[own]
        place = at[new[own] + off // suffixes[own]]
        where = where_all[first[own] + off % suffixes[own]]
        length = _follow(shard.words, items, where, place)
        keep = length >= least
        place, where, length = place[keep], where[keep], length[keep]
        doc = np.searchsorted(shard.starts, where, "right") - 1
        item = np.searchsorted(item_starts, place, "right") - 1
        yield doc, item, where - shard.starts[doc], place - item_starts[item], length


def _follow(words: np.ndarray, items: np.ndarray, where: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How long each pair, alike for ``LEAST`` words, goes on; ends of documents (0) and items (-1) are alike to nothing."""
    length = np.full(len(where), LEAST, dtype=np.int64)
    going = np.arange(len(where))
    while going.size:
        step = np.arange(max(1, min(1_024, 2_000_000 // going.size)))
        w = np.minimum(where[going, None] + length[going, None] + step, len(words) - 1)
        p = np.minimum(place[going, None] + length[going, None] + step, len(items) - 1)
        differ = words[w] != items[p]
        stops = differ.any(axis=1)
        length[going] += np.where(stops, differ.argmax(axis=1), len(step))
        going = going[~stops]
    return length


class _Reader:
    """Documents of a partition as shards; longer ones in runs that overlap by ``least - 1`` words, whose matches are joined again."""

    def __init__(self, blocks, least: int, shard: int):
        self.blocks, self.least, self.shard = blocks, least, shard
        self.edges: dict = {}  # document -> its matches that touch an edge between two runs
        self._clear()

    def _clear(self):
        self.docs, self.keys, self.size, self.numbers = [], [], 0, _Numbers()

    def add(self, key, text: str):
        words = words_of(text)
        for a in range(0, max(1, len(words)), self.shard):
            part = words[a : a + self.shard + self.least - 1]
            if self.size and self.size + len(part) + 1 > 1.5 * self.shard:
                yield from self.search()
            if len(part) >= self.least:
                self.docs.append(list(map(self.numbers.__getitem__, part)))
                self.keys.append((key, a, a + len(part) < len(words)))
                self.size += len(part) + 1

    def search(self):
        if self.docs:
            shard = Shard(self.docs)
            offset = np.array([k[1] for k in self.keys], dtype=np.int64)
            inner = np.array([k[1] > 0 for k in self.keys])  # another run lies before, or after
            outer = np.array([k[2] for k in self.keys])
            for block in self.blocks:
                texts = [words_of(text) for _, text in block.value]
                ids = np.array([i for i, _ in block.value], dtype=object)
                flat = np.array([n for words in texts for n in [*(self.numbers.get(w, -1) for w in words), -1]], dtype=np.int64)
                starts = np.cumsum([0] + [len(w) + 1 for w in texts])[:-1]
                for doc, item, at, of, length in matches(shard, flat, starts, self.least):
                    cut = inner[doc] & (at == 0) | outer[doc] & (at + length == np.diff(shard.starts)[doc] - 1)
                    for d, i, x, y, n in zip(doc[cut], item[cut], at[cut], of[cut], length[cut], strict=True):
                        x = int(x + offset[d])
                        self.edges.setdefault(self.keys[d][0], []).append((ids[i], x - int(y), x, x + int(n)))
                    yield from self._longest([self.keys[d][0] for d in doc[~cut]], ids[item[~cut]], (at + offset[doc])[~cut], of[~cut], length[~cut])
            last = self.keys[-1]
            for key in [k for k in self.edges if not (last[2] and k == last[0])]:
                yield from self._joined(key, self.edges.pop(key))
        self._clear()

    def _joined(self, key, found: list[tuple]):
        """Matches of a document on one diagonal that overlap are one."""
        runs: list[list] = []
        for item, diagonal, a, b in sorted(found, key=lambda r: (str(r[0]), r[1], r[2])):
            if runs and runs[-1][:2] == [item, diagonal] and a <= runs[-1][3]:
                runs[-1][3] = max(runs[-1][3], b)
            else:
                runs.append([item, diagonal, a, b])
        yield from self._longest([key] * len(runs), [r[0] for r in runs], [r[2] for r in runs], [r[2] - r[1] for r in runs], [r[3] - r[2] for r in runs])

    @staticmethod
    def _longest(docs, items, doc_words, item_words, lengths):
        out = pd.DataFrame({"doc_id": docs, "item_id": items, "words": lengths, "doc_word": doc_words, "item_word": item_words})
        if len(out):
            yield out.sort_values(["words", "doc_word", "item_word"], ascending=[False, True, True]).drop_duplicates(["doc_id", "item_id"])


def _look(blocks, least: int, shard: int):
    def run(batches):
        reader = _Reader(blocks, least, shard)
        for pdf in batches:
            for key, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                yield from reader.add(key, text)
        yield from reader.search()

    return run


def leaks(documents: DataFrame, items: DataFrame, least: int = LEAST, block: int = ITEM_BLOCK, shard: int = SHARD) -> DataFrame:
    """Documents and items that share at least ``least`` consecutive words: doc_id, item_id, and the longest such run (words, doc_word, item_word from 0).

    A word is a longest run of letters and digits; case does not count. Null ids and texts, and texts of fewer words,
    match nothing; repeated ids count together; empty tables give an empty result; other columns are ignored.
    ``least`` is 12 or more, the depth to which binary search goes; ``block`` and ``shard`` bound memory and change no result.
    """
    if least < LEAST:
        raise ValueError(f"at least {LEAST} words")
    spark = documents.sparkSession
    src = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    known = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    size = known.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block))
    dealt = Scratch(spark, "leakage").put(known.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))) if blocks > 1 else known.withColumn("block", F.lit(0))
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, item_id {known.schema['item_id'].dataType.simpleString()}, words long, doc_word long, item_word long"
    out = None
    for first in range(0, blocks, PASS):
        sent = [spark.sparkContext.broadcast(sorted(tuple(r) for r in dealt.where(F.col("block") == k).select("item_id", "text").collect())) for k in range(first, min(first + PASS, blocks))]
        part = src.mapInPandas(_look(sent, least, shard), schema)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("m")).select("doc_id", "item_id", "m.words", (-F.col("m.d")).alias("doc_word"), (-F.col("m.i")).alias("item_word"))


def clean(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents without a leak."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
