"""Per-document text statistics, and whether a text is natural prose.

A text is read line by line: headings, lists, tables, code, logs, settings, links and the like are told by their layout.
What is left is joined to paragraphs and cut into sentences; a piece counts as a running sentence if it is built like
one. The distribution of function words and character classes of the running text is then compared with the profiles of
prose in each language and of other structures by Jensen–Shannon divergence; running text that is nearer to word lists,
tables, code or garble than to prose counts as none.

The profiles are fitted: prose of each language on running text whose function words are that language's, structures on
lines of their layout, both over all documents. Profiles that no layout shows are made from those:
a word list is prose without capitals and stops, unknown words are prose without function words.

Each text is read once, for its own counts and for the profiles: what a text counts is written, a short row each, and
compared with the profiles when all are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import Scratch

# Classes of characters and words; in a distribution characters and words count half each.
CLASSES = ["lower", "upper", "digit", "blank", "stop", "sign", "function", "other"]
# Distributions where the documents show a structure too seldom or not at all, in the order of CLASSES.
PROFILES = {
    "prose": [0.795, 0.020, 0.005, 0.155, 0.020, 0.005, 0.30, 0.70],
    "list": [0.700, 0.050, 0.030, 0.150, 0.010, 0.060, 0.05, 0.95],
    "table": [0.450, 0.020, 0.180, 0.180, 0.010, 0.160, 0.02, 0.98],
    "code": [0.620, 0.060, 0.040, 0.140, 0.010, 0.130, 0.03, 0.97],
    "encoded": [0.400, 0.380, 0.160, 0.010, 0.000, 0.050, 0.00, 1.00],
    "garbled": [0.350, 0.120, 0.060, 0.200, 0.010, 0.260, 0.02, 0.98],
}
#: Characters from which a profile is fitted.
FIT_CHARS = 20_000
#: The share of non-blank characters in running sentences from which a text is prose.
SHARE = 0.5

_FENCE = re.compile(r"^\s*(```+|~~~+)")
_HEADING = re.compile(r"^\s{0,3}(?:#{1,6}(?:\s|$)|=+\s*$|-{2,}\s*$|\*{3,}\s*$|_{3,}\s*$)")
_LIST = re.compile(r"^\s*(?:[-*+•‣◦·–]\s+(?:\[[ xX]\]\s+)?|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})[.)]\s+|\[[ xX]\]\s+)")
_TABLE = re.compile(r"^\s*\|.*\||^[^|]*\|[^|]*\|[^|]*\||^\s*[+|][-+=|]{3,}")
_FIELDS = re.compile(r"^[^\s,;\t]*(?:[,;\t][^,;\t]{0,40}){3,}$")
_LOG = re.compile(r"^\s*(?:\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\[?\d\d:\d\d:\d\d|(?:DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|TRACE)\b[:\s\]]|at\s+[\w.$<>]+\s*\(|File \"|Traceback\b|\w*(?:Error|Exception):\s)")
_TOC = re.compile(r"(?:\.\s?){4,}\s*\d+\s*$|^\s*\d+(?:\.\d+)+\s+\S.*\d+\s*$")
_SETTING = re.compile(r"^\s*[\w.\"'-]+\s*(?::|=)\s*(?:\S+|\[.*\]|\{.*\}|'[^']*'|\"[^\"]*\")?\s*[,;]?\s*$")
_ARROW = re.compile(r"^\s*[\w./-]+\s*(?:->|=>|-->|→|<-|»|>)\s*[\w./-]*\s*$|^[\w-]+(?:\s*/\s*[\w-]+){2,}\s*$")
_LINK = re.compile(r"^\s*(?:!?\[[^\]]*\]\([^)]*\)\s*|\[[^\]]*\]:\s*\S+|<?https?://\S+>?\s*)+[.,;]?\s*$")
_CODE = re.compile(r"^\s*(?://|/\*|\*/|#!|<\?|</?\w+[^>]*>\s*$|(?:const|let|var|import|export|from|def|class|func|function|return|package|public|private|if\s*\(|for\s*\(|while\s*\(|npm|npx|pnpm|yarn|git|pip|cd|sudo|curl|docker|make)\s.*[=({;\[/.-]|.*[;{}]\s*$|[\w.]+\(.*\)\s*;?\s*$|\$\s+\S|>>>\s)")
_MARKS = re.compile(r"^\s*(?:>\s?)+")
_LETTERED = re.compile(r"^\s*[a-zA-Z]\.\s")
_STATEMENT_END = re.compile(r"[;{}=]\s*$")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]*_]*\s+(?=\S)")
_ENDS = re.compile(r"[.!?…:][\"'”’»)\]*_`]*$")
_BEGINS = re.compile(r"^[\"'“‘«¿¡(\[*_]*(?:[A-ZÀ-ÖØ-Þ]|`|\d|[^\x00-ɏ])")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_TOKEN = re.compile(r"[^\W_]+")
_WIDE = re.compile(r"[^\x00-\x7f]")
_GARBLE = re.compile("�|ï¿½|[ÃÂÐÑ][\x80-\xffŒ-ž–-›€™]|â€|%[0-9A-F]{2}")


def divergence(p: list[float], q: list[float]) -> float:
    """Jensen–Shannon divergence in bits."""
    total = 0.0
    for a, b in zip(p, q, strict=True):
        m = (a + b) / 2
        if a:
            total += a * math.log2(a / m) / 2
        if b:
            total += b * math.log2(b / m) / 2
    return total


def tally(text: str) -> dict[str, int]:
    """Characters by count."""
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=128)[:128]
    at = np.flatnonzero(counts)
    out = dict(zip(map(chr, at.tolist()), counts[at].tolist(), strict=True))
    if not text.isascii():
        out |= Counter(_WIDE.findall(text))
    return out


@lru_cache(maxsize=4096)
def _kind(c: str) -> str:
    return "lower" if c.islower() or c.isalpha() and not c.isupper() else "upper" if c.isupper() else "digit" if c.isdigit() else "blank" if c.isspace() else "stop" if c in ".,;:!?…¿¡" else "sign"


_ASCII = np.array([[_kind(chr(i)) == c for c in CLASSES[:6]] for i in range(128)], dtype=np.int64)


def counted(text: str, function: int, words: int) -> list[int]:
    """Characters and words of each class, in the order of CLASSES."""
    got = (np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=128)[:128] @ _ASCII).tolist()
    if not text.isascii():
        for c, k in Counter(_WIDE.findall(text)).items():
            got[CLASSES.index(_kind(c))] += k
    return [*got, function, words - function]


def function_words(words: Iterable[str], common: dict[str, frozenset[str]], every: frozenset[str]) -> tuple[str, int]:
    """The language most function words of the lower-case words are of, and their number; the first of the alphabet where equal."""
    hits = Counter(filter(every.__contains__, words))
    known = {k: sum(n for w, n in hits.items() if w in common[k]) for k in sorted(common)}
    lang = max(known, key=known.get) if known else ""
    return lang, known.get(lang, 0)


def made(fitted: dict[str, list[float]]) -> dict[str, list[float]]:
    """All profiles, as halves of characters and words: the fitted ones, those they give rise to, and fixed ones for the rest.

    Names are a structure, or a structure, a colon and the language.
    """
    out = {k: v for k, v in fitted.items()}
    if not any(k.startswith("prose") for k in out):
        out["prose:"] = PROFILES["prose"]
    for name, p in list(out.items()):
        if name.startswith("prose"):
            chars = sum(p[:6]) - p[1] - p[4]
            out["word list" + name[5:]] = [p[0] / chars, 0.0, p[2] / chars, p[3] / chars, 0.0, p[5] / chars, p[6] * 0.75, 1 - p[6] * 0.75]
            out["unknown words" + name[5:]] = [*p[:6], 0.01, 0.99]
    out = {k: v for k, v in PROFILES.items() if k != "prose" and k not in out} | out
    return {k: [x / 2 for x in v] for k, v in out.items()}


def nearest(counts: np.ndarray, langs: list[str], profiles: dict[str, list[float]], built: bool) -> tuple[np.ndarray, np.ndarray]:
    """(structure, divergence) of the nearest profile for each row of counts; texts built of sentences are no word lists.

    Profiles of other languages than the text's are not compared where its own has one.
    """
    counts = np.asarray(counts, dtype=float).reshape(-1, len(CLASSES))
    chars, words = counts[:, :6].sum(axis=1, keepdims=True), counts[:, 6:].sum(axis=1, keepdims=True)
    p = np.hstack([counts[:, :6] / np.maximum(chars, 1), counts[:, 6:] / np.maximum(words, 1)]) / 2
    langs = np.asarray(langs, dtype=object)
    own = np.array([f"prose:{k}" in profiles for k in langs], dtype=bool)
    far, which = np.full(len(p), np.inf), np.full(len(p), "", dtype=object)
    for name, q in profiles.items():
        what, _, of = name.partition(":")
        if built and what == "word list":
            continue
        q = np.asarray(q, dtype=float)
        m = (p + q) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            d = (np.where(p > 0, p * np.log2(p / m), 0.0) + np.where(q > 0, q * np.log2(q / m), 0.0)).sum(axis=1) / 2
        if of:
            d[own & (langs != of)] = np.inf
        nearer = d < far
        far[nearer], which[nearer] = d[nearer], what
    return which, far


def _shown(lines: list[str], inside: set[str], common: dict[str, frozenset[str]], every: frozenset[str], totals: dict[str, np.ndarray]) -> None:
    """Adds to the totals, by structure, what the lines outside of running text count."""
    parts: dict[str, list[str]] = {}
    for line in map(str.strip, lines):
        if line and line not in inside:
            what = "list" if _LIST.match(line) else "table" if ("|" in line or line[0] == "+") and _TABLE.search(line) else "code" if _CODE.match(line) else ""
            if what:
                parts.setdefault(what, []).append(line)
    for what, said in parts.items():
        words = _WORD.findall("\n".join(said).lower())
        function = 0
        if not every.isdisjoint(words):  # each line by the language of its own function words
            function = sum(function_words(_WORD.findall(line.lower()), common, every)[1] for line in said)
        totals[what] = totals.get(what, 0) + np.array(counted("".join(said), function, len(words)))


def profiles_of(totals: dict[str, list[int]]) -> dict[str, list[float]]:
    """The profiles of prose of each language, and of lists, tables and code, where there is enough text of it."""
    out = {}
    for name, count in sorted(totals.items()):
        chars, words = sum(count[:6]), sum(count[6:])
        if chars >= FIT_CHARS and words:
            out[name] = [x / chars for x in count[:6]] + [x / words for x in count[6:]]
    return out


def _running(lines: list[str]) -> list[list[str]]:
    """Paragraphs of lines that are not laid out as anything else."""
    out: list[list[str]] = []
    now: list[str] = []
    fence, listed = "", False
    for raw in lines:
        line = raw.rstrip()
        m = ("`" in line or "~" in line) and _FENCE.match(line)
        if fence:
            if m and m[1].startswith(fence):
                fence = ""
            continue
        if m:
            fence = m[1]
            out.append(now)
            now = []
            continue
        if ">" in line:
            line = _MARKS.sub("", line)
        first = line.lstrip()[:1]
        if not first:
            out.append(now)
            now, listed = [], False
            continue
        if _LIST.match(line) and not (now and _LETTERED.match(line)):
            listed = True
        elif not (listed and raw[:1] in " \t"):
            listed = False
        # what every match of a pattern contains is asked first: most lines have none of it
        laid = (
            listed
            or first in "#=-*_" and _HEADING.match(line)
            or ("|" in line or first == "+") and _TABLE.search(line)
            or _LOG.match(line)
            or line[-1].isdigit() and _TOC.search(line)
            or ("]" in line or "://" in line) and _LINK.match(line)
            or (">" in line or "/" in line or "<-" in line or "→" in line or "»" in line) and _ARROW.match(line)
        )
        if not laid and ((":" in line or "=" in line) and _SETTING.match(line) or ("," in line or ";" in line or "\t" in line) and _FIELDS.match(line) or _CODE.match(line) or raw.startswith(("    ", "\t"))):
            # a wrapped line of a paragraph may look like these
            laid = not (now and _BEGINS.match(now[0]) and len(line.split()) >= 1 and not _STATEMENT_END.search(line) and not _FIELDS.match(line) and not (_SETTING.match(line) and not _ENDS.search(line)))
        if laid:
            out.append(now)
            now = []
        else:
            now.append(line.strip())
    out.append(now)
    return [p for p in out if p]


def _is_sentence(text: str, solid: int, words: list[str], common: frozenset[str], last: bool) -> bool:
    if len(words) < 2:
        return False
    if len(text) > 80 and max(map(len, text.split())) > 80 or not text.isascii() and len(_GARBLE.findall(text)) * 4 > len(words) or "%" in text and len(_GARBLE.findall(text)) * 4 > len(words):
        return False
    if sum(map(len, words)) < 0.55 * solid:
        return False
    if not _BEGINS.match(text):  # written without capitals, or after an abbreviation
        return len(words) >= 3 and bool(_ENDS.search(text)) and not common.isdisjoint(map(str.lower, words))
    if _ENDS.search(text):
        return len(words) >= 3 or not common.isdisjoint(map(str.lower, words))
    return last and 4 <= len(words) <= 80 and not common.isdisjoint(map(str.lower, words))  # cut off in mid-sentence


def _lines(text: str) -> list[str]:
    return (text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text).split("\n")


def _sentences(paragraphs: list[list[str]], common: frozenset[str]) -> tuple[list[str], list[str], int]:
    """The running sentences of the paragraphs, the words of all of them, and their non-blank characters."""
    found, said, solids = [], [], 0
    for paragraph in paragraphs:
        parts = _SENTENCE.split(" ".join(paragraph))
        for k, part in enumerate(parts):
            words = _WORD.findall(part)
            solid = _solid(part)
            if _is_sentence(part, solid, words, common, k == len(parts) - 1):
                found.append(part)
                said += words
                solids += solid
    return found, said, solids


def _solid(text: str) -> int:
    return len("".join(text.split()))


def read(text: str, common: dict[str, frozenset[str]], every: frozenset[str], totals: dict[str, np.ndarray] | None = None, whole: bool = True) -> dict:
    """What a text counts before profiles are known: VERDICT_COUNTS, and with ``whole`` all COUNTS.

    Adds to ``totals``, by profile, what the text shows of each structure.
    """
    lines = _lines(text)
    paragraphs = _running(lines)
    running, said, solid_running = _sentences(paragraphs, every)
    joined, said = " ".join(running), list(map(str.lower, said))
    lang, function = function_words(said, common, every)
    run = counted(joined, function, len(said)) if joined else None
    solid = _solid(text)
    if totals is not None:
        if run and len(joined) >= 200 and function >= 0.1 * len(said):  # else too short, or of no known language
            name = f"prose:{lang}"
            totals[name] = totals.get(name, 0) + np.array(run)
        _shown(lines, {line for p in paragraphs for line in p}, common, every, totals)
    out = {"nonblank": solid > 0, "share": min(1.0, solid_running / solid) if solid else 0.0, "run_language": lang, "run": run}
    if not whole:
        return out
    low = text.lower()
    words = _TOKEN.findall(low)
    n = len(words)
    digits = signs = 0
    for c, k in tally(text).items():
        if c.isdigit():
            digits += k
        elif not c.isspace() and not c.isalnum():
            signs += k
    shown = [line for line in map(str.strip, text.splitlines()) if line]
    apart = _WORD.findall(low)
    all_language, function = function_words(apart, common, every)
    return out | {
        "words": n, "mean_word_length": sum(map(len, words)) / n if n else 0.0, "symbol_ratio": signs / solid if solid else 0.0, "lines": len(shown),
        "punctuated_lines": sum(line[-1] in ".!?…" for line in shown) / len(shown) if shown else 0.0, "common_words": sum(map(every.__contains__, words)) / n if n else 0.0, "distinct_words": len(set(words)) / n if n else 0.0,
        "digit_ratio": digits / solid if solid else 0.0, "sentences": len(running), "all_language": all_language, "every": counted(" ".join(text.split()), function, len(apart)) if solid else None,
    }


def judge(read: pd.DataFrame, profiles: dict[str, list[float]]) -> pd.DataFrame:
    """The rows read, with the divergence, structure and share of prose; without the counts of whole texts the share alone tells."""
    n = len(read)
    share = read["share"].to_numpy(dtype=float, copy=True)
    structure, far, lang = np.full(n, "", dtype=object), np.zeros(n), np.full(n, "", dtype=object)

    def compare(rows: np.ndarray, counts: str, language: str, built: bool) -> None:
        if len(rows):
            lang[rows] = read[language].to_numpy(dtype=object)[rows]
            structure[rows], far[rows] = nearest(np.stack([np.asarray(x) for x in read[counts].to_numpy()[rows]]), lang[rows], profiles, built)

    compare(np.flatnonzero(read["run"].notna().to_numpy()), "run", "run_language", True)
    decided = (share >= SHARE) & (structure != "prose")  # by the divergence alone
    share[structure != "prose"] = 0.0
    if "every" in read:  # what the text is rather than prose
        rest = share < SHARE
        structure[rest], far[rest], lang[rest] = "", 0.0, ""
        compare(np.flatnonzero(rest & read["every"].notna().to_numpy()), "every", "all_language", False)
        structure[rest & (structure == "prose")] = "mixed"
    return read.assign(language=lang, divergence=far, structure=structure, prose_share=share, by_divergence=decided)


def describe(text: str, common: dict[str, frozenset[str]], profiles: dict[str, list[float]] | None = None) -> dict:
    """All statistics of a text; shares are 0 where there is nothing to count."""
    every = frozenset().union(*common.values()) if common else frozenset()
    row = judge(pd.DataFrame([read(text, common, every)]), made({}) if profiles is None else profiles).iloc[0]
    return {name: row[name] for name in (f.split()[0] for f in FIELDS.split(", "))}


FIELDS = "words int, mean_word_length double, symbol_ratio double, lines int, punctuated_lines double, common_words double, distinct_words double, digit_ratio double, sentences int, language string, divergence double, structure string, prose_share double, by_divergence boolean"


#: What is read of each text for the verdict, and for all statistics.
VERDICT_COUNTS = "nonblank boolean, share double, run_language string, run array<bigint>"
COUNTS = VERDICT_COUNTS + ", words int, mean_word_length double, symbol_ratio double, lines int, punctuated_lines double, common_words double, distinct_words double, digit_ratio double, sentences int, all_language string, every array<bigint>"


def _names(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]


def _read(common: dict[str, frozenset[str]], whole: bool):
    """A row a text, and at the end of each part of the table a row a profile, without doc_id."""
    every = frozenset().union(*common.values()) if common else frozenset()
    names = _names(COUNTS if whole else VERDICT_COUNTS)

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for pdf in batches:
            rows = [(key, None, None, *read(text, common, every, totals, whole).values()) for key, text in zip(pdf["doc_id"], pdf["text"], strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", "profile", "total", *names])
        yield pd.DataFrame([(None, name, count.tolist(), *[None] * len(names)) for name, count in totals.items()], columns=["doc_id", "profile", "total", *names])

    return run


def _texts(documents: DataFrame) -> DataFrame:
    return documents.where("doc_id is not null and text is not null").select("doc_id", "text")


def _reading(documents: DataFrame, common: dict[str, frozenset[str]], whole: bool) -> DataFrame:
    src = _texts(documents)
    return src.mapInPandas(_read(common, whole), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, profile string, total array<bigint>, {COUNTS if whole else VERDICT_COUNTS}")


def _fit(reading: DataFrame) -> dict[str, list[float]]:
    rows = reading.where("doc_id is null").groupBy("profile").agg(*[F.sum(F.col("total")[k]).alias(c) for k, c in enumerate(CLASSES)]).collect()  # a row a language and structure
    return profiles_of({row["profile"]: list(row[1:]) for row in rows})


def fit_profiles(documents: DataFrame, common: dict[str, frozenset[str]]) -> dict[str, list[float]]:
    """Profiles from all documents: a profile of prose for each language, and of lists, tables and code, where there is enough text of it."""
    return _fit(_reading(documents, common, False))


def _common(commonwords: DataFrame) -> dict[str, frozenset[str]]:
    listed = commonwords.where("lang is not null and word is not null").select(F.lower("lang").alias("lang"), F.lower("word").alias("word")).distinct().limit(1_000_001).collect()
    if len(listed) > 1_000_000:
        raise ValueError("more than a million common words")
    common: dict[str, set[str]] = {}
    for row in listed:
        common.setdefault(row["lang"], set()).add(row["word"])
    return {k: frozenset(v) for k, v in common.items()}


def _judged(documents: DataFrame, commonwords: DataFrame, whole: bool, fields: str) -> DataFrame:
    reading = Scratch(documents.sparkSession, "prose").put(_reading(documents, _common(commonwords), whole))
    profiles = made(_fit(reading))
    names = ["doc_id", "nonblank", *_names(fields)]

    def run(batches):
        for pdf in batches:
            yield judge(pdf, profiles)[names]

    out = reading.where("doc_id is not null").drop("profile", "total").mapInPandas(run, f"doc_id {reading.schema['doc_id'].dataType.simpleString()}, nonblank boolean, {fields}")
    return out.withColumn("natural", F.when(F.col("nonblank"), F.col("prose_share") >= SHARE))


def verdicts(documents: DataFrame, commonwords: DataFrame) -> DataFrame:
    """doc_id, nonblank, prose_share, by_divergence and ``natural`` as in :func:`statistics`, without the statistics that they do not need."""
    return _judged(documents, commonwords, False, "prose_share double, by_divergence boolean")


def statistics(documents: DataFrame, commonwords: DataFrame) -> DataFrame:
    """One row per row of ``documents`` with a text: doc_id, nonblank, the statistics, and ``natural``.

    ``by_divergence`` says that the text has running sentences enough and only its nearest profile makes it no prose.

    ``natural`` is null for blank texts. Null ids and null texts are left out; repeated rows give repeated rows; an
    empty table gives an empty result; without common words no text has any; other columns are ignored. The list of
    common words is small by its nature (a few dozen words a language); beyond a million rows it is refused.
    """
    return _judged(documents, commonwords, True, FIELDS)


def counts(documents: DataFrame, commonwords: DataFrame) -> DataFrame:
    """The basic counts alone, by built-in functions: doc_id, words, mean_word_length, symbol_ratio, lines, punctuated_lines, common_words."""
    if commonwords.limit(1_000_001).count() > 1_000_000:
        raise ValueError("more than a million common words")
    words = F.transform(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: w)
    lines = F.filter(F.transform(F.split("text", "\n"), lambda s: F.regexp_replace(s, r"^[ \t\r]+|[ \t\r]+$", "")), lambda s: s != "")
    known = commonwords.where("word is not null").agg(F.collect_set(F.lower("word")).alias("known"))
    src = documents.where("doc_id is not null and text is not null").select("doc_id", words.alias("w"), lines.alias("l"), F.length(F.regexp_replace("text", r"[ \t\r\n]", "")).alias("solid"), F.length(F.regexp_replace("text", r"[\p{L}\p{N} \t\r\n]", "")).alias("signs")).join(F.broadcast(known))
    n, m = F.size("w"), F.size("l")
    part = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(F.lit(0.0)), 6)
    return src.select("doc_id", n.alias("words"), part(F.aggregate("w", F.lit(0), lambda a, w: a + F.length(w)), n).alias("mean_word_length"), part(F.col("signs"), F.col("solid")).alias("symbol_ratio"), m.alias("lines"), part(F.size(F.filter("l", lambda s: s.rlike(r"[.!?…]$"))), m).alias("punctuated_lines"), part(F.size(F.filter("w", lambda w: F.array_contains("known", w))), n).alias("common_words"))
