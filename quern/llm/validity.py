"""Source files that do not parse.

A file is cut into chunks, where it can be after a block that ends at the margin, else at a line end; most files are one.
The chunks, spread over the cluster, become lexer-state maps with bracket summaries (:mod:`quern.llm.lexer_states`). Maps
compose associatively; composed from the start of the file they tell in what state each chunk begins, so which cuts part
statements. That scan sees no text: a file of a gigabyte is some 60,000 narrow rows. What lies between two such cuts, a
run of balanced statements, is then parsed by the local grammars, each by itself wherever there is room. Python's
statements are parsed by the interpreter's own grammar (``ast``).

A run found wrong is confirmed on the whole text before the file counts as invalid, and a file whose maps do not fit
together is parsed whole: maps know neither markup nor quotes nested in f-strings.
"""

from __future__ import annotations

import ast
import json
import re
import sys
import warnings

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import grammar_go, grammar_js, grammar_php
from quern.llm.lexer_states import BROKEN, START, chunk_map, compose, settle
from quern.llm.lexing import _DIVISION, _DQ, _REGEX, _SQ
from quern.session import Scratch

# The language of each extension.
LANGUAGES = {"ts": "ts", "tsx": "ts", "mts": "ts", "cts": "ts", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "py": "py", "pyi": "py", "go": "go", "php": "php"}
#: Frames that the rules of the local grammars take for a token at most.
FRAMES = 64
#: Files longer than this are cut into chunks of about this many characters.
CHUNK = 8_192
_CODE = re.compile(rf"{_DIVISION}|//[^\n]*+|/\*[\s\S]*?\*/|{_SQ}|{_DQ}|`|{_REGEX}|[{{}}]|<(?=[A-Za-z_$>])")
_TEMPLATE = re.compile(r"\\[\s\S]|`|\$\{")
_OPEN = re.compile(r"<([A-Za-z_$][\w.:$-]*)?")
_TAG = re.compile(r"\s+|/\*[\s\S]*?\*/|//[^\n]*|(/>|>|\{)|[A-Za-z_$][\w:.$-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|(\{|(?=<))))?")
_CHILD = re.compile(r"[^<>{}]+|\{|</\s*([\w.:$-]*)\s*>|<")
_SPREAD = re.compile(r"^\s*\.\.\.")
_COMMENTS = re.compile(r"\s+|/\*[\s\S]*?\*/|//[^\n]*")
# Words after which an expression begins.
_BEFORE = {"return", "default", "case", "typeof", "yield", "await", "else", "do", "in", "of", "void", "delete", "throw"}
_LAST_WORD = re.compile(r"[\w$]")


class _Code:
    """Code outside of markup, in its braces (``jsx``) or in a hole of a template (``hole``)."""

    def __init__(self, kind: str):
        self.kind, self.out, self.depth = kind, [], 0


class _Template:
    def __init__(self):
        self.out = ["`"]


class _Element:
    def __init__(self, start: int, name: str):
        self.start, self.name, self.parts, self.tag = start, name, [], True


def _starts_expression(text: str, at: int, comments: dict[int, int]) -> bool:
    """Whether an operand, not an operator, is due at ``at``."""
    while at > 0:
        if text[at - 1].isspace():
            at -= 1
        elif at in comments:
            at = comments[at]
        else:
            break
    if not at:
        return True
    if not _LAST_WORD.match(text[at - 1]):
        return text[at - 1] not in ")]'\"`"
    end = at
    while at > 0 and _LAST_WORD.match(text[at - 1]):
        at -= 1
    return text[at:end] in _BEFORE and (not at or text[at - 1] != ".")


def without_elements(text: str) -> str:
    """Markup elements replaced by lists of the expressions in them; an explicit stack, so of any depth.

    What begins like an element and is none (type parameters, say) stays as it is.
    """
    stack: list = [_Code("top")]
    comments: dict[int, int] = {}
    plain: set[int] = set()
    at = 0
    while True:
        top = stack[-1]
        failed = False
        if isinstance(top, _Code):
            m = _CODE.search(text, at)
            if not m:
                top.out.append(text[at:])
                at = len(text)
                failed = len(stack) > 1
                if not failed:
                    return "".join(top.out)
            else:
                top.out.append(text[at : m.start()])
                t, at = m[0], m.end()
                if t == "`":
                    stack.append(_Template())
                elif t == "<" and m.start() not in plain and _starts_expression(text, m.start(), comments):
                    name = _OPEN.match(text, m.start())
                    stack.append(_Element(m.start(), name[1] or ""))
                    at = name.end()
                elif t == "}" and not top.depth and top.kind != "top":
                    stack.pop()
                    inner = "".join(top.out)
                    if top.kind == "hole":
                        stack[-1].out.append("${" + inner + "}")
                    elif _COMMENTS.sub("", inner):
                        stack[-1].parts.append(_SPREAD.sub("", inner) + "\n")
                else:
                    if t in "{}":
                        top.depth += 1 if t == "{" else -1
                    elif t[:2] in ("//", "/*"):
                        comments[m.end()] = m.start()
                    top.out.append(t)
        elif isinstance(top, _Template):
            m = _TEMPLATE.search(text, at)
            if not m:
                top.out.append(text[at:])
                at = len(text)
                stack.pop()
                stack[-1].out.append("".join(top.out))
                continue
            top.out.append(text[at : m.start()])
            at = m.end()
            if m[0] == "${":
                stack.append(_Code("hole"))
            else:
                top.out.append(m[0])
                if m[0] == "`":
                    stack.pop()
                    stack[-1].out.append("".join(top.out))
        else:
            m = (_TAG if top.tag else _CHILD).match(text, at)
            closed = False
            if not m:
                failed = True
            elif top.tag:
                at = m.end()
                if m[1] == "{" or m[2] == "{":
                    stack.append(_Code("jsx"))
                elif m[2] is not None:
                    name = _OPEN.match(text, at)
                    stack.append(_Element(at, name[1] or ""))
                    at = name.end()
                elif m[1] == ">":
                    top.tag = False
                elif m[1] == "/>":
                    closed, failed = bool(top.name), not top.name
            else:
                at = m.end()
                if m[0] == "{":
                    stack.append(_Code("jsx"))
                elif m[0] == "<":
                    name = _OPEN.match(text, at - 1)
                    stack.append(_Element(at - 1, name[1] or ""))
                    at = name.end()
                elif m[0][0] == "<":
                    closed, failed = m[1] == top.name, m[1] != top.name
            if closed:
                stack.pop()
                whole = "(0" + "".join(f",({x})" for x in top.parts) + ")"
                (stack[-1].out if isinstance(stack[-1], _Code) else stack[-1].parts).append(whole)
        if failed:
            # the nearest element that begins in code is none
            while len(stack) > 1 and not (isinstance(stack[-1], _Element) and isinstance(stack[-2], _Code)):
                stack.pop()
            if len(stack) == 1:
                return text
            at = stack.pop().start
            plain.add(at)


def is_valid(text: str, lang: str, markup: bool = False) -> bool:
    """Whether the whole text is a sentence of the language.

    The local grammars nest as deep as the text does: a rule takes a few frames a token, and the interpreter keeps frames
    of Python functions on its heap. Python's own parser ends at a fixed depth of its stack, which brackets cannot
    reach (it refuses more than 200 of them), but some thousands of ``elif`` or ``not`` in a row can; such a text counts
    as valid if its brackets match.
    """
    if text.startswith("\ufeff"):
        text = text[1:]
    if lang != "php" and not text.strip():
        return True
    if lang == "py":
        return _python(text)
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, min(2**31 - 1, 10_000 + FRAMES * len(text))))
    try:
        if lang == "php":
            return grammar_php.valid(text)
        if lang == "go":
            return grammar_go.valid(text)
        ok = grammar_js.valid(text, lang == "ts")
        if not ok and markup and re.search(r"<[A-Za-z>]", text) and "</" in text + text.replace("/>", "</"):
            ok = grammar_js.valid(without_elements(text), lang == "ts")
        return ok
    finally:
        sys.setrecursionlimit(before)


def _python(text: str) -> bool:
    try:
        ast.parse(text)
    except (SyntaxError, ValueError):
        return False
    except RecursionError:  # raised where the tree of a text already parsed is built
        return True
    except MemoryError:
        return settle("py", chunk_map("py", text)) is not False
    return True


# Words that go on with the statement before them, or that must not begin a later part of a file.
_GOES_ON = {
    "js": "else catch finally while instanceof in of as satisfies from extends implements", "go": "import package else",
    "php": "else elseif catch finally while and or xor instanceof insteadof as namespace declare use",
}
_GOES_ON["ts"] = _GOES_ON["js"]
_BLOCK_END = re.compile(r"\n\}[ \t]*\r?\n")
_NEXT_WORD = re.compile(r"(?:\s+|//[^\n]*|/\*[\s\S]*?\*/|#(?!\[)[^\n]*)*+([A-Za-z_$@][\w$]*)?")
_PY_START = re.compile(r"\n[ \t]+\S[^\n]*\n(?:[ \t]*\n)+(?=(?:def|class|async|import|from|@)[ \w])")


def chunks_of(text: str, most: int, lang: str | None = None) -> list[tuple[str, bool]]:
    """Pieces of about ``most`` characters, and whether each begins after the end of a block at the margin.

    Other pieces begin at a line end; a longer line stays whole.
    """
    out, at, parted = [], 0, False
    while at < len(text):
        end, fit = len(text), False
        if len(text) - at > most:
            ends = [m.end() for m in (_PY_START if lang == "py" else _BLOCK_END).finditer(text, at + most // 2, at + most)] if lang else []
            if lang != "py":
                stop = _GOES_ON.get(lang, "").split()
                ends = [e for e in ends if (word := _NEXT_WORD.match(text, e)[1]) and word not in stop]
            fit = bool(ends)
            end = ends[-1] if fit else text.rfind("\n", at, at + most) + 1 or (text.find("\n", at + most) + 1 or len(text))
        out.append((text[at:end], parted))
        at, parted = end, fit
    return out


def _markup(ext: str) -> bool:
    return ext in ("jsx", "tsx", "js")


def _judge(batches):
    warnings.simplefilter("ignore")
    for pdf in batches:
        pdf["valid"] = [None if lang is None or text is None else is_valid(text, lang, _markup(ext)) for text, lang, ext in zip(pdf["content"], pdf["lang"], pdf["ext"], strict=True)]
        yield pdf[["path", "workspace", "lang", "version", "at", "valid"]]


#: In place of nulls in keys.
_NONE, _NEVER = "\0", -(2**63)
_KEYS = ["path", "workspace", "lang", "ext", "version", "at"]
_KEY_TYPES = "path string, workspace string, lang string, ext string, version long, at long"


def _cut(most: int):
    def cut(batches):
        for pdf in batches:
            rows = [(*key, seq, fit, chunk) for *key, text in pdf[[*_KEYS, "content"]].itertuples(index=False, name=None) for seq, (chunk, fit) in enumerate(chunks_of(text, most, key[2]))]
            yield pd.DataFrame(rows, columns=[*_KEYS, "seq", "fit", "chunk"])

    return cut


def _summarise(batches):
    for pdf in batches:
        pdf["states"] = [json.dumps(chunk_map(lang, chunk.removeprefix("\ufeff") if not seq else chunk)) for lang, seq, chunk in zip(pdf["lang"], pdf["seq"], pdf["chunk"], strict=True)]
        yield pdf


def _in_groups(width: int, columns: list[str], rows_of):
    """A mapper over rows sorted by their first ``width`` columns: ``rows_of`` gets each group's rows and gives rows of ``columns``.

    Groups may lie across batches; no frame is made for each of them.
    """

    def run(batches):
        held: list[tuple] = []
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.itertuples(index=False, name=None):
                if held and held[-1][:width] != row[:width]:
                    out += rows_of(held)
                    held = []
                held.append(row)
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(rows_of(held) if held else [], columns=columns)

    return run


def _scan(rows: list[tuple]) -> list[tuple]:
    """For each chunk of a file (keys, seq, fit, states) the first chunk of its run of statements, -1 for all where the maps do not fit together."""
    lang = rows[0][2]
    start = START[lang]
    so_far, owner, owners = {start: (start, "", "")}, 0, []
    for *_, seq, fit, states in rows:
        if fit and so_far[start] == ("code", "", ""):
            owner = seq
        owners.append(owner)
        so_far = compose(so_far, {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(states).items()})
    if settle(lang, so_far) is False:
        owners = [-1] * len(owners)
    return [(*row[: len(_KEYS)], row[len(_KEYS)], owner) for row, owner in zip(rows, owners, strict=True)]


# What a run that is not a file's first needs before it.
_BEFORE_RUN = {"go": "package p\n", "php": "<?php "}


def _parse_run(rows: list[tuple]) -> list[tuple]:
    """Whether the chunks (keys, run, seq, chunk) of one run make up balanced statements."""
    _, _, lang, ext, _, _, run, _, _ = rows[0]
    text = "".join(row[-1] for row in rows)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        ok = is_valid(_BEFORE_RUN.get(lang, "") + text if run > 0 else text, lang, _markup(ext))
    return [(*rows[0][: len(_KEYS)], ok)]


def verdicts(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``files``: path, workspace, lang, version (of the content), at (indexed) and ``valid``.

    ``valid`` is null where the content is null or the extension names no known language; empty, blank and
    comment-only texts are valid. Rows of long files that repeat path, workspace, time and content are given once.
    Null paths name no file and are left out; an empty table gives an empty result; other columns are ignored.
    """
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    has = lambda c, kind: F.col(c) if c in files.columns else F.lit(None).cast(kind)
    src = files.where("path is not null").select("path", has("workspace", "string").alias("workspace"), known[ext].alias("lang"), ext.alias("ext"), F.xxhash64("content").alias("version"), F.unix_micros(has("indexed_at", "timestamp").cast("timestamp")).alias("at"), "content")
    long = (F.length("content") > chunk) & F.col("lang").isNotNull()
    schema = "path string, workspace string, lang string, version long, at long, valid boolean"
    short = src.where(~F.coalesce(long, F.lit(False))).mapInPandas(_judge, schema)
    scratch = Scratch(files.sparkSession, "validity")
    keyed = src.where(long).withColumns({"workspace": F.coalesce("workspace", F.lit(_NONE)), "at": F.coalesce("at", F.lit(_NEVER))})
    cut = keyed.mapInPandas(_cut(chunk), f"{_KEY_TYPES}, seq int, fit boolean, chunk string")
    spread = cut.dropDuplicates([*_KEYS, "seq"])  # repeated rows of a file bring each chunk again; the chunks of a file are spread
    chunks = scratch.put(spread.mapInPandas(_summarise, f"{_KEY_TYPES}, seq int, fit boolean, chunk string, states string"))
    width = len(_KEYS)
    narrow = chunks.select(*_KEYS, "seq", "fit", "states").repartition(*_KEYS).sortWithinPartitions(*_KEYS, "seq")
    runs = scratch.put(narrow.mapInPandas(_in_groups(width, [*_KEYS, "seq", "run"], _scan), f"{_KEY_TYPES}, seq int, run int"))
    parse = lambda rows: rows.repartition(*_KEYS, "run").sortWithinPartitions(*_KEYS, "run", "seq").mapInPandas(_in_groups(width + 1, [*_KEYS, "valid"], _parse_run), f"{_KEY_TYPES}, valid boolean")
    parts = chunks.join(runs, [*_KEYS, "seq"]).select(*_KEYS, "run", "seq", "chunk")
    per = scratch.put(parse(parts).groupBy(*_KEYS).agg(F.bool_and("valid").alias("valid"), F.count(F.lit(1)).alias("runs")))
    whole = parse(chunks.join(per.where("not valid and runs > 1"), _KEYS, "left_semi").select(*_KEYS, F.lit(0).alias("run"), "seq", "chunk"))
    named = lambda rows: rows.select("path", F.nullif("workspace", F.lit(_NONE)).alias("workspace"), "lang", "version", F.nullif("at", F.lit(_NEVER)).alias("at"), "valid")
    return short.unionByName(named(per.where("valid or runs = 1"))).unionByName(named(whole))


def rates(judged: DataFrame) -> DataFrame:
    """Files, invalid files and their share per workspace and language; of a repeated path the latest row counts."""
    latest = judged.where("lang is not null and valid is not null").groupBy("path").agg(F.max_by(F.struct("workspace", "lang", "valid"), F.struct(F.coalesce("at", F.lit(-1).cast("long")), "version")).alias("r")).select("r.*")
    return latest.groupBy("workspace", F.col("lang").alias("language")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.when(~F.col("valid"), 1).otherwise(0)).alias("invalid")).withColumn("share", F.round(F.col("invalid") / F.col("files"), 6))
