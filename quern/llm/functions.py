"""Functions paired with their documentation.

Source files become function nodes with exact source ranges: Python by the interpreter's syntax trees, the brace
languages by a tree of matched brackets over lexed tokens in which declarations are recognised. Nodes meet ``symbols``
by file, line and name. A comment counts as a description if something remains that tells what the function does once
marks, tags, directives, placeholders, notices, decoration, disabled code and the name itself are taken away.
"""

from __future__ import annotations

import ast
import bisect
import re
import warnings
from functools import lru_cache
from itertools import accumulate, compress

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import lexing as lx
from quern.llm.validity import LANGUAGES, is_valid
from quern.session import Scratch

# ------------------------------------------------------------------------------------------------------ descriptions
# Tool directives, placeholders, notices, tags whose text describes.
DIRECTIVES = re.compile(
    r"^\W*(?:(?:eslint|tslint|stylelint|prettier|webpack|biome|deno|cspell|spell-?checker|phpstan|psalm|phpmd|jest|vitest|vite)-\w+|(?:jshint|jslint|pylint|flake8|mypy|pyright|isort|yapf|ruff|lint|phpcs|phpmd|sonar[\w-]*|vim?|coverage|globals?|type|fmt|go|nolint)\s*:\s*\S|(?:istanbul|c8|v8|coverage)\s+ignore|ts-(?:ignore|expect-error|nocheck|check)\b|@ts-\w+|noqa\b|nosec\b|nosonar\b|nolint\b|eslint\s|pragma:?\s|\+build\s|@?noinspection\b|@?codecoverageignore\w*|-\*-|\#\s*(?:end)?region\b|(?-i:(?:end)?region\b)|language=|@flow\b|\#?__\w+__)",
    re.IGNORECASE,
)
PLACEHOLDER = re.compile(
    r"^\W*(?:(?:todo|fixme|xxx|tbd|tbc|hack|wip|n/?a|none|null|nil|placeholder|stub|undocumented|lorem\s+ipsum.*|no\s+(?:description|docs?|documentation|comment)s?(?:\s+(?:yet|available|provided|given|here))*|(?:missing|empty|insert|add|write|needs?|fill\s+in|put|enter|provide|your)\s+(?:(?:a|an|the|some|missing|your|method|function|class)\s+)*(?:descriptions?|docs?|documentation|docstring|doc|comments?|summary|text)(?:\s+(?:here|later|below|goes\s+here))*|(?:descriptions?|documentation|docs?|docstring|summary|comments?)(?:\s+(?:here|goes\s+here|missing|pending|tbd|todo|to\s+follow|needed))*|to\s+be\s+(?:documented|done|described|written|determined|defined)|document\s+(?:this|me)|describe\s+(?:this|me)|see\s+(?:above|below)|same\s+as\s+above|auto-?generated(?:\s+(?:method|function|comment))?\s*(?:stub)?|sin\s+descripci[oó]n|por\s+hacer|keine\s+beschreibung|beschreibung\s+fehlt)\W*)+$",
    re.IGNORECASE,
)
TASK_NOTE = re.compile(r"^\W*(?:todo|fixme|xxx|tbd|hack)\b\s*(?:\([^)]*\))?\s*:?", re.IGNORECASE)
NOTICE = re.compile(r"copyright\b|\(c\)\s*\d{4}|©|spdx-license|all\s+rights\s+reserved|licen[sc]ed?\s+(?:under|to)|\blicen[sc]e\b.*\b(?:mit|apache|bsd|gpl|file|root|terms)\b|^\W*(?:authors?|written\s+by|created\s+by|maintainers?|contributors?|modified\s+by|since|version|date)\s*:|permission\s+is\s+hereby\s+granted|the\s+software\s+is\s+provided|redistribution\s+and\s+use|warrant(?:y|ies)\s+of\s+merchantability", re.IGNORECASE)
DESCRIBING_TAGS = {"description", "desc", "summary", "brief", "remarks", "details", "short", "overview", "abstract", "note"}
SECTION = re.compile(r"^\s*(?:args?|arguments?|parameters?|params?|returns?|return\s+value|yields?|raises?|throws?|exceptions?|keyword\s+args?|attributes?|examples?|see\s+also|references?|todo|deprecated)\s*:\s*$", re.IGNORECASE)
RULED_SECTION = re.compile(r"^\s*(?:Parameters|Returns|Yields|Raises|Examples|Notes|See Also|Attributes)\s*$")
FIELD = re.compile(r"^\s*:(?:param|type|returns?|rtype|raises?|arg|keyword|var|ivar|cvar|meta)\b[^:]*:")
STOP = set("a an the this that these those it its is are be was of in on to for and or with by as at from function functions method methods func fn procedure routine class handler helper implementation implements does do here el la los las un una der die das ein eine le les une función funcion método metodo funktion methode fonction".split())

_OPEN = re.compile(r"^\s*(?:/\*+!?|<!--|[rRuUbBfF]{0,2}(?:\"\"\"|''')|[rRuU]?[\"'](?=[^\"']*[\"']\s*$))")
_CLOSE = re.compile(r"(?:\*+/|-->|\"\"\"|''')\s*$")
_LEAD = re.compile(r"^\s*(?:///?!?|//+|#(?!region|endregion)+|\*(?!/)|;;+|--(?=\s))")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯฀-๿]")
_CODE_MARK = re.compile(r"[=({;\[]")
_CODE_HINT = re.compile(r"[=;{]|\w\([^)]*\)\s*$")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\dA-Z_]+|\d+")
_RULE = re.compile(r"\s*[-=~]{3,}\s*")
_TAG = re.compile(r"\{?@(\w[\w-]*)\}?(.*)")
_INLINE_TAG, _INLINE_TAG_TEXT = re.compile(r"\{@\w+\}"), re.compile(r"\{@\w+\s+([^}]*)\}")
_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>")
_PART = re.compile(r"\n\s*\n|(?<=[.!?])\s+|\n(?=\W*(?:TODO|FIXME|XXX)\b)")
_DECORATION = re.compile(r"[-=*~#_+]{3,}")
_WORD_CHARACTER = re.compile(r"\w")
_CODE_LINE = re.compile(r"^\s*(?:(?:const|let|var|return|if|for|while|switch|throw|raise|import|from|def|func|package|use|echo|await|yield|else|try|catch|break|continue|pass)\b.*[;:({)=]?|[\w.$>\[\]'\"-]+\s*(?::?=|\+=|-=|:=)\s*\S.*|[\w.$>-]+\([^)]*\)\s*;?|[{}\[\]();,]+|.*[;{}]|return\b.*)\s*$")


def lines_of(comment: str) -> list[str]:
    """The lines of a raw comment without its marks."""
    text = comment.replace("\r\n", "\n").replace("\r", "\n").strip("﻿ \t\n")
    if (m := _OPEN.match(text)) and not m[0].lstrip().startswith("//"):
        text = text[m.end() :]
        if m[0].strip()[-1:] in "\"'" and len(m[0].strip().lstrip("rRuUbBfF")) == 1:
            text = text.rstrip()[:-1]
    text = _CLOSE.sub("", text)
    return [_LEAD.sub("", line).rstrip() for line in text.split("\n")]


@lru_cache(maxsize=100_000)
def _stem(word: str) -> str:
    word = word.lower()
    for end in ("ies", "es", "s", "ing", "ed", "e"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)]
    return word


@lru_cache(maxsize=100_000)
def name_words(name: str) -> tuple[str, ...]:
    return tuple(w.lower() for w in _NAME_PART.findall(name))


@lru_cache(maxsize=100_000)
def _word_parts(word: str) -> tuple[tuple[str, str], ...]:
    """The words in a word of more than one letter, each with its stem, or none if it tells nothing."""
    return tuple((w, "" if w in STOP else _stem(w)) for w in name_words(word) or (word.lower(),) if len(w) > 1)


def _disabled_code(lines: list[str], lang: str | None) -> bool:
    """Whether the text is code: it parses in the file's language and looks like it, or every line looks like it."""
    body = [line for line in lines if line.strip()]
    text = "\n".join(lines)
    if not body or not _CODE_MARK.search(text):
        return False
    if all(_CODE_LINE.match(line) for line in body) and (re.search(r";\s*$|[{}]\s*$", text, re.MULTILINE) or re.search(r"\w\s*(?:=|:=|\+=)\s*\S|\w\(", text)):
        words = max(len(_WORD.findall(re.sub(r"[\"'`].*?[\"'`]|\w+\(|[\w.]+", lambda m: m[0] if re.fullmatch(r"[^\W\d_]+", m[0]) else " ", line))) for line in body)
        if words <= 6:
            return True
    if lang is None or not _CODE_HINT.search(text):
        return False
    code = {"go": "package p\nfunc f() {\n" + text + "\n}", "php": "<?php " + text}.get(lang, text)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return is_valid(code, lang)


def describe(comment: str | None, name: str | None, lang: str | None = None) -> str | None:
    """What the comment says about the function, or None if it says nothing."""
    if not comment or not comment.strip():
        return None
    lines = lines_of(comment)
    if _disabled_code(lines, lang):
        return None
    kept: list[str] = []
    tag, ended = False, False
    for k, line in enumerate(lines):
        s = line.strip()
        if not s:
            kept.append("")
            continue
        if SECTION.match(s) or RULED_SECTION.match(s) and k + 1 < len(lines) and _RULE.fullmatch(lines[k + 1]):
            ended = True
        if FIELD.match(s):
            tag = True
            continue
        if DIRECTIVES.match(s):
            continue
        m = _TAG.match(s)
        if m and not s.startswith("{@link"):
            tag = m[1].lower() not in DESCRIBING_TAGS
            ended = ended and tag
            if not tag:
                kept.append(m[2].strip(" :-"))
            continue
        if tag or ended or NOTICE.search(s):
            continue
        kept.append(s)
    text = "\n".join(kept)
    if "{@" in text:
        text = _INLINE_TAG_TEXT.sub(r"\1", _INLINE_TAG.sub(" ", text))
    if "<" in text:
        text = _MARKUP.sub(" ", text)
    # decoration: lines without letters, and rules around a text
    said = []
    for part in _PART.split(text):
        part = _DECORATION.sub(" ", " ".join(part.split())).strip()
        if not part or not _WORD_CHARACTER.search(part) or PLACEHOLDER.match(part):
            continue
        if TASK_NOTE.match(part):
            continue  # says what is to be done, not what is done
        said.append(part)
    text = " ".join(said).strip()
    if not text:
        return None
    if not text.isascii() and _CJK.search(text):
        return text if len(_CJK.findall(text)) >= 4 else None
    parts = [part for word in _WORD.findall(text) for part in _word_parts(word)]
    own = {"", *map(_stem, name_words(name or ""))}
    return text if len(parts) >= 2 and any(stem not in own for _, stem in parts) else None


# ----------------------------------------------------------------------------------------------------- function nodes
def _python_nodes(text: str):
    text = text.removeprefix("﻿")
    rows = text.split("\n")
    starts = list(accumulate((len(row) + 1 for row in rows), initial=0))

    def offset(line: int, col: int) -> int:  # columns are counted in UTF-8
        row = rows[line - 1]
        return starts[line - 1] + (col if row.isascii() else len(row.encode()[:col].decode(errors="ignore")))

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            yield from _python_blocks(rows, starts)
            return
    for node in _statements(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            start = starts[first - 1] + len(rows[first - 1]) - len(rows[first - 1].lstrip())
            yield node.name, node.lineno, start, offset(node.end_lineno, node.end_col_offset)


def _statements(tree: ast.Module):
    """The blocks of a tree, level by level: functions stand in them alone, never in expressions."""
    todo: list[ast.AST] = [tree]
    for node in todo:
        yield node
        for field in ("body", "cases", "handlers", "orelse", "finalbody"):
            todo += getattr(node, field, ())


_DEF = re.compile(r"([ \t]*)(?:async[ \t]+)?def[ \t]+([^\W\d]\w*)[ \t]*[(\[]")


def _python_blocks(rows: list[str], starts: list[int]):
    """Functions of a text that does not parse as a whole: each lasts until its indentation ends."""
    open_defs: list[tuple[int, str, int]] = []  # (indentation, name, row)
    last, depth = 0, 0
    ended = lambda row, name: (name, row + 1, starts[row] + len(rows[row]) - len(rows[row].lstrip()), starts[last] + len(rows[last].rstrip()))
    for k, row in enumerate(rows):
        if not row.strip():
            continue
        indent = len(row) - len(row.lstrip())
        m = _DEF.match(row)
        if m or depth <= 0 and row.lstrip()[0] not in ")]}#":
            while open_defs and open_defs[-1][0] >= indent:
                _, name, at = open_defs.pop()
                yield ended(at, name)
            depth = 0
        if m:
            open_defs.append((indent, m[2], k))
        if m or depth > 0:  # a header may go on over lines
            depth += sum(map(row.count, "([{")) - sum(map(row.count, ")]}"))
        last = k
    for _, name, at in reversed(open_defs):
        yield ended(at, name)




def _first(table: lx.Kinds) -> lx.Kinds:
    """Of each token's kind what its place in the text needs: one character, or none."""
    return lx.Kinds(lambda token: "[" if (k := table[token]) == "#[" else k[:1])


_LEX = {"js": (lx.JS_TOKEN, _first(lx._JS)), "go": (lx.GO_TOKEN, _first(lx._GO)), "php": (lx.PHP_TOKEN, _first(lx._PHP))}
_LEX["ts"] = _LEX["js"]
_J, _G, _P = lx.JS_WORDS, lx.GO_WORDS, lx.PHP_WORDS
_NAME = "i" + "".join(_J[w] for w in lx.JS_CONTEXTUAL.split())
_JS_FUNCTION = re.compile(f"{_J['function']}\\*?([{_NAME}])")
_JS_VALUE = re.compile(f"(?:[{_J['const']}{_J['let']}{_J['var']},]|(?<=[G;n{{}}]))([{_NAME}])(?=(?::[^=;{{}}n]*)?=(?:{_J['async']})?(?:[({_NAME}<]|{_J['function']}))")
_JS_METHOD = re.compile(f"([{_NAME}{''.join(_J[w] for w in lx.JS_RESERVED.split() if w not in ('if', 'for', 'while', 'switch', 'catch', 'function', 'with', 'return', 'new', 'typeof', 'import'))}])(?=[(<])")
_GO_FUNCTION = re.compile(f"{_G['func']}(?:\\([^()]*\\))?(i)(?=[(\\[])|(?<=[n;{{}}])(i)(?=d{_G['func']}\\()")
_PHP_FUNCTION = re.compile(f"{_P['function']}&?([i{''.join(_P.values())}])(?=\\()")
_BRACKET = re.compile(r"[(){}\[\]]")
_CLOSERS = {")": "(", "]": "[", "}": "{"}


def _brace_nodes(text: str, lang: str):
    pattern, table = _LEX[lang]
    tokens = [m[0] for m in pattern.finditer(text)] if pattern.groups else pattern.findall(text)  # together they are the text
    kinds = list(map(table.__getitem__, tokens))
    s = "".join(kinds)
    starts, sizes = list(compress(accumulate(map(len, tokens), initial=0), kinds)), list(compress(map(len, tokens), kinds))
    match: dict[int, int] = {}
    stack: list[int] = []
    for m in _BRACKET.finditer(s):
        i = m.start()
        c = s[i]
        if c in "([{":
            stack.append(i)
        elif stack and s[stack[-1]] == _CLOSERS[c]:
            match[stack.pop()] = i
        elif _CLOSERS[c] in (left := [s[j] for j in stack[-8:]]):
            # a bracket left open inside a closed one ends with it; a closing one without a partner closes nothing
            for _ in range(left[::-1].index(_CLOSERS[c]) + 1):
                match[stack.pop()] = i
    match |= dict.fromkeys(stack, len(s) - 1)  # cut off: to the end of the text
    found: list[tuple[int, int]] = []  # token of the name, token of the end
    if lang in ("js", "ts"):
        classes = _class_bodies(s, match)
        for m in _JS_FUNCTION.finditer(s):
            found.append((m.start(1), _body(s, match, m.end(1))))
        for m in _JS_VALUE.finditer(s):
            end = _value(s, match, m.end(1))
            if end is not None:
                found.append((m.start(1), end))
        if classes:
            names = [m for m in _JS_METHOD.finditer(s) if s[m.start(1) - 1] not in ".=(,:?"]
            for m, holder in zip(names, _holders([m.start(1) for m in names], match), strict=True):
                if holder in classes:
                    end = _body(s, match, m.end(1), declared=True)
                    if end is not None:
                        found.append((m.start(1), end))
    elif lang == "go":
        for m in _GO_FUNCTION.finditer(s):
            g = 1 if m[1] else 2
            found.append((m.start(g), _body(s, match, s.find("(", m.end(g)) if g == 2 else m.end(g))))
    else:
        for m in _PHP_FUNCTION.finditer(s):
            found.append((m.start(1), _body(s, match, m.end(1))))
    if not found:
        return
    begins = list(accumulate(map((1).__add__, map(len, text.split("\n")))))  # of all lines but the first
    for at, end in found:
        if end is None or end >= len(starts):
            continue
        a = starts[at]
        line = bisect.bisect_right(begins, a)
        start = begins[line - 1] if line else 0
        begin = start + len(text[start:a]) - len(text[start:a].lstrip(" \t"))
        yield text[a : a + sizes[at]], line + 1, begin, starts[end] + sizes[end]


def _class_bodies(s: str, match: dict[int, int]) -> set[int]:
    """The braces that hold the members of a class or interface: the first after its head that is no object type or argument."""
    out = set()
    for m in re.finditer(_J["class"] + "|" + _J["interface"], s):
        i = m.end()
        while i < len(s):
            c = s[i]
            if c == "{" and s[i - 1] not in "<,|&:":
                out.add(i)
                break
            if c in "([{":
                i = match.get(i, len(s))
            elif c in ";)]}":
                break
            i += 1
    return out & match.keys()


def _holders(places: list[int], match: dict[int, int]) -> list[int]:
    """For each of the ascending places the innermost matched bracket around it, or -1; one pass over both."""
    opens, out, stack, k = sorted(match), [], [], 0
    for at in places:
        while k < len(opens) and opens[k] < at:
            while stack and match[stack[-1]] < opens[k]:
                stack.pop()
            stack.append(opens[k])
            k += 1
        while stack and match[stack[-1]] < at:
            stack.pop()
        out.append(stack[-1] if stack else -1)
    return out


def _body(s: str, match: dict[int, int], at: int, declared: bool = False):
    """The token that ends a function whose parameters (after type parameters) begin at ``at``."""
    if at < len(s) and s[at] in "<[":
        at = s.find("(", at)
    if at < 0 or at not in match:
        return None
    i = match[at] + 1
    while i < len(s):
        c = s[i]
        if c == "{":
            if i not in match:
                return None
            if s[i - 1] in ":|&<a" and s[match[i] + 1 : match[i] + 2] in ("{", "[", "|", "&"):
                i = match[i] + 1  # an object type before the body
                continue
            return match[i]
        if c in "([":
            i = match.get(i, len(s)) + 1
            continue
        if c in ";n}" or c == "=":
            return i - 1 if declared and c != "=" else None
        i += 1
    return len(s) - 1 if declared else None


def _value(s: str, match: dict[int, int], at: int):
    """The token that ends a function assigned after ``at``, or None if the value is no function."""
    i = s.find("=", at) + 1
    if s[i : i + 1] == _J["async"]:
        i += 1
    if s[i : i + 1] == _J["function"]:
        j = s.find("(", i)
        return _body(s, match, j) if j > 0 else None
    if s[i : i + 1] == "<":
        i = s.find("(", i)
    if s[i : i + 1] == "(":
        if i not in match:
            return None
        i = match[i] + 1
        if s[i : i + 1] == ":":
            j = s.find("a", i)
            if j < 0 or re.search("[;n]", s[i:j]):
                return None
            i = j
    else:
        i += 1
    if s[i : i + 1] != "a":
        return None
    i += 1
    if s[i : i + 1] == "{":
        return match.get(i)
    while i < len(s):  # an expression: to the end of its line or list
        c = s[i]
        if c in "([{":
            i = match.get(i, len(s)) + 1
            continue
        if c in ";n,)]}":
            break
        i += 1
    return i - 1


def function_nodes(text: str, lang: str) -> list[tuple[str, int, int, int]]:
    """(name, line from 1, start, end) of each function and method; offsets are characters of the text.

    A text that does not parse still gives the functions that can be told: in Python by indentation, in the brace
    languages with brackets left open closed by the next that fits.
    """
    return list(_python_nodes(text) if lang == "py" else _brace_nodes(text, lang))


def _nodes(with_code: bool):
    def run(batches):
        for pdf in batches:
            rows = []
            for path, lang, text in zip(pdf["path"], pdf["lang"], pdf["content"], strict=True):
                bom = text.startswith("﻿") and lang == "py"
                for name, line, start, end in function_nodes(text, lang):
                    start, end = start + bom, end + bom
                    rows.append((path, line, name, lang, start, end, text[start:end] if with_code else None))
            yield pd.DataFrame(rows, columns=["path", "line", "name", "lang", "start", "end", "code"])

    return run


def nodes(files: DataFrame, with_code: bool = True) -> DataFrame:
    """Function nodes of all files with a known language: path, line, name, lang, start, end, code; one per path, line and name."""
    src = files.where("path is not null and content is not null").select("path", _lang("path").alias("lang"), "content").where("lang is not null")
    out = src.mapInPandas(_nodes(with_code), "path string, line int, name string, lang string, start int, end int, code string")
    return out.dropDuplicates(["path", "line", "name"])


@F.pandas_udf(T.StringType())
def _described(comment: pd.Series, name: pd.Series, lang: pd.Series) -> pd.Series:
    none = lambda x: None if x is None or x != x else x
    return pd.Series([describe(none(c), none(n), none(k)) for c, n, k in zip(comment, name, lang, strict=True)], dtype="object")


_described = _described.asNondeterministic()  # else a filter on it runs it once more


def _lang(path: str):
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return known[F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))]


def documented(symbols: DataFrame, files: DataFrame, with_code: bool = True, without_node: bool = False) -> DataFrame:
    """One row per function node met by a described symbol: symbol_id, name, kind, description, file_path, line, start, end, code.

    Kinds are compared without case and surrounding blanks; repeated ids count once. Null ids, symbols that no node of
    their file meets at their line and by their name, and symbols whose comment is null, blank or says nothing are left
    out. ``without_node`` adds the described symbols whose file is absent, has no text or does not parse up to them,
    with null start, end and code. Empty tables give an empty result; other columns are ignored.
    """
    kind = F.lower(F.regexp_replace("kind", r"^\s+|\s+$", ""))
    own = symbols.where(F.col("id").isNotNull() & kind.isin("function", "method") & F.col("comment").isNotNull())
    own = own.groupBy(F.col("id").alias("symbol_id")).agg(F.min(F.struct(F.col("name").alias("symbol_name"), kind.alias("kind"), "comment", "file_path", F.col("line").alias("at"))).alias("s")).select("symbol_id", "s.*")
    own = own.select("symbol_id", "symbol_name", "kind", _described("comment", "symbol_name", _lang("file_path")).alias("description"), "file_path", "at").where("description is not null")
    found = nodes(files, with_code)
    if without_node:  # both are asked twice, read once
        scratch = Scratch(files.sparkSession, "nodes")
        found, own = scratch.put(found), scratch.put(own)
    here = (own.file_path == found.path) & (own["at"] == found.line) & (own.symbol_name == found.name)
    shown = lambda rows, *place: rows.select("symbol_id", F.col("symbol_name").alias("name"), "kind", "description", "file_path", F.col("at").alias("line"), *place)
    out = shown(own.join(found, here), "start", "end", "code")
    if without_node:
        none = [F.lit(None).cast(kind).alias(c) for c, kind in (("start", "int"), ("end", "int"), ("code", "string"))]
        out = out.unionByName(shown(own.join(found, here, "left_anti"), *none))
    return out
