"""Chunks of source text as lexer-state maps with bracket summaries.

Where a chunk begins is not known to be code, a comment, a template or a string, so a chunk is read once for each
state it could begin in. Reading gives the state it ends in, the closing brackets it needs from before and the opening
brackets it leaves. Two maps compose into the map of the joined text, associatively, so chunks of one file can be read
anywhere and in any order, and partial results merged in any grouping that keeps the order.

States by language: JavaScript and TypeScript ``code``, ``hole`` (code in a template's ``${}``), ``comment``, ``template``;
Python ``code`` and its two triple-quoted strings; Go ``code``, ``comment``, ``raw``; PHP ``html``, ``code``, ``comment``,
``single``, ``double``. A chunk that cannot be read without more context (a heredoc, a template in a template in a
template) gives ``None``: undecided, which the grammar then settles on the whole text.
"""

from __future__ import annotations

import re

from quern.llm.lexing import _DIVISION, _DQ, _REGEX, _SQ

BROKEN = "broken"
START = {"js": "code", "ts": "code", "py": "code", "go": "code", "php": "html"}
ENDS = {"js": {"code"}, "ts": {"code"}, "py": {"code"}, "go": {"code"}, "php": {"html", "code"}}
STATES = {"js": ["code", "hole", "comment", "template"], "py": ["code", "'''", '"""'], "go": ["code", "comment", "raw"], "php": ["html", "code", "comment", "single", "double"]}
STATES["ts"] = STATES["js"]
_BR = r"[(){}\[\]]"
_CODE = {
    "js": re.compile(rf"{_DIVISION}|//[^\n]*+|/\*|{_SQ}|{_DQ}|`|{_REGEX}|{_BR}"),
    "py": re.compile(rf"\#[^\n]*+|'''|\"\"\"|{_SQ}|{_DQ}|{_BR}|['\"]"),
    "go": re.compile(rf"//[^\n]*+|/\*|\"(?:[^\"\\\n]++|\\[^\n])*+\"|'(?:[^'\\\n]|\\[^\n]{{1,10}}?)'|`|{_BR}"),
    "php": re.compile(rf"\?>|(?://|\#(?!\[))(?:(?!\?>)[^\n])*+|/\*|<<<[ \t]*[\"']?[^\W\d]|['\"]|{_BR}"),
}
_CODE["ts"] = _CODE["js"]
#: What ends, or interrupts, each state that is not code.
_UNTIL = {"comment": re.compile(r"\*/"), "template": re.compile(r"\\[\s\S]|`|\$\{"), "raw": re.compile("`"), "'''": re.compile(r"\\[\s\S]|'''"), '"""': re.compile(r'\\[\s\S]|"""'), "single": re.compile(r"\\[\s\S]|'"), "double": re.compile(r'\\[\s\S]|"'), "html": re.compile(r"<\?(?:php\b|=)", re.I)}
_ENTER = {"/*": "comment", "`": "template", "'''": "'''", '"""': '"""', "'": "single", '"': "double", "?>": "html"}
_PAIR = {")": "(", "]": "[", "}": "{", "$": "$"}


def read(lang: str, text: str, state: str):
    """(state at the end, closers needed, openers left), BROKEN, or None where undecided."""
    need: list[str] = []
    stack: list[str] = []
    hole = state == "hole"
    mode, at = ("code" if hole else state), 0
    while at <= len(text):
        if mode != "code":
            m = _UNTIL[mode].search(text, at)
            if not m:
                break
            at = m.end()
            if m[0] == "${":
                stack.append("$")
                mode = "code"
            elif m[0][0] != "\\":
                mode = "code"
            continue
        for m in _CODE[lang].finditer(text, at):
            t = m[0]
            if t in "([{":
                stack.append(t)
            elif t in ")]}":
                if stack:
                    top = stack.pop()
                    if top == "$" and t == "}":
                        mode, at = "template", m.end()
                        break
                    if top != _PAIR[t]:
                        return BROKEN
                elif t == "}" and hole:
                    hole = False
                    need.append("$")
                    mode, at = "template", m.end()
                    break
                else:
                    need.append(t)
            elif t in _ENTER and not (lang == "py" and len(t) == 1):
                mode, at = ("raw" if lang == "go" and t == "`" else _ENTER[t]), m.end()
                break
            elif t[:3] == "<<<" or lang == "py" and t in "'\"":
                return None
        else:
            break
    return mode, "".join(need), "".join(stack)


def chunk_map(lang: str, text: str) -> dict:
    """The map of one chunk. A text that needs no brace reads alike in code and in a hole."""
    out = {s: read(lang, text, s) for s in STATES[lang] if s != "hole"}
    if "hole" in STATES[lang]:
        code = out["code"]
        out["hole"] = read(lang, text, "hole") if code is None or code == BROKEN or "}" in code[1] else code
    return out


def compose(first: dict, second: dict) -> dict:
    """The map of the two texts joined."""
    out = {}
    for state, one in first.items():
        if one is None or one == BROKEN:
            out[state] = one
            continue
        mode, need, give = one
        if mode == "code" and "hole" in second:
            inner = give.rstrip("([")
            if inner.endswith("$") or not inner and state == "hole" and "$" not in need:
                mode = "hole"
        two = second[mode]
        if two is None or two == BROKEN:
            out[state] = two
            continue
        end, wants, leaves = two
        k = 0
        while k < len(wants) and give:
            top, closer = give[-1], wants[k]
            if top == "$" and closer == "}":  # a second hole closed in one chunk: its rest was read in the wrong state
                out[state] = None
                break
            if top != _PAIR[closer]:
                out[state] = BROKEN
                break
            give, k = give[:-1], k + 1
        else:
            out[state] = (end, need + wants[k:], give + leaves)
    return out


def settle(lang: str, whole: dict) -> bool | None:
    """False where the text cannot be right, None where the grammar must say."""
    out = whole[START[lang]]
    if out == BROKEN:
        return False
    if out is None:
        return None
    mode, need, give = out
    return None if mode in ENDS[lang] and not need and not give else False
