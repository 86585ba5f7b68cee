"""Lexers for source text: every token becomes one character, its kind.

A file turns into a short string of kinds (``const a = f(1)`` into ``c i = i ( 0 )`` without the blanks), on which brackets
are matched and grammars work. Tokens are split by one compiled pattern and looked up in a dictionary that classifies
each distinct token once, so the work per token stays in C. Kinds shared by all languages:

``i`` name, ``0`` number, ``s`` string, ``n`` line end, ``G`` a balanced brace group (put in by :func:`structure`), ``X`` not
a token; punctuation stands for itself, operators and keywords have characters of their own.
"""

from __future__ import annotations

import re


class Kinds(dict):
    """Kind by token, filled on first sight and bounded."""

    def __init__(self, classify, most: int = 100_000):
        super().__init__()
        self.classify, self.most = classify, most

    def __missing__(self, token: str) -> str:
        kind = self.classify(token)
        if len(token) <= 200:
            if len(self) >= self.most:
                self.clear()
            self[token] = kind
        return kind


def keyword_kinds(words: str, base: int) -> dict[str, str]:
    return {w: chr(base + i) for i, w in enumerate(words.split())}


# ---------------------------------------------------------------------------------------------- JavaScript, TypeScript
# Reserved words, then words that are names elsewhere.
JS_RESERVED = "break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof new return switch throw try typeof var void while with"
JS_CONTEXTUAL = "let async await yield static get set of from as type interface namespace module declare abstract readonly public private protected override accessor implements keyof infer is asserts satisfies unique global out"
JS_WORDS = keyword_kinds(JS_RESERVED, 0x100) | keyword_kinds(JS_CONTEXTUAL, 0x180)
JS_LITERAL_WORDS = {"this", "super", "null", "true", "false"}

_SQ = r"'(?:[^'\\\n]++|\\(?:\r\n|[\s\S]))*+'"
_DQ = r'"(?:[^"\\\n]++|\\(?:\r\n|[\s\S]))*+"'
_FLAT = r"`(?:[^`\\$]++|\\[\s\S]|\$(?!\{))*+`"
_HOLE1 = rf"\$\{{(?:[^{{}}`'\"]++|{_SQ}|{_DQ}|{_FLAT}|\{{[^{{}}`]*+\}})*+\}}"
_TPL1 = rf"`(?:[^`\\$]++|\\[\s\S]|\$(?!\{{)|{_HOLE1})*+`"
_HOLE = rf"\$\{{(?:[^{{}}`'\"]++|{_SQ}|{_DQ}|{_TPL1}|\{{(?:[^{{}}`'\"]++|{_SQ}|{_DQ}|{_TPL1}|\{{[^{{}}`]*+\}})*+\}})*+\}}"
_TPL = rf"`(?:[^`\\$]++|\\[\s\S]|\$(?!\{{)|{_HOLE})*+`"
_DIVISION = r"(?<=[\w$)\]])(?<!return)(?<!typeof)(?<!case)(?<!\bin)(?<!\bof)(?<!void)(?<!delete)(?<!throw)(?<!\belse)(?<!yield)(?<!await)[ \t]*/(?![/*])=?"
_REGEX = r"/(?![*/])(?:[^\\/\[\n]++|\\[^\n]|\[(?:[^\]\\\n]++|\\[^\n])*+\])++/[A-Za-z]*"
_JS_NUMBER = r"(?:0[xXbBoO][\da-fA-F_]++|(?:\d[\d_]*+(?:\.[\d_]*+)?|\.\d[\d_]*+)(?:[eE][+-]?\d++)?)n?(?![\w$])"
_JS_OP = r">>>=|>>=|===|!==|\*\*=|&&=|\|\|=|\?\?=|<<=|\.\.\.|=>|==|!=|<=|>=|\*\*|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|<<|[-+*%&|^]=|[{}()\[\];,<>+\-*%&|^!~?:=.@]"
_JS_PLAIN = rf"{_DIVISION}|#?(?:[^\W\d]|\$)[\w$]*+|[ \t\r\f\v\xa0\ufeff]+|\n\s*+|//[^\n]*+|/\*[\s\S]*?\*/|{_JS_OP}|{_SQ}|{_DQ}|{_JS_NUMBER}"
JS_TOKEN = re.compile(rf"{_JS_PLAIN}|{_TPL}|/\*|{_REGEX}|[\s\S]")
#: Without templates, whose holes nest as deep as they like: the pattern above knows those of small depth.
_JS_FLAT = re.compile(rf"{_JS_PLAIN}|/\*|{_REGEX}|[\s\S]")
_JS_IN_TEMPLATE = re.compile(r"\\[\s\S]|`|\$\{")
_JS_HOLES = re.compile(rf"\\[\s\S]|{_HOLE}")
JS_OPS = {c: c for c in "{}()[];,<>*|&!~?:=.@"} | {"=>": "a", "...": "e", "?.": "q", "++": "p", "--": "p", "+": "m", "-": "m"}
JS_OPS |= {c: "A" for c in ">>>= >>= **= &&= ||= ??= <<= += -= *= %= &= |= ^= /=".split()}
JS_OPS |= {c: "o" for c in "=== !== == != <= >= ** && || ?? << % ^ /".split()}


def _js_kind(token: str) -> str:
    c = token[0]
    if c == "\n":
        return "n"
    if c in " \t\r\f\v\xa0\ufeff":
        token = token.strip(" \t\r\f\v\xa0\ufeff")
        return JS_OPS[token] if token in ("/", "/=") else "X" if token else ""
    if c.isalpha() or c in "_$#":
        return JS_WORDS.get(token) or ("j" if token in JS_LITERAL_WORDS else "X" if token == "#" else "i")
    if token in JS_OPS:
        return JS_OPS[token]
    if len(token) == 1:
        return "0" if c.isdecimal() and c.isascii() else "i" if c.isalnum() and not c.isdecimal() else "X"
    if c in "'\"":
        return "s"
    if c == "`":
        if len(token) == 1:
            return "X"
        holes = [hole for hole in _JS_HOLES.findall(token) if hole[0] == "$"] if "${" in token else []
        return "t" + "".join("h" + js_kinds(hole[2:-1]).replace("n", "") + "h" for hole in holes) + "T" if holes else "t"
    if c == "/":
        return "" if token[1] == "/" else ("n" if "\n" in token else "" if len(token) > 3 else "X") if token[1] == "*" else "r"
    return "0" if c.isdecimal() or c == "." else "X"


_JS = Kinds(_js_kind)


def js_kinds(text: str) -> str:
    if text.startswith("#!"):
        text = "//" + text[2:]
    kinds = "".join(map(_JS.__getitem__, JS_TOKEN.findall(text)))
    return _js_nested(text) if "X" in kinds and "`" in text else kinds


def _js_nested(text: str) -> str:
    """The kinds with templates read by an explicit stack; a template that does not end gives ``X``."""
    out: list[str] = []
    holes: list[bool] = []  # of each open template, whether it has a hole
    braces: list[int] = []  # of each open hole, the braces open in it
    at, inside = 0, False
    while at < len(text):
        if inside:
            m = _JS_IN_TEMPLATE.search(text, at)
            if not m:
                break
            at = m.end()
            if m[0] == "`":
                if holes.pop():
                    out.append("T")
                inside = False
            elif m[0] == "${":
                holes[-1] = True
                out.append("h")
                braces.append(0)
                inside = False
            continue
        for m in _JS_FLAT.finditer(text, at):
            token = m[0]
            at = m.end()
            if token == "`":
                out.append("t")
                holes.append(False)
                inside = True
                break
            if braces and token == "}" and not braces[-1]:
                braces.pop()
                out.append("h")
                inside = True
                break
            if braces and token in "{}":
                braces[-1] += 1 if token == "{" else -1
            kind = _JS[token]
            out.append(kind.replace("n", "") if braces else kind)
    return "".join(out) + ("X" if holes else "")


# ---------------------------------------------------------------------------------------------------------------- Go
GO_WORDS = keyword_kinds("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var", 0x200)
_GO_OP = r"<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|&\^|<<|>>|[-+*/%&|^]=|[{}()\[\];,<>+\-*/%&|^!~?:=.@]"
GO_TOKEN = re.compile(rf"[^\W\d]\w*+|[ \t\r\f\v]+|\n\s*+|//[^\n]*+|/\*[\s\S]*?\*/|/\*|{_GO_OP}|\"(?:[^\"\\\n]++|\\[^\n])*+\"|`[^`]*+`|'(?:[^'\\\n]|\\[^\n]{{1,10}}?)'|(?:0[xXbBoO][\da-fA-F_]++|(?:\d[\d_]*+(?:\.[\d_]*+)?|\.\d[\d_]*+)(?:[eEpP][+-]?\d++)?)i?(?!\w)|[\s\S]")
GO_OPS = {c: c for c in "{}()[];,*&!^~:=.<"} | {"...": "e", "<-": "q", "++": "p", "--": "p", "+": "m", "-": "m", ":=": "d", "|": "|"}
GO_OPS |= {c: "A" for c in "<<= >>= &^= += -= *= /= %= &= |= ^=".split()} | {c: "o" for c in "&& || == != <= >= &^ << >> / % >".split()}


def _go_kind(token: str) -> str:
    c = token[0]
    if c == "\n":
        return "n"
    if c in " \t\r\f\v":
        return ""
    if c == "\ufeff":
        return "X"
    if c.isalpha() or c == "_":
        return GO_WORDS.get(token, "i")
    if token in GO_OPS:
        return GO_OPS[token]
    if c == "/":
        return "" if token[1] == "/" else ("n" if "\n" in token else "") if len(token) > 3 else "X"
    if c in "\"'`":
        return "s" if len(token) > 1 else "X"
    return "0" if c.isdecimal() and c.isascii() or c == "." else "X"


_GO = Kinds(_go_kind)
_GO_ENDS = "i0s)]}p" + "".join(GO_WORDS[w] for w in ("break", "continue", "fallthrough", "return"))
_GO_NO_SEMI = re.compile(f"(?<![{re.escape(_GO_ENDS)}])n+|(?<=n)n+")


def go_kinds(text: str) -> str:
    """Line ends stay only where the language puts a semicolon."""
    return _GO_NO_SEMI.sub("", "".join(map(_GO.__getitem__, GO_TOKEN.findall(text.removeprefix("\ufeff") + "\n"))))


# --------------------------------------------------------------------------------------------------------------- PHP
PHP_WORDS = keyword_kinds(
    "abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list namespace new or print private protected public readonly require require_once return static switch throw trait try unset use var while xor yield match enum exit die from",
    0x300,
)
_PHP_NAME = r"\\?[^\W\d]\w*+(?:\\[^\W\d]\w*+)*+\\?"
_PHP_OP = r"<=>|\*\*=|\.\.\.|<<=|>>=|===|!==|\?\?=|\?->|->|=>|::|\+\+|--|&&|\|\||\?\?|==|!=|<>|<=|>=|<<|>>|\*\*|[-+*/%&|^.]=|\#\[|[{}()\[\];,<>+\-*/%&|^!~?:=.@$]"
PHP_TOKEN = re.compile(
    r"\?>(?:(?!<\?(?:php\b|=))[\s\S])*+(?:<\?(?:php\b|=)|\Z)|\$[^\W\d]\w*+|\(\s*(?:int|integer|float|double|real|string|bool|boolean|array|object|binary|unset)\s*\)"
    + rf"|{_PHP_NAME}|\s+|(?://|\#(?!\[))(?:(?!\?>)[^\n])*+|/\*[\s\S]*?\*/|/\*|<<<[ \t]*([\"']?)([^\W\d]\w*)\1\r?\n(?:[\s\S]*?\n)??[ \t]*\2\b|{_PHP_OP}"
    + r"|'(?:[^'\\]++|\\[\s\S])*+'|\"(?:[^\"\\{]++|\\[\s\S]|\{\$(?:[^{}\"']++|'[^']*'|\"[^\"]*\"|\{[^{}]*\})*+\}|\{)*+\"|`(?:[^`\\]++|\\[\s\S])*+`"
    + r"|(?:0[xXbBoO][\da-fA-F_]++|(?:\d[\d_]*+(?:\.[\d_]*+)?|\.\d[\d_]*+)(?:[eE][+-]?\d++)?)(?!\w)|[\s\S]",
    re.IGNORECASE,
)
PHP_OPEN = re.compile(r"<\?(?:php\b|=)", re.IGNORECASE)
PHP_OPS = {c: c for c in "{}()[];,&|!~?:=.@<$"} | {"...": "e", "->": ">", "?->": ">", "=>": "a", "::": "q", "++": "p", "--": "p", "+": "m", "-": "m", "#[": "#["}
PHP_OPS |= {c: "A" for c in "**= <<= >>= ??= += -= *= /= %= &= |= ^= .=".split()} | {c: "o" for c in "<=> === !== && || ?? == != <> <= >= << >> ** * / % ^ >".split()}


def _php_kind(token: str) -> str:
    c = token[0]
    if c.isspace():
        return ""
    if token.startswith("?>"):
        return ";" + (PHP_WORDS["echo"] if token.endswith("=") and token[-3:] == "<?=" else "")
    if c == "$" and len(token) > 1:
        return "v"
    if c.isalpha() or c in "_\\":
        return PHP_WORDS.get(token.lower()) or ("j" if token.endswith("\\") else "i") if token != "\\" else "X"
    if token in PHP_OPS:
        return PHP_OPS[token]
    if c == "(":
        return "!"
    if c == "<" and token.startswith("<<<"):
        return "s"
    if c == "#" or token.startswith("//"):
        return ""
    if token.startswith("/*"):
        return "" if len(token) > 3 else "X"
    if c in "\"'`":
        return "s" if len(token) > 1 else "X"
    return "0" if c.isdecimal() and c.isascii() or c == "." else "X"


_PHP = Kinds(_php_kind)


def php_kinds(text: str) -> str | None:
    """None where the text never enters PHP."""
    start = PHP_OPEN.search(text)
    if not start:
        return None
    lead = PHP_WORDS["echo"] if start[0] == "<?=" else ""
    return lead + "".join([_PHP[m[0]] for m in PHP_TOKEN.finditer(text, start.end())])


# ------------------------------------------------------------------------------------------------------- brace groups
_BRACKETS = re.compile(r"[(){}\[\]n;]")
_PAIRS = {")": "(", "]": "[", "}": "{"}


def structure(kinds: str, drop_lines: bool = True):
    """The kinds as a node (content, children): each brace group is a child and a ``G`` in the content.

    Line ends inside round and square brackets go where ``drop_lines``; semicolons there become ``f``.
    None where brackets do not match.
    """
    buf: list[str] = []
    children: list = []
    frames: list = []
    opens: list[str] = []
    last = 0
    for m in _BRACKETS.finditer(kinds):
        i = m.start()
        if i > last:
            buf.append(kinds[last:i])
        last = i + 1
        c = kinds[i]
        if c == "n":
            if not drop_lines or not opens or opens[-1] == "{":
                buf.append("n")
        elif c == ";":
            buf.append("f" if opens and opens[-1] != "{" else ";")
        elif c == "{":
            opens.append(c)
            frames.append((buf, children))
            buf, children = [], []
        elif c in "([":
            opens.append(c)
            buf.append(c)
        else:
            if not opens or opens.pop() != _PAIRS[c]:
                return None
            if c == "}":
                node = ("".join(buf), children)
                buf, children = frames.pop()
                buf.append("G")
                children.append(node)
            else:
                buf.append(c)
    if opens:
        return None
    buf.append(kinds[last:])
    return "".join(buf), children
