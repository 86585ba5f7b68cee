"""PHP: statements, classes, expressions and types over kinds. Line ends mean nothing here."""

from __future__ import annotations

import re

from quern.llm.grammar import Bad, Parser, judge, remembered
from quern.llm.lexing import PHP_WORDS, php_kinds, structure

W = PHP_WORDS
KEYWORDS = "".join(W.values())
SOFT = "".join(W[w] for w in "enum match readonly from".split())
NAME = "i" + SOFT
TYPE = NAME + "".join(W[w] for w in ("array", "callable", "static"))
MODIFIERS = "".join(W[w] for w in "public private protected static abstract final readonly var".split())
BINARY = "o*m|&<." + "".join(W[w] for w in "and or xor instanceof".split())
UNARY = "m!@&~p" + "".join(W[w] for w in "clone print include include_once require require_once new throw".split())
OPENERS = {"if": "endif", "for": "endfor", "foreach": "endforeach", "while": "endwhile", "switch": "endswitch", "declare": "enddeclare"}
_SPLIT = re.compile(r"(?<=;)(?=[^)])")


class Php(Parser):
    def __init__(self, text: str):
        super().__init__(text)
        self.open: list[str] = []  # alternative blocks opened (+) and closed (-) by this piece

    def close(self) -> None:
        if not self.end:
            self.need(";")

    def statements(self) -> None:
        while not self.end:
            self.statement()

    def statement(self) -> None:
        self.attributes()
        c, nxt = self.c, self.ahead()
        word = _WORD.get(c, "")
        if c == ";":
            self.p += 1
        elif c == "G":
            self.group("block")
        elif word in ("if", "elseif", "for", "foreach", "while", "switch", "declare"):
            self.p += 1
            self.control(word)
        elif word == "else":
            self.p += 1
            if self.take(":"):
                self.open += ["-if", "+if"]
            else:
                raise Bad
        elif word.startswith("end") and word != "":
            self.p += 1
            self.open.append("-" + word[3:])
            self.close()
        elif word == "do":
            self.p += 1
            self.statement()
            self.need(W["while"])
            self.paren()
            self.close()
        elif word == "try":
            self.p += 1
            self.group("block")
            n = 0
            while self.take(W["catch"]):
                n += 1
                self.need("(")
                self.type()
                self.take("v")
                self.need(")")
                self.group("block")
            if self.take(W["finally"]):
                self.group("block")
            elif not n:
                raise Bad
        elif word == "namespace" and nxt != "j":
            self.p += 1
            self.take(NAME)
            if self.c == "G":
                self.group("block")
            else:
                self.close()
        elif word == "use":
            self.p += 1
            self.take(W["function"] + W["const"])
            while True:
                if self.take("j"):
                    self.group("uses")
                else:
                    self.need(NAME)
                    if self.take(W["as"]):
                        self.need(NAME)
                if not self.take(","):
                    break
            self.close()
        elif word == "const":
            self.p += 1
            self.constants()
        elif word == "function" and (nxt in NAME or nxt == "&" and self.ahead(2) in NAME):
            self.p += 1
            self.take("&")
            self.need(NAME)
            self.signature()
            self.group("block")
        elif word in ("abstract", "final", "class", "interface", "trait") or word == "readonly" and nxt in MODIFIERS + W["class"] or word == "enum" and nxt in NAME:
            self.type_declaration()
        elif word in ("return", "break", "continue"):
            self.p += 1
            if not self.end and self.c != ";":
                self.expression()
            self.close()
        elif word in ("echo",):
            self.p += 1
            self.list()
            self.close()
        elif word == "global":
            self.p += 1
            self.list()
            self.close()
        elif word == "static" and nxt == "v":
            self.p += 1
            while True:
                self.need("v")
                if self.take("="):
                    self.expression()
                if not self.take(","):
                    break
            self.close()
        elif word == "goto":
            self.p += 1
            self.need(NAME)
            self.close()
        elif word in ("case", "default") and nxt not in "(":
            raise Bad
        elif c in NAME and nxt == ":" and self.ahead(2) != ":":
            self.p += 2
        else:
            self.expression()
            self.close()

    def control(self, word: str) -> None:
        self.need("(")
        if word == "for":
            for k in range(3):
                if self.c not in "f)":
                    self.list()
                if k < 2:
                    self.need("f")
        elif word == "foreach":
            self.expression()
            self.need(W["as"])
            self.take("&")
            self.expression()
            if self.take("a"):
                self.take("&")
                self.expression()
        elif word == "declare":
            self.need(NAME)
            self.need("=")
            self.expression()
        else:
            self.expression()
        self.need(")")
        if self.take(":"):
            self.open += ["-if", "+if"] if word == "elseif" else ["+" + word]
            return
        if word == "switch":
            self.group("switch")
            return
        if word == "declare" and (self.end or self.take(";")):
            return
        self.statement()
        if word in ("if", "elseif"):
            if self.c == W["elseif"]:
                self.p += 1
                self.control("elseif")
            elif self.c == W["else"] and self.ahead() != ":":
                self.p += 1
                self.statement()

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def constants(self) -> None:
        if self.c in TYPE and self.ahead() in NAME + KEYWORDS and self.ahead() != "\0":
            self.type()
        while True:
            self.need(NAME + KEYWORDS)
            self.need("=")
            self.expression()
            if not self.take(","):
                return self.close()

    def attributes(self) -> None:
        while self.take("#"):
            self.need("[")
            while not self.take("]"):
                self.need(NAME)
                if self.c == "(":
                    self.arguments()
                if self.c != "]":
                    self.need(",")

    def type_declaration(self) -> None:
        while self.take(MODIFIERS):
            pass
        kind = self.c
        self.need(W["class"] + W["interface"] + W["trait"] + W["enum"])
        self.need(NAME)
        if kind == W["enum"] and self.take(":"):
            self.type()
        for word in ("extends", "implements"):
            if self.take(W[word]):
                self.need(NAME)
                while self.take(","):
                    self.need(NAME)
        self.group("class")

    def signature(self) -> None:
        self.parameters()
        if self.take(W["use"]):
            self.need("(")
            while not self.take(")"):
                self.take("&")
                self.need("v")
                if self.c != ")":
                    self.need(",")
        if self.take(":"):
            self.type()

    def parameters(self) -> None:
        self.need("(")
        while not self.take(")"):
            self.attributes()
            while self.take(MODIFIERS):
                pass
            if self.c not in "v&e":
                self.type()
            self.take("&")
            self.take("e")
            self.need("v")
            if self.take("="):
                self.expression()
            if self.c == "G":
                self.group("hooks")
            if not self.take(","):
                self.need(")")
                return

    def type(self) -> None:
        self.take("?")
        while True:
            if self.take("("):
                self.type()
                self.need(")")
            else:
                self.need(TYPE)
            if self.c == "|" or self.c == "&" and self.ahead() not in "ve&":
                self.p += 1
            else:
                return

    # ------------------------------------------------------------------------------------------------ expressions
    def list(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def expression(self) -> None:
        self.binary()
        if self.take("?"):
            if not self.take(":"):
                self.expression()
                self.need(":")
            self.expression()
            if self.c == "?":
                self.expression_tail()

    def expression_tail(self) -> None:
        while self.take("?"):
            if not self.take(":"):
                self.expression()
                self.need(":")
            self.binary()

    def binary(self) -> None:
        self.unary()
        while True:
            c = self.c
            if c in BINARY and c != "\0":
                self.p += 1
                self.unary()
            elif c in "=A" and c != "\0":
                self.p += 1
                self.take("&")
                self.unary()
            else:
                return

    def unary(self) -> None:
        while self.c in UNARY and self.c != "\0":
            made = self.c == W["new"]
            self.p += 1
            if made and self.c == W["class"] or made and self.c == W["readonly"] and self.ahead() == W["class"]:
                self.take(W["readonly"])
                self.p += 1
                if self.c == "(":
                    self.arguments()
                for word in ("extends", "implements"):
                    if self.take(W[word]):
                        self.need(NAME)
                        while self.take(","):
                            self.need(NAME)
                self.group("class")
                return
        if self.c == W["yield"]:
            self.p += 1
            self.take(W["from"])
            if not self.end and self.c not in ";),]":
                self.expression()
                if self.take("a"):
                    self.expression()
            return
        self.operand()
        while True:
            c = self.c
            if c == ">":
                self.p += 1
                if self.c == "G":
                    self.group("one")
                else:
                    self.need(NAME + KEYWORDS + "v")
            elif c == "q":
                self.p += 1
                if self.c == "G":
                    self.group("one")
                else:
                    self.need(NAME + KEYWORDS + "v")
            elif c == "[":
                self.p += 1
                if not self.take("]"):
                    self.expression()
                    self.need("]")
            elif c == "(":
                self.arguments()
            elif c == "p":
                self.p += 1
            else:
                return

    def arguments(self) -> None:
        self.need("(")
        while not self.take(")"):
            if self.take("e"):
                if self.take(")"):
                    return
            elif self.c in NAME + KEYWORDS and self.ahead() == ":" and self.c != "\0":
                self.p += 2
            self.expression()
            if not self.take(","):
                self.need(")")
                return

    def operand(self) -> None:
        c, nxt = self.c, self.ahead()
        if c in "v0s":
            self.p += 1
        elif c == "$":
            self.p += 1
            if self.c == "G":
                self.group("one")
            else:
                self.operand()
        elif c == "(":
            self.paren()
        elif c == "[":
            self.p += 1
            self.elements("]")
        elif c == W["array"] and nxt == "(" or c == W["list"] and nxt == "(":
            self.p += 2
            self.elements(")")
        elif c in (W["fn"], W["function"]) or c == W["static"] and nxt in W["fn"] + W["function"]:
            self.take(W["static"])
            short = self.c == W["fn"]
            self.p += 1
            self.take("&")
            self.signature()
            if short:
                self.need("a")
                self.expression()
            else:
                self.group("block")
        elif c == W["match"] and nxt == "(":
            self.p += 1
            self.paren()
            self.group("match")
        elif c == "#":
            self.attributes()
            self.operand()
        elif c in NAME + "".join(W[w] for w in "static isset empty exit die unset array callable namespace self".split() if w in W):
            self.p += 1
        else:
            raise Bad

    def elements(self, right: str) -> None:
        while not self.take(right):
            if self.take(","):
                continue
            if not self.take("&e"):
                self.expression()
                if self.take("a"):
                    self.take("&")
                    self.expression()
            else:
                self.expression()
            if self.c != right:
                self.need(",")

    # ------------------------------------------------------------------------------------------------ brace bodies
    def one(self) -> None:
        self.expression()

    def members(self) -> None:
        while not self.end:
            if self.take(";"):
                continue
            self.attributes()
            if self.take(W["use"]):
                self.need(NAME)
                while self.take(","):
                    self.need(NAME)
                if self.c == "G":
                    self.group("adaptations")
                else:
                    self.close()
                continue
            if self.take(W["case"]):
                self.need(NAME + KEYWORDS)
                if self.take("="):
                    self.expression()
                self.close()
                continue
            some = False
            while self.take(MODIFIERS):
                some = True
            if self.take(W["const"]):
                self.constants()
            elif self.take(W["function"]):
                self.take("&")
                self.need(NAME + KEYWORDS)
                self.signature()
                if self.c == "G":
                    self.group("block")
                else:
                    self.close()
            elif some:
                if self.c != "v":
                    self.type()
                while True:
                    self.need("v")
                    if self.take("="):
                        self.expression()
                    if not self.take(","):
                        break
                if self.c == "G":
                    self.group("hooks")
                else:
                    self.close()
            else:
                raise Bad

    def clauses(self) -> None:
        while not self.end:
            if self.take(W["case"]):
                self.expression()
                self.need(":;")
            elif self.c == W["default"] and self.ahead() in ":;":
                self.p += 2
            else:
                self.statement()

    def arms(self) -> None:
        while not self.end:
            if self.c == W["default"]:
                self.p += 1
                self.take(",")
            else:
                self.expression()
                while self.take(",") and self.c != "a":
                    self.expression()
            self.need("a")
            self.expression()
            if not self.end:
                self.need(",")

    def uses(self) -> None:
        while not self.end:
            self.take(W["function"] + W["const"])
            self.need(NAME)
            if self.take(W["as"]):
                self.need(NAME)
            if not self.end:
                self.need(",")

    def loose(self) -> None:
        """Hooks and trait adaptations: brackets and statements' ends only."""
        while not self.end:
            if self.c == "G":
                self.group("block")
            else:
                self.p += 1


_WORD = {v: k for k, v in W.items()}
_RULES = {"block": Php.statements, "file": Php.statements, "class": Php.members, "switch": Php.clauses, "match": Php.arms, "one": Php.one, "uses": Php.uses, "hooks": Php.loose, "adaptations": Php.loose}
_WHOLE = {"class", "switch", "match", "one", "uses", "hooks", "adaptations"}


@remembered
def _parse(piece: str, role: str):
    parser = Php(piece)
    try:
        _RULES[role](parser)
    except Bad:
        return None
    return (tuple(parser.roles), tuple(parser.open)) if parser.end else None


def parse(piece: str, role: str):
    """Roles, if the piece is right; a list of statements in alternative syntax must also close what it opens."""
    out = _parse(piece, role)
    return None if out is None or out[1] else out[0]


def pieces_of(content: str, role: str) -> list[str]:
    """Statements; those that open an alternative block go on to where it is closed."""
    if role in _WHOLE:
        return [content] if content else []
    return [piece for piece in _SPLIT.split(content) if piece]


def _statements(content: str):
    """Roles of the groups of a list of statements cut into pieces, or None."""
    roles: list[str] = []
    depth: list[str] = []
    for piece in _SPLIT.split(content):
        if not piece:
            continue
        out = _parse(piece, "block")
        if out is None and depth and depth[-1] == "switch":
            out = _parse(piece, "switch")
        if out is None:
            return None
        roles += out[0]
        for event in out[1]:
            if event[0] == "+":
                depth.append(event[1:])
            elif not depth or depth.pop() != event[1:]:
                return None
    return None if depth else tuple(roles)


def valid(text: str) -> bool:
    kinds = php_kinds(text)
    if kinds is None:
        return True
    if "X" in kinds:
        return False
    node = structure(kinds)
    if node is None:
        return False
    whole = lambda content, role: [content] if content else []
    return judge(node, "file", whole, lambda content, role: _statements(content) if role in ("file", "block") else parse(content, role))
