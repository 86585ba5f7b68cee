"""JavaScript and TypeScript: statements, expressions, patterns, types and class bodies over kinds."""

from __future__ import annotations

import re

from quern.llm.grammar import Bad, Parser, judge, remembered
from quern.llm.lexing import JS_CONTEXTUAL, JS_RESERVED, JS_WORDS, js_kinds, structure

W = JS_WORDS
CONTEXTUAL = "".join(W[w] for w in JS_CONTEXTUAL.split())
RESERVED = "".join(W[w] for w in JS_RESERVED.split())
NAME = "i" + CONTEXTUAL  # binds
ANY_NAME = NAME + RESERVED + "j"  # after a dot, as a key
BINARY = "o*m<>|&" + W["in"] + W["instanceof"]
UNARY = "m!~" + W["typeof"] + W["void"] + W["delete"]
MODIFIERS = "".join(W[w] for w in "static async get set readonly public private protected abstract declare override accessor".split()) + "*"
ACCESS = "".join(W[w] for w in "public private protected readonly override".split())
VARS = W["var"] + W["let"] + W["const"]
# A line end parts statements unless what is before wants more or what follows goes on.
_OPEN = re.escape("(,.q=aAo*m<|&?:!~@e" + "".join(W[w] for w in "else do extends new in instanceof typeof void delete case of as implements".split()))
_GOES_ON = re.escape(").]q,;?:oA=*m<>|&a([t" + "".join(W[w] for w in "else catch finally in instanceof extends implements".split()))
_SPLIT = re.compile(f"(?<![{_OPEN}])n+(?![{_GOES_ON}n])")
LISTS = {"object", "pattern", "specs", "enum", "expression"}


class JS(Parser):
    def __init__(self, text: str, ts: bool):
        super().__init__(text)
        self.ts, self.target, self.no_in = ts, False, False

    def mode(self):
        return self.no_in

    # ------------------------------------------------------------------------------------------------- statements
    def close(self) -> None:
        """A semicolon, a line end or the end."""
        if self.take(";") or self.end or self.p in self.lines:
            return
        raise Bad

    def statements(self) -> None:
        while not self.end:
            self.statement()

    def statement(self) -> None:
        c, nxt = self.c, self.ahead()
        if c == ";":
            self.p += 1
        elif c == "G":
            self.group("block")
        elif c == "@":
            self.decorators()
            self.statement()
        elif c in VARS and c != "\0" and (c != W["let"] or nxt in NAME + "[G"):
            self.p += 1
            if self.ts and c == W["const"] and self.c == W["enum"]:
                return self.enum()
            self.declarators()
            self.close()
        elif c == W["function"] or c == W["async"] and nxt == W["function"] and self.p + 1 not in self.lines:
            self.function(True)
        elif c == W["class"]:
            self.klass(True)
        elif c == W["if"]:
            self.p += 1
            self.paren()
            self.statement()
            if self.take(W["else"]):
                self.statement()
        elif c == W["for"]:
            self.loop()
        elif c in (W["while"], W["with"]):
            self.p += 1
            self.paren()
            self.statement()
        elif c == W["do"]:
            self.p += 1
            self.statement()
            self.need(W["while"])
            self.paren()
            self.take(";")
        elif c == W["switch"]:
            self.p += 1
            self.paren()
            self.group("switch")
        elif c == W["try"]:
            self.p += 1
            self.group("block")
            caught = self.take(W["catch"])
            if caught:
                if self.take("("):
                    self.binding()
                    self.annotation()
                    self.need(")")
                self.group("block")
            if self.take(W["finally"]):
                self.group("block")
            elif not caught:
                raise Bad
        elif c == W["return"]:
            self.p += 1
            if not (self.end or self.c == ";" or self.p in self.lines):
                self.expression()
            self.close()
        elif c == W["throw"]:
            self.p += 1
            if self.p in self.lines:
                raise Bad
            self.expression()
            self.close()
        elif c in (W["break"], W["continue"]):
            self.p += 1
            if self.p not in self.lines:
                self.take(NAME)
            self.close()
        elif c == W["debugger"]:
            self.p += 1
            self.close()
        elif c == W["import"] and nxt not in "(.":
            self.imports()
        elif c == W["export"]:
            self.exports()
        elif c in NAME and nxt == ":":
            self.p += 2
            self.statement()
        elif self.ts and c in CONTEXTUAL + W["enum"] and self.attempt(self.ts_statement):
            pass
        else:
            self.expression()
            self.close()

    def ts_statement(self) -> None:
        c, nxt = self.c, self.ahead()
        same = self.p + 1 not in self.lines
        if c == W["interface"] and nxt in NAME and same:
            self.p += 2
            self.type_parameters()
            if self.take(W["extends"]):
                self.type_list()
            self.group("type")
        elif c == W["type"] and nxt in NAME and same:
            self.p += 2
            self.type_parameters()
            self.need("=")
            self.type()
            self.close()
        elif c == W["enum"]:
            self.enum()
        elif c in (W["namespace"], W["module"]) and nxt in NAME + "s" and same:
            self.p += 2
            while self.take("."):
                self.need(NAME)
            if not (self.c == "G"):
                self.close()
            else:
                self.group("block")
        elif c == W["global"] and nxt == "G":
            self.p += 1
            self.group("block")
        elif c == W["abstract"] and nxt == W["class"]:
            self.p += 1
            self.klass(True)
        elif c == W["declare"] and same and nxt not in ".=(,;)\0":
            self.p += 1
            self.statement()
        else:
            raise Bad

    def enum(self) -> None:
        self.need(W["enum"])
        self.need(NAME)
        self.group("enum")

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def loop(self) -> None:
        self.p += 1
        self.take(W["await"])
        self.need("(")
        if self.c in VARS and self.c != "\0" and (self.c != W["let"] or self.ahead() in NAME + "[G"):
            self.p += 1
            self.binding()
            self.annotation()
            if self.take(W["of"] + W["in"]):
                self.expression()
                self.need(")")
                return self.statement()
            if self.take("="):
                self.assign()
            if self.take(","):
                self.declarators()
        elif self.c != "f":
            at, n = self.p, len(self.roles)
            self.no_in = True
            try:
                self.postfix()
                ok = self.take(W["of"] + W["in"])
            except Bad:
                ok = False
            self.no_in = False
            if ok:
                self.expression()
                self.need(")")
                return self.statement()
            self.p = at
            del self.roles[n:]
            self.expression()
        for last in ("f", ")"):
            self.need("f")
            if self.c != last:
                self.expression()
            if last == ")":
                self.need(")")
        self.statement()

    def declarators(self) -> None:
        while True:
            self.binding()
            if self.ts:
                self.take("!")
            self.annotation()
            if self.take("="):
                self.assign()
            if not self.take(","):
                return

    def imports(self) -> None:
        self.p += 1
        if not self.take("s"):
            if self.ts and self.c == W["type"] and self.ahead() in NAME + "G*" and not (self.ahead() == W["from"] and self.ahead(2) == "s"):
                self.p += 1
            if self.take(NAME):
                if self.ts and self.take("="):
                    self.expression()
                    return self.close()
                more = self.take(",")
            else:
                more = True
            if more:
                if self.take("*"):
                    self.need(W["as"])
                    self.need(NAME)
                else:
                    self.group("specs")
            self.need(W["from"])
            self.need("s")
        if self.take(W["with"]):
            self.group("object")
        self.close()

    def exports(self) -> None:
        self.p += 1
        c, nxt = self.c, self.ahead()
        if self.take(W["default"]):
            c, nxt = self.c, self.ahead()
            if c == W["function"] or c == W["async"] and nxt == W["function"]:
                self.function(False)
            elif c == W["class"]:
                self.klass(False)
            elif self.ts and c in (W["abstract"], W["interface"]) and nxt in NAME + W["class"]:
                self.statement()
            else:
                self.assign()
                self.close()
        elif self.take("*"):
            if self.take(W["as"]):
                self.need(ANY_NAME + "s")
            self.need(W["from"])
            self.need("s")
            self.close()
        elif c == "G" or self.ts and c == W["type"] and nxt in "G*":
            self.take(W["type"])
            if self.take("*"):
                self.need(W["from"])
                self.need("s")
                return self.close()
            self.group("specs")
            if self.take(W["from"]):
                self.need("s")
            self.close()
        elif self.ts and self.take("="):
            self.expression()
            self.close()
        elif self.ts and c == W["as"] and nxt == W["namespace"]:
            self.p += 2
            self.need(NAME)
            self.close()
        elif c in VARS + W["function"] + W["class"] + "@" or c == W["async"] and nxt == W["function"] or self.ts and c in W["import"] + W["enum"] + "".join(W[w] for w in "interface type namespace module declare abstract".split()):
            self.statement()
        else:
            raise Bad

    def decorators(self) -> None:
        while self.take("@"):
            self.postfix()

    def function(self, named: bool) -> None:
        self.take(W["async"])
        self.need(W["function"])
        self.take("*")
        if not self.take(NAME) and named:
            raise Bad
        self.signature()
        if self.c == "G":
            self.group("block")
        elif self.ts:
            self.close()
        else:
            raise Bad

    def signature(self) -> None:
        self.type_parameters()
        self.parameters()
        self.annotation()

    def klass(self, named: bool) -> None:
        self.need(W["class"])
        if not (self.c in (W["implements"], W["extends"]) and self.ahead() != "G") and not self.take(NAME) and named:
            raise Bad
        self.type_parameters()
        if self.take(W["extends"]):
            self.postfix()
            if self.ts and self.c == "<":
                self.type_arguments()
        if self.ts and self.take(W["implements"]):
            self.type_list()
        self.group("class")

    def parameters(self) -> None:
        self.need("(")
        while not self.take(")"):
            self.decorators()
            if self.ts:
                while self.c in ACCESS and self.ahead() in NAME + "[G":
                    self.p += 1
            rest = self.take("e")
            if not (self.ts and self.take("j")):
                self.binding()
            if self.ts:
                self.take("?")
            self.annotation()
            if not rest and self.take("="):
                self.assign()
            if not self.take(","):
                self.need(")")
                return

    def binding(self) -> None:
        if self.c == "G":
            self.group("pattern")
        elif self.take("["):
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("e")
                self.binding()
                if self.take("="):
                    self.assign()
                if self.c != "]":
                    self.need(",")
        else:
            self.need(NAME)

    # ------------------------------------------------------------------------------------------------ expressions
    def expression(self) -> None:
        self.assign()
        while self.take(","):
            self.assign()

    def body(self) -> None:
        if self.c == "G":
            self.group("block")
        else:
            self.assign()

    def arrow(self) -> None:
        if self.ts:
            self.type_parameters()
        self.parameters()
        self.annotation()
        if self.p in self.lines:
            raise Bad
        self.need("a")

    def assign(self) -> None:
        c, nxt = self.c, self.ahead()
        if c in NAME and nxt == "a":
            self.p += 2
            return self.body()
        if c == W["async"] and self.p + 1 not in self.lines:
            if nxt in NAME and self.ahead(2) == "a":
                self.p += 3
                return self.body()
            if nxt in "(<":
                self.p += 1
                if self.attempt(self.arrow):
                    return self.body()
                self.p -= 1
        if (c == "(" or c == "<" and self.ts) and self.attempt(self.arrow):
            return self.body()
        if c == W["yield"] and nxt not in "=.":
            self.p += 1
            self.take("*")
            if not self.end and self.c not in ")],;:f\0" and self.p not in self.lines:
                self.assign()
            return None
        self.conditional()
        if self.c in "=A" and self.c != "\0":
            if not self.target:
                raise Bad
            self.p += 1
            self.assign()
            self.target = False
        return None

    def conditional(self) -> None:
        self.binary()
        if self.take("?"):
            self.assign()
            self.need(":")
            self.assign()
            self.target = False

    def binary(self) -> None:
        self.unary()
        while True:
            c = self.c
            if c == W["in"] and self.no_in:
                return
            if c in BINARY and c != "\0":
                self.p += 1
                while c == ">" and self.take(">"):
                    pass
                self.unary()
            elif self.ts and c in (W["as"], W["satisfies"]) and self.p not in self.lines:
                self.p += 1
                if not self.take(W["const"]):
                    self.type()
            else:
                return
            self.target = False

    def unary(self) -> None:
        c = self.c
        if c in UNARY and c != "\0":
            self.p += 1
            self.unary()
            self.target = False
        elif c == "p":
            self.p += 1
            self.unary()
            if not self.target:
                raise Bad
            self.target = False
        elif c == W["await"] and self.ahead() not in ".=,;:)]?oA*a\0":
            self.p += 1
            self.unary()
            self.target = False
        elif c == "<" and self.ts and self.attempt(self.type_arguments):
            self.unary()
        else:
            self.postfix()
            if self.c == "p" and self.p not in self.lines:
                if not self.target:
                    raise Bad
                self.p += 1
                self.target = False

    def postfix(self, calls: bool = True) -> None:
        self.primary()
        while True:
            c = self.c
            if c == "." or c == "q":
                self.p += 1
                if c == "q" and self.c in "([":
                    continue
                self.need(ANY_NAME)
                self.target = c == "."
            elif c == "[":
                self.p += 1
                self.inside(self.expression)
                self.need("]")
                self.target = True
            elif c == "(" and calls:
                self.arguments()
                self.target = False
            elif c == "t":
                self.template()
                self.target = False
            elif c == "!" and self.ts and self.p not in self.lines and self.ahead() not in NAME + "0s(G":
                self.p += 1
            elif c == "<" and self.ts and self.attempt(self.applied):
                self.target = False
            else:
                return

    def applied(self) -> None:
        """Type arguments that a call, a template or an end follows."""
        self.type_arguments()
        if self.c not in "(t),;].:}=" + "\0" and self.p not in self.lines:
            raise Bad

    def inside(self, rule) -> None:
        was, self.no_in = self.no_in, False
        rule()
        self.no_in = was

    def arguments(self) -> None:
        self.need("(")
        was, self.no_in = self.no_in, False
        while not self.take(")"):
            self.take("e")
            self.assign()
            if not self.take(","):
                self.need(")")
                break
        self.no_in = was

    def template(self) -> None:
        self.need("t")
        if self.c == "h":
            while self.take("h"):
                self.inside(self.expression)
                self.need("h")
            self.need("T")

    def primary(self) -> None:
        c, nxt = self.c, self.ahead()
        self.target = False
        if c == W["async"] and nxt == W["function"] and self.p + 1 not in self.lines or c == W["function"]:
            self.function(False)
        elif c in NAME:
            self.p += 1
            self.target = True
        elif c in "j0sr":
            self.p += 1
        elif c == "t":
            self.template()
        elif c == "(":
            self.p += 1
            self.inside(self.expression)
            self.need(")")
            self.target = True
        elif c == "[":
            self.p += 1
            was, self.no_in = self.no_in, False
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("e")
                self.assign()
                if self.c != "]":
                    self.need(",")
            self.no_in, self.target = was, True
        elif c == "G":
            self.group("object")
            self.target = True
        elif c == W["class"]:
            self.klass(False)
        elif c == W["new"]:
            self.p += 1
            if self.take("."):
                self.need(NAME)
                return
            self.postfix(calls=False)
            if self.ts and self.c == "<":
                self.attempt(self.type_arguments)
            if self.c == "(":
                self.arguments()
            self.target = False
        elif c == W["import"] and nxt in "(.":
            self.p += 1
        elif c == "@":
            self.decorators()
            self.klass(False)
        else:
            raise Bad

    # ------------------------------------------------------------------------------------------------------ types
    def annotation(self) -> None:
        if self.ts and self.take(":"):
            self.type()

    def type_list(self) -> None:
        self.type()
        while self.take(","):
            self.type()

    def type_parameters(self) -> None:
        if not self.ts or not self.take("<"):
            return
        while not self.take(">"):
            while self.c in W["const"] + W["in"] + W["out"] and self.ahead() in NAME:
                self.p += 1
            self.need(NAME)
            if self.take(W["extends"]):
                self.type()
            if self.take("="):
                self.type()
            if self.c != ">":
                self.need(",")

    def type_arguments(self) -> None:
        self.need("<")
        self.type_list()
        self.need(">")

    def function_type(self) -> None:
        self.take(W["abstract"])
        self.take(W["new"])
        self.type_parameters()
        self.parameters()
        self.need("a")

    def type(self) -> None:
        if self.c in "(<" + W["new"] + W["abstract"] and self.c != "\0" and self.attempt(self.function_type):
            return self.type()
        self.take("|&")
        while True:
            self.type_operand()
            if not self.take("|&"):
                break
        if self.c == W["extends"] and self.p not in self.lines:
            at, n = self.p, len(self.roles)
            self.p += 1
            self.type()
            if not self.take("?"):
                self.p = at
                del self.roles[n:]
                return None
            self.type()
            self.need(":")
            self.type()
        return None

    def type_operand(self) -> None:
        c, nxt = self.c, self.ahead()
        if c in W["keyof"] + W["unique"] + W["readonly"] and c != "\0" and nxt in ANY_NAME + "([G":
            self.p += 1
            return self.type_operand()
        if c == W["infer"] and nxt in NAME:
            self.p += 2
            return None
        if c == W["asserts"] and nxt in NAME + "j" and self.p + 1 not in self.lines:
            self.p += 2
            if self.take(W["is"]):
                self.type()
            return None
        if c in "(<" + W["new"] and c != "\0" and self.attempt(self.function_type):
            return self.type()
        if c in NAME + "j":
            self.p += 1
            if self.c == W["is"] and self.p not in self.lines:
                self.p += 1
                return self.type()
            while self.take("."):
                self.need(ANY_NAME)
            if self.c == "<" and self.p not in self.lines:
                self.type_arguments()
        elif c == W["void"]:
            self.p += 1
        elif c == W["typeof"]:
            self.p += 1
            if not self.take(W["import"]):
                self.need(NAME + "j")
            elif self.take("("):
                self.need("s")
                self.need(")")
            while self.take("."):
                self.need(ANY_NAME)
            if self.c == "<":
                self.type_arguments()
        elif c == W["import"]:
            self.p += 1
            self.need("(")
            self.need("s")
            self.need(")")
            while self.take("."):
                self.need(ANY_NAME)
            if self.c == "<":
                self.type_arguments()
        elif c in "s0":
            self.p += 1
        elif c == "m" and nxt == "0":
            self.p += 2
        elif c == "t":
            self.p += 1
            if self.c == "h":
                while self.take("h"):
                    self.type()
                    self.need("h")
                self.need("T")
        elif c == "G":
            self.group("type")
        elif c == "(":
            self.p += 1
            self.type()
            self.need(")")
        elif c == "[":
            self.p += 1
            while not self.take("]"):
                self.take("e")
                if self.c in NAME and (self.ahead() == ":" or self.ahead() == "?" and self.ahead(2) == ":"):
                    self.p += 1
                    self.take("?")
                    self.need(":")
                self.type()
                self.take("?")
                if self.c != "]":
                    self.need(",")
        else:
            raise Bad
        while self.c == "[" and self.p not in self.lines:
            self.p += 1
            if not self.take("]"):
                self.type()
                self.need("]")
        return None

    # ------------------------------------------------------------------------------------------------ brace bodies
    def key(self) -> None:
        if self.take("["):
            self.assign()
            self.need("]")
        else:
            self.need(ANY_NAME + "s0")

    def method(self) -> None:
        self.signature()
        if self.c == "G":
            self.group("block")
        elif not self.ts or not (self.take(";") or self.end or self.p in self.lines):
            raise Bad

    def object(self) -> None:
        while not self.end:
            if self.take("e"):
                self.assign()
            else:
                while self.c in W["async"] + W["get"] + W["set"] + "*" and self.ahead() not in "(,:=<\0":
                    self.p += 1
                short = self.c in NAME
                self.key()
                if self.c in "(<":
                    self.signature()
                    self.group("block")
                elif self.take(":"):
                    self.assign()
                elif not short:
                    raise Bad
                elif self.take("="):
                    self.assign()
            if not self.end:
                self.need(",")

    def pattern(self) -> None:
        while not self.end:
            if self.take("e"):
                self.binding()
            else:
                short = self.c in NAME
                self.key()
                if self.take(":"):
                    self.binding()
                elif not short:
                    raise Bad
                if self.take("="):
                    self.assign()
            if not self.end:
                self.need(",")

    def specs(self) -> None:
        while not self.end:
            if self.ts and self.c == W["type"] and self.ahead() in ANY_NAME + "s" and self.ahead() != W["as"]:
                self.p += 1
            self.need(ANY_NAME + "s")
            if self.take(W["as"]):
                self.need(ANY_NAME + "s")
            if not self.end:
                self.need(",")

    def enum_body(self) -> None:
        while not self.end:
            self.key()
            if self.take("="):
                self.assign()
            if not self.end:
                self.need(",")

    def members(self) -> None:
        while not self.end:
            if self.take(";"):
                continue
            self.decorators()
            if self.c == W["static"] and self.ahead() == "G":
                self.p += 1
                self.group("block")
                continue
            while self.c in MODIFIERS and self.c != "\0" and self.ahead() not in "(=;:?!<\0" and (self.p + 1 not in self.lines or self.c == "*"):
                self.p += 1
            if self.ts and self.c == "[" and self.ahead() in NAME and self.ahead(2) == ":":
                self.index_signature()
                self.close()
                continue
            self.key()
            if self.ts:
                self.take("?!")
            if self.c in "(<":
                self.method()
            else:
                self.annotation()
                if self.take("="):
                    self.assign()
                self.close()

    def index_signature(self) -> None:
        self.need("[")
        self.need(NAME)
        self.need(":")
        self.type()
        self.need("]")
        self.take("?")
        self.need(":")
        self.type()

    def type_members(self) -> None:
        while not self.end:
            if self.take(";,"):
                continue
            if self.take("m") and self.c not in W["readonly"]:
                raise Bad
            while self.c in W["readonly"] + W["get"] + W["set"] and self.ahead() not in "(:?;,<\0" and self.p + 1 not in self.lines:
                self.p += 1
            if self.c in "(<":
                self.signature()
            elif self.c == W["new"] and self.ahead() in "(<":
                self.p += 1
                self.signature()
            elif self.c == "[" and self.ahead() in NAME and self.ahead(2) == ":":
                self.index_signature()
            elif self.c == "[" and self.ahead() in NAME and self.ahead(2) == W["in"]:
                self.p += 3
                self.type()
                if self.take(W["as"]):
                    self.type()
                self.need("]")
                self.take("m")
                self.take("?")
                self.annotation()
            else:
                self.key()
                self.take("?")
                if self.c in "(<":
                    self.signature()
                else:
                    self.annotation()
            if not (self.take(";,") or self.end or self.p in self.lines):
                raise Bad

    def clauses(self) -> None:
        """Statements among the labels of a switch."""
        while not self.end:
            if self.take(W["case"]):
                self.expression()
                self.need(":")
            elif self.c == W["default"]:
                self.p += 1
                self.need(":")
            else:
                self.statement()


_RULES = {"block": JS.statements, "file": JS.statements, "class": JS.members, "switch": JS.clauses, "type": JS.type_members, "object": JS.object, "pattern": JS.pattern, "specs": JS.specs, "enum": JS.enum_body}


@remembered
def parse(piece: str, role: str, ts: bool):
    parser = JS(piece, ts)
    try:
        _RULES[role](parser)
    except Bad:
        return None
    return tuple(parser.roles) if parser.end else None


# a decorator, a label or a head without its statement waits for the next line
_WAITS = re.compile(rf"(?:^|n)(?:@[^G]*|[{W['if']}{W['for']}{W['while']}][^G;]*\)|{W['else']}{W['if']}[^G;]*\)|.*{W['else']})$")


def pieces_of(content: str, role: str) -> list[str]:
    if role in LISTS:
        flat = content.replace("n", "")
        return [flat] if flat else []
    out: list[str] = []
    wait = ""
    for piece in _SPLIT.split(content):
        if wait:
            piece = wait + "n" + piece
            wait = ""
        if not piece or piece == "n" or not piece.strip("n"):
            continue
        if (piece[0] == "@" or piece[-1] == ")") and role != "type" and _WAITS.search(piece):
            wait = piece
        else:
            out.append(piece)
    if wait:
        out.append(wait)
    return out


def valid(text: str, ts: bool) -> bool:
    kinds = js_kinds(text)
    if "X" in kinds:
        return False
    node = structure(kinds)
    return node is not None and judge(node, "file", pieces_of, lambda piece, role: parse(piece, role, ts))
