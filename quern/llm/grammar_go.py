"""Go: declarations, statements, expressions and types over kinds."""

from __future__ import annotations

from quern.llm.grammar import Bad, Parser, judge, remembered
from quern.llm.lexing import GO_WORDS, go_kinds, structure

W = GO_WORDS
BINARY = "o*m|&<^q"
UNARY = "m!^*&q~"
TYPE_START = "i*[(q" + "".join(W[w] for w in ("map", "chan", "func", "struct", "interface"))


class Go(Parser):
    def __init__(self, text: str):
        super().__init__(text)
        self.header = False  # a brace after an operand opens the block, not a literal
        self.no_type: set[int] = set()  # brackets known to begin no type: each is tried once

    def mode(self):
        return self.header

    def statements(self) -> None:
        while not self.end:
            if not self.take(";"):
                self.statement()

    def file(self) -> None:
        while not self.end:
            if self.take(";"):
                continue
            c = self.c
            if c == W["package"]:
                self.p += 1
                self.need("i")
            elif c == W["import"]:
                self.p += 1
                self.grouped(self.imported)
            elif c == W["func"]:
                self.p += 1
                if self.c == "(":
                    self.parameters()
                self.need("i")
                if self.c == "[":
                    self.parameters("[", "]")
                self.signature()
                if self.c == "G":
                    self.group("block")
            elif c in W["var"] + W["const"] + W["type"] and c != "\0":
                self.declaration()
            else:
                raise Bad
            if not self.end:
                self.need(";")

    def imported(self) -> None:
        self.take("i.")
        self.need("s")

    def grouped(self, rule) -> None:
        if self.take("("):
            while not self.take(")"):
                rule()
                if self.c != ")":
                    self.need("f")
        else:
            rule()

    def declaration(self) -> None:
        c = self.c
        self.p += 1
        self.grouped(self.type_spec if c == W["type"] else self.value_spec)

    def type_spec(self) -> None:
        self.need("i")
        if self.c == "[" and self.ahead() == "i" and self.ahead(2) not in "]\0" and self.attempt(lambda: self.parameters("[", "]")):
            pass
        self.take("=")
        self.type()

    def value_spec(self) -> None:
        self.need("i")
        while self.take(","):
            self.need("i")
        if self.c in TYPE_START and self.c != "\0":
            self.type()
        if self.take("="):
            self.expressions()

    def simple(self) -> None:
        self.expressions()
        if self.take("p"):
            return
        if self.take("d=A"):
            if self.c == W["range"]:
                self.p += 1
                self.expression()
            else:
                self.expressions()

    def in_header(self, rule) -> None:
        was, self.header = self.header, True
        rule()
        self.header = was

    def free(self, rule) -> None:
        was, self.header = self.header, False
        rule()
        self.header = was

    def head(self, parts: int) -> None:
        """Simple statements between semicolons before a block."""
        while parts and self.c != "G":
            if self.c != ";":
                self.simple()
            parts -= 1
            if self.c == "G":
                return
            self.need(";")

    def statement(self) -> None:
        c = self.c
        if c == "G":
            self.group("block")
        elif c in W["var"] + W["const"] + W["type"] and c != "\0":
            self.declaration()
        elif c == W["return"]:
            self.p += 1
            if not self.end and self.c != ";":
                self.expressions()
        elif c == W["if"]:
            self.p += 1
            if self.c == "G":
                raise Bad
            self.in_header(lambda: self.head(2))
            self.group("block")
            if self.take(W["else"]):
                if self.c == W["if"]:
                    return self.statement()
                self.group("block")
        elif c == W["for"]:
            self.p += 1
            if self.take(W["range"]):
                self.in_header(self.expression)
            else:
                self.in_header(lambda: self.head(3))
            self.group("block")
        elif c == W["switch"]:
            self.p += 1
            self.in_header(lambda: self.head(2))
            self.group("switch")
        elif c == W["select"]:
            self.p += 1
            self.group("switch")
        elif c in W["go"] + W["defer"] and c != "\0":
            self.p += 1
            self.expression()
        elif c in W["break"] + W["continue"] and c != "\0":
            self.p += 1
            self.take("i")
        elif c == W["goto"]:
            self.p += 1
            self.need("i")
        elif c == W["fallthrough"]:
            self.p += 1
        elif c == "i" and self.ahead() == ":":
            self.p += 2
            if not self.end:
                self.statement()
            return None
        else:
            self.simple()
        if not self.end:
            self.need(";")
        return None

    def clauses(self) -> None:
        while not self.end:
            if self.take(W["case"]):
                self.clause()
                self.need(":")
            elif self.c == W["default"]:
                self.p += 1
                self.need(":")
            elif not self.take(";"):
                self.statement()

    def clause(self) -> None:
        def types():
            self.type()
            while self.take(","):
                self.type()
            if self.c != ":":
                raise Bad

        if not self.attempt(types):
            self.simple()

    # ------------------------------------------------------------------------------------------------ expressions
    def expressions(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def expression(self) -> None:
        self.unary()
        while self.c in BINARY and self.c != "\0":
            self.p += 1
            self.unary()

    def unary(self) -> None:
        while self.c in UNARY and self.c != "\0":
            self.p += 1
        self.operand()
        while True:
            c = self.c
            if c == ".":
                self.p += 1
                if self.take("("):
                    if not self.take(W["type"]):
                        self.type()
                    self.need(")")
                else:
                    self.need("i")
            elif c == "[":
                self.p += 1
                self.free(self.index)
            elif c == "(":
                self.free(self.arguments)
            elif c == "G" and self.literal_ok and not self.header:
                self.group("literal")
                self.literal_ok = False
                continue
            else:
                return
            self.literal_ok = c in ".["

    def index(self) -> None:
        empty = True
        while not self.take("]"):
            if self.take(":,"):
                empty = False
                continue
            empty = False
            if not self.attempt(self.indexed):
                self.type()
        if empty:
            raise Bad

    def indexed(self) -> None:
        self.expression()
        if self.c not in ":],":
            raise Bad

    def arguments(self) -> None:
        self.need("(")
        while not self.take(")"):
            if not self.attempt(self.argument):
                self.type()
                if self.c not in ",)":
                    raise Bad
            if not self.take(","):
                self.need(")")
                return

    def argument(self) -> None:
        self.expression()
        self.take("e")
        if self.c not in ",)":
            raise Bad

    def operand(self) -> None:
        c = self.c
        self.literal_ok = False
        if c == "i":
            self.p += 1
            self.literal_ok = True
        elif c in "0s":
            self.p += 1
        elif c == "(":
            self.p += 1
            if not self.attempt(lambda: (self.free(self.expression), self.need(")"))):
                self.type()
                self.need(")")
        elif c == W["func"]:
            self.p += 1
            self.signature()
            if self.c == "G":
                self.group("block")
        elif c in "[" + W["map"] + W["chan"] + W["struct"] + W["interface"] and c != "\0":
            self.type()
            # a literal of a bracketed type is one even before a block
            if self.c == "G" and c in "[" + W["map"] + W["struct"]:
                self.group("literal")
            self.literal_ok = False
        else:
            raise Bad

    # ------------------------------------------------------------------------------------------------------ types
    def type(self) -> None:
        c = self.c
        if c == "i":
            self.p += 1
            if self.take("."):
                self.need("i")
            if self.c == "[" and self.ahead() != "]":
                self.attempt(self.type_arguments)
        elif c == "*":
            self.p += 1
            self.type()
        elif c == "[":
            self.p += 1
            if not self.take("]"):
                if not self.take("e"):
                    self.expression()
                self.need("]")
            self.type()
        elif c == W["map"]:
            self.p += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif c == "q":
            self.p += 1
            self.need(W["chan"])
            self.type()
        elif c == W["chan"]:
            self.p += 1
            self.take("q")
            self.type()
        elif c == W["func"]:
            self.p += 1
            self.signature()
        elif c == W["struct"]:
            self.p += 1
            self.group("struct")
        elif c == W["interface"]:
            self.p += 1
            self.group("interface")
        elif c == "(":
            at = self.p
            if at in self.no_type:
                raise Bad
            self.p += 1
            try:
                self.type()
                self.need(")")
            except Bad:
                self.no_type.add(at)
                raise
        else:
            raise Bad

    def type_arguments(self) -> None:
        self.need("[")
        self.type()
        while self.take(","):
            self.type()
        self.need("]")

    def signature(self) -> None:
        self.parameters()
        if self.c == "(":
            self.parameters()
        elif self.c in TYPE_START and self.c != "\0":
            self.type()

    def parameters(self, left: str = "(", right: str = ")") -> None:
        self.need(left)
        while not self.take(right):
            if not self.take("e"):
                self.constraint()
            if self.c not in "," + right:
                self.take("e")
                self.constraint()
            elif self.s[self.p - 1] == "e":
                self.constraint()
            if not self.take(","):
                self.need(right)
                return

    def constraint(self) -> None:
        self.take("~")
        self.type()
        while self.take("|"):
            self.take("~")
            self.type()

    # ------------------------------------------------------------------------------------------------ brace bodies
    def fields(self) -> None:
        while not self.end:
            if self.take(";"):
                continue
            if self.c == "*" or self.c == "i" and self.ahead() in "s.;\0":
                self.type()
            else:
                self.need("i")
                while self.take(","):
                    self.need("i")
                self.type()
            self.take("s")
            if not self.end:
                self.need(";")

    def methods(self) -> None:
        while not self.end:
            if self.take(";"):
                continue
            if self.c == "i" and self.ahead() == "(":
                self.p += 1
                self.signature()
            else:
                self.constraint()
            if not self.end:
                self.need(";")

    def literal(self) -> None:
        while not self.end:
            self.element()
            if self.take(":"):
                self.element()
            if not self.end:
                self.need(",")

    def element(self) -> None:
        if self.c == "G":
            self.group("literal")
        else:
            self.expression()


_RULES = {"block": Go.statements, "file": Go.file, "switch": Go.clauses, "struct": Go.fields, "interface": Go.methods, "literal": Go.literal}


@remembered
def parse(piece: str, role: str):
    parser = Go(piece)
    try:
        _RULES[role](parser)
    except Bad:
        return None
    return tuple(parser.roles) if parser.end else None


def pieces_of(content: str, role: str) -> list[str]:
    if role == "literal":  # a line end here lacks its comma
        return ["X"] if "n" in content else [content] if content else []
    return [piece for piece in content.split("n") if piece]


def valid(text: str) -> bool:
    kinds = go_kinds(text)
    if "X" in kinds:
        return False
    if not kinds.strip("n"):
        return True
    # line ends stay inside round brackets, where only groups of declarations may have them
    node = structure(kinds.replace(",n", ","), drop_lines=False)
    if node is None:
        return False
    content, children = _unbracketed(node)
    pieces = [piece for piece in content.split("n") if piece]
    package, imports, rest = W["package"] + "i", W["import"], False
    if not pieces or pieces[0].rstrip(";") != package and not pieces[0].startswith(package + ";"):
        return False
    for piece in pieces[1:]:
        if piece[0] == W["package"] or piece[0] == imports and rest:
            return False
        rest = rest or piece[0] != imports
    return judge((content, children), "file", pieces_of, parse)


def _unbracketed(node):
    """Line ends inside round or square brackets become ``f``, as semicolons there are."""
    content, children = node
    if "n" in content and ("(" in content or "[" in content):
        out, depth = [], 0
        for c in content:
            depth += (c in "([") - (c in ")]")
            out.append("f" if c == "n" and depth else c)
        content = "".join(out)
    return content, [_unbracketed(child) for child in children]
