"""What the local grammars share.

A grammar sees one balanced statement (or list, or type body) as a string of kinds in which every brace group is a ``G``.
Parsing it gives the role of each group in order, or nothing where it is no sentence of the language; the groups are
then judged in their roles. Verdicts are kept by the string of kinds, so a statement of a known shape costs a lookup.
"""

from __future__ import annotations

from functools import lru_cache


class Bad(Exception):
    pass


class Parser:
    def __init__(self, text: str):
        flat, lines = [], set()
        if "n" in text:
            for c in text:
                if c == "n":
                    lines.add(len(flat))
                else:
                    flat.append(c)
            text = "".join(flat)
        self.s, self.lines, self.p, self.roles = text + "\0", lines, 0, []
        self.failed: set = set()  # what was attempted in vain, where and in which mode: backtracking never repeats it

    @property
    def c(self) -> str:
        return self.s[self.p]

    def ahead(self, n: int = 1) -> str:
        return self.s[min(self.p + n, len(self.s) - 1)]

    @property
    def end(self) -> bool:
        return self.p >= len(self.s) - 1

    def take(self, kinds: str) -> bool:
        """Take the next token if it is one of these kinds."""
        c = self.s[self.p]
        if c != "\0" and c in kinds:
            self.p += 1
            return True
        return False

    def need(self, kinds: str) -> None:
        if not self.take(kinds):
            raise Bad

    def group(self, role: str) -> None:
        self.need("G")
        self.roles.append(role)

    def mode(self):
        """What, besides the place, a rule's success depends on."""
        return None

    def attempt(self, rule) -> bool:
        at, n = self.p, len(self.roles)
        key = (at, getattr(rule, "__func__", None), self.mode())
        if key in self.failed:
            return False
        try:
            rule()
            return True
        except Bad:
            self.p = at
            del self.roles[n:]
            if key[1] is not None:
                self.failed.add(key)
            return False


def judge(node, role: str, pieces_of, parse) -> bool:
    """Whether the node, and all groups in it, are what their roles ask for.

    ``pieces_of(content, role)`` cuts a content into balanced statements; ``parse(piece, role)`` gives the roles of its
    groups or None. An explicit stack: nesting is not bounded by Python's.
    """
    todo = [(node, role)]
    while todo:
        (content, children), role = todo.pop()
        at = 0
        for piece in pieces_of(content, role):
            roles = parse(piece, role)
            if roles is None or len(roles) != piece.count("G"):
                return False
            for inner in roles:
                todo.append((children[at], inner))
                at += 1
    return True


def remembered(parse):
    """Short pieces are kept with their verdict."""
    keep = lru_cache(maxsize=100_000)(parse)
    return lambda piece, role, *more: keep(piece, role, *more) if len(piece) <= 400 else parse(piece, role, *more)
