"""Documents as ordered trees: parsing, rendering, flat rows, selection, deltas. Plain Python on one document at a time.

A node is a dict with ``type`` and, where they apply, ``label``, ``value``, ``level``, ``ordered`` and ``children``.
"""

from __future__ import annotations

import copy
import difflib
import json
import re

from quern.functions.text import safe_regex

_HEADING = re.compile(r"^(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$")
_ITEM = re.compile(r"^([ \t]*)([-*+]|\d{1,9}[.)])[ \t]+(.*)$")
_FENCE = re.compile(r"^(```+|~~~+)[ \t]*(.*)$")
_RULE = re.compile(r"^[ \t]{0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")


def _plain(text: str) -> str:
    """Inline marks off."""
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    return re.sub(r"(`+)(.+?)\1|\*\*(.+?)\*\*|__(.+?)__|\*(.+?)\*", lambda m: next(g for g in m.groups()[1:] if g is not None), text).strip()


def parse_markdown(text: str) -> dict:
    """Sections nest by heading level; lists nest by indent."""
    root: dict = {"type": "document", "children": []}
    open_: list[dict] = [root]
    lines = text.replace("\r\n", "\n").split("\n")
    i = 0
    while i < len(lines):
        line = lines[i]
        here = open_[-1]["children"]
        if not line.strip():
            i += 1
        elif m := _FENCE.match(line):
            j = next((k for k in range(i + 1, len(lines)) if lines[k].startswith(m[1]) and not lines[k].strip(m[1][0])), len(lines))
            node = {"type": "code-block", "value": "\n".join(lines[i + 1 : j])}
            if m[2].strip():
                node["label"] = m[2].strip()
            here.append(node)
            i = j + 1
        elif m := _HEADING.match(line):
            level = len(m[1])
            while len(open_) > 1 and open_[-1]["level"] >= level:
                open_.pop()
            node = {"type": "section", "label": _plain(m[2]), "level": level, "children": []}
            open_[-1]["children"].append(node)
            open_.append(node)
            i += 1
        elif _RULE.match(line):
            here.append({"type": "thematic-break"})
            i += 1
        elif line.startswith(">"):
            j = i
            while j < len(lines) and lines[j].startswith(">"):
                j += 1
            here.append({"type": "paragraph", "value": "\n".join(re.sub(r"^>[ \t]?", "", x) for x in lines[i:j])})
            i = j
        elif _ITEM.match(line):
            node, i = _list(lines, i, len(_ITEM.match(line)[1].expandtabs(4)))
            here.append(node)
        else:
            j = i
            while j < len(lines) and lines[j].strip() and (j == i or not (_HEADING.match(lines[j]) or _FENCE.match(lines[j]) or _ITEM.match(lines[j]) or _RULE.match(lines[j]))):
                j += 1
            here.append({"type": "paragraph", "value": _plain(" ".join(x.strip() for x in lines[i:j]))})
            i = j
    return root


def _list(lines: list[str], i: int, indent: int) -> tuple[dict, int]:
    ordered = lines[i].strip()[0].isdigit()
    node: dict = {"type": "list", "ordered": ordered, "children": []}
    while i < len(lines):
        m = _ITEM.match(lines[i])
        if not m:
            if lines[i].strip() and lines[i].startswith((" ", "\t")) and node["children"]:
                node["children"][-1]["label"] += " " + _plain(lines[i])
                i += 1
                continue
            if not lines[i].strip() and i + 1 < len(lines) and (n := _ITEM.match(lines[i + 1])) and len(n[1].expandtabs(4)) >= indent and n[2][0].isdigit() == ordered:
                i += 1
                continue
            break
        depth = len(m[1].expandtabs(4))
        if depth < indent or depth == indent and m[2][0].isdigit() != ordered:
            break
        if depth > indent + 1 and node["children"]:
            inner, i = _list(lines, i, depth)
            node["children"][-1].setdefault("children", []).append(inner)
            continue
        node["children"].append({"type": "list-item", "label": _plain(m[3])})
        i += 1
    return node, i


def parse_plain(text: str) -> dict:
    parts = [p for p in text.replace("\r\n", "\n").split("\n\n") if p.strip()]
    return {"type": "document", "children": [{"type": "paragraph", "children": [{"type": "line", "value": x} for x in p.split("\n")]} for p in parts]}


def _value_tree(value, names: tuple[str, str, str, str]) -> dict:
    mapping, pair, sequence, item = names
    wrap = lambda node, v: node | ({"children": [_value_tree(v, names)]} if isinstance(v, dict | list) else {"value": v})
    if isinstance(value, dict):
        return {"type": mapping, "children": [wrap({"type": pair, "label": str(k)}, v) for k, v in value.items()]}
    if isinstance(value, list):
        return {"type": sequence, "children": [wrap({"type": item}, v) for v in value]}
    return {"type": "scalar", "value": value}


def parse_json(text: str) -> dict:
    return {"type": "document", "children": [_value_tree(json.loads(text), ("object", "property", "array", "array-item"))] if text.strip() else []}


def parse_yaml(text: str) -> dict:
    import yaml

    value = yaml.safe_load(text)
    return {"type": "document", "children": [] if value is None else [_value_tree(value, ("mapping", "pair", "sequence", "sequence-item"))]}


PARSERS = {"markdown": parse_markdown, "plaintext": parse_plain, "json": parse_json, "yaml": parse_yaml}


def parse(text: str, form: str) -> dict:
    if form not in PARSERS:
        raise ValueError(f"no parser for {form}")
    return PARSERS[form](text)


def _to_value(node: dict):
    kids = node.get("children", [])
    if node["type"] in ("object", "mapping"):
        return {k["label"]: _to_value(k["children"][0]) if k.get("children") else k.get("value") for k in kids}
    if node["type"] in ("array", "sequence"):
        return [_to_value(k["children"][0]) if k.get("children") else k.get("value") for k in kids]
    return node.get("value")


def render(node: dict, form: str = "markdown") -> str:
    """The text of a tree or of part of one."""
    if form in ("json", "yaml"):
        inner = node["children"][0] if node["type"] == "document" and node["children"] else node
        value = _to_value(inner)
        if form == "json":
            return json.dumps(value, indent=2, ensure_ascii=False)
        import yaml

        return yaml.safe_dump(value, sort_keys=False, allow_unicode=True).rstrip("\n")
    return "\n\n".join(_blocks(node))


def _blocks(node: dict) -> list[str]:
    kind, kids = node["type"], node.get("children", [])
    if kind == "section":
        return ["#" * node["level"] + " " + node["label"]] + [b for k in kids for b in _blocks(k)]
    if kind == "code-block":
        return [f"```{node.get('label', '')}\n{node.get('value', '')}\n```"]
    if kind == "thematic-break":
        return ["---"]
    if kind in ("list", "list-item"):
        return ["\n".join(_items(node if kind == "list" else {"children": [node], "ordered": False}, 0))]
    if kind == "line":
        return [str(node.get("value", ""))]
    if kind == "paragraph":
        return ["\n".join(str(k.get("value", "")) for k in kids) if kids else str(node.get("value", ""))]
    return [b for k in kids for b in _blocks(k)]


def _items(node: dict, depth: int) -> list[str]:
    out = []
    for n, item in enumerate(node["children"], 1):
        out.append("  " * depth + (f"{n}. " if node.get("ordered") else "- ") + item.get("label", ""))
        for inner in item.get("children", []):
            out += _items(inner, depth + 1)
    return out


def flatten(root: dict) -> list[tuple]:
    """(path, parent_path, ancestors' types, type, label, value, value_type, level, ordered, ord) in pre-order; paths compare as arrays."""
    out: list[tuple] = []

    def visit(node: dict, path: list[int], types: list[str]) -> None:
        value = node.get("value")
        kind = None if "value" not in node else {bool: "boolean", int: "number", float: "number", str: "string"}.get(type(value), "null")
        shown = None if value is None else json.dumps(value) if not isinstance(value, str) else value
        out.append((path, path[:-1] if path else None, types, node["type"], node.get("label"), shown, kind, node.get("level"), node.get("ordered"), len(out)))
        for k, child in enumerate(node.get("children", [])):
            visit(child, [*path, k], [*types, node["type"]])

    visit(root, [], [])
    return out


# ---------------------------------------------------------------------------------------------------- selection, JSONPath
def _test(pattern: str | None, text) -> bool:
    safe = safe_regex(pattern)
    return safe is not None and re.search(safe, "" if text is None else str(text), re.IGNORECASE) is not None


def node_matches(node: dict, selector: dict, ancestors: list[dict]) -> bool:
    if node["type"] != selector["type"]:
        return False
    if "matches" in selector and not _test(selector["matches"], node.get("label")):
        return False
    if "contains" in selector:
        text = node.get("value") or "\n".join(str(c.get("value", "")) for c in node.get("children", []))
        if not _test(selector["contains"], text):
            return False
    if "level" in selector and node.get("level") != selector["level"]:
        return False
    kids = node.get("children", [])
    fields = kids[0].get("children", kids) if kids else []
    for key, pattern in selector.get("where", {}).items():
        field = next((f for f in fields if f.get("label") == key), None)
        if field is None or not _test(pattern, field.get("value")):
            return False
    if "parent" in selector:
        near = next((a for a in reversed(ancestors) if a["type"] == selector["parent"]["type"]), None)
        return near is not None and node_matches(near, selector["parent"], [])
    return True


def find(root: dict, selector: dict) -> list[tuple[dict, list[dict]]]:
    """Matching nodes in pre-order, each with its ancestors; ``index`` picks one."""
    out: list[tuple[dict, list[dict]]] = []

    def visit(node: dict, above: list[dict]) -> None:
        if node_matches(node, selector, above):
            out.append((node, above))
        for child in node.get("children", []):
            visit(child, [*above, node])

    visit(root, [])
    if "index" in selector:
        return out[selector["index"] : selector["index"] + 1] if selector["index"] >= 0 else []
    return out


def json_path(value, path: str) -> list:
    """Values at ``$``, ``.f``, ``..f``, ``[*]`` and ``[n]`` of a parsed document."""
    here = [value]
    for deep, name, index in re.findall(r"(\.\.)?\.?([A-Za-z_][\w-]*)?(?:\[(\*|\d+)\])?", path.removeprefix("$")):
        if deep:
            pool, here = here, []
            while pool:
                x = pool.pop(0)
                if isinstance(x, dict) and name in x:
                    here.append(x[name])
                pool = (list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []) + pool
        elif name:
            here = [x[name] for x in here if isinstance(x, dict) and name in x]
        if index == "*":
            here = [y for x in here for y in (x if isinstance(x, list) else x.values() if isinstance(x, dict) else [])]
        elif index:
            here = [x[int(index)] for x in here if isinstance(x, list) and int(index) < len(x)]
    return here


# ------------------------------------------------------------------------------------------------------------------ deltas
class DeltaError(ValueError):
    pass


def _only(root: dict, selector: dict) -> tuple[dict, list[dict]]:
    found = find(root, selector)
    if len(found) != 1:
        raise DeltaError(f"{len(found)} nodes match {json.dumps(selector)}")
    return found[0]


def _content(entry: dict, form: str) -> list[dict]:
    if "content" in entry:
        return parse(entry["content"], form)["children"]
    value = entry.get("value")
    return [{"type": "paragraph", "value": value}] if form in ("markdown", "plaintext") else [_value_tree(value, ("mapping", "pair", "sequence", "sequence-item") if form == "yaml" else ("object", "property", "array", "array-item"))]


def _unwrapped(parent: dict, nodes: list[dict]) -> list[dict]:
    """The children of parsed content that is of the same collection as where it goes."""
    return nodes[0]["children"] if nodes and parent["type"] in ("list", "array", "sequence", "object", "mapping") and nodes[0]["type"] == parent["type"] else nodes


def apply_delta(root: dict, entries: list[dict], form: str = "markdown") -> dict:
    """The tree after the entries, in order. Each selector must meet exactly one node of the original tree; one node is changed once."""
    touched: set[int] = set()
    for entry in entries:
        if entry["op"] in ("modified", "removed"):
            node, _ = _only(root, entry["selector"])
            if id(node) in touched:
                raise DeltaError("two entries change one node")
            touched.add(id(node))
    root = copy.deepcopy(root)
    for entry in entries:
        op = entry["op"]
        if op == "no-op":
            continue
        if op == "added":
            place = entry.get("position", {})
            sibling = place.get("before") or place.get("after")
            if sibling:
                node, above = _only(root, sibling)
                parent = above[-1]
                at = next(k for k, c in enumerate(parent["children"]) if c is node) + ("after" in place)
            else:
                parent = _only(root, place["parent"])[0] if "parent" in place else root
                at = 0 if place.get("first") else len(parent.setdefault("children", []))
            parent["children"][at:at] = _unwrapped(parent, _content(entry, form))
            continue
        node, above = _only(root, entry["selector"])
        if op == "removed":
            above[-1]["children"] = [c for c in above[-1]["children"] if c is not node]
            continue
        if "rename" in entry:
            node["label"] = entry["rename"]
        if "content" not in entry and "value" not in entry:
            continue
        how = entry.get("strategy", "replace")
        if "content" not in entry and how == "replace" and not isinstance(entry["value"], dict | list):
            node.pop("children", None)
            node["value"] = entry["value"]
            continue
        target = node["children"][0] if node.get("children") and node["type"] in ("property", "pair") else node
        new = _unwrapped(target, _content(entry, form))
        if how == "append":
            target.setdefault("children", []).extend(new)
        elif how == "merge-by":
            target["children"] = merge_by(target.get("children", []), new, entry["mergeKey"])
        else:
            target.pop("value", None)
            target["children"] = new
    return root


def _field(node: dict, key: str):
    kids = node.get("children", [])
    fields = kids[0].get("children", kids) if kids else []
    return next((f.get("value") for f in fields if f.get("label") == key), node.get("label"))


def merge_by(old: list[dict], new: list[dict], key: str) -> list[dict]:
    """A keyed full join: base order, replaced where the key comes again, then the new keys."""
    by = {_field(n, key): n for n in new}
    out = [by.pop(_field(n, key), n) for n in old]
    return out + [n for k, n in by.items()]


# ---------------------------------------------------------------------------------------------------- text of documents
def summary(text: str) -> str | None:
    """The paragraph after the first-level heading, else the first of Overview, Summary or Purpose."""
    lines = text.split("\n")

    def paragraph(i: int) -> str | None:
        while i < len(lines) and not lines[i].strip():
            i += 1
        out = []
        while i < len(lines) and lines[i].strip() and not lines[i].startswith("#"):
            out.append(lines[i].strip())
            i += 1
        return " ".join(out) or None

    first = next((i for i, x in enumerate(lines) if re.match(r"# .+", x)), None)
    found = paragraph(first + 1) if first is not None else None
    for i, line in enumerate(lines):
        if not found and re.match(r"## (Overview|Summary|Purpose)\s*$", line):
            found = paragraph(i + 1)
    return found


def shift_headings(text: str, by: int) -> str:
    """Heading levels moved, within 1 and 6; fenced code is left alone."""
    out, fence = [], ""
    for line in text.split("\n"):
        m = re.match(r"^(```+|~~~+)", line)
        if m and (not fence or m[1].startswith(fence)):
            fence = "" if fence else m[1]
        h = None if fence else re.match(r"^(#{1,6})(\s)", line)
        out.append("#" * min(6, max(1, len(h[1]) + by)) + line[len(h[1]) :] if h else line)
    return "\n".join(out)


def unified_diff(a: str, b: str, name: str = "file", context: int = 3) -> str:
    return "\n".join(difflib.unified_diff(a.split("\n"), b.split("\n"), f"a/{name}", f"b/{name}", lineterm="", n=context))


def resolve_link(base: str, link: str) -> str | None:
    """A relative link against the folder of ``base`` (``workspace:path``); None where it leaves the workspace or is no path."""
    if re.match(r"^[a-z][a-z0-9+.-]*://|^#|^mailto:", link):
        return None
    workspace, _, path = base.rpartition(":")
    parts = [] if link.startswith("/") else path.split("/")[:-1]
    for part in link.split("#")[0].split("?")[0].split("/"):
        if part == "..":
            if not parts:
                return None
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    return f"{workspace}:{'/'.join(parts)}" if workspace else "/".join(parts)


def snippet(text: str, tokens: list[str], size: int = 32) -> str:
    """About ``size`` words around the first token, with dots where text is left out."""
    words = text.split()
    hit = next((i for i, w in enumerate(words) if any(t in w.lower() for t in tokens)), 0)
    start = max(0, min(hit - size // 2, len(words) - size))
    return ("..." if start else "") + " ".join(words[start : start + size]) + ("..." if start + size < len(words) else "")


def line_range(text: str, excerpt: str) -> tuple[int, int]:
    """First and last line of an excerpt's first part in the text; 1 and 1 where it is not found."""
    part = next((p for p in excerpt.split("...") if p.strip()), "")
    at = text.find(part) if part else -1
    if at < 0:
        return 1, 1
    first = text.count("\n", 0, at) + 1
    return first, first + part.count("\n")
