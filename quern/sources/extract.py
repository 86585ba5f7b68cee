"""Declarations, imports, calls and base types from source text, and their resolution to edges by joins.

An extractor reads one file's text, with comments and strings blanked so that places keep, and gives rows; what a row
means across files is settled by equi-joins on names and paths. A file that cannot be read gives an error row.
"""

from __future__ import annotations

import ast
import bisect
import re
import warnings

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.events import enclosing
from quern.sources.files import LANGUAGES

_BLANK = {
    "c": re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\[\s\S])*`"),
    "php": re.compile(r"//[^\n]*|#(?!\[)[^\n]*|/\*[\s\S]*?\*/|'(?:[^'\\]|\\[\s\S])*'|\"(?:[^\"\\]|\\[\s\S])*\""),
}
_ID = r"[A-Za-z_$][\w$]*"
_TS = [
    ("class", re.compile(rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({_ID})", re.M)), ("interface", re.compile(rf"^[ \t]*(?:export\s+)?(?:declare\s+)?interface\s+({_ID})", re.M)), ("enum", re.compile(rf"^[ \t]*(?:export\s+)?(?:const\s+)?enum\s+({_ID})", re.M)),
    ("type", re.compile(rf"^[ \t]*(?:export\s+)?type\s+({_ID})\s*(?:<[^=]*>)?\s*=", re.M)), ("function", re.compile(rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({_ID})", re.M)),
    ("function", re.compile(rf"^[ \t]*(?:export\s+)?(?:const|let|var)\s+({_ID})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)]*\)\s*(?::[^=\n]+)?|{_ID}\s*)=>", re.M)), ("variable", re.compile(rf"^(?:export\s+)?(?:const|let|var)\s+({_ID})\s*(?::[^=\n]+)?=(?!\s*(?:async\s*)?(?:\([^)]*\)\s*(?::[^=\n]+)?|{_ID}\s*)=>)", re.M)),
    ("method", re.compile(rf"^[ \t]+(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*(?!(?:if|for|while|switch|catch|return|function|throw|new|else|do)\b)({_ID})\s*(?:<[^>\n]*>)?\([^)\n]*\)\s*(?::\s*[^{{;\n]+)?\{{", re.M)),
]
_GO = [("function", re.compile(r"^func\s+([A-Za-z_]\w*)\s*[\[(]", re.M)), ("method", re.compile(r"^func\s+\([^)]*\)\s*([A-Za-z_]\w*)\s*\(", re.M)), ("interface", re.compile(r"^type\s+([A-Za-z_]\w*)\s+interface\b", re.M)), ("class", re.compile(r"^type\s+([A-Za-z_]\w*)\s+struct\b", re.M)), ("type", re.compile(r"^type\s+([A-Za-z_]\w*)\s+(?!struct\b|interface\b)", re.M)), ("variable", re.compile(r"^(?:const|var)\s+([A-Za-z_]\w*)", re.M))]
_PHP = [("class", re.compile(r"^[ \t]*(?:(?:final|abstract|readonly)\s+)*class\s+(\w+)", re.M)), ("interface", re.compile(r"^[ \t]*interface\s+(\w+)", re.M)), ("class", re.compile(r"^[ \t]*trait\s+(\w+)", re.M)), ("enum", re.compile(r"^[ \t]*enum\s+(\w+)", re.M)), ("method", re.compile(r"(?:^|[{};])\s*(?:(?:public|private|protected|static|final|abstract)\s+)+function\s+&?(\w+)", re.M)), ("function", re.compile(r"(?:^|[{};])[ \t]*function\s+&?(\w+)", re.M)), ("variable", re.compile(r"^const\s+(\w+)\s*=", re.M))]
_RULES = {"typescript": _TS, "tsx": _TS, "javascript": _TS, "jsx": _TS, "go": _GO, "php": _PHP}
_TS_IMPORT = re.compile(rf"^[ \t]*import\s+(type\s+)?(?:({_ID})\s*,?\s*)?(?:\*\s*as\s+({_ID})\s*)?(?:\{{([^}}]*)\}}\s*)?(?:from\s*)?['\"]([^'\"\n]+)['\"]|\brequire\(\s*['\"]([^'\"\n]+)['\"]\s*\)|\bimport\(\s*['\"]([^'\"\n]+)['\"]\s*\)", re.M)
_CALL = re.compile(rf"\bnew\s+({_ID})\s*(?:<[^>\n]*>)?\(|\b({_ID})\s*(?:\?\.|\.|->|::)\s*({_ID})\s*\(|(?<![\w$.>:])({_ID})\s*\(")
_NOT_CALLS = set("if for while switch catch function return typeof await super import require constructor foreach elseif match isset empty array list echo print func defer go range select def class with assert lambda and or not in is del yield raise except".split())


def blank(text: str, language: str) -> str:
    """The text with comments and strings as blanks; line ends stay."""
    return _BLANK["php" if language == "php" else "c"].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _at(breaks: list[int], i: int) -> tuple[int, int]:
    line = bisect.bisect_left(breaks, i)
    return line + 1, i - (breaks[line - 1] + 1 if line else 0)


def facts(text: str, language: str) -> list[tuple]:
    """Rows (fact, name, kind, target, receiver, line, column): symbol, import, call, base and export facts of a file.

    The receiver of an import or export is the name it has in the file it comes from, or goes out by."""
    if language == "python":
        return _python(text)
    code = blank(text, language)
    breaks = [m.start() for m in re.finditer("\n", text)]
    out, seen = [], set()
    for kind, rule in _RULES[language]:
        for m in rule.finditer(code):
            if m.start(1) not in seen:
                seen.add(m.start(1))
                out.append(("symbol", m[1], kind, None, None, *_at(breaks, m.start(1))))
    if language == "go":
        for m in re.finditer(r"^import\s+(?:\(([^)]*)\)|.*)$", text, re.M):
            for p in re.finditer(r"(?:([\w.]+)\s+)?\"([^\"\n]+)\"", m[0]):
                out.append(("import", p[1] or p[2].rsplit("/", 1)[-1], "blank" if p[1] == "_" else "namespace", p[2], None, *_at(breaks, m.start() + p.start())))
    elif language == "php":
        for m in re.finditer(r"^[ \t]*use\s+([\w\\]+)(?:\s+as\s+(\w+))?\s*;", code, re.M):
            out.append(("import", m[2] or m[1].rsplit("\\", 1)[-1], "named", m[1], m[1].rsplit("\\", 1)[-1], *_at(breaks, m.start(1))))
        for m in re.finditer(r"\b(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"\n]+)['\"]", text):
            out.append(("import", None, "require", m[1], None, *_at(breaks, m.start())))
    else:
        for m in _TS_IMPORT.finditer(text):
            where = _at(breaks, m.start())
            if m[6] or m[7]:
                out.append(("import", None, "require" if m[6] else "dynamic", m[6] or m[7], None, *where))
                continue
            if m[2]:
                out.append(("import", m[2], "default", m[5], "default", *where))
            if m[3]:
                out.append(("import", m[3], "namespace", m[5], None, *where))
            for part in filter(None, (p.strip() for p in (m[4] or "").split(","))):
                one = re.sub(r"^type\s+", "", part).split(" as ")
                out.append(("import", one[-1].strip(), "named", m[5], one[0].strip(), *where))
            if not (m[2] or m[3] or m[4]):
                out.append(("import", None, "side-effect", m[5], None, *where))
    for m in _CALL.finditer(code):
        name = m[1] or m[3] or m[4]
        if name in _NOT_CALLS or m[2] in _NOT_CALLS or re.search(r"\b(?:function|func|def)\s*&?\s*$", code[max(0, m.start() - 12) : m.start()]) or m.start(4) in seen:
            continue
        form = "constructor" if m[1] or m[2] and re.search(r"\bnew\s+$", code[max(0, m.start() - 8) : m.start()]) else ("static" if m[2][0].isupper() else "member") if m[2] else "free"
        before = re.search(r"(?:\.|->|::|\$)\s*$", code[max(0, m.start() - 8) : m.start()]) if m[2] and not (language == "php" and m[2] == "this") else None
        # a property of something, or a PHP variable, is no name that a file declares or imports: marked by what stands before it
        out.append(("call", name, form, None, (before[0].strip() if before else "") + m[2] if m[2] else None, *_at(breaks, m.start())))
    for m in re.finditer(rf"\b(?:class|interface)\s+({_ID})[^{{\n]*?\bextends\s+({_ID}(?:\s*,\s*{_ID})*)", code):
        out += [("base", m[1], "EXTENDS", b.strip(), None, *_at(breaks, m.start(1))) for b in m[2].split(",")]
    for m in re.finditer(rf"\bclass\s+({_ID})[^{{\n]*?\bimplements\s+({_ID}(?:\s*,\s*{_ID})*)", code):
        out += [("base", m[1], "IMPLEMENTS", b.strip(), None, *_at(breaks, m.start(1))) for b in m[2].split(",")]
    if _RULES[language] is _TS:
        for m in re.finditer(rf"^[ \t]*export\s+default\s+(?:(?:abstract\s+)?class\s+|(?:async\s+)?function\s*\*?\s*)?({_ID})", code, re.M):
            out.append(("export", m[1], "default", None, "default", *_at(breaks, m.start(1))))
        for m in re.finditer(r"^[ \t]*export\s*\{([^}]*)\}(?!\s*from\b)", code, re.M):
            for one in (re.sub(r"^type\s+", "", x.strip()).split(" as ") for x in m[1].split(",") if " as " in x):
                out.append(("export", one[0].strip(), "named", None, one[-1].strip(), *_at(breaks, m.start())))
    return out


def _python(text: str) -> list[tuple]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text.removeprefix("﻿"))
    out: list[tuple] = []

    def visit(node, inside: bool, top: bool) -> None:
        for child in ast.iter_child_nodes(node):
            where = (getattr(child, "lineno", 0), getattr(child, "col_offset", 0))
            if isinstance(child, ast.ClassDef):
                out.append(("symbol", child.name, "class", None, None, *where))
                out.extend(("base", child.name, "EXTENDS", ast.unparse(b), None, *where) for b in child.bases)
                visit(child, True, False)
                continue
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                out.append(("symbol", child.name, "method" if inside else "function", None, None, *where))
                visit(child, False, False)
                continue
            if isinstance(child, ast.Import):
                out.extend(("import", a.asname or a.name.split(".")[0], "namespace", a.name, None, *where) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                out.extend(("import", a.asname or a.name, "named", "." * child.level + (child.module or ""), a.name, *where) for a in child.names)
            elif isinstance(child, ast.Assign) and top:
                out.extend(("symbol", t.id, "variable", None, None, *where) for t in child.targets if isinstance(t, ast.Name))
            elif isinstance(child, ast.Call):
                f = child.func
                if isinstance(f, ast.Name):
                    out.append(("call", f.id, "constructor" if f.id[:1].isupper() else "free", None, None, *where))
                elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
                    out.append(("call", f.attr, "static" if f.value.id[:1].isupper() else "member", None, f.value.id, *where))
            visit(child, inside and not isinstance(child, ast.stmt), top and isinstance(node, ast.Module) and False)

    visit(tree, False, True)
    return out


def _read(batches):
    cols = ["path", "fact", "name", "kind", "target", "receiver", "line", "column", "error"]
    for pdf in batches:
        rows = []
        for path, language, text in zip(pdf["path"], pdf["language"], pdf["content"], strict=True):
            try:
                rows += [(path, *fact, None) for fact in dict.fromkeys(facts(text, language))]
            except Exception as error:
                rows.append((path, "error", None, None, None, None, 0, 0, str(error)[:200]))
        yield pd.DataFrame(rows, columns=cols)


def analysed(files: DataFrame) -> DataFrame:
    """All facts of all files with a known ending: path, fact (symbol, import, call, base, export, error), name, kind, target, receiver, line, column, error."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    src = files.where("path is not null and content is not null").select("path", known[F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))].alias("language"), "content").where("language is not null")
    return src.mapInPandas(_read, "path string, fact string, name string, kind string, target string, receiver string, line int, column int, error string")


def symbols(found: DataFrame) -> DataFrame:
    s = found.where("fact = 'symbol'")
    return s.select(F.concat_ws(":", "path", "kind", "name", "line", "column").alias("id"), "name", "kind", F.col("path").alias("file_path"), "line", F.col("column").alias("column_number"))


def _tried(found: DataFrame) -> DataFrame:
    """(source, target, n, candidate): the paths an import could mean, in order."""
    rel = found.where("fact = 'import' and (target like '.%' or kind = 'require' and lower(path) like '%.php' and target not like '/%')").select("path", "target").distinct()
    python = F.col("path").rlike(r"\.pyi?$")
    dots = F.length(F.regexp_extract("target", r"^(\.+)", 1))
    body = F.regexp_replace("target", r"^\.+", "")
    spec = F.when(python, F.concat(F.repeat(F.lit("../"), (dots - 1).cast("int")), F.translate(body, ".", "/"))).otherwise(F.col("target"))
    folder = F.regexp_replace(F.substring_index("path", ":", -1), r"/?[^/]*$", "")
    joined = F.filter(F.split(F.concat_ws("/", folder, spec), "/"), lambda p: ~p.isin("", "."))
    walked = F.aggregate(joined, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    base = F.concat(F.substring_index("path", ":", 1), F.lit(":"), F.array_join(walked, "/"))
    stem = F.regexp_replace(base, r"\.jsx?$", "")
    ends = F.when(python, F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit(".pyi")), F.concat(base, F.lit("/__init__.py")))).otherwise(F.array(base, F.concat(stem, F.lit(".ts")), F.concat(stem, F.lit(".tsx")), F.concat(stem, F.lit(".js")), F.concat(stem, F.lit("/index.ts")), F.concat(stem, F.lit("/index.js"))))
    return rel.select(F.col("path").alias("source"), "target", F.posexplode(ends).alias("n", "candidate"))


def import_edges(found: DataFrame, paths: DataFrame) -> DataFrame:
    """IMPORTS edges (source, target): relative specifiers, and files that PHP requires, against the importing file, endings tried in order, the first that exists wins."""
    met = _tried(found).join(paths.select(F.col("path").alias("candidate")).distinct(), "candidate")
    return met.groupBy("source", "target").agg(F.min_by("candidate", "n").alias("found")).select("source", F.col("found").alias("target")).distinct()


#: What a receiver may be that is declared in the file itself, and words for the object at hand.
_TYPES = ["class", "interface", "enum", "type"]
_OWN = ["this", "self", "cls", "static"]


def _unique(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows whose target is the only one of their keys."""
    return rows.groupBy(*keys).agg(F.min("target").alias("target"), F.max("target").alias("_hi")).where("target = _hi").drop("_hi")


def _bound(found: DataFrame, imports: DataFrame) -> DataFrame:
    """Import facts with the file they resolve to: (file_path, name, kind, original, file)."""
    met = _tried(found).join(imports.select("source", F.col("target").alias("candidate")).distinct(), ["source", "candidate"])
    where = met.groupBy("source", "target").agg(F.min_by("candidate", "n").alias("file"))
    facts = found.where("fact = 'import'").select(F.col("path").alias("source"), "target", "name", "kind", F.col("receiver").alias("original"))
    return facts.join(where, ["source", "target"]).select(F.col("source").alias("file_path"), "name", "kind", "original", "file").distinct()


def _names(found: DataFrame, bound: DataFrame) -> DataFrame:
    """What a name stands for in a file: (file_path, name, target, rank), one row a name.

    First what is imported by that name, met by its original name, the first declaration there; then the only local symbol;
    then the only one of the files taken in whole (``*``, require). Defaults and renamed exports go by their export facts.
    """
    syms = symbols(found)
    tops = syms.where("kind <> 'method'").select(F.col("file_path").alias("file"), "name", "id", "line", "column_number")
    out = found.where("fact = 'export'").select(F.col("path").alias("file"), "name", F.col("receiver").alias("original"))
    offered = tops.withColumn("original", F.col("name")).unionByName(tops.join(out, ["file", "name"]))
    offered = offered.groupBy("file", "original").agg(F.min_by("id", F.struct("line", "column_number", "id")).alias("target"))
    whole = F.col("kind").isin("require", "dynamic") | (F.coalesce("original", F.lit("")) == "*")
    by_name = bound.where(~whole & F.col("name").isNotNull() & F.col("original").isNotNull()).join(offered, ["file", "original"])
    taken = bound.where(whole).select("file_path", "file").join(tops.select("file", "name", F.col("id").alias("target")), "file")
    ranked = [_unique(by_name, "file_path", "name"), _unique(syms.withColumn("target", F.col("id")), "file_path", "name"), _unique(taken, "file_path", "name")]
    every = ranked[0].withColumn("rank", F.lit(0))
    for rank in (1, 2):
        every = every.unionByName(ranked[rank].withColumn("rank", F.lit(rank)))
    return every.groupBy("file_path", "name").agg(F.min_by(F.struct("target", "rank"), "rank").alias("r")).select("file_path", "name", "r.*")


def _receivers(found: DataFrame, bound: DataFrame, names: DataFrame) -> DataFrame:
    """(file_path, receiver, file): the file whose symbols a receiver's members are; only where it is one."""
    spaces = bound.where("kind = 'namespace'").select("file_path", F.col("name").alias("receiver"), F.col("file").alias("target"))
    kinds = symbols(found).select(F.col("id").alias("target"), "kind", F.col("file_path").alias("file"))
    things = names.join(kinds, "target").where((F.col("rank") == 0) | F.col("kind").isin(_TYPES)).select("file_path", F.col("name").alias("receiver"), F.col("file").alias("target"))
    return _unique(spaces.unionByName(things), "file_path", "receiver").withColumnRenamed("target", "file")


def call_edges(found: DataFrame, imports: DataFrame) -> DataFrame:
    """CALLS and CONSTRUCTS edges (source, target, type): from the enclosing symbol to what the name stands for in the file.

    ``imports`` is (source, target) of files. A call with a receiver goes to the only symbol of that name in the file of what
    the receiver names: a type, an imported name, an imported file or the object at hand. Variables' types are binding facts
    and not known here. Ambiguous names and calls on themselves give nothing.
    """
    syms = symbols(found)
    calls = found.where("fact = 'call'").select(F.col("path").alias("file_path"), "line", "name", "receiver", F.when(F.col("kind") == "constructor", "CONSTRUCTS").otherwise("CALLS").alias("type")).distinct()
    bound = _bound(found, imports)
    names = _names(found, bound)
    plain = calls.where("receiver is null").join(names.select("file_path", "name", "target"), ["file_path", "name"])
    own = calls.where(F.col("receiver").isin(_OWN)).withColumn("file", F.col("file_path"))
    other = calls.where(~F.col("receiver").isin(_OWN)).join(_receivers(found, bound, names), ["file_path", "receiver"])
    members = _unique(syms.select(F.col("file_path").alias("file"), "name", F.col("id").alias("target")), "file", "name")
    sent = own.unionByName(other.select(*own.columns)).join(members, ["file", "name"])
    # few calls resolve: only those look for the symbol around them
    every = plain.select("file_path", "line", "target", "type").unionByName(sent.select("file_path", "line", "target", "type")).distinct()
    placed = enclosing(every, syms.where("kind in ('function', 'method', 'class')"))
    return placed.where("enclosing_id <> target").select(F.col("enclosing_id").alias("source"), "target", "type").distinct()


def base_edges(found: DataFrame, imports: DataFrame) -> DataFrame:
    """EXTENDS and IMPLEMENTS edges (source, target, type) from a type to the type its base names in the file."""
    syms, bound = symbols(found), _bound(found, imports)
    names = _names(found, bound)
    name = F.regexp_replace("target", r"\[[\s\S]*$", "")  # type arguments
    base = found.where("fact = 'base'").select(F.col("path").alias("file_path"), F.col("name").alias("_own"), "line", F.col("column").alias("column_number"), F.col("kind").alias("type"), F.substring_index(name, ".", -1).alias("name"), F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).alias("receiver"))
    base = base.join(syms.select("file_path", F.col("name").alias("_own"), "line", "column_number", F.col("id").alias("source")), ["file_path", "_own", "line", "column_number"])
    kinds = syms.where(F.col("kind").isin(_TYPES)).select(F.col("id").alias("target"))
    plain = base.where("receiver is null").join(names, ["file_path", "name"]).select("source", "target", "type")
    members = _unique(syms.where(F.col("kind").isin(_TYPES)).select(F.col("file_path").alias("file"), "name", F.col("id").alias("target")), "file", "name")
    far = base.where("receiver is not null").join(_receivers(found, bound, names), ["file_path", "receiver"]).join(members, ["file", "name"]).select("source", "target", "type")
    return plain.unionByName(far).join(kinds, "target", "left_semi").where("source <> target").select("source", "target", "type").distinct()
