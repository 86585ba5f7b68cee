"""Column functions on names, paths, globs, hashes and documents: all built-in expressions that stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where names are parted (case changes, then letters and digits), and what separates their parts.
CASE_BORDERS = [("([a-z0-9])([A-Z])", "$1 $2"), ("([A-Z]+)([A-Z][a-z])", "$1 $2")]
DIGIT_BORDERS = [("([A-Za-z])([0-9])", "$1 $2"), ("([0-9])([A-Za-z])", "$1 $2")]
INDEX_BORDERS = [("([a-z])([A-Z])", "$1 $2"), ("([A-Z]+)([A-Z][a-z])", "$1 $2")]
SEPARATORS = "[:/_.-]+"
_REGEX_SIGNS = ".^$+?()[]{}|\\"


def path_glob(pattern: str) -> str:
    """An anchored, case-sensitive expression; only the full stop is escaped, ``*`` is any text."""
    return "^" + pattern.replace(".", r"\.").replace("*", ".*") + "$"


def name_glob(pattern: str, case_sensitive: bool = False) -> str:
    return ("" if case_sensitive else "(?i)") + path_glob(pattern)


def exclude_glob(pattern: str) -> str:
    """All signs escaped, case ignored."""
    return "(?i)^" + "".join(".*" if c == "*" else "\\" + c if c in _REGEX_SIGNS else c for c in pattern) + "$"


def excluded(path: Column, workspace: Column, paths: list[str] = (), workspaces: list[str] = ()) -> Column:
    """Whether the workspace is listed or any glob matches the path."""
    out = workspace.isin(list(workspaces)) if workspaces else F.lit(False)
    for pattern in paths:
        out = out | path.rlike(exclude_glob(pattern))
    return F.coalesce(out, F.lit(False))


def safe_regex(pattern: str) -> str | None:
    """The pattern, or None (which never matches) where it is invalid or a repeated group repeats inside."""
    if re.search(r"\((?:[^()\\]|\\.)*[+*}](?:[^()\\]|\\.)*\)[+*{]", pattern):
        return None
    try:
        re.compile(pattern)
    except re.error:
        return None
    return pattern


def matches(value: Column, pattern: str) -> Column:
    safe = safe_regex(pattern)
    return F.lit(False) if safe is None else F.coalesce(value.rlike(safe), F.lit(False))


def split_words(name: Column) -> Column:
    """Array of the lower-case parts of a name at case changes, letter–digit borders and ``: / _ . -``."""
    x = name
    for pattern, put in CASE_BORDERS + DIGIT_BORDERS + [(SEPARATORS, " ")]:
        x = F.regexp_replace(x, pattern, put)
    x = F.trim(F.lower(x))
    return F.filter(F.split(x, r"\s+"), lambda p: p != "")


def expand_name(name: Column) -> Column:
    """The name, followed by its parts where it has more than one."""
    x = name
    for pattern, put in INDEX_BORDERS:
        x = F.regexp_replace(x, pattern, put)
    parts = F.trim(F.lower(F.translate(x, "_-", "  ")))
    return F.when(parts == F.lower(name), name).otherwise(F.concat(name, F.lit(" "), parts))


def components(identity: Column) -> Column:
    return F.concat(F.lit(" "), F.translate(identity, ":/_.-", "     "), F.lit(" "))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def normal_path(path: Column) -> Column:
    """Forward slashes, no leading ``./``."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(?:\./)+", "")


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def symbol_id(file_path: Column, kind: Column, name: Column, line: Column, column: Column) -> Column:
    return F.concat_ws(":", file_path, kind, name, line.cast("string"), column.cast("string"))


def under_prefix(path: Column, prefix: str) -> Column:
    """Equal to the prefix or below it as a folder."""
    return (path == prefix) | path.startswith(prefix.rstrip("/") + "/")


def stale(stored: Column, current: Column) -> Column:
    """True, false, or null where either is unknown."""
    return stored != current


def title(content: Column, fallback: Column) -> Column:
    """The text of the first first-level heading, or the fallback."""
    found = F.regexp_extract(content, r"(?m)^#[ \t]+([^\r\n]+?)[ \t]*\r?$", 1)
    return F.coalesce(F.nullif(found, F.lit("")), fallback)


def all_captures(text: Column, pattern: str, strip: str | None = None) -> Column:
    """All captures of the first group, after an optional removal."""
    src = F.regexp_replace(text, strip, "") if strip else text
    return F.regexp_extract_all(src, F.lit(pattern), F.lit(1))


def capture_or_all(text: Column, pattern: str) -> Column:
    """The first group, or the whole text where nothing matches."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text)


def expand_template(template: Column, values: dict[str, Column]) -> Column:
    """``{{key}}`` replaced for known keys; unknown ones stay."""
    out = template
    for key, value in values.items():
        out = F.replace(out, F.lit("{{" + key + "}}"), value)
    return out


def cleanup(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Replacements in order, line by line, before hashing."""
    for pattern, put in rules:
        text = F.regexp_replace(text, f"(?m){pattern}", put)
    return text


def normal_snippet(text: Column) -> Column:
    """Control sequences off, tabs as two blanks, right-trimmed, common indent off."""
    x = F.regexp_replace(F.regexp_replace(text, r"\x1B\[[0-9;]*[A-Za-z]", ""), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    lines = F.transform(F.split(F.replace(x, F.lit("\t"), F.lit("  ")), "\r?\n"), lambda s: F.rtrim(s))
    indent = F.array_min(F.transform(F.filter(lines, lambda s: s != ""), lambda s: F.length(s) - F.length(F.ltrim(s))))
    return F.array_join(F.transform(lines, lambda s: F.substring(s, F.coalesce(indent, F.lit(0)) + 1, F.greatest(F.length(s), F.lit(1)))), "\n")


def expand_query(query: str) -> tuple[str, list[str], list[str]]:
    """(normal query, raw tokens, tokens with their parts) of a query string, in order, without repeats."""
    raw = [t.lower() for t in query.split()]
    out: list[str] = []
    for token in raw:
        x = token  # lower case already: only digits and separators part it
        for pattern, put in DIGIT_BORDERS:
            x = re.sub(pattern, put.replace("$", "\\"), x)
        out += [token, *re.sub(SEPARATORS, " ", x).split()]
    return " ".join(raw), raw, list(dict.fromkeys(out))


def placeholders(template: Column, text: Column, pattern: str) -> Column:
    """``$0`` to ``$9`` in a template replaced by the groups of the first match; groups that are not there are empty, null where nothing matches."""
    out = template
    groups = re.compile(pattern).groups
    for k in range(9, -1, -1):
        out = F.replace(out, F.lit(f"${k}"), F.regexp_extract(text, pattern, k) if k <= groups else F.lit(""))
    return F.when(text.rlike(pattern), out)


def quoted(value: Column) -> Column:
    """A value in single quotes, as a shell takes it."""
    return F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def file_hashes(keys: Column, hashes: Column) -> Column:
    """One map of file to hash from two arrays of equal length."""
    return F.map_from_arrays(keys, hashes)
