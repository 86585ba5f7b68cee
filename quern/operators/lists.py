"""Ordered lists: offset and keyset pages, and what a page says about the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(rows: DataFrame, order: list[Column], limit: int | None = None, number: int | None = None, after: tuple | None = None, keys: tuple[str, str] | None = None) -> DataFrame:
    """Rows of one page of an ordered list.

    ``number`` (from 1) needs ``limit`` and excludes ``after``; ``after`` is the (key, id) of the last row seen, in ascending
    lists. Nothing is numbered: pages are ``offset`` and ``limit`` on a sort, or a filter before it.
    """
    if number is not None and (limit is None or after is not None):
        raise ValueError("a page number needs a limit and no cursor")
    if number is not None and number < 1 or limit is not None and limit < 1:
        raise ValueError("pages and limits count from 1")
    if after is not None:
        key, ident = keys
        rows = rows.where((F.col(key) > F.lit(after[0])) | ((F.col(key) == F.lit(after[0])) & (F.col(ident) > F.lit(after[1]))))
    out = rows.orderBy(*order)
    if number is not None:
        out = out.offset((number - 1) * limit)
    return out if limit is None else out.limit(limit)


def page_meta(rows: DataFrame, got: DataFrame, limit: int, number: int = 1) -> DataFrame:
    """total, count, limit, page and whether more follows, for a numbered page."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return total.join(F.broadcast(got.agg(F.count(F.lit(1)).alias("count")))).select("total", "count", F.lit(limit).alias("limit"), F.lit(number).alias("page"), (F.lit(number * limit) < F.col("total")).alias("more"))


def keyset_meta(rows: DataFrame, keys: tuple[str, str], limit: int, after: tuple | None = None) -> DataFrame:
    """total, count, limit, next_key and next_id of a page after a cursor; the next cursor is null where nothing follows.

    The page and one row more are taken in order, so what lies beyond is neither sorted whole nor counted.
    """
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    key, ident = keys
    ahead = page(rows.select(F.col(key).alias("key"), F.col(ident).alias("ident")), [F.col("key"), F.col("ident")], limit + 1, after=after, keys=("key", "ident"))
    last = F.when(F.count(F.lit(1)) > limit, F.element_at(F.sort_array(F.collect_list(F.struct("key", "ident"))), limit))
    return total.join(F.broadcast(ahead.agg(F.least(F.count(F.lit(1)), F.lit(limit)).alias("count"), last.alias("last")))).select("total", "count", F.lit(limit).alias("limit"), F.col("last.key").alias("next_key"), F.col("last.ident").alias("next_id"))


def active_order(state: str = "state", created: str = "created_at", at: str = "at", name: str = "name") -> list[Column]:
    """Active ones by creation; drafted and discarded ones by their time, the latest first; then by name."""
    closed = F.col(state).isin("drafted", "discarded")
    return [F.when(closed, None).otherwise(F.col(created)).asc_nulls_last(), F.when(closed, F.col(at)).desc(), F.col(name)]


def archive_order(at: str = "archived_at", name: str = "name") -> list[Column]:
    return [F.col(at).desc(), F.col(name)]


def affected_order() -> list[Column]:
    """Affected symbols by depth, path, line, name, id."""
    return [F.col(c) for c in ("depth", "file_path", "line", "name", "id")]


def check_limit(value: str | int | None, default: int = 100) -> int | None:
    """The limit a user gave: a number from 1, ``all`` for none, or the default."""
    if value is None:
        return default
    if value == "all":
        return None
    if not str(value).isdigit() or int(value) < 1:
        raise ValueError(f"not a limit: {value}")
    return int(value)


def preview_order(name: str = "filename") -> list[Column]:
    """``spec.md`` first, then by name."""
    return [F.when(F.col(name) == "spec.md", 0).otherwise(1), F.col(name)]


def first_keys(keys: Column, most: int = 10) -> Column:
    """The first keys, and how many more there are."""
    shown = F.array_join(F.slice(keys, 1, most), ", ")
    return F.when(F.size(keys) > most, F.concat(shown, F.lit(" and "), (F.size(keys) - most).cast("string"), F.lit(" more"))).otherwise(shown)
