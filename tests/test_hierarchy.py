import random

import pytest
from pyspark.sql import functions as F

from quern.operators import hierarchy


def brute(pairs):
    ids = {i for i, _ in pairs if i is not None}
    parent = {}
    for i in ids:
        known = [p for j, p in pairs if j == i and p and p in ids]
        parent[i] = min(known) if known else None
    out = {}
    for i in ids:
        path, seen, x = [], set(), i
        while x is not None and x not in seen:
            seen.add(x)
            path.append(x)
            x = parent[x]
        out[i] = None if x is not None else path[::-1]
    return out


def check(spark, pairs):
    rows = spark.createDataFrame(pairs, "id string, parent_id string")
    want = brute(pairs)
    got = {r["id"]: r for r in hierarchy.resolve(rows, paths=True).collect()}
    assert got.keys() == want.keys()
    for i, path in want.items():
        assert got[i]["path"] == path
        assert got[i]["endless"] == (path is None)
        assert got[i]["depth"] == (None if path is None else len(path) - 1)
        assert got[i]["root"] == (None if path is None else path[0])
    plain = {r["id"]: (r["root"], r["depth"], r["endless"]) for r in hierarchy.resolve(rows).collect()}
    assert plain == {i: (g["root"], g["depth"], g["endless"]) for i, g in got.items()}


def test_long_chain_cycles_and_stars(spark):
    chain = [(f"c{i:03}", f"c{i - 1:03}" if i else None) for i in range(60)]
    cycle = [(f"y{i}", f"y{(i + 1) % 7}") for i in range(7)] + [("below", "y3"), ("deeper", "below"), ("self", "self"), ("two-a", "two-b"), ("two-b", "two-a")]
    star = [("hub", None)] + [(f"s{i}", "hub") for i in range(200)]
    check(spark, chain + cycle + star)


def test_dirty_links(spark):
    check(spark, [("a", ""), ("b", None), ("c", "nowhere"), ("d", "a"), ("d", "a"), ("e", "zz"), ("e", "b"), ("e", "a"), (None, "a"), ("f", "d"), ("f", "")])


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_with_cycles(spark, seed):
    r = random.Random(seed)
    n = 120
    check(spark, [(f"n{i}", r.choice([None, f"n{r.randrange(n)}", f"n{max(0, i - 1)}"])) for i in range(n)])


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "id string, parent_id string, c long, p long, root string, depth int")
    assert hierarchy.resolve(empty, paths=True).count() == 0
    rows = spark.createDataFrame([("a", None, 1, 2, "x", 3), ("b", "a", 1, 2, "x", 3)], empty.schema)
    assert sorted((r["id"], r["depth"]) for r in hierarchy.resolve(rows).collect()) == [("a", 0), ("b", 1)]


def test_descendants_invert_paths(spark):
    rows = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("c", "a"), ("x", "x")], "id string, parent_id string")
    got = {(r["ancestor"], r["descendant"], r["distance"]) for r in hierarchy.descendants(hierarchy.resolve(rows, paths=True)).collect()}
    assert got == {("r", "a", 1), ("r", "b", 2), ("r", "c", 2), ("a", "b", 1), ("a", "c", 1)}


def test_numbers_as_ids(spark):
    rows = spark.range(5).select("id", (F.col("id") - 1).alias("parent_id"))
    assert hierarchy.resolve(rows).agg(F.max("depth")).first()[0] == 4
