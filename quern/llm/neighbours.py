"""The k most similar vectors of every vector.

A hierarchical k-means tree indexes every vector in one leaf of about ``LEAF_ROWS``, so leaves grow with the data. Its upper
part is fitted on a bounded sample and known everywhere; its ends are cells. A cell that holds more rows than a task
should is fitted further on a bounded sample of its own rows, again and again; the last level, from cells to leaves, is
fitted where the rows of a cell are, in the task that searches it.

A query walks the tree best bin first: nodes wait in a priority queue by the distance of their centre, so cells come in
the order of the largest distance on their way from the root; that order is computed for whole blocks of queries at
once, and within a cell the nearest leaves come first. How many cells, and how many leaves of each, a query visits is
calibrated: a stated set of queries is compared with all vectors, in blocks, and visits widen until the wanted share of
true neighbours lies in visited leaves.

Equal vectors form a class that is indexed once. Cells are bundled into groups of bounded size, cells that no centre can
part are cut, and the queries of a group come in blocks of bounded size, so no task grows with a dense region.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import Scratch


@dataclass(frozen=True)
class Sizes:
    """Bounds, all independent of the data; they set the size of tasks and of what the driver holds, not what is indexed."""

    fit_rows: int = 20_000  # rows that a part of the tree is fitted on
    cells: int = 1_024  # cells of the first fit at most; larger cells are fitted further
    leaf_rows: int = 96  # vectors aimed at in a leaf
    group_rows: int = 24_000  # members a task holds
    query_rows: int = 32_000  # queries a task holds
    calibration: int = 200  # queries compared with all rows for calibration


SIZES = Sizes()
#: The share of true neighbours that calibration asks for; recall over all vectors is to be 0.9 at least.
TARGET = 0.94
#: The weight of a cell's own distance in its key.
TIE = 1e-6
BRANCH = 16


@dataclass
class Tree:
    centres: np.ndarray  # of all nodes but the root
    parent: np.ndarray  # -1 below the root; parents come before their children
    leaf: np.ndarray  # number of the cell, or -1
    leaves: int
    levels: list = field(default_factory=list)  # nodes by depth, from 1

    def __post_init__(self):
        depth = np.zeros(len(self.parent), dtype=np.int64)
        for node, above in enumerate(self.parent):
            depth[node] = depth[above] + 1 if above >= 0 else 0
        self.levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)] if len(depth) else []
        self.kids = {}
        for node, above in enumerate(self.parent.tolist()):
            self.kids.setdefault(above, []).append(node)
        self.kids = {k: np.array(v) for k, v in self.kids.items()}
        self.node_of = np.empty(self.leaves, dtype=np.int64)
        self.node_of[self.leaf[self.leaf >= 0]] = np.flatnonzero(self.leaf >= 0)

    def order_keys(self, x: np.ndarray) -> np.ndarray:
        """For rows of ``x``, the key of each cell: the largest distance on the way to it, by which a priority queue pops it.

        Below a node that is farther than all its children the largest distance is the node's for all of them; the queue
        then pops the nearest first, so a cell's own distance parts such ties.
        """
        far = 1.0 - x @ self.centres.T
        own = far[:, self.node_of].astype(np.float64)
        for nodes in self.levels[1:]:
            far[:, nodes] = np.maximum(far[:, nodes], far[:, self.parent[nodes]])
        return far[:, self.node_of] + TIE * own

    def first(self, x: np.ndarray, most: int, dense: int = 4_096) -> np.ndarray:
        """The ``most`` cells of the least keys of each row, -1 where there are fewer.

        A tree of more than ``dense`` nodes is walked level by level with the ``8 * most`` best nodes of each, so the
        work of a query follows its visits and the depth, not the number of cells.
        """
        if len(self.parent) <= dense:
            keys = self.order_keys(x)
            if most >= keys.shape[1]:
                return np.tile(np.arange(keys.shape[1]), (len(x), 1))
            return np.argpartition(keys, most - 1, axis=1)[:, :most]
        row, node = np.repeat(np.arange(len(x)), len(self.kids[-1])), np.tile(self.kids[-1], len(x))
        key = (1.0 - x @ self.centres[self.kids[-1]].T).ravel()
        done = []  # (row, cell, key)
        while len(row):
            row, node, key = _least(row, node, key, 8 * most)
            end = self.leaf[node] >= 0
            done.append((row[end], self.leaf[node[end]], key[end]))
            row, node, key = row[~end], node[~end], key[~end]
            out = []
            for above in np.unique(node):
                here = node == above
                kids = self.kids[above]
                own = (1.0 - x[row[here]] @ self.centres[kids].T).astype(np.float64)
                far = np.maximum(own, key[here, None]) + TIE * own
                out.append((np.repeat(row[here], len(kids)), np.tile(kids, here.sum()), far.ravel()))
            row, node, key = map(np.concatenate, zip(*out, strict=True)) if out else (row, node, key)
        row, cell, key = _least(*map(np.concatenate, zip(*done, strict=True)), most)
        seen = np.full((len(x), most), -1)
        seen[row, _within(row)] = cell
        return seen

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row: at every node the nearest child."""
        out = np.full(len(x), -1)
        here = np.full(len(x), -1)
        while (open_rows := np.flatnonzero(out < 0)).size:
            for node in np.unique(here[open_rows]):
                rows = open_rows[here[open_rows] == node]
                kids = self.kids[node]
                best = kids[np.argmax(x[rows] @ self.centres[kids].T, axis=1)]
                here[rows] = best
                out[rows] = self.leaf[best]
        return out

    def refined(self, finer: dict[int, np.ndarray]) -> Tree:
        """The tree in which some cells have become nodes over the given centres."""
        centres, parent, leaf = [self.centres], [self.parent], self.leaf.copy()
        for cell, below in sorted(finer.items()):
            node = int(self.node_of[cell])
            leaf[node] = -1
            centres.append(below.astype(np.float32))
            parent.append(np.full(len(below), node))
        leaf = np.concatenate([leaf, *(np.zeros(len(p), dtype=leaf.dtype) for p in parent[1:])])
        leaf[leaf >= 0] = np.arange((leaf >= 0).sum())
        return Tree(np.concatenate(centres), np.concatenate(parent), leaf, int((leaf >= 0).sum()))


def _within(row: np.ndarray) -> np.ndarray:
    """The place of each among its equals, for sorted values."""
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.array([], dtype=np.int64)
    return np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))


def _least(row: np.ndarray, node: np.ndarray, key: np.ndarray, most: int):
    """Of each row the ``most`` of the least keys, sorted by row and key."""
    order = np.lexsort((key, row))
    row, node, key = row[order], node[order], key[order]
    keep = _within(row) < most
    return row[keep], node[keep], key[keep]


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length one; computed in double precision."""
    x = raw.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(8):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres)
    own = np.argmax(x @ centres.T, axis=1)
    used = np.unique(own)
    return centres[used], np.searchsorted(used, own)


def fit_tree(sample: np.ndarray, rows: int, sizes: Sizes = SIZES) -> Tree:
    """The first fit of a tree for ``rows`` vectors, from a sample of unit vectors."""
    rng = np.random.default_rng(11)
    wanted = int(min(sizes.cells, max(1, round(rows / sizes.leaf_rows))))
    centres: list[np.ndarray] = []
    parent: list[int] = []
    todo = [(-1, np.arange(len(sample)), wanted)]
    ends: set[int] = set()
    while todo:
        node, rows_in, leaves = todo.pop(0)
        k = min(BRANCH, leaves, len(rows_in))
        if k <= 1 and node >= 0:
            ends.add(node)
            continue
        c, own = _kmeans(sample[rows_in], max(1, k), rng)
        if len(c) == 1 and node >= 0:
            ends.add(node)
            continue
        for i in range(len(c)):
            inside = rows_in[own == i]
            centres.append(c[i])
            parent.append(node)
            share = int(round(leaves * len(inside) / len(rows_in)))
            todo.append((len(parent) - 1, inside, share)) if len(c) > 1 and share > 1 else ends.add(len(parent) - 1)
    leaf = np.full(len(parent), -1)
    for n, node in enumerate(sorted(ends)):
        leaf[node] = n
    return Tree(np.array(centres, dtype=np.float32), np.array(parent), leaf, len(ends))


def local_leaves(x: np.ndarray, cell: int, leaf_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The leaves of one cell, fitted on its own unit vectors: (centres, leaf of each row). The same rows give the same leaves."""
    k = max(1, round(len(x) / leaf_rows))
    if k == 1:
        return x[:1], np.zeros(len(x), dtype=np.int64)
    rng = np.random.default_rng(cell)
    some = x if len(x) <= 24 * k else x[np.sort(rng.choice(len(x), 24 * k, replace=False))]
    centres, _ = _kmeans(some, k, rng)
    return centres, np.argmax(x @ centres.T, axis=1)


def usable(files: DataFrame, dim: int = 64) -> DataFrame:
    """(path, vec) of files whose embedding is ``dim`` finite numbers, not all zero; each path once, with its smallest vector."""
    e = F.col("embedding").cast("array<float>")
    good = (F.size(e) == dim) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    return files.where(F.col("path").isNotNull() & F.coalesce(good, F.lit(False))).groupBy("path").agg(F.min(e).alias("vec"))


def _matrix(cells: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), dtype=np.float32).reshape(-1, dim)


def _to_bytes(batches):
    for pdf in batches:
        pdf["vec"] = [np.asarray(v, dtype=np.float32).tobytes() for v in pdf["vec"]]
        yield pdf


def _index(tree: Tree, dim: int):
    def run(batches):
        for pdf in batches:
            pdf["leaf"] = tree.assign(unit(_matrix(pdf["vec"], dim)).astype(np.float32)) if len(pdf) else []
            yield pdf

    return run


def _exact(queries: np.ndarray, ids: np.ndarray, dim: int, k: int):
    """The k best of each part for a stated set of queries."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            s = queries @ unit(_matrix(pdf["vec"], dim)).T
            cids = pdf["cid"].to_numpy()
            s[ids[:, None] == cids[None, :]] = -2
            top = np.argsort(-s, axis=1)[:, :k]
            rows = np.repeat(np.arange(len(ids)), top.shape[1])
            flat = top.ravel()
            yield pd.DataFrame({"q": ids[rows], "cid": cids[flat], "leaf": pdf["leaf"].to_numpy()[flat], "sim": s[rows, flat]})

    return run


def _finer(dim: int, group_rows: int):
    """Centres that part the rows of a cell, fitted on a sample of them."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid")
        x = unit(_matrix(pdf["vec"], dim)).astype(np.float32)
        wanted = max(2, min(len(x), -(-4 * int(pdf["rows"].iloc[0]) // group_rows)))
        centres, _ = _kmeans(x, wanted, np.random.default_rng(int(key[0])))
        return pd.DataFrame({"leaf": [key[0]], "centres": [centres.astype(np.float32).tobytes()]})

    return run


def _part(cid, cut: int):
    """The part of a cut cell that a member belongs to."""
    return cid % cut


def _route(tree: Tree, dim: int, visits: int, group_of: np.ndarray, cuts: np.ndarray, blocks: np.ndarray):
    """Rows for the tasks: each vector as a member of its cell's group, and as a query of every group with a cell it visits."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            seen = tree.first(unit(_matrix(pdf["vec"], dim)).astype(np.float32), visits)
            out = []
            row, cell = np.nonzero(seen >= 0)[0], seen[seen >= 0]
            order = np.lexsort((cell, group_of[cell], row))
            row, cell = row[order], cell[order]
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (group_of[cell[1:]] != group_of[cell[:-1]])]))
            cids, vecs = pdf["cid"].tolist(), pdf["vec"].tolist()
            for cid, vec, leaf in zip(cids, vecs, pdf["leaf"].tolist(), strict=True):
                g = int(group_of[leaf])
                out += [(g, _part(cid, int(cuts[leaf])), b, cid, vec, leaf, b"") for b in range(int(blocks[g]))]
            for a, b in zip(new, np.append(new[1:], len(row)), strict=True):
                i, h, inside = int(row[a]), int(group_of[cell[a]]), cell[a:b]
                out += [(h, p, cids[i] % int(blocks[h]), cids[i], vecs[i], -1, inside.astype(np.int32).tobytes()) for p in range(int(cuts[inside].max()))]
            yield pd.DataFrame(out, columns=["g", "part", "block", "cid", "vec", "leaf", "probes"])

    return run


def _search(dim: int, k: int, leaves_each: int, leaf_rows: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        member = pdf["leaf"].to_numpy() >= 0
        m, q = pdf[member].sort_values(["leaf", "cid"]), pdf[~member]
        if not len(m) or not len(q):
            return pd.DataFrame({"cid": np.array([], dtype=np.int64), "near": pd.Series([], dtype=object)})
        mv, qv = _matrix(m["vec"], dim), _matrix(q["vec"], dim)
        mu, qu = unit(mv).astype(np.float32), unit(qv).astype(np.float32)
        mids, qids = m["cid"].to_numpy(), q["cid"].to_numpy()
        cells, starts = np.unique(m["leaf"].to_numpy(), return_index=True)
        ends = np.append(starts[1:], len(m))
        probes = [np.frombuffer(b, dtype=np.int32) for b in q["probes"]]
        owner = np.repeat(np.arange(len(q)), [len(p) for p in probes])
        flat = np.concatenate(probes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        width = k + 1  # the query itself may be among them
        best = np.full((len(q), width), -2.0, dtype=np.float32)
        who = np.full((len(q), width), -1, dtype=np.int64)

        def look(asking: np.ndarray, at: np.ndarray) -> None:
            for c in range(0, len(asking), 8192):
                rows = asking[c : c + 8192]
                s = qu[rows] @ mu[at].T
                hit = np.flatnonzero(s.max(axis=1) > best[rows, 0])
                if not hit.size:
                    continue
                s, rows = s[hit], rows[hit]
                n = min(width, s.shape[1])
                top = np.argpartition(-s, n - 1, axis=1)[:, :n]
                both = np.concatenate([best[rows], np.take_along_axis(s, top, 1)], axis=1)
                ids = np.concatenate([who[rows], at[top]], axis=1)
                keep = np.argsort(both, axis=1)[:, -width:]  # the least of the kept comes first
                best[rows], who[rows] = np.take_along_axis(both, keep, 1), np.take_along_axis(ids, keep, 1)

        for cell, a, b in zip(cells, starts, ends, strict=True):
            lo, hi = np.searchsorted(flat, [cell, cell + 1])
            asking = owner[lo:hi]
            if not len(asking):
                continue
            centres, own = local_leaves(mu[a:b], int(cell), leaf_rows)
            if len(centres) <= leaves_each:
                look(asking, np.arange(a, b))
                continue
            order = np.argsort(own, kind="stable")
            cut = np.searchsorted(own[order], np.arange(len(centres) + 1))
            for c in range(0, len(asking), 65_536):
                rows = asking[c : c + 65_536]
                near = np.argsort(-(qu[rows] @ centres.T), axis=1, kind="stable")
                # as many leaves as calibrated, and more until they hold k others
                seen = np.cumsum(np.diff(cut)[near], axis=1)
                visited = np.arange(len(centres)) < np.maximum(leaves_each, 1 + (seen < width).sum(axis=1))[:, None]
                ask, near = np.broadcast_to(rows[:, None], near.shape)[visited], near[visited]
                by = np.argsort(near, kind="stable")
                ask, bounds = ask[by], np.searchsorted(near[by], np.arange(len(centres) + 1))
                for leaf in np.unique(near):
                    look(ask[bounds[leaf] : bounds[leaf + 1]], a + order[cut[leaf] : cut[leaf + 1]])
        qd, md = unit(qv), unit(mv)
        sims = np.where(who >= 0, np.einsum("ij,ikj->ik", qd, md[who.clip(0)]), -2)
        other, alike = np.where(who >= 0, mids[who.clip(0)], -1).tolist(), sims.tolist()
        near = [[{"sim": x, "cid": c} for x, c in zip(alike[i], other[i], strict=True) if c >= 0 and c != own] for i, own in enumerate(qids.tolist())]
        return pd.DataFrame({"cid": qids, "near": near})

    return run


@dataclass
class Found:
    neighbours: DataFrame  # path, neighbour, rank from 1, similarity
    visits: int  # cells a query visits
    leaves_each: int  # leaves it visits of each
    cells: int
    calibrated: float  # the share of the calibration queries' true neighbours in visited leaves


def _hash_below(share: float, *columns: str):
    """Whether the hash of a row, as a number in [0, 1), lies below a share: the same rows on every run."""
    return F.xxhash64(*columns).bitwiseAND(F.lit(0xFFFFFF)) / F.lit(float(0x1000000)) < share


def nearest(files: DataFrame, k: int = 5, dim: int = 64, target: float = TARGET, sizes: Sizes = SIZES) -> Found:
    """The ``k`` most similar other files of each file with a usable embedding, by cosine; ties go to the smaller path.

    Files without a usable embedding neither ask nor answer; a path counts once; equal vectors find each other first;
    fewer than ``k`` others give fewer rows; an empty table gives no rows. Other columns are ignored.
    """
    spark = files.sparkSession
    scratch = Scratch(spark, "neighbours")
    members = scratch.put(usable(files, dim).select("path", F.xxhash64("vec").alias("v1"), F.xxhash64(F.lit("quern"), "vec").alias("v2"), "vec"))
    heads = members.selectExpr("path", "v1", "v2", "row_number() over (partition by v1, v2 order by path) as r").where(F.col("r") <= k + 1)
    firsts = heads.groupBy("v1", "v2").agg(F.sort_array(F.collect_list("path")).alias("firsts"))
    classes = members.join(heads.where("r = 1").select("path"), "path", "left_semi").select(F.monotonically_increasing_id().alias("cid"), "v1", "v2", "vec")
    classes = scratch.put(classes.mapInPandas(_to_bytes, "cid long, v1 long, v2 long, vec binary"))
    n = classes.count()
    if n == 0:
        return Found(spark.createDataFrame([], "path string, neighbour string, rank int, similarity double"), 0, 0, 0, 1.0)
    sample = classes.where(_hash_below(sizes.fit_rows / max(n, sizes.fit_rows), "v1")).select("vec").orderBy("vec").toPandas()
    if not len(sample):
        sample = classes.select("vec").orderBy("vec").limit(1).toPandas()
    tree = fit_tree(unit(_matrix(sample["vec"], dim)).astype(np.float32), n, sizes)
    while True:
        indexed = scratch.put(classes.select("cid", "vec").mapInPandas(_index(tree, dim), "cid long, vec binary, leaf int"))
        counts = np.zeros(tree.leaves, dtype=np.int64)
        for row in indexed.groupBy("leaf").count().collect():  # one number a cell
            counts[row["leaf"]] = row["count"]
        large = spark.createDataFrame([(int(c), int(counts[c])) for c in np.flatnonzero(counts > sizes.group_rows)], "leaf int, rows long")
        some = indexed.join(F.broadcast(large), "leaf").where(F.xxhash64("vec").bitwiseAND(F.lit(0xFFFFFF)) / F.lit(float(0x1000000)) < F.lit(float(sizes.fit_rows)) / F.greatest("rows", F.lit(sizes.fit_rows)))
        finer = {} if large.isEmpty() else {r["leaf"]: np.frombuffer(r["centres"], dtype=np.float32).reshape(-1, dim) for r in some.groupBy("leaf").applyInPandas(_finer(dim, sizes.group_rows), "leaf int, centres binary").collect()}
        finer = {c: x for c, x in finer.items() if len(x) > 1}
        if not finer:
            break
        tree = tree.refined(finer)
        scratch.drop(indexed)
    # groups of cells, and how often members and queries of a group are cut, by exact counts
    group_of, cuts, size, g = np.zeros(tree.leaves, dtype=np.int64), np.ones(tree.leaves, dtype=np.int64), 0, 0
    for leaf in range(tree.leaves):
        if size and size + counts[leaf] > sizes.group_rows:
            g, size = g + 1, 0
        group_of[leaf], size = g, size + counts[leaf]
        cuts[leaf] = max(1, -(-counts[leaf] // sizes.group_rows))
    visits, leaves_each, recall = calibrate(indexed, tree, dim, k, target, n, cuts, counts, sizes)
    # any cells that a query visits hold k others between them
    visits = min(tree.leaves, max(visits, 1 + int(np.searchsorted(np.cumsum(np.sort(counts)), k + 1))))
    # how many queries a group gets, estimated on the sample: it sets the size of tasks, not what they find
    asking = np.zeros(g + 1)
    some = unit(_matrix(sample["vec"].iloc[:: max(1, len(sample) // 4_000)], dim)).astype(np.float32)
    for x in np.array_split(some, max(1, len(some) // 500)):
        for cells in tree.first(x, visits):
            asking[np.unique(group_of[cells[cells >= 0]])] += 1
    blocks = np.maximum(1, np.ceil(asking / len(some) * n / sizes.query_rows)).astype(np.int64)
    routed = indexed.mapInPandas(_route(tree, dim, visits, group_of, cuts, blocks), "g int, part int, block int, cid long, vec binary, leaf int, probes binary")
    near = routed.groupBy("g", "part", "block").applyInPandas(_search(dim, k, leaves_each, sizes.leaf_rows), "cid long, near array<struct<sim:double,cid:long>>")
    merged = near.groupBy("cid").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near")), asc=False), 1, k).alias("near"))
    named = classes.select("cid", "v1", "v2").join(firsts, ["v1", "v2"])
    links = merged.select("cid", F.explode("near").alias("e")).select("cid", "e.sim", F.col("e.cid").alias("other"))
    away = links.join(named.select(F.col("cid").alias("other"), "firsts"), "other").select("cid", F.explode(F.slice("firsts", 1, k)).alias("neighbour"), "sim")
    own = named.select("cid", F.explode("firsts").alias("neighbour"), F.lit(1.0).alias("sim"))
    best = away.unionByName(own).groupBy("cid").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("far"), "neighbour"))), 1, k + 1).alias("best"))
    lists = best.join(named.select("cid", "v1", "v2"), "cid").select("v1", "v2", "best")
    per = members.select("path", "v1", "v2").join(lists, ["v1", "v2"]).select("path", F.slice(F.filter("best", lambda e: e["neighbour"] != F.col("path")), 1, k).alias("best"))
    rows = per.select("path", F.posexplode("best").alias("pos", "e")).select("path", F.col("e.neighbour").alias("neighbour"), (F.col("pos") + 1).alias("rank"), (-F.col("e.far")).alias("similarity"))
    return Found(rows, visits, leaves_each, tree.leaves, recall)


def _leaf_ranks(true: dict[int, list[tuple[int, int]]], queries: np.ndarray, dim: int, leaf_rows: int):
    """For the true neighbours in one part of a cell, how many of its leaves are as near to the query as theirs."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid", ignore_index=True)
        x = unit(_matrix(pdf["vec"], dim)).astype(np.float32)
        centres, own = local_leaves(x, int(key[0]), leaf_rows)
        at = dict(zip(pdf["cid"].tolist(), own.tolist(), strict=True))
        out = []
        for q, cid in true[int(key[0])]:
            if cid in at:
                near = queries[q] @ centres.T
                out.append((q, cid, int((near > near[at[cid]]).sum()) + 1))
        return pd.DataFrame(out, columns=["q", "cid", "rank"])

    return run


def calibrate(indexed: DataFrame, tree: Tree, dim: int, k: int, target: float, n: int, cuts: np.ndarray, counts: np.ndarray, sizes: Sizes = SIZES) -> tuple[int, int, float]:
    """How many cells to visit, how many leaves of each, and the share of true neighbours in them, by a stated set of queries against all rows.

    Of the pairs that reach the target, the one with the fewest comparisons is taken.
    """
    share = 2 * sizes.calibration / max(n, 2 * sizes.calibration)
    rows = indexed.where(_hash_below(share, "vec")).select("cid", "vec").orderBy(F.xxhash64("vec"), "vec").limit(sizes.calibration).toPandas()
    if not len(rows) or n <= k + 1:
        return tree.leaves, max(1, int(counts.max())), 1.0
    queries, ids = unit(_matrix(rows["vec"], dim)), rows["cid"].to_numpy()
    parts = indexed.mapInPandas(_exact(queries, ids, dim, k), "q long, cid long, leaf int, sim double")
    true = parts.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("sim", "leaf", "cid")), asc=False), 1, k).alias("top")).collect()
    at = {int(c): i for i, c in enumerate(ids)}
    single = queries.astype(np.float32)
    cell_rank: dict[tuple[int, int], int] = {}
    wanted: dict[int, list[tuple[int, int]]] = {}
    for row in true:
        i = at[row["q"]]
        keys = tree.order_keys(single[i : i + 1])[0]
        for e in row["top"]:
            cell_rank[i, e["cid"]] = int((keys < keys[e["leaf"]]).sum()) + 1
            wanted.setdefault(e["leaf"], []).append((i, e["cid"]))
    cut = indexed.sparkSession.createDataFrame([(int(c), int(cuts[c])) for c in sorted(wanted)], "leaf int, cut long")
    inside = indexed.join(F.broadcast(cut), "leaf").withColumn("part", F.col("cid") % F.col("cut"))
    ranks = inside.groupBy("leaf", "part").applyInPandas(_leaf_ranks(wanted, single, dim, sizes.leaf_rows), "q int, cid long, rank int").collect()
    pairs = np.array([(cell_rank[r["q"], r["cid"]], r["rank"]) for r in ranks])
    per_cell = np.maximum(1, np.round(counts / sizes.leaf_rows))
    need, best = int(np.ceil(target * len(pairs))), None
    for most in np.unique(pairs[:, 1]):
        reached = np.sort(pairs[pairs[:, 1] <= most, 0])
        if len(reached) >= need:
            cells = int(reached[need - 1])
            cost = cells * (float(np.minimum(per_cell, most).mean()) + 0.2)
            if best is None or cost < best[0]:
                best = (cost, cells, int(most))
    _, visits, leaves_each = best
    return visits, leaves_each, float(((pairs[:, 0] <= visits) & (pairs[:, 1] <= leaves_each)).mean())


def recall(files: DataFrame, found: DataFrame, k: int = 5, dim: int = 64, every: int = 100, block: int = 4_096) -> DataFrame:
    """One row (queries, wanted, found, recall): a stated set of queries, one path in ``every`` by its hash, against all rows.

    A true neighbour counts as found if it, or another as similar, is among the query's rows in ``found``. Queries are
    compared in blocks of bounded size; the similarities of the ``k`` true neighbours are what both sides are judged by.
    """
    spark = files.sparkSession
    scratch = Scratch(spark, "recall")
    rows = scratch.put(usable(files, dim).select(F.xxhash64("path").alias("cid"), "vec", F.lit(0).alias("leaf")).mapInPandas(_to_bytes, "cid long, vec binary, leaf int"))
    asked = rows.where(F.pmod("cid", F.lit(every)) == 0).select("cid", "vec")
    blocks = max(1, -(-asked.count() // block))
    true = None
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("vec"), F.lit(blocks)) == b).orderBy("cid").toPandas()
        if not len(mine):
            continue
        part = rows.mapInPandas(_exact(unit(_matrix(mine["vec"], dim)), mine["cid"].to_numpy(), dim, k), "q long, cid long, leaf int, sim double")
        true = part if true is None else true.unionByName(part)
    if true is None:
        return spark.createDataFrame([(0, 0, 0, 1.0)], "queries long, wanted long, found long, recall double")
    least = true.groupBy("q").agg(F.slice(F.sort_array(F.collect_list("sim"), asc=False), 1, k).alias("sims")).select("q", F.element_at("sims", -1).alias("least"), F.size("sims").alias("wanted"))
    got = found.select(F.xxhash64("path").alias("q"), "similarity").join(least, "q").where(F.col("similarity") >= F.col("least") - 1e-9).groupBy("q").agg(F.count(F.lit(1)).alias("found"))
    return least.join(got, "q", "left").agg(F.count(F.lit(1)).alias("queries"), F.sum("wanted").alias("wanted"), F.sum(F.least(F.coalesce("found", F.lit(0)), F.col("wanted"))).alias("found")).withColumn("recall", F.col("found") / F.col("wanted"))


def alike(found: Found, least: float = 0.9) -> DataFrame:
    """Unordered pairs (path_a, path_b) at least ``least`` similar of which one is among the other's nearest."""
    near = found.neighbours.where(F.col("similarity") >= least)
    return near.select(F.least("path", "neighbour").alias("path_a"), F.greatest("path", "neighbour").alias("path_b")).distinct()
