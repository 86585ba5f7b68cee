import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.llm import leakage, neighbours, packing, prose, splitting

WORDS = "after the lantern near a quiet harbour another keel lifts this woven hamper while the oar mends one damp mill beside each granary".split()


def text(r, n):
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


# ------------------------------------------------------------------------------------------------------------- splitting
@pytest.mark.parametrize("make", [lambda r: text(r, 4000), lambda r: "x" * 20_000, lambda r: "\n\n".join(text(r, 60) for _ in range(60)), lambda r: "😀é" * 9_000, lambda r: "\r\n".join(text(r, 9) for _ in range(400)), lambda r: text(r, 3), lambda r: "a" * 6_000, lambda r: "a b" * 2_000 + "a"])
@pytest.mark.parametrize("overlap", [0, 200])
def test_pieces_lose_nothing(make, overlap):
    t = make(random.Random(1))
    pieces = splitting.cuts(t, 6_000, overlap)
    assert all(b - a <= 6_000 for a, b in pieces)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(t)
    for (_, end), (start, _) in zip(pieces, pieces[1:], strict=False):
        assert end - start == overlap
    assert splitting.cuts("") == []


def test_cuts_fall_on_boundaries_and_edits_stay_local():
    r = random.Random(2)
    t = "\n\n".join(text(r, 70) + "." for _ in range(120))
    ends = [b for _, b in splitting.cuts(t)]
    assert all(t[b - 1].isspace() for b in ends[:-1])
    changed = t[: len(t) // 2] + "a new sentence here. " + t[len(t) // 2 :]
    shift = len(changed) - len(t)
    after = {b for _, b in splitting.cuts(changed)}
    same = [b for b in ends if b in after or b + shift in after]
    assert len(same) >= len(ends) - 3


def test_split_rows(spark):
    big = "word " * 2_000
    rows = spark.createDataFrame([("files", "a", big), ("files", "a", big), ("specs", "b", "short"), ("files", None, big), ("docnodes", "c", None), ("docnodes", "d", "")], "item_table string, item_key string, content string").withColumns({"piece": F.lit("x"), "text": F.lit(1)})
    got = splitting.split(rows).orderBy("piece").collect()
    assert {(r["item_table"], r["item_key"]) for r in got} == {("files", "a")}
    assert "".join(r["text"][r["overlap"] :] for r in got) == big
    assert splitting.split(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splitting.cuts("x", 10, 10)


# --------------------------------------------------------------------------------------------------------------- packing
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_packing(seed):
    r = np.random.default_rng(seed)
    sizes = r.integers(0, 900, 400)
    start = packing.best_fit(sizes, 1_000)
    bins = packing.improve([list(b) for b in start], sizes, 1_000)
    assert sorted(i for b in bins for i in b) == list(range(400))
    assert all(sizes[b].sum() <= 1_000 for b in bins)
    assert len(bins) <= len(start)


def test_local_search_empties_containers():
    sizes = np.array([5, 5, 4, 4, 4, 4, 2, 2])
    poor = [[0, 2], [1, 3], [4, 6], [5, 7]]  # 9, 9, 6, 6 of 10
    assert len(packing.improve(poor, sizes, 10)) == 3


def test_pack(spark):
    r = random.Random(3)
    docs = [(i, text(r, r.randrange(1, 150))) for i in range(200)] + [(200, text(r, 3_000)), (201, ""), (202, None), (None, "x"), (5, "short")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"tokens": F.lit("x"), "part": F.lit("y")})
    got = packing.pack(table, capacity=512, group=64).collect()
    assert {x["doc_id"] for x in got} == set(range(202))
    fill = {}
    for x in got:
        fill[x["container"]] = fill.get(x["container"], 0) + x["tokens"]
    assert max(fill.values()) <= 512
    encode = packing.tokenizer().encode_ordinary
    size = {i: len(encode(t)) for i, t in docs if i is not None and t is not None and (i, t) != (5, "short")}
    for i, n in size.items():
        mine = sorted((x["start_token"], x["tokens"]) for x in got if x["doc_id"] == i)
        assert sum(t for _, t in mine) == n and (len(mine) == 1 or n > 512)
    assert sum(f < 0.97 * 512 for f in fill.values()) <= -(-len(size) // 64)  # one a group is left underfull
    assert packing.pack(table.limit(0)).count() == 0


def test_long_texts_are_measured_in_slices():
    encode = packing.tokenizer().encode_ordinary
    t = "\n".join(text(random.Random(4), 20) for _ in range(300))
    assert packing._count(encode, t, 1_000) == len(encode(t))


# --------------------------------------------------------------------------------------------------------------- leakage
def brute_leaks(docs, items, least=12):
    out = {}
    for d, t in docs:
        a = leakage.words_of(t) if t else []
        for i, u in items:
            b = leakage.words_of(u) if u else []
            best = 0
            for x in range(len(a)):
                for y in range(len(b)):
                    n = 0
                    while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                        n += 1
                    best = max(best, n)
            if best >= least:
                out[d, i] = max(best, out.get((d, i), 0))
    return out


def test_leaks_against_brute_force(spark):
    r = random.Random(6)
    items = [(i, text(r, 40)) for i in range(6)]
    docs = []
    for d in range(60):
        t = text(r, 60)
        if d % 3 == 0:
            w = items[d % 6][1].split()
            a = r.randrange(0, 20)
            n = r.choice([11, 12, 13, 20])
            t = t[:80] + " ZZZ **" + " _ ".join(w[a : a + n]).upper() + "** zzz " + t[80:]
        docs.append((d, t))
    docs += [(100, None), (101, ""), (102, "one two"), (103, items[0][1]), (103, items[1][1]), (103, items[1][1])]
    items += [(7, None), (8, "too short"), (9, items[2][1])]
    D = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit("x"))
    E = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(x["doc_id"], x["item_id"]): x["words"] for x in leakage.leaks(D, E).collect()}
    assert got == brute_leaks(docs, items)
    assert leakage.leaks(D.limit(0), E).count() == 0 and leakage.leaks(D, E.limit(0)).count() == 0
    left = leakage.clean(D, leakage.leaks(D, E))
    assert left.where("doc_id = 103").count() == 0


class Sent:
    def __init__(self, *items):
        self.value = list(items)


def longest(docs, items, shard, blocks=1):
    sent = [Sent(*items[k::blocks]) for k in range(blocks)]
    out = {}
    for found in leakage._look(sent, 12, shard)(iter([pd.DataFrame({"doc_id": [d for d, _ in docs], "text": [t for _, t in docs]})])):
        for d, i, n in zip(found["doc_id"], found["item_id"], found["words"], strict=True):
            out[d, i] = max(out.get((d, i), 0), n)
    return out


def test_shards_and_blocks_change_nothing():
    r = random.Random(7)
    for _ in range(12):
        words = [f"w{k}" for k in range(r.choice([1, 2, 4, 40]))]
        items = [(i, " ".join(r.choices(words, k=r.randint(5, 60)))) for i in range(4)]
        docs = [(d, " ".join(r.choices(words, k=r.randint(0, 120))) + (" " + r.choice(items)[1] + " x" if d % 2 else "")) for d in range(5)]
        want = brute_leaks(docs, items)
        for shard, blocks in ((30, 1), (40, 3), (1_000, 2)):
            assert longest(docs, items, shard, blocks) == want


def test_a_match_across_an_edge_is_one():
    passage = " ".join(f"x{k}" for k in range(8_000))
    doc = " ".join(f"y{k}" for k in range(19_000)) + " " + passage + " end"
    assert longest([(1, doc)], [(9, passage)], 10_000) == {(1, 9): 8_000}


def test_shared_passages_are_classes():
    header = " ".join(f"h{k}" for k in range(40))
    found = longest([(d, f"{header} d{d}") for d in range(400)], [(i, f"{header} i{i}") for i in range(100)], leakage.SHARD)
    assert len(found) == 40_000 and set(found.values()) == {40}
    assert longest([(1, "a " * 4_000)], [(2, "a " * 100)], leakage.SHARD) == {(1, 2): 100}


# ------------------------------------------------------------------------------------------------------------ neighbours
def test_neighbours_against_brute_force(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(500, 64)).astype(np.float32)
    near = (base[:80] * 3 + r.normal(size=(80, 64)) * 0.2).astype(np.float32)
    copies = np.repeat(base[:1], 9, axis=0)
    x = np.concatenate([base, near, copies])
    rows = [(f"p{i:04}", v.tolist()) for i, v in enumerate(x)]
    bad = [("short", [1.0] * 32), ("zero", [0.0] * 64), ("nan", [float("nan")] * 64), ("null", None), ("inf", [float("inf")] * 64), (None, rows[0][1]), ("hole", [None] + [1.0] * 63), rows[3]]
    files = spark.createDataFrame(rows + bad, "path string, embedding array<float>").withColumns({"vec": F.lit("x"), "rank": F.lit(1)})
    found = neighbours.nearest(files)
    got = {}
    for q in found.neighbours.collect():
        got.setdefault(q["path"], []).append((q["rank"], q["neighbour"], q["similarity"]))
    assert set(got) == {p for p, _ in rows} and all(len(v) == 5 for v in got.values())
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    hits = 0
    pairs = set()
    for i in range(len(u)):
        order = sorted((j for j in range(len(u)) if j != i), key=lambda j: (-round(s[i, j], 9), j))[:5]
        hits += len({f"p{j:04}" for j in order} & {n for _, n, _ in got[f"p{i:04}"]})
        pairs |= {tuple(sorted((f"p{i:04}", f"p{j:04}"))) for j in order if s[i, j] >= 0.9}
    assert hits / (5 * len(u)) >= 0.9
    assert {tuple(p) for p in neighbours.alike(found).collect()} == pairs


def test_few_and_no_vectors(spark):
    one = spark.createDataFrame([("a", [1.0] * 64), ("b", [2.0] * 64)], "path string, embedding array<float>")
    assert {tuple(p) for p in neighbours.alike(neighbours.nearest(one)).collect()} == {("a", "b")}
    assert neighbours.nearest(one.limit(0)).neighbours.count() == 0
    assert neighbours.nearest(one.limit(1)).neighbours.count() == 0


def test_large_cells_are_fitted_further(spark):
    """Clustered vectors with bounds so small that cells are refined, cut in leaves and dealt to many tasks."""
    r = np.random.default_rng(3)
    hubs = r.normal(size=(12, 64)) * 3
    x = np.concatenate([hubs[k % 12] + r.normal(size=64) * 0.7 for k in range(1_500)]).reshape(1_500, 64).astype(np.float32)
    files = spark.createDataFrame([(f"p{i:04}", v.tolist()) for i, v in enumerate(x)], "path string, embedding array<float>")
    found = neighbours.nearest(files, sizes=neighbours.Sizes(fit_rows=200, cells=4, leaf_rows=20, group_rows=120, query_rows=200, calibration=100))
    assert found.cells > 12
    rows = found.neighbours.cache()
    assert rows.count() == 7_500
    row = neighbours.recall(files, rows, every=3).first()
    assert row["queries"] > 300 and row["recall"] >= 0.9 and row["wanted"] == 5 * row["queries"]
    again = neighbours.nearest(files, sizes=neighbours.Sizes(fit_rows=200, cells=4, leaf_rows=20, group_rows=120, query_rows=200, calibration=100))
    assert (again.visits, again.leaves_each, again.cells) == (found.visits, found.leaves_each, found.cells)


def test_walking_a_large_tree_visits_what_the_whole_order_says():
    r = np.random.default_rng(4)
    x = neighbours.unit(r.normal(size=(2_000, 64))).astype(np.float32)
    tree = neighbours.fit_tree(x, 40_000).refined({3: x[:5], 7: x[5:9]})
    assert tree.leaves == len(set(tree.leaf[tree.leaf >= 0].tolist())) and (tree.assign(x) >= 0).all()
    keys = tree.order_keys(x[:50])
    dense, walked = tree.first(x[:50], 20), tree.first(x[:50], 20, dense=0)
    met = 0
    for i in range(50):
        want = set(np.argsort(keys[i])[:20].tolist())
        assert set(dense[i].tolist()) == want
        met += len(want & set(walked[i].tolist()))
    assert met >= 0.95 * 50 * 20


def test_bins_come_in_the_order_of_a_priority_queue():
    import heapq

    r = np.random.default_rng(2)
    x = neighbours.unit(r.normal(size=(3000, 64))).astype(np.float32)
    tree = neighbours.fit_tree(x, 60_000)
    keys = tree.order_keys(x[:20])
    assert tree.leaves > 100 and (tree.assign(x) >= 0).all()
    for i in range(20):
        heap = [(1 - float(x[i] @ tree.centres[n]), n) for n in np.flatnonzero(tree.parent < 0)]
        heapq.heapify(heap)
        order = []
        while heap:
            d, n = heapq.heappop(heap)
            if tree.leaf[n] >= 0:
                order.append(tree.leaf[n])
            for k in np.flatnonzero(tree.parent == n):
                heapq.heappush(heap, (1 - float(x[i] @ tree.centres[k]), k))
        assert np.all(np.diff(keys[i][order]) >= -1e-5)


# ----------------------------------------------------------------------------------------------------------------- prose
EN = "When the plugin stores any caller that forwards its report, each of the readers must wait for the lock. There is no need to merge the record; the kernel resolves it at the end of the day. "
COMMON = {"en": frozenset("the of and to in is that for it as on with by this are be from at or an not when if because must may each any no one its there".split()), "de": frozenset("der die das und in den von zu mit sich des auf für ist im dem nicht ein eine".split())}


@pytest.mark.parametrize(("t", "natural"), [
    (EN * 3, True), (EN.lower() * 3, True), ("# Title\n\n" + "\n".join(EN.split(", ")) * 3, True), ("Das Protokoll vergleicht alle toten Verweise, und die Sitzung behält die letzte Fassung. " * 3, True), ("> " + EN * 2, True), (EN[:120], True),
    ("- one item\n- another item\n1. third\n" * 10, False), ("| a | b |\n|---|---|\n" + "| the | of |\n" * 20, False), ("```ts\nconst a = b(c)\n```\n" * 9, False), ("2025-01-01 10:00:00 INFO a.b - c=1\n" * 9, False), ("key: value\nother: [a, b]\n" * 9, False), ("[a](b.md)\n" * 9, False), ("kQVDZWB3KTtnvQrCLhDWahN4cCG8CdcpZlZhUPrnt38ojjZkT4FCKOIdH9TJ3M4XwPHT9Wd9sNVY\n" * 5, False),
    ("target schema node it an and node by policy canonical from record manifest queue scope approval be of change final or an session " * 5, False), ("Ã©Ã¨ task ï¿½ï¿½ %C3%A9 Â·Â· rule " * 20, False), ("Perbx tursifut medxl rzsqjq wqnguzcabas vo xasde pxmat? Nelqwilji disbowqdqt rqswz kezus xzvxqurdo. " * 5, False), ("1.2 Current label .......... 12\n" * 9, False), (EN + "\n\n" + "| a | b | c |\n" * 80, False), ("a,b,c,d\n1,2,3,4\n" * 20, False),
])
def test_prose(t, natural):
    assert (prose.describe(t, COMMON)["prose_share"] >= 0.5) == natural


def test_statistics(spark):
    common = spark.createDataFrame([(k, w) for k, ws in COMMON.items() for w in ws] + [(None, "x"), ("en", None)], "lang string, word string")
    docs = spark.createDataFrame([(1, "The cat. A dog!\n\n- 42"), (2, " \n"), (3, None), (None, "x"), (4, "x" * 200_000), (1, "The cat. A dog!\n\n- 42")], "doc_id long, text string").withColumn("words", F.lit("clash"))
    got = [r for r in prose.statistics(docs, common).collect()]
    assert sorted(r["doc_id"] for r in got) == [1, 1, 2, 4]
    one = next(r for r in got if r["doc_id"] == 1)
    assert (one["words"], one["lines"], one["punctuated_lines"]) == (5, 2, 0.5)
    assert one["mean_word_length"] == pytest.approx(12 / 5) and one["common_words"] == pytest.approx(1 / 5) and one["symbol_ratio"] == pytest.approx(3 / 15)
    assert next(r for r in got if r["doc_id"] == 2)["natural"] is None
    assert next(r for r in got if r["doc_id"] == 4)["natural"] is False
    plain = {r["doc_id"]: r for r in prose.counts(docs, common).collect()}
    assert (plain[1]["words"], plain[1]["lines"], plain[1]["punctuated_lines"]) == (5, 2, 0.5)
    assert prose.statistics(docs.limit(0), common).count() == 0
    assert prose.statistics(docs, common.limit(0)).count() == 4


def test_divergence_is_a_distance_squared():
    p, q = [0.5, 0.5, 0.0], [0.1, 0.2, 0.7]
    assert prose.divergence(p, p) == 0 and prose.divergence(p, q) == pytest.approx(prose.divergence(q, p)) and 0 < prose.divergence(p, q) <= 1


def test_profiles_are_fitted_per_language(spark):
    rows = [(k, EN * 3 + f"\n\n- item {k}") for k in range(60)] + [(100 + k, "Das Protokoll vergleicht alle toten Verweise, und die Sitzung behält die letzte Fassung der Liste. " * 5) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fitted = prose.fit_profiles(docs, COMMON)
    assert {"prose:en", "prose:de"} <= set(fitted) and fitted["prose:de"][1] > fitted["prose:en"][1]
    every = prose.made(fitted)
    assert all(abs(sum(p) - 1) < 0.02 for p in every.values()) and "word list:de" in every
    assert prose.fit_profiles(docs.limit(0), COMMON) == {} and prose.fit_profiles(docs, {}) == {}


def test_profiles_come_from_all_documents(spark):
    german = "Das Protokoll vergleicht alle toten Verweise, und die Sitzung behält die letzte Fassung der Liste. " * 5
    rows = [(k, german) for k in range(prose.FIT_CHARS // len(german) + 1)] + [(1_000 + k, "- item") for k in range(8_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fitted = prose.fit_profiles(docs, COMMON)  # German is enough only if no document is left out
    said = german.strip()
    assert fitted["prose:de"][:2] == pytest.approx([sum(c.islower() for c in said) / len(said), sum(c.isupper() for c in said) / len(said)], abs=1e-3)
    assert "prose:de" not in prose.fit_profiles(docs.where("doc_id > 0"), COMMON) and fitted["prose:de"] == prose.fit_profiles(docs.repartition(7), COMMON)["prose:de"]


def test_verdicts_are_those_of_the_statistics(spark):
    common = spark.createDataFrame([(k, w) for k, ws in COMMON.items() for w in ws], "lang string, word string")
    texts = [EN * 3, "- one item\n" * 10, " \n", "", None, "target schema node it an and node by policy canonical from record manifest queue " * 5, "Perbx tursifut medxl rzsqjq wqnguzcabas vo xasde pxmat? " * 9]
    docs = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts * 2)] + [(None, EN)], "doc_id string, text string")
    same = ["doc_id", "nonblank", "prose_share", "by_divergence", "natural"]
    got = prose.verdicts(docs, common)
    assert got.columns == same and sorted(map(str, got.collect())) == sorted(map(str, prose.statistics(docs, common).select(same).collect())) and got.count() == 12
    assert prose.verdicts(docs.limit(0), common).count() == 0


def test_full_pieces_are_containers(spark):
    table = spark.createDataFrame([(1, "word " * 3_000), (2, "word " * 10), (3, None)], "doc_id long, text string")
    got = packing.pack(table, capacity=256, group=8).collect()
    full = [r for r in got if r["tokens"] == 256]
    assert len(full) > 9 and all(r["container"] < 0 for r in full) and len({r["container"] for r in full}) == len(full)
    assert sum(r["tokens"] for r in got if r["doc_id"] == 1) == len(packing.tokenizer().encode_ordinary("word " * 3_000))


def test_cuts_snap_to_the_nearest_boundary():
    ends = [np.array([100, 180, 300]), np.array([150])]
    assert splitting._snap(170, 120, 400, ends) == 180 and splitting._snap(170, 140, 160, ends) == 150 and splitting._snap(170, 160, 175, ends) == 170
