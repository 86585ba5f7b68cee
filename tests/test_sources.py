import os

import pytest
from pyspark.sql import functions as F

from quern.operators import events as ev
from quern.sources import extract, files, store
from quern.streaming import incremental


def test_discovery_and_classification(spark, tmp_path):
    for name, raw in {"a.ts": b"x", "b.txt": "é".encode("cp1252"), "node_modules/c.ts": b"x", "d.png": b"x", "keep/e.log": b"x", "keep/f.log": b"x", "g.bin": bytes(range(256)), "h.md": "\ufeffü".encode("utf-16-le")}.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    found = files.discover(spark, str(tmp_path), [*files.EXCLUDED, "*.log", "!keep/e.log"])
    rows = {r["path"]: r for r in files.classify(found.withColumn("content", files.decode("content"))).collect()}
    assert set(rows) == {"a.ts", "b.txt", "keep/e.log", "g.bin", "h.md"}
    assert (rows["a.ts"]["kind"], rows["b.txt"]["kind"], rows["g.bin"]["kind"]) == ("file", "document", "skipped")
    assert rows["b.txt"]["content"] == "é" and rows["h.md"]["content"] == "ü"


def test_store_versions_and_incremental_equals_full(spark, tmp_path):
    f = spark.createDataFrame([("w:a.ts", "1"), ("w:b.ts", "1")], "path string, content_hash string")
    s = spark.createDataFrame([("a1", "w:a.ts"), ("b1", "w:b.ts")], "id string, file_path string")
    r = spark.createDataFrame([("b1", "a1", "CALLS"), ("w:a.ts", "a1", "DEFINES"), ("w:b.ts", "b1", "DEFINES")], "source string, target string, type string")
    d = spark.createDataFrame([], "path string")
    p = spark.createDataFrame([("s1",), ("s2",)], "spec_id string")
    st = store.Store(spark, str(tmp_path / "store"))
    assert st.generation is None
    with st:
        first = st.bulk_load({"files": f, "symbols": s, "relations": r, "docnodes": d, "specs": p})
        with pytest.raises(RuntimeError), store.Store(spark, str(tmp_path / "store")):
            pass
    # a.ts comes again with the same symbol: the call from b stays
    st.upsert_files(f.where("path = 'w:a.ts'"), s.where("id = 'a1'"), r.where("source = 'w:a.ts'"))
    assert st.is_stale(first)
    assert {tuple(x) for x in st.table("relations").select("source", "target", "type").collect()} == {tuple(x) for x in r.collect()}
    st.remove_files(spark.createDataFrame([("w:a.ts",)], "path string"))
    assert {x["source"] for x in st.table("relations").collect()} == {"w:b.ts"}
    st.remove("specs", spark.createDataFrame([("s1",)], "spec_id string"))
    assert [x[0] for x in st.table("specs").collect()] == ["s2"]
    assert st.statistics().first().asDict() == {"files": 1, "docnodes": 0, "symbols": 1, "specs": 1}
    st.clear()
    assert st.table("files").count() == 0


def test_json_lines(spark, tmp_path):
    where = store.publish_lines(spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string"), str(tmp_path / "index"))
    with open(os.path.join(where, "part-bad.json"), "w") as f:
        f.write('{"id": 3, "name": "c"}\nnot json\n')
    assert sorted(r["id"] for r in store.read_lines(spark, where, "id long, name string").where("id is not null").collect()) == [1, 2, 3]


def test_extraction_and_resolution(spark):
    rows = [
        ("w:src/a.ts", "import { helper } from './lib/b.js'\nimport Def, { x as y } from 'pkg'\nexport class A extends Base implements I {\n  run(n: number): void {\n    helper(n)\n    // helper2()\n    new A()\n  }\n}\n"),
        ("w:src/lib/b.ts", "export function helper(n: number) { return n }\n"),
        ("w:m.py", "from .n import f\nclass C(B):\n    def go(self):\n        f()\n"),
        ("w:n.py", "def f():\n    pass\n"),
        ("w:bad.py", "def f(:\n"),
        ("w:g.go", 'package g\nimport (\n\tx "a/b"\n\t"c/d"\n)\nfunc (t *T) M() {}\nfunc F() { x.Y() }\ntype T struct {}\n'),
        ("w:p.php", "<?php\nuse A\\B as C;\nclass P extends Q { public function m() { n(); } }\nfunction n() {}\n"),
        ("w:none.ts", None),
    ]
    table = spark.createDataFrame(rows, "path string, content string")
    found = extract.analysed(table).cache()
    syms = {(r["file_path"], r["kind"], r["name"]) for r in extract.symbols(found).collect()}
    assert {("w:src/a.ts", "class", "A"), ("w:src/a.ts", "method", "run"), ("w:src/lib/b.ts", "function", "helper"), ("w:m.py", "method", "go"), ("w:g.go", "method", "M"), ("w:p.php", "method", "m"), ("w:p.php", "function", "n")} <= syms
    assert [r["path"] for r in found.where("fact = 'error'").collect()] == ["w:bad.py"]
    imports = extract.import_edges(found, table)
    assert {tuple(r) for r in imports.collect()} == {("w:src/a.ts", "w:src/lib/b.ts"), ("w:m.py", "w:n.py")}
    calls = {(r["source"].split(":")[3], r["target"].split(":")[3], r["type"]) for r in extract.call_edges(found, imports).collect()}
    assert calls == {("run", "helper", "CALLS"), ("run", "A", "CONSTRUCTS"), ("go", "f", "CALLS"), ("m", "n", "CALLS")}
    bases = {(r["name"], r["kind"], r["target"]) for r in found.where("fact = 'base'").collect()}
    assert {("A", "EXTENDS", "Base"), ("A", "IMPLEMENTS", "I"), ("P", "EXTENDS", "Q"), ("C", "EXTENDS", "B")} <= bases


def test_change_state(spark):
    log = spark.createDataFrame([("c", 1, "created", None), ("c", 2, "transitioned", "implementing"), ("c", 3, "signed-off", None), ("c", 4, "drafted", None), ("d", 1, "created", None), ("d", 2, "signed-off", None), ("d", 3, "invalidated", None)], "change string, seq long, type string, to_state string").withColumn("at", F.col("seq"))
    got = {r["change"]: r for r in ev.change_state(log).collect()}
    assert (got["c"]["state"], got["c"]["drafted"], got["c"]["signed_off"], got["c"]["implementing_at"]) == ("implementing", True, True, 2)
    assert (got["d"]["state"], got["d"]["signed_off"], got["d"]["invalidated_at"]) == ("drafting", False, 3)


def test_stream_equals_batch(spark, tmp_path, small):
    batch = spark.read.parquet(f"{small}/events.parquet").select("ts", "event_type")
    os.makedirs(tmp_path / "in")
    batch.withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    src = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = incremental.windowed_counts(stream, "ts", F.col("event_type"), "1 day", "3650 days")
    query = out.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "check")).start()
    query.awaitTermination(120)
    same = lambda df: sorted((r["start"], r["key"], r["n"]) for r in df.collect())
    assert same(spark.table("counted")) == same(incremental.windowed_counts(src, "ts", F.col("event_type"), "1 day"))
    seen = []
    query = incremental.merge_batches(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), lambda rows, n: seen.append(rows.count()), str(tmp_path / "merge"))
    query.processAllAvailable()
    query.stop()
    assert sum(seen) == src.count()


def test_streamed_state_and_upserts(spark, tmp_path):
    log = spark.createDataFrame([("c", 1, "created", None), ("c", 2, "transitioned", "implementing"), ("c", 3, "signed-off", None), ("d", 1, "created", None), ("d", 2, "signed-off", None), ("d", 3, "invalidated", None)], "change string, seq long, type string, to_state string").withColumn("at", F.col("seq"))
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    query = incremental.change_states(stream).writeStream.outputMode("complete").format("memory").queryName("states").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    assert sorted(map(str, spark.table("states").collect())) == sorted(map(str, ev.change_state(log).collect()))
    st = store.Store(spark, str(tmp_path / "s"))
    f = spark.createDataFrame([("w:a", "1"), ("w:b", "1")], "path string, content_hash string")
    s = spark.createDataFrame([("a1", "w:a"), ("b1", "w:b")], "id string, file_path string")
    r = spark.createDataFrame([("b1", "a1", "CALLS")], "source string, target string, type string")
    st.bulk_load({"files": f.limit(0), "symbols": s.limit(0), "relations": r, "docnodes": spark.createDataFrame([], "path string"), "specs": spark.createDataFrame([], "spec_id string")})
    assert {tuple(x) for x in incremental.upsert_changed(st, f, s, r).collect()} == {("w:a", "new"), ("w:b", "new")}
    first = st.generation
    incremental.upsert_changed(st, f, s, r)
    assert st.generation == first and st.table("files").count() == 2 and st.table("relations").count() == 1


def test_cache_and_freshness(spark):
    now = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z"), ("d", 4, "w")], "key string, stamp long, fingerprint string")
    old = spark.createDataFrame([("a", 1, "q", "A", "v1"), ("b", 9, "y", "B", "v1"), ("c", 9, "q", "C", "v1"), ("d", 4, "w", "D", "v0")], "key string, stamp long, fingerprint string, result string, version string")
    assert {tuple(x) for x in incremental.cached_results(now, old, "v1").collect()} == {("a", "hard", "A"), ("b", "soft", "B"), ("c", "miss", None), ("d", "miss", None)}
    assert not incremental.needs_rebuild(now, now) and incremental.needs_rebuild(now, now, True)
    assert incremental.needs_rebuild(now, now.limit(3)) and incremental.needs_rebuild(now, now.withColumn("stamp", F.col("stamp") + 1))


def test_calls_and_bases_resolve_by_alias_receiver_and_base(spark):
    rows = [
        ("w:a.ts", "import { foo as bar, same } from './b'\nimport * as ns from './c'\nimport Def from './d'\nimport { Base } from './c'\nexport class A extends Base {\n  one(): void {\n    bar()\n    same()\n    ns.deep()\n    Def()\n    this.two()\n    Base.make()\n    this.ns.deep2()\n  }\n  two(): void {\n  }\n}\n"),
        ("w:b.ts", "export function foo() { return 1 }\nexport function same() { return 1 }\n"),
        ("w:c.ts", "export function same() { return 2 }\nexport function deep() { return 2 }\nexport function deep2() { return 2 }\nexport class Base {\n  static make(): void {\n  }\n}\n"),
        ("w:d.ts", "export default function inner() { return 3 }\n"),
    ]
    table = spark.createDataFrame(rows, "path string, content string")
    found = extract.analysed(table).cache()
    imports = extract.import_edges(found, table)
    short = lambda e: {(r["source"].split(":")[3], ":".join(r["target"].split(":")[1:4:2]), r["type"]) for r in e.collect()}
    assert short(extract.call_edges(found, imports)) == {("one", x, "CALLS") for x in ("b.ts:foo", "b.ts:same", "c.ts:deep", "d.ts:inner", "a.ts:two", "c.ts:make")}
    assert short(extract.base_edges(found, imports)) == {("A", "c.ts:Base", "EXTENDS")}


def test_php_requires_resolve_against_the_file(spark):
    rows = [("w:p/a.php", "<?php\nrequire_once 'lib/x.php';\nrequire './y.php';\nrequire '/abs.php';\nfunction m() {\n  h();\n}\n"), ("w:p/lib/x.php", "<?php\nfunction h() {}\n"), ("w:p/y.php", "<?php\n"), ("w:abs.php", "<?php\n")]
    table = spark.createDataFrame(rows, "path string, content string")
    found = extract.analysed(table).cache()
    imports = extract.import_edges(found, table)
    assert {tuple(r) for r in imports.collect()} == {("w:p/a.php", "w:p/lib/x.php"), ("w:p/a.php", "w:p/y.php")}
    assert [(r["source"].split(":")[3], r["target"].split(":")[3]) for r in extract.call_edges(found, imports).collect()] == [("m", "h")]
