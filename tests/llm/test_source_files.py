import ast
import random

import pytest
from pyspark.sql import functions as F

from quern.llm import functions, generated, lexer_states, validity

CASES = [
    ("a.py", "def f(x):\n    return x\n", True), ("a.py", "def f(x:\n    return x\n", False), ("a.py", "# only\n", True), ("a.py", "  \n", True), ("a.py", "\ufeffx = 1\r\n", True), ("a.py", "x = '''\n<<<<<<< HEAD\n'''\n", True), ("a.py", "x = 1\n<<<<<<< HEAD\ny = 2\n", False), ("a.pyi", "def f(x: int) -> str: ...\n", True), ("a.py", "x = 1\0\n", False),
    ("a.ts", "export const f = async <T,>(a: T, b?: number): Promise<T> => { for (const [k, v] of m) { g(k!)?.h ?? v } return a as unknown as T }\n", True), ("a.ts", "interface A<T extends B = C> extends D { readonly [k: string]: T; m?(x: number): void\n new (x: T): A<T> }\ntype U = { [K in keyof T]?: T[K] } | ((a: string) => void)[]\n", True), ("a.ts", "abstract class A<T> extends B<T> implements C { private x: Map<string, Array<number>> = new Map()\n static { this.y = 1 }\n constructor(private readonly z = 1) { super() }\n get v(): number { return 1 }\n abstract f(): void }\nenum E { A = 'x', B = 1 << 2 }\n", True),
    ("a.js", "function f(a: string) { return a }\n", False), ("a.js", "const r = a / b / c, s = /[)}]+$/u.test(x)\nlabel: for (;;) { if (a) continue label; else break }\n", True), ("a.js", "const t = `a ${b ? `c ${d}` : '}'} e`\n", True), ("a.js", "const t = `a ${b\n", False), ("a.js", "let x = \u2018y\u2019\n", False), ("a.js", "if (a) {\n", False), ("a.js", "x = = 1\n", False), ("a.js", "const f = (a) =&gt; a\n", False), ("a.js", "a\n(b)\n+c\n`d`\n", True), ("a.js", "return = 1", False), ("a.js", "1: const a = 1\n2: const b = 2\n", False), ("a.js", "({ a, b: [c], ...d } = e)\nasync () => { await x; for await (const y of z) {} }\nexport { a as default } from 'm'\nimport d, * as n from 'x'\n", True),
    ("a.jsx", "const A = () => <div className='x' {...p}>text {items.map((i) => <li key={i}>{i}</li>)} <br/></div>\n", True), ("a.jsx", "const A = () => <div>text\n", False), ("a.ts", '{ "a": 1, "b": 2 }\n', False), ("a.js", '["a", 1]\n', True), ("a.ts", "export const SAMPLE = `\n<<<<<<< HEAD\n=======\n>>>>>>> main\n`\n", True),
    ("a.go", 'package p\n\nimport (\n\t"fmt"\n\tx "y/z"\n)\n\ntype T[K comparable] struct {\n\tA, B int `json:"a"`\n\t*E\n}\n\nfunc (t *T[K]) M(a, b int, c ...string) (n int, err error) {\n\tif x := f(); x > 0 {\n\t\treturn 1, nil\n\t} else if y {\n\t\tgo func() { ch <- 1 }()\n\t}\n\tfor i, v := range []int{1, 2} {\n\t\tswitch z := v.(type) {\n\t\tcase int, *T[K]:\n\t\t\tfmt.Println(i, z)\n\t\tdefault:\n\t\t}\n\t}\n\tm := map[string]struct{ a int }{"k": {a: 1}}\n\tselect {\n\tcase <-ch:\n\t}\n\treturn\n}\n', True),
    ("a.go", "package p\n\nfunc f() {\n\tx := []int{\n\t\t1,\n\t\t2\n\t}\n}\n", False), ("a.go", "package p\nx := 1\n", False), ("a.go", "func f() {}\n", False), ("a.go", "package p\n\nfunc f()\n{\n}\n", False), ("a.go", "// c\n", True),
    ("a.php", "plain text { ( [\n", True), ("a.php", "<?php\nnamespace A\\B;\nuse C\\{D, E as F};\nabstract class G extends H implements I {\n use T;\n const X = 1;\n private ?int $a = null;\n public function __construct(private readonly string $b, int|string ...$c) {}\n public static function f(): static { return new static(...[1]); }\n}\n$x = fn($y) => match(true) { $y > 1, $y < 0 => 'a', default => throw new E() };\nforeach ($a as $k => [$b, $c]) { echo \"{$a['b']} $c->d\"; }\n$s = <<<TXT\n{ ( $x\nTXT;\n", True),
    ("a.php", "<ul><?php foreach ($rows as $row): ?><li><?= $row ?></li><?php endforeach; ?></ul>\n", True), ("a.php", "<?php foreach ($rows as $row): ?>x\n", False), ("a.php", "<?php\nfunction f( { }\n", False), ("a.php", "<?php\n$x = 1\n$y = 2;\n", False), ("a.php", "<?php\n// it's ?> { <?php echo 1;\n", True),
]


@pytest.mark.parametrize(("path", "text", "ok"), CASES)
def test_validity(path, text, ok):
    ext = path.split(".")[1]
    assert validity.is_valid(text, validity.LANGUAGES[ext], ext in ("jsx", "tsx", "js")) == ok


def test_chunk_maps_compose_in_any_grouping_and_never_refute_what_parses():
    r = random.Random(5)
    for path, text, ok in CASES:
        lang = validity.LANGUAGES[path.split(".")[1]]
        markup = path.endswith("jsx")  # which brackets in markup count is for the grammar to say
        for size in (5, 17, 60):
            chunks = [c for c, _ in validity.chunks_of(text.removeprefix("\ufeff"), size, lang)]
            assert "".join(chunks) == text.removeprefix("\ufeff")
            maps = [lexer_states.chunk_map(lang, c) for c in chunks]
            left = maps[0]
            for m in maps[1:]:
                left = lexer_states.compose(left, m)
            while len(maps) > 1:
                i = r.randrange(len(maps) - 1)
                maps[i : i + 2] = [lexer_states.compose(*maps[i : i + 2])]
            verdict = lexer_states.settle(lang, maps[0])
            assert verdict == lexer_states.settle(lang, left)
            assert markup or not (ok and verdict is False), (path, text, size)


def test_verdicts_do_not_depend_on_the_chunk(spark):
    long = "".join(f"export function f{i}(a) {{ return `${{a}} {i}` }}\n" for i in range(300))
    rows = [(p, t, "w", "x") for p, t, _ in CASES] + [("long.js", long, "w", None), ("cut.js", long[:-3], None, "x"), ("cut.js", long[:-3], None, "x"), ("null.py", None, "w", "x"), (None, "x", "w", "x"), ("other.txt", "{{", "w", "x")]
    files = spark.createDataFrame([(f"{k}/{p}" if p else None, t, w, x) for k, (p, t, w, x) in enumerate(rows)], "path string, content string, workspace string, lang string")
    seen = []
    for chunk in (200, 1 << 20):
        seen.append(sorted((r["path"], r["valid"]) for r in validity.verdicts(files, chunk).distinct().collect() if r["valid"] is not None))
    assert seen[0] == seen[1]
    got = dict(seen[0])
    for k, (p, _, ok) in enumerate(CASES):
        assert got[f"{k}/{p}"] == ok
    assert got[f"{len(CASES)}/long.js"] and not got[f"{len(CASES) + 1}/cut.js"]
    assert validity.verdicts(files.limit(0)).count() == 0
    assert validity.rates(validity.verdicts(files)).agg(F.sum("files")).first()[0] == len(CASES) + 3


@pytest.mark.parametrize(("comment", "name", "says"), [
    ("/** Loads the cache. */", "load", True), ("/** load */", "load", False), ("/** The loadCache function. */", "loadCache", False), ("// ------ load cache ------", "loadCache", False), ("/** LOAD CACHE! */", "loadCache", False), ("// Load cache from disk", "loadCache", True),
    ("// eslint-disable-next-line complexity", "f", False), ("# noqa: C901", "f", False), ("// #region helpers", "f", False), ("// Region of the map that is shown", "f", True), ("// region to string", "toString", False), ("/** endregion */", "f", False), ("// Coverage of the cache by tests", "f", True),
    ("/** TODO */", "f", False), ('"""Description here."""', "f", False), ("/** TODO: speed this up. Keeps each task in order. */", "f", True), ("// TODO: document this", "f", False), ("// n/a", "f", False), ("/** No description. */", "f", False),
    ("/**\n * @param a - the name\n * @returns the value\n */", "f", False), ("/** {@inheritDoc} */", "f", False), ("/**\n * Orders all rows.\n * @param a - x\n */", "f", True), ('"""\nArgs:\n    a: the name.\n"""', "f", False), ('    """Orders all rows.\n\n    Args:\n        a: the name.\n    """', "f", True),
    ("// Copyright (c) 2020 The Authors. All rights reserved.\n// SPDX-License-Identifier: MIT", "f", False), ("// @author nobody\n// @since 0.1", "f", False), ("// const a = load(b);\n// return a;", "f", False), ("'''page = lock(parser)\nreturn page\n'''", "f", False), ("# if a:\n#     b()", "f", False),
    ("/** Der Befehl liest alle Dateien. */", "f", True), ("// ソートされた行を返す", "f", True), ("/** <p>Removes <b>hook</b> rows.</p> */", "f", True), ("/**\n *\n */", "f", False), (None, "f", False), ("", "f", False), ("/** x. */", "f", False), ("// Never rejects twice", None, True),
])
def test_descriptions(comment, name, says):
    for lang in (None, "ts", "py"):
        assert (functions.describe(comment, name, lang) is not None) == says


def test_function_nodes_have_exact_ranges():
    ts = "export class A {\n  /** d */\n  run<T>(a: { b: string }): { c: T } {\n    return { c: 1 }\n  }\n  private x = 1\n}\nexport const f = async (a: number): Promise<void> => {\n  if (a) { g() }\n}\nconst h = (x) => x + 1\nfunction k() { function inner() { return '}' } }\n"
    got = {n: ts[a:b] for n, _, a, b in functions.function_nodes(ts, "ts")}
    assert got["run"].startswith("run<T>(") and got["run"].endswith("return { c: 1 }\n  }")
    assert got["f"].startswith("export const f") and got["f"].endswith("g() }\n}")
    assert got["h"] == "const h = (x) => x + 1" and got["inner"].endswith("return '}' }")
    py = "class A:\n    @deco\n    def f(self):\n        'é'\n        return 1\n"
    assert [(n, line, py[a:b]) for n, line, a, b in functions.function_nodes(py, "py")] == [("f", 3, "@deco\n    def f(self):\n        'é'\n        return 1")]
    go = "package p\nfunc (t *T) M() int {\n\treturn 1\n}\nfunc F() {\n\tg := func() { }\n}\n"
    assert {n for n, *_ in functions.function_nodes(go, "go")} == {"M", "F", "g"}
    assert functions.function_nodes("def f(:", "py") == [("f", 1, 0, 7)]  # what does not parse is told by its layout


def test_documented_pairs(spark):
    code = "/** d */\nfunction load(a) {\n  return a\n}\n"
    files = spark.createDataFrame([("w:a.js", code, "x"), ("w:a.js", code, "y"), ("w:null.js", None, "x")], "path string, content string, name string")
    schema = "id string, name string, kind string, file_path string, line int, comment string, code string"
    symbols = spark.createDataFrame([("1", "load", " Function", "w:a.js", 2, "/** Reads the file. */", "z"), ("1", "load", " Function", "w:a.js", 2, "/** Reads the file. */", "z"), ("2", "load", "method", "w:gone.js", 9, "// Writes the file", None), ("3", "x", "class", "w:a.js", 1, "// Holds the file", None), ("4", "x", "function", None, None, "// Holds the file", None), (None, "x", "function", "w:a.js", 2, "// Holds the file", None), ("5", None, "method", "w:a.js", 2, None, None), ("6", "load", "function", "w:a.js", 2, "/** load */", None)], schema)
    got = {r["symbol_id"]: r for r in functions.documented(symbols, files, without_node=True).collect()}
    assert set(got) == {"1", "2", "4"} and [r["symbol_id"] for r in functions.documented(symbols, files).collect()] == ["1"]
    assert got["1"]["code"] == code[9:-1] and got["1"]["description"] == "Reads the file." and got["2"]["code"] is None
    assert functions.documented(symbols.limit(0), files).count() == 0
    assert functions.documented(symbols, files.limit(0)).count() == 0
    assert functions.documented(symbols, files.limit(0), without_node=True).count() == 3


def test_comments_are_read_once(spark):
    """The parts with and without a node, and the filter on descriptions, share one reading of the comments."""
    files = spark.createDataFrame([("w:a.js", "function load(a) {\n  return a\n}\n")], "path string, content string")
    symbols = spark.createDataFrame([("1", "load", "function", "w:a.js", 1, "// Reads the file."), ("2", "gone", "function", "w:b.js", 1, "// Writes the file.")], "id string, name string, kind string, file_path string, line int, comment string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(functions.documented(symbols, files)).count("ArrowEvalPython") == 1
    both = functions.documented(symbols, files, with_code=False, without_node=True)
    assert "ArrowEvalPython" not in plan(both)  # they are written
    assert {r["symbol_id"]: r["description"] for r in both.collect()} == {"1": "Reads the file.", "2": "Writes the file."}


def test_python_functions_stand_in_any_block():
    blocks = ["if a:", "elif a:", "else:", "for x in y:", "else:", "while a:", "else:", "with a:", "try:", "except E:", "else:", "finally:", "class C:", "async def g():", "def h():"]
    text = "".join(f"{b}\n    def f{k}(x=lambda: 0): pass\n" for k, b in enumerate(blocks)) + "try:\n    def t1(): pass\nexcept* E:\n    def t2(): pass\nmatch a:\n    case 1 if b:\n        def m1(): pass\n    case _:\n        def m2():\n            def m3(): pass\n"
    want = [(n.name, n.lineno) for n in ast.walk(ast.parse(text)) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
    assert [found[:2] for found in functions.function_nodes(text, "py")] == want and len(want) == len(blocks) + 7


def test_generated_files(spark, small):
    body = "import { a } from './a.js'\n\n// Sorts rows by {k}.\nexport function sort{k}(rows) {{\n  if (rows.length > {k}) return rows\n  return rows.filter((row) => row.{w} !== undefined)\n}}\n"
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    rows = [(f"w:src/f{k}.ts", body.replace("{k}", str(k)).replace("{w}", words[k % 6]).replace("{{", "{").replace("}}", "}") * (1 + k % 5)) for k in range(120)]
    mini = lambda k: "".join(f"function {chr(97 + i % 26)}{k}(e,t){{return e&&t.{words[i % 6]}?e[{i}]:void 0}}" for i in range(40))
    rows += [(f"w:dist/m{k}.js", mini(k)) for k in range(20)] + [("w:lib/hidden.js", mini(77)), ("w:lib/noted.ts", "// Code generated by x. DO NOT EDIT.\n" + rows[3][1]), ("w:lib/hand.ts", "// Hand-written on purpose: the generated version was too slow.\n" + rows[4][1]), ("w:lib/own.ts", "// Copyright (c) 2020 the platform authors. All rights reserved.\n" + rows[5][1]), ("w:lib/text.ts", rows[6][1] + "const H = '// Code generated by x. DO NOT EDIT.'\n"), ("w:vendor/x/y.ts", None), ("w:lib/null.ts", None), (None, "x"), ("w:src/f1.ts", rows[1][1]), ("w:lib/empty.ts", "")]
    files = spark.createDataFrame([(p, c, 1.0) for p, c in rows], "path string, content string, score double")
    found = {r["path"] for r in generated.classify(files).where("found").collect()}
    assert found == {f"w:dist/m{k}.js" for k in range(20)} | {"w:lib/hidden.js", "w:lib/noted.ts", "w:vendor/x/y.ts"}
    assert generated.classify(files.limit(0)).count() == 0


def test_forest_finds_held_out_notices(spark, small):
    """Files whose notices are hidden are told from text alone: minified and machine-made ones score, hand-written ones do not."""
    out = generated.classify(spark.read.parquet(f"{small}/files.parquet"))
    row = out.where("score is not null").agg(F.avg(F.when(F.col("literal"), F.col("score"))).alias("data"), F.avg(F.when(~F.col("says") & ~F.col("literal"), F.col("score"))).alias("rest")).first()
    assert row["data"] > 0.7 and row["rest"] < 0.3


@pytest.mark.parametrize(
    ("ext", "text", "ok"),
    [
        ("jsx", "const A = () => <b onClick={() => { if (a) { f() } }}>x</b>\n", True),
        ("tsx", "const A = () => <ul>{xs.map((x) => { if (x) { return { a: { b: { c: <li {...{ d: { e: 1 } }}>{x /* } */}</li> } } } } })}</ul>\n", True),
        ("tsx", "const f = <T,>(a: T) => a\nconst g = <T extends B>(a: T) => <p>{a}</p>\n", True),
        ("js", "const A = () => (\n  // it's a note\n  <><i a='}' b={`{${<u/>}`}/> it's {/* c */} text</>\n)\n", True),
        ("jsx", "const A = () => <b onClick={() => { if (a) { f( } }}>x</b>\n", False),
        ("jsx", "const A = () => <p><b>{a b}</b></p>\n", False),
        ("jsx", "const A = () => <p><b></p>\n", False),
        ("js", "const t = `${xs.map(x => { if (x) { return g({a: 1}) } })}`\n", True),
        ("ts", "const t = " + "`a ${f({ b: " * 40 + "1" + " })} c`" * 40 + "\n", True),
        ("js", "const t = `${xs.map(x => { if (x) { return g({a: 1}) } })`\n", False),
        ("ts", "const t = " + "`a ${f({ b: " * 40 + "1 2" + " })} c`" * 40 + "\n", False),
        ("jsx", "const A = () => " + "<p>{f(() => { " * 60 + "1" + " })}</p>" * 60 + "\n", True),
    ],
)
def test_nesting_of_templates_and_markup_has_no_depth(ext, text, ok):
    assert validity.is_valid(text, validity.LANGUAGES[ext], ext in ("jsx", "tsx", "js")) == ok


def test_long_files_are_judged_as_short_ones(spark):
    line = 'x = f"{d.get("(")}"\n'
    rows = [("short.py", line), ("long.py", line * 1000), ("broken.py", line * 1000 + "f(\n")]
    assert dict(validity.verdicts(spark.createDataFrame(rows, "path string, content string")).select("path", "valid").collect()) == {"short.py": True, "long.py": True, "broken.py": False}


def test_python_beyond_the_interpreter_still_needs_its_brackets(monkeypatch):
    def deep(text):
        raise MemoryError

    monkeypatch.setattr(validity.ast, "parse", deep)
    assert validity.is_valid("f(1)\n", "py") and not validity.is_valid("f(1\n", "py")


def test_notices_are_read_to_their_end():
    line = "//# sourceMappingURL=data:application/json;base64,"
    assert generated.notice_in_header("f()\n" + line + "A" * 5000 + "\n")
    assert generated.notice_in_header("/*\n" + " * words\n" * 4000 + " * Code generated by x. DO NOT EDIT.\n */\nf()\n")
    assert not generated.notice_in_header("/*\n" + " * words\n" * 4000 + " */\nf()\n")


@pytest.mark.parametrize(("ext", "before", "inner", "after"), [("js", "x = ", "([", "])"), ("ts", "let x = ", "([", "])"), ("go", "package p\n\nvar x = ", "((", "))"), ("php", "<?php $x = ", "([", "])")])
def test_any_depth_has_the_verdict_of_a_small_one(ext, before, inner, after):
    end = "\n" if ext == "go" else ";\n"
    for n in (3, 5_000):
        for middle, ok in (("1", True), ("1 1 +*", False)):
            assert validity.is_valid(before + inner * n + middle + after * n + end, ext) == ok


def test_backtracking_never_repeats_what_failed():
    assert validity.is_valid("x = " + "(a = " * 60 + "1" + ")" * 60 + ";\n", "js")
    assert not validity.is_valid("package p\n\nvar x = " + "a[" * 60 + "1 1 +*" + "]" * 60 + "\n", "go")


def test_all_methods_of_a_large_class():
    text = "class A extends mixin(B)<{ a: 1 }> {\n" + "".join(f"  m{k}(a) {{ return [a]; }}\n" for k in range(12_000)) + "}\n"
    assert len(functions.function_nodes(text, "ts")) == 12_000


@pytest.mark.parametrize(("lang", "text", "names"), [
    ("py", "@d\ndef a(x,\n      y):\n    return 1\n\nclass B:\n    def m(self):\n        def inner(): pass\n        x = (\n    def n(self): return 2\ndef z(): 1 +\n", ["a", "inner", "m", "n", "z"]),
    ("js", "function a() { if (x) { }\nfunction b() { return 1 }\n", ["a", "b"]), ("ts", "class A { m() { f(] } n() { } }", ["m", "n"]), ("go", "package p\nfunc a() {}\nfunc b( {\n", ["a"]), ("py", "", []),
])
def test_functions_of_broken_texts(lang, text, names):
    found = functions.function_nodes(text, lang)
    assert sorted(n for n, *_ in found) == names
    assert all(0 <= a < b <= len(text) and name in text[a:b] for name, _, a, b in found)


def test_runs_have_the_verdict_of_the_whole(spark, small):
    files = spark.read.parquet(f"{small}/files.parquet")
    whole = {(r["path"], r["version"], r["at"]): r["valid"] for r in validity.verdicts(files, 1 << 30).collect()}
    for size in (200, 1_000):
        assert {(r["path"], r["version"], r["at"]): r["valid"] for r in validity.verdicts(files, size).collect()} == whole


def test_held_out_labels(spark, small):
    got = {r["sign"]: r for r in generated.held_out(spark.read.parquet(f"{small}/files.parquet")).collect()}
    assert all(0 <= r["found"] <= r["rows"] for r in got.values())
    assert generated.held_out(spark.read.parquet(f"{small}/files.parquet").limit(0)).count() == 0
