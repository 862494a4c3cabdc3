"""Cutting files into blocks: goldens per language."""

from dataclasses import replace

from pyspark.sql import functions as F

from corpusloom.operators import extract as ops
from corpusloom.operators.languages import DEFAULT_LANGUAGES, TYPESCRIPT, language_of, language_specs


def cut(spark, path, text, languages=DEFAULT_LANGUAGES):
    files = spark.createDataFrame([(path, text)], "filepath string, content string")
    return [r.asDict() for r in ops.extract_blocks(files, languages).orderBy("ordinal").collect()]


def brief(rows):
    return [(r["code_type"], r["class_name"] or r["function_name"], r["start_line"], r["end_line"]) for r in rows]


PY = '''
limit = 3

def area(w: int, h=dict(a=1, b=[2, 3])) -> int:
    """def fake(x):
return 0
"""
    if w > (
        limit
    ):
        return 0  # class Fake(Base):

    return w * h
# def commented(): pass

@cached
async def fetch(
    url: str,
    *args,
    **kw,
) -> dict[str, int]:
    async with get(url) as r:
        return await r

@final
class Shape(geo.Base, Mixin, metaclass=Meta):
    "class in a string: def x():"
    side = 1

    @property
    def name(self):
        def inner(a, b): return a
        return 'it\\'s' + inner(1, 2)

    class Part:
        def weight(self) -> float:
            return 1.0

total = area(1, 2)
'''


def test_python_blocks(spark):
    rows = cut(spark, "a/b.py", PY)
    assert brief(rows) == [
        ("class", "Shape", 25, 36),
        ("class", "Part", 34, 36),
        ("function", "area", 3, 12),
        ("function", "fetch", 16, 22),
        ("function", "name", 30, 32),
        ("function", "inner", 31, 31),
        ("function", "weight", 35, 36),
        ("global", None, None, None),
    ]
    shape, part, area, fetch, name, inner, weight, rest = rows
    assert shape["inputs"] == ["Mixin"] and shape["all_bases"] == ["Base", "Mixin"]
    assert shape["code"].startswith("class Shape(geo.Base") and shape["code"].endswith("return 1.0")
    assert shape["summary"] == (
        "class: Shape\n    parent classes: ('Mixin',)\n\n"
        "    method: name\n        input parameters: ('self',)\n        output parameters: None\n        code: ...\n"
    )
    assert part["inputs"] is None and "parent classes: None" in part["summary"]
    assert area["inputs"] == ["w: int", "h=dict(a=1, b=[2, 3])"] and area["outputs"] == ["int"]
    assert area["code"].endswith("return w * h")
    assert fetch["code"].startswith("async def fetch(\n") and fetch["inputs"] == ["url: str", "*args", "**kw"]
    assert fetch["outputs"] == ["dict[str, int]"]
    assert name["owner_class"] == "Shape" and weight["owner_class"] == "Part" and area["owner_class"] is None
    assert inner["code"] == "def inner(a, b): return a"
    assert rest["code"] == "limit = 3\n\n# def commented(): pass\n\n@cached\n\n@final\n\ntotal = area(1, 2)\n"
    assert all(r["language"] == "python" for r in rows)


PHP = r'''<?php
namespace App;
// function nope() {
# class Nope {
$text = "function nope() { $x }";
function greet(string $name, array $opts = ['a' => 1, 'b' => [2]]): ?string
{
    $f = function ($x) { return $x; };
    return "hi {$name}"; /* } */
}
abstract class Box extends \Lib\Base implements Thing {
    private $n = 1;
    abstract protected function size(): int|float;
    public static function make() {
        if (true) { return new class { public $z; }; } else { return Box::class; }
    }
}
interface Thing { public function act($a); }
'''


def test_php_blocks(spark):
    rows = cut(spark, "x.php", PHP)
    assert brief(rows) == [
        ("class", "Box", 10, 16),
        ("function", "greet", 5, 9),
        ("function", "size", 12, 12),
        ("function", "make", 13, 15),
        ("function", "act", 17, 17),
        ("global", None, None, None),
    ]
    box, greet, size, make, act, rest = rows
    assert box["inputs"] == ["Base"]
    assert [line for line in box["summary"].split("\n") if "method:" in line] == [
        "    method: size",
        "    method: make",
    ]
    assert greet["inputs"] == ["string $name", "array $opts = ['a' => 1, 'b' => [2]]"]
    assert greet["outputs"] == ["?string"] and size["outputs"] == ["int", "float"]
    assert size["code"] == "abstract protected function size(): int|float;"
    assert make["code"].startswith("public static function make() {") and make["inputs"] is None
    assert act["inputs"] == ["$a"]
    assert rest["code"].startswith("<?php\nnamespace App;\n// function nope() {")


TS = r'''import { a } from './a';
const f = function named(x) { return x; };
export async function load<T>(id: number, opt: Map<string, number> = new Map()): Promise<T> {
    const msg = `class ${id} {`;
    while (id) { call(id); }
    return fetch(`/x/${id}`); // function nope() {
}
export default class Store extends Base.Core implements Sink, Other {
    private cache = new Map<string, () => void>();
    constructor(private readonly key: string, cb = (e) => { return e; }) {
        super();
    }
    get size(): number { return this.cache.size; }
    async *items({ a, b }: Opts): AsyncIterable<{ n: number }> {
        for (const x of y) { if (x) { yield x; } }
    }
    handler = (e: Event) => { run(e); };
}
abstract class Hidden {
    abstract name(): string;
    show() { return 'x'; }
}
interface Opts { call(x: number): void; }
'''


def test_typescript_blocks(spark):
    rows = cut(spark, "s.tsx", TS)
    assert brief(rows) == [
        ("class", "Store", 7, 17),
        ("function", "load", 2, 6),
        ("function", "constructor", 9, 11),
        ("function", "size", 12, 12),
        ("function", "items", 13, 15),
        ("function", "show", 20, 20),
        ("global", None, None, None),
    ]
    store, load, ctor, size, items, show, rest = rows
    assert store["inputs"] == ["Base"] and store["code"].startswith("class Store")
    assert load["code"].startswith("async function load<T>(") and load["code"].endswith("}")
    assert load["inputs"] == ["id: number", "opt: Map<string, number> = new Map()"]
    assert load["outputs"] == ["Promise<T>"]
    assert ctor["inputs"] == ["private readonly key: string", "cb = (e) => { return e; }"]
    assert size["code"] == "get size(): number { return this.cache.size; }" and size["outputs"] == ["number"]
    assert items["inputs"] == ["{ a, b }: Opts"] and items["owner_class"] == "Store"
    assert "import { a }" in rest["code"] and "interface Opts" in rest["code"] and "Store" not in rest["code"]


EDGES = {"empty": "", "blank": "  \n\n", "plain": "Only text, no code."}

SQL = """
-- all; of it
WITH s AS (
    SELECT a FROM t WHERE x = 'insert; into'
)
-- then
SELECT s.a
FROM s;

UPDATE t SET a = 1 WHERE b IN (SELECT b FROM u);
DELETE FROM t; INSERT INTO t VALUES (1, ';'), (2, 'it''s');
CREATE TABLE skipped (a int);
CREATE OR REPLACE FUNCTION f(a INT) RETURNS INT AS $body$
BEGIN
    RETURN (SELECT 1);
END;
$body$ LANGUAGE plpgsql;
SELECT f(5)
"""


def test_sql_statements(spark):
    rows = cut(spark, "q.sql", SQL)
    assert [(r["code_type"], r["start_line"], r["end_line"]) for r in rows] == [
        ("select", 2, 7),
        ("update", 9, 9),
        ("delete", 10, 10),
        ("insert", 10, 10),
        ("function", 12, 16),
        ("select", 17, 17),
    ]
    assert rows[0]["code"].startswith("WITH s AS") and rows[0]["code"].endswith("FROM s")
    assert rows[3]["code"] == "INSERT INTO t VALUES (1, ';'), (2, 'it''s')"
    assert rows[4]["function_name"] is None
    assert cut(spark, "bad.sql", "SELECT FROM t;")[0]["code"] == "SELECT FROM t"
    assert [r["code_type"] for r in cut(spark, "c.sql", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a")] == [
        "insert"
    ]


def test_edge_files(spark):
    rows = [(f"{case}.{end}", text) for end in ("py", "php", "ts") for case, text in EDGES.items()]
    files = spark.createDataFrame([*rows, ("notes.md", "# x")], "filepath string, content string")
    got = [(r["filepath"], r["code_type"], r["code"]) for r in ops.extract_blocks(files).collect()]
    assert sorted(got) == sorted((f"plain.{e}", "global", EDGES["plain"]) for e in ("py", "php", "ts"))


def test_decorated_and_blank_lines(spark):
    rows = cut(spark, "d.py", "\nx = 1\n\ndef f() -> str:\n    return 'a'\n\n@d\ndef f() -> str:\n    return 'a'\n")
    assert rows[-1]["code"] == "x = 1\n\n\n@d\n"
    assert rows[0]["code"] == rows[1]["code"] == "def f() -> str:\n    return 'a'"
    only = cut(spark, "d.ts", "\nfunction f(): string {\n    return 'a';\n}\n\nexport async function g() {\n}\n")
    assert [r["code_type"] for r in only] == ["function", "function"]


def test_spans_agree_with_code(spark):
    files = spark.createDataFrame([("a.py", PY), ("b.php", PHP), ("c.ts", TS)], "filepath string, content string")
    for r in ops.extract_blocks(files).filter("start_line is not null").collect():
        assert r["code"].count("\n") == r["end_line"] - r["start_line"]
    names = {r["name"] for r in ops.spans(ops.extract_blocks(files)).collect()}
    assert {"Shape", "greet", "load"} <= names


def test_new_language_is_a_row(spark):
    script = replace(TYPESCRIPT, name="javascript", suffixes=(".js",))
    languages = (script,)
    assert brief(cut(spark, "a.js", "function f(a) {\n  return a;\n}\n", languages)) == [("function", "f", 0, 2)]
    assert cut(spark, "a.js", "function f(a) {}") == []
    assert language_specs(spark, languages).filter("language = 'javascript'").count() == 1


def test_balance(spark):
    cases = [("a.py", "f(x)['}']", True), ("a.py", "f(x", False), ("a.py", "", True), ("a.py", "x = 'a", False)]
    cases += [("a.ts", "`${a}` + (']')", True), ("a.php", "$a = [1);", False), ("a.py", ")(", False)]
    rows = spark.createDataFrame(cases, "p string, t string, want boolean")
    got = rows.select("want", ops.is_balanced(F.col("t"), language_of(F.col("p"))).alias("b")).collect()
    assert [r["b"] for r in got] == [r["want"] for r in got]


def test_outline(spark):
    files = spark.createDataFrame(
        [("m.py", "class A(B):\n    def go(self, x) -> int:\n        return x\n")], "filepath string, content string"
    )
    asked = spark.createDataFrame([("m.py",), ("no.py",), ("",)], "filepath string")
    got = {r["filepath"]: r["outline"] for r in ops.summarize_files(files, asked).collect()}
    assert got["m.py"] == (
        "Class: A\n\tParent Classes: B\n\tmethod: go\nFunction: go\n\tInput Parameters: self, x\n\tOutput Parameters: int"
    )
    assert got["no.py"] == "File not found: no.py"


def test_large_file_stays_linear(spark):
    text = "".join(f"def f_{i}(a, b):\n    '''doc {i}'''\n    return a\n\n" for i in range(3000))
    assert len(cut(spark, "big.py", text)) == 3000


def test_docstring_that_ends_in_a_backslash(spark):
    text = 'def a():\n    """Path: C:\\\\"""\n    return 1\n\ndef b():\n    """two"""\n    return 2\n\ndef c():\n    return 3\n'
    assert brief(cut(spark, "x.py", text))[:3] == [("function", "a", 0, 2), ("function", "b", 4, 6), ("function", "c", 8, 9)]


def test_regular_expressions_and_nested_templates(spark):
    text = (
        "class A {\n  m(x: string) {\n    const r = x.replace(/[{]'/g, '');\n    return r / 2 / 1;\n  }\n}\n"
        "function f(a: string[]) {\n  return `<${a.map(x => `{${x}`).join('}')}>`;\n}\nfunction g() {\n  return 1;\n}\n"
    )
    found = brief(cut(spark, "x.ts", text))
    assert ("class", "A", 0, 5) in found and ("function", "f", 6, 8) in found and ("function", "g", 9, 11) in found


def test_heredoc_with_quotes_and_braces(spark):
    text = (
        "<?php\nfunction f() {\n    $t = <<<EOT\n    it's {a\n    EOT;\n    return $t;\n}\n"
        "function g() {\n    return <<<'X'\nit's }\nX;\n}\nfunction h() { return 1 << 2; }\n"
    )
    found = brief(cut(spark, "x.php", text))
    assert [b for b in found if b[0] == "function"] == [
        ("function", "f", 1, 6), ("function", "g", 7, 11), ("function", "h", 12, 12)
    ]
