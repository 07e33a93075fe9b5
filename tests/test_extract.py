"""The declaration scanner on texts that mislead simpler ones, and imports across folders."""

import random
import time

import pytest

from evispark.sources import extract

TEXT = """const a = 1, b: string = "x, y", c = `t ${ {k: [1,2]}.k.join(", ") } } end`;
let re = /[{/]"'`/g, d = a / b / 2;
function over(x: number): void;
function over(x: string): void;
function over(x: any) { return x.replace(/}/g, "{"); }
export const obj = { f: 1 }, tail = () => { return `a${`in ${1}`}b`; }, last;
class K<T> { m = 1; get(): Map<string, number> { return `}`; } }
// const no = 1
const f = (p: A<B, C>, q) => p, g = [1, 2];
"""


def test_declarations():
    found = [(path, kind.removesuffix("Declaration"), line, end) for _, path, kind, _, line, end in extract.declarations(TEXT)]
    v = "Variable"
    assert found == [
        ("a", v, 1, 1), ("b", v, 1, 1), ("c", v, 1, 1), ("re", v, 2, 2), ("d", v, 2, 2), ("over", "Function", 3, 3), ("over", "Function", 4, 4), ("over", "Function", 5, 5),
        ("obj", v, 6, 6), ("tail", v, 6, 6), ("last", v, 6, 6), ("K", "Class", 7, 7), ("K.m", "Property", 7, 7), ("K.get", "Method", 7, 7), ("f", v, 9, 9), ("g", v, 9, 9),
    ]
    signatures = {path: s for _, path, _, s, _, _ in extract.declarations(TEXT)}
    assert signatures["b"] == 'const b: string = "x, y"' and signatures["f"] == "const f = (p: A<B, C>, q) => p" and signatures["last"] == "const last"


def test_code_keeps_places():
    clean = extract.code_of(TEXT)
    assert len(clean) == len(TEXT) and [i for i, c in enumerate(clean) if c == "\n"] == [i for i, c in enumerate(TEXT) if c == "\n"]
    assert "no" not in clean and "end" not in clean and "a / b / 2" in clean and "{k: [1,2]}.k.join(" in clean
    r = random.Random(1)
    for _ in range(3000):  # whatever is not closed ends with the text
        x = "".join(r.choice("`${}/*\\\"'a \n=(") for _ in range(r.randrange(12)))
        assert len(extract.code_of(x)) == len(x)
        list(extract.declarations(x))


def test_time_grows_with_the_text():
    def took(n):
        text = "".join(f"export const v{i} = `x${{{i}}}`;\n" for i in range(n))
        began = time.process_time()
        assert sum(1 for _ in extract.declarations(text)) == n
        return time.process_time() - began

    took(500)
    assert took(16_000) < 20 * max(took(2000), 0.01)


@pytest.mark.parametrize("depth", [1, 3, 40])
def test_imports_over_any_number_of_steps_up(spark, depth):
    below = "/".join(f"d{i}" for i in range(depth))
    files = [("src/base.ts", "export class Base {}"), (f"src/{below}/leaf.ts", f"import {{ Base as B, type Other }} from './.{'/..' * depth}/base';\nimport {{ x }} from '../' + y"), ("src/none.ts", None)]
    got = extract.imports(spark.createDataFrame(files, "path string, text string"))
    assert {tuple(r) for r in got.collect()} == {(f"src/{below}/leaf.ts", "Base", "src/base.ts"), (f"src/{below}/leaf.ts", "Other", "src/base.ts")}


def test_sources_of_very_many_spans_of_one_file(spark):
    n = 30_000
    files = spark.createDataFrame([("big", "\n".join(f"line {i}" for i in range(1, n + 1))), ("small", "a\r\nb\nc\n"), ("none", None)], "path string, text string")
    odd = [("small", 1, 3), ("small", 2, 2), ("small", 2, 2), ("small", 3, 9), ("small", 5, 6), ("small", 3, 2), ("none", 1, 1), ("gone", 1, 1), ("small", None, 1), ("small", 2, 2_000_000_000)]
    spans = spark.range(1, n + 1, 1, 4).selectExpr("'big' path", "cast(id as int) line", "cast(id as int) end_line").unionByName(spark.createDataFrame(odd, "path string, line int, end_line int"))
    began = time.time()
    got = [tuple(r) for r in extract.source_of(files, spans).select("path", "line", "end_line", "source").collect()]
    assert time.time() - began < 60
    big = {r[1]: r[3] for r in got if r[0] == "big"}
    assert big == {i: f"line {i}" for i in range(1, n + 1)}
    want = [("small", 1, 3, "a\nb\nc"), ("small", 2, 2, "b"), ("small", 2, 2, "b"), ("small", 3, 9, "c"), ("small", 5, 6, ""), ("small", 3, 2, ""), ("none", 1, 1, None), ("small", None, 1, None), ("small", 2, 2_000_000_000, "b\nc")]
    assert sorted((r for r in got if r[0] != "big"), key=str) == sorted(want, key=str)
